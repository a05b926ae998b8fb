"""URL filter: pattern rules indexed by their rarest literal token.  DataFrame operations only.

A URL is cut into tokens (runs of letters and digits, A-Z lower-cased).  Each rule
has literal tokens that every URL it fits must contain whole; it is filed under
the one that the fewest URLs contain.  URLs fetch candidate rules by their tokens
through an equi-join with that index, and only candidates run their regular
expression.  Rules without a whole literal token are filed under the empty token,
which every URL has.

Two kinds of rule share the index.  *Host rules* (host, path, action) fit a host
and its subdomains where the URL's path starts with the rule's path; the longest
wins (on equal length, allow; then the rule that sorts first).  *Patterns* give the
verdict where no host rule fits: ``||`` anchors at a host or a subdomain, ``|`` at
the start or end, ``*`` is any text, ``^`` a separator or the end; ``@@`` makes an
exception, which beats blocking patterns.  Patterns ignore case.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  A null URL, or one
without ``://``, has neither and is allowed.  Rows may repeat and page ids may be
null: rows meet their verdict by URL, and each distinct URL is judged once.  Other
columns of the pages are kept, except that ``host``, ``path``, ``rule``,
``verdict`` and ``pattern`` are replaced.

Rules and their literal tokens travel by broadcast while they are at most
``BROADCAST_RULES``; beyond that they are joined by a shuffle.  Pages without a URL are
spread over the tasks of the last join, which they cannot match.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The default patterns.
DEFAULT_PATTERNS = (
    "||spam-farm.example.org^",
    "||doubleclick.net^",
    "||adservice.*/ads/",
    "/wp-login.php^",
    "/xmlrpc.php^",
    "/cgi-bin/*.exe",
    "/phishing/",
    "^casino^",
    "^viagra^",
    "@@||example.org^about^",
)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text) if text.isascii() else "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _whole_tokens(text: str, open_start: bool, open_end: bool) -> list[str]:
    """Tokens of a literal piece that must stand whole in any text it fits."""
    out = []
    for m in re.finditer(r"[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))):
        if (m.start() or not open_start) and (m.end() < len(text) or not open_end):
            out.append(m[0])
    return out


def compile_host_rule(host: str, path: str, action: str) -> tuple:
    if path and not path.startswith("/"):
        raise ValueError(f"a rule's path starts with /: {path!r}")
    if action not in ("allow", "block"):
        raise ValueError(f"unknown action {action!r}")
    host = host.translate(str.maketrans(_UPPER, _LOWER))
    regex = r"(?s)^(?:[^/]*\.)?" + _quoted(host) + (_quoted(path) if path else r"(?:/|\z)")
    # the host ends where the path starts, so only the path's own end is open
    tokens = _whole_tokens(host, False, False) + _whole_tokens(path, False, True)
    return "host", host + path, action, regex, tokens


def compile_pattern(pattern: str) -> tuple:
    body, action = (pattern[2:], "allow") if pattern.startswith("@@") else (pattern, "block")
    start = end = ""
    if body.startswith("||"):
        start, body = r"^(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        start, body = "^", body[1:]
    if body.endswith("|"):
        end, body = r"\z", body[:-1]
    parts = re.split(r"([*^])", body)
    regex = "".join(".*" if p == "*" else r"(?:[^A-Za-z0-9_.%-]|\z)" if p == "^" else _quoted(p) for p in parts)
    tokens = []
    for i, p in enumerate(parts):
        if p and p not in "*^":
            before = parts[i - 1] if i else ("" if not start else "^")
            after = parts[i + 1] if i + 1 < len(parts) else ("^" if end else "")
            tokens += _whole_tokens(p, before != "^", after != "^")
    return "pattern", pattern, action, "(?is)" + start + regex + end, tokens


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, rest after the host)."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(after, r"^[^?#]*", 0), after


def filter_urls(pages: DataFrame, host_rules: list[tuple[str, str, str]], patterns: tuple[str, ...] = DEFAULT_PATTERNS, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and the pattern that decided."""
    spark = pages.sparkSession
    rules = [compile_host_rule(*r) for r in host_rules] + [compile_pattern(p) for p in patterns]
    host, path, after = split_url(F.col("judged_url"))
    urls = (
        pages.select(F.col(url_col).alias("judged_url")).where(F.contains(url_col, F.lit("://"))).distinct()
        .select("judged_url", F.concat(host, path).alias("place"), F.concat(host, after).alias("whole"))
    )
    tokens = F.split(F.translate("whole", _UPPER, _LOWER), "[^a-z0-9]+")
    by_token = urls.select("*", F.explode(F.array_distinct(F.concat(tokens, F.array(F.lit(""))))).alias("token"))

    literals = sorted({t for r in rules for t in r[4]})
    seen = spark.createDataFrame([(t,) for t in literals], "token string")
    # as many rows as the rules have literal tokens
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_RULES else df
    count = {r["token"]: r["n"] for r in by_token.join(small(seen, len(literals)), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}
    index = [(min(r[4], key=lambda t: (count.get(t, 0), t)) if r[4] else "", *r[:4]) for r in rules]
    table = spark.createDataFrame(index, "token string, kind string, name string, action string, regex string")
    candidates = by_token.join(small(table, len(index)), "token")
    target = F.when(F.col("kind") == "host", F.col("place")).otherwise(F.col("whole"))
    fits = candidates.where(F.rlike(target, F.col("regex")))
    is_host = F.col("kind") == "host"
    allow = F.col("action") == "allow"
    order = F.struct((-F.length("name")).alias("l"), (~allow).alias("a"), F.col("name").alias("n"), F.col("action").alias("v"))
    pattern = F.struct((~allow).alias("a"), F.col("name").alias("n"), F.col("action").alias("v"))
    verdicts = fits.groupBy("judged_url").agg(F.min(F.when(is_host, order)).alias("r"), F.min(F.when(~is_host, pattern)).alias("p"))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")]
    key = F.coalesce(url_col, F.concat(F.lit("\0"), F.spark_partition_id()))  # no judged URL is like that
    joined = pages.select(*own, key.alias("_judged_key")).join(verdicts, F.col("_judged_key") == F.col("judged_url"), "left")
    h, p, _ = split_url(F.col(url_col))
    return joined.select(
        *own, h.alias("host"), p.alias("path"), F.col("r.n").alias("rule"),
        F.coalesce("r.v", "p.v", F.lit("allow")).alias("verdict"), F.when(F.col("r").isNull(), F.col("p.n")).alias("pattern"),
    )
