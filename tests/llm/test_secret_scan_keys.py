import random
import string

from contamgraph.llm import secret_scan as S

SURE = 0.9


def random_spans(text):
    return [(s, e) for s, k, e in S.spans_of(text, S.default_vocabulary()) if S.KINDS[k] == "random"]


def share(alphabet, length, cut=0, n=60):
    rng = random.Random(length)
    keys = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(n)]
    if cut:
        keys = ["-".join(k[i : i + cut] for i in range(0, length, cut)) for k in keys]
    return sum(random_spans(f"key is {k} ok") == [(7, 7 + len(k))] for k in keys) / n


def test_keys_of_letters():
    assert share(string.ascii_letters, 40) >= SURE and share(string.ascii_lowercase, 40) >= SURE and share(string.ascii_uppercase, 40) >= SURE
    assert share(string.ascii_letters, 20) >= SURE


def test_keys_in_parts():
    assert share(string.ascii_letters, 24, cut=4) >= SURE
    assert random_spans("licence aQxZ-4821-LkTw-9930-PqRz-1187 for you") == [(8, 37)]


def test_short_keys():
    assert share(string.ascii_letters + string.digits, 16) >= SURE


def test_words_and_numbers_stay():
    fine = [
        "Donaudampfschifffahrtsgesellschaft", "THEREFOREANDTHUSWESHOUTLOUDLY", "getElementByIdFromDocumentObjectModel", "XMLHttpRequestFactory", "2024-01-15_2024-01-16_000123",
        "log-2024-01-15-10-22-33-44", "v-1-2-3-4-5-6-7-8-9-10-11-12", "20240115T102233Z", "x86_64-linux-gnu", "RTX-2080Ti-11GB", "org/apache/spark/sql/catalyst", "en-de-fr-es-it-pt-nl-sv", "x" * 300, "ACGTTGCA" * 20, "antidisestablishmentarianism",
        "24be64439e3e", "/en/articles/the-long-title-of-a-page",
    ]
    assert not [t for t in fine if random_spans(f"see {t} now")]
