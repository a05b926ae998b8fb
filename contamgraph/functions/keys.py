"""Entity keys and graph ids as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the published pattern of accessions.
_UNIPROT = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def ligand_id(canonical: Column) -> Column:
    """Null where nothing canonical is known."""
    return F.concat(F.lit("lig:"), F.md5(canonical))


def scaffold_id(scaffold: Column) -> Column:
    """The empty scaffold is an entity of its own."""
    return F.concat(F.lit("sca:"), F.md5(F.coalesce(scaffold, F.lit(""))))


def example_id(source: Column, target: Column, row: Column) -> Column:
    return F.concat_ws(":", F.lit("ex"), source, F.coalesce(target, F.lit("")), row.cast("string"))


def target_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("tgt:"), source, F.lit(":"), target)


def split_id(source: Column, split: Column) -> Column:
    return F.concat(F.lit("split:"), source, F.lit(":"), split)


def is_accession(c: Column) -> Column:
    """The three published forms of a protein accession."""
    return c.rlike(_UNIPROT)


def collapsed(text: Column) -> Column:
    """Full key text: runs of white space are one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def letters_only(text: Column) -> Column:
    """Parent key text: a-z of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def first_sentence(text: Column) -> Column:
    """Scaffold text: up to the first stop or line end, lower-cased; may be empty."""
    return F.lower(F.regexp_extract(text, r"^[^.\n]*", 0))


def row_key(columns: list[str]) -> Column:
    """Whole-row key: null-preserving text of all columns, joined by the unit separator."""
    return F.concat(*[x for c in columns for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\x1f"))])


def pair(a: Column, b: Column) -> tuple[Column, Column]:
    """An unordered pair in sorted order."""
    return F.least(a, b), F.greatest(a, b)


def pocket_entry(pocket: Column) -> Column:
    """Entry name of a pocket construct ``ENTRY_ORG_start_end[_n]``; other ids unchanged."""
    return F.coalesce(F.nullif(F.regexp_extract(pocket, r"^([A-Za-z0-9]+_[A-Za-z0-9]+)_\d+_\d+(_\d+)?$", 1), F.lit("")), pocket)


def pocket_name(pocket: Column) -> Column:
    """Entry name of a pocket construct of at least five parts whose last three are numbers; null for other ids."""
    return F.nullif(F.regexp_extract(pocket, r"^([^_]*_[^_]*)(_[^_]*)*_\d+_\d+_\d+$", 1), F.lit(""))


def stereo_free_text(smiles: Column) -> Column:
    """Molecule text without its stereo marks (for texts that cannot be parsed)."""
    return F.translate(smiles, "/\\@", "")
