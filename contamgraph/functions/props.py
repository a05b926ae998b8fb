"""Typed properties: built as structs, serialised once, read by JSON path."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "{}"


def props(**fields: Column) -> Column:
    """JSON object with its fields in the given order; null values are kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def empty() -> Column:
    return F.lit(EMPTY)


def text(column: Column | str, field: str) -> Column:
    """A field as text; null where absent or JSON null."""
    return F.get_json_object(column, f"$.{field}")


def number(column: Column | str, field: str) -> Column:
    """A field as double; null where absent or no number."""
    return text(column, field).try_cast("double")


def any_of(column: Column | str, *fields: str) -> Column:
    """The first of several field names that is present."""
    return F.coalesce(*(text(column, f) for f in fields))


def spliced(column: Column, fields: dict[str, Column], quoted: bool = True) -> Column:
    """JSON object with more fields appended, as strings or as they are; null if a new value is null."""
    q = '"' if quoted else ""
    add = F.concat(*[x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(("," if i else "") + f'"{k}":{q}'), v, F.lit(q))])
    return F.when(column == EMPTY, F.concat(F.lit("{"), add, F.lit("}"))).otherwise(
        F.concat(F.regexp_replace(column, r"\}$", ""), F.lit(","), add, F.lit("}"))
    )


def has_nul(column: Column) -> Column:
    return F.contains(column, F.char(F.lit(0)))
