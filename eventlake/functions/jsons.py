"""JSON kept as text: single fields, and one typed parse for many fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.schemas import JsonPath


def json_text(column: Column | str, key: str) -> Column:
    """Text of one top-level field."""
    return F.get_json_object(column, f"$.{key}")


def json_schema(leaves: Iterable[tuple[JsonPath, T.DataType]]) -> T.StructType:
    """Struct that covers just the wanted paths, for one from_json call."""
    by_key: dict[str, list[tuple[JsonPath, T.DataType]]] = {}
    for path, kind in leaves:
        by_key.setdefault(path[0], []).append((path[1:], kind))

    def node(rest: list[tuple[JsonPath, T.DataType]]) -> T.DataType:
        if any(not path for path, _ in rest):
            return rest[0][1]
        if isinstance(rest[0][0][0], int):
            return T.ArrayType(node([(path[1:], kind) for path, kind in rest]))
        return json_schema(rest)

    return T.StructType([T.StructField(key, node(rest)) for key, rest in by_key.items()])


def json_path(parsed: Column, path: JsonPath) -> Column:
    """Follow a path through a parsed struct; a missing list item gives NULL."""
    for key in path:
        parsed = F.get(parsed, F.lit(key)) if isinstance(key, int) else parsed.getField(key)
    return parsed


# A cast that fails costs an exception per row, so text that cannot be a number is kept from it.
_NUMBER_LIKE = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:nan|inf|infinity))\s*$"
_DIGITS = r"^\s*[+-]?[0-9]+\s*$"


def as_double(text: Column) -> Column:
    """Number from a JSON leaf, NULL where it is none."""
    return F.when(text.rlike(_NUMBER_LIKE), text.try_cast("double"))


def as_bigint(text: Column) -> Column:
    """Whole number from a JSON leaf: fractions are rounded, true and false count as 1 and 0."""
    return F.coalesce(
        F.when(text.rlike(_DIGITS), text.try_cast("bigint")),
        F.round(as_double(text)).try_cast("bigint"),
        F.when(text == "true", F.lit(1)).when(text == "false", F.lit(0)).cast("bigint"),
    )


def list_count(items: Column) -> Column:
    return F.coalesce(F.array_size(items), F.lit(0)).cast("bigint")


def is_malformed(text: Column) -> Column:
    """True where text is present but is not exactly one JSON value."""
    # a mark behind the value is only the second item if nothing else is; no text holds its own hash
    mark = F.xxhash64(text).cast("string")
    second = F.get_json_object(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "$[1]")
    return text.isNotNull() & ~second.eqNullSafe(mark)
