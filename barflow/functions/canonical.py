"""Canonical JSON and text normalising as column functions.

The form is that of compact JSON with sorted keys and ASCII escapes, so digests agree with those that other programs take of the
same record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = r"^[\x20\x21\x23-\x5B\x5D-\x7E]*$"
_SHORT = {"0022": '\\"', "005c": "\\\\", "000a": "\\n", "000d": "\\r", "0009": "\\t", "0008": "\\b", "000c": "\\f"}


def json_text(c: Column) -> Column:
    """A JSON string; all but printable ASCII is escaped by UTF-16 units in lower-case hex."""
    text = F.coalesce(c, F.lit(""))
    digits = F.lower(F.hex(F.encode(text, "UTF-16BE")))
    short = F.create_map(*[F.lit(v) for pair in _SHORT.items() for v in pair])

    def unit(i: Column) -> Column:
        u = F.substring(digits, (i - 1) * 4 + 1, F.lit(4))
        plain = (u >= "0020") & (u < "007f")
        return F.coalesce(short[u], F.when(plain, F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), u)))
    slow = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest((F.length(digits) / 4).cast("int"), F.lit(1))), unit), "")
    return F.concat(F.lit('"'), F.when(F.rlike(text, F.lit(_PLAIN)), text).otherwise(slow), F.lit('"'))


def json_array(items: Column, write=json_text) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, write), ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """A JSON object of values that are JSON already, keys in order."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_reordered(text: Column) -> Column:
    """JSON text with keys in order and without spaces, at every depth; what is no JSON stays as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def stripped(c: Column) -> Column:
    """Text without white space of any kind at both ends; null is empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def first_filled(*cs: Column) -> Column:
    """The first text that is neither null nor empty, stripped."""
    return stripped(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs], F.lit("")))


def slug(c: Column) -> Column:
    """Lower case; runs of other signs than letters, digits and underscores become one underscore."""
    t = F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "[^a-z0-9_]+", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^_|_$", ""), F.lit("")), F.lit("unknown"))


def short_digest(c: Column, n: int) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, n)
