"""Canonical text of values and digests over it.

Doubles are rounded to 8 places and written as plain decimals, so the text does
not depend on an engine's way to print a float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.frames import col, finite


def number_text(x: Column | str, places: int = 8) -> Column:
    """Fixed-point text, NULL for NULL, NaN and infinities."""
    return F.round(finite(x), places).cast(f"decimal(38,{places})").cast("string")


def escaped(text: Column) -> Column:
    """The inside of an ASCII JSON string: quotes, backslashes and controls escaped, other characters as ``\\uXXXX``
    (those beyond the first plane as a pair)."""
    short = F.create_map(*(F.lit(x) for pair in (("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")) for x in pair))
    def code(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    def one(c: Column) -> Column:
        n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
        above = n - 0x10000
        pair = F.concat(code(F.lit(0xD800) + F.shiftright(above, 10)), code(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))))
        return F.coalesce(F.element_at(short, c), F.when((n >= 32) & (n < 127), c).when(n < 0x10000, code(n)).otherwise(pair))
    rest = F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")
    return F.when(text.rlike("^[ !#-\\[\\]-~]*$"), text).otherwise(rest)


def json_value(x: Column, kind: str) -> Column:
    """One JSON value: ``number``, ``integer``, ``boolean``, ``raw`` (already JSON) or ``string``."""
    if kind == "number":
        text = number_text(x)
    elif kind in ("integer", "boolean", "raw"):
        text = x.cast("string")
    else:
        text = F.concat(F.lit('"'), escaped(x.cast("string")), F.lit('"'))
    return F.coalesce(text, F.lit("null"))


def canonical_json(fields: dict[str, tuple[Column | str, str]]) -> Column:
    """A JSON object with sorted keys, no spaces and NULLs kept."""
    parts = []
    for i, name in enumerate(sorted(fields)):
        value, kind = fields[name]
        parts += [F.lit(("," if i else "{") + f'"{name}":'), json_value(col(value), kind)]
    return F.concat(*parts, F.lit("}"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("0x"), F.sha2(text, 256))


def fixed(x: Column | str, places: int) -> Column:
    """Text with a fixed number of places, halves rounded up."""
    scale = 10.0 ** places
    return (F.floor(col(x) * scale + 0.5) / scale).cast(f"decimal(38,{places})").cast("string")


def percent(x: Column | str, places: int = 0) -> Column:
    """A share as percent text."""
    return F.concat(fixed(col(x) * 100, places), F.lit("%"))
