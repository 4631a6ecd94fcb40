"""JSON with sorted keys, two spaces a level and ASCII only, as column expressions made from the schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters below the blank with a short escape.
ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def json_string(x: Column) -> Column:
    """A text in quotes; whatever isn't printable ASCII as an escape, characters beyond 16 bits as two.

    Each run of such characters is escaped as a whole, by its UTF-16 units, and set between the parts around it: a few
    passes over the text, however long it is.
    """
    plain = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    odd = "[^ -~]+"

    def escaped(run: Column) -> Column:
        out = F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(....)", r"\\u$1")
        for code, short in ESCAPES.items():
            out = F.replace(out, F.lit(f"\\u{code:04x}"), F.lit(short))
        return out

    runs = F.concat(F.transform(F.regexp_extract_all(plain, F.lit(odd), F.lit(0)), escaped), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(F.split(plain, odd), runs, lambda part, run: F.concat(part, run)), "")
    return F.concat(F.lit('"'), F.when(x.rlike(odd), whole).otherwise(plain), F.lit('"'))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once, whatever f does with it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _shortest(x: Column) -> Column:
    shape = lambda p: F.format_string(f"%.{p}e", x)
    return F.coalesce(*(F.when(shape(p).cast("double") == x, shape(p)) for p in range(17)), shape(17))


def _laid_out(e: Column) -> Column:
    """The text of a number, from its shortest digits with an exponent."""
    sign, power = F.when(e.startswith("-"), "-").otherwise(""), F.substring_index(e, "e", -1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(e, "e", 1), "[^0-9]", ""), "(?<=.)0+$", "")
    n = F.length(digits)
    whole = F.concat(F.rpad(F.left(digits, power + 1), power + 1, F.lit("0")), F.lit("."), F.when(n > power + 1, F.substr(digits, power + 2)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    far = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.format_string("e%+03d", power))
    return F.concat(sign, F.when(power.between(0, 15), whole).when(power.between(-4, -1), small).otherwise(far))


def json_double(x: Column) -> Column:
    """The shortest digits that give the number again; plain from 1e-4 up to 1e16, else with an exponent of two digits at least."""
    named = F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, x.cast("string"))
    return F.coalesce(named, _let(_let(x, _shortest), _laid_out))


def _block(parts: Column, empty: Column, edges: str, pad: str, inner: str, sep: str) -> Column:
    joined = F.concat(F.lit(edges[0] + inner), F.array_join(parts, sep + inner), F.lit(pad + edges[1]))
    return F.when(empty, edges).otherwise(joined)


def canonical_json(x: Column, kind: T.DataType, indent: int | None = 2, depth: int = 0) -> Column:
    """A column of any type as canonical JSON: keys sorted by code point, null for null, [] and {} for what is empty.

    indent None gives one line, with ", " and ": ". Structs keep null fields; keys of a map are its keys as text, sorted, as
    they are after that; numbers are exact; dates, times and intervals are texts, binary is base64. NaN and the infinities
    are written by name. The expression grows with the schema and not with the data; nothing is collected.
    """
    pad = "" if indent is None else "\n" + " " * indent * depth
    inner, sep = ("", ", ") if indent is None else ("\n" + " " * indent * (depth + 1), ",")
    below = lambda v, t: canonical_json(v, t, indent, depth + 1)
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        keys = F.array(*(F.concat(json_string(F.lit(f.name)), F.lit(": "), below(x.getField(f.name), f.dataType)) for f in fields))
        out = _block(keys, F.lit(not fields), "{}", pad, inner, sep)
    elif isinstance(kind, T.ArrayType):
        out = _block(F.transform(x, lambda v: below(v, kind.elementType)), F.size(x) == 0, "[]", pad, inner, sep)
    elif isinstance(kind, T.MapType):
        named = F.transform(F.map_entries(x), lambda e: F.struct(e["key"].cast("string").alias("k"), below(e["value"], kind.valueType).alias("v")))
        parts = F.transform(F.array_sort(named), lambda e: F.concat(json_string(e["k"]), F.lit(": "), e["v"]))
        out = _block(parts, F.size(x) == 0, "{}", pad, inner, sep)
    elif isinstance(kind, (T.BooleanType, T.IntegralType, T.DecimalType)):
        out = x.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = json_double(x.cast("double"))
    elif isinstance(kind, T.BinaryType):
        out = json_string(F.base64(x))
    else:
        out = json_string(x.cast("string"))
    return F.when(x.isNull(), "null").otherwise(out)


def row_json(columns: dict[str, T.DataType], indent: int | None = 2) -> Column:
    """The named columns of a row as one object."""
    kind = T.StructType([T.StructField(n, t) for n, t in columns.items()])
    return canonical_json(F.struct(*(F.col(f"`{n}`").alias(n) for n in columns)), kind, indent)
