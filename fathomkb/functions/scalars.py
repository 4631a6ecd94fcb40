"""Scalar functions of the knowledge data model, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in token overlap.
STOP_WORDS = "the and for with that this from are was were has have had not but you your they their will shall can may into".split()


def slugify(x: Column) -> Column:
    """Trimmed, lower-cased, other runs than [a-z0-9] as one "-", none at the edges; empty: "item"."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("item")).otherwise(s)


def bounded_id(prefix: str, x: Column, most: int) -> Column:
    """prefix-slug, or where that is longer than `most` a cut slug and 12 hex digits of the raw value's SHA-256."""
    whole = F.concat(F.lit(prefix + "-"), slugify(x))
    short = F.regexp_replace(F.substring(whole, 1, most - 13), "-+$", "")
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat_ws("-", short, F.substring(F.sha2(x, 256), 1, 12)))


def normalize_separators(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[./_\\-]+", "-")


def canonical_name(x: Column) -> Column:
    """"-" and "_" as spaces, a space before every upper-case letter, one space between words, lower case."""
    spaced = F.regexp_replace(F.regexp_replace(x, "[-_]", " "), r"(\p{Lu})", " $1")
    return F.lower(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def canonical_kind(x: Column) -> Column:
    return F.when(x.isin("function", "method", "paragraph", "section", "test"), "operation").when(x.isin("class", "record", "data_item", "data"), "type").when(F.coalesce(x, F.lit("")) == "", "unknown").otherwise(x)


def normalize_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def title_case(x: Column) -> Column:
    """Each word between single spaces with its first character in upper and the rest in lower case."""
    return F.array_join(F.transform(F.split(x, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " ")


def capitalize_words(x: Column) -> Column:
    """The same for runs of letters, whatever stands between them."""
    parts = F.regexp_extract_all(x, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def meaningful_tokens(x: Column) -> Column:
    """Distinct tokens [a-z][a-z0-9]+ of more than two characters that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z][a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS)))


def clamp_confidence(x: Column) -> Column:
    """A number or numeric string moved into [0, 1]; anything else is 0.6."""
    number = F.expr("1") * x.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.6)).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def parse_confidence(x: Column) -> Column:
    """An edited confidence, null unless it is a number from 0 to 1."""
    number = F.trim(x).try_cast("double")
    return F.when(~F.isnan(number) & number.between(0, 1), number)


def short_signature(x: Column, most: int = 200) -> Column:
    s = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(s) > most, F.concat(F.left(s, F.lit(most)), F.lit(" …"))).otherwise(s)


def first_paragraph(x: Column) -> Column:
    return F.trim(F.regexp_extract(x, r"^\s*([\s\S]*?)(?:\n\s*\n[\s\S]*)?$", 1))


def join_path(*parts: Column) -> Column:
    """Each non-empty part as "/" and the part without "/" at its edges."""
    return F.concat(*(F.when(F.coalesce(p, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.regexp_replace(p, "^/+|/+$", ""))) for p in parts))


def package_key(x: Column) -> Column:
    n = F.size(F.split(x, r"\."))
    return F.when(n >= 3, F.substring_index(x, ".", 2)).otherwise(F.substring_index(x, ".", 1))


def short_q(x: Column) -> Column:
    return F.substring_index(x, ".", -2)


def shared_prefix_len(a: Column, b: Column) -> Column:
    """The number of equal leading dotted segments."""
    same = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def fingerprint(version: Column, request: Column, actor: Column, prompt: Column) -> Column:
    """SHA-256 of the sorted JSON of a request and its prompt's digest."""
    return F.sha2(F.to_json(F.struct(actor.alias("actor"), F.sha2(prompt, 256).alias("prompt"), request.alias("request"), version.alias("version"))), 256)


def nonempty(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def mask(x: Column, keep: int = 4) -> Column:
    """All but the last `keep` characters as "*"; short values wholly."""
    return F.when(F.length(x) <= keep, F.repeat(F.lit("*"), F.length(x))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(x) - keep), F.right(x, F.lit(keep))))


def first_of(*parts: Column, default: str) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*(F.nullif(p, F.lit("")) for p in parts), F.lit(default))


def claim_kind(code_kind: Column, derivation: Column) -> Column:
    return first_of(code_kind, derivation, default="unclassified")


def claim_module(qualified_name: Column, file: Column) -> Column:
    """A qualified name without its last segment; where it has only one, the file."""
    return F.when(F.contains(qualified_name, F.lit(".")), F.regexp_replace(qualified_name, r"\.[^.]*$", "")).otherwise(first_of(file, default="unknown"))


def dirname(x: Column) -> Column:
    """What stands before the last "/"; "/" for a file of the root, empty without one."""
    cut = F.regexp_replace(x, "/[^/]*$", "")
    return F.when(~F.contains(x, F.lit("/")), "").when((cut == "") & x.startswith("/"), "/").otherwise(cut)


def normpath(x: Column) -> Column:
    """A POSIX path without empty and "." segments, ".." taken away with the segment before it; "." if nothing is left."""
    absolute = x.startswith("/")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(
        p == "..", F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).when(absolute, acc).otherwise(F.concat(acc, F.array(p)))
    ).otherwise(F.concat(acc, F.array(p)))
    joined = F.array_join(F.aggregate(F.split(x, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def relative_link(source: Column, target: Column) -> Column:
    """The POSIX path from the folder of one document to another: "../" for each folder to leave, then what to enter."""
    a, b = F.filter(F.split(dirname(normpath(source)), "/"), lambda p: p != ""), F.split(normpath(target), "/")
    same = F.zip_with(a, F.slice(b, F.lit(1), F.size(b) - 1), lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long")).cast("int")
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b) - shared)), "/")
