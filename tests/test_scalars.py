import pytest
from pyspark.sql import functions as F

from fathomkb.functions import scalars as fn


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values)))).select(column).first()[0]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (lambda x: fn.slugify(x), "  Hello, World! ", "hello-world"), (lambda x: fn.slugify(x), "--", "item"), (lambda x: fn.slugify(x), "", "item"), (lambda x: fn.slugify(x), "Éa b", "a-b"),
        (lambda x: fn.canonical_name(x), "HTTPServer", "h t t p server"), (lambda x: fn.canonical_name(x), "a-b_c", "a b c"), (lambda x: fn.canonical_kind(x), "method", "operation"), (lambda x: fn.canonical_kind(x), "", "unknown"), (lambda x: fn.canonical_kind(x), "module", "module"),
        (lambda x: fn.normalize_name(x), "A-b_C 1", "abc1"), (lambda x: fn.normalize_separators(x), "A/b.c__D", "a-b-c-d"), (lambda x: fn.clamp_confidence(x), "1.7", 1.0), (lambda x: fn.clamp_confidence(x), "-2", 0.0), (lambda x: fn.clamp_confidence(x), "x", 0.6), (lambda x: fn.clamp_confidence(x), None, 0.6), (lambda x: fn.clamp_confidence(x), "NaN", 0.6),
        (lambda x: fn.parse_confidence(x), "0.5", 0.5), (lambda x: fn.parse_confidence(x), "1.5", None), (lambda x: fn.parse_confidence(x), "nan", None), (lambda x: fn.package_key(x), "a.b.c", "a.b"), (lambda x: fn.package_key(x), "a.b", "a"), (lambda x: fn.short_q(x), "a.b.c", "b.c"),
        (lambda x: fn.meaningful_tokens(x), "The cat and THE cat sat on a2b", ["cat", "sat", "a2b"]), (lambda x: fn.short_signature(x), "a  b\n c", "a b c"), (lambda x: fn.short_signature(x), "x" * 300, "x" * 200 + " …"), (lambda x: fn.first_paragraph(x), "\n\nfirst\nline\n\nsecond", "first\nline"),
        (lambda x: fn.join_path(x, F.lit(""), F.lit("/c/")), "/a/b/", "/a/b/c"), (lambda x: fn.join_path(x), "/", "/"), (lambda x: fn.mask(x), "abcdefgh", "****efgh"), (lambda x: fn.mask(x), "abc", "***"), (lambda x: fn.nonempty(x, "d"), "", "d"),
    ],
)
def test_scalar(spark, expr, value, want):
    assert one(spark, expr(F.col("x0")), value) == want


@pytest.mark.parametrize(("a", "b", "n"), [("a.b.c", "a.b.d", 2), ("a", "b", 0), ("a.b", "a.b", 2), ("a", "a.b", 1)])
def test_shared_prefix(spark, a, b, n):
    assert one(spark, fn.shared_prefix_len(F.col("x0"), F.col("x1")), a, b) == n


def test_bounded_ids(spark):
    assert one(spark, fn.bounded_id("source", F.col("x0"), 20), "Short") == "source-short"
    long = one(spark, fn.bounded_id("source", F.col("x0"), 30), "a very long name of a source indeed")
    assert len(long) <= 30 and long != one(spark, fn.bounded_id("source", F.col("x0"), 30), "a very long name of a source, too")


def test_fingerprint_depends_on_every_part(spark):
    f = lambda *v: one(spark, fn.fingerprint(F.lit(1), F.col("x0"), F.col("x1"), F.col("x2")), *v)
    assert len({f("r", "a", "p"), f("s", "a", "p"), f("r", "b", "p"), f("r", "a", "q")}) == 4
