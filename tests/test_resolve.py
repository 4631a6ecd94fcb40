"""Name resolution, numbering, reports and paths on small frames with nulls, ties and empties."""

import os
import random

from pyspark.sql import functions as F

from fathomkb.functions import scalars as fn
from fathomkb.operators import claims as C
from fathomkb.operators import extract as E
from fathomkb.operators import relations as R
from fathomkb.operators import report as P
from fathomkb.operators import resolve as N
from fathomkb.operators import validate as V
from fathomkb.sources.shared import shared_dir


def symbols(spark, rows):
    return spark.createDataFrame([(k, f"s{k}", q.rsplit(".", 1)[-1], q, m) for k, (q, m) in enumerate(rows)], "seq int, id string, title string, qualified_name string, module string")


def test_imports_exact_suffix_tie_and_trimmed(spark):
    modules = spark.createDataFrame([("app.core.db",), ("lib.core.db",), ("app.core.db.models",), ("db",), ("x.only",)], "module string")
    ask = [("app.web", "core.db"), ("other.web", "core.db"), ("app.web", "db"), ("q", "only"), ("q", "only.thing"), ("q", "none"), ("app.web", "core.db.Session"), ("q", "none.at.all"), ("q", "")]
    got = {(r.module, r.name): r.target for r in N.resolve_imports(spark.createDataFrame(ask, "module string, name string"), modules).collect()}
    assert got == {("app.web", "core.db"): "app.core.db", ("other.web", "core.db"): None, ("app.web", "db"): "db", ("q", "only"): "x.only", ("q", "only.thing"): "x.only", ("q", "none"): None, ("app.web", "core.db.Session"): "app.core.db", ("q", "none.at.all"): None, ("q", ""): None}


def test_references_in_order_of_rules(spark):
    s = symbols(spark, [("m.A", "m"), ("m.A.run", "m"), ("m.B", "m"), ("m.B.run", "m"), ("m.B.own", "m"), ("n.util.helper", "n.util"), ("k.util.helper", "k.util"), ("m.lone", "m"), ("n.run", "n"), ("m.B.run", "m")])
    imports = spark.createDataFrame([("m", 0, "n.util"), ("m", 1, "k.util"), ("n", 0, "missing")], "module string, pos int, name string")
    classes = spark.createDataFrame([("m.B", 0, "A"), ("m.B", 1, "B"), ("m.A", 0, "Gone"), ("m.A", 1, "m.B")], "qualified_name string, pos int, base string")
    names = ["m.A.run", "A.run", "lone", "lone()", "run", "self.own", "self.run", "cls.gone", "util.helper", "helper", "x.helper", "own", None]
    refs = spark.createDataFrame([("s4", n) for n in names] + [("s8", "lone"), ("s0", "self.run")], "subject string, name string")
    got = {(r.subject, r.name): r.target for r in N.resolve_references(refs, s, imports, classes).collect()}
    want = {"m.A.run": "s1", "A.run": "s1", "lone": "s7", "lone()": "s7", "run": None, "self.own": None, "self.run": None, "cls.gone": None, "util.helper": "s5", "helper": None, "x.helper": None, "own": None, None: None}
    assert {n: got["s4", n] for n in names} == want  # self.run: two members of B, repeated
    assert got["s8", "lone"] == "s7" and N.resolve_references(refs.limit(0), s, imports, classes).count() == 0


def test_references_in_parts_leave_no_step_tables(spark):
    r = random.Random(5)
    s = symbols(spark, [(f"{m}.{c}.{n}", m) for m in ("a", "a.b", "c") for c in "AB" for n in r.sample(["x", "y", "z", "w", "x"], 3)] + [("a.A", "a"), ("a.B", "a"), ("c.A", "c")])
    imports = spark.createDataFrame([("a", 0, "a.b"), ("c", 0, "b"), ("a.b", 0, "x")], "module string, pos int, name string")
    classes = spark.createDataFrame([("a.A", 0, "B"), ("a.B", 0, "c.A"), ("c.A", 0, "a.A")], "qualified_name string, pos int, base string")
    names = ["x", "y()", "self.x", "cls.y", "self.w", "b.x", "A", "A.x", "a.b.A.z", "none", None]
    refs = spark.createDataFrame([(f"s{k}", n) for k in range(21) for n in names] + [(None, "x")], "subject string, name string")
    top = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(top))
    whole = N.resolve_references(refs, s, imports, classes).collect()
    middle = set(os.listdir(top))
    parts = N.resolve_references(refs, s, imports, classes, parts=3).collect()
    assert sorted(map(str, parts)) == sorted(map(str, whole)) and len(parts) == 21 * len(names)
    left = lambda new: sorted(x.split("-")[0] for x in new)
    assert left(middle - before).count("ancestors") == 1
    assert [x for x in left(set(os.listdir(top)) - middle) if x in ("refs", "asks", "fixed", "owned", "rest", "answers", "part")] == []


def test_ancestry_with_cycles_and_diamonds(spark):
    rows = [("m.D", 0, "B"), ("m.D", 1, "C"), ("m.B", 0, "A"), ("m.C", 0, "A"), ("m.A", 0, "D"), ("m.A", 1, "lost")]
    got = {(r["class"], r.ancestor): r.path for r in N.ancestry(spark.createDataFrame(rows, "qualified_name string, pos int, base string")).collect()}
    assert got["m.D", "m.B"] == [0] and got["m.D", "m.A"] == [0, 0] and got["m.D", "m.C"] == [1] and got["m.A", "m.C"] == [0, 1]
    assert all(a != b for a, b in got) and len(got) == 12


def test_numbering_across_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = spark.createDataFrame([("hot" if k % 5 else None if k % 10 else "b", k, k % 7) for k in range(500)], "source string, seq int, sum int")
    for r in C.version_chain(rows, "source", ["seq"], "sum").collect():
        same = [k for k in range(500) if ("hot" if k % 5 else None if k % 10 else "b") == r.source]
        assert r.version == same.index(r.seq) + 1 and r.latest == (r.seq == same[-1]) and r.unchanged == any(k < r.seq and k % 7 == r["sum"] for k in same)


def test_reachable_stops(spark):
    e = spark.createDataFrame([(f"n{k}", "p", f"n{k + 1}") for k in range(6)] + [("n1", "p", "n0"), ("n0", "q", "z")], "subject string, predicate string, object string")
    assert {(r.id, r.level) for r in R.reachable(e, "n0", ["p"], 3).collect()} == {("n1", 1), ("n2", 2), ("n3", 3)}
    assert R.reachable(e, "n0", ["p"], 8, most_seen=3).count() == 2 and R.reachable(e, "none", ["p"]).count() == 0


def test_long_text_without_a_mark_is_quick(spark):
    import time

    docs = spark.createDataFrame([(1, "word " * 40_000), (2, "a b. c!\nd? e"), (3, None)], "doc_id int, text string")
    began = time.time()
    assert [r.sentence for r in E.sentences(docs).orderBy("doc_id", "pos").collect()] == ["a b.", "c!", "d?"] and time.time() - began < 20


def test_paths_and_titles(spark):
    row = spark.range(1).select(
        *(fn.normpath(F.lit(x)).alias(f"n{i}") for i, x in enumerate(["a//b/./c", "../x/..", "/..", "", "a/..", "a/../../b"])),
        fn.relative_link(F.lit("a/b/c.md"), F.lit("a/d/e.md")).alias("r1"), fn.relative_link(F.lit("c.md"), F.lit("d.md")).alias("r2"), fn.relative_link(F.lit("x/y/z/c.md"), F.lit("d.md")).alias("r3"),
        fn.title_case(F.lit("hELLO  big-wORLD 2x")).alias("t1"), fn.capitalize_words(F.lit("hELLO  big-wORLD 2x")).alias("t2"),
    ).first()
    assert list(row) == ["a/b/c", "..", "/", ".", ".", "../b", "../d/e.md", "d.md", "../../../d.md", "Hello  Big-world 2x", "Hello  Big-World 2X"]


def test_bulk_review_and_states(spark):
    c = spark.createDataFrame([("c1", "proposed", "active", 4, False), ("c2", None, None, 1, True), ("c3", "approved", "retired", 2, True)], "id string, review_status string, lifecycle_status string, tier int, review_required boolean")
    chosen = c.select("id").union(spark.createDataFrame([("gone",)], "id string")).union(c.select("id"))
    got = {tuple(r) for r in P.bulk_review(c, chosen, "approve", "seen", {"approve": "approved"}).collect()}
    assert got == {(f"c{k}", "approved", f"crev-000{k} approve of 3") for k in (1, 2, 3)}
    assert P.bulk_review(c, chosen, "approve", " ", {"approve": "approved"}).count() == 0
    assert {(r.id, r.review_status) for r in P.bulk_review(c, chosen, "odd", "x", {}).collect()} == {("c1", "proposed"), ("c2", None), ("c3", "approved")}
    assert tuple(P.bundle_state(c, c).first()) == (1, "1 awaiting review") and P.bundle_state(c.limit(0), c).first().state == "not built" and P.bundle_state(c, c.limit(0)).first().state == "reviewed"


def test_profile_and_procedure_rules(spark):
    b = spark.createDataFrame([(1, "code-knowledge-bundle", True, ["a"]), (2, None, None, None)], "id int, profile string, configured boolean, directories array<string>")
    assert {(r.rule, r.id) for r in V.profile(b, ["a", "b"]).collect()} == {("directory:b", 1), ("profile", 2), ("configuration", 2), ("directory:a", 2), ("directory:b", 2)}
    p = spark.createDataFrame([(1, ["a", "b"], ["b"], "x"), (2, ["a"], ["a", "c"], "x"), (3, ["a"], ["a"], None)], "id int, required array<string>, cited array<string>, claim string")
    assert [tuple(r) for r in V.procedure(p).orderBy("id").collect()] == [(1, "a", "member_not_cited"), (2, "", None), (3, "", "claim_missing")]
