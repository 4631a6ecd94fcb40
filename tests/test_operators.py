import pytest
from pyspark.sql import functions as F

from fathomkb.operators import claims as C
from fathomkb.operators import context as X
from fathomkb.operators import extract as E
from fathomkb.operators import relations as R
from fathomkb.operators import search as S
from fathomkb.operators import validate as V
from fathomkb.sources import files

EDGE = "seq int, id string, subject string, predicate string, object string, status string, confidence double, evidence string"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("symbol-a", "calls", "symbol-b", "unresolved"), ("symbol-b", "calls", "symbol-c", "exact"), ("symbol-c", "calls", "symbol-a", "exact"), ("symbol-d", "calls", "symbol-d", "exact"), ("symbol-a", "calls", "symbol-b", "exact"), ("test-x", "covers", "symbol-c", "exact"), ("symbol-b", "tested_by", "test-y", "exact"), ("symbol-c", "reads", "file", "inferred")]
    return spark.createDataFrame([(i, f"{s}|{p}|{o}", s, p, o, st, 0.9, f"e{9 - i}") for i, (s, p, o, st) in enumerate(rows)], EDGE).repartition(3)


def test_merge_prefers_the_first_exact_row(edges):
    r = {x.subject + x.predicate: x for x in R.merge_relations(edges).collect()}
    assert r["symbol-acalls"].status == "exact" and r["symbol-acalls"].evidence == ["e5", "e9"] and r["symbol-acalls"].seq == 0


def test_neighbourhood_has_edges_at_nodes_nearer_than_depth(edges):
    ids = lambda d: {x.id for x in R.neighbourhood(edges, "test-x", d).collect()}
    assert ids(0) == ids(1) == {"test-x|covers|symbol-c"}
    assert ids(2) == {"test-x|covers|symbol-c", "symbol-b|calls|symbol-c", "symbol-c|calls|symbol-a", "symbol-c|reads|file"}
    assert ids(4) == {x.id for x in edges.filter("subject <> 'symbol-d'").collect()}


def test_change_impact_counts_objects_only_if_symbols(edges):
    assert {x.id for x in R.change_impact(edges, "symbol-c").collect()} == {"test-x", "symbol-b", "symbol-a"}


def test_reachable_on_a_cycle(edges):
    for f in (R.reachable, R.reachable_levels):
        assert {(x.id, x.level) for x in f(edges, "symbol-a", ["calls"]).collect()} == {("symbol-b", 1), ("symbol-c", 2)}


def test_degrees_and_coverage(spark, edges):
    s = spark.createDataFrame([("symbol-a",), ("symbol-z",)], "id string")
    assert {tuple(x) for x in R.degrees(s, edges).collect()} == {("symbol-a", 2, 1, 3), ("symbol-z", 0, 0, 0)}
    assert {tuple(x) for x in R.coverage(edges).collect()} == {("symbol-c", "test-x"), ("symbol-b", "test-y")}


def test_fixpoint_and_clusters(spark):
    bases = spark.createDataFrame([("a", "Base"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], "name string, base string")
    assert {x.name for x in R.fixpoint_members(bases, ["Base"]).collect()} == {"a", "b", "c"}
    s = spark.createDataFrame([("f", "m"), ("g", "m"), ("h", "n")], "id string, file string")
    e = spark.createDataFrame([("f", "calls", "g", "exact"), ("f", "calls", "h", "exact"), ("f", "calls", "f", "exact"), ("g", "calls", "f", "inferred")], "subject string, predicate string, object string, status string")
    assert [tuple(x) for x in R.call_clusters(s, e, least=1).collect()] == [("f", 1)]


def test_fixpoint_has_no_last_level(spark):
    bases = spark.createDataFrame([("k0", "Base"), *((f"k{i}", f"k{i - 1}") for i in range(1, 20)), ("k3", "k19"), ("x", "y"), (None, "k2")], "name string, base string")
    assert sorted(str(x.name) for x in R.fixpoint_members(bases, ["Base"]).collect()) == sorted(["None", *(f"k{i}" for i in range(20))])


def test_suffix_resolution(spark):
    m = spark.createDataFrame([("a.b.c",), ("x.b.c",), ("q",), ("z.q",), ("k.only",)], "module string")
    got = dict(R.resolve_suffix(spark.createDataFrame([("b.c",), ("q",), ("only",), ("none",), ("a.b.c",)], "ref string"), m).collect())
    assert got == {"b.c": None, "q": "q", "only": "k.only", "none": None, "a.b.c": "a.b.c"}


SYMBOL = "id string, title string, kind string, qualified_name string, file string, docstring string, language string"


def test_symbol_search_has_two_phases(spark):
    s = spark.createDataFrame([("symbol-1", "red", "function", "m.red", "f.py", "a ring", "py"), ("symbol-2", "blue", "class", "m.blue", "f.py", None, "py"), ("symbol-3", "ring", "class", "m.ring", "f.py", "red", "js")], SYMBOL)
    run = lambda q, **k: [(x.id, x.score) for x in S.symbols_search(s, q, **k).collect()]
    assert run("red ring") == [("symbol-1", 102), ("symbol-3", 102)]
    assert run("red nothing") == [("symbol-1", 101), ("symbol-3", 1)]
    assert run("") == [("symbol-2", 0), ("symbol-1", 0), ("symbol-3", 0)] and run("red ring", language="js") == [("symbol-3", 102)]


ITEM = "seq int, id string, subject string, predicate string, object string, source_text string, status string, source_id string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "i1", "Refund", "should", "A", "Refunds within days", "approved", "s"), (2, "i2", "Refund", "should", "B", "other words", "rejected", "s"), (3, "i3", "Refund", "should", "A", "x", None, "s"), (4, "i4", "", "p", "", "empty subject", "proposed", "t")], ITEM)


def test_item_searches(items):
    ids = lambda df: {x.id for x in df.collect()}
    assert ids(S.knowledge_search(items, "refund WITHIN")) == {"i1"} and len(ids(S.knowledge_search(items, ""))) == 4
    assert ids(S.any_term(items, [])) == set() and ids(S.any_term(items, ["days", "other"])) == {"i1", "i2"}
    assert ids(S.without_rejected(items)) == {"i1", "i3", "i4"}


def test_conflicts_look_at_the_row_before_only(items):
    assert {x.id for x in S.conflicts(items, ["subject", "predicate"], "object").collect()} == {"i2", "i3"}


def test_concepts(items):
    got = {x.label: (x.score, x.item_count) for x in S.detect_concepts(items, "a refund within days").collect()}
    assert got["Refund"] == (8 * 3 + 3 * 3 + 3 + 1 + 1, 3) and got[""] == (8, 1)  # an empty label is in every scenario
    index = {x.concept_id: x for x in C.concept_index(items).collect()}
    assert (index["concept-refund"].item_count, index["concept-refund"].unknown, index["concept-item"].label) == (3, 1, "")


def test_paging_and_suffixes(spark):
    s = spark.range(7).select(F.col("id"), F.lit("x").alias("b"), F.col("id").alias("seq"))
    page = lambda n: [x.id for x in S.page(s, ["id"], n, 3).collect()]
    assert page(2) == [3, 4, 5] and page(99) == [6] and page("no") == page(-4) == [0, 1, 2]
    assert [x.unique_id for x in S.suffix_repeats(s, "b").orderBy("seq").collect()][:3] == ["x", "x-1", "x-2"]
    assert {x.id for x in S.last_entries(s, "b", 2).collect()} == {5, 6}


def test_usable(spark):
    rows = [("a", "proposed", None, 4, True), ("b", "approved", "", 4, True), ("c", "rejected", "active", 1, False), ("d", None, "active", 2, True), ("e", "approved", "retired", 1, False), ("f", "proposed", "active", 4, False)]
    c = spark.createDataFrame(rows, "id string, review_status string, lifecycle_status string, tier int, review_required boolean")
    assert {x.id for x in c.filter(S.usable()).collect()} == {"b", "d", "f"}


def test_overlay(spark):
    c = spark.createDataFrame([("a", "proposed"), ("b", "proposed")], "id string, review_status string")
    d = spark.createDataFrame([("a", "approved"), ("z", "rejected")], "claim_id string, decision string")
    assert dict(C.overlay(c, d).collect()) == {"a": "approved", "b": "proposed"}


def test_code_merge(spark):
    t = "id string, symbol_id string, version int, lifecycle_status string"
    old = spark.createDataFrame([("a", "s1", 1, "active"), ("b", "s1", 1, None), ("c", "gone", 1, ""), ("d", "s2", 1, "active"), ("e", "s1", 1, "superseded")], t)
    new = spark.createDataFrame([("a", "s1", 1, ""), ("n", "s2", 2, "")], t)
    got = {x.id: x.lifecycle_status for x in C.merge_code(old, new, spark.createDataFrame([("s1", 1), ("s2", 2)], "symbol_id string, version int")).collect()}
    assert got == {"a": "active", "b": "retired", "c": "retired", "d": "superseded", "e": "superseded", "n": "active"}


def test_item_merge(spark):
    t = "id string, source_id string, version int, lifecycle_status string"
    got = {x.id: (x.lifecycle_status, x.superseded_by) for x in C.merge_items(spark.createDataFrame([("a", "s", 1, None), ("b", "s", 2, None), ("c", "t", 1, ""), ("d", "s", 1, "retired")], t), spark.createDataFrame([("n2", "s", 2, ""), ("n1", "s", 2, "")], t)).collect()}
    assert got == {"a": ("superseded", "n1,n2"), "c": ("active", None), "d": ("retired", None), "n1": ("active", None), "n2": ("active", None)}


def test_review_fold_stops_at_a_terminal_action(spark):
    log = [(1, "a", "commented"), (2, "a", "edited"), (3, "a", "approved"), (4, "a", "rejected"), (5, "b", "deferred"), (6, "c", "edited")]
    got = {x.item_id: (x.status, x.n_applied) for x in C.fold_reviews(spark.createDataFrame(log, "seq int, item_id string, action string").repartition(3)).collect()}
    assert got == {"a": ("approved", 3), "b": ("proposed", 1), "c": ("edited", 1)}


def test_update_preview(spark):
    t = "id string, filename string, checksum string"
    got = {x.id: x.update for x in C.update_preview(spark.createDataFrame([("a", "a.md", "1"), ("b", "b.md", "9"), ("c", "old.md", "3"), ("d", "d.md", "4"), ("e", "e.png", "5")], t), spark.createDataFrame([("a", "a.md", "1"), ("b", "b.md", "2"), ("x", "old.md", "3")], t)).collect()}
    assert got == {"a": "unchanged_version", "b": "new_version", "c": "unchanged_version", "d": "new_source", "e": "unsupported"}


def test_sections(spark):
    docs = spark.createDataFrame([(1, "before\n# Scope\ntext\n##\nProcedure steps\n####### no\n#no"), (2, "plain"), (3, "")], "doc_id long, text string")
    got = {(x.doc_id, x.n): (x.level, x.heading, x.role, x.start, x.end) for x in E.sections(docs).collect()}
    total = len("before\n# Scope\ntext\n##\nProcedure steps\n####### no\n#no")
    assert got[1, 1] == (1, "Scope", "scope", 7, 20) and got[1, 2] == (2, "Procedure steps", "procedure", 20, total)
    assert got[2, 1] == (1, "Document", "general", 0, 5) and len(got) == 4


def test_sentences_and_offsets(spark):
    docs = spark.createDataFrame([(1, "It  must be.\nNo end here\nÄ shall! And then?"), (2, None)], "doc_id long, text string")
    assert [x.sentence for x in E.sentences(docs, E.OBLIGATIONS).orderBy("pos").collect()] == ["It must be.", "Ä shall!"]
    text = docs.first().text
    for m in E.matches(docs, E.SENTENCE).collect():
        assert text[m.start : m.start + len(m.match)] == m.match
    assert [x.id for x in E.mined_claims(docs).orderBy("id").collect()] == ["ki-1-000001", "ki-1-000002"]


def test_rules_and_grounding(spark):
    i = spark.createDataFrame([("a", "needs approval and a record", None), ("b", "nothing", None), ("c", "approval", ["own"])], "id string, source_text string, authored array<string>")
    got = {(x.id, x.rule) for x in E.decision_rules(i, authored="authored").collect()}
    assert got == {("a", "approval_required"), ("a", "documentation"), ("b", "follow_guidance"), ("c", "own")}
    c = E.grounded(spark.createDataFrame([("some text here", "text", 10), ("some", "no", 10)], "section_text string, claim string, section_start int")).collect()
    assert [(x.span_status, x.start_pos, x.end_pos) for x in c] == [("exact", 15, 19), ("llm_claimed", None, None)]


PY = '''
import os
from a.b import c
LIMIT = 3
class Item(Base):
    @router.get("/items")
    def read(self):
        return helper(os.getenv("X"))
def test_read():
    def inner(): pass
    read()
if True:
    def hidden(): pass
'''


def test_python_symbols(spark):
    got = {x.qualified_name: x for x in E.python_symbols(spark.createDataFrame([("pkg/mod.py", PY), ("bad.py", "def ("), ("pkg/__init__.py", "")], "path string, text string")).collect()}
    assert got["pkg.mod"].imports == ["a.b", "os"] and got["pkg.mod.Item"].bases == ["Base"] and got["pkg.mod.LIMIT"].kind == "constant" and got["pkg"].kind == "module"
    assert (got["pkg.mod.Item.read"].kind, got["pkg.mod.Item.read"].route, got["pkg.mod.Item.read"].calls) == ("method", "GET /items", ["helper", "os.getenv"])
    assert got["pkg.mod.test_read"].kind == "test" and "pkg.mod.test_read.<locals>.inner" in got and got["bad"].error and not any("hidden" in k for k in got)


def test_cobol(spark):
    text = "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. PAY.\n      * comment\nFD  IN-FILE.\n01  REC.\n  05  AMOUNT PIC 9.\nPROCEDURE DIVISION.\nMAIN-PARA.\n  PERFORM CALC\n  CALL 'SUB1'.\n  GO TO MAIN-PARA.\nCOPY BOOK1."
    df = spark.createDataFrame([("p.cbl", text)], "path string, text string")
    assert {(x.kind, x.name) for x in E.cobol_symbols(df).collect()} == {("program", "PAY"), ("file", "IN-FILE"), ("record", "REC"), ("data_item", "AMOUNT"), ("paragraph", "MAIN-PARA"), ("copy", "BOOK1")}
    assert {(x.predicate, x.name) for x in E.cobol_facts(df).collect()} == {("performs", "CALC"), ("calls", "SUB1"), ("jumps_to", "MAIN-PARA")}


def test_boilerplate(spark):
    pages = spark.createDataFrame([("d", f"Page {i}\nbody {'x' * i}\nfoot") for i in range(5)], "doc string, text string")
    assert {(x.key, x.pages) for x in E.repeated_lines(pages, "doc").collect()} >= {("Page #", 5), ("foot", 5)}


def test_validators(spark):
    t = "id string, subject string, subject_kind string, object string, object_kind string, predicate string, status string, evidence array<string>"
    rows = [("r1", "s1", "symbol", "s9", "symbol", "calls", "odd", ["e1"]), ("r2", "gone", "module", "x", "external", "calls", "exact", []), ("r3", None, "symbol", "s1", "symbol", "imports", "exact", None)]
    rows += [("r4", "s1", "symbol", "m1", "module", "calls", "inferred", ["x2", "e1", "x1"]), ("r5", "s1", None, "zz", None, "calls", None, None)]
    got = {tuple(x) for x in V.relations(spark.createDataFrame(rows, t), spark.createDataFrame([("s1",), ("m1",)], "id string"), spark.createDataFrame([("e1",)], "id string")).collect()}
    assert got == {("error", "status", "r1", ""), ("error", "unknown_object", "r1", "s9"), ("error", "unknown_subject", "r2", "gone"), ("error", "exact_without_evidence", "r2", ""), ("error", "unknown_subject", "r3", ""),
                   ("warning", "not_exact", "r4", ""), ("error", "unknown_evidence", "r4", "x2, x1"), ("error", "status", "r5", "")}
    c = spark.createDataFrame([("a", "kind1", ["s"], ["s"], "s", "q", "the q text"), ("b", "kind1", ["s", "t"], ["s"], "s", "q", "x"), ("c", "bad", ["s"], ["s"], "s", "q", "q"), ("d", "kind1", ["s"], ["s"], "s", " ", "q")], "id string, kind string, cited array<string>, allowed array<string>, own string, quote string, source string")
    assert [(x.rejected, x.anchored) for x in V.candidate(c, ["kind1"]).orderBy("id").collect()][:3] == [(None, True), ("unknown_id", False), ("kind", True)]


def test_contexts(items):
    assert {x.id for x in X.agent_context(items, ["nothing-has-this"]).collect()} == {"i1", "i2", "i3", "i4"}
    assert {(x.id, x.excluded) for x in X.agent_context(items, ["other", "within"]).collect()} == {("i1", False), ("i2", True)}
    assert [x.id for x in X.scenario_context(items, "refund within days", ["within"]).collect()] == ["i1"]


def test_documents_and_sinks(spark, items, tmp_path):
    nodes, edges = files.graph(spark.createDataFrame([(1, "s", "p")], "seq int, id string, path string"), items)
    assert {x.id for x in nodes.collect()} == {"s", "i1", "i2", "i3", "i4", "concept-refund", "concept-item"} and edges.count() == 8
    (tmp_path / "r/.git").mkdir(parents=True)
    (tmp_path / "r/a.py").write_text("x = 1")
    (tmp_path / "r/.git/b.py").write_text("y")
    assert [(x.path.rsplit("/", 1)[1], x.language, x.text) for x in files.scan_repository(spark, f"file://{tmp_path}/r").collect()] == [("a.py", "python", "x = 1")]
    (tmp_path / "s.json").write_text('{"id": "a", "n": 1}')
    assert files.read_state(spark, f"file://{tmp_path}/s.json", "id string, n int").first().n == 1
    md = spark.createDataFrame([("﻿ a\r\nb\r ",)], "t string").select(files.normalize_markdown(F.col("t"))).first()[0]
    assert md == "a\nb\n"


def test_review_stream(spark, tmp_path):
    from fathomkb.streaming import reviews

    log = spark.createDataFrame([(1, "a", "edited"), (2, "a", "approved"), (3, "b", "deferred")], "seq long, item_id string, action string").selectExpr("seq", "item_id", "action", "'r' reviewer", "timestamp_seconds(seq) ts", "1.0D value")
    log.write.parquet(f"{tmp_path}/in")
    q = reviews.fold_stream(reviews.read_log(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    got = {x.item_id: x.status for x in spark.read.parquet(f"{tmp_path}/out/state/000000000").collect()}
    assert got == {"a": "approved", "b": "proposed"}


def test_item_states_equal_the_batch_whatever_the_order(spark, tmp_path):
    import random

    from fathomkb.streaming import reviews

    r = random.Random(6)
    rows = [(i, f"i{r.randint(0, 9)}", r.choice(["edited", "commented", "deferred", "edited", "approved", "rejected"] if i > 40 else ["edited", "commented"])) for i in range(120)]
    late = rows[:]
    r.shuffle(late)
    frame = lambda part: spark.createDataFrame(part, "seq long, item_id string, action string").selectExpr("seq", "item_id", "action", "'r' reviewer", "timestamp_seconds(seq) ts", "1.0D value")
    for part in (late[:50], late[30:90], late[60:] + late[:10]):  # some again
        frame(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen = {}
        step = lambda batch, n: seen.update({x.item_id: tuple(x) for x in batch.collect()})  # noqa: E731, B023
        q = reviews.item_states(reviews.read_log(spark, f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(90) and q.exception() is None
        known = frame(spark.read.parquet(f"{tmp_path}/in").select("seq", "item_id", "action").distinct().collect())
        want = {x.item_id: (x.item_id, x.status, x.n_applied, x.last_seq) for x in C.fold_reviews(known).collect()}
        assert seen == {k: want[k] for k in seen} and {x[1] for x in part} == set(seen)
