"""Claims of structure, spans, side files, readers and sinks on small and odd inputs."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from fathomkb.functions.canonical import json_string, row_json
from fathomkb.operators import bundle_reports, rules, spans
from fathomkb.operators import report as P
from fathomkb.operators import static_claims as T
from fathomkb.plans import catalog
from fathomkb.sources import files, frontmatter, sinks, turtle
from fathomkb.sources.shared import shared_dir
from fathomkb.sources.spread import first_k, range_join, running


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_running(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "a", "a", None, "b"]), r.randint(0, 50), r.randint(0, 9), i) for i in range(500)]
    got = running(spark.createDataFrame(data, "own_ string, v_ int, n int, range_ int"), ["own_"], ["v_", "range_"], F.col("n"))
    for k in {x[0] for x in data}:
        total = 0
        mine = sorted((x for x in data if x[0] == k), key=lambda x: (x[1], x[3]))
        found = {x.range_: x for x in got.filter(F.col("own_").eqNullSafe(k)).collect()}
        for x in mine:
            assert found[x[3]].before == total
            total += x[2]
        assert all(x.total == total for x in found.values()) and len(found) == len(mine)


def test_range_join_and_first_k(spark):
    r = random.Random(3)
    points = [(r.choice("xy"), i, r.randint(0, 3000)) for i in range(200)]
    ranges = [(r.choice("xy"), i, s := r.randint(0, 3000), s + r.choice([-1, 0, 5, 900])) for i in range(60)]
    got = range_join(spark.createDataFrame(points, "scope string, p int, at int"), spark.createDataFrame(ranges, "scope string, s int, start int, end int"), "scope", "at", "start", "end", 64)
    assert rows_of(got, "p", "s") == sorted(((p, s) for a, p, at in points for b, s, lo, hi in ranges if a == b and lo <= at <= hi), key=str)
    few = first_k(spark.createDataFrame(points, "scope string, p int, at int"), ["scope"], [F.desc("at"), "p"], 3)
    assert rows_of(few, "scope", "p", "rank") == sorted(((k, p, i + 1) for k in "xy" for i, (_, p) in enumerate(sorted((-at, p) for s, p, at in points if s == k)[:3])), key=str)


def test_symbol_claims(spark):
    s = [("m", "method", "python", "a.m", "m", " Does it. \n"), ("t", "test", "python", "a.t", None, None), ("c", "class", None, None, "Preview", None), ("p", "paragraph", "cobol", "P1", "p", "doc"), ("k", "constant", "python", "a.pipeline", "", "x"), ("z", "function", "python", "a.z", "z", "")]
    r = [("1", "m", "raises", "E2"), ("2", "m", "raises", "E1"), ("3", "m", "reads", "env:B"), ("4", "m", "reads", "file"), ("5", "t", "covers", "m"), ("6", "p", "performs", "Q"), ("7", "p", "writes", "F"), ("8", "p", "updates", "D"), ("9", "p", "branches_on", "D"), ("10", "z", "validates", "m"), ("2", "m", "raises", "E1"), ("11", None, None, None)]
    symbols = spark.createDataFrame(s, "id string, kind string, language string, qualified_name string, title string, docstring string")
    relations = spark.createDataFrame(r, "id string, subject string, predicate string, object string")
    got = {x.id: x for x in T.symbol_claims(symbols, relations).collect()}
    assert {k: x.claim for k, x in got.items() if x.symbol_id == "m"} == {"ki-m-documents-behavior": "a.m documents this behavior: Does it.", "ki-m-raises-exception": "a.m raises E1, E2 according to static analysis.", "ki-m-reads-environment": "a.m reads environment variable(s): B."}
    assert {x.kind for x in got.values() if x.symbol_id == "p"} == {"cobol-workflow", "cobol-file-io", "cobol-data-updates", "cobol-branching"}
    assert {k for k, x in got.items() if x.tier == 4} == {"ki-c-architecture-review-required", "ki-z-architecture-review-required", "ki-p-cobol-workflow"}
    assert all((x.confidence, x.review_required) == ((0.72, True) if x.tier == 4 else (0.82, False)) for x in got.values()) and not any(x.symbol_id == "k" for x in got.values())
    links = rows_of(T.claim_relations(T.symbol_claims(symbols, relations), relations), "claim_id", "relation_id")
    assert [b for a, b in links if a == "ki-m-reads-environment"] == ["3", "4"] and [b for a, b in links if a == "ki-m-raises-exception"] == ["1", "2"]


def test_procedure_claims(spark):
    s = [(x, "function", "f.py", line, f"f.{x}") for x, line in (("a", 9), ("b", 5), ("c", 2), ("d", 1))] + [("o", "function", "g.py", 1, "g.o"), ("k", "class", "f.py", 3, "f.K")]
    e = [("a", "b"), ("a", "c"), ("a", "c"), ("a", "a"), ("a", "o"), ("a", "k"), ("b", "c"), ("d", "b"), ("d", "zz")]
    relations = spark.createDataFrame([(x, "calls", y, "exact") for x, y in e] + [("d", "calls", "c", "inferred")], "subject string, predicate string, object string, status string")
    got = T.procedure_claims(spark.createDataFrame(s, "id string, kind string, file string, line int, qualified_name string"), relations).collect()
    assert [(x.id, x.confidence, x.members) for x in got] == [("ki-proc-a-procedure", 0.7, ["a", "b", "c"])]
    assert got[0].claim == "f.a calls 2 same-file helper(s), forming a 3-step sequence: 1. f.a; 2. f.c; 3. f.b. Step order reflects where each helper is defined in the file, not confirmed call-site or runtime order."


def test_ordinals_count_from_zero(spark):
    c = spark.createDataFrame([("x", "s", "k", 3, True), ("y", "s", "k", 1, True), ("w", "s", "k", 2, False), ("z", "s", "j", 9, True)], "id string, symbol_id string, kind string, seq int, accepted boolean")
    assert rows_of(T.claim_ordinals(c), "id", "ordinal") == [("x", 1), ("y", 0), ("z", 0)]


def test_nested_levels_equal_a_stack(spark):
    r = random.Random(4)
    data = [(f"f{f}", i, r.choice([1, 5, 5, 10, 10, 15, 49]), 41) for f in range(4) for i in range(1, 41) if r.random() < 0.8]
    want = {}
    for f in range(4):
        mine, stack = [x for x in data if x[0] == f"f{f}"], []
        for x in mine:
            while stack and stack[-1][2] >= x[2]:
                want[stack.pop()[:2]][1] = x[1] - 1
            want[x[:2]] = [stack[-1][1] if stack else None, 41]
            stack.append(x)
    got = spans.nested(spark.createDataFrame(data, "scope string, at int, level int, last int"), "scope", "at", "level", "last")
    assert {(x.scope, x["at"]): [x.parent, x.end] for x in got.collect()} == want


def test_spans_of_odd_files(spark):
    f = spark.createDataFrame([("a.cbl", None), ("b.cbl", ""), ("c.cbl", "only text"), ("d.cbl", "X.\r\nY.\r\n"), ("e/prog.cbl", "PROGRAM-ID. A.\nCALL 'B'.\n01 R.\nPROGRAM-ID. B.\nCALL \"NONE\".")], "path string, text string")
    assert rows_of(spans.control_spans(spans.logical_lines(f)), "path", "name", "line_start", "line_end") == [("d.cbl", "X", 1, 1), ("d.cbl", "Y", 2, 2)]
    got = {(x.path, x.name): x for x in spans.programs(f).collect()}
    assert got["e/prog.cbl", "A"].calls == ["B"] and got["e/prog.cbl", "A"].external == [] and got["e/prog.cbl", "A"].data_items == 1 and got["e/prog.cbl", "A"].line_end == 3
    assert got["e/prog.cbl", "B"].external == ["NONE"] and ("c.cbl", "C") in got and ("b.cbl", "B") in got


@pytest.mark.parametrize("indent", [2, None])
def test_canonical_json(spark, indent):
    schema = "b boolean, a struct<z:string,k:array<struct<q:int,p:double>>>, m map<string,array<string>>, e array<int>, `Ünï\"c` string, l long, x double"
    data = [(True, ('x\ny"\\', [(1, 0.5), (None, None)]), {"b": ["é", "😀"], "a": []}, [], "\x7f\x00tab\tend\n", 2**62, 1e16), (None,) * 7, (False, (None, []), {}, [1, None], "plain", -1, -1.5e-7), (None, None, None, None, "x\n", 0, -0.0)]
    df = spark.createDataFrame(data, schema)
    for r in df.select(row_json({f.name: f.dataType for f in df.schema}, indent).alias("j"), F.struct(*(f"`{c}`" for c in df.columns)).alias("r")).collect():
        assert r.j == json.dumps(r.r.asDict(True), sort_keys=True, indent=indent)


def test_json_of_odd_and_long_texts(spark):
    r = random.Random(8)
    texts = ["".join(r.choice('ab\\"/u0 \x00\x08\t\n\x0b\x0c\r\x1f\x7f\x80é\u2028\uffff😀') for _ in range(r.randint(0, 12))) for _ in range(400)] + ["a é\n😀" * 50_000]
    began = time.monotonic()
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", json_string(F.col("t")).alias("j")).collect()
    assert all(x.j == json.dumps(texts[x.i]) for x in got) and time.monotonic() - began < 30  # quadratic in a text's length, it takes minutes


FRONT = {
    "plain": ("just a body\n", None, None, "just a body\n"), "null": (None, None, None, ""), "unterminated": ("---\ntype: x\nno end\n", frontmatter.UNTERMINATED, None, ""), "empty": ("---\n---\nbody", frontmatter.NO_TYPE, None, ""),
    "list": ("---\n- a\n- b\n---\n", frontmatter.NO_MAPPING, None, ""), "scalar": ("---\nhello\n---\nb", frontmatter.NO_MAPPING, None, ""), "falsy": ("---\ntype: ''\n---\n", frontmatter.NO_TYPE, None, ""),
    "sources": ("---\ntype: a\nsources: b\n---\n", frontmatter.NO_LIST, None, ""), "resource": ("---\ntype: a\nsources:\n- resource: a\n- path: b\n---\n", frontmatter.NO_RESOURCE, None, ""), "invalid": ("---\ntype: a\nfoo bar: [a\n---\n", frontmatter.INVALID, None, ""),
    "ok": ("---\ntype: Note\ntitle: \"A: b\" # c\nsources:\n- resource: a.md\n  pages: 3\n- resource: 'b''s'\ntags: [x, y z]\nmeta:\n  deep:\n    - one\n---\n\n\n# Body\n", None,
           {"type": "Note", "title": "A: b", "sources[0].resource": "a.md", "sources[0].pages": "3", "sources[1].resource": "b's", "tags[0]": "x", "tags[1]": "y z", "meta.deep[0]": "one"}, "# Body"),
    "crlf": ("---\r\ntype: a\r\n---\r\nb\r\n", None, {"type": "a"}, "b"), "nested": ("---\ntype: a\nm:\n- - 1\n  - 2\n- - 3\n---\n", None, {"type": "a", "m[0][0]": "1", "m[0][1]": "2", "m[1][0]": "3"}, ""),
}


def test_front_matter(spark):
    df = spark.createDataFrame([(k, x[0], 1) for k, x in FRONT.items()], "id string, text string, error int").select("id", "text", F.lit("clash").alias("body"))
    got = {x.id: (x.error, x.front, x.body) for x in frontmatter.read_documents(df).collect()}
    assert got == {k: x[1:] for k, x in FRONT.items()}


def test_documents_round_trip(spark, tmp_path):
    data = [("a b+c", "Note", "x: 'y' \"z\" # no", [("r1", 1), (None, 2)], "body\nmore\n"), ("d", "null", "", [], None), ("e", "Note", "line\nend\\", None, "")]
    df = spark.createDataFrame(data, "name string, type string, title string, sources array<struct<resource:string,page:int>>, text string")
    sinks.write_documents(frontmatter.document_lines(df, "name", ["type", "title"], {"sources": ["resource", "page"]}, F.col("text")), f"{tmp_path}/d")
    got = {x.document: x for x in frontmatter.read_documents(sinks.read_documents(spark, f"{tmp_path}/d")).collect()}
    assert got["a b+c"].error == frontmatter.NO_RESOURCE and got["d"].front == {"type": "null", "title": ""} and got["e"].front["title"] == "line\nend\\"


def tree(folder):
    return {os.path.relpath(f"{d}/{n}", folder): open(f"{d}/{n}", "rb").read() for d, _, names in os.walk(folder) for n in names if "_manifest" not in d and not n.endswith(".crc")}


def test_reports_are_the_same_bytes_again(spark, tmp_path):
    items = spark.createDataFrame([(i, f"k{i}", "s", "p", o, None, None, None) for i, o in enumerate(["A", "B", "A", "A", "", "C", None])], "seq long, id string, subject string, predicate string, object string, review_status string, lifecycle_status string, stale_after string")
    none = spark.createDataFrame([], "source_id string, source_version_id string, version_number int, status string, original_path string")
    sources = spark.createDataFrame([("2026",), ("",), (None,)], "stale_after string")
    for run in range(2):
        lines = bundle_reports.standard_reports(sources, none, items.repartition(run + 2), sources, none)
        manifest = sinks.write_documents(lines, f"{tmp_path}/{run}", per_file=4)
    one, two = tree(f"{tmp_path}/0"), tree(f"{tmp_path}/1")
    assert one == two and manifest.count() == len(one)
    assert one["conflicts/00000.md"].decode() + one["conflicts/00001.md"].decode() == "# Conflict Report\n\n" + "".join(f"- Candidate conflict for `s` / `p` involving `k{i}`\n" for i in (1, 2, 4, 6))
    assert one["freshness/00000.md"] == b"# Freshness Report\n\nSources with freshness metadata: 1\nKnowledge items with freshness metadata: 0\n"
    update = b"".join(v for k, v in sorted(one.items()) if k.startswith("source_update")).decode()
    assert update.endswith("- active: 7\n\n## Source Versions\n- No source versions found.\n")
    empty = bundle_reports.standard_reports(sources.limit(0), none, items.limit(0), sources.limit(0), none)
    text = {k: [x.text for x in empty.filter(F.col("document") == k).orderBy("line").collect()] for k in ("conflicts", "review_summary")}
    assert text == {"conflicts": ["# Conflict Report", "", "- No candidate conflicts detected."], "review_summary": ["# Review Summary", "", "- No knowledge items found.", "", "Review events: 0"]}


def test_turtle_names_and_rules(spark):
    t = "seq long, id string, subject string, predicate string, object string, source_id string, status string"
    data = [(1, "k1", "A b", "should", "x y", "s", "approved"), (2, "k2", "a-B", "should", "x-y", "s", None), (3, "k3", "A b", "should", "x y", None, "x"), (4, "k4", None, None, None, None, None), (5, "k5", "é", "p", 'uncertain "q"\n clinical review', "s", "x")]
    blocks = turtle.turtle_blocks(spark.createDataFrame(data, t)).collect()
    text = "\n".join(x.block for x in sorted(blocks, key=lambda x: (x.seq or -1, x.place)))

    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return f"{h % 2**32:08x}"

    assert text.count(" a sopkb:RelationObject ;") == 4 and f"sopkb:object_x_y_{fnv('x-y' + chr(0) + 'x-y')} a sopkb:RelationObject ;" in text
    assert text.count("sopkb:concept_a_b a sopkb:Concept ;") == 1 and text.count('rdfs:label "A b" .') == 1 and 'sopkb:conditionFact "case_uncertainty"' in text and '"uncertain \\"q\\"  clinical review"' in text
    assert [x.block for x in turtle.turtle_blocks(spark.createDataFrame([], t)).collect()] == ["\n".join([*turtle.PREFIXES, ""])]


def test_item_rules(spark):
    kind = "id string, subject string, predicate string, object string, own array<struct<id:string,title:string,fact:string,action:string,label:string,condition:string,required:boolean>>"
    data = [("a", "S", "requires", "Confirm patient identity; record contraindications", None), ("b", "Sub ject", "pre dicate", None, []), ("c", "S", "p q", "x", [(None, "", "f", None, None, None, False), ("own", "T", None, None, None, None, None)])]
    got = rows_of(rules.item_rules(spark.createDataFrame(data, kind), authored="own"), "item_id", "position", "rule_id", "title", "fact", "required")
    assert got == [("a", 0, "rule-a-confirm-patient-identity", "Confirm patient identity", "patient_identity_confirmed", True), ("a", 1, "rule-a-record-contraindications", "Record contraindications", "contraindications_recorded", True), ("b", 0, "rule-b-pre-dicate", "Sub ject", "scenario_mentions_sub_ject", True),
                   ("c", 0, "rule-c-p-q", "S", "f", False), ("c", 1, "own", "T", None, True)]


def test_states(spark, tmp_path):
    for name, text in {"a": '{"n": 1, "more": {}}', "b": '{"n": ', "c": "", "d": '{"n": "text"}', "e": "[1]"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    read = lambda **o: {x.file[-6]: (x.state and x.state.n, x.corrupt) for x in files.read_states(spark, f"file://{tmp_path}", "n int", **o).collect()}
    assert read() == {"a": (1, False), "b": (None, True), "d": (None, False), "e": (None, True)}
    assert set(read(corrupt="drop")) == {"a", "d"} and files.read_states(spark, f"file://{tmp_path}/none", "n int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_states(spark, f"file://{tmp_path}/none", "n int", missing="error")
    with pytest.raises(Exception, match="not a JSON object"):
        read(corrupt="error")


def test_version_registry(spark):
    kind = "id string, version_number string, version_id string, status string, checksum string, versions array<struct<version_id:string,version_number:string,status:string,checksum:string>>"
    data = [("a", "-2", None, "", "c", None), ("b", "3", "own", "retired", "c", []), ("c", "x", "", None, "c", [("v9", "9", "superseded", "k"), ("v1", None, None, None)]), ("", "1", None, "", "c", None), (None, "1", None, "", "c", None)]
    got = rows_of(P.version_registry(spark.createDataFrame(data, kind)), "source_id", "version", "version_id", "status", "active_version_id", "synthesized", "position")
    assert got == [("a", "1", "a:v1", "active", "a:v1", True, 1), ("b", "3", "own", "active", "own", True, 1), ("c", "9", "v9", "superseded", "c:v1", False, 1), ("c", None, "v1", None, "c:v1", False, 2)]


def test_packed_documents_and_states(spark, tmp_path):
    r = random.Random(9)
    texts = {"a/b.md": "", "a/ü 1": "\n", "[x]*": "one\n\n", "long": "\n".join(f"line {i}" for i in range(60)), "null": None} | {f"d{i}": "".join(r.choice(["x", "\n", "\r\n", "\\", " "]) for _ in range(r.randint(0, 20))) for i in range(200)}
    rows = spark.createDataFrame(list(texts.items()), "name string, body string").repartition(5)
    seen = []
    for run in ("one", "two"):
        index = sinks.write_packed(sinks.text_lines(rows, "name", "body"), f"{tmp_path}/{run}", per_file=100)
        assert index.groupBy("document").count().filter("count > 2").count() == 0 and index.select("document").distinct().count() == len(texts) - 1
        seen.append({p.name: p.read_bytes() for p in (tmp_path / run / "packed").glob("[0-9]*")})
    assert seen[0] == seen[1] and len(seen[0]) < 20 and all(x.count(b"\n") <= 100 for x in seen[0].values())
    assert {x.document: x.text for x in sinks.read_packed(spark, f"{tmp_path}/one").collect()} == {k: t + "\n" for k, t in texts.items() if t is not None}
    sinks.write_packed(sinks.text_lines(rows.limit(0), "name", "body"), f"{tmp_path}/none")
    assert sinks.read_packed(spark, f"{tmp_path}/none").count() == 0

    states = {"a": '{"n": 1}', "b": "", "c": '{"n": ', "d": '{\n  "n": "x"\n}', "e": "[1]"}
    (tmp_path / "single").mkdir()
    for k, t in states.items():
        (tmp_path / "single" / f"{k}.json").write_text(t + "\n")
    sinks.write_packed(sinks.text_lines(spark.createDataFrame([(f"{k}.json", t) for k, t in states.items()], "name string, body string"), "name", "body"), f"file://{tmp_path}/states", ".json")
    for corrupt in ("default", "drop"):
        single, packed = ({x.file[-6]: (x.state and x.state.n, x.corrupt) for x in files.read_states(spark, f"file://{tmp_path}/{f}", "n int", corrupt=corrupt).collect()} for f in ("single", "states"))
        assert single == packed and set(packed) == set("ad" if corrupt == "drop" else "abcde")
    with pytest.raises(FileNotFoundError):
        files.read_states(spark, f"{tmp_path}/none", "n int", missing="error")


def test_lines_of_a_constant_document_stay_in_order(spark, tmp_path):
    lines = spark.range(3000, numPartitions=7).selectExpr("'all' document", "3000 - id line", "concat('t', 3000 - id) text")
    manifest = sinks.write_documents(lines, f"{tmp_path}/d", per_file=1000)
    assert (tmp_path / "d" / "all" / "00001.md").read_text() == "".join(f"t{i}\n" for i in range(1001, 2001)) and manifest.count() == 3


@pytest.mark.parametrize("name", ["s6_states", "x11_adopted_symbols", "s15_documents_read_back"])
def test_files_are_few_however_many_documents(spark, tmp_path, name):
    spark.range(1200).selectExpr("id s_suppkey", "concat('Supplier', id) s_name", "cast(id % 25 as int) s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    top = shared_dir(spark).removeprefix("file://")
    count = lambda: sum(len(f) for _, _, f in os.walk(top))
    before = count()
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() >= 900 and count() - before < 150
