"""The corpus pipeline on a small fixture, stage by stage against what each should do, and the registered queries."""

import hashlib
import random

import pytest

import __spark_entry__ as entry

corpus_pipeline = pytest.importorskip("corpus_pipeline")
r = random.Random(9)
VOCAB = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(700)]


def text(seed, n=120):
    q = random.Random(seed)
    return " ".join(q.choice(VOCAB) for _ in range(n)).capitalize() + "."


def test_pipeline(spark, tmp_path):
    item, key = text(5000, 40), hashlib.sha1(b"pipeline").hexdigest()
    junk = lambda s: " ".join(w.upper() + "!!" for w in text(s).split())
    rows = [(i, text(i) if i % 3 else junk(i), "en", "s1", 1) for i in range(120)]
    rows += [(200, text(1), "en", "s1", 1), (201, text(999) + " " + item, "en", "s1", 1), (202, text(998) + f' token = "{key}"', "en", "s1", 1), (203, None, "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {x.doc_id: x for x in docs.collect()}
    good = {i for i in range(120) if i % 3}
    assert good | {200, 201, 202} <= set(seen["quality"]) and not set(range(0, 120, 3)) & set(seen["quality"])
    assert 200 not in seen["near_dedup"] and good | {201, 202} <= set(seen["near_dedup"])
    assert 201 not in seen["decontamination"] and good | {202} <= set(seen["decontamination"])
    assert key not in seen["secrets"][202].text and seen["secrets"][1].text == text(1)
    assert all(x.restored for i, x in seen["pieces"].items() if i != 203)
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted((i,) for i in seen["pieces"])


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Repeated, null and clashing ids and columns, empty and long texts: each stage's rows are those of slow versions."""
    from collections import Counter

    from fathomkb.llm import pieces, quality

    from .test_operators import brute_components, brute_contained

    items = ["Anna has 12 apples and gives 5 to Ben. How many apples does Anna have left in the old green basket now?", text(7000, 30), "42"]
    junk = lambda s: " ".join(w.upper() + "!!" for w in text(s).split())
    rows = [(i, text(i) if i % 3 else junk(i)) for i in range(60)]
    near = lambda s, k: " ".join("changed" if j == k else w for j, w in enumerate(text(s).split()))
    rows += [(300, near(1, 50)), (301, near(1, 60)), (302, near(2, 9)), (4, text(4)), (4, text(400)), (5, near(7, 3)), (None, text(500)), (None, text(1)), (305, ""), (306, None)]
    rows += [(310, text(501) + " " + items[0].replace("Anna", "Weng Li").replace("12", "9")), (None, text(502) + " " + items[1]), (311, text(503) + " 42 " + text(504)), (312, " ".join(text(600 + k, 200) for k in range(30)))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copy_id int, leaking int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    good = [x for x in rows if model.score([x[1]])[0] >= 0.5]
    assert {i for i, _ in good if i and i < 60} == {i for i in range(60) if i % 3}
    known, keyed = {}, []  # texts under one id are documents of their own: number them behind all ids, in the order of their hashes
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for _, t in good], "text string").distinct().selectExpr("text", "xxhash64(text) h").collect()}
    for i, t in sorted({x for x in good if x[0] is not None}, key=lambda x: (x[0], hashes[x[1]])):
        key = i if i not in known else 10_000 + len(keyed)
        known[i] = t
        keyed.append((key, i, t))
    root, _ = brute_components([(k, t) for k, _, t in keyed])
    stays = Counter((i, t) for k, i, t in keyed if root[k] == k) + Counter(x for x in good if x[0] is None)
    stays = Counter({x: n for x, n in stays.items() if not any(brute_contained(x[1] or "", s) for s in items)})

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == stays
    lattice = pieces.Lattice(open(pieces.MODEL, "rb").read())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, lattice.decode(r.ids) if r.ids is not None else None) for r in out) == stays


def test_pipeline_of_no_documents(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
