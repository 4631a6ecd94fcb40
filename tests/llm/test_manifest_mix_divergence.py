"""The manifest, the mix and the divergence audit against plain Python, and on nulls, empty and long texts, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomkb.llm import divergence, manifest, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rid int, n long, before long, rank int, path string"


def frame(spark, rows):
    """(doc_id, text, lang, source) as documents, with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", 3, 1, 2, 5, "p") for i, t, g, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = ["".join(r.choice("abcdeéßж") for _ in range(r.randint(1, 4))) for _ in range(60)]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 90)))
    out = [(i, text() + ("\n" if i % 3 else "") + text(), r.choice(["en", "de"]), f"s{min(r.randint(0, 9), 4)}") for i in range(400)]
    out += [(1000 + i, "same words here", "en", "s0") for i in range(150)]  # copies
    out += [(7, out[7][1], "en", "s1")] * 3 + [(None, "no\nid", "en", "s1"), (None, None, None, None), (2000, None, "en", None), (2001, "", "fr", "s2"), (2002, " \t\n ", "fr", "s3")]
    return [*out, (2003, "long Text " * 30_000, "en", "s0"), (2004, "alone", "xx", "only"), (-5, "minus\n", "en", "Z"), (2**63 - 1, "top", "en", "é")]


# manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The root of a list of nodes, and for each of them the list of (left, right) on its way."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(rows):
    sources = defaultdict(list)
    for i, t, g, s in rows:
        n = None if t is None else len(t)
        cut = t if t is None or i is None or zlib.crc32(str(i).encode()) % 2 else t.replace("\n", "")
        sources[s].append(((i is not None, i or 0), leaf(i, s, g, n, t), leaf(i, s, g, n, cut), i))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(sources[s]), *climb([x[1] for x in sorted(sources[s])])) for s in names}
    root, above = climb([trees[s][1] for s in names])
    for s, up in zip(names, above):
        leaves, sub, paths = trees[s]
        for (_, own, arrived, i), path in zip(leaves, paths):
            at = arrived
            for left, right in path + up:
                at = h(left, at, right)
            yield i, own, sub, root, h(*(a + b for a, b in path + up)), at, at == root


@pytest.mark.parametrize("every", [1, 4])
def test_manifest_equals_plain_python(spark, rows, tmp_path, every):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    manifest.build(frame(spark, rows), f"{tmp_path}/m", {"text": tampered}, every=every)
    got = manifest.verify(spark, f"{tmp_path}/m", every=every).withColumn("proof", F.sha2(manifest.siblings(F.col("path")), 256))
    got = [tuple(r) for r in got.select("id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(brute_manifest(rows), key=order)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [1, 4, 28])
def test_manifest_of_one_source(spark, tmp_path, n):
    rows = [(i, f"text {i}", "en", "s") for i in range(n)]
    manifest.build(frame(spark, rows), f"{tmp_path}/m")
    got = manifest.verify(spark, f"{tmp_path}/m").collect()
    assert {(r.id, r.root) for r in got} == {(r[0], r[3]) for r in brute_manifest(rows)} and all(r.verified for r in got)


def test_manifest_stores_every_few_levels(spark, tmp_path):
    manifest.build(frame(spark, [(i, str(i), "en", "s") for i in range(100)]), f"{tmp_path}/m", every=2)
    stored = [spark.read.parquet(f"{tmp_path}/m/sources/level-{k}") for k in range(3)]
    assert [s.agg(F.sum(F.size("nodes"))).first()[0] for s in stored] == [100, 12, 2]


def test_manifest_of_an_empty_table(spark, tmp_path):
    manifest.build(frame(spark, []), f"{tmp_path}/m")
    assert manifest.verify(spark, f"{tmp_path}/m").count() == 0


# mix


def test_permutation_takes_each_place_once(spark):
    for n in (1, 2, 7, 100):
        keys = F.transform(F.array(*map(F.lit, range(12))), lambda i: (i * 7919 + 13) % n)
        got = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), keys, F.lit(0)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n)) and (n < 100 or sum(r.x == r.id for r in got) < 10)


def test_permutation_of_ints_is_that_of_longs(spark):
    n, keys = 100_000, [99_999, 54_321, 7]
    at = [spark.range(50).select(mixing.permuted(F.col("id").cast(t), F.lit(n).cast(t), F.array(*map(F.lit, keys)).cast(f"array<{t}>"), F.lit(3).cast(t)).alias("x")) for t in ("int", "long")]
    assert at[0].collect() == at[1].collect() and at[0].dtypes == [("x", "bigint")]


def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in capped]
        share = (total - 3 * sum(sizes[s] for s in capped)) / (sum(weight[s] for s in rest) or 1)
        over = {s for s in rest if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * share for s in names}
        capped |= over


def test_mix(spark, rows):
    docs = frame(spark, rows)
    got = mixing.taken(docs, [1, 2, 3], block=8, shard=64).collect()
    again = mixing.taken(docs.repartition(7), [1, 2, 3], block=8, shard=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, takes, source = Counter(), Counter(), {}
    for i, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    targets = brute_targets(sizes)
    for r in got:
        assert r.taken <= 3 * r.size and (r.size or not r.taken)
        if r.doc_id in (None, 7):
            continue
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - targets[source[r.doc_id]]) < 1e-6
    placed = Counter()
    for r in got:
        takes[r.target, r.source_size] += r.taken
        placed[r.target, r.source_size] += 1
    for s in sizes:
        assert abs(takes[targets[s], sizes[s]] - targets[s]) <= 16


def test_mixed_texts_are_the_words_of_their_documents(spark, rows):
    from fathomkb.llm.common import Scratch

    with Scratch(spark) as steps:
        parts, _, sources = mixing.mix(frame(spark, rows), [1, 2], steps, True, block=8, shard=64)
        got, target = parts.collect(), {r.tree: r for r in sources.collect()}
    texts = defaultdict(list)
    for i, t, _, _ in rows:
        texts[i].append(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    slots = defaultdict(int)
    for r in got:
        assert any(r.doc_words == t[r["at"] : r["at"] + r.words] for t in texts[r.doc_id])
        slots[r.tree, r.k] += r.words
    assert max(slots.values()) == 8 and sum(v < 8 for v in slots.values()) <= 3 * len(target)
    shards = Counter((r.shard, r.tree) for r in {(x.shard, x.tree, x.k): x for x in got}.values())
    last = max(s for s, _ in shards)
    assert all(sum(n for (s, _), n in shards.items() if s == k) == 64 for k in range(last))
    assert len({n for (s, t), n in shards.items() if t == "=s0"}) > 1  # counts are drawn


def test_mix_without_words(spark):
    assert mixing.taken(frame(spark, [])).count() == 0
    got = mixing.taken(frame(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


# divergence


def brute_audit(rows, least, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, g, s in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        groups[g or ""].add(s or "")
        n[g or "", s or ""].update(found)
        docs[g or ""].update(set(found))
    for g, sources in groups.items():
        kept = [t for t, d in docs[g].items() if d >= least]
        all_n = {t: sum(n[g, s][t] for s in sources) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(n[g, s]) for s in sources}, share(all_n)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if n[g, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, v) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    yield g, s, part, item, v, k + 1


@pytest.mark.parametrize("least, top, cells", [(30, 50, 65_536), (2, 5, 40), (10**6, 50, 65_536)])
def test_audit_equals_plain_python(spark, rows, monkeypatch, least, top, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)
    got = [tuple(r) for r in divergence.audit(frame(spark, rows), least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == sorted(brute_audit(rows, least, top))


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_skyband_holds_the_first_of_every_monotone_score():
    r = random.Random(1)
    rows = pd.DataFrame({"n": [r.randint(1, 30) for _ in range(3000)], "all_n": [r.randint(30, 60) for _ in range(3000)], "term": [f"t{i}" for i in range(3000)]})
    band = divergence.skyband(rows, 10)
    own = [sum(1 for b in rows.itertuples() if b.n >= a.n and b.all_n <= a.all_n and b.term.encode() < a.term.encode()) for a in rows.itertuples()]
    assert sorted(band["term"]) == sorted(t for t, d in zip(rows["term"], own) if d < 10) and len(band) < 1500


def test_blocks_of_sources(spark):
    rows = [(i, f"w{'abcdefg'[i % 7]} we{'xyz'[i % 3]}", "en", f"s{i % 11}") for i in range(300)]
    assert sorted(tuple(r) for r in divergence.audit(frame(spark, rows), 3, 4, size=4).select("lang", "source", "part", "item", "value", "rank").collect()) == sorted(brute_audit(rows, 3, 4))
