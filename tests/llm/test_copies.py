"""SimHash and vector near-duplicates against brute force, and their edge cases."""

import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countgrove.llm import cross_polytope, simhash
from countgrove.llm.components import components


def _classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "The quick\tbrown fox  jumps over THE lazy dog the quick brown fox É"
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), seed=42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == expected
    assert simhash.fingerprint("Two Words") == xxhash.xxh64_intdigest("two words", seed=42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_fingerprint_of_a_long_text_is_hashed_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("leaf", [8, 64, 10000])
def test_tree_links_equal_brute_force(spark, leaf):
    rng = random.Random(leaf)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = set(centres)
    for c in centres:
        for _ in range(8):
            flips = rng.sample(range(64), rng.randint(1, 4))
            fps.add(c ^ sum(1 << b for b in flips))
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    pairs = [(a, b) for a, b in itertools.combinations(signed, 2)
             if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 2]
    found = {r["node"]: r["root"] for r in components(simhash.links(df, 2, leaf)).collect()}
    assert {n: found.get(n, n) for n in signed} == _classes(signed, pairs)


@pytest.mark.parametrize("splits", [0, 3])
def test_tasks_of_a_dense_cluster_are_bounded(spark, monkeypatch, splits):
    """A third of the fingerprints lie around one centre: leaves are split, or cut into parts, and no link is lost."""
    monkeypatch.setattr(simhash, "SPLITS", splits)
    leaf, rng = 40, np.random.default_rng(splits)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    centre = rng.integers(1 << 63, dtype=np.uint64)
    dense = [centre ^ np.bitwise_xor.reduce(rng.choice(bit, n, replace=False)) for n in rng.integers(1, 5, 900)]
    fps = np.unique(np.concatenate([rng.integers(1 << 63, size=1800, dtype=np.uint64), np.array(dense, dtype=np.uint64)]))
    signed = fps.view(np.int64)
    df = spark.createDataFrame([(int(f),) for f in signed], "fp long").repartition(3)
    sizes, inner = [], simhash._dealt

    def dealt(*args):
        out = inner(*args)
        sizes.extend(out.groupBy("leaf", "_h", "_q").agg(F.count_if("home"), F.count_if("ask")).collect())
        return out

    monkeypatch.setattr(simhash, "_dealt", dealt)
    found = {r["node"]: r["root"] for r in components(simhash.links(df, 2, leaf)).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    nodes = signed.tolist()
    assert {n: found.get(n, n) for n in nodes} == _classes(nodes, zip(signed[i].tolist(), signed[j].tolist()))
    assert max(s[3] for s in sizes) <= 3 * leaf and max(s[4] for s in sizes) <= 12 * leaf


def test_simhash_edge_cases(spark):
    rows = [(3, None, "a"), (1, "", "b"), (None, " ", "c"), (5, "one two three four", None), (5, "one two three four", None),
            (9, "ONE two three four", "d"), (7, "something else entirely here", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("fp", F.lit("x"))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (None, 1), (5, 5), (5, 5), (9, 5), (7, 7)], key=str)
    zero = simhash.near_duplicates(docs).filter("doc_id = 1").first()
    assert zero.fingerprint == "0" * 16
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 5, 7, None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.Random(2).shuffle(chain)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 300)}}
    assert components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


def _vectors():
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        v = rng.normal(size=16)
        for _ in range(rng.integers(1, 6)):
            w = v / np.linalg.norm(v) + rng.normal(size=16) * 0.04
            rows.append((w * rng.uniform(0.5, 20)).tolist())
    return [(i, v, int(i % 2)) for i, v in enumerate(rows)] + [(900 + i, rows[0], 0) for i in range(5)]


@pytest.mark.parametrize("chunk", [4, 1024])
def test_vector_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(cross_polytope, "CHUNK", chunk)
    monkeypatch.setattr(cross_polytope, "BIN", 50)
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: k for i, _, k in rows}
    pairs = [(a, b) for a, b in itertools.combinations(unit, 2)
             if label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    links = dict.fromkeys(unit, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    roots = _classes(unit, pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cross_polytope.near_duplicates(df, tables=8).collect()}
    assert got == {i: (links[i], roots[i], roots[i] == i) for i in unit}


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.0], None), (4, [1.0, nan], 1),
            (5, [1.0, None], 1), (6, [0.0, -0.0], 1), (7, None, 1), (8, [], 1), (9, [1.0, inf], 1), (10, [1.0, 2.0, 0.0], 1),
            (None, [1.0, 2.0], 1), (12, [-1.0, -2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in cross_polytope.near_duplicates(df).collect())
    alone = [(str(i), 0, str(i)) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12)]
    assert got == sorted([("1", 3, "1"), ("2", 3, "1"), ("2", 3, "1"), ("None", 3, "1"), *alone])
    assert cross_polytope.near_duplicates(df.limit(0)).count() == 0
    floats = df.select("vec_id", F.col("embedding").cast(T.ArrayType(T.FloatType())).alias("embedding"), "label")
    assert cross_polytope.near_duplicates(floats).filter("vec_id = 1").first().n_links == 3


def test_hashing_has_high_recall_near_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * side
    for functions in (2, 3):
        met = np.zeros(len(a), dtype=bool)
        for t in range(cross_polytope.TABLES):
            x, y = (cross_polytope.bucket_keys(v, t, functions) for v in (a, b))
            met |= (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
        assert met.mean() > 0.99
