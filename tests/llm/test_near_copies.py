"""The near-duplicate stage of the pipeline against brute force over all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from countgrove.llm import near_copies


def _set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _kept_by_hand(rows):
    """Smallest id of each class of texts with Jaccard similarity 0.8 or more."""
    sets = sorted({_set(t) for _, t in rows}, key=lambda s: sorted(s))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        sizes = len(sets[i]), len(sets[j])
        if 10 * min(sizes) >= 8 * max(sizes) > 0 and 9 * len(sets[i] & sets[j]) >= 4 * sum(sizes):
            root[find(j)] = find(i)
    place = {s: find(i) for i, s in enumerate(sets)}
    first = {}
    for i, t in rows:
        if i is not None:
            k = place[_set(t)]
            first[k] = min(first.get(k, i), i)
    return sorted(first.values())


def _edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"x{rng.random()}"
    return words


def test_near_duplicate_stage_equals_brute_force(spark):
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))] + passage * (k % 2)
        rows += [(None, " ".join(_edited(rng, base, rng.randrange(len(base) // 30)))) for _ in range(8)]
    hot = [f"h{i}" for i in range(120)]
    rows += [(None, " ".join(_edited(rng, hot, rng.randrange(5)))) for _ in range(120)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    rows += [(900, rows[7][1].upper()), (901, "two words"), (902, "Two\nwords"), (903, None), (904, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).repartition(5)
    got = corpus_pipeline.drop_near_copies(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == _kept_by_hand(rows)


def test_near_duplicate_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == _kept_by_hand(rows)


def test_rows_without_id_and_repeats(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    one, two = _edited(rng, base, 0), _edited(rng, base, 3)
    rows = [(5, " ".join(one)), (5, " ".join(one)), (None, " ".join(two)), (None, " ".join(two)), (9, " ".join(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in near_copies.keep_first(docs).collect()), key=str) == [5, None, None]
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_bands_meet_at_the_threshold():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(3000):
        h = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
        a, b = np.sort(h[:180]), np.sort(h[20:])      # 160 of 200 shared
        met += bool(set(near_copies.bands(a)) & set(near_copies.bands(b)))
    assert met == 3000


def test_stage_links_fingerprints_too(spark):
    passage = " ".join(f"p{i}" for i in range(21))     # odd: no bit is tied
    rows = [(i, " ".join([passage] * 60 + [f"own{i}w{k}" for k in range(40)])) for i in range(1, 4)]     # alike to SimHash only
    rows += [(4, rows[1][1].replace("own2w3 ", "")), (5, "another text of other words altogether"), (6, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.keep_first(docs).collect()) == [1, 2, 3, 5]
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()) == [1, 5]
