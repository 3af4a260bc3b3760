"""Fill-in-middle, lexical search and token counts against plain versions of their definitions."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from countgrove.llm import fill_in_middle, lexical_search, token_counts
from countgrove.plans.scratch import new_path

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ODD = ["", None, " ", "one", " \t two\nthree  ", "a<P>b", "<S", "ends in <", "é ü 漢字 😀 x", "x" * 5000, "w " * 4000]


def texts(n, seed=0):
    rng = random.Random(seed)
    words = [f"{c}{i}" for i in range(60) for c in ("ab", "Cd", "é")]
    return [" ".join(rng.choices(words, weights=range(180, 0, -1), k=rng.choice([1, 5, 30, 200, 900]))) for _ in range(n)]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("own") for c in ("n", "output", "content", "score", "version", "term")}) if clash else df


# --- fill-in-middle -------------------------------------------------------------------------

def plain_cut(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < 80
    return doc, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_cuts_equal_a_walk_over_units(spark):
    rows = list(enumerate(ODD * 12 + texts(60))) + [(None, "no id here"), (3, "repeated id"), (3, "repeated id")]
    got = fill_in_middle.transform(frame(spark, rows, clash=True).repartition(3), window=64)
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_cut(*r) for r in rows), key=str)
    forms = {r["form"] for r in got.collect()}
    assert forms == {"plain", "spm", "psm"}
    back = got.withColumn("back", fill_in_middle.restored())
    assert sorted((r["doc_id"] or -1, r["back"]) for r in back.collect()) == sorted((r[0] or -1, r[1] or "") for r in rows)
    assert fill_in_middle.transform(frame(spark, [])).count() == 0


def test_windows_do_not_move_units():
    for text in [t or "" for t in ODD] + texts(20, 1):
        ends, at = [], 0
        for u in UNIT.findall(text):
            at += len(u)
            ends.append(at)
        for window in (1, 2, 7, 100, 1 << 20):
            assert fill_in_middle.unit_ends(text, window) == ends
    assert len(fill_in_middle.unit_ends("abc de " * 3_000_000)) == 6_000_001   # beyond what one match can keep


def test_sentinels_that_cannot_be_found_again_are_refused(spark):
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(frame(spark, []), sentinels=bad)
    own = ("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    rows = list(enumerate(texts(30, 2)))
    got = fill_in_middle.transform(frame(spark, rows), seed=7, rate=100, spm=50, sentinels=own)
    assert {r["form"] for r in got.collect()} == {"psm", "spm"}
    back = got.select("doc_id", fill_in_middle.restored(own).alias("text"))
    assert sorted(map(tuple, back.collect())) == rows


# --- lexical search -------------------------------------------------------------------------

def plain_search(docs, items, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bags = [Counter(TERM.findall((t or "").translate(lower))) for _, t in docs]
    n_docs, words = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(lower)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for (doc, _), bag in zip(docs, bags):
            score = 0
            for t in wanted & set(bag):
                m = 10 + 90 * sum(bag.values()) * n_docs // words
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return out


def found(spark, docs, items, **options):
    items = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(frame(spark, docs, clash=True).repartition(3), items, **options)
    return [tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()]


def test_search_equals_scoring_every_document(spark):
    bodies = texts(150, 3) + ODD
    docs = list(enumerate(bodies)) + [(1000 + i, bodies[7]) for i in range(40)] + [(None, bodies[7]), (None, bodies[9]), (5, bodies[11])]
    items = [(i, t) for i, t in enumerate(texts(25, 4))] + [(30, bodies[7]), (31, "Ab0 AB1 ab0"), (32, ""), (33, None), (34, "unheard"),
                                                            (35, "ab3"), (35, "cd4"), (None, "é5 é6"), (36, "漢字 😀")]
    expected = plain_search(docs, items)
    assert sorted(found(spark, docs, items), key=str) == sorted(expected, key=str)
    assert sorted(found(spark, docs, items, query_terms=300, top=3), key=str) == sorted((r for r in expected if r[1] <= 3), key=str)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, "..."), (2, None)], items) == []


def test_saturated_signatures_stay_exact(spark):
    """Signatures of far too few bits exclude little, and the result is the same."""
    docs, items = list(enumerate(texts(60, 5))), list(enumerate(texts(6, 6)))
    assert sorted(found(spark, docs, items, widest=16)) == sorted(plain_search(docs, items))


def test_bounds_are_upper_bounds():
    import numpy as np
    import xxhash

    bodies = texts(40, 7)
    bags = [Counter(lexical_search.terms(t)) for t in bodies]
    block = lexical_search._Block(lexical_search._width(2000))
    for i, bag in enumerate(bags):
        pairs = [(t, j) for t, n in bag.items() for j in range(n.bit_length())]
        h = np.array([xxhash.xxh64_intdigest(t, 42) for t, _ in pairs], dtype=np.uint64)
        block.add(i, b"", sum(bag.values()), max(bag.values()), lexical_search._slots(h, np.array([j for _, j in pairs]), block.width).ravel())
    width, _, _, sizes, most, bits = block.row()
    vocabulary = sorted(set().union(*bags))
    hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in vocabulary], dtype=np.uint64)
    own, weights = np.arange(0, len(vocabulary), 2), np.arange(len(vocabulary))[::2] + 1.0
    bound = lexical_search._bounds(width, sizes, most, bits, hashes, [weights], [own], len(bags), sum(sizes))[0]
    for i, bag in enumerate(bags):
        m = 10 + 90 * sizes[i] * len(bags) // sum(sizes)
        score = sum(int(w) * (10**9 * bag[vocabulary[k]] // (1000 * bag[vocabulary[k]] + 8 * m)) for k, w in zip(own, weights) if vocabulary[k] in bag)
        assert score <= bound[i] <= 1.6 * score


# --- token counts ---------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    bodies = ODD + texts(30, 8) + ["<|endoftext|> a<|endoftext|>b", "don't  stop ", "<s> </s>"]
    rows = list(enumerate(bodies)) + [(None, "no id"), (4, "again"), (4, "again")]
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(library.encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    expected = [(i, len((t or "").encode()), size(t or ""), size(t or "") > 20) for i, t in rows]
    for small in (0, 1000):
        got = token_counts.count(frame(spark, rows, clash=True).repartition(3), path, limit=20, small=small)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_parts_of_a_long_text_have_the_tokens_of_the_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = token_counts.counter(path, 1 << 30)
    for text in [*filter(None, ODD), *texts(20, 9), "a  b   c \n d " * 50, "<|endoftext|> x " * 40, "no-space" * 400]:
        assert token_counts.counter(path, 10)([text]) == whole([text])


def test_only_misses_are_encoded_and_appended(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "test-cache")
    rows = list(enumerate(["one two", "three", "one two", None, ""]))
    token_counts.count(frame(spark, rows), path, cache).collect()
    assert spark.read.parquet(cache).count() == 3          # one two, three, and the empty text
    version = token_counts.tokenizer_version(path)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"stored").digest()), 99, version), (bytearray(hashlib.sha256(b"other").digest()), 98, "old")],
                          token_counts._CACHE).write.partitionBy("version").mode("append").parquet(cache)
    got = token_counts.count(frame(spark, [*rows, (5, "stored"), (6, "other"), (7, "new"), (8, "new")]), path, cache)
    counts = {r["doc_id"]: r["n_tokens"] for r in got.collect()}
    assert counts[5] == 99 and counts[6] == 1 and counts[3] == counts[4] == 0 and counts[0] == counts[2] == 2
    held = spark.read.parquet(cache).filter(F.col("version") == version)
    assert held.count() == 6 and held.select("content").distinct().count() == 6
    assert token_counts.count(frame(spark, []), path, cache).count() == 0
    folded = token_counts.count(frame(spark, [(1, "A  b"), (2, "a b")]), path, cache, normalise=lambda t: F.lower(F.regexp_replace(t, " +", " ")))
    assert {r["n_tokens"] for r in folded.collect()} == {2} and sorted(r["n_bytes"] for r in folded.collect()) == [3, 4]
