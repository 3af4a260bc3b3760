"""Ranked lexical search over bit-sliced Bloom signatures.

Every document has a signature: each of its terms sets a few bits, once for every level 2^j that its
count reaches. Documents of like size share a block, whose bits are stored by slice: slice s is the
bitmap of the documents that have bit s. The slices of a term and level, ANDed, overestimate which
documents hold the term that often. Bitmaps weighted by the terms and added up give per document an
upper bound of its score, which is exact but for wrong bits and counts between two levels.

A search runs in two rounds. The documents with the highest bounds are scored exactly, which gives
each item a score that its last rank reaches at least. Then all documents whose bound does not fall
below it are scored exactly; the others are provably not among the first.

Blocks are built where the texts are read and never move. Items are the stated query set and are
taken in blocks of a bounded number of terms, which every executor gets; of the documents only
bounds, candidates and the texts of candidates leave a task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.scratch import release, written
from .common import digest_of as _content, fields, map_batches, one_text_each, slices

TOP = 10             # ranks of an item
HASHES = 3           # bits a term sets per level
BITS_PER_TERM = 16   # signature bits per term and level, at least
NARROWEST, WIDEST = 1 << 10, 1 << 24   # bits of a signature; beyond, bounds loosen and results stay exact
CELLS = 1 << 23      # bits of a block, about
MOST_DOCS, LEAST_DOCS = 4096, 8        # documents of a block
TERMS_HELD = 1 << 18  # counted terms a task holds before it hands them on
QUERY_TERMS = 1 << 18  # terms of the items that are asked at once and sent to every executor, about
CHUNK_TERMS = 1 << 10  # terms whose bitmaps are weighed at once
B_SHARE = 90         # hundredths of length normalisation

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order: runs of ASCII letters and digits and of all further characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM).split()


class _Hashes(dict):
    """64-bit hash per term, kept while there are not too many."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > TERMS_HELD:
            self.clear()
        self[term] = h = xxhash.xxh64_intdigest(term, 42)
        return h


def _slots(hashes: np.ndarray, level: int | np.ndarray, width: int) -> np.ndarray:
    """The HASHES slices of each (term, level) in a signature of `width` bits, one column per hash."""
    h = (hashes ^ (np.atleast_1d(level).astype(np.uint64) * _ODD)) * _ODD
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    places = h[..., None] + np.arange(HASHES, dtype=np.uint64) * step[..., None]
    return (places & np.uint64(width - 1)).astype(np.int64)


def _width(entries: int, widest: int = WIDEST) -> int:
    """Signature bits for so many (term, level) entries: a power of two."""
    return min(widest, max(NARROWEST, 1 << (max(entries, 1) * BITS_PER_TERM - 1).bit_length()))


class _Block:
    """Signatures of some documents of one width, by slice."""

    def __init__(self, width: int):
        self.width = width
        self.room = max(LEAST_DOCS, min(MOST_DOCS, CELLS // width)) // 8 * 8
        self.bits = np.zeros((width, self.room // 8), dtype=np.uint8)
        self.ids: list = []
        self.contents: list[bytes] = []
        self.sizes: list[int] = []
        self.most: list[int] = []

    def add(self, doc, content: bytes, size: int, most: int, slots: np.ndarray) -> bool:
        at = len(self.ids)
        self.bits[slots, at >> 3] |= np.uint8(128 >> (at & 7))
        self.ids.append(doc)
        self.contents.append(content)
        self.sizes.append(size)
        self.most.append(most)
        return at + 1 == self.room

    def row(self) -> tuple:
        used = -(-len(self.ids) // 8)
        return self.width, self.ids, self.contents, self.sizes, self.most, self.bits[:, :used].tobytes()


def _index_schema(id_type: T.DataType) -> T.StructType:
    return fields(("width", T.LongType()), ("ids", T.ArrayType(id_type)), ("contents", T.ArrayType(T.BinaryType())),
                  ("sizes", T.ArrayType(T.LongType())), ("most", T.ArrayType(T.LongType())), ("bits", T.BinaryType()),
                  ("part", T.IntegerType()), ("term", T.BinaryType()), ("df", T.LongType()))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", widest: int = WIDEST) -> DataFrame:
    """The written index: rows of blocks (width, ids, contents, sizes, most, bits), and rows (term, df) by task.

    `contents` are digests of the texts, `sizes` numbers of terms, `most` the count of the most
    frequent term. Documents without terms are in no block.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), _content(text).alias("content"))
    schema = _index_schema(docs.schema[id_col].dataType)
    kinds, labels = [to_arrow_type(f.dataType) for f in schema.fields], schema.fieldNames()

    def batch(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], labels)

    def of_block(block: _Block, part: int) -> pa.RecordBatch:
        return batch([[v] for v in (*block.row(), part, None, None)])

    def of_terms(found: Counter, part: int) -> pa.RecordBatch:
        n = len(found)
        return batch([*[[None] * n] * 6, [part] * n, list(found), list(found.values())])

    def run(batches):
        part = TaskContext.get().partitionId()
        hashes, held, blocks = _Hashes(), Counter(), {}
        for whole in batches:
            for piece in slices(whole):
                for doc, body, content in zip(*[piece.column(i).to_pylist() for i in range(3)]):
                    found = Counter(terms(body))
                    if not found:
                        continue
                    held.update(found.keys())
                    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
                    counts = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                    levels = np.frexp(counts.astype(float))[1]       # the counts 2^0 to 2^(levels - 1) are reached
                    at = np.repeat(np.arange(len(h)), levels)
                    level = np.arange(len(at)) - np.repeat(np.cumsum(levels) - levels, levels)
                    width = _width(len(at), widest)
                    block = blocks.get(width) or blocks.setdefault(width, _Block(width))
                    if block.add(doc, content, int(counts.sum()), int(counts.max()), _slots(h[at], level, width).ravel()):
                        yield of_block(blocks.pop(width), part)
                    if len(held) > TERMS_HELD:
                        yield of_terms(held, part)
                        held.clear()
        for block in blocks.values():
            yield of_block(block, part)
        if held:
            yield of_terms(held, part)

    return written(rows.mapInArrow(run, schema), "signatures")


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term) of every item, each term once; rows of one id are one item."""
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))

    def work(ids, texts):
        pairs = [(i, t) for i, text in zip(ids, texts) for t in dict.fromkeys(terms(text))]
        return [i for i, _ in pairs], [t for _, t in pairs]

    return map_batches(rows, ["item", "text"], fields(("item", rows.schema["item"].dataType), ("term", T.BinaryType())),
                       work).distinct()


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's contribution per weight: rises with its count."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _bounds(width, sizes, most, bits, hashes, weights, owners, n_docs, n_terms):
    """Per item its upper bounds over the documents of a block, as an int64 matrix.

    `hashes` are those of the distinct terms; `owners` lists per item the places of its terms there,
    `weights` their weights.
    """
    m = np.array([100 - B_SHARE + (B_SHARE * n * n_docs) // n_terms for n in sizes], dtype=np.int64)
    most = np.array(most, dtype=np.int64)
    docs = len(sizes)
    bits = np.frombuffer(bits, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((len(owners), docs), dtype=np.int64)
    live, above = np.arange(len(hashes)), None
    before = np.zeros(docs, dtype=np.int64)
    for level in range(int(most.max()).bit_length()):
        slots = _slots(hashes[live], level, width)
        here = bits[slots[:, 0]]
        for k in range(1, HASHES):
            here &= bits[slots[:, k]]
        if above is not None:
            here &= above
        some = here.any(axis=1)
        live, above = live[some], here[some]
        if not live.size:
            break
        place = np.full(len(hashes) + 1, -1)
        place[live] = np.arange(live.size)
        gain = _gain(np.minimum(most, 2 ** (level + 1) - 1), m)
        step, before = np.where(most >= 2 ** level, gain - before, 0), gain
        present = np.unpackbits(above, axis=1, count=docs).astype(np.float64)
        for i, (own, w) in enumerate(zip(owners, weights)):
            at = place[own]
            held = at >= 0
            if held.any():
                out[i] += (w[held] @ present[at[held]]).astype(np.int64) * step
    return out


class _Items:
    """Some items with the hashes of their distinct terms, in chunks of about CHUNK_TERMS terms."""

    def __init__(self, asked: list[tuple[object, dict[bytes, int]]]):
        self.asked = asked
        self._chunks = None

    def chunks(self):
        """(numbers of the items, hashes of their terms, weights per item, places of the terms per item)."""
        if self._chunks is None:
            self._chunks, start, held = [], 0, 0
            for k, (_, weights) in enumerate(self.asked):
                held += len(weights)
                if held >= CHUNK_TERMS or k + 1 == len(self.asked):
                    part = [w for _, w in self.asked[start:k + 1]]
                    place = {t: i for i, t in enumerate(dict.fromkeys(t for w in part for t in w))}
                    self._chunks.append((range(start, k + 1), np.array([xxhash.xxh64_intdigest(t, 42) for t in place], dtype=np.uint64),
                                         [np.array(list(w.values()), dtype=np.float64) for w in part],
                                         [np.array([place[t] for t in w]) for w in part]))
                    start, held = k + 1, 0
        return self._chunks

    def __reduce__(self):
        return _Items, (self.asked,)


def _record(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], schema.fieldNames())


def _bounded(blocks: DataFrame, items, n_docs: int, n_terms: int, top: int, limits: dict | None) -> DataFrame:
    """(no, bound, id, content, size) of the documents of each block that item `no` has to look at.

    Without limits the `top` highest bounds of a block; with them all documents that the limit of the
    item, a score and an id, does not exclude. Of equal texts only the `top` smallest ids can be among the first.
    """
    schema = fields(("no", T.IntegerType()), ("bound", T.LongType()), ("id", blocks.schema["ids"].dataType.elementType),
                    ("content", T.BinaryType()), ("size", T.LongType()))

    def leading(bound, order):
        at = np.nonzero(bound > 0)[0]
        return at[np.lexsort((order[at], -bound[at]))][:top].tolist()

    def open_(bound, order, limit, known, contents):
        at = np.nonzero(bound > 0)[0]
        if limit is not None:
            score, last = limit
            before = len(order) if last is None else bisect_right(known, last)
            at = at[(bound[at] > score) | ((bound[at] == score) & (order[at] < before))]
        seen: Counter = Counter()
        for k in at[np.argsort(order[at])].tolist():
            seen[contents[k]] += 1
            if seen[contents[k]] <= top:
                yield k

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                width, ids, contents, sizes, most, bits = (batch.column(c)[i].as_py() for c in range(6))
                ranked = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))
                known = [ids[k] for k in ranked if ids[k] is not None]
                order = np.empty(len(ranked), dtype=np.int64)
                order[ranked] = np.arange(len(ranked))
                for numbers, hashes, weights, owners in items.value.chunks():
                    found = _bounds(width, sizes, most, bits, hashes, weights, owners, n_docs, n_terms)
                    rows = [(no, int(bound[k]), ids[k], contents[k], sizes[k]) for no, bound in zip(numbers, found) for k in (
                        leading(bound, order) if limits is None else open_(bound, order, limits.get(no), known, contents))]
                    if rows:
                        yield _record(rows, schema)

    return blocks.mapInArrow(run, schema)


def _first(df: DataFrame, by, order, top: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= top)


def _scored(chosen: DataFrame, docs: DataFrame, text_col: str, items, item_type: T.DataType, n_docs: int, n_terms: int) -> DataFrame:
    """(no, item, id, score) of the chosen (no, id, content, size) with a score above 0; each text is read once."""
    asks = written(chosen.groupBy("content").agg(F.max("size").alias("size"), F.collect_list(F.struct("no", "id")).alias("asks")), "asks")
    text = F.coalesce(F.col(text_col), F.lit(""))
    bodies = one_text_each(docs.select(_content(text).alias("content"), text.alias("text")), asks.select("content"))
    schema = fields(("no", T.IntegerType()), ("item", item_type), ("id", docs.schema["id"].dataType), ("score", T.LongType()))

    def run(batches):
        for whole in batches:
            for piece in slices(whole):
                rows = []
                for body, size, wanted in zip(*[piece.column(c).to_pylist() for c in range(3)]):
                    counts = Counter(terms(body))
                    m = 100 - B_SHARE + (B_SHARE * size * n_docs) // n_terms
                    gain = {t: 1_000_000_000 * n // (1000 * n + 8 * m) for t, n in counts.items()}
                    known: dict = {}
                    for ask in wanted:
                        no = ask["no"]
                        item, weights = items.value.asked[no]
                        if no not in known:
                            known[no] = sum(weights[t] * gain[t] for t in weights.keys() & gain.keys())
                        if known[no] > 0:
                            rows.append((no, item, ask["id"], known[no]))
                if rows:
                    yield _record(rows, schema)

    return written(asks.join(bodies, "content").select("text", "size", "asks").mapInArrow(run, schema), "scores")


def _asked(weights: DataFrame) -> list[tuple[object, dict[bytes, int]]]:
    """The items of a query block in a fixed order, each with the weights of its terms."""
    out: dict = {}
    for r in weights.collect():
        out.setdefault(r["item"], {})[bytes(r["term"])] = r["weight"]
    return [(item, dict(sorted(out[item].items()))) for item in sorted(out, key=lambda x: (x is None, x))]


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", top: int = TOP, query_terms: int = QUERY_TERMS,
           widest: int = WIDEST) -> DataFrame:
    """(item, rank, id, score): the `top` documents of the highest score above 0 for each item.

    Equal scores rank by id, NULL ids last. Repeated rows of a document are documents of their own;
    rows of one item id, NULL included, are one item with the terms of all. NULL, empty and term-less
    texts find nothing and are not found. Texts of any length are taken whole; other columns are
    ignored; empty tables give no rows. Items are asked in blocks of about `query_terms` terms. A
    signature has at most `widest` bits (a power of two): with fewer, more documents are scored.
    """
    spark, item_type = docs.sparkSession, items.schema[item_col].dataType
    index = build_index(docs, id_col, text_col, widest)
    blocks = index.filter(F.col("bits").isNotNull()).select("width", "ids", "contents", "sizes", "most", "bits")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long"), F.coalesce(F.sum(
        F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).cast("long")).first()
    seen = index.filter(F.col("term").isNotNull()).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.expr(f"cast(floor(1000 * ln((2 * {n_docs}L + 2) / (2 * df + 1))) as bigint)")
    weights = written(_item_terms(items, item_col, item_text).join(seen, "term").select("item", "term", weight.alias("weight"))
                      .filter(F.col("weight") > 0), "weights")
    n_parts = max(1, -(-weights.count() // query_terms))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_body"))
    by_id = F.col("id").asc_nulls_last()

    def best(scores: DataFrame) -> DataFrame:
        return _first(scores, ["no"], [F.col("score").desc(), by_id], top, "rank")

    results = []
    for part in range(n_parts):
        asked = _asked(weights.filter(F.pmod(F.xxhash64("item"), F.lit(n_parts)) == part))
        if not asked and (results or part + 1 < n_parts):
            continue
        sent = spark.sparkContext.broadcast(_Items(asked))
        total = max(n_terms, 1)

        def score(chosen):
            return _scored(chosen, own, "_body", sent, item_type, n_docs, total)

        leaders = score(_first(_bounded(blocks, sent, n_docs, total, top, None), ["no"], [F.col("bound").desc(), by_id], top, "n"))
        limits = {r["no"]: (r["score"], r["id"]) for r in best(leaders).filter(F.col("rank") == top).collect()}
        release(leaders)
        scores = score(_first(_bounded(blocks, sent, n_docs, total, top, limits), ["no", "content"], [by_id], top, "n"))
        results.append(best(scores).select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"),
                                           F.col("id").alias(id_col), "score"))
    release(index, weights)
    return reduce(DataFrame.unionByName, results)
