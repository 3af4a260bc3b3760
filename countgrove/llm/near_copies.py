"""Near-copies of texts: SimHash fingerprints, and Jaccard similarity of sets of word shingles, verified exactly.

`keep_first` links texts by either. The fingerprints are those of `simhash`, searched by its trees; the rest
of this module finds the pairs that share most of their shingles, which fingerprints alone miss.

Texts with one set of shingles are collapsed. Sets are compared if they agree in a band of minimum
hashes; a pair at the threshold shares none of the BANDS bands with a probability of 3e-6, a closer
pair with less. No candidate is accepted unverified. Sets that share a band value form a family, known
by its smallest member. First every member is compared with that one, which joins dense families in
one pass; families that are still in parts are then cut into chunks and compared chunk by chunk, but
only members of different parts. Comparisons stay inside the tasks and return links that join parts,
so no table of pairs is made. Texts move to the families, not their shingles, which take more room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import release, written
from . import simhash
from .common import digest_of, fields, free_name, map_batches, one_text_each
from .components import components

WIDTH = 5
SIMILAR = (4, 5)       # least shared part of the shingles of two texts, as a fraction
BANDS, ROWS = 32, 5    # 1 - (1 - 0.8^5)^32 = 0.999997 of the pairs at 0.8 meet
CHUNK = 512            # shingles whose minimum hashes are taken at once
FAMILY = 1 << 20       # shingles of a chunk of a family, about
SLAB = 512             # members compared with the others at once
COLUMNS = 2048         # shingles counted at once

_RANDOM = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_FACTOR, _SHIFT = 2 * _RANDOM[0] + 1, _RANDOM[1]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words and short texts as in `simhash.fingerprint`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    parts = zip(*[words[i:] for i in range(width)]) if len(words) >= width else [tuple(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in parts), dtype=np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """Hashes of the BANDS groups of minimum hashes of a set; none of an empty set."""
    if not found.size:
        return []
    low = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for s in range(0, found.size, CHUNK):
        low = np.minimum(low, (found[s:s + CHUNK, None] * _FACTOR + _SHIFT).min(axis=0))
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(low.reshape(BANDS, ROWS))]


def _similar(shared, a, b):
    num, den = SIMILAR
    return (num + den) * shared >= num * (a + b)


def _against_lead(sets: list[np.ndarray], lead: int) -> np.ndarray:
    """Whether each set is similar to the lead's."""
    own = sets[lead]
    shared = np.array([np.isin(s, own, assume_unique=True).sum() for s in sets])
    return _similar(shared, np.array([s.size for s in sets]), own.size)


def _joining_links(sets: list[np.ndarray], part: np.ndarray, side: np.ndarray | None):
    """Index pairs of similar sets that join parts; between the two sides only, where sides are given.

    Members of the largest part are not compared with each other.
    """
    sizes = np.array([s.size for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = times[code] > 1
    order = np.argsort(code[held], kind="stable")
    owner, code = owner[held][order], np.unique(code[held][order], return_inverse=True)[1]
    edges = np.searchsorted(code, np.arange(0, (code[-1] if code.size else 0) + COLUMNS + 1, COLUMNS))
    labels, part = np.unique(part, return_inverse=True)
    root = np.arange(len(labels))
    small = np.nonzero(part != np.bincount(part).argmax())[0]
    for start in range(0, small.size, SLAB):
        some = small[start:start + SLAB]
        place = np.full(len(sets), -1)
        place[some] = np.arange(some.size)
        shared = np.zeros((some.size, len(sets)), dtype=np.float32)
        for k in range(len(edges) - 1):
            at = slice(edges[k], edges[k + 1])
            every = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            every[owner[at], code[at] - k * COLUMNS] = 1
            shared += every[some] @ every.T
        alike = _similar(shared.astype(np.int64), sizes[some][:, None], sizes[None, :])
        if side is not None:
            alike &= side[some][:, None] != side[None, :]
        for i, j in zip(*np.nonzero(alike)):
            u, v = int(some[i]), int(j)
            a, b = part[u], part[v]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                yield u, v


_LINKS = fields(("u", T.LongType()), ("v", T.LongType()))
_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links(nodes: DataFrame, texts_of, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """(u, v) links that connect all similar sets, and the tables they are read from.

    `texts_of` gives (node, text) of a written table of nodes.
    """
    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    low = (keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
           .filter(F.col("low") < F.col("high")).select("key", "low"))
    members = written(keyed.join(low, "key").groupBy("low", "node").agg(F.first("n").alias("n")), "members")
    bodies = written(texts_of(written(members.select("node").distinct(), "wanted")), "bodies")

    def chunked(table: DataFrame) -> DataFrame:
        cut = table.groupBy("low").agg(F.ceil(F.sum("n") / FAMILY).cast("int").alias("chunks"))
        return table.join(cut, "low").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))

    def with_lead(table: pa.Table) -> pa.Table:
        nodes_, lead = table["node"].to_pylist(), table["low"][0].as_py()
        alike = _against_lead([shingles(t, width) for t in table["text"].to_pylist()], nodes_.index(lead))
        hit = [n for n, a in zip(nodes_, alike) if a and n != lead]
        return pa.table([[lead] * len(hit), hit], schema=_ARROW)

    first = chunked(members)
    leads = first.filter(F.col("node") == F.col("low")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("other <> chunk")
    rows = first.select("low", "chunk", "node").unionByName(leads.select("low", F.col("other").alias("chunk"), "node"))
    found = written(rows.join(bodies, "node").groupBy("low", "chunk").applyInArrow(with_lead, _LINKS), "links")

    roots = components(found).withColumnRenamed("node", "_n")
    placed = members.join(roots, F.col("node") == F.col("_n"), "left").select(
        "low", "node", "n", F.coalesce("root", "node").alias("part"))
    apart = placed.groupBy("low").agg(F.min("part").alias("_p"), F.max("part").alias("_q")).filter("_p < _q").select("low")
    rest = written(chunked(placed.join(apart, "low")), "apart")
    pairs = rest.select("low", "node", "part", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "low", "node", "part", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def by_chunks(table: pa.Table) -> pa.Table:
        part = np.array(table["part"].to_pylist(), dtype=np.int64)
        if (part == part[0]).all():
            return _ARROW.empty_table()
        sets = [shingles(t, width) for t in table["text"].to_pylist()]
        side = None if table["i"][0].as_py() == table["j"][0].as_py() else np.array(table["chunk"].to_pylist())
        nodes_ = table["node"].to_pylist()
        hit = list(_joining_links(sets, part, side))
        return pa.table([[nodes_[u] for u, _ in hit], [nodes_[v] for _, v in hit]], schema=_ARROW)

    more = written(pairs.join(bodies, "node").groupBy("low", "i", "j").applyInArrow(by_chunks, _LINKS), "links")
    release(members, bodies, rest)
    return found.unionByName(more), [found, more]


def _fingerprint_links(table: DataFrame, radius: int) -> DataFrame:
    """Written (u, v) links between nodes whose texts have fingerprints within `radius` bits.

    `table` holds (node, fp). Nodes of one fingerprint link to its smallest, and those of linked fingerprints among
    each other; a node whose texts differ in fingerprint connects them too.
    """
    held = written(table.select("node", "fp").distinct(), "fingerprints")
    least = written(held.groupBy("fp").agg(F.min("node").alias("least")), "least")
    alike = simhash.links(least.select("fp"), radius)
    ends = [least.select(F.col("fp").alias(k), F.col("least").alias(n)) for k, n in (("u", "_u"), ("v", "_v"))]
    across = alike.join(ends[0], "u").join(ends[1], "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    inside = held.join(least, "fp").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    found = written(inside.unionByName(across), "links")
    release(held, least)
    return found


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
               radius: int | None = None) -> DataFrame:
    """One document of each class of near-copies: that of the smallest id.

    Texts link if the Jaccard similarity of their sets of `width`-word shingles is SIMILAR or more, and with a
    `radius` also if their fingerprints of `simhash` differ in no more bits than that; classes are the connected
    components of all links. NULL and empty texts are copies of each other. Rows
    that repeat an id are one document, of which one row stays. Rows without an id take part and
    stay, since they cannot be told apart. The columns of `docs` are kept as they are.
    """
    own, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def work(ids, contents, texts):
        found = [shingles(t, width) for t in texts]
        keys = [xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63) for s in found]
        marks = [0 if radius is None else simhash.fingerprint(t) for t in texts]
        return ids, contents, keys, [s.size for s in found], [bands(s) for s in found], np.array(marks, dtype=np.uint64).view(np.int64)

    rows = docs.select(own.alias("id"), digest_of(text).alias("content"), text.alias("text"))
    table = map_batches(rows, ["id", "content", "text"], fields(
        ("id", docs.schema[id_col].dataType), ("content", T.BinaryType()), ("node", T.LongType()), ("n", T.LongType()),
        ("bands", T.ArrayType(T.LongType())), ("fp", T.LongType())), work)
    if radius is not None:
        table = written(table, "marked")
    nodes = written(table.groupBy("node").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("content").alias("content"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "content"))).alias("first")), "nodes")

    def texts_of(wanted: DataFrame) -> DataFrame:
        at = written(nodes.join(wanted, "node", "left_semi").select("content", "node"), "contents")
        return one_text_each(rows.select("content", "text"), at.select("content")).join(at, "content").select("node", "text")

    links, used = _links(nodes, texts_of, width)
    if radius is not None:
        marked = _fingerprint_links(table, radius)
        links, used = links.unionByName(marked), [*used, marked, table]
    roots = components(links).withColumnRenamed("node", "_n")
    classes = (nodes.join(roots, F.col("node") == F.col("_n"), "left")
               .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")))
    kept = written(classes.filter(F.col("first").isNotNull()).groupBy(F.col("first.id").alias("_kept_id"))
                   .agg(F.min("first.content").alias("_kept_content")), "kept")
    release(nodes, *used)
    content = free_name(docs, "content")
    known = docs.filter(own.isNotNull()).withColumn(content, digest_of(text)).dropDuplicates([id_col, content])
    stays = known.join(kept, (own == F.col("_kept_id")) & (F.col(content) == F.col("_kept_content")), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return stays.select(*columns).unionByName(docs.filter(own.isNull()).select(*columns))
