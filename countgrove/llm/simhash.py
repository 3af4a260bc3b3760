"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Fingerprints are routed by a vantage-point tree whose levels look at disjoint bands of bits:
a level holds one vantage point and one radius, and a fingerprint goes left or right by its
Hamming distance to the vantage inside that band. Distances of disjoint bands add up, so the
triangle inequality bounds the cost of every side a neighbour could have taken, and the costs
of several levels share the one search radius. A fingerprint is at home in one leaf and is
sent as a query to the later leaves whose boundary it overlaps. Leaves that a dense cluster
fills beyond the bound are split again, each by a vantage point and radii of its own; what
still exceeds it is cut into parts of homes that meet parts of queries. Inside a task a further
tree prunes before pairs are compared exactly.

Tasks have a bounded size at any number of fingerprints and any density; copies of a query grow
with the square of the number of levels, that is of the logarithm of the table. Vantage points
and radii come from aggregates over all fingerprints; of them the driver sees those of the first
tree only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import release, written
from .common import fields, map_batches
from .components import components

BITS = 64
LEAF = 20000       # fingerprints at home in a leaf, about; twice as many at most
LEAST_LEVELS = 2   # of the first tree, however small the table
SPLIT_LEVELS = 4   # of the tree of one leaf beyond the bound
SPLITS = 3         # times that leaves are split before they are cut into parts
BLOCK = 1 << 18    # pairs compared at once inside a leaf
CHUNK = 1 << 15    # shingles hashed at once of a very long text


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of one text: a bit is set if over half of the shingle hashes set it.

    Words are runs without ASCII white space, A-Z lower-cased; repeated shingles count
    again, a text of fewer words is one shingle, and NULL or no words give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(BITS, dtype=np.int64)
    hashed = xxhash.xxh64_intdigest
    for start in range(0, n, CHUNK):
        part = words[start:min(start + CHUNK, n) + width - 1]
        shingles = zip(*[part[i:] for i in range(width)]) if len(words) >= width else [tuple(words)]
        h = np.fromiter((hashed(b" ".join(s), 42) for s in shingles), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; `fp` holds the 64 bits as a signed number."""
    def work(ids, texts):
        bits = np.array([fingerprint(t, width) for t in texts], dtype=np.uint64)
        return ids, bits.view(np.int64)

    return map_batches(docs, [id_col, text_col], fields(
        (id_col, docs.schema[id_col].dataType), ("fp", T.LongType())), work)


# --- routing between leaves ---------------------------------------------------------------

def _bands(levels: int) -> list[int]:
    """Bit masks of `levels` disjoint bands that cover the fingerprint."""
    edges = [BITS * i // levels for i in range(levels + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _distance(mask: int, vantage: Column) -> Column:
    return F.bit_count((F.col("fp").bitwiseXOR(vantage)).bitwiseAND(F.lit(_signed(mask))))


def _radii(masks: list[int], vantage: Column) -> list[Column]:
    """Per band the radius that comes nearest to halving the fingerprints, as aggregates."""
    def gap(mask, r):
        return F.abs(2 * F.sum((_distance(mask, vantage) <= r).cast("long")) - F.count(F.lit(1)))

    return [F.array_min(F.array(*[F.struct(gap(m, r).alias("gap"), F.lit(r).alias("r"))
                                  for r in range(m.bit_count())]))["r"] for m in masks]


def _placed(rows: DataFrame, masks: list[int], vantage: Column, radii: list[Column], radius: int) -> DataFrame:
    """`rows` (fp, home, ...) with `_to`, one row per leaf of a tree; `home` stays true at one of them.

    A row at home goes to its leaf and, as a query, to the later leaves in reach; a row that is a
    query already goes to all leaves in reach.
    """
    side, cost = [], []
    for i, (mask, r) in enumerate(zip(masks, radii, strict=True)):
        d = _distance(mask, vantage)
        side.append(F.when(d > r, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
        cost.append(F.when(d > r, d - r).otherwise(r + 1 - d))
    own = side[0]
    for s in side[1:]:
        own = own.bitwiseOR(s)
    base = rows.select(*rows.columns, own.alias("_own"), F.array(*[
        F.struct(F.lit(1 << i).cast("long").alias("bit"), c.cast("int").alias("cost"))
        for i, c in enumerate(cost)]).alias("_flips"))
    reach = F.array(F.struct(F.lit(0).cast("long").alias("bit"), F.lit(0).alias("cost")))

    def further(taken):
        """The reach of one more level on its other side, in increasing order of levels."""
        fits = F.filter("_flips", lambda f: (f["bit"] > taken["bit"]) & (f["cost"] + taken["cost"] <= radius))
        return F.transform(fits, lambda f: F.struct(f["bit"].bitwiseOR(taken["bit"]).alias("bit"),
                                                    (f["cost"] + taken["cost"]).alias("cost")))

    for _ in range(radius):
        reach = F.array_distinct(F.concat(reach, F.flatten(F.transform(reach, further))))
    leaves = F.filter(F.transform(reach, lambda s: F.col("_own").bitwiseXOR(s["bit"])),
                      lambda x: ~F.col("home") | (x >= F.col("_own")))
    return (base.withColumn("_to", F.explode(leaves))
            .withColumn("home", F.col("home") & (F.col("_to") == F.col("_own"))).drop("_own", "_flips"))


def _routed(distinct: DataFrame, radius: int, leaf: int) -> DataFrame:
    """(leaf, fp, home): the home leaf of each fingerprint and the later leaves in reach, by one tree over all."""
    n = distinct.count()
    rows = distinct.select("fp", F.lit(True).alias("home"))
    if not n:
        return rows.select(F.lit(0).cast("long").alias("leaf"), "fp", "home")
    levels = min(BITS // 2, max(LEAST_LEVELS, int(np.ceil(np.log2(n / leaf)))))
    masks = _bands(levels)
    vantage = F.lit(distinct.agg(F.min_by("fp", F.struct(F.xxhash64("fp"), "fp"))).first()[0])
    radii = [F.lit(r) for r in distinct.agg(*_radii(masks, vantage)).first()]
    return _placed(rows, masks, vantage, radii, radius).select(F.col("_to").alias("leaf"), "fp", "home")


def _split(routed: DataFrame, over: DataFrame, radius: int, turn: int) -> DataFrame:
    """`routed` with the leaves of `over` each split by a tree of its own; other leaves stay.

    Leaves have hashed names: two of one name would only be searched together.
    """
    masks = _bands(SPLIT_LEVELS)
    big = routed.join(over, "leaf", "left_semi")
    chosen = big.filter("home").groupBy("leaf").agg(
        F.min_by("fp", F.struct(F.xxhash64(F.lit(turn), "fp"), "fp")).alias("_vantage"))
    names = [f"_r{i}" for i in range(SPLIT_LEVELS)]
    trees = big.filter("home").join(chosen, "leaf").groupBy("leaf", "_vantage").agg(
        *[r.alias(name) for r, name in zip(_radii(masks, F.col("_vantage")), names, strict=True)])
    own = _placed(big.join(trees, "leaf"), masks, F.col("_vantage"), [F.col(name) for name in names], radius)
    return routed.join(over, "leaf", "left_anti").unionByName(
        own.select(F.xxhash64(F.lit(turn), "leaf", "_to").alias("leaf"), "fp", "home"))


def _dealt(routed: DataFrame, bound: int) -> DataFrame:
    """(leaf, _h, _q, fp, home, ask): tasks of at most about `bound` homes and 4 x `bound` queries.

    Every row of a leaf is a query there. Homes and queries of a leaf are cut into parts; a home
    goes to its part of homes against every part of queries, a query to its part of queries against
    every part of homes, so each two meet once and a row lists its own line of parts only.
    """
    sizes = routed.groupBy("leaf").agg(F.ceil(F.count_if("home") / bound).alias("_nh"),
                                       F.ceil(F.count(F.lit(1)) / (4 * bound)).alias("_nq"))
    rows = routed.join(sizes.filter("_nh > 0"), "leaf")
    part_h = F.pmod(F.xxhash64(F.lit("home"), "fp"), F.col("_nh"))
    part_q = F.pmod(F.xxhash64(F.lit("query"), "fp"), F.col("_nq"))
    parts = rows.select("leaf", "fp", "home", part_h.alias("_ph"), part_q.alias("_pq"), "_nh", "_nq")
    whole = parts.filter("_nh = 1 AND _nq = 1").select(
        "leaf", F.lit(0).cast("long").alias("_h"), F.lit(0).cast("long").alias("_q"), "fp", "home", F.lit(True).alias("ask"))
    cut = parts.filter("_nh > 1 OR _nq > 1")
    zero = F.lit(0).cast("long")
    homes = cut.filter("home").select("leaf", F.col("_ph").alias("_h"), F.explode(F.sequence(zero, F.col("_nq") - 1)).alias("_q"),
                                      "fp", F.lit(True).alias("home"), F.lit(False).alias("ask"))
    queries = cut.select("leaf", F.explode(F.sequence(zero, F.col("_nh") - 1)).alias("_h"), F.col("_pq").alias("_q"),
                         "fp", F.lit(False).alias("home"), F.lit(True).alias("ask"))
    return whole.unionByName(homes).unionByName(queries)


# --- search inside a leaf -----------------------------------------------------------------

def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _near(fps, homes, queries, left, radius, depth=0):
    """Index pairs (query, home) within the radius, by a tree over bands of eight bits.

    `left` is the part of the radius that the bands above have not used up.
    """
    if homes.size == 0 or queries.size == 0:
        return
    if depth == BITS // 8 or homes.size * queries.size <= BLOCK:
        step = max(1, BLOCK // homes.size)
        for s in range(0, queries.size, step):
            q = queries[s:s + step]
            hit = np.bitwise_count(fps[q][:, None] ^ fps[homes][None, :]) <= radius
            i, j = np.nonzero(hit)
            yield q[i], homes[j]
        return
    mask = np.uint64(255 << (8 * depth))
    vantage = fps[homes[homes.size // 2]]
    dh = _popcount((fps[homes] ^ vantage) & mask)
    dq = _popcount((fps[queries] ^ vantage) & mask)
    for d in np.unique(dh):
        need = np.abs(dq - d)
        inside = need <= left
        yield from _near(fps, homes[dh == d], queries[inside], left[inside] - need[inside], radius, depth + 1)


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of index pairs into `parent`, whose entries point at the smallest member."""
    while a.size:
        a, b = parent[a], parent[b]
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _leaf_links(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(pdf["fp"].to_numpy(), kind="stable")
        signed = pdf["fp"].to_numpy()[order]
        fps = signed.view(np.uint64)
        homes = np.nonzero(pdf["home"].to_numpy()[order])[0]
        asking = np.nonzero(pdf["ask"].to_numpy()[order])[0]
        parent = np.arange(len(fps))
        left = np.full(asking.size, radius, dtype=np.int16)
        waiting, held = [], 0
        for q, h in _near(fps, homes, asking, left, radius):
            waiting.append((q, h))
            held += q.size
            if held > 1 << 20:
                parent = merge(parent, *map(np.concatenate, zip(*waiting)))
                waiting, held = [], 0
        if waiting:
            parent = merge(parent, *map(np.concatenate, zip(*waiting)))
        linked = parent != np.arange(len(fps))
        return pd.DataFrame({"u": signed[linked], "v": signed[parent[linked]]})

    return run


def links(distinct: DataFrame, radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """(u, v) links that connect all fingerprints within `radius` bits of each other.

    `distinct` has one row per fingerprint `fp`. Each task returns a star per group found in
    it, so the table is no longer than the routed one however dense the groups are. Tasks hold
    about 2 x `leaf` homes at most.
    """
    bound = 2 * leaf
    routed = written(_routed(distinct, radius, leaf), "routed")
    for turn in range(SPLITS):
        over = written(routed.filter("home").groupBy("leaf").count().filter(F.col("count") > bound).select("leaf"), "over")
        if over.isEmpty():
            release(over)
            break
        last, routed = routed, written(_split(routed, over, radius, turn), "routed")
        release(last, over)
    return _dealt(routed, bound).groupBy("leaf", "_h", "_q").applyInPandas(_leaf_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """(id, fingerprint, component_id): classes of documents whose fingerprints link up.

    Fingerprints link at `radius` or fewer differing bits. Documents with one fingerprint are
    collapsed before the search, whatever their number. `component_id` is the smallest id
    reachable. NULL and empty texts have the fingerprint zero and link like any other; rows
    with a NULL id take part and get the class of the others (NULL in a class without ids);
    repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fps")
    distinct = written(fps.groupBy("fp").agg(F.min(id_col).alias("_first")), "distinct")
    roots = components(links(distinct, radius, leaf))
    rooted = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "_first", F.coalesce("root", "fp").alias("_root")))
    classes = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.join(classes, "_root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
               radius: int = 2, leaf: int = LEAF) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id.

    Rows that repeat an id are one document, of which one row stays. Rows without an id cannot
    be told apart and stay. The columns of `docs` are kept as they are.
    """
    classes = near_duplicates(docs, id_col, text_col, width, radius, leaf)
    first = classes.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept_id")).distinct()
    kept = docs.join(first, docs[id_col] == F.col("_kept_id"), "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
