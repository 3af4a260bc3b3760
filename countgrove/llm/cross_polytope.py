"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations.

A hash function flips signs and applies a fast Hadamard transform, three times; its value is
the axis of the largest coordinate with its sign, that is the nearest vertex of the cross
polytope. A table joins several functions into one bucket key. A vector is stored in its home
bucket of every table and asks there and in the next best buckets (multiprobe: the cheapest
replacements of one or two functions by their runner-up vertices). Candidates are verified by
cosine in double precision, and a pair counts in the first table in which it meets.

Equal vectors are collapsed first. A bucket with more than CHUNK stored vectors is cut into
chunks, and every question goes to all chunks, so no bucket has to fit into one task and no
pair is lost. Links are counted and merged inside the task; pairs are not written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import written
from .common import append_batches, fields
from .components import components
from .simhash import merge

TABLES = 4
PROBES = 4           # buckets asked in each table, the home bucket included
RUNNERS_UP = 3       # vertices after the nearest that a probe may use
CHUNK = 1024         # stored vectors of a bucket in one task
BIN = 4096           # rows of small buckets handled together
PER_BUCKET = 64      # vectors of a label per bucket of a table, about; sets the number of functions


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two.

    Sums run in a fixed order per row, so a vector has the same code in any batch.
    """
    half = 1
    while half < x.shape[1]:
        parts = x.reshape(len(x), -1, 2, half)
        x = np.stack([parts[:, :, 0] + parts[:, :, 1], parts[:, :, 0] - parts[:, :, 1]], axis=2).reshape(len(x), -1)
        half *= 2
    return x


def bucket_keys(x: np.ndarray, table: int, functions: int, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """(rows, probes) bucket keys of one table, the home bucket first, then by rising cost."""
    n, width = x.shape
    size = 1 << max(1, (width - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :width] = x
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (functions, 3, size))
    vertex, loss = [], []
    for k in range(functions):
        y = padded
        for flips in signs[k]:
            y = hadamard(y * flips)
        best = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :RUNNERS_UP + 1]
        value = np.take_along_axis(y, best, axis=1)
        vertex.append(best * 2 + (value < 0))
        strength = np.abs(value)
        loss.append((strength[:, :1] - strength) / np.maximum(strength[:, :1], 1e-300))
    home = np.stack([v[:, 0] for v in vertex], axis=1)
    others, costs = [], []

    def replaced(*changes):
        key = home.copy()
        for k, i in changes:
            key[:, k] = vertex[k][:, i]
        others.append(key)
        costs.append(sum(loss[k][:, i] for k, i in changes))

    places = range(1, min(RUNNERS_UP + 1, size))
    for k in range(functions):
        for i in places:
            replaced((k, i))
        for j in range(k):
            replaced((j, 1), (k, 1))
    order = np.argsort(np.stack(costs, axis=1), axis=1, kind="stable")[:, :probes - 1]
    keys = np.concatenate([home[:, None], np.stack(others, axis=1)[np.arange(n)[:, None], order]], axis=1)
    base = (2 * size) ** np.arange(functions, dtype=np.int64)
    return (keys * base).sum(axis=2)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=float)
    x = x / np.abs(x).max(axis=1, keepdims=True)   # keeps squares finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _units(vectors: list) -> list[np.ndarray]:
    """Unit vectors of rows that may differ in length."""
    out: list = [None] * len(vectors)
    for d in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == d]
        for i, row in zip(at, _unit([vectors[i] for i in at])):
            out[i] = row
    return out


def _with_keys(reps: DataFrame, tables: int, functions: int, probes: int) -> DataFrame:
    """Adds `_keys`, the bucket keys of all tables one after the other."""
    def work(vectors):
        out: list = [None] * len(vectors)
        for d in {len(v) for v in vectors}:
            at = [i for i, v in enumerate(vectors) if len(v) == d]
            x = _unit([vectors[i] for i in at])
            keys = np.concatenate([bucket_keys(x, t, functions, probes) for t in range(tables)], axis=1)
            for i, line in zip(at, keys.tolist()):
                out[i] = line
        return [out]

    return append_batches(reps, ["_vector"], fields(("_keys", T.ArrayType(T.LongType()))), work)


def _bin_links(threshold: float, probes: int):
    """Buckets of one bin: links between stored vectors and the vectors that ask for them.

    Returns stars (n = 0) that connect what was found and the number of new links per node.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        node, copies = pdf["_node"].to_numpy(), pdf["_copies"].to_numpy()
        stored = pdf["_stored"].to_numpy()
        same, place = np.unique(node, return_inverse=True)
        first = np.unique(place, return_index=True)[1]
        asks = pdf["_asks"].to_numpy()
        unit = _units([pdf["_vector"].iat[i] for i in first])
        codes = np.array([pdf["_keys"].iat[i] for i in first]).reshape(len(same), -1, probes)
        parent, links = np.arange(len(same)), np.zeros(len(same), dtype=np.int64)
        groups = pdf.groupby(["_label", "_length", "_table", "_key", "_stored_part", "_ask_part"], sort=False)
        for (_, _, table, *_), rows in groups.indices.items():
            held, asking = rows[stored[rows]], rows[asks[rows]]
            if not len(held) or not len(asking):
                continue
            own = np.stack([unit[k] for k in place[held]])
            for s in range(0, len(asking), CHUNK):
                part = asking[s:s + CHUNK]
                i, j = np.nonzero(np.stack([unit[k] for k in place[part]]) @ own.T >= threshold)
                a, b = part[i], held[j]
                apart = node[a] != node[b]
                a, b = a[apart], b[apart]
                if not len(a):
                    continue
                parent = merge(parent, place[a], place[b])
                p, q = place[a], place[b]
                new = np.ones(len(a), dtype=bool)
                for t in range(table):
                    new &= ~_meet(codes[:, t], p, q)
                # b's home is asked by a; where a's home is also asked by b, the smaller node counts
                back = (codes[q, table] == codes[p, table, :1]).any(axis=1)
                new &= ~back | (node[a] < node[b])
                np.add.at(links, p[new], copies[b[new]])
                np.add.at(links, q[new], copies[a[new]])
        joined, counted = np.nonzero(parent != np.arange(len(same)))[0], np.nonzero(links)[0]
        return pd.DataFrame({
            "u": np.concatenate([same[joined], same[counted]]),
            "v": np.concatenate([same[parent[joined]], same[counted]]),
            "n": np.concatenate([np.zeros(len(joined), dtype=np.int64), links[counted]])})

    return run


def _meet(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """True for pairs of which one asks the home bucket of the other."""
    return (keys[a] == keys[b, :1]).any(axis=1) | (keys[b] == keys[a, :1]).any(axis=1)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = 0.98, tables: int = TABLES,
                    probes: int = PROBES, functions: int | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors are compared only with equal, non-NULL labels and equal lengths, and link at a
    cosine of `threshold` or more. A vector that is NULL, zero, empty, or holds a NULL or a
    non-finite component links with nothing: it has no links and is its own component. Equal
    vectors of a label link with each other and each counts as a link of the others; rows that
    repeat an id count as vectors. Different vectors with one id are one node. A NULL id takes part but
    names no component. `functions` defaults to as many as keep about PER_BUCKET vectors of
    the largest label in a bucket. An empty table gives no rows; other columns are ignored.
    """
    number = F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 equals 0.0
    sound = (F.col(label_col).isNotNull() & (F.size(vector_col) > 0)
             & F.coalesce(F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x)
                                   & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
             & F.coalesce(F.exists(vector_col, lambda x: x != 0), F.lit(False)))
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"),
                          F.when(sound, number).alias("_vector"))
    # the row number is part of the written table, so it names a distinct vector from here on
    reps = written(rows.filter(F.col("_vector").isNotNull()).groupBy("_label", "_vector").agg(
        F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"))
        .withColumn("_node", F.monotonically_increasing_id()), "vectors")
    if functions is None:
        most = reps.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vector")).alias("d")).agg(
            F.max("n"), F.max("d")).first()
        functions = max(2, int(np.ceil(np.log(max(most[0] or 1, 2) / PER_BUCKET) / np.log(2 * max(most[1] or 2, 2)))))
    keyed = written(_with_keys(reps, tables, functions, probes), "keys")
    found = written(_pairs(keyed, threshold, probes), "pairs")
    counts = found.groupBy("u").agg(F.sum("n").alias("_linked"))
    rooted = (reps.join(components(found), F.col("_node") == F.col("node"), "left")
              .withColumn("_root", F.coalesce("root", "_node")))
    names = rooted.groupBy("_root").agg(F.min("_rep").alias("component_id"))
    classes = (rooted.join(counts, rooted["_node"] == counts["u"], "left").join(names, "_root")
               .select(F.col("_label").alias("_l"), F.col("_vector").alias("_v"), "component_id",
                       (F.coalesce("_linked", F.lit(0)) + F.col("_copies") - 1).alias("n_links")))
    return (rows.join(classes, (F.col("_label") == F.col("_l")) & (F.col("_vector") == F.col("_v")), "left")
            .select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False))))


def _pairs(keyed: DataFrame, threshold: float, probes: int) -> DataFrame:
    """(u, v, n) of all buckets in which somebody asks for a stored vector.

    A bucket with many rows is cut into parts on both sides, and every part of stored vectors
    meets every part of asking ones. Buckets are dealt to bins of about BIN rows, so that a
    task handles many small buckets at a time.
    """
    spots = F.transform("_keys", lambda key, i: F.struct(
        (i / probes).cast("int").alias("table"), key.alias("key"), (i % probes == 0).alias("stored")))
    asked = keyed.select("_label", F.size("_vector").alias("_length"), "_node", F.explode(spots).alias("_spot")).select(
        "_label", "_length", "_node", F.col("_spot.table").alias("_table"), F.col("_spot.key").alias("_key"),
        F.col("_spot.stored").alias("_home"))
    bucket = ["_label", "_length", "_table", "_key"]
    busy = (asked.groupBy(*bucket).agg(F.count_if("_home").alias("_n_stored"), F.count(F.lit(1)).alias("_n_asking"))
            .filter((F.col("_n_stored") > 0) & (F.col("_n_asking") > 1)))
    parted = (asked.join(busy, bucket)
              .withColumn("_sp", F.ceil(F.col("_n_stored") / CHUNK).cast("int"))
              .withColumn("_ap", F.ceil(F.col("_n_asking") / (4 * CHUNK)).cast("int"))
              .withColumn("_h", F.xxhash64("_node")))
    own_s, own_a = F.pmod("_h", F.col("_sp")).cast("int"), F.pmod(F.shiftright("_h", 20), F.col("_ap")).cast("int")
    # only the own row and column of the grid of parts: one struct per part, not per pair of parts
    asks = F.transform(F.sequence(F.lit(0), F.col("_sp") - 1), lambda s: F.struct(s.alias("s"), own_a.alias("a")))
    holds = F.transform(F.filter(F.sequence(F.lit(0), F.col("_ap") - 1), lambda a: a != own_a),
                        lambda a: F.struct(own_s.alias("s"), a.alias("a")))
    met = F.when(F.col("_home"), F.concat(asks, holds)).otherwise(asks)
    placed = parted.withColumn("_c", F.explode(met)).select(
        *bucket, "_node", F.col("_c.s").alias("_stored_part"), F.col("_c.a").alias("_ask_part"),
        (F.col("_home") & (F.col("_c.s") == own_s)).alias("_stored"),
        (F.col("_c.a") == own_a).alias("_asks"))
    placed = written(placed, "spots")
    bins = max(1, placed.count() // BIN)
    parts = [*bucket, "_stored_part", "_ask_part"]
    full = placed.withColumn("_bin", F.pmod(F.xxhash64(*parts), F.lit(bins))).join(
        keyed.select("_node", "_copies", "_vector", "_keys"), "_node")
    return full.groupBy("_bin").applyInPandas(_bin_links(threshold, probes), fields(
        ("u", T.LongType()), ("v", T.LongType()), ("n", T.LongType())))
