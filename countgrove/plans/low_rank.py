"""Largest singular triplets of a sparse matrix whose rows and columns both stay on Spark.

Where one side has NARROW keys at most, the lines of the other side are reduced as they are: one pass
gives their triangle, whose singular vectors are those of the narrow side, and a second one the vectors
of the long side. No rounds are needed, however close the values are.

Else randomised subspace iteration: a block of random directions is multiplied by the matrix and its
transpose in turn until its singular values settle. A product is a join of the cells with the block
and a sum of vectors, combined map-side. A tall block is made orthonormal by a QR tree: every task
reduces its rows to one small triangle, triangles are merged by groups, and the last one, block by
block wide, is all that the driver sees.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import row_index
from .scratch import release, written

NARROW = 512      # keys of the shorter side up to which the lines of the longer one are reduced directly
LINES = 2048      # lines made dense at once
FAN = 64          # triangles merged at once
SETTLED = 1e-10   # relative change of the wanted singular values at which iteration ends
ROUNDS = 200      # rounds after which it ends anyway
NOISE = 1e-12     # singular values of a block below this share of its largest count as 0


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("b")]


def _triangle(block: DataFrame) -> np.ndarray:
    """R of the QR of a tall block, by a tree over the tasks."""
    cols = _columns(block)
    width = len(cols)

    def reduce_rows(batches):
        r = np.zeros((0, width))
        for pdf in batches:
            r = np.linalg.qr(np.vstack([r, pdf.to_numpy(float)]), mode="r")
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    return _merged(block.select(*cols).mapInPandas(reduce_rows, "r binary"), width)


def _merged(triangles: DataFrame, width: int) -> np.ndarray:
    """One triangle of those of the tasks."""
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = np.vstack([np.frombuffer(r).reshape(-1, width) for r in pdf["r"]])
        return pd.DataFrame({"r": [np.linalg.qr(stacked, mode="r").tobytes()]})

    parts = written(triangles, "triangles")
    while (n := parts.count()) > FAN:
        last = parts
        grouped = last.withColumn("g", F.pmod(F.xxhash64("r"), F.lit(-(-n // FAN))))
        parts = written(grouped.groupBy("g").applyInPandas(merge, "r binary"), "triangles")
        release(last)
    rows = [np.frombuffer(r["r"]).reshape(-1, width) for r in parts.collect()]
    release(parts)
    return np.linalg.qr(np.vstack([np.zeros((1, width)), *rows]), mode="r")


def _turned(block: DataFrame, key: str, by: np.ndarray) -> DataFrame:
    """The block times a small matrix; the key is kept."""
    cols = _columns(block)
    schema = T.StructType([block.schema[key]] + [T.StructField(f"b{i}", T.DoubleType()) for i in range(by.shape[1])])

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame(pdf[cols].to_numpy(float) @ by, columns=[f"b{i}" for i in range(by.shape[1])])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    return block.select(key, *cols).mapInPandas(run, schema)


def _basis(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of a block with triangle r, and the matrix that makes the block orthonormal."""
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    held = s > NOISE * max(s[0], np.finfo(float).tiny)
    return s[held], vt[held].T / s[held]


def _orthonormal(block: DataFrame, key: str) -> DataFrame:
    """Written orthonormal basis of the block; a second pass removes what rounding left of the first."""
    rough = written(_turned(block, key, _basis(_triangle(block))[1]), "basis")
    fine = written(_turned(rough, key, _basis(_triangle(rough))[1]), "basis")
    release(rough)
    return fine


def _product(cells: DataFrame, block: DataFrame, to: str, by: str) -> DataFrame:
    """Matrix (or its transpose) times a block: one vector per key of `to`."""
    cols = _columns(block)
    summed = (cells.join(block, by).groupBy(to).agg(*[F.sum(F.col("x") * F.col(c)).alias(c) for c in cols]))
    return written(summed, "product")


def _start(cells: DataFrame, width: int, seed: int) -> DataFrame:
    """Random directions, fixed by seed and key."""
    def normal(i):
        u, v = (F.pmod(F.xxhash64(F.lit(seed), F.lit(i), F.lit(k), "column"), F.lit(1 << 52)) + 0.5 for k in (0, 1))
        return F.sqrt(-2 * F.log(u / (1 << 52))) * F.cos(v * (2 * np.pi / (1 << 52)))

    return cells.select("column").distinct().select("column", *[normal(i).alias(f"b{i}") for i in range(width)])


def _dense(batch: pa.RecordBatch, width: int):
    """The keys and dense lines of a batch of (key, line), some at a time."""
    for start in range(0, batch.num_rows, LINES):
        some = batch.slice(start, LINES)
        line = some.column(1)
        sizes, cells = np.diff(line.offsets.to_numpy()), line.flatten()
        out = np.zeros((some.num_rows, width))
        out[np.repeat(np.arange(some.num_rows), sizes), cells.field("at").to_numpy()] = cells.field("x").to_numpy()
        yield some.column(0), out


def _direct(cells: DataFrame, k: int, short: str) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Values and vectors (short side, long side) of a matrix whose short side has NARROW keys at most."""
    spark, long = cells.sparkSession, "column" if short == "row" else "row"
    keys = cells.select(F.col(short).alias("key")).distinct()
    index = written(row_index(keys.filter("key IS NOT NULL"), "key", name="at"), "keys")
    known = index.count()
    index = index.select("key", F.col("at").cast("int").alias("at")).unionByName(keys.filter("key IS NULL").withColumn("at", F.lit(known)))
    width = known + keys.filter("key IS NULL").count()
    placed = cells.join(index, F.col(short).eqNullSafe(F.col("key"))).groupBy(long, "at").agg(F.sum("x").alias("x"))
    lines = written(placed.groupBy(long).agg(F.collect_list(F.struct("at", "x")).alias("line")), "lines")

    def reduce_lines(batches):
        r = np.zeros((0, width))
        for batch in batches:
            for _, x in _dense(batch, width):
                r = np.linalg.qr(np.vstack([r, x]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": pa.array([r.tobytes()], pa.binary())})

    _, s, vt = np.linalg.svd(_merged(lines.mapInArrow(reduce_lines, "r binary"), width), full_matrices=False)
    held = s > NOISE * max(s[0], np.finfo(float).tiny)
    s, vt = s[held][:k], vt[held][:k]
    names = [f"b{i}" for i in range(len(s))]
    of_long = T.StructType([lines.schema[long]] + [T.StructField(c, T.DoubleType()) for c in names])

    def turn(batches):
        for batch in batches:
            for ids, x in _dense(batch, width):
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in (x @ (vt.T / s)).T)], [long, *names])

    vectors = spark.createDataFrame(pd.DataFrame({"at": np.arange(width), **{c: v for c, v in zip(names, vt)}}))
    near = written(index.join(vectors, "at").select(F.col("key").alias(short), *names), "vectors")
    far = written(lines.mapInArrow(turn, of_long), "vectors")
    release(lines)
    return s, near, far


def singular_triplets(cells: DataFrame, k: int, extra: int | None = None, seed: int = 42) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The k largest singular values of the written cells (row, column, x), with unit vectors as (row, b0, ...) and (column, b0, ...).

    Cells without a column take no part. Fewer values come back where the rank is lower. `extra` directions
    serve the iteration only (see `_iterated`).
    """
    cells = cells.filter(F.col("column").isNotNull())
    short = next((side for side in ("row", "column") if cells.select(side).distinct().limit(NARROW + 1).count() <= NARROW), None)
    if short:
        s, near, far = _direct(cells, k, short)
        rows, columns = (near, far) if short == "row" else (far, near)
    else:
        s, rows, columns = _iterated(cells, k, extra, seed)
    largest = columns.agg(*[F.max_by(f"b{i}", F.struct(F.abs(f"b{i}"), F.col("column"))).alias(f"b{i}") for i in range(len(s))]).first()
    sign = np.array([1.0 if v is None or v >= 0 else -1.0 for v in largest or []])
    turn = np.diag(sign) if len(sign) else np.zeros((0, 0))
    return s, _turned(rows, "row", turn), _turned(columns, "column", turn)


def _iterated(cells: DataFrame, k: int, extra: int | None, seed: int) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """Values and vectors (rows, columns) by subspace iteration.

    `extra` directions beyond k (as many as k, 40 at least) speed convergence: an error shrinks each round by the
    squared ratio of the first value left out to the one wanted.
    """
    extra = max(40, k) if extra is None else extra
    left = _product(cells, _start(cells, k + extra, seed), "row", "column")
    before = None
    for _ in range(ROUNDS):
        right = _product(cells, _turned(left, "row", _basis(_triangle(left))[1]), "column", "row")
        release(left)
        now, by = _basis(_triangle(right))
        now = now[:k]
        settled = before is not None and now.shape == before.shape and np.all(np.abs(now - before) <= SETTLED * now[0])
        if settled:
            break
        left = _product(cells, _turned(right, "column", by), "row", "column")
        release(right)
        before = now
    else:
        right = _product(cells, _turned(left, "row", _basis(_triangle(left))[1]), "column", "row")
    right_basis = _orthonormal(right, "column")
    left = _product(cells, right_basis, "row", "column")
    _, s, vt = np.linalg.svd(_triangle(left), full_matrices=False)
    held = s > NOISE * max(s[0], np.finfo(float).tiny)
    s, vt = s[held][:k], vt[held][:k]
    rows = written(_turned(left, "row", vt.T / s), "rows")
    columns = written(_turned(right_basis, "column", vt.T), "columns")
    release(left, right, right_basis)
    return s, rows, columns
