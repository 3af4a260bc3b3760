"""Sample-by-sample tables from blocks of rows.

A pair table is a matrix product. Rows are hashed into blocks of bounded rows and cells, kept as
compressed lines; one task holds two blocks, adds up every inner key that both have, and returns the
finished pairs strip by strip, so neither pairs nor partial sums are shuffled or held for a whole tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.common import dbl, names
from .ranking import row_index
from .scratch import written

BLOCK = 8192             # rows of a block at most, about
TILE_CELLS = 2_000_000   # cells of a block at most, about
LINE_CELLS = 250_000     # cells of a line of a block, about
TILED = 8                # blocks that a small table is cut into, of 32 rows at least
CHUNK = 2048             # inner keys multiplied at once where cells are dense
SIDE = 512               # rows of a side multiplied at once where cells are dense
PIECE = 1 << 18          # pairs of one piece of a task's result
PARTS = 4096             # partitions of the tiles at most


# Kernels: what one inner key that both rows hold adds to a pair, for arrays of the two values.


def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of products over the inner key."""
    return x * y


def shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of inner keys present on both sides."""
    return ((x > 0) & (y > 0)).astype(float)


def _part(x: np.ndarray) -> np.ndarray:
    return -x * np.log(np.where(x > 0, x, 1.0))


def shared_entropy(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Entropy of the mean share, less the entropy parts of the two half shares."""
    return np.where((x > 0) & (y > 0), _part((x + y) / 2) - _part(x / 2) - _part(y / 2), 0.0)


def _shared_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a > 0).astype(float).T @ (b > 0).astype(float)


def _shared_entropy_dense(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`shared_entropy` added up: where one side is 0 the entropy of the mean is that of its half share, so only that needs pairs."""
    a, b = (np.where(x > 0, x, 0.0) / 2 for x in (a, b))
    own_a, own_b = _part(a).sum(axis=0), _part(b).sum(axis=0)
    out = np.zeros((a.shape[1], b.shape[1]))
    for start in range(0, len(out), STRIP):
        some = a[:, start:start + STRIP]
        both, log = np.empty((2, some.shape[1], b.shape[1]))
        for x, y in zip(some, b):
            np.add(x[:, None], y, out=both)
            np.log(np.maximum(both, TINY, out=log), out=log)
            log *= both
            out[start:start + STRIP] -= log
    out -= own_a[:, None] + own_b
    out[_shared_dense(a, b) == 0] = 0.0
    return out


STRIP = 32            # rows of a side whose pairs are held at once
TINY = np.finfo(float).tiny
MET = 1 << 19         # meetings of two cells that are added up at once
# kernels of all cells of a chunk at once, and their speed against a matrix product
DENSE = {dot: (lambda a, b: a.T @ b, 1.0), shared: (_shared_dense, 1.0), shared_entropy: (_shared_entropy_dense, 0.15)}
DENSE_GAIN = 100      # cells of a matrix product in the time of one meeting, about


class Side(NamedTuple):
    """Rows of one side of a tile: number of positive cells, sum and sum of squares of the values."""

    n: np.ndarray
    s: np.ndarray
    q: np.ndarray


class Rows(NamedTuple):
    """Some rows with their labels: the cells of row r are `ends[r]` to `ends[r + 1]`, in order of their inner key."""

    ids: pa.Array
    labels: pa.Array
    ends: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def pos(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids)), np.diff(self.ends))

    def side(self) -> Side:
        pos, v = self.pos(), self.value
        return Side(*(np.bincount(pos, w, len(self.ids)) for w in (v > 0, v, v * v)))


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then their second bytes and so on, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).reshape(-1).view(kind)


def _encoded(pos: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int) -> bytes:
    """Cells of a line, nothing lost: cells per row, steps between inner keys, and values by their number among those of the row."""
    order = np.lexsort((at, pos))
    pos, at, value = pos[order], at[order], value[order]
    step = np.diff(at, prepend=0)
    by_value = np.lexsort((value, pos))
    p, v = pos[by_value], value[by_value]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1])
    of_row = np.bincount(p[new], minlength=rows)
    code = np.empty(len(p), np.int64)
    code[by_value] = np.cumsum(new) - 1
    code -= (np.cumsum(of_row) - of_row)[pos]
    steps = "<i4" if not len(step) or np.abs(step).max() < 2 ** 31 else "<i8"
    codes = "<u2" if not len(code) or code.max() < 2 ** 16 else "<u4"
    parts = [np.array([rows, len(pos), int(new.sum()), int(steps[2]), int(codes[2])], "<i8").tobytes(),
             _planes(np.bincount(pos, minlength=rows).astype("<i4")), _planes(of_row.astype("<i4")),
             _planes(step.astype(steps)), _planes(code.astype(codes)), _planes(np.ascontiguousarray(v[new], "<f8"))]
    raw = b"".join(parts)
    return np.array([len(raw)], "<i8").tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells per row, inner keys and values of a line."""
    raw = pa.decompress(data[8:], int(np.frombuffer(data, "<i8", 1)[0]), codec="zstd", asbytes=True)
    rows, cells, kinds, steps, codes = np.frombuffer(raw, "<i8", 5).tolist()
    start, found = 40, []
    for kind, n in (("<i4", rows), ("<i4", rows), (f"<i{steps}", cells), (f"<u{codes}", cells), ("<f8", kinds)):
        end = start + n * np.dtype(kind).itemsize
        found.append(_from_planes(raw[start:end], kind, n))
        start = end
    per_row, of_row, step, code, own = found
    first = np.repeat(np.cumsum(of_row, dtype=np.int64) - of_row, per_row)
    return per_row, np.cumsum(step, dtype=f"i{steps}"), own[first + code]


def _rows_of(lines: list[dict]) -> Rows:
    """Lines of a block one after another."""
    cells = [_decoded(line["_data"]) for line in lines]
    per_row = np.concatenate([c[0] for c in cells])
    return Rows(pa.concat_arrays([line["_rows"] for line in lines]), pa.concat_arrays([line["_labels"] for line in lines]),
                np.concatenate(([0], np.cumsum(per_row, dtype=np.int64))), np.concatenate([c[1] for c in cells]), np.concatenate([c[2] for c in cells]))


def _lines(batches: Iterator[pa.RecordBatch], names_: list[str]) -> Iterator[dict]:
    """Lines of a group one by one; lists of rows stay arrays."""
    for batch in batches:
        columns = {n: batch.column(n) for n in names_}
        for k in range(batch.num_rows):
            yield {n: c[k].values if n in ("_rows", "_labels") else c[k].as_py() for n, c in columns.items()}


def _packed(df: DataFrame, row: str, inner: str, value: str, keys: list[str], block: int, cells: int, label=None,
            room: int | None = None) -> tuple[DataFrame, int, DataFrame]:
    """Blocks of rows as compressed lines, the number of blocks (for the largest key), and the numbers `_at` of inner keys.

    A line holds row ids, their labels and cells. Cells without an inner key count in their row, by the number
    -1, and meet no other. A block has about `block` rows and about `cells` cells at most (and rows for `room` cells, were
    they dense), and smaller ones serve a table that would have few tiles. Lines are smaller than blocks, so none is large.
    """
    label = F.lit(0).cast("bigint") if label is None else F.col(label)
    named = df.select(*keys, F.col(row).alias("_row"), F.col(inner).alias("_inner"), dbl(value).alias("_value"), label.alias("_label"))
    data = written(named.filter(F.col("_row").isNotNull() & F.col("_label").isNotNull()), "cells")
    sizes = data.groupBy(*keys).agg(F.count_distinct("_row").alias("_r"), F.count(F.lit(1)).alias("_c"))
    largest = sizes.agg(F.max("_r"), F.max("_c")).first()
    rows_n, cells_n = largest[0] or 0, largest[1] or 0
    inners = written(row_index(data.filter(F.col("_inner").isNotNull()).select("_inner").distinct(), "_inner", name="_at"), "inners")
    if room is not None:
        block = min(block, max(1, room // max(1, inners.count())))
    blocks = max(1, -(-rows_n // block), -(-cells_n // cells), min(TILED, rows_n // 32))
    lines = blocks * max(1, -(-cells_n // (blocks * LINE_CELLS)))
    placed = data.join(inners, "_inner", "left").select(
        *keys, "_row", "_value", "_label", F.coalesce("_at", F.lit(-1)).cast("bigint").alias("_at"),
        F.pmod(F.xxhash64("_row"), F.lit(lines)).alias("_line"))
    schema = T.StructType([data.schema[k] for k in keys] + [
        T.StructField("_block", T.LongType()), T.StructField("_line", T.LongType()),
        T.StructField("_rows", T.ArrayType(data.schema["_row"].dataType)),
        T.StructField("_labels", T.ArrayType(data.schema["_label"].dataType)), T.StructField("_data", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def pack(table: pa.Table) -> pa.Table:
        coded = table["_row"].combine_chunks().dictionary_encode()
        ids, pos = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.full(len(ids), len(pos))
        np.minimum.at(first, pos, np.arange(len(pos)))
        number = table["_line"][0].as_py()
        line = {**{k: table[k][:1].combine_chunks() for k in keys}, "_block": [number % blocks], "_line": [number], "_rows": [ids.to_pylist()],
                "_labels": [table["_label"].take(pa.array(first)).to_pylist()],
                "_data": [_encoded(pos, table["_at"].to_numpy(), table["_value"].to_numpy().astype(float), len(ids))]}
        return pa.table([pa.array(line[f.name], f.type) if isinstance(line[f.name], list) else line[f.name].cast(f.type) for f in arrow], schema=arrow)

    return written(placed.groupBy(*keys, "_line").applyInArrow(pack, schema), "blocks"), blocks, inners


def _dense(side: Rows, code: np.ndarray, rows: slice, start: int, end: int) -> np.ndarray:
    """Cells of some rows with codes from `start` to `end` as a matrix (code, row)."""
    some = slice(side.ends[rows.start], side.ends[rows.stop])
    pos = np.repeat(np.arange(rows.stop - rows.start), np.diff(side.ends[rows.start:rows.stop + 1]))
    here = (code[some] >= start) & (code[some] < end)
    m = np.zeros((end - start, rows.stop - rows.start))
    m[code[some][here] - start, pos[here]] = side.value[some][here]
    return m


def _steps(n: int, size: int) -> Iterator[slice]:
    return (slice(start, min(start + size, n)) for start in range(0, n, size))


def _met(a: Rows, b: Rows, kernel: Callable, chunk: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Kernel sums of strips of rows of one side with all rows of the other."""
    na, nb = len(a.ids), len(b.ids)
    order = np.argsort(b.at, kind="stable")
    pos_b, at_b = b.pos().astype(np.int32)[order], b.at[order]
    first = np.searchsorted(at_b, 0)
    kept, begin, size = np.unique(at_b[first:], return_index=True, return_counts=True)
    if not kept.size:
        yield from ((rows, np.zeros((rows.stop - rows.start, nb))) for rows in _steps(na, max(1, PIECE // nb)))
        return
    found = np.minimum(np.searchsorted(kept, a.at), kept.size - 1)
    meet = kept[found] == a.at
    meets = np.where(meet, size[found], 0)
    dense, speed = DENSE.get(kernel, (None, 0.0))
    both = np.unique(found[meet])
    if both.size * na * nb < DENSE_GAIN * speed * int(meets.sum()):
        del order, pos_b, at_b, meets
        codes = [np.full(len(side.at), -1) for side in (a, b)]
        codes[0][meet] = np.searchsorted(both, found[meet])
        del found, meet
        near = np.minimum(np.searchsorted(kept[both], b.at), both.size - 1)
        same = kept[both][near] == b.at
        codes[1][same] = near[same]
        del near, same
        for rows in _steps(na, min(SIDE, max(1, 8 * PIECE // nb))):
            sums = np.zeros((rows.stop - rows.start, nb))
            for some in _steps(both.size, chunk):
                left = _dense(a, codes[0], rows, some.start, some.stop)
                for columns in _steps(nb, 2 * SIDE):
                    sums[:, columns] += dense(left, _dense(b, codes[1], columns, some.start, some.stop))
            yield rows, sums
        return
    # every cell of the left side meets the cells of the right one in its inner key
    value_b = b.value[order]
    edges = np.concatenate(([0], np.cumsum(meets)))[a.ends]
    place = begin[found] + first
    pos_a = a.pos()
    start, most = 0, max(1, PIECE // nb)
    while start < na:
        end = min(start + most, na, max(start + 1, int(np.searchsorted(edges, edges[start] + MET, "right")) - 1))
        some = slice(a.ends[start], a.ends[end])
        j = _ranges(place[some], meets[some])
        x = kernel(np.repeat(a.value[some], meets[some]), value_b[j])
        target = np.repeat((pos_a[some] - start) * nb, meets[some]) + pos_b[j]
        yield slice(start, end), np.bincount(target, x, (end - start) * nb).reshape(end - start, nb)
        start = end


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after another."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def _ranks(*sides: pa.Array) -> list[np.ndarray]:
    """Places of the ids of some sides in their common order."""
    known = [ids.to_pylist() for ids in sides]
    place = {v: k for k, v in enumerate(sorted({v for ids in known for v in ids}))}
    return [np.array([place[v] for v in ids], dtype=np.int64) for ids in known]


def _strips(a: Rows, b: Rows, same: bool, kernel: Callable, chunk: int, finish: Callable | None):
    """Of each strip of a tile: rows of the left side, finished values of its pairs, and which pairs count, None for all."""
    of_a, of_b = a.side(), b.side()
    at_a, at_b = _ranks(a.ids, b.ids)
    right = Side(*(x[None, :] for x in of_b))
    for rows, sums in _met(a, b, kernel, chunk):
        value = sums if finish is None else finish(sums, Side(*(x[rows, None] for x in of_a)), right)
        yield rows, value, at_a[rows, None] < at_b[None, :] if same else None


def _ends(ids: pa.Array, at_a: np.ndarray, at_b: np.ndarray, r: np.ndarray, c: np.ndarray) -> list[pa.Array]:
    """Ids of pairs of rows of two sides, the smaller first; `ids` are those of both."""
    swap = at_a[r] > at_b[c]
    other = len(at_a) + c
    return [ids.take(pa.array(e)) for e in (np.where(swap, other, r), np.where(swap, r, other))]


def _cells_of(rows: slice, once: np.ndarray | None, columns: int) -> tuple[np.ndarray, np.ndarray]:
    if once is None:
        n = rows.stop - rows.start
        return np.repeat(np.arange(rows.start, rows.stop), columns), np.tile(np.arange(columns), n)
    r, c = np.nonzero(once)
    return r + rows.start, c


def _tile(batches: Iterator[pa.RecordBatch], keys: list[str]) -> tuple[dict, Rows, Rows] | None:
    """The first line and both sides of a tile; None if one has no rows."""
    lines = list(_lines(batches, [*keys, "_i", "_j", "_block", "_line", "_rows", "_labels", "_data"]))
    of = lines[0]
    sides = [sorted((x for x in lines if x["_block"] == b), key=lambda x: x["_line"]) for b in dict.fromkeys((of["_i"], of["_j"]))]
    if not all(sides):
        return None
    rows = [_rows_of(side) for side in sides]
    return of, rows[0], rows[-1]


def _tiles(packed: DataFrame, blocks: int, keys: list[str]) -> DataFrame:
    """Every pair of blocks as a group (keys, _i, _j) of their lines; as many partitions as tiles allow."""
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    parts = min(blocks * (blocks + 1) // 2, PARTS)
    tiles = packed.withColumn("_other", other).withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other"))
    return tiles.drop("_other").repartition(parts, *keys, "_i", "_j")


def pair_sums(df: DataFrame, row: str, inner: str, value: str, kernel: Callable = dot, keys=(), block: int = BLOCK, chunk: int = CHUNK,
              out: str = "value", left: str = "s1", right: str = "s2", finish: Callable | None = None, cells: int = TILE_CELLS) -> DataFrame:
    """Symmetric kernel of every pair of rows, (keys, s1, s2, value) with s1 < s2; pairs that share nothing have 0.

    `df` holds one cell per (keys, row, inner). A task holds the cells of two blocks of rows, adds up
    the whole inner key and returns its pairs, which are not shuffled again: what moves is the compressed
    cells, as often as there are blocks. `finish(sums, left side, right side)` turns the sums of a strip
    of rows into the result (NaN becomes NULL).
    """
    keys = names(keys)
    packed, blocks, _ = _packed(df, row, inner, value, keys, block, cells)
    kind = df.schema[row].dataType
    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField(left, kind), T.StructField(right, kind), T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _tile(batches, keys)
        if tile is None:
            return
        of, a, b = tile
        ids = pa.concat_arrays([a.ids, b.ids]).cast(arrow.field(left).type)
        at_a, at_b = _ranks(a.ids, b.ids)
        for rows, found, once in _strips(a, b, of["_i"] == of["_j"], kernel, chunk, finish):
            step = max(1, PIECE // len(at_b))
            for part in _steps(len(found), step):
                some = slice(rows.start + part.start, rows.start + part.stop)
                r, c = _cells_of(some, None if once is None else once[part], len(at_b))
                values = found[part].ravel() if once is None else found[part][once[part]]
                same = [pa.array([of[k]], arrow.field(k).type).take(pa.array(np.zeros(len(r), dtype=np.int64))) for k in keys]
                yield pa.RecordBatch.from_arrays([*same, *_ends(ids, at_a, at_b, r, c), pa.array(values, pa.float64(), from_pandas=True)], schema=arrow)

    return _tiles(packed, blocks, keys).groupBy(*keys, "_i", "_j").applyInArrow(run, schema)


AT_ONCE = 8    # replicates that a tile of `pair_spread` holds
SPREAD = 2048   # rows of its blocks at most, about


def pair_spread(df: DataFrame, row: str, inner: str, value: str, kernel: Callable, finish: Callable, rep: str, reps: int, mean: str = "mean",
                sd: str = "sd", block: int = SPREAD, chunk: int = CHUNK, cells: int = TILE_CELLS, left: str = "s1", right: str = "s2", at_once: int = AT_ONCE) -> DataFrame:
    """Mean and sample sd over replicates of a value of every pair of rows, (s1, s2, mean, sd) with s1 < s2.

    `rep` numbers the replicates from 1 to `reps`. A task holds the cells of two blocks of rows in `at_once` replicates, forms
    their pairs one replicate after the other as `pair_sums` does and keeps running moments, so a pair is
    returned once for that many replicates. A pair counts in the replicates that have both rows.
    """
    turn = "_turn"
    at_once = -(-reps // -(-reps // at_once))
    turns = df.filter(F.col(rep).isNotNull()).withColumn(turn, F.floor((F.col(rep) - 1) / at_once))
    packed, blocks, _ = _packed(turns, row, inner, value, [turn, rep], block, max(1, cells // 3))
    kind = df.schema[row].dataType
    schema = T.StructType([T.StructField(left, kind), T.StructField(right, kind)] + [T.StructField(c, T.DoubleType()) for c in ("_n", "_mean", "_m2")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = sorted(_lines(batches, [rep, "_i", "_j", "_block", "_line", "_rows", "_labels", "_data"]), key=lambda x: (x[rep], x["_line"]))
        i, j = lines[0]["_i"], lines[0]["_j"]
        own = {b: sorted({v for line in lines if line["_block"] == b for v in line["_rows"].to_pylist()}) for b in (i, j)}
        place = [{v: k for k, v in enumerate(own[b])} for b in (i, j)]
        shape = len(own[i]), len(own[j])
        n, mean_, m2, formed = np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
        for number in sorted({line[rep] for line in lines}):    # lines stay compressed until their replicate comes
            sides = [[line for line in lines if line[rep] == number and line["_block"] == b] for b in dict.fromkeys((i, j))]
            if not all(sides):
                continue
            held = [_rows_of(side) for side in sides]
            a, b = held[0], held[-1]
            at_a, at_b = (np.array([p[v] for v in side.ids.to_pylist()]) for p, side in zip(place, (a, b)))
            for rows, found, _ in _strips(a, b, False, kernel, chunk, finish):
                for line, r in zip(found, at_a[rows]):
                    formed[r, at_b] = True
                    known = ~np.isnan(line)
                    c, line = at_b[known], line[known]
                    n[r, c] += 1
                    off = line - mean_[r, c]
                    mean_[r, c] += off / n[r, c]
                    m2[r, c] += off * (line - mean_[r, c])
        ids = pa.array([*own[i], *own[j]], arrow.field(left).type)
        at_a, at_b = _ranks(ids[:len(own[i])], ids[len(own[i]):])
        for rows in _steps(len(at_a), max(1, PIECE // max(1, len(at_b)))):
            once = formed[rows] & (at_a[rows, None] < at_b[None, :]) if i == j else formed[rows]
            r, c = _cells_of(rows, once, len(at_b))
            yield pa.RecordBatch.from_arrays([*_ends(ids, at_a, at_b, r, c), *(pa.array(x, pa.float64()) for x in (
                n[r, c].astype(float), mean_[r, c], m2[r, c]))], schema=arrow)

    parts = _tiles(packed, blocks, [turn]).groupBy(turn, "_i", "_j").applyInArrow(run, schema)
    if reps > at_once:
        def add(acc, e):
            total, off = F.greatest(acc["_n"] + e["_n"], F.lit(1.0)), e["_mean"] - acc["_mean"]
            return F.struct((acc["_n"] + e["_n"]).alias("_n"), (acc["_mean"] + off * e["_n"] / total).alias("_mean"),
                            (acc["_m2"] + e["_m2"] + off * off * acc["_n"] * e["_n"] / total).alias("_m2"))

        none = F.struct(*[F.lit(0.0).alias(c) for c in ("_n", "_mean", "_m2")])
        each = F.sort_array(F.collect_list(F.struct("_n", "_mean", "_m2")))     # as many as there are turns
        parts = parts.groupBy(left, right).agg(F.aggregate(each, none, add).alias("_all")).select(left, right, "_all.*")
    return parts.select(left, right, F.when(F.col("_n") > 0, F.col("_mean")).alias(mean),
                        F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1))).alias(sd))


def pair_moments(df: DataFrame, row: str, inner: str, value: str, kernel: Callable, finish: Callable, group: str | None = None,
                 keys=(), block: int = BLOCK, chunk: int = CHUNK, cells: int = TILE_CELLS) -> DataFrame:
    """Count, mean and variance over pairs of rows by unordered pair of their groups, without a table of pairs.

    Returns (keys, group_1, group_2, n, mean, variance); without `group` both are 0. A task holds the
    cells of two blocks of rows as in `pair_sums`, turns the sums of a strip into one value per pair by `finish`,
    and returns three numbers per pair of groups. Rows without a group take no part.
    """
    keys = names(keys)
    packed, blocks, _ = _packed(df, row, inner, value, keys, block, cells, group)
    kind = packed.schema["_labels"].dataType.elementType
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("group_1", kind), T.StructField("group_2", kind)] + [
        T.StructField(c, T.DoubleType()) for c in ("_n", "_mean", "_m2")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _tile(batches, keys)
        if tile is None:
            return
        of, a, b = tile
        own = [side.labels.to_pylist() for side in (a, b)]
        labels = sorted({*own[0], *own[1]})
        place = {v: k for k, v in enumerate(labels)}
        group_a, group_b = (np.array([place[v] for v in side], dtype=np.int64) for side in own)
        held: dict[int, tuple] = {}
        for rows, found, once in _strips(a, b, of["_i"] == of["_j"], kernel, chunk, finish):
            pair = np.minimum(group_a[rows, None], group_b[None, :]) * len(labels) + np.maximum(group_a[rows, None], group_b[None, :])
            value, pair = (found.ravel(), pair.ravel()) if once is None else (found[once], pair[once])
            if not value.size:
                continue
            which, where = (np.arange(len(labels) ** 2), pair) if len(labels) ** 2 <= PIECE // 16 else np.unique(pair, return_inverse=True)
            n = np.bincount(where, minlength=len(which)).astype(float)
            mean = np.bincount(where, value, len(which)) / np.maximum(n, 1.0)
            off = value - mean[where]
            m2 = np.bincount(where, off * off, len(which))
            for g in np.nonzero(n)[0]:
                n0, mean0, m20 = held.get(int(which[g]), (0.0, 0.0, 0.0))
                total, step = n0 + n[g], mean[g] - mean0
                held[int(which[g])] = (total, mean0 + step * n[g] / total, m20 + m2[g] + step * step * n0 * n[g] / total)
        if not held:
            return
        same = [pa.array([of[k]] * len(held), arrow.field(k).type) for k in keys]
        ends = [pa.array([labels[p] for p in side], arrow.field("group_1").type) for side in zip(*(divmod(p, len(labels)) for p in held))]
        yield pa.RecordBatch.from_arrays([*same, *ends, *(pa.array(x, pa.float64()) for x in zip(*held.values()))], schema=arrow)

    by = [*keys, "group_1", "group_2"]
    parts = written(_tiles(packed, blocks, keys).groupBy(*keys, "_i", "_j").applyInArrow(run, schema), "moments")
    whole = parts.groupBy(*by).agg(F.sum("_n").alias("_all"), (F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).alias("_centre"))
    off = F.col("_mean") - F.col("_centre")
    return (parts.join(whole, by).groupBy(*by).agg(
        F.max("_all").cast("bigint").alias("n"), F.max("_centre").alias("mean"),
        F.sum(F.col("_m2") + F.col("_n") * off * off).alias("_m2"))
        .select(*by, "n", "mean", F.when(F.col("n") > 1, F.col("_m2") / (F.col("n") - 1)).alias("variance")))


TRIPLE = 512            # inner keys of a chunk of `triple_sums`
DENSE_CELLS = 8_000_000  # cells of the products of a block's rows that a task of it holds
TRIPLE_TASKS = 12       # tasks of it at least


def triple_sums(df: DataFrame, between: DataFrame, row: str, inner: str, value: str, block: int = BLOCK, chunk: int = TRIPLE,
                out: str = "value", left: str = "s1", right: str = "s2") -> DataFrame:
    """Sum over i, j of x_i w_ij y_j for every pair of rows, (s1, s2, value) with s1 < s2.

    `between` holds (f1, f2, d), each unordered pair of inner keys once and equal to its mirror; absent
    and NULL pairs are 0, and so is a NULL inner key; NULL rows take no part. Rows are hashed to blocks, and
    inner keys are cut into chunks. A task first multiplies the rows of a block with the table between, chunk by chunk,
    then meets the lines of half of the blocks one by one and returns finished pairs: the table and half of the cells, both
    packed, move once per block, never pairs or partial sums. A block has so many rows that its products
    are DENSE_CELLS. Every pair of rows has a result, 0 if nothing lies between them.
    """
    packed, blocks, inners = _packed(df, row, inner, value, [], block, TILE_CELLS, room=DENSE_CELLS)
    share, chunks = max(1, TRIPLE_TASKS // blocks), max(1, -(-inners.count() // chunk))
    ends = [inners.select(F.col("_inner").alias(f), F.col("_at").alias(c)) for f, c in (("_f1", "_at1"), ("_f2", "_at2"))]
    cuts = between.select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), dbl("d").alias("_d")).filter("_d != 0")
    cuts = cuts.join(ends[0], "_f1").join(ends[1], "_f2").select(
        F.least("_at1", "_at2").alias("_low"), F.greatest("_at1", "_at2").alias("_high"), "_d").withColumn(
        "_a", F.floor(F.col("_low") / chunk)).withColumn("_b", F.floor(F.col("_high") / chunk))

    def dense(table: pa.Table) -> pa.Table:
        a, b = table["_a"][0].as_py(), table["_b"][0].as_py()
        low, high, d = (table[c].to_numpy() for c in ("_low", "_high", "_d"))
        w = np.zeros((chunk, chunk))
        np.add.at(w, (low - a * chunk, high - b * chunk), d)
        if a == b:      # the other triangle is the mirror of one
            w += w.T - np.diag(np.diag(w))
        return pa.table({"_a": [a], "_b": [b], "_data": [pa.compress(w.tobytes(), codec="zstd", asbytes=True)]})

    w_lines = written(cuts.groupBy("_a", "_b").applyInArrow(dense, "_a long, _b long, _data binary"), "between")
    last = F.lit(blocks - 1).cast("bigint")
    every, shares = F.explode(F.sequence(F.lit(0).cast("bigint"), last)), F.explode(F.sequence(F.lit(0), F.lit(share - 1)))
    # a pair of blocks is met by the lower or the higher one in turn
    low, high = F.least("_block", "_t"), F.greatest("_block", "_t")
    meets = F.col("_t") == F.when((low + high) % 2 == 0, low).otherwise(high)
    nowhere = F.lit(-1).cast("bigint")
    own = packed.withColumns({"_t": F.col("_block"), "_part": shares}).withColumns({"_kind": F.lit(0), "_a": nowhere, "_b": nowhere})
    lines = packed.withColumn("_t", every).filter(meets | (F.col("_t") == F.col("_block"))).withColumns({
        "_part": F.pmod(F.floor(F.col("_line") / blocks), F.lit(share)).cast("int"), "_kind": F.lit(2), "_a": nowhere, "_b": nowhere})
    absent = {f.name: F.lit(None).cast(f.dataType) for f in packed.schema.fields if f.name != "_data"}
    tables = w_lines.withColumns({**absent, "_kind": F.lit(1), "_t": every}).withColumn("_part", shares)
    order = ["_t", "_part", "_kind", "_block", "_line", "_rows", "_data", "_a", "_b"]
    dealt = own.select(order).unionByName(tables.select(order)).unionByName(lines.select(order)).repartition(
        min(blocks * share, PARTS), "_t", "_part").sortWithinPartitions("_t", "_part", "_kind")
    kind = df.schema[row].dataType
    schema = T.StructType([T.StructField(left, kind), T.StructField(right, kind), T.StructField(out, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_lines, a, u, most = [], None, None, 0
        for line in _lines(batches, order):
            if line["_kind"] < most:
                raise ValueError("lines of a task are out of order")
            most = line["_kind"]
            if most == 0:
                own_lines.append({**line, "_labels": line["_rows"]})
                continue
            if not own_lines:
                continue
            if a is None:
                a = _rows_of(own_lines)
                u = np.zeros((len(a.ids), chunk * chunks))
            if most == 1:
                w = np.frombuffer(pa.decompress(line["_data"], chunk * chunk * 8, codec="zstd", asbytes=True)).reshape(chunk, chunk)
                p, q = (slice(c * chunk, (c + 1) * chunk) for c in (line["_a"], line["_b"]))
                u[:, q] += _dense(a, a.at, slice(0, len(a.ids)), p.start, p.stop).T @ w
                if p != q:
                    u[:, p] += _dense(a, a.at, slice(0, len(a.ids)), q.start, q.stop).T @ w.T
                continue
            b = _rows_of([{**line, "_labels": line["_rows"]}])
            at_a, at_b = _ranks(a.ids, b.ids)
            ids = pa.concat_arrays([a.ids, b.ids]).cast(arrow.field(left).type)
            for columns in _steps(len(b.ids), max(1, min(SIDE, 2 * DENSE_CELLS // 8 // u.shape[1]))):
                v = u @ _dense(b, b.at, columns, 0, u.shape[1])
                for rows in _steps(len(a.ids), max(1, PIECE // v.shape[1])):
                    once = at_a[rows, None] < at_b[None, columns] if line["_block"] == line["_t"] else None
                    r, c = _cells_of(rows, once, v.shape[1])
                    yield pa.RecordBatch.from_arrays([*_ends(ids, at_a, at_b, r, c + columns.start), pa.array(v[r, c], pa.float64())], schema=arrow)

    return dealt.groupBy("_t", "_part").applyInArrow(run, schema)


def row_pairs(df: DataFrame, key: str, cols, block: int = 2048,
              suffixes: tuple[str, str] = ("_1", "_2"), left: str = "s1",
              right: str = "s2") -> DataFrame:
    """Every pair of rows with key1 < key2 and both sides' columns.

    Blocks of about `block` rows meet by an equi-join on the block number; `key` is unique. The pairs
    of blocks are dealt out before they are expanded: their rows are few, so adaptive execution,
    which goes by size, would leave all pairs to a few tasks.
    """
    cols = names(cols)
    df = written(df.select(key, *cols), "rows")
    count = df.count()
    blocks_n = max(1, -(-count // block), min(TILED, count // 32))
    blocks = written(df.select(F.pmod(F.xxhash64(key), F.lit(blocks_n)).alias("_b"), F.struct(key, *cols).alias("_row"))
                     .groupBy("_b").agg(F.collect_list("_row").alias("_rows")), "blocks")
    a = blocks.select(F.col("_b").alias("_i"), F.col("_rows").alias("_l"),
                      F.explode(F.sequence(F.col("_b"), F.lit(blocks_n - 1).cast("bigint"))).alias("_j"))
    b = blocks.select(F.col("_b").alias("_j"), F.col("_rows").alias("_r"))
    met = a.join(b, "_j").repartition(min(blocks_n * (blocks_n + 1) // 2, PARTS), "_i", "_j")
    both = (met.select("_i", "_j", F.explode("_l").alias("_x"), "_r")
            .select("_i", "_j", "_x", F.explode("_r").alias("_y"))
            .filter((F.col("_i") < F.col("_j")) | (F.col("_x")[key] < F.col("_y")[key])))
    low = F.when(F.col("_x")[key] < F.col("_y")[key], F.col("_x")).otherwise(F.col("_y"))
    high = F.when(F.col("_x")[key] < F.col("_y")[key], F.col("_y")).otherwise(F.col("_x"))
    ordered = both.select(low.alias("_x"), high.alias("_y"))
    return ordered.select(
        F.col("_x")[key].alias(left), F.col("_y")[key].alias(right),
        *[F.col("_x")[c].alias(c + suffixes[0]) for c in cols],
        *[F.col("_y")[c].alias(c + suffixes[1]) for c in cols])
