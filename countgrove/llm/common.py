"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Characters that count as word characters of an expression but are no letters, such as superscripts and fractions.
NUMERALS = "".join(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())

_NUMERAL_SET = frozenset(NUMERALS)
_NUMERAL_GAPS = dict.fromkeys(map(ord, NUMERALS), "_")


def without_numerals(text: str) -> str:
    """The text with `_` for NUMERALS. Few texts have any, and a set finds that out faster than a character class."""
    if text.isascii() or _NUMERAL_SET.isdisjoint(text):
        return text
    return text.translate(_NUMERAL_GAPS)


HELD_OUT = 2         # remainder of the fold that no model learns from
FOLDS = 4
SMALL = 100_000          # digests of 32 bytes that are sent to every executor; more are shuffled
SLICE_BYTES = 2 << 20  # texts are handed to Python in slices of about this size


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves HELD_OUT modulo FOLDS; false for a NULL id."""
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def map_batches(df: DataFrame, columns: list[str], schema: T.StructType,
                work: Callable[..., Iterable]) -> DataFrame:
    """Runs `work(*column lists)` on slices of rows inside the tasks, one output list per field.

    Slices are cut by bytes, so a run of very long texts does not pile up in a worker.
    """
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]
    labels = schema.fieldNames()
    df = df.select(*columns)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = work(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, type=kind) for values, kind in zip(out, kinds, strict=True)], labels)

    return df.mapInArrow(run, schema)


def digest_of(text: Column) -> Column:
    """SHA-256 of a text, by which equal texts are known."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def one_text_each(texts: DataFrame, wanted: DataFrame, small: int = SMALL) -> DataFrame:
    """(content, text) of the wanted contents, once each, from the (content, text) of all rows.

    `wanted` is a written table of distinct contents. Equal texts are reduced inside the tasks before
    they move, so a text that a third of the rows repeat is no heavy key; where few contents are
    wanted no other text moves.
    """
    few = wanted.count() <= small
    if few:
        texts = texts.join(F.broadcast(wanted), "content", "left_semi")
    texts = texts.groupBy("content").agg(F.any_value("text").alias("text"))
    return texts if few else texts.join(wanted, "content", "left_semi")


def slices(batch: pa.RecordBatch):
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, min(rows, rows * SLICE_BYTES // max(batch.nbytes, 1)))
    start = 0
    while start < rows:
        part = batch.slice(start, step)
        while part.num_rows > 1 and part.nbytes > 2 * SLICE_BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        start += part.num_rows


def fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def append_batches(df: DataFrame, columns: list[str], extra: T.StructType,
                   work: Callable[..., Iterable]) -> DataFrame:
    """All columns of `df` and those that `work(*column lists)` returns; rows stay where they are."""
    kinds = [to_arrow_type(f.dataType) for f in extra.fields]
    labels = df.columns + extra.fieldNames()
    places = [df.columns.index(c) for c in columns]

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = work(*[part.column(i).to_pylist() for i in places])
                added = [pa.array(values, type=kind) for values, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(part.columns + added, labels)

    return df.mapInArrow(run, T.StructType(df.schema.fields + extra.fields))


def text_groups(texts: list[str], size: int = 1 << 20):
    """Slices (start, stop) of consecutive texts with about `size` characters together."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
