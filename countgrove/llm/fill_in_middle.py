"""Fill-in-middle transformation: a text is cut twice between units and its parts change places.

A unit is a run of ASCII white space with the word behind it, or the white space at the end. One
`fullmatch` of (unit)* keeps every repetition of the group, so the ends of the group give the number
of units and the offset of any cut; units are not walked one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_batches

SENTINELS = ("<P>", "<S>", "<M>")   # before the prefix, the suffix and the middle
SEED = 42
RATE = 50       # of 100 texts so many are transformed
SPM = 80        # of 100 transformed texts so many have the suffix first
WINDOW = 1 << 20   # code points matched at once; the matcher keeps some 200 bytes a unit

_UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*")


def unit_ends(text: str, window: int = WINDOW) -> list[int]:
    """Offsets behind each unit, in code points.

    A text longer than the window is matched window by window. All units but the last of a window
    end inside it, so the next window starts where the last one began, and a unit that fills a window
    is matched again in one of twice the length.
    """
    if len(text) <= window:
        return _UNITS.fullmatch(text).ends(1)
    ends: list[int] = []
    start, width = 0, window
    while start + width < len(text):
        found = _UNITS.fullmatch(text, start, start + width).ends(1)
        if len(found) > 1:
            ends += found[:-1]
            start, width = found[-2], window
        else:
            width *= 2
    return ends + _UNITS.fullmatch(text, start).ends(1)


def _work(rate: int, spm: int, sentinels: Sequence[str], window: int):
    before_prefix, before_suffix, before_middle = sentinels

    def one(text: str | None, digest: str):
        text = text or ""
        ends = unit_ends(text, window)
        n = len(ends)
        h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
        if not text or h3 % 100 >= rate or any(s in text for s in sentinels):
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (low, high))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < spm:
            return n, "spm", a, b - a, f"{before_suffix}{suffix}{before_prefix}{prefix}{before_middle}{middle}"
        return n, "psm", a, b - a, f"{before_prefix}{prefix}{before_suffix}{suffix}{before_middle}{middle}"

    def work(ids, texts, digests):
        rows = [one(t, d) for t, d in zip(texts, digests)]
        return ids, *(list(zip(*rows)) if rows else [[]] * 5)

    return work


def _check(sentinels: Sequence[str]) -> None:
    """Sentinels that could overlap one another would not be found again in the output."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                raise ValueError("sentinels must not be empty, overlap or contain each other")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE,
              spm: int = SPM, sentinels: Sequence[str] = SENTINELS, window: int = WINDOW) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per document.

    `n` units; `form` is plain, spm (suffix, prefix, middle) or psm (prefix, suffix, middle). Cuts, the
    choice to transform and the form depend on the seed and the id alone, so reruns and repeated rows
    agree; a NULL id counts as an id without digits. NULL and empty texts, and texts that hold a
    sentinel, stay plain; their numbers of characters are NULL. Texts of any length are cut whole;
    other columns are ignored; an empty table gives no rows.
    """
    _check(sentinels)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.sha2(key.cast("binary"), 256).alias("_digest"))
    return map_batches(rows, ["_id", "_text", "_digest"], fields(
        (id_col, docs.schema[id_col].dataType), ("n", T.LongType()), ("form", T.StringType()),
        ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())),
        _work(rate, spm, tuple(sentinels), window))


def restored(sentinels: Sequence[str] = SENTINELS, output: str = "output", form: str = "form") -> Column:
    """The text that `transform` was given, from its output and form alone."""
    _check(sentinels)
    before_prefix, before_suffix, before_middle = sentinels
    head = F.substring_index(output, before_middle, 1)
    middle = F.substring_index(output, before_middle, -1)

    def first(opening: str, following: str) -> Column:
        return F.substr(F.substring_index(head, following, 1), F.lit(len(opening) + 1))

    psm = F.concat(first(before_prefix, before_suffix), middle, F.substring_index(head, before_suffix, -1))
    spm = F.concat(F.substring_index(head, before_prefix, -1), middle, first(before_suffix, before_prefix))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def digests(cut: DataFrame, id_col: str = "doc_id", sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """The rows of `transform` with digests in place of texts: that of the output and that of the restored text."""
    return cut.select(id_col, "n", "form", "prefix_chars", "middle_chars",
                      F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored(sentinels).cast("binary"), 256).alias("restored_sha256"))
