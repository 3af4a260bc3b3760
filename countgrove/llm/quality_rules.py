"""Quality rules: divergence of a document from language references.

A document is described by two histograms: of character classes, and of the common words of a
language against all other words. References are the same histograms summed over all documents
of a language. The verdict compares both with every reference by Jensen-Shannon distance (base
2, so 0..1), and each comparison is made only from a minimum length on. A short text strays
further from its language by chance, so the largest distance falls with the root of the length.
Fixed base rules on length and repetition come first.

Common words, their frequencies and all other statistics of the references cover all documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import written
from .common import append_batches, fields, free_name, map_batches

COMMON = 48            # common words of a language
MIN_CHARS = 200        # characters from which character classes are compared
MIN_WORDS = 50         # words from which common words are compared, and the base rule for length
CLASS_LIMIT, CLASS_NOISE = 0.14, 2.8   # largest class distance: limit + noise / sqrt(characters)
WORD_LIMIT, WORD_NOISE = 0.18, 2.2     # largest word distance: limit + noise / sqrt(words)
MAX_REPEATED = 50      # percent of words in repeated windows
WINDOW = 3

# Characters of each kind.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:?'\"()-"
TRIMMED = ".,;:!?\"'()"

_SPACE, _LOWER, _UPPER, _DIGIT, _MARK, _SHOUT, _SYMBOL, _LETTER, _REST = range(9)
CLASSES = 9


def _class_table() -> np.ndarray:
    table = np.full(0x3001, _REST, dtype=np.uint8)
    by_category = {"Ll": _LOWER, "Lu": _UPPER, "Lt": _UPPER, "Lm": _LETTER, "Lo": _LETTER, "Nd": _DIGIT}
    for c in range(0x3000):
        table[c] = by_category.get(unicodedata.category(chr(c)), _REST)
    for chars, kind in ((SPACES, _SPACE), (MARKS, _MARK), ("!", _SHOUT), (SYMBOLS, _SYMBOL)):
        table[[ord(c) for c in chars]] = kind
    return table


_TABLE = _class_table()


def _words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _trimmed(word: bytes) -> bytes:
    return word.strip(TRIMMED.encode()).lower()


def _repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text has twice or more."""
    if len(words) < WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    key = code[:len(code) - WINDOW + 1]
    for i in range(1, WINDOW):
        paired = key * len(ids) + code[i:len(code) - WINDOW + 1 + i]
        key = np.unique(paired, return_inverse=True)[1]
    seen = np.bincount(key)[key] > 1
    covered = np.zeros(len(code), dtype=bool)
    for i in range(WINDOW):
        covered[i:len(code) - WINDOW + 1 + i] |= seen
    return int(covered.sum())


def _repeated_lines(text: str) -> int:
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return again


@dataclass
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    common: np.ndarray    # counts of the vocabulary, and of all other words at the end

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEATED * self.n_words


def measure(text: str | None, place: dict[bytes, int]) -> Measures:
    """Base counts and both histograms of a whole text; `place` maps a common word to its bin."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    classes = np.bincount(_TABLE[np.minimum(points, 0x3000)], minlength=CLASSES)
    words = _words_of(text)
    common = np.zeros(len(place) + 1, dtype=np.int64)
    for word, n in Counter(words).items():
        common[place.get(_trimmed(word), -1)] += n
    return Measures(len(words), int(len(points) - classes[_SPACE]), int(classes[_SYMBOL]),
                    _repeated_lines(text), _repeated_words(words), classes, common)


@dataclass
class References:
    """Vocabulary of common words and, per language, its words and both summed histograms."""

    place: dict[bytes, int]
    own: dict[str, list[int]]          # bins of the language's common words
    classes: dict[str, np.ndarray]
    common: dict[str, np.ndarray]

    def distances(self, classes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest class and word distance of each row to any language; NaN where a guard applies."""
        none = np.full(len(classes), np.nan)
        if not self.classes or not len(classes):
            return none, none
        by_class = np.min([distance(classes, h) for h in self.classes.values()], axis=0)
        by_word = np.min([distance(_binned(common, self.own[lang]), _binned(h[None, :], self.own[lang])[0])
                          for lang, h in self.common.items()], axis=0)
        return (np.where(classes.sum(axis=1) >= MIN_CHARS, by_class, np.nan),
                np.where(common.sum(axis=1) >= MIN_WORDS, by_word, np.nan))

    def keeps(self, base_failed, classes: np.ndarray, common: np.ndarray, apart) -> np.ndarray:
        """Verdict of each row; an unknown distance does not speak against it."""
        chars, words = (np.maximum(h.sum(axis=1), 1) for h in (classes, common))
        return ~(np.asarray(base_failed, dtype=bool) | (apart[0] > CLASS_LIMIT + CLASS_NOISE / np.sqrt(chars))
                 | (apart[1] > WORD_LIMIT + WORD_NOISE / np.sqrt(words)))

    def keeps_texts(self, texts: list[str | None]) -> list[bool]:
        got = [measure(t, self.place) for t in texts]
        classes, common = np.array([m.classes for m in got]), np.array([m.common for m in got])
        return self.keeps([m.base_failed for m in got], classes, common, self.distances(classes, common)).tolist()


def _binned(common: np.ndarray, own: list[int]) -> np.ndarray:
    """Rows of the vocabulary reduced to one language's words and all others."""
    mine = common[:, own]
    return np.concatenate([mine, (common.sum(axis=1) - mine.sum(axis=1))[:, None]], axis=1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to the counts `q`; 1 if only one side is empty."""
    mass, whole = p.sum(axis=1), q.sum()
    p = p / np.maximum(mass, 1)[:, None]
    q = q / max(whole, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum(axis=1) for x in (p, np.broadcast_to(q, p.shape))]
    apart = np.sqrt(np.maximum(sum(parts) / 2, 0.0))
    return np.where((mass > 0) & (whole > 0), apart, np.where((mass > 0) | (whole > 0), 1.0, 0.0))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 count: int = COMMON) -> dict[str, list[bytes]]:
    """The most frequent trimmed words of each language over all its documents.

    Words are counted per slice and again map-side, so a language with most of the documents
    sends one row per word and task; only `count` words a language reach the driver.
    """
    def work(langs, texts):
        counts: dict[str, Counter] = {}
        for lang, text in zip(langs, texts):
            counts.setdefault(lang, Counter()).update(_words_of(text or ""))
        flat = []
        for lang, c in counts.items():
            trimmed: Counter = Counter()
            for w, n in c.items():
                trimmed[_trimmed(w)] += n
            flat += [(lang, w, n) for w, n in trimmed.items() if w.strip(SYMBOLS.encode())]
        return zip(*flat) if flat else ([], [], [])

    totals = (map_batches(docs.filter(F.col(lang_col).isNotNull()), [lang_col, text_col], fields(
        ("lang", T.StringType()), ("word", T.BinaryType()), ("n", T.LongType())), work)
        .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    top = totals.withColumn("_r", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.col("n").desc(), "word"))).filter(F.col("_r") <= count)
    out: dict[str, list[bytes]] = {}
    for r in top.orderBy("lang", "_r").collect():
        out.setdefault(r["lang"], []).append(bytes(r["word"]))
    return out


def measures(docs: DataFrame, place: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang") -> DataFrame:
    """(id, lang, base counts, base_failed, classes, common) of all rows, without the texts."""
    def work(ids, langs, texts):
        got = [measure(t, place) for t in texts]
        return (ids, langs, [m.n_words for m in got], [m.word_chars for m in got], [m.n_symbols for m in got],
                [m.n_dup_lines for m in got], [m.n_repeat_words for m in got], [m.base_failed for m in got],
                [m.classes.tolist() for m in got], [m.common.tolist() for m in got])

    counts = T.ArrayType(T.LongType())
    return map_batches(docs, [id_col, lang_col, text_col], fields(
        (id_col, docs.schema[id_col].dataType), ("_lang", T.StringType()), ("n_words", T.LongType()),
        ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
        ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()),
        ("classes", counts), ("common", counts)), work)


def _vocabulary(words: dict[str, list[bytes]]) -> tuple[dict[bytes, int], dict[str, list[int]]]:
    place: dict[bytes, int] = {}
    for own in words.values():
        for w in own:
            place.setdefault(w, len(place))
    return place, {lang: [place[w] for w in own] for lang, own in words.items()}


def references(measured: DataFrame, words: dict[str, list[bytes]]) -> References:
    """Histograms summed over all documents of each language of `words`."""
    place, own = _vocabulary(words)
    sized = [(c, n) for c, n in (("classes", CLASSES), ("common", len(place) + 1))]
    sums = measured.filter(F.col("_lang").isNotNull()).groupBy("_lang").agg(*[
        F.array(*[F.sum(F.col(c)[i]) for i in range(n)]).alias(c) for c, n in sized]).collect()
    hists = {c: {r["_lang"]: np.array(r[c], dtype=np.int64) for r in sums if r["_lang"] in own} for c, _ in sized}
    return References(place, own, hists["classes"], hists["common"])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distances).

    NULL and empty texts have no words and fail the base rules. A NULL language counts towards
    no reference. Without any language only the base rules decide. `class_distance` and `word_distance` are NULL under their minimum
    lengths. Repeated rows are judged each and counted each; an empty table gives no rows;
    other columns are ignored.
    """
    words = common_words(docs, text_col, lang_col)
    table = written(measures(docs, _vocabulary(words)[0], id_col, text_col, lang_col), "measures")
    refs = references(table, words)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work(classes, common, failed):
        classes, common = np.array(classes), np.array(common)
        apart = refs.distances(classes, common)
        return refs.keeps(failed, classes, common, apart), *[[None if np.isnan(x) else x for x in d] for d in apart]

    verdicts = append_batches(table, ["classes", "common", "base_failed"], fields(
        ("kept", T.BooleanType()), ("class_distance", T.DoubleType()), ("word_distance", T.DoubleType())), work)
    return verdicts.select(id_col, *counts, "base_failed", "kept", "class_distance", "word_distance")


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that the rules keep, with their own columns; texts are not shuffled."""
    words = common_words(docs, text_col, lang_col)
    table = measures(docs, _vocabulary(words)[0], id_col, text_col, lang_col)
    refs = references(table, words)
    name = free_name(docs, "kept")
    flagged = append_batches(docs, [text_col], fields((name, T.BooleanType())),
                             lambda texts: [refs.keeps_texts(texts)])
    return flagged.filter(F.col(f"`{name}`")).drop(name)
