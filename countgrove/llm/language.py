"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (one to three letters, words padded by a space) of a
language by rank. A document's own list is compared with every profile by out-of-place
distance: the sum of rank differences, with the length of the profile for an n-gram it lacks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_batches, fields, held_out, map_batches, without_numerals

PROFILE = 400        # n-grams of a language profile and of a document's list
LONGEST = 3
SAMPLE = 4000        # documents a language is learned from, at most (about)
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_BITS = 21           # of a code point; three fit a signed 64-bit key
_SPACE = 32


def gram_keys(text: str | None) -> np.ndarray:
    """Keys of all n-grams of the lower-cased text; words are runs of letters inside spaces."""
    words = _NOT_LETTERS.sub(" ", without_numerals((text or "").lower())).strip()
    if not words:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    space = c == _SPACE
    keys = [c[~space]]
    key = c
    for n in range(2, LONGEST + 1):
        key = key[:-1] << _BITS | c[n - 1:]
        inner = np.zeros(len(key), dtype=bool)     # a space may begin or end an n-gram only
        for i in range(1, n - 1):
            inner |= space[i:i + len(key)]
        keys.append(key[~inner])
    return np.concatenate(keys)


def ranked(keys: np.ndarray, count: int = PROFILE) -> np.ndarray:
    """The most frequent keys; ties by key."""
    distinct, n = np.unique(keys, return_counts=True)
    if len(distinct) > count:       # only counts that can make the list are sorted
        least = np.partition(n, len(n) - count)[len(n) - count]
        distinct, n = distinct[n >= least], n[n >= least]
    return distinct[np.lexsort((distinct, -n))][:count]


@dataclass
class Profiles:
    """Languages, the sorted n-grams of all profiles, and ranks (n-gram, language)."""

    languages: list[str]
    keys: np.ndarray
    ranks: np.ndarray    # PROFILE where a language lacks the n-gram; the last row lacks all

    @classmethod
    def of(cls, lists: dict[str, list[int]]) -> Profiles:
        languages = sorted(lists)
        keys = np.unique(np.array([k for own in lists.values() for k in own], dtype=np.int64))
        ranks = np.full((len(keys) + 1, len(languages)), PROFILE, dtype=np.int64)
        for j, lang in enumerate(languages):
            ranks[np.searchsorted(keys, lists[lang]), j] = np.arange(len(lists[lang]))
        return cls(languages, keys, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of the least distance (ties: the first in order) and 1 less its share of the maximum."""
        own = ranked(gram_keys(text))
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, own)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == own[known]
        ranks = self.ranks[np.where(known, at, len(self.keys))]
        place = np.arange(len(own))[:, None]
        apart = np.where(ranks < PROFILE, np.abs(ranks - place), PROFILE).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (PROFILE * len(own)))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample: int = SAMPLE) -> Profiles:
    """Profiles of all languages from documents outside the held-out fold.

    A language with more than `sample` documents is learned from about that many, picked by
    hash of the id. N-grams are counted in the tasks and ranked per language; only the
    profiles reach the driver.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & ~held_out(id_col))
    shares = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.least(
        F.lit(1.0), sample / F.count(F.lit(1)))).collect()}
    if not shares:
        return Profiles.of({})
    bound = F.create_map(*[x for lang, s in shares.items() for x in (F.lit(lang), F.lit(float(s)))])
    unit = F.pmod(F.xxhash64(F.lit("profile"), id_col), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.filter(unit < F.element_at(bound, F.col(lang_col)))

    def work(langs, texts):
        own: dict[str, list] = {}
        for lang, text in zip(langs, texts):
            own.setdefault(lang, []).append(gram_keys(text))
        out: tuple = ([], [], [])
        for lang, keys in own.items():
            distinct, n = np.unique(np.concatenate(keys), return_counts=True)
            for column, values in zip(out, ([lang] * len(n), distinct.tolist(), n.tolist())):
                column.extend(values)
        return out

    counts = (map_batches(picked, [lang_col, text_col], fields(
        ("lang", T.StringType()), ("gram", T.LongType()), ("n", T.LongType())), work)
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    top = counts.withColumn("_r", F.row_number().over(
        Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).filter(F.col("_r") <= PROFILE)
    lists: dict[str, list[int]] = {lang: [] for lang in shares}
    for r in top.orderBy("lang", "_r").collect():
        lists[r["lang"]].append(r["gram"])
    return Profiles.of({lang: own for lang, own in lists.items() if own})


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_name: str = "lang_pred",
             score_name: str = "score") -> DataFrame:
    """All rows and columns of `docs` with the language of the whole text and a score in 0..1.

    A NULL text, and one without letters, is `und` with score 0, as is every text without any
    profile. Texts alone decide, so equal texts agree; repeated rows are scored each; an empty
    table gives no rows. The two names must be free.
    """
    return append_batches(docs, [text_col], fields((lang_name, T.StringType()), (score_name, T.DoubleType())),
                          lambda texts: zip(*[profiles.predict(t) for t in texts]))
