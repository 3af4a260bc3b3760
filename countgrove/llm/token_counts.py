"""Token counts of whole texts through a cache of counted contents.

A text is known by the digest of its normalised content and a tokenizer by the digest of its
library, release and vocabulary. Digests are joined to the stored counts; only distinct contents
without a count are encoded, once each, and their counts are appended to the cache.

The cache is a Parquet folder of (version, content, n_tokens), one partition per version. Each row
is right by itself, so readers of a half-written append, two writers at once or a task that ran twice
do no harm: equal contents have equal counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from importlib.metadata import version as release

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import new_path, release as drop, written
from .common import SMALL, digest_of, fields, map_batches, one_text_each, text_groups

LIMIT = 512               # tokens above which a document is over the limit
PART = 1 << 18            # code points of a text encoded at once where its tokenizer allows cuts

_CACHE = fields(("content", T.BinaryType()), ("n_tokens", T.LongType()), ("version", T.StringType()))
_CUT = re.compile(r"(?<=\S) (?=\S)")


def tokenizer_version(path: str) -> str:
    """Digest of all that decides a count: the library, its release, the vocabulary file."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    digest = hashlib.sha256(f"{library} {release(library)}\n".encode())
    with open(path, "rb") as vocabulary:
        digest.update(vocabulary.read())
    return digest.hexdigest()


def _cuts_allowed(described: dict) -> bool:
    """True where a text may be cut in front of a single space between two words.

    A byte-level splitter without added space starts a piece at such a space, and no special token reaches over it.
    """
    splitter = described.get("pre_tokenizer") or {}
    special = described.get("added_tokens") or []
    return (splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
            and described.get("normalizer") is None and described.get("post_processor") is None
            and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in special))


def _parts(text: str, size: int) -> list[str]:
    """The text in parts of `size` or some more, cut in front of single spaces between words."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    return [*out, text[start:]]


@lru_cache(maxsize=4)
def counter(path: str, part: int = PART) -> Callable[[list[str]], list[int]]:
    """Function from texts to their numbers of tokens, without begin, end or added special tokens.

    Special strings inside a text are handled as the library does by default. Long texts are encoded
    in parts where that cannot change a token, whole otherwise.
    """
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core per task
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as described:
        cut = _cuts_allowed(json.load(described))

    def count(texts: list[str]) -> list[int]:
        split = [_parts(t, part) if cut and len(t) > part else [t] for t in texts]
        flat = [p for parts in split for p in parts]
        sizes: list[int] = []
        for start, stop in text_groups(flat, part):
            sizes += [len(e) for e in tokenizer.encode_batch_fast(flat[start:stop], add_special_tokens=False)]
        at = iter(sizes)
        return [sum(next(at) for _ in parts) for parts in split]

    return count


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) of a tokenizer version, one row per content; none where the cache is new."""
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _CACHE).select("content", "n_tokens")
    return (spark.read.schema(_CACHE).parquet(cache).filter(F.col("version") == version)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def count(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text",
          limit: int = LIMIT, normalise: Callable[[Column], Column] | None = None, small: int = SMALL) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per document.

    `path` is a vocabulary file that every executor has: `.json` for tokenizers, `.model` for
    sentencepiece. `cache` is a folder that the driver and all executors share; without one a new
    folder serves this call. `normalise` may map texts that the tokenizer counts alike to one text;
    by default a NULL text is the empty one and every other stands for itself. `n_bytes` are those
    of the text as given. Repeated rows and NULL ids are counted like any other; texts of any length
    are counted whole; other columns are ignored; an empty table gives no rows.

    Digests alone are joined to the cache. Texts are reduced to one per content inside the tasks
    before they move, and where few contents are missing only their texts move at all.
    """
    spark = docs.sparkSession
    cache = cache or new_path(spark, "token-counts")
    version = tokenizer_version(path)
    plain = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalise(plain) if normalise else plain
    keyed = written(docs.select(F.col(id_col).alias("_id"), F.octet_length(plain).cast("long").alias("n_bytes"),
                                digest_of(norm).alias("content")), "digests")
    misses = written(keyed.select("content").distinct().join(stored(spark, cache, version), "content", "left_anti"), "misses")
    if misses.count():
        texts = one_text_each(docs.select(digest_of(norm).alias("content"), norm.alias("text")), misses, small)
        counted = map_batches(texts, ["content", "text"], fields(("content", T.BinaryType()), ("n_tokens", T.LongType())),
                              lambda contents, found: (contents, counter(path)(found)))
        counted.withColumn("version", F.lit(version)).write.partitionBy("version").mode("append").parquet(cache)
    drop(misses)
    counts = stored(spark, cache, version)
    return keyed.join(counts, "content", "left").select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
