"""Byte-level BPE encoding and decoding with padded matrices.

A slice of texts is split by the pattern, its distinct pieces are sorted into length buckets,
and each bucket is one matrix of token ids padded with -1. Every round looks up the rank of
all neighbouring pairs in a hash table, merges the leftmost pair of minimum rank in every row
that has one, closes the gap, and retires finished rows. Pieces that are longer than the
widest bucket merge in the same order through a queue, so run time stays near-linear in them.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, map_batches

NONE = np.iinfo(np.int32).max
WIDEST = 256         # bytes of the widest matrix row
CELLS = 1 << 18      # matrix cells handled at once
KEPT_PIECES = 200000  # encoded pieces a worker remembers between slices


class Ranks:
    """Vocabulary of a rank file with a hash table over mergeable pairs of ids."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.size = max(vocabulary.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in vocabulary.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([vocabulary[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(vocabulary[t[:i]], vocabulary[t[i:]], rank) for t, rank in vocabulary.items()
                 for i in range(1, len(t)) if t[:i] in vocabulary and t[i:] in vocabulary]
        self._build(np.array(pairs, dtype=np.int64).reshape(-1, 3))

    def _build(self, pairs: np.ndarray) -> None:
        """Open addressing with linear probing; keys are placed in rounds, one per free slot."""
        bits = max(4, int(4 * len(pairs)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, dtype=np.int64)
        self._ranks = np.full(1 << bits, NONE, dtype=np.int32)
        keys, ranks = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        slot = self._slot(keys)
        self._probes = 1
        while keys.size:
            free = np.nonzero(self._keys[slot] == -1)[0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self._keys[slot[first]] = keys[first]
            self._ranks[slot[first]] = ranks[first]
            rest = np.ones(keys.size, dtype=bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
            slot = (slot[rest] + 1) & self._mask
            self._probes += bool(keys.size)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self._shift).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where the pair does not merge (or an id is -1)."""
        out = np.full(left.shape, NONE, dtype=np.int32)
        where = np.nonzero((left >= 0) & (right >= 0))
        keys = left[where].astype(np.int64) << 32 | right[where]
        slot = self._slot(keys)
        found = np.full(keys.size, NONE, dtype=np.int32)
        todo = np.arange(keys.size)
        for _ in range(self._probes):
            held = self._keys[slot[todo]]
            hit = held == keys[todo]
            found[todo[hit]] = self._ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            if not todo.size:
                break
            slot[todo] = (slot[todo] + 1) & self._mask
        out[where] = found
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            n = len(piece)
            if n > WIDEST:
                out[k] = self._encode_long(piece)
            else:
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(k)
        for width, rows in sorted(buckets.items()):
            step = max(1, CELLS // max(width, 1))
            for s in range(0, len(rows), step):
                part = rows[s:s + step]
                for k, ids in zip(part, self._merge_rows([pieces[k] for k in part], width)):
                    out[k] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8)
        length = np.array([len(p) for p in pieces])
        ids = self.byte_ids[raw.reshape(len(pieces), width)]
        ids[np.arange(width)[None, :] >= length[:, None]] = -1
        out: list[bytes] = [b""] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.lookup(ids[:, :-1], ids[:, 1:])
        while row.size:
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(row.size, dtype=np.int64)
            low = rank[np.arange(row.size), best] if rank.shape[1] else np.full(row.size, NONE)
            done = low == NONE
            if done.any():
                counts = (ids[done] >= 0).sum(axis=1)
                for k, line, n in zip(row[done], ids[done].astype("<u4"), counts):
                    out[k] = line[:n].tobytes()
                live = ~done
                row, ids, rank, best, low = row[live], ids[live], rank[live], best[live], low[live]
                if not row.size:
                    break
            at = np.arange(row.size)
            ids[at, best] = low
            ids = _without(ids, best + 1)
            rank = _without(rank, best)
            for side in (best - 1, best):  # the two pairs that hold the new token
                on = np.nonzero((side >= 0) & (side < rank.shape[1]))[0]
                j = side[on]
                rank[on, j] = self.lookup(ids[on, j], ids[on, j + 1])
        return out

    def _encode_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece: a queue of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        ranks = self.lookup(ids[:-1], ids[1:])
        ids, end = ids.tolist(), len(piece)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        queue = [(int(ranks[i]), i, ids[i], ids[i + 1]) for i in np.nonzero(ranks != NONE)[0].tolist()]
        heapq.heapify(queue)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i] if ids[i] == left else end
            if j >= end or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < end:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end:
                    found = self._rank_of(ids[a], ids[b])
                    if found != NONE:
                        heapq.heappush(queue, (found, a, ids[a], ids[b]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def _rank_of(self, left: int, right: int) -> int:
        return int(self.lookup(np.array([left]), np.array([right]))[0])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join([self.tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _without(m: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The matrix less one column of each row; later columns move one to the left."""
    at = np.arange(m.shape[1] - 1)[None, :]
    return np.take_along_axis(m, at + (at >= column[:, None]), axis=1)


def _latin(pattern: str):
    """The pattern for texts up to U+00FF, with its classes spelled out for the faster `re` module.

    None where the pattern uses other escapes; the general expression then serves all texts.
    """
    classes = {name: "".join(f"\\x{c:02x}" for c in range(256) if regex.fullmatch(name, chr(c)))
               for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in regex.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, flags=regex.DOTALL):
        if part in classes:
            out.append(classes[part] if inside else f"[{classes[part]}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
        elif part.startswith("\\"):
            return None
        else:
            inside = part == "[" or inside and part != "]"
            out.append(part)
    return re.compile("".join(out)).findall


class Encoder:
    """Splits texts, encodes the distinct pieces of a slice and joins them again."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks = ranks
        self._general = regex.compile(pattern).findall
        self._narrow = _latin(pattern) or self._general
        self._known: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._general(text)
        return self._narrow(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self._split(t or "") for t in texts]
        seen = set()
        for line in pieces:
            seen.update(line)
        fresh = list(seen.difference(self._known))
        if len(self._known) + len(fresh) > KEPT_PIECES:
            self._known, fresh = {}, list(seen)
        self._known.update(zip(fresh, self.ranks.encode_pieces([p.encode() for p in fresh])))
        ids = self._known.__getitem__
        return [b"".join(map(ids, line)) for line in pieces]


@lru_cache(maxsize=4)
def _ranks(path: str) -> Ranks:
    with open(path, "rb") as lines:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text, packed as little-endian unsigned 32-bit integers.

    `path` names a rank file that every executor has (a tokenizer's vocabulary is installed, not
    shipped) and `pattern` the expression that splits a text before merging; special tokens are
    ordinary text. NULL and empty texts give an empty sequence; repeated rows are encoded each;
    an empty table gives no rows; other columns are ignored.
    """
    def work(keys, texts):
        return keys, _encoder(path, pattern).encode(texts)

    return map_batches(docs, [id_col, text_col], fields(
        (id_col, docs.schema[id_col].dataType), ("ids", T.BinaryType())), work)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): packed ids with the bytes they stand for; NULL ids stay NULL."""
    def work(keys, ids):
        ranks = _ranks(path)
        return keys, ids, [None if i is None else ranks.decode(i) for i in ids]

    return map_batches(encoded, [id_col, "ids"], fields(
        (id_col, encoded.schema[id_col].dataType), ("ids", T.BinaryType()), ("decoded", T.BinaryType())), work)


def token_ids(packed: str = "ids"):
    """Packed ids as an array of numbers."""
    digits = F.hex(packed)
    places = F.sequence(F.lit(0), (F.octet_length(packed) / 4).cast("int") - 1)
    return F.when(F.octet_length(packed) > 0, F.transform(places, lambda i: F.conv(F.concat(*[
        F.substring(digits, i * 8 + (7 - 2 * b), F.lit(2)) for b in range(4)]), 16, 10).cast("long"))
    ).otherwise(F.array().cast("array<bigint>"))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): `encode` and `decode` of each text by one worker."""
    def work(keys, texts):
        ids = _encoder(path, pattern).encode(texts)
        return keys, ids, [_ranks(path).decode(i) for i in ids]

    return map_batches(docs, [id_col, text_col], fields(
        (id_col, docs.schema[id_col].dataType), ("ids", T.BinaryType()), ("decoded", T.BinaryType())), work)


def round_trip_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    return round_trip(docs, path, pattern, id_col, text_col).select(
        id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
