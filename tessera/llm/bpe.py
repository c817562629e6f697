"""Byte-level BPE encoding and decoding by corpus-level merge replay.

A block of documents is cut into segments, from the end of one word to the end of the
next, and each distinct segment into pieces by the tokenizer's pattern. Patterns must not
match from a non-space into white space, as those of byte-level tokenizers don't; then the
cut changes no piece. The block's distinct
pieces that this worker has not met before lie end to end in one sequence of tokens, at
first one per byte. An inverted index leads from the rank of a token pair to the positions
where the pair stands. Ranks are taken in ascending order, by bands: the positions of a band's
ranks are gathered, and in waves each piece that has some merges those of its lowest rank,
left to right; only the pairs with their two neighbours enter the index anew. Pieces that go
on when few others do, such as very long ones, are set aside and replayed rank by rank.
The result of a piece equals a merge of the piece alone, lowest rank first, since merges
never cross pieces and the order of ranks inside a piece is the same.

Spark deals the documents; a task holds one block and what it remembers of segments and
pieces, bounded in bytes and dropped at the task's end. The index is one of a block's
unseen pieces: joining the ids of the corpus' distinct pieces back to their places would
shuffle a row for every word of the corpus.

Defined results: null is an empty text with no tokens; empty tables give no rows; special
strings inside texts are ordinary text; all columns of the input are passed on, and the
added one replaces a column of that name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import TwoGenerations, released

#: Bytes of segments and of pieces that a task remembers, pairs it remembers, characters of a
#: block, characters of one replay. An entry costs its text, its ids and some 200 bytes around them.
CACHED_BYTES = 48_000_000
CACHED_PAIRS = 100_000
BLOCK_CHARS = 1_000_000
REPLAYED = 100_000
AROUND = 200
#: Ends of the bands of ranks, and what a wave of merges must have: pieces, and a share of the band's positions.
BANDS = (1_024, 4_096, 1 << 20)
FEW = 32
#: Bytes of ids that are decoded at a time.
DECODED = 1_000_000
#: Control characters that Python takes for white space and patterns don't.
_ODD = re.compile("[\x1c-\x1f]")
_SEGMENTS = re.compile(r"\s*\S+|\s+").findall


class PairRanks(dict):
    """(left id << 20 | right id) -> id of the merged token, or -1."""

    def __init__(self, ranks: dict[bytes, int], tokens: dict[int, bytes]):
        self.ranks, self.tokens = ranks, tokens

    def __missing__(self, pair: int) -> int:
        merged = self.ranks.get(self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF], -1)
        self[pair] = merged
        return merged


def _ascending(places: np.ndarray) -> np.ndarray:
    """The distinct places, sorted: np.unique would hash them, at several times the cost."""
    places.sort()
    return places[np.diff(places, prepend=-1) != 0]


def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Those of the pairs at `at` that a merge from left to right takes: every other one of a run."""
    places = np.arange(len(at))
    run = np.maximum.accumulate(np.where(np.append(True, nxt[:-1] != at[1:]), places, 0))
    return at[(places - run) % 2 == 0]


def _size(keys: list[str], values: list[bytes]) -> int:
    return AROUND * len(keys) + sum(map(len, keys)) + sum(map(len, values))


class Vocabulary:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.pairs = PairRanks(self.ranks, self.tokens)
        cuts = [(-1, -1, -1)]  # so that a vocabulary without merges has a row too
        for token, rank in self.ranks.items():
            halves = ((self.ranks.get(token[:i]), self.ranks.get(token[i:])) for i in range(1, len(token)))
            cuts += [(a, b, rank) for a, b in halves if a is not None and b is not None]
        pairs = np.array(cuts, dtype=np.int64)
        codes = pairs[:, 0] << 20 | pairs[:, 1]
        order = np.argsort(codes)
        self.pair_codes, self.pair_ranks = codes[order], pairs[order, 2]
        self.token_sizes = np.zeros(max(self.tokens) + 1, dtype=np.int64)
        self.token_sizes[list(self.tokens)] = [len(token) for token in self.ranks]
        self.token_ends = np.cumsum(self.token_sizes)
        self.token_sizes[self.token_sizes == 0] = -1  # no such token: decoding it raises
        self.token_bytes = np.frombuffer(b"".join(self.tokens[rank] for rank in sorted(self.tokens)), dtype=np.uint8)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pieces = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        """Drops what texts have left behind, so that a worker holds only the vocabulary."""
        self.cache, self.segments = TwoGenerations(CACHED_BYTES), TwoGenerations(CACHED_BYTES)
        self.pairs.clear()

    def ranks_of(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each pair (left id << 20 | right id), or -1."""
        at = np.searchsorted(self.pair_codes, codes)
        at[at == len(self.pair_codes)] = 0
        return np.where(self.pair_codes[at] == codes, self.pair_ranks[at], -1)

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(x) for x in pieces])
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ends = np.cumsum(sizes)
        size = len(ids)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        right = np.arange(1, size + 1)
        right[ends - 1] = -1
        left = np.arange(-1, size - 1)
        left[ends - sizes] = -1
        now = np.full(size, -1, dtype=np.int64)  # the rank of the pair that starts at each position
        starts = np.flatnonzero(right >= 0)
        now[starts] = self.ranks_of(ids[starts] << 20 | ids[starts + 1])
        aside = np.zeros(len(pieces), dtype=bool)
        for top in BANDS:
            places = np.flatnonzero((now >= 0) & (now < top))  # the index of the band
            places = places[~aside[piece[places]]]
            while len(places):
                own = piece[places]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                least = np.minimum.reduceat(now[places], first)
                at = places[now[places] == np.repeat(least, np.diff(first, append=len(places)))]
                if len(first) < FEW or len(at) * FEW < len(places):
                    aside[own] = True
                    break
                at = _apart(at, right[at])
                nxt = right[at]
                ids[at], ids[nxt], now[nxt], right[at] = now[at], -1, -1, right[nxt]
                now[at] = -1
                inner = at[right[at] >= 0]
                left[right[inner]] = inner
                prior = left[at]
                changed = _ascending(np.concatenate([inner, prior[prior >= 0]]))
                now[changed] = self.ranks_of(ids[changed] << 20 | ids[right[changed]])
                places = _ascending(np.concatenate([places, changed]))
                places = places[(now[places] >= 0) & (now[places] < top)]
        alive = ids >= 0
        packed = ids[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive)[ends - 1] * 4).tolist()
        out = [packed[a:b] for a, b in zip([0, *stops], stops)]
        if aside.any():
            slow = np.flatnonzero(aside).tolist()
            for i, done in zip(slow, self._replay_few([np.frombuffer(out[i], dtype="<u4").astype(np.int64) for i in slow])):
                out[i] = done
        return out

    def _replay_few(self, pieces: list[np.ndarray]) -> list[bytes]:
        """replay() of pieces that are tokens already, one position at a time, by an index of single ranks."""
        flat = np.concatenate(pieces)
        ends = np.cumsum([len(x) for x in pieces])
        size = len(flat)
        after = np.arange(1, size + 1)
        after[ends - 1] = -1
        before = np.arange(-1, size - 1)
        before[ends[:-1]] = -1
        before[0] = -1
        pairs, index, heap = self.pairs, {}, []
        starts = np.flatnonzero(after >= 0)
        codes, which = np.unique(flat[starts] << 20 | flat[starts + 1], return_inverse=True)
        ranks = np.array([pairs[c] for c in codes.tolist()], dtype=np.int64)[which] if len(codes) else np.zeros(0, np.int64)
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        for group in np.split(order, cuts) if len(order) else []:
            rank = int(ranks[group[0]])
            index[rank] = starts[group].tolist()
            heappush(heap, rank)
        now = np.full(size, -1, dtype=np.int64)  # the rank of the pair that starts at each position
        now[starts] = ranks
        ids, right, left, now = flat.tolist(), after.tolist(), before.tolist(), now.tolist()
        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            if len(places) > 1:
                places.sort()
            base = rank << 20
            for at in places:
                if now[at] != rank:
                    continue  # one of the two has been merged since
                nxt, prior = right[at], left[at]
                beyond = right[nxt]
                ids[at], ids[nxt], now[nxt], right[at] = rank, -1, -1, beyond
                if beyond < 0:
                    now[at] = -1
                else:
                    left[beyond] = at
                    now[at] = r = pairs[base | ids[beyond]]
                    if r >= 0:
                        if (known := index.get(r)) is not None:
                            known.append(at)
                        else:
                            index[r] = [at]
                            heappush(heap, r)
                if prior >= 0:
                    now[prior] = r = pairs[ids[prior] << 20 | rank]
                    if r >= 0:
                        if (known := index.get(r)) is not None:
                            known.append(prior)
                        else:
                            index[r] = [prior]
                            heappush(heap, r)
        done = np.array(ids, dtype=np.int64)
        alive = done >= 0
        packed = done[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive)[ends - 1] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def _encode_segments(self, segments: list[str]) -> list[bytes]:
        cut = [self.pieces(x) for x in segments]
        known, fresh = self.cache.recall(set().union(*cut))
        part, size = [], 0
        for i, piece in enumerate(fresh):
            part.append(piece)
            size += len(piece)
            if size >= REPLAYED or i == len(fresh) - 1:
                ids = self.replay([x.encode() for x in part])
                known.update(zip(part, ids))
                self.cache.learn(part, ids, _size(part, ids))
                part, size = [], 0
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs.clear()
        return [b"".join(map(known.__getitem__, x)) for x in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if _ODD.search(t) else _SEGMENTS(t) for t in texts]
        known, fresh = self.segments.recall(set().union(*cut))
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            ids = self._encode_segments(part)
            known.update(zip(part, ids))
            self.segments.learn(part, ids, _size(part, ids))
        return [b"".join(map(known.__getitem__, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self._bytes_of(np.frombuffer(ids[i : i + DECODED], dtype="<u4")) for i in range(0, len(ids), DECODED))

    def _bytes_of(self, ids: np.ndarray) -> bytes:
        size, end = self.token_sizes[ids], self.token_ends[ids]
        ends = np.cumsum(size)
        return self.token_bytes[np.repeat(end - ends, size) + np.arange(ends[-1])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once for each worker, from the tokenizer file of its machine."""
    return Vocabulary(path, pattern)


def block_sizes(lengths: list[int], most: int = BLOCK_CHARS) -> Iterator[int]:
    """Numbers of consecutive texts with about `most` characters together, one at least."""
    n = size = 0
    for length in lengths:
        if n and size + length > most:
            yield n
            n = size = 0
        n += 1
        size += length
    if n:
        yield n


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[list[str]]:
    start = 0
    for n in block_sizes(list(map(len, texts)), most):
        yield texts[start : start + n]
        start += n


def _with_binary(df: DataFrame, name: str) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.BinaryType())])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids`: token ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            out = [x for block in blocks(texts) for x in words.encode(block)]
            keep = [n for n in batch.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(out, pa.binary())], names=[*keep, ids])
        words.forget()
        released()

    return docs.mapInArrow(run, _with_binary(docs, ids))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with `decoded`: the bytes that its ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        for batch in batches:
            out = [words.decode(x or b"") for x in batch.column(ids).to_pylist()]
            keep = [n for n in batch.schema.names if n != decoded]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(out, pa.binary())], names=[*keep, decoded])

    return encoded.mapInArrow(run, _with_binary(encoded, decoded))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, by encode and decode.

    One pass: a task encodes a block, decodes it and sends three short columns back instead
    of ids and texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path, pattern)
        digest = lambda b: sha256(b).hexdigest()
        for batch in batches:
            start = 0
            texts = batch.column(1)
            for size in block_sizes(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                ids = words.encode([t or "" for t in texts.slice(start, size).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, size),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(map(digest, ids), pa.string()),
                        pa.array([digest(words.decode(x)) for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                start += size
        words.forget()
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
