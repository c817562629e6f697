"""Alignment of two tokenizers' tokens by pointer jumping.

Tokenizer A (tokenizers, byte-level) and B (sentencepiece, byte fallback) encode the same
text. Each token points to the farthest-right token of the other side that overlaps it, or
to itself where none ends farther right; of two that end together, A's points to B's. All
pointers of a block are doubled at once (successor of the successor) until none changes;
then each token points at its component's terminal token, whose place labels its group.

A task cuts texts before each space behind a non-space. No token of either side crosses
such a place: A's pattern never runs from a non-space into a space, and no piece of B holds
a space behind another character (checked when the file is read). So both encodings are
the segments' encodings one behind the other, groups too: segments that were met before are
not encoded again, and new ones are encoded and aligned many at a time. Where bytes come
back changed, the segments are told apart by halves, and the texts that hold one of those
changed are encoded whole.

Links are counted over the corpus by the number of the pair of ids. Tokens that end
together have one as a suffix of the other, so the vocabularies alone give the list of
pairs that can ever be linked (some hundreds of thousands, whatever the corpus); counts are
kept by place in that list, collected and sent to the tasks as two arrays of its length.
Documents go through the encoders once: their links are written, four bytes each, into the
shared folder, counted from there, and scored from there.

Defined results: null and empty texts, and texts that either side gives back changed (such
as those that hold U+2581), have no tokens and only zeros; special strings inside texts are
plain text; repeated rows are counted each; texts of any length are taken whole; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import block_sizes
from tessera.llm.common import TwoGenerations, released, staged

SPACE = "▁"
#: Segments that are looked up together, characters that are encoded and aligned together,
#: and bytes of segments that a task remembers.
SEGMENTS = 20_000
TOGETHER = 100_000
CACHED_BYTES = 128_000_000
#: What an entry costs besides its text, links and groups.
AROUND = 400
_CUT = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+").findall
NOTHING = (0, 0, 0, b"", b"")


def byte_level() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairNames(dict):
    """Place in `pairs` -> `a|b` of a group of these two tokens alone; no more entries than pairs."""

    def __init__(self, pairs: np.ndarray, width: int):
        self.pairs, self.width = pairs, width

    def __missing__(self, place: int) -> bytes:
        self[place] = name = b"%d|%d" % divmod(int(self.pairs[place]), self.width)
        return name


class Tokenizers:
    """The two tokenizers, the bytes of their tokens, and the pairs of tokens that can be linked."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_level()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        #: whether texts may be cut before a space behind a non-space
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.blank = self.b.piece_to_id(SPACE)
        self.a_size = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.a_name, self.b_name = [b"%d" % i for i in range(len(self.a_bytes))], [b"%d" % i for i in range(len(self.b_bytes))]
        self.pairs = self._pairs()
        self.names = PairNames(self.pairs, len(self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.cache = TwoGenerations(CACHED_BYTES)

    def _pairs(self) -> np.ndarray:
        """a * len(b_bytes) + b, ascending, of all pairs one of which is a suffix of the other."""
        found = set()
        width = len(self.b_bytes)
        by_bytes_a, by_bytes_b = {}, {}
        for known, tokens in ((by_bytes_a, self.a_bytes), (by_bytes_b, self.b_bytes)):
            for i, token in enumerate(tokens):
                known.setdefault(token, []).append(i)
        for token, ids in by_bytes_a.items():
            for start in range(len(token)):
                for b in by_bytes_b.get(token[start:], ()):
                    found.update(a * width + b for a in ids)
        for token, ids in by_bytes_b.items():
            for start in range(1, len(token)):
                for a in by_bytes_a.get(token[start:], ()):
                    found.update(a * width + b for b in ids)
        return np.array(sorted(found), dtype=np.int64)

    def align(self, texts: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, links, groups) of each text, which starts with a space.

        links holds places of `pairs`, four bytes each; None where the tokens' bytes differ
        from the text.
        """
        out: list[tuple | None] = [None] * len(texts)
        waiting = [[i for i, t in enumerate(texts) if self.cuts and not t[-1].isspace()]]
        waiting = [[i] for i in sorted(set(range(len(texts))).difference(waiting[0]))] + waiting
        while waiting:
            some = waiting.pop()
            for size in block_sizes([len(texts[i]) for i in some], TOGETHER) if len(some) > 1 else [len(some)]:
                part, some = some[:size], some[size:]
                found = self._together([texts[i] for i in part]) if part else []
                if found is not None:
                    for i, x in zip(part, found):
                        out[i] = x
                elif len(part) > 1:
                    waiting += [part[: size // 2], part[size // 2 :]]
        return out

    def _together(self, texts: list[str]) -> list[tuple] | None:
        """align() of texts that may stand one behind the other, encoded as one; None if bytes differ."""
        whole = "".join(texts)
        raw = whole.encode()
        a_ids = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        b_ids = self.b.encode(whole[1:]) or [self.blank]  # which puts the space back
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return None
        sizes = map(len, texts) if len(raw) == len(whole) else (len(t.encode()) for t in texts)
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(texts)))
        a, b = np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        terminal = pointers(a_end, b_end)
        last = np.unique(terminal) - len(a)  # B's tokens that end their groups
        stop = b_end[last]
        a_stop, b_stop = np.searchsorted(a_end, stop) + 1, last + 1
        a_start, b_start = np.append(0, a_stop[:-1]), np.append(0, b_stop[:-1])
        places = np.searchsorted(self.pairs, a[a_stop - 1] * len(self.b_bytes) + b[last])
        alone = ((a_stop - a_start == 1) & (b_stop - b_start == 1)).tolist()
        a_name, b_name, names = [self.a_name[i] for i in a_ids], [self.b_name[i] for i in b_ids], self.names
        spans = zip(alone, places.tolist(), a_start.tolist(), a_stop.tolist(), b_start.tolist(), b_stop.tolist())
        groups = [names[p] if one else b",".join(a_name[i:j]) + b"|" + b",".join(b_name[k:n]) for one, p, i, j, k, n in spans]
        n_a, n_b, to = (np.searchsorted(x, ends) + 1 for x in (a_end, b_end, stop))
        counts = [np.diff(x, prepend=0).tolist() for x in (n_a, n_b, to)]
        links, to = places.astype("<u4").tobytes(), to.tolist()
        return [(x, y, n, links[4 * (t - n) : 4 * t], b";".join(groups[t - n : t])) for x, y, n, t in zip(*counts, to)]

    def documents(self, texts: list[str]) -> list[tuple]:
        """The same of whole documents, to which the space is added here."""
        whole = [" " + t if t else "" for t in texts]
        cut = [(_CUT(t) if self.cuts else [t]) if t else [] for t in whole]
        known, fresh = self.cache.recall(set().union(*cut))
        for i in range(0, len(fresh), SEGMENTS):
            part = fresh[i : i + SEGMENTS]
            found = self.align(part)
            known.update(zip(part, found))
            self.cache.learn(part, found, sum(AROUND + len(t) + (len(x[3]) + len(x[4]) if x else 0) for t, x in zip(part, found)))
        out = []
        for text, segments in zip(whole, cut):
            rows = [known[s] for s in segments]
            if not rows:
                out.append(NOTHING)
            elif None in rows:
                out.append(self.align([text])[0] or NOTHING)
            else:
                n_a, n_b, n, links, groups = zip(*rows)
                out.append((sum(n_a), sum(n_b), sum(n), b"".join(links), b";".join(groups)))
        return out


def pointers(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """The terminal token of each token's component: A's tokens first, then B's, by place.

    The ends are ascending, over the same bytes. Jumps double until no pointer changes.
    """
    n = len(a_end)
    over_a = n + np.searchsorted(b_end, a_end)  # the B token that holds A's last byte
    over_b = np.searchsorted(a_end, b_end)
    over_b = np.where(a_end[over_b] > b_end, over_b, n + np.arange(len(b_end)))
    to = np.concatenate([over_a, over_b])
    while True:
        beyond = to[to]
        if np.array_equal(beyond, to):
            return to
        to = beyond


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """Read once for each worker, from the files of its machine."""
    return Tokenizers(a_path, b_path)


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, links, groups of each document.

    groups is its text (`a1,a2|b1;a3|b2`), or the text's SHA-256; links holds the place of
    each link's pair in Tokenizers.pairs, as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(a_path, b_path)
        for batch in batches:
            start = 0
            for size in block_sizes(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
                found = tools.documents([t or "" for t in batch.column(1).slice(start, size).to_pylist()])
                groups = [(sha256(x[4]).hexdigest() if x[4] else "") if digest else x[4].decode() for x in found]
                counts = [pa.array([x[i] for x in found], pa.int64()) for i in range(3)]
                columns = [batch.column(0).slice(start, size), *counts, pa.array([x[3] for x in found], pa.binary()), pa.array(groups, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "links", "groups"])
                start += size
        tools.forget()
        released()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, links binary, groups string")


def _places(links: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(links.to_pylist()), dtype="<u4")


def link_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """place, n: how many links of the corpus hold the pair at each place; pairs without links are left out.

    A task adds its documents up before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(_places(batch.column(0)), minlength=n_pairs)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["place", "n"])

    return aligned.select("links").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    aligned = staged(align(docs, a_path, b_path, digest=True), "aligned")
    spark = docs.sparkSession
    tools = tokenizers(a_path, b_path)
    pairs, width = tools.pairs, len(tools.b_bytes)
    found = link_counts(aligned, len(pairs)).toArrow()  # at most one row per pair of the list
    counts = np.zeros(len(pairs), dtype=np.int64)
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(width, dtype=np.int64)
    np.maximum.at(highest, pairs % width, counts)
    known = spark.sparkContext.broadcast((counts, counts == highest[pairs % width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = known.value
        for batch in batches:
            n, n_best, total = [], [], []
            for links in batch.column(4).to_pylist():
                places = np.frombuffer(links, dtype="<u4")
                n.append(len(places))
                n_best.append(int(best[places].sum()))
                total.append(int(counts[places].sum()))
            added = [pa.array(x, pa.int64()) for x in (n, n_best, total)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *added, batch.column(5)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return aligned.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
