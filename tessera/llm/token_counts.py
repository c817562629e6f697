"""Token counts with the tokenizers library, by overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets. Two neighbouring chunks are
spliced at a character position in their overlap that starts a token in both and is proven
stable: a white-space character after one that is not. No match of the tokenizer's pattern
runs from a non-space into a space, the pattern looks behind nowhere and its only look-ahead
stands behind white space, and special strings hold no white space; so no token crosses such
a position, and the tokens on each side depend on that side alone. If the overlap holds no
common stable position, it is widened to twice its length, at last to the text's end.

Other documents need no splice. By the same proof their count is the sum over the segments
between stable positions, and the library encodes each distinct segment of a block once.

Defined results: null is an empty text with no tokens; repeated rows are counted each;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import released

CHUNK = 32_768
OVERLAP = 512
#: Bytes of segments that a task remembers, at their characters and some 150 bytes around them.
CACHED_BYTES = 32_000_000
AROUND = 150
#: Control characters that Python takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_STABLE = re.compile(r"(?<=\S)(?=\s)")
_SEGMENTS = re.compile(r"\s*\S+|\s+").findall


class Counter:
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.forget()

    def forget(self) -> None:
        self.cache: dict[str, int] = {}
        self.held = 0

    def starts(self, text: str, at: int) -> list[int]:
        """Where the tokens of text start, counted from `at`. Tokens of one character share it."""
        return [at + a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def resynchronised(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Tokens of text, from chunks of `chunk` characters that share `overlap` at least."""
        total, begin, wide = 0, 0, overlap
        while True:
            end = begin + chunk + wide
            if end >= len(text) or _ODD.search(text):
                return total + len(self.tokenizer.encode(text[begin:], add_special_tokens=False))
            here = self.starts(text[begin:end], begin)
            low = end - wide
            # the next chunk starts at the first stable position of the overlap that both can share
            there = [m.start() for m in _STABLE.finditer(text, low, end)]
            common: set[int] = set()
            if there:
                following = set(self.starts(text[low:end], low))
                common = following.intersection(here, there)
            if not common:
                wide *= 2
                continue
            splice = max(common)
            total += sum(a < splice for a in here)
            begin, wide = splice, overlap

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        short = [not (len(t) > chunk or _ODD.search(t)) for t in texts]
        cut = [_SEGMENTS(t) if s else [] for t, s in zip(texts, short)]
        fresh = list(set().union(*cut).difference(self.cache)) if cut else []
        size = AROUND * len(fresh) + sum(map(len, fresh))
        if self.held + size > CACHED_BYTES and self.cache:
            self.forget()
            fresh = list(set().union(*cut))
            size = AROUND * len(fresh) + sum(map(len, fresh))
        self.held += size
        for i in range(0, len(fresh), 20_000):
            block = fresh[i : i + 20_000]
            self.cache.update(zip(block, map(len, self.tokenizer.encode_batch_fast(block, add_special_tokens=False))))
        count = self.cache.__getitem__
        return [sum(map(count, x)) if s else self.resynchronised(t, chunk) for t, s, x in zip(texts, short, cut)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024, chunk: int = CHUNK, block_rows: int = 2_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, block_rows):
                part = batch.slice(i, block_rows)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(tool.counts(texts, chunk), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )
        tool.forget()
        released()

    whole = docs.select("doc_id", F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = whole.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
