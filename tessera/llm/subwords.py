"""Character n-grams of words, hashed for many words at once."""

from __future__ import annotations

import re

import numpy as np

#: Runs of word characters, lower-cased; digits and underscores count as such.
words_of = re.compile(r"\w+").findall


def hashed_ngrams(words: list[str], sizes: tuple[int, ...], buckets: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each word), n-grams grouped by word.

    Words are framed by < and >, so that prefixes and suffixes are n-grams of their own.
    whole adds the framed word itself.
    """
    text = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(codes))  # characters to the word's end
    owner, hashed = [], []
    rolling = np.zeros(len(codes), dtype=np.uint64)
    prime = np.uint64(0x100000001B3)
    for n in range(1, min(max(sizes), len(codes)) + 1):
        rolling[: len(codes) - n + 1] = (rolling[: len(codes) - n + 1] ^ codes[n - 1 :]) * prime
        if n in sizes:
            fits = np.flatnonzero(left >= n)
            owner.append(word[fits])
            hashed.append(rolling[fits] + np.uint64(n))
    if whole:
        powers = np.cumprod(np.full(int(lengths.max(initial=1)), prime, dtype=np.uint64))
        owner.append(np.arange(len(words)))
        hashed.append(np.add.reduceat(codes * powers[left - 1], ends - lengths) if len(words) else np.zeros(0, np.uint64))
    owner, hashed = np.concatenate(owner), np.concatenate(hashed)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(owner, kind="stable")
    return ((hashed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


class WordRows:
    """Rows of values for words: computed by block, remembered up to a bound."""

    def __init__(self, compute, width: int, most: int = 150_000):
        self.compute, self.width, self.most = compute, width, most
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, self.width))

    def sums(self, documents: list[list[str]]) -> np.ndarray:
        """The sum of the rows of each document's words."""
        fresh = list(set().union(*documents).difference(self.at)) if documents else []
        if len(self.at) + len(fresh) > self.most:
            self.forget()
            fresh = list(set().union(*documents))
        if fresh:
            self.at.update(zip(fresh, range(len(self.at), len(self.at) + len(fresh))))
            self.rows = np.concatenate([self.rows, *(self.compute(fresh[i : i + 50_000]) for i in range(0, len(fresh), 50_000))])
        out = np.zeros((len(documents), self.width))
        for i, words in enumerate(documents):
            if words:
                at = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
                out[i] = self.rows[at].sum(axis=0)
        return out
