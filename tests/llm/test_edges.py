"""Empty tables, repeated rows, clashing names, ties and very long texts where no other test has them."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, language, mixing, near_dedup, neighbours, token_counts
from tessera.llm.queries import BPE_TOKENIZER, COUNT_TOKENIZER
from tests.conftest import SF
from tests.llm.test_operators import docs

COUNTS, RANKS = public_tokenizers.path(COUNT_TOKENIZER), public_tokenizers.path(BPE_TOKENIZER)


def test_token_counts_of_repeated_rows_and_clashing_names(spark):
    rows = docs(spark, "one two", None, "one two", "x " * 100_000)
    twice = rows.union(rows).withColumns({"n_tokens": F.lit("a"), "n_bytes": F.lit("b"), "over_limit": F.lit("c")})
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(twice, COUNTS).collect())
    assert got[::2] == got[1::2] and got[0] == (0, 7, 2, False) and got[2] == (1, 0, 0, False) and got[6][3]
    assert token_counts.token_counts(rows.limit(0), COUNTS).count() == 0


def test_bpe_of_empty_tables_and_repeated_rows(spark):
    rows = docs(spark, "one two", None, "", "one two")
    got = sorted(map(tuple, bpe.digests(rows.union(rows), RANKS, public_tokenizers.PATTERN).collect()))
    nothing = hashlib.sha256(b"").hexdigest()
    assert got[::2] == got[1::2] and [r[1] for r in got[::2]] == [2, 0, 0, 2] and got[2][2:] == (nothing, nothing)
    assert got[0][3] == hashlib.sha256(b"one two").hexdigest() and got[0][1:] == got[6][1:]
    assert bpe.digests(rows.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.decode(bpe.encode(rows.limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


def _merged(words: bpe.Vocabulary, piece: bytes) -> list[int]:
    """The ids of a piece alone, one merge at a time, the leftmost of the lowest rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranks = [words.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == 1 << 30:
            return [words.ranks[x] for x in parts]
        at = ranks.index(min(ranks))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_bpe_merges_pieces_in_waves_and_only_odd_ones_alone(monkeypatch):
    words, rng = bpe.vocabulary(RANKS, public_tokenizers.PATTERN), random.Random(4)
    parts = [" ", "a", "aa", "ab", "e", "er", "tion", "che", "é", "=", "ment"]
    pieces = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))).encode() for _ in range(3_000)] + [b"=" * 3_000, b"ab" * 800 + b"a", b"a" * 333, b"\xff\xfe"]
    alone, few = [], words._replay_few
    monkeypatch.setattr(words, "_replay_few", lambda some: alone.extend(some) or few(some))
    assert [list(np.frombuffer(x, dtype="<u4")) for x in words.replay(pieces)] == [_merged(words, x) for x in pieces]
    assert 0 < len(alone) < 0.1 * len(pieces)
    for piece in pieces[:40] + pieces[-4:]:
        assert list(np.frombuffer(words.replay([piece])[0], dtype="<u4")) == _merged(words, piece)
        assert words.decode(words.replay([piece])[0]) == piece


def test_mixing_of_repeated_ids_and_a_very_long_text(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (1, "c", "y"), (None, "d e", "y"), (2, "w " * 200_000, "z")], "doc_id long, text string, source string")
    rows = rows.withColumns({"size": F.lit("s"), "taken": F.lit("t"), "key": F.lit("k"), "target": F.lit("g")})
    found = mixing.mix(rows).collect()
    assert sorted(r.size for r in found) == [1, 2, 2, 2, 200_000] and all(0 <= r.taken <= 2 * r.size for r in found)
    assert sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(rows.repartition(3)).collect()) == sorted((str(r.doc_id), r.size, r.taken) for r in found)


def test_languages_of_repeated_rows_and_a_very_long_text(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    long = real.limit(1).withColumn("text", F.repeat(F.lit("the quick brown fox and the lazy dog "), 20_000))
    found = language.languages(real.union(real.filter("doc_id < 20")).union(long)).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, set()).add((r.lang_pred, round(r.score, 9)))
    assert len(found) == real.count() + 21 and all(len(by_id[i]) == 1 for i in range(1, 20))


def test_neighbours_of_equal_cosine_go_by_id(spark):
    rows = [(50, [1.0, 0.0])] + [(i, [2.0**i, 2.0**i]) for i in range(1, 8)] + [(9, [1.0, -1.0])]
    found = neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in found) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)] and len({r.score for r in found}) == 1


def test_near_duplicates_of_very_long_texts(spark):
    long = " ".join(f"w{i % 977}x{i % 1009}" for i in range(60_000))
    found = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs(spark, long, long + " tail", "else", long[: len(long) // 2]), width=4).collect()}
    assert found == {0: (0, True), 1: (0, False), 2: (2, True), 3: (3, True)}
