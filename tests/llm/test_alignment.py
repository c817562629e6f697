"""Tokenizer alignment against a plain walk over whole texts' byte offsets."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.common import TwoGenerations
from tests.conftest import SF

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, n_a string, links int"
ODD = [
    None, "", " ", "   ", "x", " x", "a ", "a  b", "\n", " \n ", "tail \n\n", "tab\tand\x0b\x1c\x1f more", "▁", "with ▁ in it", "<|endoftext|> <s> </s> <unk> <0x41>",
    "日本語の長い文章。" * 30, "é è ﬁ ｆｕｌｌ　width", "emoji 😀😀 👩‍👩‍👧", "\x00 nul", " no break　", "Don't  can't\r\nwon't", "x " * 400, "y" * 3_000, "a\n b\tc  d\n",
]


def plain_alignment(rows):
    """Rows (doc_id, text) by whole encodings, a walk over offsets, and counts in dictionaries."""
    a_tool, b_tool = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a_tool.encode_special_tokens = True
    decode = {}
    for b in range(256):
        (c,) = a_tool.encode(bytes([b]).decode("latin-1"), add_special_tokens=False).tokens[-1:]
        if b < 128:
            decode[c] = b
    letters = alignment.byte_level()
    assert all(letters[c] == b for c, b in decode.items())

    def b_bytes(i):
        piece = b_tool.id_to_piece(i)
        return bytes.fromhex(piece[3:5]) if b_tool.is_byte(i) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        groups, links, a, b = [], [], [], []
        if text:
            coded = a_tool.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(letters[c] for c in t)) for i, t in zip(coded.ids, coded.tokens)]
            b = [(i, b_bytes(i)) for i in b_tool.encode(text)]
            raw = (" " + text).encode()
            if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
                a = b = []
        ends = []
        for side in (a, b):
            at, out = 0, {}
            for i, x in side:
                at += len(x)
                out[at] = i
            ends.append(out)
        cuts = sorted(ends[0].keys() & ends[1].keys())
        for low, high in zip([0, *cuts], cuts):
            parts = [",".join(str(i) for end, i in side.items() if low < end <= high) for side in ends]
            groups.append("|".join(parts))
            links.append((ends[0][high], ends[1][high]))
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return sorted(
        (doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc_id, n_a, n_b, groups, links in found
    )


def rows_of(frame):
    return sorted(tuple(r) for r in alignment.alignment(frame, A_PATH, B_PATH).collect())


def test_documents_equal_a_plain_walk(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = real + [(10_000 + i, t) for i, t in enumerate(ODD)] + real[:3]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS)
    assert rows_of(frame) == plain_alignment(rows)
    assert rows_of(frame.limit(0)) == []


def test_random_strings_equal_a_plain_walk(spark):
    rng = random.Random(3)
    letters = ["a", "the", "é", " ", "  ", "\n", "\t", "▁", "日", "😀", "'s", ".", "\x1d", " ", "Z9", "<s>"]
    weights = [9, 9, 3, 20, 3, 3, 1, 0.3, 3, 2, 2, 4, 1, 1, 2, 1]
    rows = [(i, "".join(rng.choices(letters, weights, k=rng.randrange(40)))) for i in range(1_500)]
    assert rows_of(spark.createDataFrame([(*r, None, None) for r in rows], DOCS)) == plain_alignment(rows)


def test_groups_are_given_as_text_and_links_as_places(spark):
    frame = spark.createDataFrame([(1, "Hello wörld", None, None)], DOCS)
    (row,) = alignment.align(frame, A_PATH, B_PATH).collect()
    assert row.groups.count(";") == row.n_groups - 1 == len(row.links) // 4 - 1
    tools = alignment.tokenizers(A_PATH, B_PATH)
    a, b = np.divmod(tools.pairs[np.frombuffer(row.links, "<u4")], len(tools.b_bytes))
    assert [(x.split("|")[0].split(",")[-1], x.split("|")[1].split(",")[-1]) for x in row.groups.split(";")] == [(str(i), str(j)) for i, j in zip(a, b)]


@pytest.mark.parametrize("seed", range(5))
def test_pointers_reach_the_end_of_each_component(seed):
    rng = np.random.default_rng(seed)
    a, b = (np.unique(np.append(rng.integers(1, 60, 25), 60)) for _ in range(2))
    found = alignment.pointers(a, b)
    common = np.intersect1d(a, b)
    want = [len(a) + int(np.searchsorted(b, common[np.searchsorted(common, end)])) for end in [*a, *b]]
    assert found.tolist() == want


def test_what_is_remembered_stays_bounded():
    cache = TwoGenerations(1_000)
    for i in range(500):
        keys = {f"k{j}" for j in range(i, i + 5)} | {"hot"}
        known, fresh = cache.recall(keys)
        assert set(known) | set(fresh) == keys
        cache.learn(fresh, fresh, 10 * len(fresh))
        assert len(cache.young) + len(cache.old) <= 110
    assert "hot" in cache.young or "hot" in cache.old
