"""The splitters against a plain version of the rule, and their invariants."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking as ck
from tests.conftest import SF


def plain_split(text, size, overlap, separators=ck.PROSE):
    """The rule in plain Python: cut at the first separator that occurs, merge greedily, recurse."""
    if not separators:
        return [text]
    if separators[0] == "":
        pieces = list(text)
    else:
        parts = [p for p in re.split(f"((?:{separators[0]}))", text)]
        pieces = [a + b for a, b in zip(parts[0::2], parts[1::2] + [""])]
    out, open_ = [], []
    for piece in filter(None, pieces):
        if len(piece) >= size:
            if open_:
                out.append("".join(open_))
            out += plain_split(piece, size, overlap, separators[1:])
            open_ = []
            continue
        if open_ and sum(map(len, open_)) + len(piece) > size:
            out.append("".join(open_))
            while open_ and (sum(map(len, open_)) > overlap or sum(map(len, open_)) + len(piece) > size):
                open_.pop(0)
        open_.append(piece)
    return out + (["".join(open_)] if open_ else [])


def test_recursive_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("text", ck.recursive_chunks(F.col("text"), 300, 50).alias("chunks")).collect()
    for row in rows:
        want = [re.sub("\n{2,}", "\n", c.strip()) for c in plain_split(row.text, 300, 50)]
        assert row.chunks == [c for c in want if c]


def test_children_stay_inside_their_parents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    parents = ck.parent_chunks(docs)
    joined = ck.child_chunks(parents).join(parents, ["doc_id", "parent_ix"])
    assert joined.filter(~F.contains("parent", F.col("text"))).count() == 0


def test_edge_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "x" * 5000)], "doc_id long, text string")
    found = {r.doc_id: r for r in rows.select("doc_id", ck.recursive_chunks(F.col("text")).alias("r"), ck.structure_split(F.col("text")).alias("s"), ck.semantic_break_chunks(ck.with_vectors(F.split(F.coalesce("text", F.lit("")), "\n"))).alias("m")).collect()}
    assert [found[i].r for i in (1, 2, 3)] == [[], [], []] and found[4].r == ["x" * 5000]
    assert found[1].s == [] and found[4].s == ["x" * 5000]


def plain_chunks(text, size, overlap, separators=ck.PROSE):
    cut = [re.sub("\n{2,}", "\n", c.strip()) for c in plain_split(text, size, overlap, separators)]
    return [c for c in cut if c]


def plain_vector(sentence):
    out = [0.0] * 16
    for word in sentence.lower().split():
        out[zlib.crc32(word.encode()) % 16] += 1
    return out


def plain_semantic(text, similar=0.74, least=220, most=520):
    sentences = [s.strip() for s in re.findall("[^。！？!?；;\n]+[。！？!?；;\n]?", text)]
    sentences = [s for s in sentences if s] or [text]
    out, open_, last = [], sentences[0], plain_vector(sentences[0])
    size = len(open_)
    for sentence in sentences[1:]:
        vector = plain_vector(sentence)
        norms = math.sqrt(sum(x * x for x in last)) * math.sqrt(sum(x * x for x in vector))
        cosine = sum(x * y for x, y in zip(last, vector)) / norms if norms else 0.0
        if cosine < similar and size >= least or size + len(sentence) > most:
            out.append(open_.strip())
            open_, size = sentence, len(sentence)
        else:
            open_, size = open_ + sentence, size + len(sentence)
        last = vector
    return [*out, open_.strip()]


def plain_structure(text, least=80):
    out, buffer = [], ""
    for part in filter(None, (p.strip() for p in re.split("\n\\s*\n+", text))):
        if len(buffer) < least:
            buffer = f"{buffer}\n{part}" if buffer else part
        else:
            out.append(buffer)
            buffer = part
    return [*out, buffer] if buffer else out


def plain_hybrid(text, most=520, overlap=50):
    items = [i for p in plain_structure(text) for i in ([p] if len(p) <= most else plain_semantic(p, most=most))]
    pieces = [c for i in items for c in ([i] if len(i) <= most else plain_chunks(i, most, 0))]
    pieces = [c for c in (re.sub("\n{2,}", "\n", p).strip() for p in pieces) if c]
    out = []
    for piece in pieces:
        out.append((out[-1][-overlap:] if out else "") + piece)
    return out


def digests(rows):
    return sorted((*key, hashlib.md5(text.encode()).hexdigest()) for key, text in rows)


@pytest.mark.parametrize(
    "name, plain",
    [
        ("markdown_chunks", lambda t: plain_chunks(t, ck.PARENT, ck.OVERLAP, ck.MARKDOWN)),
        ("semantic_break_chunks", plain_semantic),
        ("hybrid_chunks", plain_hybrid),
        ("recursive_chunks", lambda t: plain_chunks(t, ck.PARENT, ck.OVERLAP)),
    ],
)
def test_queries_equal_the_plain_rule(spark, name, plain):
    from tessera.plans import registry

    registry.load()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = digests(((r.doc_id, i), c) for r in docs for i, c in enumerate(plain(r.text or "")))
    got = sorted((r.doc_id, r.chunk_ix, r.chunk_md5) for r in registry.QUERIES[name](spark, SF).collect())
    assert got == want


def test_parents_and_children_equal_the_plain_rule(spark):
    from tessera.plans import registry

    registry.load()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = digests(((r.doc_id, p, c), child) for r in docs for p, parent in enumerate(plain_chunks(r.text or "", ck.PARENT, ck.OVERLAP)) for c, child in enumerate(plain_chunks(parent, ck.CHILD, ck.OVERLAP)))
    got = sorted((r.doc_id, r.parent_ix, r.child_ix, r.text_md5) for r in registry.QUERIES["parent_child_chunks"](spark, SF).collect())
    assert got == want


@pytest.mark.parametrize("name", ["text_classifier_train", "text_classifier_predict"])
def test_classifier_queries(spark, name):
    from tessera.plans import registry

    registry.load()
    first = registry.QUERIES[name](spark, SF)
    assert sorted(map(str, first.collect())) == sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    assert first.count() > 0


def test_markdown_cuts_long_runs_between_characters(spark):
    run = "".join(chr(97 + i % 26) for i in range(3000))
    texts = [run, f"# head\n{run} tail", run[:300], run[:301], run[:550], run[:551], "ab " + run[:299]]
    rows = spark.createDataFrame(enumerate(texts), "i int, text string").select("i", ck.markdown_chunks(F.col("text"), 300, 50).alias("chunks")).collect()
    for row in rows:
        assert row.chunks == plain_chunks(texts[row.i], 300, 50, ck.MARKDOWN)
        assert all(len(c) <= 300 for c in row.chunks)


def test_hybrid_keeps_rows_with_equal_ids_apart(spark):
    rows = spark.createDataFrame([(1, "first text"), (1, "second text")], "doc_id long, text string")
    assert sorted(r.text for r in ck.hybrid_chunks(rows).collect()) == ["first text", "second text"]


def test_sections_and_chapters_of_rows_with_equal_and_null_ids(spark):
    text = "intro\nHead one\n" + "a" * 50 + "\nHead two\nshort\nHead one\n" + "b" * 60
    docs = spark.createDataFrame([(1, text), (1, "Head x\n" + "c" * 45), (None, text), (3, ""), (4, None), (5, "\n\n")], "doc_id long, text string")
    found = ck.sections(docs, lambda line: line.startswith("Head")).collect()
    whole = [("Head one", 1, "Head one\n" + "a" * 50), ("Head one", 3, "Head one\n" + "b" * 60)]
    want = [(i, *w) for i in (1, None) for w in whole] + [(1, "Head x", 1, "Head x\n" + "c" * 45), (3, "全文", 0, ""), (4, "全文", 0, None), (5, "全文", 0, "")]
    assert sorted(map(repr, ((r.doc_id, r.title, r.section_ix, r.text) for r in found))) == sorted(map(repr, want))
    chapters = ck.chapter_map(docs, "^Head").collect()
    want = [(i, t, c) for i in (1, None) for t, c in (("Head one", "b" * 60), ("Head two", "short"))] + [(1, "Head x", "c" * 45)]
    assert sorted(map(repr, ((r.doc_id, r.title, r.content) for r in chapters))) == sorted(map(repr, want))


def test_sections_of_a_text_of_many_lines_take_linear_time(spark):
    docs = spark.range(1).selectExpr("id as doc_id", "repeat('Head of a part\nline of a part\n', 30000) as text")
    assert ck.sections(docs, lambda line: line.startswith("Head"), least=1).count() == 30_000
    assert ck.chapter_map(docs, "^Head").count() == 1


def test_graph_blocks_equal_a_plain_twin(spark):
    from tessera.plans import registry

    registry.load()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        for p, parent in enumerate(plain_chunks(r.text, 1600, 100)):
            for c, child in enumerate(plain_chunks(parent, 500, 100)):
                want.append((r.doc_id, p, c, hashlib.md5(child.encode()).hexdigest()))
    found = registry.QUERIES["graph_parent_child"](spark, SF).collect()
    assert sorted((r.doc_id, r.parent_ix, r.child_ix, r.text_md5) for r in found) == sorted(want)
    assert {r.role for r in found} == {"graph"} and len({r.id for r in found}) == len(found)
