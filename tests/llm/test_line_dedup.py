"""Line dedup against a plain reader, on edge tables and on thresholds."""

import random

import pytest

from tessera.llm.line_dedup import drop_repeated_lines

DOCS = "doc_id long, text string, version string, line_version string, lost_places int, n_lines int"


def plain_lines(rows, least=2, shortest=10):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= shortest:
                holders.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), ())
            first = min(held, key=lambda i: (i is None, i or 0), default=None)
            if len(held) < least or first == doc_id:
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def found(frame, **how):
    return sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.kept_text)) for r in drop_repeated_lines(frame, **how).collect())


@pytest.mark.parametrize("least", [2, 3])
def test_small_tables_equal_a_plain_reader(spark, least):
    rng = random.Random(least)
    lines = ["", "short", "A line of Ten", "  a line of ten\t", "\x0ba LINE of ten\r", "İstanbul is a city", "i̇stanbul is a city", "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü", " a line of ten", "nine char", "ten chars!", "x" * 50_000]
    rows = [(rng.choice([None, *range(15)]), rng.choice([None, "\n".join(rng.choice(lines) for _ in range(rng.randrange(9)))])) for _ in range(40)]
    frame = spark.createDataFrame([(*r, "v", "w", 1, 2) for r in rows + rows[:5]], DOCS)
    assert found(frame, least=least) == plain_lines(rows + rows[:5], least=least)
    assert found(frame.limit(0)) == []


def test_columns_pass_and_clashes_are_replaced(spark):
    frame = spark.createDataFrame([(1, "the same long line\nown", "v", "w", 1, 2), (2, "own\nThe same long line ", "v", "w", 1, 2)], DOCS)
    got = drop_repeated_lines(frame)
    assert got.columns == ["doc_id", "text", "version", "line_version", "lost_places", "n_lines", "n_dropped", "kept_text"]
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text, r.line_version) for r in got.collect()) == [(1, 2, 0, "the same long line\nown", "w"), (2, 2, 1, "own", "w")]


def test_a_line_in_every_document_and_a_long_document(spark):
    frame = spark.range(3_000).selectExpr("id as doc_id", "concat('The very same line\n', 'line number ', id, if(id = 7, repeat('\nfiller line of text', 100000), '')) as text")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in drop_repeated_lines(frame).collect()}
    assert got[0] == (2, 0) and got[7] == (100_002, 1) and all(v == (2, 1) for k, v in got.items() if k not in (0, 7))
