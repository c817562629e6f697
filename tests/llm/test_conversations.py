"""Conversation repair: the search against exhaustive search, and edge tables against a plain reader."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from tessera.llm import conversations
from tessera.llm.conversations import CUT, MUST_GO, SOUND, cheapest_edits

ROWS = "conv_id long, turn long, role string, text string, gone string, audit int"


def exhaustive(initials, faults):
    """The same by trying all edits at every row, the rest of each row and last role only once."""
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted=0):
        asked = "a" if last == "u" else "u"
        ways = [(0, "")] if i == len(initials) and last in ("", "a") else []

        def after(cost, edit, rest):
            ways.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            after(5, "I", best(i, asked, inserted + 1))
        if i < len(initials):
            after(2, "D", best(i + 1, last))
            if faults[i] != MUST_GO:
                more = 5 * (faults[i] == CUT)
                after(1 + more, "R", best(i + 1, asked))
                if initials[i] in legal[last]:
                    after(more, "K", best(i + 1, initials[i]))
        return min(ways, default=(10**9, ""))

    return best(0, "")


def test_search_equals_exhaustive_search():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.randrange(0, 9)
        initials = "".join(rng.choice("uuaas t") for _ in range(n))
        faults = bytes(rng.choice((SOUND, SOUND, CUT, MUST_GO)) for _ in range(n))
        want = exhaustive(initials, faults)
        assert cheapest_edits(initials, faults) == want
        assert cheapest_edits(initials, faults, informed=False) == want


def test_search_without_estimates_agrees_on_longer_rows_and_long_ones_are_fast():
    rng = random.Random(6)
    for _ in range(20):
        n = rng.randrange(10, 25)
        initials = "s" + "".join(rng.choice("uaua s") for _ in range(n))
        faults = bytes(rng.choice((0, 0, 0, 1, 2)) for _ in range(n + 1))
        assert cheapest_edits(initials, faults) == cheapest_edits(initials, faults, informed=False)
    cost, audit = cheapest_edits("ua" * 20_000 + "s" * 20_000, bytes(60_000))
    assert (cost, audit) == (20_000, "K" * 40_000 + "R" * 20_000)


def plain_digest(rows):
    """The contract read row by row; rows are (conv_id, turn, role, text)."""
    groups = {}
    for conv_id, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        code = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        group = groups.setdefault(conv_id, [])
        if code == 1:
            text = ""
        if code == 2:
            text = "".join(c for c in text if c not in ".!?")
        if code == 4:
            role = "user"
        group.extend([(turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1))
    blanks = " \t\n\x0b\x0c\r"
    out = {}
    for conv_id, group in groups.items():
        order = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest())
        group.sort(key=order)
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in group:
            kind = 0 if not text.strip(blanks) else 1 if (role, text) in seen else 2 if text.rstrip(blanks)[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(SOUND if kind is None else CUT if kind == 2 else MUST_GO)
            if kind is not None:
                counts[kind] += 1
        initials = [role[:1] for _, role, _ in group]
        turns = {t for t, _, _ in group if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = exhaustive([x or " " for x in initials], faults)
        lines, i = [], 0
        for edit in audit:
            asked = "user" if not lines or lines[-1][0][:1] != "u" else "assistant"
            if edit == "I":
                lines.append((asked, ""))
                continue
            if edit != "D":
                lines.append((group[i][1] if edit == "K" else asked, group[i][2]))
            i += 1
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv_id] = (gaps, *counts, illegal, cost, audit, digest)
    return out


def digests(frame):
    found = conversations.digests(conversations.repaired(conversations.damaged(frame))).collect()
    rows = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(rows) == len(found)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_small_tables_equal_a_plain_reader(spark, seed):
    rng = random.Random(seed)
    texts = [None, "", " \t", "Yes.", "No", "Why?  ", "äöü!", "one\ntwo.", " ", "long " * 5_000 + "."]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(5)]), rng.choice(roles), rng.choice(texts)) for _ in range(70)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    assert digests(frame) == plain_digest(rows)


def test_gone_empty_and_repeated(spark):
    gone = next(i for i in range(1_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi.", None, 0)], ROWS)
    assert digests(frame) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert digests(frame.limit(0)) == {}
    kept = next(i for i in range(1_000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    rows = [(kept, 0, "user", "Hi."), (kept, 0, "user", "Hi."), (kept, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    assert digests(frame)[kept][:7] == (0, 0, 1, 0, 1, 2, "KDK")


def test_repaired_rows_carry_texts(spark):
    kept = next(i for i in range(1_000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in range(3)))
    rows = [(kept, 0, "system", "S."), (kept, 1, "assistant", "Q."), (kept, 2, "assistant", "A.")]
    found = conversations.repaired(conversations.damaged(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS))).filter("place > 0")
    assert [(r.place, r.edit, r.role, r.text) for r in found.collect()] == [(1, "K", "system", "S."), (2, "R", "user", "Q."), (3, "K", "assistant", "A.")]


def test_one_conversation_of_all_rows(spark):
    """A hot conversation passes through as rows, not as one value."""
    frame = spark.range(20_000).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('Text ', id, '.') as text")
    (row,) = conversations.digests(conversations.repaired(conversations.damaged(frame))).collect()
    assert row.gaps > 0 and row.blank > 500 and len(row.audit) > 19_000 and row.cost >= 2 * (row.blank + row.duplicate)
