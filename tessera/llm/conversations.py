"""Conversation structure repair by iterative-deepening A*.

The rows of a conversation are kept, given another role or deleted, and empty turns are
inserted, until the initials of its roles read s?(ua)+ or nothing. The cheapest edits are
sought depth first, in ASCII order of their initials, under a bound on the cost that rises
to the least cost that the last search had to cut off. A table holds for each failed state
(rows consumed, last role) the cost that its failure proves to be needed from there; states
whose proven cost exceeds what is left are not entered again, in this search or later ones.
The estimate of a state not yet in the table comes from a pattern database: the exact costs
in the simpler problem where a conversation may end after a system row. It never exceeds
the true cost, so the first path that arrives is the cheapest, and of these the ASCII-least.

Texts stay away from the search: rows are shuffled to it as initials, faults and digests,
sorted, and streamed; a task holds some bytes for each row of one conversation. Then texts
are shuffled once, sorted behind their conversation's edits, and streamed past them; a task
holds one batch of texts, however long a conversation is.

Defined results: null roles and texts are one space; a null conv_id is a conversation of
its own; null turns come first; rows of equal turn are ordered by the digest of role and
text, so repeated rows stand together; extra columns are ignored; texts of any length are
taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BLANKS, WORD

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
#: What a truncated row costs that is not deleted.
TRUNCATED = 5
#: Faults of a row.
SOUND, CUT, MUST_GO = 0, 1, 2
#: The last role of what stands so far; a conversation may end at NONE and ASSISTANT.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = {"su", "ua", "au"}
#: What the simpler problem takes for the same: a system row counts as an assistant's.
_CLASS = (0, 1, 2, 1)
_ROLES = {USER: "user", ASSISTANT: "assistant"}


def _asked(last: int) -> int:
    """The role that a row must get, if it is given one, after `last`."""
    return ASSISTANT if last == USER else USER


def _steps(initial: str, fault: int, last: int) -> Iterator[tuple[str, int, int, int]]:
    """Edits at a row in ASCII order: initial, cost, rows consumed, role that comes last then."""
    yield "D", DELETE, 1, last
    yield "I", INSERT, 0, _asked(last)
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT else 0
        kept = _KEPT.get((last, initial))
        if kept is not None:
            yield "K", KEEP + more, 1, kept
        yield "R", REROLE + more, 1, _asked(last)


def _patterns(initials: str, faults: bytes) -> list[array]:
    """For each class of last roles the cost of the rows from each place on, in the simpler problem."""
    n = len(initials)
    need = [array("q", bytes(8 * (n + 1))) for _ in range(3)]
    need[2][n] = INSERT
    for i in range(n - 1, -1, -1):
        for state, last in enumerate((NONE, SYSTEM, USER)):
            need[state][i] = min(cost + need[_CLASS[then]][i + 1] for _, cost, rows, then in _steps(initials[i], faults[i], last) if rows)
        straight = [need[state][i] for state in range(3)]
        need[2][i] = min(straight[2], INSERT + straight[1])
        need[1][i] = min(straight[1], INSERT + straight[2])
        need[0][i] = min(straight[0], INSERT + need[2][i])
    return need


def cheapest_edits(initials: str, faults: bytes, informed: bool = True) -> tuple[int, str]:
    """The least cost of a legal conversation and the ASCII-least initials of edits of that cost.

    initials holds one character per row (a space where a role is empty); without `informed`
    the search starts with no estimate.
    """
    n = len(initials)
    need = _patterns(initials, faults) if informed else [array("q", bytes(8 * (n + 1)))] * 3
    proven: dict[int, int] = {}

    def least(at: int, last: int) -> int:
        known = proven.get(4 * at + last)
        return need[_CLASS[last]][at] if known is None else known

    def ways(at: int, last: int) -> Iterator[tuple[str, int, int, int]]:
        return _steps(initials[at], faults[at], last) if at < n else iter((("I", INSERT, 0, _asked(last)),))

    bound = least(0, NONE)
    while True:
        # a frame: rows consumed, last role, cost so far, edits left to try, least cost seen beyond the bound
        path: list[str] = []
        frames = [[0, NONE, 0, ways(0, NONE), None]]
        while frames:
            frame = frames[-1]
            at, last, spent, left, beyond = frame
            if at == n and last in (NONE, ASSISTANT):
                return spent, "".join(path)
            for name, cost, rows, then in left:
                rest = cost + least(at + rows, then)
                if spent + rest > bound:
                    beyond = rest if beyond is None else min(beyond, rest)
                    continue
                frame[4] = beyond
                path.append(name)
                frames.append([at + rows, then, spent + cost, ways(at + rows, then), None])
                break
            else:
                proven[4 * at + last] = beyond
                frames.pop()
                if frames:
                    path.pop()
                    above = frames[-1]
                    rest = spent - above[2] + beyond
                    above[4] = rest if above[4] is None else min(above[4], rest)
        bound = proven[NONE]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after the damage that their conv_id and turn decide.

    gone rows only tell that their conversation exists.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat_ws(":", named("conv_id"), named("turn")).cast("binary")), F.lit(20))
    text = named("text")
    hurt = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(code == 4, "user").otherwise(named("role")).alias("role"),
        F.when(code.isin(0, 1), "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (code == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))).alias("copy"),
    )
    return hurt.drop("copy")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.char_length(role), role, text)))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Each row of sorted batches, and whether its first column differs from the row before."""
    before, first = None, True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield first or row[0] != before, row
            before, first = row[0], False


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_EDITS = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What the search needs of a conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.seen, self.initials, self.faults = conv_id, set(), [], bytearray()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial, digest, blank, cut) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        repeated = digest in self.seen
        self.seen.add(digest)
        self.faults.append(MUST_GO if blank or repeated else CUT if cut else SOUND)
        self.blank += blank
        self.duplicate += repeated and not blank
        self.truncated += self.faults[-1] == CUT
        if self.initials:
            self.illegal += self.initials[-1] + initial not in _LEGAL
        self.initials.append(initial)

    def summary(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = cheapest_edits("".join(x or " " for x in self.initials), bytes(self.faults))
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def edits(rows: DataFrame) -> DataFrame:
    """One row per conversation: its counts of faults, the cost and the initials of its cheapest edits.

    rows has conv_id, turn, role, text, gone.
    """
    text, role = F.col("text"), F.col("role")
    blank = ~F.rlike(text, F.lit(WORD))
    short = rows.select(
        "conv_id",
        "gone",
        "turn",
        F.substring(role, 1, 1).alias("initial"),
        _digest(role, text).alias("digest"),
        blank.alias("blank"),
        (~F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    kind = rows.schema["conv_id"].dataType
    schema = _EDITS.format(kind.simpleString())
    names = ["conv_id", *_COUNTS, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        def summaries():
            now = None
            for begins, (conv_id, gone, turn, initial, digest, blank, cut) in _conversations(batches):
                if begins:
                    if now is not None:
                        yield now.summary()
                    now = _Conversation(conv_id)
                if not gone:
                    now.add(turn, initial, digest, blank, cut)
            if now is not None:
                yield now.summary()

        for part in itertools.batched(summaries(), 1_000):
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *[pa.array(c, pa.int64()) for c in columns[1:-1]], pa.array(columns[-1], pa.string())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    ids = to_arrow_type(kind)
    sorted_rows = short.repartition("conv_id").sortWithinPartitions("conv_id", "gone", F.asc_nulls_first("turn"), "digest")
    return sorted_rows.mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """Each conversation's repaired rows behind a row of its counts, in one partition and in order.

    conv_id, place (0: the counts, edits and cost), edit (its initial), role, text, and the
    columns of `edits`, null but at place 0. Deleted rows are left out.
    """
    found = edits(rows)
    kind = rows.schema["conv_id"].dataType
    stats = F.struct(*_COUNTS, "audit").alias("stats")
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), stats)
    empty = F.lit(None).cast(heads.schema["stats"].dataType)
    texts = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", _digest(F.col("role"), F.col("text")).alias("digest"), "role", "text", empty.alias("stats"))
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "digest"]
    both = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "stats")
    schema = "conv_id {}, place long, edit string, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string".format(kind.simpleString())

    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, last, conv_id, nothing = "", 0, 0, NONE, None, (None,) * (len(_COUNTS) + 1)

        def inserted(out: list) -> None:
            nonlocal at, place, last
            while at < len(audit) and audit[at] == "I":
                at, place, last = at + 1, place + 1, _asked(last)
                out.append((conv_id, place, "I", _ROLES[last], "", *nothing))

        def packed(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[1] == 0:
                    conv_id, head = row[0], row[4]
                    audit, at, place, last = head["audit"], 0, 0, NONE
                    out.append((conv_id, 0, "", None, None, *[head[c] for c in _COUNTS], audit))
                else:
                    edit, role = audit[at], row[2]
                    at += 1
                    if edit != "D":
                        place += 1
                        last = _KEPT[last, role[:1]] if edit == "K" else _asked(last)
                        out.append((conv_id, place, edit, role if edit == "K" else _ROLES[last], row[3], *nothing))
                inserted(out)
            if out:
                yield packed(out)

    return both.mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """One row per conversation of `repaired`, with the SHA-256 of its lines role:text."""
    kind = found.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hashed = None, sha256()

        def done() -> tuple:
            return (*head, hashed.hexdigest())

        for batch in batches:
            out = []
            at = {n: batch.column(n).to_pylist() for n in ["place", "role", "text", *names[:-1]]}
            for i, place in enumerate(at["place"]):
                if place == 0:
                    if head is not None:
                        out.append(done())
                    head, hashed = [at[n][i] for n in names[:-1]], sha256()
                else:
                    line = f"{at['role'][i]}:{at['text'][i]}"
                    hashed.update((line if place == 1 else "\n" + line).encode())
            if out:
                yield packed(out, batch.schema.field("conv_id").type)
            ids = batch.schema.field("conv_id").type
        if head is not None:
            yield packed([done()], ids)

    def packed(out: list, ids: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], ids), *[pa.array(c, pa.int64()) for c in columns[1:-2]], *[pa.array(c, pa.string()) for c in columns[-2:]]], names=names)

    return found.mapInArrow(run, _EDITS.format(kind) + ", repaired_sha256 string")
