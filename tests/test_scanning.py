"""Matches with their places, and what a scan of files leaves out."""

import re

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import scanning
from tessera.operators.logs import gaps
from tessera.operators.ranks import group_rank


def test_every_match_has_its_own_place(spark):
    key = "sk-" + "a1B2" * 6
    texts = [f"{key}\nthen {key} and SK-{'x' * 20}", "call 13912345678, 13912345678!", "password = 123456\npassword=12345", f"YOUR_{key} your-1", None, "", "x" * 90 + key + "y" * 90]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, text in enumerate(texts):
        for name, pattern in tx.SENSITIVE:
            for m in re.finditer(pattern, text or ""):
                context = text[max(0, m.start() - 50) : m.end() + 50].replace("\n", " ")
                if "YOUR_" not in m[0] and "your-" not in m[0].lower():
                    want.append((i, name, m.start() + 1, m[0], context))
    assert sorted(map(tuple, scanning.scan(rows).collect())) == sorted(want)


def test_scannable_files(spark):
    paths = {"a/b.py": True, "a/.git/b.py": False, "models/x.json": False, "x/tokenizer_config.json": False, "a/b.PNG": False, "readme.md": True, "my_models/x.yml": True, ".py": False}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.ok for r in rows.select("path", scanning.scannable(F.col("path")).alias("ok")).collect()} == paths


def test_group_rank_and_gaps(spark):
    rows = spark.createDataFrame([(None if i % 3 == 0 else f"g{i % 3}", i * 7 % 101) for i in range(100)], "g string, us long").withColumn("order", F.col("us"))
    placed = group_rank(rows, "g", F.floor(F.col("us") / 10), "us", name="n", size="all").collect()
    timed = {(r.g, r.us): r.gap_us for r in gaps(rows, "g", "us", "order", 10).collect()}
    for g in (None, "g1", "g2"):
        values = sorted(r.us for r in placed if r.g == g)
        assert [r.us for r in sorted((r for r in placed if r.g == g), key=lambda r: r.n)] == values
        assert {r.all for r in placed if r.g == g} == {len(values)}
        assert [timed[g, v] for v in values] == [None, *(b - a for a, b in zip(values, values[1:]))]
