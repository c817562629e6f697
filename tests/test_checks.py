"""Checks inside plans, samples by number, stored models."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import checks, datasets, labelling, logs
from tessera.shared import scratch


def test_wrong_totals_fail_and_right_ones_pass(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    for n in (10, 0):
        part = rows.limit(n)
        assert checks.required(part, F.count("*") == n, "no").count() == n
        with pytest.raises(PySparkException, match="ten plus one"):
            checks.required(part, F.count("*") == n + 1, "ten plus one").collect()
    split = datasets.fixed_count_split(rows, "k", [("a", 7), ("b", 3)], exact=True)
    assert sorted(r["count"] for r in split.groupBy("split").count().collect()) == [3, 7]
    with pytest.raises(PySparkException, match="splits hold 9 rows"):
        datasets.fixed_count_split(rows, "k", [("a", 7), ("b", 2)], exact=True).collect()
    labelled = rows.select("k", F.lit("x").alias("label"))
    assert datasets.final_union(labelled, labelled).count() == 20
    with pytest.raises(PySparkException, match="without a label"):
        datasets.final_union(labelled, rows.select("k", F.lit(None).cast("string").alias("label"))).collect()


def test_rows_are_checked_and_observed(spark):
    rows = spark.createDataFrame([("like", None), ("correction", "so"), ("correction", "  ")], "feedback_type string, content string")
    assert logs.feedback_accepted(rows.limit(2)).count() == 2
    with pytest.raises(PySparkException, match="needs content"):
        logs.feedback_accepted(rows).collect()
    seen, metrics = checks.observed(rows, "feedback", n=F.count("*"), blank=F.count_if(F.trim("content") == ""))
    assert len(seen.collect()) == 3 and metrics.get == {"n": 3, "blank": 1}


def test_quotas_and_classes_hold_where_labels_are_hot_null_or_missing(spark):
    rows = spark.range(5_000).selectExpr("id", "case when id % 100 = 0 then null when id % 10 = 0 then 'b' else 'a' end as label").repartition(4)
    got = {r.label: r.n for r in datasets.quota_sample(rows, "label", "id", {"a": 2_000, "b": 700, "c": 5}).groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2_000, "b": 450}
    even = datasets.balance_classes(rows, "label", "id", 1_200, bucket=64).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("copy").alias("copies")).collect()
    assert sorted((str(r.label), r.n, r.ids, r.copies) for r in even) == [("None", 1_200, 50, 24), ("a", 1_200, 1_200, 1), ("b", 1_200, 450, 3)]


def test_models_are_stored_by_version(spark):
    rows = spark.range(400).selectExpr("id", "case when id % 2 = 0 then 'ore vein mine' else 'bread salt oven' end || ' ' || (id % 7) as text", "if(id % 2 = 0, 'mining', 'kitchen') as label")
    train, test = rows.filter("id % 5 <> 0"), rows.filter("id % 5 = 0")
    store = labelling.ModelStore(spark, scratch(spark, "models"))
    assert store.latest() is None and {r.predicted for r in store.predict(test, default="mining").collect()} == {"mining"}
    first = store.train(train, test)
    assert (first.version, first.labels, first.rows, first.held_out) == (1, ["kitchen", "mining"], 320, 80) and first.accuracy >= 0.95
    store.train(train.filter("label = 'mining'").unionByName(train.limit(4)), test, label_map={"mining": "M"})
    again = labelling.ModelStore(spark, store.path)  # as another session opens it
    assert again.latest().version == 2 and [r.version for r in again.versions()] == [1, 2]
    found = again.predict(test, version=1)
    assert found.filter("predicted = label").count() / 80 == first.accuracy
    assert "M" in {r.predicted for r in again.predict(test).collect()}
    with pytest.raises(ValueError):
        again.predict(test, version=9)
