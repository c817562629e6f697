"""Queries that label questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import labelling as lb
from tessera.operators import logs
from tessera.plans.datasets import labelled
from tessera.plans.registry import query
from tessera.plans.texts import PAIRS, conversations
from tessera.shared import scratch

SCENE_WORDS, SUB_WORDS, ABSTRACT, COMPARE, COMPLEX = ("with", "stupid"), ("and", "des"), ("tion",), ("ent",), ("how", "er")


def _any(words, column: str = "question") -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


RULE = f"case when {_any(SCENE_WORDS)} then '{lb.SCENE}' when {_any(SUB_WORDS)} then '{lb.SUBQUERY}' end"


def questions(spark, sf_dir):
    return logs.session_turns(conversations(spark, sf_dir)).select("conv_id", "turn", tx.given(F.col("question")).alias("question"))


@query(f"with {PAIRS} select conv_id, turn, {RULE} as strategy from pairs")
def strategy_rules(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", lb.strategy_rules(F.col("question"), SCENE_WORDS, SUB_WORDS).alias("strategy"))


@query(f"with {PAIRS} select conv_id, turn, coalesce({RULE}, case when len(question) > 60 then '{lb.HYPOTHETICAL}' end, '{lb.DIRECT}') as strategy from pairs")
def strategy_fallback(spark, sf_dir):
    predicted = F.when(F.length("question") > 60, lb.HYPOTHETICAL)
    return questions(spark, sf_dir).select("conv_id", "turn", lb.strategy_fallback(lb.strategy_rules(F.col("question"), SCENE_WORDS, SUB_WORDS), predicted).alias("strategy"))


@query(
    f"""with {PAIRS} select conv_id, turn, case when {_any(ABSTRACT)} then '{lb.HYPOTHETICAL}' when {_any(COMPARE)} then '{lb.SUBQUERY}'
    when (len(question) > 25)::int + (len(regexp_extract_all(question, ',')) >= 2)::int + regexp_matches(question, '\\d')::int + {_any(COMPLEX)}::int >= 2 then '{lb.SCENE}' else '{lb.DIRECT}' end as strategy from pairs"""
)
def weak_label_strategy(spark, sf_dir):
    return questions(spark, sf_dir).select("conv_id", "turn", lb.weak_label_strategy(F.col("question"), ABSTRACT, COMPARE, COMPLEX).alias("strategy"))


RAW = f"case turn % 4 when 0 then '{lb.GENERAL}' when 1 then '{lb.PROFESSIONAL}' when 2 then '{lb.OLD_SCENE}' else 'other' end"


@query(f"with {PAIRS}, r as (select *, {RAW} as raw from pairs) select conv_id, turn, case when raw = '{lb.PROFESSIONAL}' or (raw = '{lb.GENERAL}' and {_any(SCENE_WORDS)}) or raw = '{lb.OLD_SCENE}' then '{lb.PROFESSIONAL}' else '{lb.GENERAL}' end as query_type from r")
def query_type_normalise(spark, sf_dir):
    t = F.col("turn") % 4
    raw = F.when(t == 0, lb.GENERAL).when(t == 1, lb.PROFESSIONAL).when(t == 2, lb.OLD_SCENE).otherwise("other")
    return questions(spark, sf_dir).select("conv_id", "turn", lb.query_type(F.col("question"), raw, SCENE_WORDS).alias("query_type"))


def _split(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", tx.given(F.col("text")).alias("text"), F.col("label").cast("string").alias("label"))
    test = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return rows.filter(~test), rows.filter(test)


@query()
def text_classifier_train(spark, sf_dir):
    """The card of the stored version: trained on four fifths, measured on the fifth held out."""
    store = lb.ModelStore(spark, scratch(spark, "tessera-models"))
    card = store.train(*_split(spark, sf_dir))
    return spark.createDataFrame([card], lb.ModelStore.CARD)


@query()
def text_classifier_predict(spark, sf_dir):
    """Predictions of the stored version for the fifth held out."""
    train, test = _split(spark, sf_dir)
    store = lb.ModelStore(spark, scratch(spark, "tessera-models"))
    store.train(train, test)
    return store.predict(test).select("doc_id", "label", "predicted")
