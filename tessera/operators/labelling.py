"""Labels for queries: ordered rules and a Spark ML text classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Signal words of the strategies.
SCENE_SIGNALS = ("我现在", "现场", "怎么办", "怎么处理", "该怎么做", "如何处置", "事故", "异常", "应急", "突发", "超限", "险情")
SUBQUERY_SIGNALS = ("比较", "区别", "对比", "优缺点", "分别", "同时", "并且", "以及", "各自", "一方面", "另一方面")
ABSTRACT_WORDS = ("影响", "意义", "作用", "趋势", "前景", "关系", "重要性", "价值", "效果")
COMPARISON_WORDS = ("对比", "区别", "差异", "优劣", "比较", "哪个更好", "有何不同")
COMPLEX_WORDS = ("如何", "怎样", "应该", "方案", "设计", "优化", "解决", "故障", "异常")
DIRECT, HYPOTHETICAL, SUBQUERY, SCENE, OLD_SCENE = "直接检索", "假设问题检索", "子查询检索", "场景重构检索", "回溯问题检索"
GENERAL, PROFESSIONAL = "通用知识", "专业咨询"


def strategy_rules(query: Column, scene: Sequence[str] = SCENE_SIGNALS, subquery: Sequence[str] = SUBQUERY_SIGNALS) -> Column:
    """The strategy of the first rule that holds, else null."""
    return F.when(tx.keyword_any(query, scene), SCENE).when(tx.keyword_any(query, subquery), SUBQUERY)


def strategy_fallback(rule: Column, predicted: Column, default: str = DIRECT) -> Column:
    return F.coalesce(rule, predicted, F.lit(default))


def weak_label_strategy(query: Column, abstract: Sequence[str] = ABSTRACT_WORDS, comparison: Sequence[str] = COMPARISON_WORDS, complex_words: Sequence[str] = COMPLEX_WORDS, long: int = 25, comma: str = ",") -> Column:
    q = tx.given(query)
    marks = [F.length(q) > long, F.regexp_count(q, F.lit(comma)) >= 2, tx.matches(q, r"\d"), tx.keyword_any(q, complex_words)]
    score = sum((m.cast("int") for m in marks[1:]), marks[0].cast("int"))
    return F.when(tx.keyword_any(q, abstract), HYPOTHETICAL).when(tx.keyword_any(q, comparison), SUBQUERY).when(score >= 2, SCENE).otherwise(DIRECT)


def query_type(query: Column, raw: Column, signals: Sequence[str]) -> Column:
    """The two valid types; strategy names count as professional, unknown values as general."""
    promoted = (raw == GENERAL) & tx.keyword_any(query, signals)
    strategies = [DIRECT, HYPOTHETICAL, SUBQUERY, SCENE, OLD_SCENE]
    return F.when((raw == PROFESSIONAL) | promoted | raw.isin(strategies), PROFESSIONAL).otherwise(GENERAL)


def train_classifier(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 14):
    """A pipeline of tokens, hashed tf-idf and logistic regression, fitted where the rows are."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer

    index = StringIndexer(inputCol=label, outputCol="label_ix", handleInvalid="keep", stringOrderType="alphabetAsc").fit(rows)
    stages = [
        RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[\s|]+"),
        HashingTF(inputCol="tokens", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="features"),
        LogisticRegression(labelCol="label_ix", maxIter=20, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=[*index.labels, "unknown"]),
    ]
    return Pipeline(stages=stages).fit(index.transform(rows))


def predict(model, rows: DataFrame, default: str = "1") -> DataFrame:
    """rows with predicted; the default label stands where there is no model."""
    if model is None:
        return rows.withColumn("predicted", F.lit(default))
    return model.transform(rows).drop("tokens", "counts", "features", "rawPrediction", "probability", "prediction")


class ModelStore:
    """Trained classifiers in a folder, one version each, with their label map and held-out figure.

    A version is complete when its card is there: the card is written last.
    """

    CARD = "version int, labels array<string>, label_map map<string, string>, rows long, held_out long, accuracy double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self.CARD).write.mode("append").json(f"{self.path}/cards")

    def versions(self) -> list:
        """The cards of all versions, ascending; a card is a row."""
        return self.spark.read.schema(self.CARD).json(f"{self.path}/cards").orderBy("version").collect()

    def latest(self):
        """The card of the newest version; None where there is none."""
        cards = self.versions()
        return cards[-1] if cards else None

    def train(self, rows: DataFrame, held_out: DataFrame, text: str = "text", label: str = "label", label_map: dict[str, str] | None = None):
        """Trains, measures on the held-out rows in one pass, stores, and returns the new card.

        label_map gives predictions the names that users see; labels without one keep theirs.
        """
        model = train_classifier(rows, text, label)
        labels = [x for x in model.stages[-1].getLabels() if x != "unknown"]
        right = F.count_if(F.col("predicted") == F.col(label))
        measured = predict(model, held_out).agg(F.count("*").alias("n"), right.alias("right")).first()
        version = (self.latest().version if self.latest() else 0) + 1
        model.write().overwrite().save(f"{self.path}/v{version}")
        card = (version, labels, label_map or {}, rows.count(), measured.n, measured.right / measured.n if measured.n else None)
        self.spark.createDataFrame([card], self.CARD).coalesce(1).write.mode("append").json(f"{self.path}/cards")
        return self.latest()

    def predict(self, rows: DataFrame, version: int | None = None, default: str = "1") -> DataFrame:
        """rows with predicted, by a version or the newest one; the default where none is stored."""
        from pyspark.ml import PipelineModel

        cards = {c.version: c for c in self.versions()}
        if version is not None and version not in cards:
            raise ValueError(f"no version {version} in {self.path}")
        if not cards:
            return predict(None, rows, default)
        card = cards[version or max(cards)]
        found = predict(PipelineModel.load(f"{self.path}/v{card.version}"), rows)
        pairs = [F.lit(x) for pair in (card.label_map or {}).items() for x in pair]
        named = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("predicted")), F.col("predicted")) if pairs else F.col("predicted")
        return found.withColumn("predicted", named)
