"""The linear baseline: standardized vectors and L2 logistic regression with pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicelake.functions.scoring import decide, log_loss, softmax_spoof
from voicelake.operators.scores import auroc, chunk_aggregate, confusion_at, eer


def fit(rows: DataFrame, vec: str, label: str, strength: float = 0.01) -> PipelineModel:
    """Scale with the statistics of the training rows and fit; both stages aggregate over partitions."""
    stages = [StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True),
              LogisticRegression(featuresCol="__s", labelCol=label, regParam=strength, elasticNetParam=0.0, rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__hat")]
    return Pipeline(stages=stages).fit(rows.withColumn("__v", array_to_vector(F.col(vec))))


def score(model: PipelineModel, rows: DataFrame, vec: str) -> DataFrame:
    """Rows with margin and P(spoof). For logits (-m, m) the probability is sigmoid(2m), so the margin is kept whole."""
    out = model.transform(rows.withColumn("__v", array_to_vector(F.col(vec))))
    scored = out.withColumn("margin", vector_to_array("__raw")[1])
    return scored.withColumn("score", softmax_spoof(F.lit(0.0), F.col("margin"))).drop("__v", "__s", "__raw", "__p", "__hat")


def evaluate(scored: DataFrame) -> DataFrame:
    """Cross entropy, AUROC, EER and the confusion of scored rows, one line."""
    loss = scored.agg(F.avg(log_loss(F.col("label"), F.col("margin"))).alias("cross_entropy"))
    return confusion_at(scored, 0.5).withColumns({
        "cross_entropy": loss.scalar(), "auroc": auroc(scored).scalar(), "eer": eer(scored).scalar()})


def file_decisions(scored: DataFrame, threshold: float, min_chunks: int = 1) -> DataFrame:
    """File scores from chunk scores and the decision; a file with too few chunks abstains."""
    files = chunk_aggregate(scored)
    value = F.when(F.col("chunks") >= min_chunks, F.col("mean"))
    return files.select("file_id", "chunks", "mean", "max", decide(value, threshold).alias("decision"))


@dataclass(frozen=True)
class Release:
    """What a released detector promises: its model, where it decides, what it needs and what it has seen."""

    model: PipelineModel
    threshold: float
    min_chunks: int
    languages: tuple[str, ...]  # of the training rows


def release(rows: DataFrame, vec: str, label: str, language: str, threshold: float, min_chunks: int) -> Release:
    """Fit on the training rows alone and note their languages (a handful of names)."""
    names = [r[0] for r in rows.select(language).where(F.col(language).isNotNull()).distinct().orderBy(language).collect()]
    return Release(fit(rows, vec, label), threshold, min_chunks, tuple(names))


def score_files(contract: Release, chunks: DataFrame, vec: str, usable: str, language: str) -> DataFrame:
    """One row per file under a release: score, decision and a coverage note; no file is dropped.

    A chunk that is not usable does not count. A file with fewer usable chunks than the contract asks for is
    insufficient: it has no score. The note says whether the file's language was among those of the training rows.
    """
    good = F.col(usable)
    scored = score(contract.model, chunks.where(good), vec)
    files = chunks.groupBy("file_id").agg(F.min(language).alias("language"), F.count_if(good).alias("usable"), F.count("*").alias("chunks"))
    means = scored.groupBy("file_id").agg(F.avg("score").alias("mean"))
    value = F.when(F.col("usable") >= contract.min_chunks, F.col("mean"))
    known = F.when(F.col("language").isNull(), "language_not_given").when(F.col("language").isin(*contract.languages), "trained_language").otherwise("language_not_in_training")
    joined = files.join(means, "file_id", "left")
    return joined.select("file_id", "chunks", "usable", "language", value.alias("score"), decide(value, contract.threshold).alias("decision"), known.alias("coverage"))
