"""Outcomes of trying a site: the latest state per domain, status, learning."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from loomline import rules
from loomline.functions.web import domain_features


def with_features(df: DataFrame) -> DataFrame:
    return df.withColumns(domain_features(F.col("domain"), F.col("country")))


def latest_outcomes(log: DataFrame) -> DataFrame:
    """Per domain: latest success, number of attempts, last check.

    The country, and with it the features, stay those of the first attempt.
    `ts` orders the attempts of a domain.
    """
    folded = log.groupBy("domain").agg(
        F.min_by("country", "ts").alias("country"),
        F.max_by("success", "ts").alias("success"),
        F.count(F.lit(1)).alias("attempts"),
        F.max("ts").alias("last_checked"),
    )
    return with_features(folded)


def remember(latest: DataFrame, tried: DataFrame, when: Column) -> DataFrame:
    """The state per domain after the attempts `tried` (domain, country, success), made at `when`.

    The country of a known domain stays. Of attempts for several countries the last by code
    counts as the latest, the first by code as the first.
    """
    known = latest.select("domain", "country", "success", "attempts", "last_checked",
                          F.lit(0).alias("_age"))
    checked = when.cast(latest.schema["last_checked"].dataType)
    new = tried.select("domain", "country", "success", F.lit(1).cast("long").alias("attempts"),
                       checked.alias("last_checked"), F.lit(1).alias("_age"))
    order = F.struct("_age", "country")
    folded = known.unionByName(new).groupBy("domain").agg(
        F.min_by("country", order).alias("country"), F.max_by("success", order).alias("success"),
        F.sum("attempts").alias("attempts"), F.max_by("last_checked", "_age").alias("last_checked"),
    )
    return with_features(folded)


def held_out(domain: Column, parts: int = 5) -> Column:
    """One domain in `parts`, by digest: kept from learning, to judge by."""
    return F.conv(F.substring(F.md5(domain), 1, 8), 16, 10).cast("long") % parts == 0


def labelled(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("success").isNotNull())


def recent_outcomes(latest: DataFrame) -> DataFrame:
    """Most recently checked first, with the status in words."""
    status = (
        F.when(F.col("success") == 1, "success")
        .when(F.col("success") == 0, "blocked").otherwise("unknown")
    )
    return latest.select(
        "domain", "country", status.alias("status"), "attempts", "last_checked"
    ).orderBy(F.desc("last_checked"), "domain")


def outcome_status(latest: DataFrame, searches: DataFrame, registry: DataFrame) -> DataFrame:
    """Tracked, working and blocked domains, logged searches, registered brands."""
    def size(df: DataFrame):
        return df.select(F.count(F.lit(1))).scalar()

    return latest.agg(
        F.count(F.lit(1)).alias("total_domains"),
        F.count_if(F.col("success") == 1).alias("successful"),
        F.count_if(F.col("success") == 0).alias("blocked"),
    ).withColumns({"search_runs": size(searches), "total_brands": size(registry)})


def training_gate(latest: DataFrame, min_rows: int = rules.MIN_TRAINING_ROWS) -> DataFrame:
    """Labelled rows, classes among them, and whether that is enough to learn."""
    counts = labelled(latest).agg(
        F.count(F.lit(1)).alias("labelled_rows"),
        F.count_distinct("success").alias("classes"),
    )
    ready = (F.col("labelled_rows") >= min_rows) & (F.col("classes") >= 2)
    return counts.withColumn("ready", ready)


def train_outcome_model(latest: DataFrame, max_depth: int = 30) -> PipelineModel | None:
    """A random forest over the domain features; None while the gate is closed.

    `max_depth` is the deepest MLlib grows; trees end earlier where nothing is left to split.
    """
    if not training_gate(latest).first().ready:
        return None
    rows = labelled(latest).select(*rules.FEATURES, F.col("success").cast("double").alias("label"))
    forest = RandomForestClassifier(
        numTrees=rules.FOREST_TREES, seed=rules.FOREST_SEED, maxDepth=max_depth
    )
    assembler = VectorAssembler(inputCols=rules.FEATURES, outputCol="features")
    return Pipeline(stages=[assembler, forest]).fit(rows)


def score_domains(model: PipelineModel | None, domains: DataFrame) -> DataFrame:
    """Probability of success per row of `domains`; null while nothing is learned."""
    if model is None:
        return domains.withColumn("probability", F.lit(None).cast("double"))
    scored = model.transform(with_features(domains))
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*domains.columns, F.coalesce(chance, F.lit(0.5)).alias("probability"))
