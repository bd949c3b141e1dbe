"""Listing rules: unusable rows, exact duplicates, spelling, price outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomline import rules
from loomline.functions.listing import normalize_gender
from loomline.functions.text import WHITESPACE
from loomline.operators.dedup import dedup
from loomline.staging import stage


def usable(df: DataFrame, described: bool = True) -> DataFrame:
    """Rows with an address, a price above zero and, unless waived, a description.

    A missing price fails; NaN counts as larger than any price and passes.
    """
    kept = df.where((F.col("url") != "") & (F.col("price") > 0))
    return kept.where(F.col("description") != "") if described else kept


def clean(df: DataFrame, keys: list[str] = rules.DUPLICATE_KEYS,
          order: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Usable rows without exact duplicates, genders canonical.

    Duplicates are judged on the genders as they came in. The price rule runs
    before the duplicate rule: price is a duplicate key, so the result is the
    same and fewer rows are shuffled. With `columns`, only these come out and travel.
    """
    distinct = dedup(usable(df), keys, order, columns)
    if "gender" not in distinct.columns:
        return distinct
    return distinct.withColumn("gender", normalize_gender(F.col("gender")))


def clean_minimal(df: DataFrame) -> DataFrame:
    """The rules of direct loading: no description, duplicate or outlier rule."""
    none = F.array().cast("array<string>")
    return usable(df, described=False).withColumns({
        "image_url": F.coalesce("image_url", F.lit("")),
        "sizes": F.coalesce("sizes", none),
        "colors": F.coalesce("colors", none),
        "category": F.coalesce(F.nullif("category", F.lit("")), F.lit(rules.DEFAULT_CATEGORY)),
        "available": F.coalesce("available", F.lit(False)),
        "gender": normalize_gender(F.col("gender"), WHITESPACE),
    })


STEPS = 64  # slices per doubling of a value
LAST_SLICE = 1 << 17  # beyond every finite value's


def value_slice(value: Column) -> Column:
    """A whole number that never falls as the value rises; some 64 per doubling."""
    double = value.cast("double")
    size = F.least(F.log2(1 + F.abs(double)) * STEPS, F.lit(float(LAST_SLICE)))
    return F.when(F.isnan(double), LAST_SLICE + 1).otherwise(
        F.floor(F.signum(double) * size)).cast("int")


def medians(df: DataFrame, key: str = "brand", value: str = "price",
            weight: str | None = None) -> DataFrame:
    """Exact lower median per key; values that are null do not count.

    A first pass counts rows per key and slice of values, a few hundred counts per key in
    which the median's slice is found. A second one counts the values of that slice only
    and puts them in order. So no value travels that cannot be a median, and a hot key is
    never sorted. With `weight`, a row stands for that many (a table of counts).
    """
    rows = F.col(weight) if weight else F.lit(1).cast("long")
    narrow = stage(
        df.where(F.col(value).isNotNull())
        .select(F.col(key).alias("_key"), F.col(value).alias("_value"), rows.alias("_rows")),
        "values")
    sliced = narrow.withColumn("_slice", value_slice(F.col("_value")))
    so_far = Window.partitionBy("_key").orderBy("_slice")
    whole = Window.partitionBy("_key")
    counted = (
        sliced.groupBy("_key", "_slice").agg(F.sum("_rows").alias("_rows"))
        .withColumns({"_to": F.sum("_rows").over(so_far), "_all": F.sum("_rows").over(whole)})
    )
    holding = stage(
        counted.where((2 * F.col("_to") >= F.col("_all"))
                      & (2 * (F.col("_to") - F.col("_rows")) < F.col("_all")))
        .select(F.col("_key").alias("_of"), F.col("_slice").alias("_in"),
                (F.col("_to") - F.col("_rows")).alias("_below"), "_all"),
        "median-slices")
    inside = (
        sliced.join(holding, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_in")))
        .groupBy("_key", "_value", "_below", "_all").agg(F.sum("_rows").alias("_rows"))
        .withColumn("_to", F.sum("_rows").over(Window.partitionBy("_key").orderBy("_value")))
    )
    reached = inside.where(2 * (F.col("_to") + F.col("_below")) >= F.col("_all"))
    return reached.groupBy(F.col("_key").alias(key)).agg(F.min("_value").alias(f"median_{value}"))


def outliers_removed(df: DataFrame, key: str = "brand", value: str = "price",
                     factor: float = rules.OUTLIER_FACTOR,
                     reference: DataFrame | None = None) -> DataFrame:
    """Rows below `factor` times their key's median; rows without a median stay.

    Medians are staged: one row per key, scanned back at their true size. Small
    ones are broadcast and `df` is not shuffled at all; larger ones are shuffled
    and the adaptive skew join splits the hot keys of `df`.
    """
    if reference is None:
        reference = stage(medians(df, key, value), "medians")
    median = F.col(f"median_{value}")
    joined = df.join(reference, key, "left")
    kept = joined.where(median.isNull() | (F.col(value) < median * factor))
    return kept.select(*df.columns)
