"""Small helpers the operators of this package share."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small table of driver-side values, planned as one literal."""
    return spark.range(1, numPartitions=1).select(
        F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>"))
    )


def literal_array(values: list, ddl: str) -> Column:
    """A constant array; it is folded into one value, so a look-up costs one index."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{ddl}>")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the table does not have, in upper or lower case."""
    taken = {name.lower() for name in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def quoted(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def full_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most `n` rows, those of least hash; tasks send only the few that can be among them.

    Four times as many as are needed pass a threshold on the hash, whatever the size of
    the table; the rest never leave their task.
    """
    bits = 40
    share = min(1.0, 4 * n / max(df.count(), 1))
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    near = df.withColumn("__place", place).where(F.col("__place") < int(share * (1 << bits)))
    order = [c for c, kind in near.dtypes if c != "__place" and not kind.startswith("map")]
    return near.orderBy("__place", *order).limit(n).drop("__place")
