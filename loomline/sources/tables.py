"""The stored listing table, logs, and file exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomline.functions.text import as_json_list
from loomline.operators.dedup import first_wins, fresh, latest_wins
from loomline.operators.reports import probe_results, probe_summary
from loomline.schemas import EXPORT_COLUMNS, STORED_COLUMNS


def table_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stored(df: DataFrame) -> DataFrame:
    """The twelve stored columns, in order."""
    return df.select(*STORED_COLUMNS)


def arrays_to_json(df: DataFrame, columns: list[str] = ["sizes", "colors"]) -> DataFrame:
    """Array columns as JSON text, for stores without arrays."""
    return df.withColumns({name: as_json_list(F.col(name)) for name in columns})


def insert_if_absent(batch: DataFrame, target: DataFrame | None, order: list[str],
                     key: str = "url") -> DataFrame:
    """The rows of `batch` that a table unique by `key` would take.

    First row of a key wins within the batch; keys already stored are ignored,
    so prices never refresh. Keys are made unique first: repeats of a hot key
    are gone before the shuffle, and the anti join reuses its partitioning. Only
    the key column of the target is read.
    """
    first = first_wins(batch, [key], order)
    return first if target is None else fresh(first, target, key)


KEY_BUCKETS = 256


def key_bucket(key: str, buckets: int = KEY_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def touched(rows: DataFrame, column: str = "bucket") -> list[int]:
    """The buckets that occur in `rows`, `buckets` numbers at most."""
    return [row[0] for row in rows.select(column).distinct().collect()]


def append_new(batch: DataFrame, path: str, order: list[str], key: str = "url",
               buckets: int = KEY_BUCKETS) -> None:
    """Insert-if-absent into the table at `path`; a replayed batch adds nothing.

    The table is partitioned by a hash of its key, and a batch reads the key column of the
    buckets it has keys for, nothing else; in a file, the key has a Bloom filter for
    searches by key, and rows lie by country. Stored rows get an `id`, the 64-bit
    fingerprint of their key (the key itself is what is unique), and the time of storing.
    """
    spark = batch.sparkSession
    bucket = key_bucket(key, buckets).alias("bucket")
    first = first_wins(batch, [key], order)
    target = table_or_none(spark, path)
    if target is not None:  # joined by the key alone, by which the rows lie already
        first = fresh(first, target.where(F.col("bucket").isin(touched(batch.select(bucket)))), key)
    (
        first.select("*", bucket).withColumns({"id": F.xxhash64(key), "scraped_at": F.current_timestamp()})
        .select("id", *STORED_COLUMNS, "scraped_at", "bucket").hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "country").write.mode("append")
        .option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("bucket").parquet(path)
    )


def upsert_latest(batch: DataFrame, target: DataFrame, order: list[str],
                  key: str = "url") -> DataFrame:
    """The table after a refresh that lets the newest row of a key win."""
    return latest_wins(target.unionByName(batch), [key], order)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns an older table lacks, added with a default."""
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def export_flat(df: DataFrame) -> DataFrame:
    """The eleven export columns, arrays joined by a bar."""
    joined = {name: F.array_join(name, "|") for name in ("sizes", "colors")}
    return df.withColumns(joined).select(*EXPORT_COLUMNS)


def write_json(df: DataFrame, path: str) -> None:
    """Listings as JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """Flat listings with a header; an empty result writes nothing."""
    flat = export_flat(df)
    if flat.isEmpty():
        return False
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return True


def log_search(spark: SparkSession, path: str, country: str, query: str) -> None:
    """Append one search to the log."""
    row = spark.range(1).select(
        F.lit(country).alias("country"), F.lit(query).alias("query"),
        F.current_timestamp().alias("ran_at"),
    )
    row.write.mode("append").parquet(path)


def write_probe_report(probes: DataFrame, path: str) -> None:
    """Totals and per-source results of a probe run, by country."""
    summary = probe_summary(probes).withColumn("checked_at", F.current_timestamp())
    summary.write.mode("overwrite").json(f"{path}/summary")
    results = probe_results(probes)
    results.write.mode("overwrite").partitionBy("country").json(f"{path}/results")
