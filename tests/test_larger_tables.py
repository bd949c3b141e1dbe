from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from loomline.operators import index
from loomline.operators.dedup import first_wins
from loomline.plans import search as searches
from loomline.plans.cleaning import cleaned, stored
from loomline.plans.fixtures import FIRST_SEEN, garments


@pytest.fixture
def shops(spark, tmp_path):
    """Listings of one part and price at several urls, some of them twice, and one dearer."""
    def write(name, ddl, rows):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")

    day = datetime.datetime(1997, 1, 2)
    lines = [(order, 1 + again, 1, 5, 100.0 + (order == 4), 10.0, 0.04, 0.02, "R", "O", day)
             for order in (30, 4, 200, 17, 100) for again in range(1 + order % 2)]
    write("lineitem", """l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long,
        l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_returnflag string,
        l_linestatus string, l_shipdate timestamp""", lines)
    write("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
          [(1, "red widget", "Brand#1", "LARGE", 7)])
    write("supplier", "s_suppkey long, s_nationkey long", [(5, 3)])
    write("nation", "n_nationkey long, n_name string, n_regionkey long", [(3, "NATION_3", 1)])
    return str(tmp_path)


def test_listings_are_indexed_by_numbers_in_the_order_of_their_urls(spark, shops, monkeypatch):
    made = []
    create = index.create_index
    monkeypatch.setattr(index, "create_index", lambda *a, **k: made.append(create(*a, **k)) or made[-1])
    found = searches.search_listings(spark, shops).where("query = 'red widget'").orderBy("rank").collect()
    address = "https://shop5.example/products/"
    assert [r.url for r in found] == [address + order for order in ("100", "17", "200", "30", "4")]
    assert [r.id for r in found] == [1001, 171, 2001, 301, 41]
    assert made[0].id_type == "bigint"


def test_stored_listings_are_shuffled_once(spark, shops):
    rows = stored(spark, shops, ["id", "url", "gender"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    want = first_wins(cleaned(spark, shops), ["url"], FIRST_SEEN).select("id", "url", "gender")
    assert sorted(rows.collect()) == sorted(want.collect()) and rows.count() == 5


def test_garments_of_one_file_reach_all_tasks(spark, tmp_path):
    spark.range(60000).selectExpr(
        "id AS p_partkey", "concat('red widget ', sha2(CAST(id AS STRING), 512)) AS p_name", "'Brand#1' AS p_brand",
        "'LARGE' AS p_type", "CAST(id % 50 AS INT) AS p_size", "CAST(id AS DOUBLE) AS p_retailprice",
    ).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = garments(spark, str(tmp_path))
    assert rows.where("title LIKE 'red widget %' AND p_partkey = p_retailprice").count() == 60000
    spread = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 1 and max(row["count"] for row in spread) < 40000
