"""The play log and the catalogue as views of the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the test views.
CUTOFF = "2000-01-01 00:00:00"
EVENT_PERIOD = "weekofyear(ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS asset_id",
        """CASE WHEN p_partkey % 50 = 7 THEN NULL WHEN p_size <= 25 THEN p_partkey
           ELSE p_partkey - p_partkey % 10 END AS content_id""",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS show_type",
        "1970 + p_size AS released_year",
        "p_brand AS country_of_origin",
        "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE replace(p_name, ' ', '/') END AS category",
        "concat(split_part(p_name, ' ', 1), ',', lower(p_type), ',', p_brand) AS keywords",
        """CASE WHEN p_partkey % 17 = 0 THEN NULL
           ELSE concat(split_part(p_name, ' ', 2), ',', split_part(p_name, ' ', 1)) END AS cast_first_name""",
        "CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size + 20 AS DOUBLE) END AS run_time_min",
        """CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'Family'
           ELSE p_type END AS audience""",
        "CASE WHEN p_partkey % 3 = 0 THEN 'Y' WHEN p_partkey % 3 = 1 THEN 'N' ELSE NULL END AS made_for_tv",
        "CASE WHEN p_partkey % 5 = 0 THEN 'Y' ELSE 'N' END AS pay_per_view",
        "'N' AS pack_premium_1",
        "CASE WHEN p_partkey % 4 = 0 THEN 'Y' ELSE 'N' END AS pack_premium_2",
        """TIMESTAMP_NTZ '1999-10-03 12:00:00' + make_dt_interval(CAST(p_partkey % 120 AS INT))
           AS start_vod_date""",
    )


def raw_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plays as logged: without content."""
    orders = table(spark, sf_dir, "orders")
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .selectExpr(
            "o_custkey div 2 AS account_id",
            "o_custkey AS customer_id",
            "l_partkey AS asset_id",
            "o_orderdate AS tunein",
            "l_shipdate AS tuneout",
            "CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS resume",
            """CASE WHEN o_orderdate < TIMESTAMP_NTZ '1998-01-01' THEN 1
               WHEN o_orderdate < TIMESTAMP_NTZ '2000-01-01' THEN 2 ELSE 3 END AS period""",
        )
    )


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    enriched = raw_plays(spark, sf_dir).join(
        catalog(spark, sf_dir).select("asset_id", "content_id"), "asset_id", "left"
    )
    return enriched.select(
        "account_id", "customer_id", "asset_id", "content_id", "tunein", "tuneout", "resume", "period"
    )


def content_or_none() -> Column:
    """The content id with -1 for none, as the compared results carry it."""
    return F.coalesce("content_id", F.lit(-1)).alias("content_id")


def event_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second play log with real clock times: events, their content taken from ``props``."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS account_id",
        "user_id AS customer_id",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS asset_id",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS content_id",
        "ts AS tunein",
        "ts AS tuneout",
        "0 AS resume",
        f"{EVENT_PERIOD} AS period",
    )


ORACLE_CATALOG = """
catalog AS (
 SELECT p_partkey AS asset_id,
  CASE WHEN p_partkey % 50 = 7 THEN NULL WHEN p_size <= 25 THEN p_partkey
       ELSE p_partkey - p_partkey % 10 END AS content_id,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS show_type,
  1970 + p_size AS released_year, p_brand AS country_of_origin,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE replace(p_name,' ','/') END AS category,
  concat(split_part(p_name,' ',1), ',', lower(p_type), ',', p_brand) AS keywords,
  CASE WHEN p_partkey % 17 = 0 THEN NULL
       ELSE concat(split_part(p_name,' ',2), ',', split_part(p_name,' ',1)) END AS cast_first_name,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_size + 20 AS DOUBLE) END AS run_time_min,
  CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'Family' ELSE p_type END AS audience,
  CASE WHEN p_partkey % 3 = 0 THEN 'Y' WHEN p_partkey % 3 = 1 THEN 'N' ELSE NULL END AS made_for_tv,
  CASE WHEN p_partkey % 5 = 0 THEN 'Y' ELSE 'N' END AS pay_per_view,
  'N' AS pack_premium_1,
  CASE WHEN p_partkey % 4 = 0 THEN 'Y' ELSE 'N' END AS pack_premium_2,
  TIMESTAMP '1999-10-03 12:00:00' + to_days(CAST(p_partkey % 120 AS INTEGER)) AS start_vod_date
 FROM part)"""

ORACLE_PLAYS = """
plays AS (
 SELECT o_custkey // 2 AS account_id, o_custkey AS customer_id, l_partkey AS asset_id, content_id,
  o_orderdate AS tunein, l_shipdate AS tuneout,
  CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS resume,
  CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1
       WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 2 ELSE 3 END AS period
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 LEFT JOIN catalog ON l_partkey = asset_id)"""

ORACLE_EVENTS = """
event_plays AS (
 SELECT user_id AS account_id, user_id AS customer_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS asset_id,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS content_id,
  ts AS tunein, ts AS tuneout, 0 AS resume, weekofyear(ts) AS period
 FROM events)"""

ORACLE_SPLIT = """
split AS (
 SELECT account_id,
  row_number() OVER (ORDER BY md5('117:' || account_id), account_id)
   <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test
 FROM (SELECT DISTINCT account_id FROM plays))"""


def sql(body: str, *ctes: str, events: bool = False) -> str:
    """Complete oracle statement: the views it may use, further CTEs, the final SELECT."""
    views = [ORACLE_CATALOG, ORACLE_PLAYS] + ([ORACLE_EVENTS] if events else [])
    return "WITH " + ",".join([*views, *ctes]) + "\n" + body
