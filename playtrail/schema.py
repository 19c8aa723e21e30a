"""Declared schemas of the two inputs; nothing is inferred from files."""

from pyspark.sql import types as T

PLAYS = T.StructType(
    [
        T.StructField("account_id", T.LongType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("asset_id", T.LongType()),
        T.StructField("tunein", T.TimestampNTZType()),
        T.StructField("tuneout", T.TimestampNTZType()),
        T.StructField("resume", T.IntegerType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("asset_id", T.LongType()),
        T.StructField("content_id", T.LongType()),
        T.StructField("show_type", T.StringType()),
        T.StructField("released_year", T.IntegerType()),
        T.StructField("country_of_origin", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("cast_first_name", T.StringType()),
        T.StructField("run_time_min", T.DoubleType()),
        T.StructField("audience", T.StringType()),
        T.StructField("made_for_tv", T.StringType()),
        T.StructField("pay_per_view", T.StringType()),
        T.StructField("pack_premium_1", T.StringType()),
        T.StructField("pack_premium_2", T.StringType()),
        T.StructField("create_date", T.TimestampNTZType()),
        T.StructField("modify_date", T.TimestampNTZType()),
        T.StructField("start_vod_date", T.TimestampNTZType()),
        T.StructField("end_vod_date", T.TimestampNTZType()),
    ]
)

FLAG_COLUMNS = ["made_for_tv", "pay_per_view", "pack_premium_1", "pack_premium_2"]
