"""Reading and writing of files."""

import pytest
from pyspark.sql import functions as F

from playtrail.operators import evaluate, shaping
from playtrail.sources import files


def test_catalog_csv(spark, tmp_path):
    names = "asset_id;content_id;show_type;released_year;country_of_origin;category;keywords;cast_first_name;run_time_min;audience;made_for_tv;pay_per_view;pack_premium_1;pack_premium_2;create_date;modify_date;start_vod_date;end_vod_date"
    (tmp_path / "m.csv").write_text(
        names + "\n7;;Serie;1999;NA;Drama/Cine;a,b;X;30.5;;N;N;N;Y;2021-01-01 00:00:00;;2021-02-03T04:05:06;\n"
    )
    row = files.read_catalog(spark, str(tmp_path / "m.csv")).first()
    assert row["content_id"] is None and row["country_of_origin"] == "NA" and row["audience"] is None
    assert row["start_vod_date"].isoformat() == "2021-02-03T04:05:06" and row["run_time_min"] == 30.5


def test_bad_number_fails_instead_of_becoming_null(spark, tmp_path):
    (tmp_path / "p.csv").write_text("account_id,customer_id,asset_id,tunein,tuneout,resume\nx,1,2,,,0\n")
    with pytest.raises(Exception):
        files.read_plays(spark, str(tmp_path / "p.csv")).collect()


def test_constant_columns_keep_nulls(spark):
    df = spark.createDataFrame([("N", "N", None), ("N", None, "N")], "a string, b string, c string")
    assert files.drop_constant_columns(df).columns == ["b", "c"]


def test_written_slates(spark, tmp_path):
    recs = spark.createDataFrame([(2, 2, 9), (2, 1, 4), (0, 1, 7)], "account_id bigint, pos bigint, content_id bigint")
    users = spark.createDataFrame([(0,), (1,), (2,)], "account_id bigint")
    out = str(tmp_path / "out")
    files.write_recs(recs, users, out)
    lines = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ['0,[7]', '1,[]', '2,"[4, 9]"']


def test_remap_takes_the_last_listed_content(spark):
    catalog = spark.createDataFrame([(1, 10, 1), (1, 5, 2), (2, None, 3)], "asset_id bigint, content_id bigint, line int")
    plays = spark.createDataFrame([(8, 1), (9, 2), (9, 3)], "customer_id bigint, asset_id bigint")
    got = shaping.remap_assets(plays, catalog, order="line").collect()
    assert [(r["customer_id"], r["content_id"]) for r in got] == [(8, 5)]
    assert shaping.remap_assets(plays, catalog, how="left").count() == 3


def test_enrich_multiplies_duplicated_assets(spark):
    catalog = spark.createDataFrame([(1, 10), (1, 11)], "asset_id bigint, content_id bigint")
    assert shaping.enrich_plays(spark.createDataFrame([(1,), (2,)], "asset_id bigint"), catalog).count() == 3


def test_checks_report_and_raise(spark):
    df = spark.createDataFrame([(1, None), (2, 3)], "a bigint, b bigint")
    report = {r["rule"]: r["violations"] for r in evaluate.check(df, evaluate.no_nulls(df)).collect()}
    assert report == {"a is set": 0, "b is set": 1}
    with pytest.raises(AssertionError):
        evaluate.require(df, {"b is set": F.col("b").isNotNull()})
    evaluate.require(df, {"a is set": F.col("a").isNotNull()})


def test_profile(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 2)], "s string, n int")
    got = {r["field"]: (r["rows"], r["filled"], r["distinct_values"]) for r in files.profile(df).collect()}
    assert got == {"s": (3, 2, 1), "n": (3, 2, 2)}
