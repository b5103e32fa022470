"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from brindle.sources import files, weather


def test_fixed_width_stations(spark, tmp_path):
    line = "USW00094728  40.7789  -73.9692   42.7 NY NEW YORK CNTRL PK TWR         GSN"
    (tmp_path / "s.txt").write_text(line + "\nbroken\n")
    r = weather.read_stations(spark, str(tmp_path / "s.txt")).collect()
    assert len(r) == 1 and (r[0]["station_id"], r[0]["lat"], r[0]["lon"], r[0]["elevation"]) == ("USW00094728", 40.7789, -73.9692, 42.7)
    (tmp_path / "i.txt").write_text("USW00094728  40.7789  -73.9692 TMAX 1869 2024\nUSW00094728  40.7789  -73.9692 PRCP 1850 2020\n")
    r = weather.read_inventory(spark, str(tmp_path / "i.txt")).first()
    assert (r["first_year"], r["last_year"], r["elements"]) == (1850, 2024, ["PRCP", "TMAX"])


def test_daily_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text("A,20200101,TMAX,250,,,S,\nA,20200101,TMAX,260,,,S,\nA,20200101,TMIN,-30,,X,S,\nA,19990101,TMAX,1,,,S,\n")
    rows = weather.read_daily_csv(spark, str(tmp_path / "d.csv"), 2000, 2024).collect()
    assert len(rows) == 1 and rows[0]["tmax"] == 26.0 and rows[0]["tmin"] is None and rows[0]["prcp"] is None
    assert weather.read_daily_csv(spark, str(tmp_path / "d.csv"), 2000, 2024, skip_flagged=False).first()["tmin"] == -3.0


def test_hourly_gzip(spark, tmp_path):
    line = "2020 01 02 03   -25   -50 10132   270    36     8    -9999    12"
    with gzip.open(tmp_path / "h.gz", "wt") as f:
        f.write(line + "\nshort\n")
    r = weather.read_hourly(spark, str(tmp_path / "h.gz")).collect()
    assert len(r) == 1 and r[0]["date"] == "2020-01-02" and r[0]["hour"] == 3 and r[0]["air_temp"] == -2.5 and r[0]["sea_level_pressure"] == 1013.2


def test_white_space_table(spark, tmp_path):
    (tmp_path / "b.txt").write_text("#YY MM DD hh WVHT\n#yr mo dy hr m\n98 01 02 03 1.5\n07 01 02 03 MM\n")
    rows = weather.read_table(spark, str(tmp_path / "b.txt")).orderBy("year").collect()
    assert [(r["year"], r["WVHT"]) for r in rows] == [(1998, 1.5), (2007, None)]


def test_buoys_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<stations><station id="1" lat="1.5" lon="-2" name="n" type="buoy" met="y" currents="n"/></stations>')
    r = weather.read_buoys_xml(spark, str(tmp_path / "a.xml")).first()
    assert (r["station_id"], r["lat"], r["met"], r["currents"], r["dart"]) == ("1", 1.5, True, False, False)


def test_geojson_and_fastq(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"a":"1"},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}')
    r = files.read_geojson(spark, str(tmp_path / "g.json")).select("properties", files.line_of(F.col("geometry")).alias("line")).first()
    assert r["properties"] == {"a": "1"} and [tuple(p) for p in r["line"]] == [(1.0, 2.0), (3.0, 4.0)]
    (tmp_path / "r.fastq").write_text("@a\nACGT\n+\nIIII\n@b\nAC\n+\n!!\n")
    q = files.fastq_quality(spark, str(tmp_path / "r.fastq")).first()
    assert (q["reads"], q["bases"]) == (2, 6) and q["mean_phred"] == pytest.approx(160 / 6)


def test_gtfs(spark, tmp_path):
    (tmp_path / "stops.txt").write_bytes("﻿stop_id,stop_name\n1,A\n".encode())
    assert [tuple(r) for r in files.read_gtfs(spark, str(tmp_path), "stops", ["stop_id", "stop_name", "zone"]).collect()] == [("1", "A", None)]
    assert files.read_gtfs(spark, str(tmp_path), "trips", ["trip_id"]).count() == 0


def test_guarded_sql(spark):
    assert files.guarded_sql(spark, "select 1 as x", 10).first()["x"] == 1
    for bad in ("drop table x", "select 1; drop table x", "with a as (select 1) insert into b select * from a"):
        with pytest.raises(ValueError):
            files.guarded_sql(spark, bad)


def test_upsert_and_cache(spark, tmp_path):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    changes = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, None, 1)], "k int, v string, at int")
    assert sorted(map(tuple, files.upsert(store, changes, ["k"], "at").collect())) == [(1, "a"), (2, "y"), (3, None)]
    key = files.cache_key({"a": 1}, {"p": 2}, "1")
    assert key != files.cache_key({"a": 2}, {"p": 2}, "1")
    assert files.cached(store, f"file://{tmp_path}", key).count() == 2 and files.cached(store.limit(0), f"file://{tmp_path}", key).count() == 2
