"""The viewport layout reads few files and answers as a full scan does."""

import math
import random

from placelens.operators import indexed, relational
from pyspark.sql import functions as F

_KIND = "provider_id long, care_type int, lat double, lon double, bbox_south double, bbox_west double, bbox_north double, bbox_east double, note string"


def _providers(spark, n=3000):
    rng, rows = random.Random(4), []
    for k in range(n):
        lat, lon = rng.uniform(-60, 60), rng.uniform(-170, 170)
        place = (None,) * 6 if k % 50 == 0 else (None, None, lat, lon, lat + 0.1, lon + 0.1) if k % 5 == 0 else (lat, lon, None, None, None, None)
        rows += [(k, care if k % 3 else None, *place, None) for care in range(1 + k % 3)]
    return spark.createDataFrame(rows, _KIND)


def test_few_files_for_a_viewport(spark, tmp_path):
    df, where = _providers(spark), f"file://{tmp_path}/i"
    files = indexed.write_index(df, where, 32).collect()
    assert sum(r.n for r in files) == df.count() and len(files) > 16
    ranges = spark.read.parquet(f"{where}/ranges")
    assert ranges.count() == ranges.select("provider_id").distinct().count() == 3000
    for box in ((10.0, 10.0, 14.0, 16.0), (-80.0, -180.0, 80.0, 180.0), (89.0, 0.0, 90.0, 1.0)):
        got = indexed.read_viewport(spark, where, box)
        south, west, north, east = indexed.spatial.extent()
        want = df.where((south <= box[2]) & (north >= box[0]) & (west <= box[3]) & (east >= box[1]))
        assert sorted(r.provider_id for r in got.collect()) == sorted(r.provider_id for r in want.collect())
        if box[0] == 10.0:
            assert 0 < len(got.inputFiles()) <= len(files) / 4 and got.count()
    # a provider's rows lie where ranges say
    r = ranges.where("n = 3").first()
    own = spark.read.parquet(f"{where}/rows/{r.file}").select("provider_id", F.col("_metadata.row_index").alias("k")).where(F.col("k").between(r["first"], r["first"] + 2))
    assert {x.provider_id for x in own.collect()} == {r.provider_id}
    some = spark.read.parquet(f"{where}/rows").where("provider_id = 0").first()
    assert some.care_type == -1 and some.lat is None and some.south is None
    views = spark.createDataFrame([(1, 10.0, 10.0, 14.0, 16.0), (2, 12.0, 12.0, 15.0, 20.0)], "query_id int, south double, west double, north double, east double")
    assert indexed.read_viewports(spark, where, views).where("query_id = 1").count() == indexed.read_viewport(spark, where, (10.0, 10.0, 14.0, 16.0)).count()


def test_curve_and_sentinels(spark):
    rows = spark.createDataFrame([(-90.0, -180.0), (90.0, 180.0), (None, 1.0), (0.0, 0.0)], "lat double, lon double")
    assert [r[0] for r in rows.select(indexed.curve(F.col("lat"), F.col("lon"))).collect()] == [0, 2**32 - 1, None, 3 << 30]
    (r,) = indexed.with_sentinels(spark.createDataFrame([(None, None, None)], "a int, b double, c string")).collect()
    assert r.a == -1 and math.isnan(r.b) and r.c is None


def test_row_ranges_and_samples(spark):
    rng = random.Random(2)
    keys = [rng.randint(0, 60) for _ in range(500)]
    df = spark.createDataFrame([(k, v % 40) for v, k in enumerate(keys)], "k int, v int").repartition(5)
    ordered = sorted(keys)
    assert {tuple(r) for r in indexed.row_ranges(df, "k").collect()} == {(k, ordered.index(k), ordered.count(k)) for k in set(keys)}
    got = {r.k: (r.n, r["sample"]) for r in relational.samples(df, ["k"], "v", 3).collect()}
    assert got == {k: (keys.count(k), ",".join(map(str, sorted({v % 40 for v, x in enumerate(keys) if x == k})[:3]))) for k in set(keys)}
    top = relational.top_k(df, ["k"], [F.col("v")], 2)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert {(r.k, r.overflow) for r in top.collect()} == {(k, keys.count(k) > 2) for k in set(keys)}
