"""Spreadsheets and SQLite tables by partitions of rows, pruned columns and pushed filters."""

import sqlite3
import zipfile

import pytest
from placelens.sources import sheets


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_xlsx_round_trip(spark, tmp_path, parts):
    rows = spark.range(4321).selectExpr("id", "CASE WHEN id % 7 <> 0 THEN concat('  <A & é', id, '>') END AS `The Name`", "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS kind").repartition(2)
    written = sheets.write_xlsx(rows, f"file://{tmp_path}/x", "S & T").collect()
    assert sum(r.n_rows for r in written) == 4321 and len(written) == 2
    df = sheets.register(spark).read.format("sheet").schema("kind string, the_name string, none string").option("parts", parts).option("sheet", "S & T").load(f"file://{tmp_path}/x")
    assert df.rdd.getNumPartitions() == 2 * parts
    assert sorted(map(tuple, df.select("the_name", "kind").collect()), key=str) == sorted(((r[1], r[2]) for r in rows.collect()), key=str)
    assert df.where("none IS NOT NULL").count() == 0
    some = df.where("kind = 'b' AND the_name LIKE '  <A & é1%'")
    assert some.count() == rows.where("kind = 'b' AND `The Name` LIKE '  <A & é1%'").count()
    assert "PushedFilters" not in _plan(some) or "kind" in _plan(some)
    assert "(kind" not in _plan(some).partition("Physical Plan")[2], "the reader has taken the filter over"


def test_skip_and_missing(spark, tmp_path):
    rows = spark.createDataFrame([("title", None), ("Code", "Rank"), ("E0", "7")], "a string, b string").coalesce(1)
    sheets.write_xlsx(rows, f"file://{tmp_path}/y").collect()
    df = sheets.register(spark).read.format("sheet").schema("rank string").option("skip", 2).load(f"file://{tmp_path}/y/*.xlsx")
    assert [r.rank for r in df.collect()] == ["7"]
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("sheet").schema("a string").load(f"file://{tmp_path}/none").collect()
    with pytest.raises(Exception, match="strings"):
        spark.read.format("sheet").schema("a int").load(f"file://{tmp_path}/y").collect()


def test_ods(spark, tmp_path):
    ns = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    row = lambda a, b, more="": f"<table:table-row{more}><table:table-cell><text:p>{a}</text:p></table:table-cell><table:table-cell><text:p>{b}</text:p></table:table-cell></table:table-row>"
    body = row("Name", "Rank") + "".join(row(f"n{k}", k) for k in range(2500)) + row("twice", "x", ' table:number-rows-repeated="2"')
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", f'<office:document-content {ns}><office:body><office:spreadsheet><table:table table:name="T">{body}</table:table></office:spreadsheet></office:body></office:document-content>')
    df = sheets.register(spark).read.format("sheet").schema("rank string, name string").option("kind", "ods").option("parts", 3).load(f"file://{tmp_path}/a.ods")
    assert df.count() == 2502 and df.where("name IN ('n7', 'twice')").count() == 3 and df.where("name = 'n2001'").first().rank == "2001"


def test_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "a.gpkg")
    db.execute("create table t (code text, n integer, geom blob)")
    db.executemany("insert into t values (?, ?, ?)", [(f"E{k % 9}" if k % 5 else None, k, b"x") for k in range(1000)])
    db.execute("delete from t where n between 100 and 300")
    db.execute("create table empty (code text)")
    db.commit()
    df = sheets.register(spark).read.format("sqlite_table").schema("n string, code string").option("table", "t").option("parts", 4).load(f"file://{tmp_path}/a.gpkg")
    assert df.rdd.getNumPartitions() == 4 and df.count() == 799
    assert sorted(int(r.n) for r in df.where("code = 'E3'").collect()) == [k for k in range(1000) if k % 9 == 3 and k % 5 and not 100 <= k <= 300]
    assert df.where("code IS NULL").count() == len([k for k in range(0, 1000, 5) if not 100 <= k <= 300])
    assert spark.read.format("sqlite_table").schema("code string").option("table", "empty").load(f"file://{tmp_path}/a.gpkg").count() == 0
