"""Postcode documents: one per outward code, with boxes, centres and a local dictionary of area codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def postcode_rows(postcodes: DataFrame, boxes: DataFrame, delta: float = 0.002) -> DataFrame:
    """outward, inward, box [w, s, e, n], centre [lon, lat], codes.

    postcodes: postcode, lat, lon, lad, county, quality; boxes: postcode, south,
    west, north, east. Unplaced postcodes (quality 9 or no coordinates) are left
    out; a postcode without a box gets delta around its point; a county code that
    ends in 999999 or equals the district's is left out.
    """
    own = postcodes.where("quality <> 9 and lat is not null and lon is not null").join(boxes, "postcode", "left")
    side = lambda c, p: F.round(F.coalesce(F.col(c), p), 6)
    box = F.array(side("west", F.col("lon") - delta), side("south", F.col("lat") - delta), side("east", F.col("lon") + delta), side("north", F.col("lat") + delta))
    codes = F.array_compact(F.array(F.col("lad"), F.when(~F.col("county").endswith("999999") & (F.col("county") != F.col("lad")), F.col("county"))))
    return own.select(F.substring_index("postcode", " ", 1).alias("outward"), F.substring_index("postcode", " ", -1).alias("inward"), box.alias("box"), F.array("lon", "lat").alias("centre"), codes.alias("codes"))


def postcode_documents(rows: DataFrame) -> DataFrame:
    """(outward, doc): JSON {"_": codes, "<inward>": {"b", "c", "a"}} where a holds places in the codes."""
    words = rows.select("outward", F.explode("codes").alias("code")).groupBy("outward").agg(F.array_sort(F.collect_set("code")).alias("words"))
    placed = rows.join(words, "outward", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    entry = F.struct("inward", F.to_json(F.struct(F.col("box").alias("b"), F.col("centre").alias("c"), F.transform("codes", lambda x: (F.array_position("words", x) - 1).cast("int")).alias("a"))).alias("json"))
    docs = placed.groupBy("outward").agg(F.first("words").alias("dictionary"), F.array_sort(F.collect_list(entry)).alias("entries"))
    body = F.transform("entries", lambda e: F.concat(F.lit('"'), e["inward"], F.lit('":'), e["json"]))
    return docs.select("outward", F.concat(F.lit('{"_":'), F.to_json("dictionary"), F.when(F.size(body) > 0, ",").otherwise(""), F.array_join(body, ","), F.lit("}")).alias("doc"))
