"""Ruling lines of rasters, recognised tables, characters of regions, stored rows."""

import numpy as np

from gridsmith.operators import layout
from gridsmith.sources import readers


def test_ruling_lines(spark):
    image = np.full((60, 100), 255, np.uint8)
    image[10:12, 5:95] = 0
    image[10:12, 40] = 255  # a gap of one pixel
    image[40, 10:20] = 0  # too short
    image[:, 70] = 20
    image[30:50, 80:99] = 0  # too thick
    d = spark.createDataFrame([(1, 100, 60, bytearray(image.tobytes()), 7.0, 3.0, 1.0)], "region_id int, width int, height int, pixels binary, x double, y double, scale double")
    got = layout.ruling_lines(d).first()
    assert got["horizontal"] == [3.0 + 59.5 - 10.5] and got["vertical"] == [77.5]


def test_recognised_tables(spark):
    assert readers.ENGINES["layout"] is layout.read_grid
    box = "struct<x:double,y:double,width:double,height:double>"
    schema = f"region_id int, table_no int, box {box}, cells array<struct<row:int,col:int,row_span:int,col_span:int,text:string,box:{box},lines:array<struct<box:{box},confidence:double>>>>"
    b = lambda w: (0.0, 0.0, float(w), 1.0)
    found = [(1, 0, b(5), [(0, 0, 1, 1, "small", b(1), [])]), (1, 1, b(9), [(0, 0, 1, 2, " two\nlines ", b(3), [(b(1), 0.9), (b(2), 0.4)]), (0, 0, 1, 1, "again", b(3), []), (1, 0, 1, 1, "", b(3), [])])]
    got = {r["row"]: r for r in readers.structure_tables(spark.createDataFrame(found, schema)).collect()}
    assert got[0]["text"] == "two lines" and got[0]["score"] == 0.4 and len(got[0]["regions"]) == 2 and got[0]["flags"] == ["spansColumns"] and got[1]["regions"] == []
    tables = spark.createDataFrame([("d", 0, (0.0, 0.0, 10.0, 10.0)), ("d", 0, (0.0, 50.0, 10.0, 10.0))], f"document_id string, page int, box {box}")
    pages = spark.createDataFrame([("d", 0, (0.0, 0.0, 100.0, 62.0))], f"document_id string, page int, crop {box}")
    assert [(r["place"], tuple(r["region"])) for r in readers.detected_tables(tables, pages).orderBy("place").collect()] == [(0, (0.0, 46.0, 14.0, 16.0)), (1, (0.0, 0.0, 14.0, 14.0))]


def test_region_chars_and_decoded_rows(spark):
    words = spark.createDataFrame([("d", 0, "a b", 0.0, 10.0, 0.0, 10.0), ("d", 0, "far", 90.0, 99.0, 0.0, 10.0)], "document_id string, page int, text string, x0 double, x1 double, y0 double, y1 double")
    regions = spark.createDataFrame([(1, "d", 0, (0.0, 0.0, 50.0, 50.0)), (2, "d", 0, (200.0, 0.0, 5.0, 5.0))], "region_id int, document_id string, page int, region struct<x:double,y:double,width:double,height:double>")
    assert {r["region_id"]: r["region_chars"] for r in readers.region_chars(words, regions).collect()} == {1: 2, 2: 0}
    rows = spark.createDataFrame([("odd", None, '["a"]')], "status string, review string, flags string")
    assert tuple(readers.decoded(rows, {"flags": "array<string>"}).first()) == ("failed", "unreviewed", ["a"])
    messages = spark.createDataFrame([('{"protocol": 2, "type": "result", "job": "j"}',), ('{"protocol": 1, "type": "error", "job": "k", "error": "no page"}',), ('{"protocol": 1, "type": "progress", "job": "k"}',)], "value string")
    assert {r["job"]: r["error"] for r in readers.worker_errors(messages).collect()} == {"j": "unknown protocol 2", "k": "no page"}
