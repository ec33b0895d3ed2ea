import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from inkloom.operators.flatten import flatten
from inkloom.sources import pagexml

BODY = """﻿<?xml version="1.0" encoding="ISO-8859-8"?>
<p:PcGts xmlns:p="urn:x"><p:Page><p:TextRegion id="r0"><p:Coords points="0,0 9,9 8,8"/><p:TextEquiv><p:Unicode>region</p:Unicode></p:TextEquiv>
<p:TextRegion id="r1"><p:TextLine id="l0"><p:Coords points=" 1,2 3.5,-4 "/><p:Baseline points="1,1 2,2"/><p:Word><p:Coords points="7,7 8,8"/><p:TextEquiv><p:Unicode>w</p:Unicode></p:TextEquiv></p:Word>
<p:TextEquiv index="0"><p:Unicode>שלום &amp; </p:Unicode></p:TextEquiv><p:TextEquiv/></p:TextLine></p:TextRegion>
<p:TextLine><p:Coords><p:Point x="1" y="2"/><p:Point x="3" y="4"/></p:Coords></p:TextLine></p:TextRegion>
<p:TableRegion><p:TextRegion><p:TextLine><p:Coords points="1;2 3;4"/></p:TextLine><p:TextLine><p:Coords points="1,2 n/a"/></p:TextLine><p:TextLine><p:Coords><p:Point x="1" y="2"/><p:Point x="x" y="4"/></p:Coords></p:TextLine></p:TextRegion></p:TableRegion>
<p:TextLine><p:TextEquiv><p:PlainText>plain</p:PlainText></p:TextEquiv></p:TextLine></p:Page></p:PcGts>"""


def brute(body):
    """The keys by walking the tree recursively."""
    out, counts = [], {"r": 0, "l": 0}
    local = lambda e: e.tag.rpartition("}")[2]

    def number(v):
        try:
            float(v)
            return True
        except (TypeError, ValueError):
            return False

    def walk(e, region):
        if local(e) == "TextRegion":
            region = counts["r"]
            counts["r"] += 1
        if local(e) == "TextLine":
            line = counts["l"]
            counts["l"] += 1
            out.append((region, line, "line", 0))
            for c in e:
                if local(c) == "Coords":
                    pts = [p.split(",") for p in c.get("points").split()] if c.get("points") else [(p.get("x"), p.get("y")) for p in c]
                    if all(len(p) == 2 and all(map(number, p)) for p in pts):
                        out.extend((region, line, "coords", k) for k in range(len(pts)))
            n = sum(local(c) == "TextEquiv" for c in e)
            out.extend((region, line, "textequiv", k) for k in range(n))
        for c in e:
            walk(c, region)

    walk(ET.fromstring(body.removeprefix("﻿")), None)
    return out


def test_tables(spark):
    rows = [(1, BODY, "x"), (1, BODY, "y"), (2, None, ""), (3, " ", ""), (4, "<a>", ""), (5, "<PcGts/>", ""), (6, "<TextLine/>", ""), (None, "<TextLine/>", "")]
    df = spark.createDataFrame(rows, "xml_id bigint, body string, lines string")
    nested = pagexml.records(df)
    got = [tuple(r) for r in pagexml.keys(nested).collect()]
    assert sorted(got, key=repr) == sorted([(1, *k) for k in brute(BODY)] + [(6, None, 0, "line", 0), (None, None, 0, "line", 0)], key=repr)
    lines = {(r.xml_id, r.line_no): r for r in pagexml.lines(nested).collect()}
    assert (lines[1, 0].region_no, lines[1, 0].line_id, lines[1, 0].region_id) == (1, "l0", "r1") and lines[1, 5].region_no is None
    points = sorted((r.line_no, r.point_no, r.x, r.y) for r in pagexml.points(nested).where("xml_id = 1").collect())
    assert points == [(0, 0, 1.0, 2.0), (0, 1, 3.5, -4.0), (1, 0, 1.0, 2.0), (1, 1, 3.0, 4.0)]
    texts = sorted((r.line_no, r.reading_no, r.idx, r.text) for r in pagexml.readings(nested).where("xml_id = 1").collect())
    assert texts == [(0, 0, "0", "שלום & "), (0, 1, None, None), (5, 0, None, "plain")]
    assert pagexml.keys(pagexml.records(df.limit(0))).count() == 0


def test_very_long_and_deep_bodies(spark):
    deep = "<TextRegion>" * 20_000 + "<TextLine/>" + "</TextRegion>" * 20_000
    wide = "<PcGts>" + "<TextLine><Coords points='1,2 3,4'/></TextLine>" * 20_000 + "</PcGts>"
    df = spark.createDataFrame([(1, deep), (2, wide)], "xml_id int, body string")
    got = {r.xml_id: (r.n, r.region) for r in pagexml.keys(pagexml.records(df)).groupBy("xml_id").agg(F.count(F.lit(1)).alias("n"), F.max("region_no").alias("region")).collect()}
    assert got == {1: (1, 19_999), 2: (60_000, None)}


def test_flatten_against_explode(spark):
    data = [{"k": 1, "a": [{"b": [{"v": 1}, {"v": None}], "n": "x"}, None, {"b": [], "n": "y"}, {"b": None, "n": "z"}]}, {"k": 2, "a": []}, {"k": 3, "a": None}, {"k": None, "a": [{"b": [{"v": 7}, None], "n": None}]}]
    df = spark.read.schema("k int, a array<struct<b:array<struct<v:int>>,n:string>>").json(spark.sparkContext.parallelize(map(json.dumps, data)))
    one = flatten(df, ["k"], [("a", "i")], {"n": "n"})
    assert sorted(map(repr, one.collect())) == sorted(map(repr, df.select("k", F.posexplode("a").alias("i", "x")).select("k", "i", "x.n").collect()))
    two = flatten(df, ["k"], [("a", "i"), ("b", "j")], {"v": "v", "whole": "."})
    want = df.select("k", F.posexplode("a").alias("i", "x")).select("k", "i", F.posexplode("x.b").alias("j", "y")).select("k", "i", "j", F.col("y.v").alias("v"), F.col("y").alias("whole"))
    assert sorted(map(repr, two.collect())) == sorted(map(repr, want.collect()))
