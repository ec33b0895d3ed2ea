import math
import struct
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkloom.functions import text
from inkloom.operators import batching, charset, combine, ctc, geometry, image, infer, lm, runlog
from inkloom.sources import readers, sinks


# ---- character sets
def test_charset(spark):
    texts = spark.createDataFrame([("אאא",), ("ב",), (None,), ("",)], "t string")
    built = charset.build(texts, "t", 2)
    assert sorted(map(tuple, built.collect())) == [(0, ""), (1, "א")]
    more = charset.extend(built, spark.createDataFrame([("גבב",)], "t string"), "t")
    assert sorted(map(tuple, more.collect())) == [(0, ""), (1, "א"), (2, "ב"), (3, "ג")]
    codec = charset.Codec(more)
    df = spark.createDataFrame([("אבxג",), ("",), (None,)], "t string").withColumn("codes", codec.encode(F.col("t")))
    rows = df.select("codes", codec.decode(F.col("codes")).alias("d"), codec.known_part(F.col("t"), F.col("codes")).alias("k")).collect()
    assert [(r.codes, r.d, r.k) for r in rows] == [([1, 2, 3], "אבג", 0.75), ([], "", 1.0), ([], "", 1.0)]
    assert [r.ch for r in charset.intersect(built.where("idx > 0"), more).collect()] == ["א"]
    assert len(set(charset.STANDARD)) == len(charset.STANDARD) and set("{}\\_<>~^$[]/") <= set(charset.STANDARD)
    assert charset.STANDARD.index("ת") == 26 and charset.STANDARD[27:38] == "0123456789 " and charset.STANDARD.endswith("XYZ")


# ---- language models
def test_char_model(spark):
    texts = spark.createDataFrame([("שלום עולם",)] * 100 + [("",), (None,)], "t string")
    grams = lm.char_ngrams(texts, "t", 4)
    counts = {(r.n, r.gram): r.cnt for r in grams.collect()}
    want = Counter()
    line = lm.PAD + "שלום עולם"
    for n in range(1, 5):
        want.update({(n, line[i : i + n]): 100 for i in range(len(line) - n + 1)} if n > 2 else Counter({(n, g): c for g, c in Counter(line[i : i + n] for i in range(len(line) - n + 1) for _ in range(100)).items()}))
    assert counts == dict(want)
    total = 900

    def logprob(context, ch):
        context = context[-3:]
        penalty = 0.0
        for k in range(len(context), -1, -1):
            ctx = context[len(context) - k :] if k else ""
            if num := counts.get((k + 1, ctx + ch), 0):
                den = counts.get((k, ctx), 0) if k else total
                if den:
                    return penalty + math.log(num / den)
            penalty += math.log(0.4)
        return penalty - math.log(total)

    asked = ["שלום", "שלוז", "zz", "ש"]
    got = {r.t: r.logprob for r in lm.char_logprobs(spark.createDataFrame([(t,) for t in asked], "t string").withColumn("k", F.col("t")), "k", "t", grams, 4).withColumnRenamed("k", "t").collect()}
    for t in asked:
        assert math.isclose(got[t], sum(logprob(t[:i], t[i]) for i in range(len(t))), rel_tol=1e-9), t
    assert logprob("שלו", "ם") > logprob("שלו", "ז") > -math.inf
    assert lm.prune_ngrams(grams, 1000).where("n > 2").count() == 0


def test_word_model(spark):
    corpus = spark.createDataFrame([(t,) for t in ["שלום עולם שלום", "שלום לכם", "בית ספר גדול", "הבית הגדול"]], "t string")
    words = lm.word_counts(corpus, "t")
    total = words.agg(F.sum("cnt").alias("total"))
    asked = spark.createDataFrame([("שלום",), ("ושלום",), ("זזז",), ("",)], "word string")
    got = {r.word: r for r in lm.word_logprobs(asked, words, total).collect()}
    assert got["זזז"].logprob == lm.OOV and got["זזז"].bonus == 0 and not got["זזז"].known and got[""].logprob == 0
    assert lm.OOV < got["ושלום"].logprob < got["שלום"].logprob and got["ושלום"].known
    assert math.isclose(got["שלום"].logprob, math.log(3 / 10))
    assert [r.word for r in lm.prune_words(words, 2).collect()] == ["שלום"]
    assert spark.range(1).select(lm.last_word(F.lit("ab cd"))).first()[0] == "cd"


# ---- decoding
def frames(*best, classes=3):
    return [[math.log(0.9) if c == b else math.log(0.1 / (classes - 1)) for c in range(classes)] for b in best]


SYMBOLS = ["", "א", "ב"]


def decoded(spark, f):
    df = spark.createDataFrame([(1, f)], "k int, f array<array<double>>")
    return df.select(ctc.greedy(F.col("f"), SYMBOLS)).first()[0], ctc.beam(df, "k", "f", SYMBOLS).first().decoded


def test_ctc(spark):
    for path, want in (([1, 1, 1, 0, 2, 2], "אב"), ([1, 0, 1], "אא"), ([1, 1, 1], "א"), ([0, 0], "")):
        assert decoded(spark, frames(*path)) == (want, want)
    df = spark.createDataFrame([(1, frames(1, 0, 2, 2)), (2, None), (3, [])], "k int, f array<array<double>>")
    rows = df.select(ctc.greedy(ctc.valid(F.col("f"), F.lit(2)), SYMBOLS).alias("t"), ctc.confidence(F.col("f")).alias("c"), ctc.confidence(F.col("f"), True).alias("e")).collect()
    assert rows[0].t == "א" and math.isclose(rows[0].c, 0.9) and math.isclose(rows[0].e, 0.9)
    assert (rows[1].t, rows[1].c, rows[2].t, rows[2].e) == ("", 0.0, "", 0.0)


def test_beam_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = rng.dirichlet(np.ones(3), 5)
        total = Counter()
        for path in np.ndindex(*(3,) * 5):
            text, last = "", 0
            for c in path:
                if c and c != last:
                    text += SYMBOLS[c]
                last = c
            total[text] += math.prod(p[t, c] for t, c in enumerate(path))
        assert ctc.beam_text(np.log(p), SYMBOLS, width=1000, top=3) == max(total, key=total.get)
    tie = np.log(np.array([[0.2, 0.4, 0.4]]))
    assert ctc.beam_text(tie, SYMBOLS, lm=lambda ctx, c: 0.0 if c == "ב" else -5.0) == "ב"


# ---- combining
def test_votes(spark):
    v = combine.vote
    assert v(["abc"] * 3) == "abc" and v(["abX", "abc", "abc"]) == "abc" and v(["abX", "abc"]) == "abX"
    assert v(["abX", "abc", "abc"], [3, 1, 1]) == "abX"
    assert v(["abc", "abYc", "abc"]) == "abc" and v(["abc", "abYc", "abYc"]) == "abYc" and v(["abc", "ac", "ac"]) == "ac"
    assert v([]) == "" and v([None, "a", "a"]) == "a"
    # an insertion needs more than half of all weight, however many ways of inserting there are
    assert v(["abc", "abxc", "abxc", "abyc"]) == "abc" and v(["abc", "abxc", "abxc", "abxc"]) == "abxc" and v(["abc", "abxc"], [1, 3]) == "abxc"
    with pytest.raises(ValueError):
        v(["a"], [1, 2])
    df = spark.createDataFrame([(["abX", "abc", "abc"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(combine.voted(F.col("t"))).collect()] == ["abc", "", ""]


def test_views_and_boards(spark):
    views = spark.createDataFrame([(1, 0, 0.5, "a"), (1, 1, 0.9, " "), (1, 2, 0.5, "b"), (2, 0, 0.1, ""), (3, 1, 0.7, "c")], "k int, v int, s double, t string")
    got = {r.k: (r.text, r.view) for r in combine.choose_view(views, ["k"], "s", "v", "t").collect()}
    assert got == {1: ("a", 0), 2: ("", None), 3: ("c", 1)}
    board = spark.createDataFrame([("x", 0.125, 1), ("y", 0.375, 2), ("z", 0.5, 3)], "m string, v double, o int")
    ours = spark.createDataFrame([(0.25,), (0.1,), (0.9,)], "v double")
    assert [r["rank"] for r in combine.rank_in(ours, "v", board, "v").collect()] == [2, 1, 4]
    assert [r.nearest for r in combine.nearest_in(ours, "v", board, "m", "v", "o").collect()] == ["x", "x", "z"]


# ---- geometry
def test_boxes(spark):
    assert [b[1] for _, b in geometry.order_boxes([(0, 300, 50, 20), (0, 100, 50, 20), (0, 200, 50, 20)], 60)] == [100, 200, 300]
    assert [b[0] for _, b in geometry.order_boxes([(0, 100, 100, 20), (400, 102, 100, 20)], 60)] == [400, 0]
    assert geometry.join_boxes([(0, 0, 50, 20), (80, 2, 50, 20), (0, 100, 50, 20)], 60) == [(0, 0, 130, 22), (0, 100, 50, 20)]
    assert geometry.join_boxes([], 60) == []
    df = spark.createDataFrame([("p", 1, 0, 0, 10, 10), ("p", 2, 100, 100, 10, 10), ("q", 3, 0, 0, 10, 10)], "page string, k int, x int, y int, w int, h int")
    found = spark.createDataFrame([("p", 0, 0, 10, 6), ("p", 100, 100, 4, 10)], "page string, x int, y int, w int, h int")
    got = {r.page: (r.n_gold, r.n_hit) for r in geometry.recall(df, found, "page", "k").collect()}
    assert got == {"p": (2, 1), "q": (1, 0), None: (3, 1)}
    assert geometry.reading_order(df, "page", 10.0).count() == 3 and geometry.merged(df.limit(0), "page", 10.0).count() == 0
    polygons = spark.createDataFrame([("0,0 1,0 1,1",), ("0 0 1 0 1 1",), ("0,0 1,1",), ("0,0 1,x 1,1",), (None,)], "p string").select(geometry.polygon(F.col("p")).alias("p")).collect()
    assert [None if r.p is None else len(r.p) for r in polygons] == [3, 3, None, None, None]
    assert geometry.transcript(spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("p", 3, " "), ("p", 4, None)], "page string, o int, t string"), "page", "o", "t").first().transcript == "a\nb"


# ---- batches
def test_budget(spark):
    widths = np.random.default_rng(1).integers(150, 2400, 3000)
    df = spark.createDataFrame([(i, int(w)) for i, w in enumerate(widths)] + [(9999, None)], "k int, w int")
    rows = batching.budget_batches(df, "k", "w", 20_000, pool=1000).collect()
    assert sorted(r.k for r in rows) == list(range(3000))
    groups = {}
    for r in rows:
        groups.setdefault((r.pool_no, r.batch_no), []).append(r.w)
    assert all(len(g) * max(g) <= 20_000 or len(g) == 1 for g in groups.values()) and max(map(len, groups.values())) <= 64


def test_widths_and_joins(spark):
    one = spark.range(1)
    assert one.select(batching.scaled_width(F.lit(5), F.lit(128)), batching.scaled_width(F.lit(100), F.lit(64)), batching.steps(F.lit(3))).first()[:] == (16, 100, 1)
    assert one.select(batching.padded(F.array(F.lit(1), F.lit(2)), 4)).first()[0] == [1, 2, 0, 0]
    lines = spark.createDataFrame([("p", 1, "a", 700), ("p", 2, "b", 400), ("p", 3, "c", 400), ("q", 1, "d", 5000)], "g string, o int, t string, w int")
    got = {r.g: (r.text, r.width) for r in batching.joined_lines(lines, "g", "o", "t", "w", most=1200).collect()}
    assert got == {"p": ("a b", 1124), "q": ("d", 5000)}


def test_groups_and_draws(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(w), i % 5 != 0) for i, w in enumerate(rng.integers(100, 900, 2000))], "k int, w int, ok boolean")
    rows = batching.joined_groups(df, "k", "w", F.col("ok"), 0.4, widest=1500, pool=500).collect()
    assert sorted(r.k for r in rows) == list(range(2000))
    groups = {}
    for r in rows:
        groups.setdefault((r.pool_no, r.group_no), []).append(r)
    sizes = Counter(len(g) for g in groups.values())
    assert sizes[2] > 50 and sizes[3] > 20 and max(sizes) == 3
    assert all(len(g) == 1 or (all(r.k % 5 for r in g) and g[0].group_width <= 1500) for g in groups.values())
    assert batching.draw([5, 100, 6, 7, 8], 3, 24) == [0, 2, 3] and batching.draw([], 3, 9) == []
    assert batching.draw([100, 5, 6], 3, 24) == [0]  # a first row over the budget is a draw of its own
    one = spark.createDataFrame([(300, "abcdefghij"), (100, "abcdefghij"), (100, ""), (100, None), (1, "abcdefghij")], "w int, t string")
    assert [r[0] for r in one.select(batching.density_factor(F.col("w"), F.col("t"), 10.1)).collect()] == [0.4, 1.0, 1.0, 1.0, 8.0]
    assert [round(r[0], 3) for r in spark.range(3).select(batching.ramp(F.col("id"), 1)).collect()] == [0.665, 1.0, 1.0]
    w = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "g string, w double")
    assert sorted(r.w for r in batching.weights(w, "g", "w").collect()) == [0.25, 0.75, 1.0]


# ---- logs
def test_logs(spark):
    df = spark.createDataFrame([("a", 0, 3.0, 1), ("a", 1, 2.0, 1), ("a", 2, 2.5, 2), ("a", 3, 1.0, 1), ("b", 0, None, 1), ("b", 1, 0.5, 1)], "arm string, e int, v double, c int")
    best = {(r.arm, r.e) for r in runlog.best_so_far(df, "arm", "e", "v").collect()}
    assert best == {("a", 0), ("a", 1), ("a", 3), ("b", 1)}
    assert [r.t for r in runlog.running(df, "arm", "e", "c", "t").where("arm = 'a'").orderBy("e").collect()] == [1, 2, 4, 5]
    v = runlog.verdict(df, "arm", "v", "c", "a", "b").first()
    assert v.better == "b" and math.isclose(v.change_pct, -50)
    lr = [r[0] for r in spark.range(1000).select(runlog.learning_rate(F.col("id"), 1000, 100, 1e-3, 1e-5)).collect()]
    assert math.isclose(lr[99], 1e-3) and all(a >= b for a, b in zip(lr[99:], lr[100:], strict=False)) and min(lr[100:]) >= 1e-5
    still = spark.createDataFrame([("x", i, 5.0) for i in range(50)], "arm string, e int, v double")
    assert runlog.moving_average(still, "arm", "e", "v", 0.99).first().ema == 5.0
    ts = spark.sql("select 'k' as k, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts from values (0), (5), (40) as t(m)")
    assert [r.idle_s for r in runlog.stalls(ts, "k", "ts", 900).collect()] == [2100]


# ---- sources and sinks
def test_samples(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(300)], "k int, s string")
    first = [r.k for r in readers.sample(df, "k", 50, 1).collect()]
    assert len(set(first)) == 50 and first == [r.k for r in readers.sample(df.repartition(3), "k", 50, 1).collect()] != [r.k for r in readers.sample(df, "k", 50, 2).collect()]
    assert Counter(r.s for r in readers.capped(df, "s", "k", {"a": 10}, 4).collect()) == {"a": 10, "b": 4}
    draws = readers.resample(df, "k", 500).collect()
    assert len(draws) == 500 and 150 < len({r.k for r in draws}) < 300
    lines = spark.createDataFrame([(i, "x" * 10) for i in range(5000)], "k int, t string")
    assert readers.corpus_lines(lines, "k", "t", 20_005).count() == 2001
    with pytest.raises(ValueError):
        readers.not_for_training("test")


def test_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a.xml\n\n b.xml \na.xml\n")
    assert {r.name for r in readers.name_list(spark, str(tmp_path / "list.txt")).collect()} == {"a.xml", "b.xml"}
    (tmp_path / "cat.tsv").write_text("page\tx\ttest/train\np1\t0\tTest\np2\t1\ttrain\n")
    assert {tuple(r) for r in readers.catalogue(spark, str(tmp_path / "cat.tsv")).collect()} == {("p1", "test"), ("p2", "train")}
    good, bad = readers.readable(spark, {"ok": str(tmp_path / "list.txt"), "no": str(tmp_path / "none")}, lambda s, p: s.read.text(p))
    assert list(good) == ["ok"] and bad == ["no"]
    assert readers.json_log(spark, str(tmp_path / "none.jsonl"), "epoch int").count() == 0
    df = spark.createDataFrame([(2, 0.5), (1, None)], "k int, v double")
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert readers.json_log(spark, str(tmp_path / "log"), "k int, v double").count() == 4
    assert sinks.markdown(df, ["k"]).splitlines() == ["| k | v |", "| --- | --- |", "| 1 |  |", "| 2 | 0.500 |"]
    assert sinks.cached(spark, str(tmp_path / "c"), lambda: df).count() == sinks.cached(spark, str(tmp_path / "c"), lambda: 1 / 0).count() == 2
    sinks.write_tsv(df, str(tmp_path / "t"))
    sinks.write_json(df, str(tmp_path / "j"))
    names = spark.createDataFrame([("a/b/c.d.xml",), ("x",)], "p string").select(readers.base_name(F.col("p")).alias("b"), readers.stem(F.col("p")).alias("s")).collect()
    assert [tuple(r) for r in names] == [("c.d.xml", "c.d"), ("x", "x")]


def test_alto(spark):
    body = "<alto><TextLine HPOS='1' VPOS='2' WIDTH='10' HEIGHT='5'><String CONTENT='א'/><SP/><String CONTENT='ב'/></TextLine><TextLine><Shape><Polygon POINTS='0 0 5 0 5 5'/></Shape><String CONTENT='ג'/></TextLine></alto>"
    df = spark.createDataFrame([(1, body), (2, "<a>"), (3, None), (4, " ")], "k int, b string")
    rows = readers.alto_lines(df, "k", "b").orderBy("line_no").collect()
    assert [(r.k, r.line_no, len(r.points), r.text) for r in rows] == [(1, 0, 4, "א ב"), (1, 1, 3, "ג")]


def png(pixels):
    h, w = pixels.shape
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def page(n=8, gap=60, width=800, rules=False):
    a = np.full((n * gap + 80, width), 240, np.uint8)
    rng = np.random.default_rng(0)
    for k in range(n):
        y = 50 + k * gap
        for x in range(60, width - 60, 14):
            if rng.random() < 0.85:
                a[y : y + 22, x : x + 9] = 30
        if rules:
            a[y + 30, 20 : width - 20] = 120
    return a


def test_images(spark):
    a = page()
    assert (image.decode_png(png(a)) == a).all() and image.decode_png(b"x") is None and image.decode_png(None) is None
    mask, scale = image.binarize(a)
    assert scale == 1 and abs(image.pitch(mask) - 60) <= 15 and abs(image.skew(mask)) <= 1 and image.pitch(np.zeros((50, 50), bool)) > 0
    for rules in (False, True):
        boxes, angle = image.segment(page(rules=rules))
        assert 6 <= len(boxes) <= 12 and abs(angle) <= 1
        assert [b[1] for b in boxes] == sorted(b[1] for b in boxes)
    assert image.preprocess(a).shape[0] == 64 and 0 < image.ink_fraction(a) < 0.5
    m = np.zeros((5, 7), bool)
    m[0, 0] = m[1, 1] = m[4, 3:6] = True
    assert sorted(image.components(m)) == [(0, 0, 2, 2, 2), (3, 4, 3, 1, 3)]
    df = spark.createDataFrame([("a", bytearray(png(a))), ("b", None), ("c", bytearray(b"zz"))], "k string, c binary")
    assert {r.k: (r.width, r.height) for r in readers.image_sizes(df, "k", "c").collect()} == {"a": (800, 560), "b": (None, None), "c": (None, None)}
    assert {r.k: r.width for r in image.measures(df, "k", "c").collect()} == {"a": 800, "b": None, "c": None}


def test_reader_boundary(spark):
    df = spark.createDataFrame([(i, "x" * i, i) for i in range(10)], "k int, c string, w int")

    def reader(batch):
        if any(len(c) == 9 for c in batch):
            raise RuntimeError
        return [c.upper() for c in batch]

    got = {r.k: r.text for r in infer.read(df.coalesce(1), "k", "c", reader, "w", batch=3).collect()}
    assert got[2] == "XX" and got[9] == ""


def test_streams(spark, tmp_path):
    from inkloom.streaming import logs

    df = spark.sql("select 'a' as k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts, double(m) as v from values (0), (5), (70), (200) as t(m)")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, n in (("w", logs.windowed(stream, "ts", "k", "v"), 3), ("s", logs.sessions(stream, "ts", "k", "20 minutes"), 3)):
        q = out.writeStream.outputMode("append" if name == "s" else "complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() >= n - 1


def test_character_set_round_trip(spark, tmp_path):
    path = str(tmp_path / "set")
    charset.save(charset.standard(spark), path)
    back = charset.restore(spark, path)
    assert {(r.idx, r.ch) for r in back.collect()} == set(enumerate(["", *charset.STANDARD]))
    charset.save(back.where("idx > 0"), path + "2")
    with pytest.raises(ValueError):
        charset.restore(spark, path + "2")


def test_boards_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(combine, "MOST_ENTRIES", 2)
    board = spark.createDataFrame([("x", 1.0, 1), ("y", 2.0, 2), ("z", 3.0, 3)], "m string, v double, o int")
    with pytest.raises(ValueError):
        combine.rank_in(spark.range(1).withColumn("v", F.lit(1.0)), "v", board, "v")


def test_sentences_keep_brackets_and_slashes(spark):
    df = spark.createDataFrame([("נאמר [כאן] או/גם (שם) latin @ 12. ועוד!",)], "t string")
    assert df.select(text.sentences(F.col("t"))).first()[0] == ["נאמר [כאן] או/גם (שם) 12", "ועוד", ""]


def test_rules_at_an_angle_and_upright_ones_go():
    a = page(n=6)
    x = np.arange(a.shape[1])
    for k in range(6):
        y = 50 + k * 60 + 40 + np.round(x * np.tan(np.radians(1.0))).astype(int)
        a[np.clip(y, 0, a.shape[0] - 1), x] = 120
    a[:, 40] = a[:, 41] = 110  # a rule at the margin
    mask, _ = image.binarize(a)
    left = image.without_rules(mask, 60.0)
    assert left[:, 38:44].sum() < 0.1 * mask[:, 38:44].sum()
    letters = page(n=6) < 100
    assert (left & letters).sum() > 0.9 * (mask & letters).sum()
    assert (left & ~letters).sum() < 0.35 * (mask & ~letters).sum()


def test_lines_of_a_page_with_their_crops(spark):
    a = page()
    df = spark.createDataFrame([("a", bytearray(png(a))), ("b", None), ("c", bytearray(b"zz"))], "k string, c binary")
    rows = image.page_lines(df, "k", "c").orderBy("line_no").collect()
    assert {r.k for r in rows} == {"a"} and 6 <= len(rows) <= 12
    assert all(len(r.pixels) == r.height * r.width and r.height > r.h and np.frombuffer(r.pixels, np.uint8).min() < 100 for r in rows)
    assert image.padded_box((0, 0, 10, 100), 105, 12) == (0, 0, 12, 105) and image.padded_box((50, 50, 100, 100), 1000, 1000) == (45, 38, 110, 124)


def test_settled_tables_are_given_back(spark):
    from inkloom import session

    t = session.settle(spark.range(3), "t")
    assert t.count() == 3
    session.release(t, spark.range(1))
    assert not Path(t.settled_at).exists()


def test_alignment_is_shortest_and_does_not_depend_on_other_differences():
    rng = np.random.default_rng(4)
    for _ in range(400):
        a, b = ("".join(rng.choice(list("abc "), rng.integers(0, 12))) for _ in (0, 1))
        at, ins = combine.align(a, b)
        assert "".join(x + y for x, y in zip(ins, [*at, ""], strict=True)) == b
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert sum(map(len, ins)) + sum(x != y for x, y in zip(at, a, strict=True)) == row[-1]
    # a word that two of three have is kept although one of them differs elsewhere, before or behind it
    assert combine.vote(["one two four", "one two three four", "one two three fourX"]) == "one two three four"
    assert combine.vote(["one two four", "one two three four", "Xne two three four"]) == "one two three four"
