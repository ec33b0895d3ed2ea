import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from inkloom.functions import metrics
from inkloom.operators import augment, ctc, image, infer, lm
from inkloom.sources import readers, sinks
from inkloom.streaming import logs
from test_operators import page, png

TEXTS = ["שלום עולם", "שלום לכם", "בית ספר גדול", "שלום"]


def test_model_in_memory_scores_as_the_joins_do(spark, tmp_path):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    grams, words = lm.char_ngrams(df, "t", 3), lm.word_counts(df, "t")
    lm.save(grams, str(tmp_path / "lm"), order=3)
    back, meta = lm.restore(spark, str(tmp_path / "lm"))
    model = lm.Model.load(back, int(meta["order"]), words)
    asked = ["שלום", "ספר עולם", "זקxq", "א"]
    joined = {r.k: r.logprob for r in lm.char_logprobs(spark.createDataFrame([(a, a) for a in asked], "k string, t string"), "k", "t", grams, 3).collect()}
    for a in asked:
        assert math.isclose(joined[a], sum(model.logprob(a[:i], a[i]) for i in range(len(a))), abs_tol=1e-9)
    assert model.logprob("שלו", "ם") > model.logprob("שלו", "ז") > -math.inf
    total = words.agg(F.sum("cnt").alias("total"))
    for r in lm.word_logprobs(spark.createDataFrame([(w,) for w in ("שלום", "ושלום", "חדש")], "word string"), words, total).collect():
        assert math.isclose(r.logprob, model.word_logprob(r.word)) and math.isclose(r.bonus, model.bonus(r.word))
    assert model.bonus("") == 14.0 and model.word_logprob("") == 0.0
    with pytest.raises(ValueError):
        lm.Model.load(grams, 3, words, most=5)
    assert lm.Model.load(grams.limit(0), 3).logprob("ab", "c") == 3 * math.log(0.4)


def test_models_decide_what_frames_leave_open(spark):
    tie = np.log(np.array([[0.02, 0.49, 0.49, 0.0 + 1e-12]] * 1)).tolist()
    df = spark.createDataFrame([(1, tie), (2, None)], "k int, f array<array<double>>")
    grams = lm.char_ngrams(spark.createDataFrame([("bbb",)], "t string"), "t", 3)
    got = {r.k: r.decoded for r in ctc.beam(df, "k", "f", ["", "a", "b", " "], 8, 4, model=lm.Model.load(grams, 3)).collect()}
    assert got == {1: "b", 2: ""}


def test_average_over_what_all_systems_can_say(spark):
    frames = spark.createDataFrame([(1, "x", 0, c, math.log(p)) for c, p in enumerate([0.5, 0.3, 0.2])] + [(1, "y", 0, c, math.log(p)) for c, p in enumerate([0.2, 0.2, 0.6])], "k int, system string, t int, c int, lp double")
    names = spark.createDataFrame([("x", 0, ""), ("x", 1, "a"), ("x", 2, "b"), ("y", 0, ""), ("y", 1, "z"), ("y", 2, "a")], "system string, c int, ch string")
    weights = spark.createDataFrame([("x", 3.0), ("y", 1.0)], "system string, weight double")
    got = {r.ch: math.exp(r.lp) for r in ctc.average_shared(frames, names, weights, "k").collect()}
    assert got == pytest.approx({"": 0.75 * 5 / 8 + 0.25 / 4, "a": 0.75 * 3 / 8 + 0.25 * 3 / 4})


def zipped_bytes(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return bytearray(out.getvalue())


def test_archives(spark):
    df = spark.createDataFrame([("a", zipped_bytes({"z/2.xml": "two", "1.xml": "one", "x.jpg": "x", "z/": ""})), ("bad", bytearray(b"nothing")), ("empty", bytearray()), ("null", None)], "k string, c binary")
    got = [(r.k, r.entry, bytes(r.content)) for r in readers.archive_entries(df, "k", "c", ".xml").collect()]
    assert got == [("a", "1.xml", b"one"), ("a", "z/2.xml", b"two")]
    files = spark.createDataFrame([("a", "2", "two"), ("a", "1", "one"), ("b", "3", "three"), ("b", None, "x")], "k string, n string, c string")
    back = readers.archive_entries(readers.archived(files, "k", "n", "c"), "k", "content").collect()
    assert sorted((r.k, r.entry, bytes(r.content)) for r in back) == [("a", "1", b"one"), ("a", "2", b"two"), ("b", "3", b"three")]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.PNG").write_bytes(png(page(n=1)))
    (tmp_path / "in" / "deep" / "b.jpeg").write_bytes(b"zz")
    (tmp_path / "in" / "c.txt").write_text("x")
    rows = readers.image_files(spark, str(tmp_path / "in")).collect()
    assert sorted(r.path.rpartition("/")[2] for r in rows) == ["a.PNG", "b.jpeg"]
    for name, lines in (("1.txt", "one\n\n two \nthree"), ("2.txt", "four\nfive")):
        (tmp_path / name).write_text(lines)
    every = readers.text_lines(spark, str(tmp_path / "*.txt")).orderBy("file", "line_no").collect()
    assert [(r.line_no, r.text) for r in every] == [(0, "one"), (1, "two"), (2, "three"), (0, "four"), (1, "five")]
    # the line that crosses the budget is the last
    assert sorted(r.text for r in readers.text_lines(spark, str(tmp_path / "*.txt"), 12).collect()) == ["four", "one", "three", "two"]
    assert sorted(r.text for r in readers.text_lines(spark, str(tmp_path / "*.txt"), 6).collect()) == ["one", "two"]


def test_registry(spark):
    def missing():
        raise AnalysisException("no such table")

    rows = lambda a, b: lambda: spark.range(a, b).withColumn("more", F.lit("x"))
    registry = {"a": readers.Registered(rows(0, 50), 10), "b": readers.Registered(rows(100, 105)), "c": readers.Registered(rows(200, 230), 5, in_all=False), "gone": readers.Registered(missing)}
    assert readers.chosen_sources(registry, "all") == ["a", "b", "gone"] and readers.chosen_sources(registry, "none") == [] == readers.chosen_sources(registry, None)
    assert readers.chosen_sources(registry, "c, a") == ["a", "c"]
    with pytest.raises(ValueError, match="unknown sources: x"):
        readers.chosen_sources(registry, ["a", "x"])
    out = readers.composite(registry, "all", ["id"], "id", seed=3).collect()
    assert [sum(r.source_name == n for r in out) for n in "abc"] == [10, 5, 0]
    few = readers.composite(registry, "all", ["id"], "id", seed=3, limit=12).collect()
    assert [r.source_name for r in few] == ["a"] * 10 + ["b"] * 2 and [r.rank for r in few][:10] == list(range(1, 11))
    assert readers.composite(registry, "gone", ["id"], "id") is None


def test_sides_of_unlike_length_are_an_error(spark):
    gold, said = spark.range(3).withColumn("ref", F.lit("a")), spark.range(3).withColumn("hyp", F.lit("b"))
    assert metrics.zipped(gold, said, "id").count() == 3
    for other in (said.limit(2), said.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ValueError):
            metrics.zipped(gold, other, "id")


def test_summary(spark):
    rows = spark.createDataFrame([("ab", "ab"), ("ab", "")], "ref string, hyp string")
    line = metrics.scored(rows).agg(*metrics.line_report()).select(metrics.summary()).first()[0]
    assert line.startswith("median 0.0000 [0.0000, 0.0000], micro 0.0000, no drop 0.5000") and line.endswith("scored 1 of 2")
    assert metrics.scored(rows.where("hyp = ''")).agg(*metrics.line_report()).select(metrics.summary()).first()[0].startswith("median -")


def test_pages_are_read_line_by_line(spark):
    df = spark.createDataFrame([("a", bytearray(png(page()))), ("b", None)], "k string, c binary")
    wide = lambda crops: [(f"w{c.shape[1] // 100}", 0.9 if i % 2 else 0.2) for i, c in enumerate(crops)]
    other = lambda crops: [("vote", 0.1)] * len(crops)

    def broken(crops):
        raise RuntimeError

    one = infer.read_pages(df, "k", "c", [wide]).orderBy("line_no").collect()
    assert {r.k for r in one} == {"a"} and all(r.text.startswith("w") for r in one) and [r.line_no for r in one] == list(range(len(one)))
    three = infer.read_pages(df, "k", "c", [wide, other, other], [1.0, 0.9, 0.8])
    assert {r.text for r in three.collect()} == {"vote"} and {r.confidence for r in three.collect()} <= {0.9, 0.2}
    assert {(r.text, r.confidence) for r in infer.read_pages(df, "k", "c", [broken]).collect()} == {("", 0.0)}
    kept = infer.page_texts(infer.read_pages(df, "k", "c", [wide]), "k", 0.5).first()
    assert kept.n_lines == sum(r.confidence >= 0.5 for r in one) == kept.transcript.count("\n") + 1


def test_lines_from_a_bank_of_glyphs(spark):
    glyph = lambda h: np.pad(np.zeros((h, 20), np.uint8), 3, constant_values=255)
    bank = {c: [glyph(30)] for c in "אבגד"}
    df = spark.createDataFrame([(1, "אב גד"), (2, "אxב"), (3, None), (4, "דגבא")], "k int, t string")
    rows = {r.k: r for r in augment.glyph_lines(df, "k", "t", bank, seed=2).collect()}
    assert set(rows) == {1, 4} and rows[1].text == "אב גד" and rows[1].height == 64 and len(rows[1].pixels) == 64 * rows[1].width
    assert rows[1].pixels == {r.k: r for r in augment.glyph_lines(df.repartition(3), "k", "t", bank, seed=2).collect()}[1].pixels
    endless = augment.endless_lines(25, df.where("k in (1, 4)"), "t", bank).collect()
    assert sorted(r.draw for r in endless) == list(range(25)) and {r.text for r in endless} == {"אב גד", "דגבא"}
    kept = spark.createDataFrame([(" אxב  גד ",), (None,)], "t string").select(augment.renderable_text(F.col("t"), "א-ת").alias("t")).collect()
    assert [r.t for r in kept] == ["אב גד", ""]
    g = spark.createDataFrame([("ל", 1, 150.0), ("א", 1, 100.0), ("א", 2, 300.0), ("ב", 1, 100.0), ("י", 1, 48.0)], "ch string, k int, h double")
    r = {x.ch: (x.n, x.ratio) for x in augment.glyph_ratios(augment.glyph_bank(g, "ch", "k", 1), "ch", "h", ["א", "ב"]).collect()}
    assert r == {"ל": (1, 1.5), "א": (1, 1.0), "ב": (1, 1.0), "י": (1, 0.48)}


def test_pixels_joined_from_right_to_left():
    a, b, c = (np.full((64, w), v, np.uint8) for w, v in ((100, 10), (50, 20), (200, 30)))
    one, two = image.side_by_side([a, b, c], gap=24, most=200)
    assert one.shape == (64, 174) and one[0, -1] == 10 and one[0, 0] == 20 and one[0, 60] == 255 and two.shape == (64, 200)
    assert image.side_by_side([]) == [] and image.side_by_side([np.zeros((32, 10), np.uint8)])[0].shape == (64, 20)


def test_gate_cache_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, None)], "k int, cer double")
    assert [readers.quality_gate(df, c, m).count() for c, m in (("cer", 0.5), ("cer", None), ("other", 0.5))] == [1, 3, 3]
    made = []
    for seed in (1, 1, 2):
        sinks.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or df, split="train", seed=seed)
    assert len(made) == 2
    sinks.write_page_blocks(spark.createDataFrame([("p", "a\nb"), ("q", None)], "n string, t string").coalesce(1), "n", "t", str(tmp_path / "b"))
    assert "\n".join(p.read_text() for p in (tmp_path / "b").glob("*.txt")) == "### p\na\nb\n\n### q\n\n\n"


def test_a_log_is_followed_from_where_it_was_left(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in", "out", "check")]
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(paths[0])
        logs.follow(spark.readStream.schema("id bigint").parquet(paths[0]), *paths[1:])
        assert sorted(r.id for r in spark.read.parquet(paths[1]).collect()) == list(range(k * 10 + 10))


def test_reading_by_aspect(spark):
    df = spark.createDataFrame([(i, "x", 100 - i, 10 + i) for i in range(9)], "k int, c string, w int, h int").coalesce(1)
    order = []
    got = infer.read(df, "k", "c", lambda b: [str(len(b))] * len(b), "w", 4, "h").collect()
    assert [r.k for r in got] == list(range(8, -1, -1)) and not order
