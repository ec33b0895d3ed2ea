"""Queries that must take every row and every character."""

import __spark_entry__ as entry
from inkloom.operators import batching


def test_collate_keeps_long_texts(spark, tmp_path):
    long = "ab" * 100 + "é"
    rows = [(1, [long, "a", None, ""]), (2, ["ab", "b"]), (3, []), (4, None), (5, [None])]
    spark.createDataFrame(rows, "batch_id bigint, texts array<string>").write.parquet(f"{tmp_path}/train_batches.parquet")
    got = {(r.batch_id, r.place): r.padded for r in entry.queries()["q_collate"](spark, str(tmp_path)).collect()}
    # composed, the long text has 201 characters; a, b and é are 1, 2 and 3
    zeros = lambda n: [0] * n
    assert got == {
        (1, 1): str([1, 2] * 100 + [3]), (1, 2): str([1, *zeros(200)]), (1, 3): str(zeros(201)), (1, 4): str(zeros(201)),
        (2, 1): "[1, 2]", (2, 2): "[2, 0]", (5, 1): "[]",
    }


def test_rover_votes_on_composed_reads(spark, tmp_path):
    # two spellings of one letter are one vote: together they outweigh the pivot's
    rows = [("a", ["cafe", "cafe\u0301", "caf\u00e9"]), ("b", ["x", None, "x"]), ("c", []), ("d", None)]
    full = [(k, "p", 1, "t", reads, [], None) for k, reads in rows]
    spark.createDataFrame(full, "line_id string, page_id string, line_index int, text string, reads array<string>, reader_ids array<string>, chosen_read_index int").write.parquet(f"{tmp_path}/gold_lines.parquet")
    got = {r.line_id: r.voted for r in entry.queries()["q_rover"](spark, str(tmp_path)).collect()}
    assert got == {"a": "caf\u00e9", "b": "x", "c": "", "d": ""}


def test_joined_rows_keep_every_line(spark):
    lines = [("p", 1, "a", 700), ("p", 2, "b", 400), ("p", 3, "c", 400), ("p", 4, "d", 5000), ("p", 5, "e", 10), ("p", 6, None, None), ("q", 1, "f", 5000)]
    df = spark.createDataFrame(lines, "g string, o int, t string, w int")
    got = sorted(map(tuple, batching.joined_rows(df, "g", "o", "t", "w", most=1200).collect()))
    assert got == [("p", 0, "a b", 1124, 2), ("p", 1, "c", 400, 1), ("p", 2, "d", 5000, 1), ("p", 3, "e ", 34, 2), ("q", 0, "f", 5000, 1)]
