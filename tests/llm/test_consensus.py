import random

from inkloom.llm import consensus
from inkloom.session import settle

SCHEMA = "line_id string, text string, reads array<string>, reader_ids array<string>, weight double"


def run(spark, rows, classes):
    lines, readers = consensus.consensus(spark, spark.createDataFrame(rows, SCHEMA), classes)
    return {r.line_id: r for r in lines.collect()}, {r.reader_id: r for r in readers.collect()}


def test_recovers_accuracies_and_truth(spark, classes):
    rnd = random.Random(3)
    truth = {"a": 0.95, "b": 0.9, "c": 0.8, "d": 0.7, "e": 0.6}
    rows, right = [], {}
    for k in range(3000):
        true = f"line {k}"
        said = [(r, true if rnd.random() < p else f"line {k} wrong {rnd.randrange(5)}") for r, p in truth.items() if rnd.random() < 0.8]
        if said:
            right[str(k)] = true
            rows.append((str(k), true, [t for _, t in said], [r for r, _ in said], 1.0))
    lines, readers = run(spark, rows, classes)
    assert all(abs(readers[r].reliability - p) < 0.06 for r, p in truth.items()), readers
    assert sum(lines[k].consensus == t for k, t in right.items()) / len(right) > 0.93


def test_good_readers_outvote_a_crowd(spark, classes):
    rnd = random.Random(1)
    rows = []
    for k in range(600):
        true = f"line {k}"
        bad = lambda: f"line {k} x{rnd.randrange(9)}" if rnd.random() < 0.6 else true  # noqa: E731, B023
        rows.append((str(k), true, [true, true, true, bad(), bad(), bad()], list("abcxyz"), 0.0))
    rows.append(("case", "stored", ["other", "other", "stored", "stored", "stored"], list("abxyz"), 0.0))
    rows.append(("fine", "stored", ["stored", "stored", "other", "other", "other"], list("abxyz"), 0.0))
    rows.append(("look", "a-b", ["a–b", "a־b"], list("ab"), 0.0))
    lines, readers = run(spark, rows, classes)
    assert lines["case"].rival == "other" and lines["fine"].rival is None and lines["look"].rival is None
    assert lines["fine"].consensus == "stored"


def test_odd_rows(spark, classes):
    rows = [
        ("null", None, None, None, 0.0), ("empty", "t", [], [], 0.0), ("blank", "t", ["", None, " "], ["a", "b", "c"], 0.0),
        ("one", "t", ["u"], ["a"], 0.0), ("twice", "t", ["u", "u"], ["a", "a"], 0.0), ("twice", "t", ["u", "u"], ["a", "a"], 0.0),
        ("noid", "t", ["u", "u"], [None, None], 0.0), ("long", "x" * 4000, ["x" * 4000, "y"], ["a", "b"], 0.0),
    ]
    lines, _ = run(spark, rows, classes)
    assert len(lines) == 7 and all(r.rival is None for r in lines.values())
    assert lines["blank"].consensus is None and lines["one"].consensus == "u" and lines["noid"].n_reads == 0
    assert run(spark, [], classes) == ({}, {})


def test_weights_joined_when_there_are_many_readers(spark, classes, monkeypatch):
    rows = [(str(k), "t", ["t", "u", "t"], [f"r{k}", f"r{k + 1}", f"r{k + 2}"], 0.0) for k in range(30)]
    voted = settle(consensus.votes(spark, spark.createDataFrame(rows, SCHEMA), classes))
    readers = settle(consensus.reliabilities(voted))
    few = sorted(map(tuple, consensus.decide(consensus.weighed(voted, readers)).collect()))
    monkeypatch.setattr(consensus, "MOST_SENT", 3)
    assert sorted(map(tuple, consensus.decide(consensus.weighed(voted, readers)).collect())) == few


def test_all_triplets_count(spark):
    rnd = random.Random(5)
    names = [f"r{k:02}" for k in range(70)]
    m = {(i, j): rnd.uniform(0.1, 0.9) for i in names for j in names if i < j}
    both = {**m, **{(j, i): v for (i, j), v in m.items()}}
    got = {r.reader_id: r.p for r in consensus.solve(spark.createDataFrame([(i, j, 1 + (i < "r05"), v) for (i, j), v in both.items()], "i string, j string, n bigint, m double"), 0.1).collect()}
    for i in names:
        jk = [(j, k) for j, k in m if i not in (j, k)]
        p = (sum(both[i, j] * both[i, k] * m[j, k] for j, k in jk) / sum(m[x] ** 2 for x in jk)) ** 0.5 + 0.1
        assert abs(got[i] - p) < 1e-9


def test_pairs_of_readers_are_given_out_before_they_grow(spark, classes, monkeypatch):
    rows = [(str(k), "t", ["t"] * 30, [f"r{k}-{i}" for i in range(30)], 0.0) for k in range(40)]
    voted = settle(consensus.votes(spark, spark.createDataFrame(rows, SCHEMA), classes))
    one = sorted(map(tuple, consensus.agreements(voted).collect()))
    monkeypatch.setattr(consensus, "MOST_PAIRS", 50)
    assert sorted(map(tuple, consensus.agreements(voted).collect())) == one and len(one) == 40 * 30 * 29 // 2
