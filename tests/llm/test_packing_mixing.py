import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm import mixing, packing
from inkloom.llm.tokens import encoder, with_tokens


def first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), None)
        if k is None:
            k = len(room)
            room.append(capacity)
        room[k] -= s
        out.append(k)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60), st.integers(20, 40))
def test_tournament_tree_is_first_fit(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), capacity).tolist() == first_fit(sizes, capacity)


def test_packing_is_whole(spark):
    items = [(i, n) for i, n in enumerate([0, 1, 5, 10, 11, 20, 35, 7, 7, 7, 3, 10, 10])] + [(100, None), (101, 2500)] + [(500 + i, i % 13) for i in range(3000)]
    items.append((1, 1))
    df = spark.createDataFrame(items, "doc_id int, n_tokens bigint")
    specs = spark.createDataFrame([(1, 10), (2, 16), (2, 16), (3, 0), (4, None), (None, 5)], "spec_id int, capacity int")
    rows = packing.pack(df, specs, group=512).collect()
    assert {r.spec_id for r in rows} == {1, 2}
    for spec, capacity in ((1, 10), (2, 16)):
        mine = [r for r in rows if r.spec_id == spec]
        used, parts = {}, {}
        for r in mine:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
            parts.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens, r.piece_no))
        assert max(used.values()) <= capacity
        assert sum(used.values()) / (len(used) * capacity) > 0.97
        for doc, n in dict(items).items():
            if n is None:
                assert doc not in parts
                continue
            got = sorted(set(parts[doc]))
            assert sum(g[1] for g in got) == n and (len(got) == 1 if n <= capacity else all(g[1] == capacity for g in got[:-1]))
            assert [g[2] for g in got] == list(range(len(got)))
        assert len(parts[1]) == 2  # a repeated row is an item of its own
    assert packing.pack(df.limit(0), specs).count() == 0
    again = {tuple(r) for r in packing.pack(df.repartition(7), specs, group=512).collect()}
    assert again == {tuple(r) for r in rows}


def test_token_sizes(spark):
    texts = ["שלום עולם", "", None, "a" * 30_000, "hello  \n world"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int").drop("n_tokens")
    got = {r.doc_id: r.n_tokens for r in with_tokens(df, ["doc_id"], "text").collect()}
    enc = encoder("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    assert got == {i: None if t is None else len(enc.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[0])) == texts[0]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.floats(0, 1), st.floats(0, 100)), max_size=6), st.floats(0, 400))
def test_water_filling(sources, budget):
    weight, limit = {s: w for s, (w, _) in sources.items()}, {s: m for s, (_, m) in sources.items()}
    got = mixing.water_fill(weight, limit, budget)
    reach = sum(limit[s] for s in sources if weight[s] > 0)
    assert all(q <= limit[s] + 1e-6 for s, q in got.items())
    assert abs(sum(got.values()) - min(budget, reach)) < 1e-6 * max(1, budget)
    # in proportion to the weights, multiplied out: the least of weights has quotients that no double holds
    free = [(q, weight[s]) for s, q in got.items() if q < limit[s] - 1e-6]
    full = [(q, weight[s]) for s, q in got.items() if q >= limit[s] - 1e-6]
    assert all(abs(p * w - q * v) <= 1e-6 * max(1, p * w) for p, v in free for q, w in free)
    assert all(p * w <= q * v * (1 + 1e-6) + 1e-6 for p, v in full for q, w in free)


def test_mixture_shares_and_limits(spark):
    docs = [(i, "big" if i % 3 else "small", 50 + i % 7) for i in range(6000)]
    docs += [(10_000 + i, "tiny", 40) for i in range(20)] + [(20_000, None, 9), (20_001, "stranger", 9), (20_002, "big", None), (20_003, "big", 0)]
    sized = spark.createDataFrame(docs, "doc_id int, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.3, 2), ("small", 0.5, 5), ("tiny", 0.2, 3), ("none", 0.1, 4), (None, 0.4, 1)], "source string, target_share double, max_repeats int")
    out = mixing.mix(sized, targets)
    rows = out.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    most = {"big": 2, "small": 5, "tiny": 3}
    assert all(1 <= r.repeats <= most[r.source] for r in rows)
    report = {r.source: r for r in mixing.shares(sized, out, targets).collect()}
    total = sum(n for _, s, n in docs if s in most and n)
    tiny = 20 * 40 * 3
    assert report["tiny"].taken_tokens == tiny and report["none"].taken_tokens == 0 and report["stranger"].taken_tokens == 0
    rest = total - tiny
    assert abs(report["big"].taken_tokens - rest * 3 / 8) < 60 and abs(report["small"].taken_tokens - rest * 5 / 8) < 60
    assert abs(sum(r.share for r in report.values()) - 1) < 1e-9
    for s in most:
        reps = {r.repeats for r in rows if r.source == s}
        assert max(reps) - min(reps) <= 1
    assert {tuple(r) for r in mixing.mix(sized.repartition(5), targets).collect()} == {tuple(r) for r in rows}
    assert mixing.mix(sized.limit(0), targets).count() == 0
    assert mixing.mix(sized, targets.limit(0)).count() == 0


def test_no_document_is_taken_more_often_than_allowed_however_many_are_empty(spark):
    # a source clamped at its limit, half of its documents of size 0: nothing is left over for one of them
    docs = [(i, "a", 0 if i % 2 else 10) for i in range(2000)] + [(9000 + i, "b", 10) for i in range(2000)]
    sized = spark.createDataFrame(docs, "doc_id int, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 2)], "source string, target_share double, max_repeats int")
    for seed in range(3):
        rows = mixing.mix(sized, targets, budget=30_000, seed=seed).collect()
        assert max(r.repeats for r in rows if r.source == "a") == 2 and len([r for r in rows if r.source == "a"]) == 2000


def test_fill_report_has_every_capacity(spark):
    packed = packing.pack(spark.createDataFrame([(i, 3) for i in range(50)], "doc_id int, n_tokens bigint"), spark.createDataFrame([(k, 9 + k) for k in range(40)], "spec_id int, capacity int"))
    specs = spark.createDataFrame([(k, 9 + k) for k in range(40)] * 2, "spec_id int, capacity_tokens int")
    rows = packing.fill_report(packed, specs).collect()
    assert len(rows) == 40 and all(r.n_tokens == 150 and r.fullest <= r.capacity_tokens for r in rows)
