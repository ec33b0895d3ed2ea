import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkloom.llm import leaks


def brute(line, text):
    """Whether a span of the line is in the text, by trying all spans and all places."""
    n = len(line)
    need = leaks.needed(n)
    for i in range(n):
        for j in range(i + need, n + 1):
            span = line[i:j]
            for a in range(len(text)):
                for b in range(a + 1, len(text) + 1):
                    part = text[a:b]
                    row = list(range(len(part) + 1))
                    for x in span:
                        last, row[0] = row[0], row[0] + 1
                        for k, y in enumerate(part, 1):
                            last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
                    ends = leaks.similar(span[0], part[0]) and leaks.similar(span[-1], part[-1])
                    if ends and row[-1] * leaks.ONE_IN <= len(span):
                        return True
    return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["aaaa", "bbbb", "cccc", "dddd", "eeee", "ffff"]), min_size=5, max_size=9), st.data())
def test_span_is_found_as_by_brute_force(line, data):
    text = list(line)
    for _ in range(data.draw(st.integers(0, 3))):
        k = data.draw(st.integers(0, len(text) - 1))
        text[k : k + 1] = data.draw(st.sampled_from([[], ["zzzz"], [text[k], "yyyy"]]))
        if not text:
            break
    assert (leaks.best_span(line, text) is not None) == brute(line, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=20), max_size=5), st.integers(1, 5))
def test_winnowing_keeps_the_least_of_every_window(owners, window):
    key = np.array([k for o in owners for k in o], np.uint64)
    owner = np.array([i for i, o in enumerate(owners) for _ in o], np.int64)
    want, at = set(), 0
    for o in owners:
        for i in range(max(1, len(o) - window + 1)) if o else ():
            part = o[i : i + window]
            want.add(at + i + max(k for k, v in enumerate(part) if v == min(part)))
        at += len(o)
    assert leaks.winnow(key, owner, window).tolist() == sorted(want)


def sketch_of(lines):
    rows = np.zeros((2, 1 << 16), np.int64)
    h, text = leaks.hashes(lines)
    for kind, distance in leaks.IN_LINES:
        for row, places in zip(rows, leaks.Sketch.places(leaks.grams(h, text, kind, distance)[0], 16), strict=True):
            np.add.at(row, places, 1)
    return leaks.Sketch(leaks.Sketch.level(rows))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=5, max_size=5), st.lists(st.sampled_from("abcdefgh"), max_size=6), st.lists(st.sampled_from("abcdefghij"), max_size=6), st.integers(0, 4), st.sampled_from(["right", "wrong", "missing", "inserted"]), st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=5, max_size=9), max_size=8))
def test_no_span_of_five_words_with_one_error_goes_without_a_common_print(span, before, after, at, error, others):
    # whatever is around it, whatever is common among the lines, and wherever the error is
    line, said = before + span + after[::-1], list(span)
    said[at : at + 1] = {"right": [span[at]], "wrong": ["zz"], "missing": [], "inserted": [span[at], "yy"]}[error]
    text = after + said + before[::-1]
    sketch = sketch_of([line, *others])
    of_line = leaks.fingerprints([line], leaks.IN_LINES, sketch)
    of_text = leaks.fingerprints([text], leaks.IN_TEXTS, sketch)
    assert set(of_line[1].tolist()) & set(of_text[1].tolist())
    assert 0 < len(of_line[1]) < sum(len(line) - d for _, d in leaks.IN_LINES) or len(line) < 7


def test_the_sketch_counts_every_gram(spark):
    rnd = random.Random(2)
    lines = [words(rnd, rnd.randint(5, 9)) for _ in range(300)] + [["a", "b", "c", "d", str(k)] for k in range(50)]
    sketch = leaks.sketched(spark.createDataFrame([(w,) for w in lines], "line_words array<string>").repartition(3))
    h, text = leaks.hashes(lines)
    for kind, distance in leaks.IN_LINES:
        assert sketch.of(leaks.grams(h, text, kind, distance)[0]).min() > 0
    common = leaks.grams(*leaks.hashes([["a", "b"]]), 0, 1)[0]
    assert sketch.of(common)[0] >= leaks.Sketch.level(np.array([50]))[0]
    assert (leaks.sketched(spark.createDataFrame([], "line_words array<string>")).rows == 0).all()


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def test_leaks(spark, classes):
    rnd = random.Random(5)
    lines = [(f"l{k}", " ".join(words(rnd, rnd.randint(5, 14)))) for k in range(60)]
    lines += [("short", "one two three four"), ("null", None), ("blank", "  "), ("copy", lines[0][1])]
    texts, want = [], set()
    for b in range(40):
        batch = []
        for t in range(6):
            w = words(rnd, 8)
            if (b + t) % 3 == 0:
                k = rnd.randrange(60)
                line = lines[k][1].split()
                n = leaks.needed(len(line))
                at = rnd.randrange(len(line) - n + 1)
                span = line[at : at + n]
                bad = b % 2 == 0
                if bad:
                    span[n // 2] = "zzz"
                w[4:4] = [x + ("," if i % 2 else "‏") for i, x in enumerate(span)]
                if (b, f"l{k}") not in {(x, z) for x, _, z in want}:
                    want.add((b, t, f"l{k}"))
                    if k == 0:
                        want.add((b, t, "copy"))
            elif t == 5:
                w[2:2] = lines[b][1].split()[:3] + ["gap"]  # too little
            batch.append(" ".join(w))
        texts.append((b, batch + [None, ""], "x"))
    texts += [texts[0], (99, None, "x"), (98, [], "x"), (97, ["word " * 3000], "x")]
    got = leaks.leaks(spark, spark.createDataFrame(texts, "batch_id int, texts array<string>, gram string"), spark.createDataFrame(lines, "line_id string, text string"), classes)
    rows = {(r.batch_id, r.text_no, r.line_id) for r in got.collect()}
    assert {(b, line) for b, _, line in rows} == {(b, line) for b, _, line in want}
    assert len(rows & want) >= len(want) - 2  # the longest span decides between two texts of a batch
    none = spark.createDataFrame([], "batch_id int, texts array<string>")
    assert leaks.leaks(spark, none, spark.createDataFrame(lines, "line_id string, text string"), classes).count() == 0


def test_common_grams_are_spread_and_lose_nothing(spark, classes, monkeypatch):
    # nearly every line and text has the same opening words
    rnd = random.Random(9)
    rest = [" ".join(words(rnd, 6)) for _ in range(300)]
    lines = spark.createDataFrame([(f"l{k}", f"so it was {r}") for k, r in enumerate(rest)], "line_id string, text string")
    texts = spark.createDataFrame([(k, [f"so it was {r} end", "so it was of old and then"]) for k, r in enumerate(rest)], "batch_id int, texts array<string>")
    want = sorted((k, 0, f"l{k}", 9) for k in range(300))
    seen = []
    for hot in (4, 10**6):
        monkeypatch.setattr(leaks, "HOT", hot)
        got = leaks.leaks(spark, texts, lines, classes).select("batch_id", "text_no", "line_id", "n_words")
        seen.append(sorted(map(tuple, got.collect())))
    assert seen[0] == seen[1] and set(want) <= set(seen[0])
