"""Held-out lines inside training texts: winnowed word grams, joined and extended.

Texts are folded to words in which look-alikes, vowel points and punctuation don't
matter. A gram is the hash of two words, side by side (near) or three places apart (far);
each kind is a sequence of its own, and of every ``window`` grams in a row the least one
is kept. Grams are ordered by how many held-out lines have them, rare ones first, then by
hash; a sketch of bounded size tells both sides the same numbers, and texts drop the
grams that no held-out line has before anything is shuffled. Fingerprints of texts and of
distinct held-out lines are joined, and every pair met is extended by an alignment that
decides exactly.

What is guaranteed. An admissible span has five words or more and one error in five words
at most, so five of its words in a row hold one error at most. If that is the third, the
first two and the last two are intact: two far grams in a row, (1, 4) and (2, 5). If a text
lacks the third word, the same pairs are two places apart in it, so texts also give the
grams of that distance to the far kind. With any other error, inserted words too, three
words in a row are intact: two near grams in a row. In every case line and text share a
whole window of two grams, hence its least one. ``WINDOW = 2`` therefore loses no admissible
span; wider windows keep fewer fingerprints and guarantee longer intact runs only.

Odd input: null and blank texts, null arrays, and lines of fewer than five words give
nothing; texts of any length are taken whole; a batch or line that comes several
times counts once; a line carried by several texts of a batch is reported for the
text with the longest span, the first of them on a tie; lines with one folded text
are matched once and reported for each of their ids; empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.lookalike import Lookalikes
from inkloom.session import settle

#: Grams of a window; the distances of a gram's words, by kind, in lines and in texts.
WINDOW, IN_LINES, IN_TEXTS = 2, ((0, 1), (1, 3)), ((0, 1), (1, 3), (1, 2))
#: The least words of a span, the words of which one may be wrong, the part of the line it must make up.
LEAST, ONE_IN, PART = 5, 5, 2
#: The sketch has two rows of at least as many counters as there are grams, up to 2 ** MOST_BITS: 32 MB, whatever the input.
MOST_BITS, CHUNK = 24, 1 << 16
#: A gram of about so many held-out lines is spread over so many tasks.
HOT, SPREAD = 1024, 16
NOT_WORD = re.compile(r"(?:[^\w\s]|_)+")
U64 = np.uint64


def words(classes: Lookalikes, text: str | None) -> list[str]:
    """The folded words of a text."""
    return NOT_WORD.sub("", classes.rewrite(text)).split() if text else []


def hashes(said: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of all texts, one after the other, and the text it is from."""
    n = [len(w) for w in said]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(x) for w in said for x in w), U64, sum(n)), np.repeat(np.arange(len(said)), n)


def grams(h: np.ndarray, text: np.ndarray, kind: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram, place of its first word) for every pair of words of one text so far apart."""
    if len(h) <= distance:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = (h[:-distance] * U64(0x9E3779B97F4A7C15) + h[distance:] + U64(kind)) * U64(0xC2B2AE3D27D4EB4F)
    at = np.flatnonzero(text[:-distance] == text[distance:])
    g = g[at]
    return g ^ (g >> U64(29)), at


class Sketch:
    """About how often each gram occurs in the held-out lines: the least of two counters, on a scale from 0 to 255; 0 means never."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows, self.bits = rows, int(rows.shape[1]).bit_length() - 1

    @staticmethod
    def places(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            return (g >> U64(64 - bits)).astype(np.int64), ((g * U64(0xD6E8FEB86659FD93)) >> U64(64 - bits)).astype(np.int64)

    @staticmethod
    def level(n: np.ndarray) -> np.ndarray:
        """Counts on a scale that keeps their order: eight steps for each doubling, 0 only for none."""
        return np.minimum(np.ceil(8 * np.log2(1.0 + n)), 255).astype(np.uint8)

    def of(self, g: np.ndarray) -> np.ndarray:
        a, b = self.places(g, self.bits)
        return np.minimum(self.rows[0][a], self.rows[1][b])


def winnow(key: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of the least key of every ``window`` neighbours of one owner, the last on a tie; of all of them where there are fewer. Ascending, each once."""
    n = len(key)
    if n == 0 or window <= 1:
        return np.arange(n)
    kept = np.zeros(n, bool)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, n])
    # owners with fewer grams than a window has: a window of all of them, padded with the largest key
    start = np.union1d(np.flatnonzero(owner[: max(0, n - window + 1)] == owner[window - 1 :]) if n >= window else np.zeros(0, int), first[size < window])
    last = (first + size)[np.searchsorted(first, start, "right") - 1]
    best, at = key[start], start.copy()
    for k in range(1, window):
        i = start + k
        inside = i < last
        i = np.minimum(i, n - 1)
        better = inside & (key[i] <= best)
        best, at = np.where(better, key[i], best), np.where(better, i, at)
    kept[at] = True
    return np.flatnonzero(kept)


def fingerprints(said: list[list[str]], distances: tuple[tuple[int, int], ...], sketch: Sketch, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, place in the text, level) of the kept grams that the sketch has."""
    h, text = hashes(said)
    begins = np.cumsum([0, *(len(w) for w in said)])
    parts = []
    for kind, distance in distances:
        g, at = grams(h, text, kind, distance)
        level = sketch.of(g)
        keep = winnow((level.astype(U64) << U64(56)) | (g >> U64(8)), text[at], window)
        keep = keep[level[keep] > 0]
        parts.append((text[at[keep]], g[keep].view(np.int64), at[keep] - begins[text[at[keep]]], level[keep]))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def needed(n: int) -> int:
    """The least words of a span of a line of n words."""
    return max(LEAST, -(-n // PART))


def similar(a: str, b: str) -> bool:
    """Whether b can be a miscopied a: at most half of the longer one's letters changed."""
    if a == b:
        return True
    most = max(len(a), len(b)) // 2
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def best_span(line: list[str], text: list[str]) -> tuple[int, int, int] | None:
    """(words, errors, first word) of the longest admissible span of the line in the text, or None.

    A span begins and ends with a word that is right or miscopied. Wrong, missing and
    inserted words are errors. For every pair of places and number of errors the
    earliest first word of a span ending there is kept.
    """
    n, m = len(line), len(text)
    need, most = needed(n), n // ONE_IN
    # As many words must be right, and a line that stands whole and unchanged has no better span.
    said = set(text)
    if sum(x in said for x in line) < need - need // ONE_IN:
        return None
    if n >= LEAST and f" {' '.join(line)} " in f" {' '.join(text)} ":
        return n, 0, 0
    best, far = None, n + 1
    above = [[far] * (most + 1) for _ in range(m + 1)]
    for i in range(n):
        here = [[far] * (most + 1)]
        g = line[i]
        for j in range(m):
            diagonal, cell = above[j], [far] * (most + 1)
            same = g == text[j]
            if same:
                cell[:] = diagonal
                cell[0] = min(cell[0], i)
                ends = cell
            else:
                cell[1:] = diagonal[:-1]
                ends = None
                if most and (min(diagonal[:-1]) < far or i + need <= n) and similar(g, text[j]):
                    cell[1] = min(cell[1], i)
                    ends = cell
            if ends:
                for e, a in enumerate(ends):
                    span = i - a + 1
                    if span >= need and e * ONE_IN <= span and (best is None or (span, -e) > (best[0], -best[1])):
                        best = (span, e, a)
            up, left = above[j + 1], here[j]
            here.append([cell[0]] + [min(cell[e], up[e - 1], left[e - 1]) for e in range(1, most + 1)])
        above = here
    return best


def held_out(spark: SparkSession, lines: DataFrame, classes: Lookalikes) -> tuple[DataFrame, DataFrame]:
    """``(line_key, line_words)`` of distinct folded texts of five words or more, and ``(line_key, line_id)``."""
    shared = spark.sparkContext.broadcast(classes)  # bounded by the code points of Unicode

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [" ".join(words(shared.value, t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.string())], names=["line_id", "folded"])

    kind = lines.schema["line_id"].dataType.simpleString()
    folded = lines.select("line_id", "text").where("text is not null").mapInArrow(go, f"line_id {kind}, folded string")
    folded = settle(folded.where(F.size(F.split("folded", " ")) >= LEAST).withColumn("line_key", F.md5("folded")).distinct(), "held-out")
    return folded.select("line_key", F.split("folded", " ").alias("line_words")).distinct(), folded.select("line_key", "line_id")


def sketched(distinct: DataFrame, most_bits: int = MOST_BITS) -> Sketch:
    """The sketch of the lines' grams. Tasks count what they meet, chunks of counters are summed in parallel, and the driver gets
    one byte a counter: no more than twice 2 ** most_bits bytes."""
    total = distinct.agg(F.sum(F.size("line_words") * len(IN_LINES)).alias("n")).first().n or 1
    bits = min(most_bits, max(16, int(total).bit_length()))

    def flush(found: list[np.ndarray], row: int) -> Iterator[tuple]:
        at, n = np.unique(np.concatenate(found), return_counts=True)
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // CHUNK)) + 1):
            if len(part):
                yield (row << (bits - 16)) + int(at[part[0]] // CHUNK), (at[part] % CHUNK).astype(np.uint16).tobytes(), n[part].astype(np.uint32).tobytes()

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = [[], []]

        def out() -> pa.RecordBatch:
            rows = [r for row in (0, 1) if found[row] for r in flush(found[row], row)]
            for f in found:
                f.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "at", "n"])

        for b in parts:
            h, text = hashes(b.column(0).to_pylist())
            for kind, distance in IN_LINES:
                for row, places in enumerate(Sketch.places(grams(h, text, kind, distance)[0], bits)):
                    found[row].append(places)
            if sum(map(len, found[0])) > 2_000_000:
                yield out()
        yield out()

    def add(table: pa.Table) -> pa.Table:
        n = np.zeros(CHUNK, np.int64)
        for at, k in zip(table.column("at").to_pylist(), table.column("n").to_pylist(), strict=True):
            n[np.frombuffer(at, np.uint16)] += np.frombuffer(k, np.uint32)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "level": pa.array([Sketch.level(n).tobytes()], pa.binary())})

    counted = distinct.select("line_words").mapInArrow(count, "chunk int, at binary, n binary")
    rows = np.zeros((2, 1 << bits), np.uint8)
    flat = rows.reshape(-1, CHUNK)
    for r in counted.groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect():  # two rows of 2 ** bits bytes
        flat[r.chunk] = np.frombuffer(r.level, np.uint8)
    return Sketch(rows)


def leaks(spark: SparkSession, batches: DataFrame, lines: DataFrame, classes: Lookalikes, window: int = WINDOW) -> DataFrame:
    """``(batch_id, text_no, line_id, n_words, n_errors, first_word)``: every text that carries a held-out line, each batch and line once."""
    kind = batches.schema["batch_id"].dataType.simpleString()
    distinct, ids = held_out(spark, lines, classes)
    shared, sketch = spark.sparkContext.broadcast(classes), spark.sparkContext.broadcast(sketched(distinct))  # both of bounded size
    hot = int(Sketch.level(np.array([HOT]))[0])

    def prints_of_lines(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            row, gram, _, level = fingerprints(b.column(1).to_pylist(), IN_LINES, sketch.value, window)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(gram), pa.array(level >= hot)], names=["line_key", "gram", "hot"])

    def prints_of_texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                owner, no, said = [], [], []
                for r, texts in enumerate(b.column(1).to_pylist()):
                    for t, text in enumerate(texts or ()):
                        if w := words(shared.value, text):
                            owner.append(r)
                            no.append(t)
                            said.append(w)
                text, gram, place, level = fingerprints(said, IN_TEXTS, sketch.value, window)
                row = np.array(owner, np.int64)[text]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.array(no, np.int32)[text], pa.int32()), pa.array(gram), pa.array(place, pa.int32()), pa.array(level >= hot)], names=["batch_id", "text_no", "gram", "j", "hot"])

    # Grams of very many lines are spread over several tasks: the lines' side is repeated, the texts' side falls to one of them.
    of_lines = distinct.mapInArrow(prints_of_lines, "line_key string, gram bigint, hot boolean")
    of_lines = of_lines.select("line_key", "gram", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    of_texts = batches.select("batch_id", "texts").where("texts is not null").mapInArrow(prints_of_texts, f"batch_id {kind}, text_no int, gram bigint, j int, hot boolean")
    of_texts = of_texts.select("batch_id", "text_no", "gram", "j", F.when(F.col("hot"), F.pmod(F.xxhash64("batch_id", "text_no"), F.lit(SPREAD)).cast("int")).otherwise(0).alias("part"))
    hits = of_texts.join(of_lines, ["gram", "part"]).groupBy("batch_id", "text_no", "line_key").agg(F.min("j").alias("from"), F.max("j").alias("to"))
    pairs = settle(hits, "pairs")

    def extend(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, w = None, []
        for b in parts:
            out: list[tuple[int, int, int, int]] = []
            for r, (text, line, lo, hi) in enumerate(zip(*(b.column(x).to_pylist() for x in ("text", "line_words", "from", "to")), strict=True)):
                if text != last:  # the rows of a text follow each other
                    last, w = text, words(shared.value, text)
                slack = len(line) + len(line) // ONE_IN
                if found := best_span(line, w[max(0, lo - slack) : hi + slack + 4]):
                    out.append((r, *found))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(take) for x in ("batch_id", "text_no", "line_key")), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["batch_id", "text_no", "line_key", "n_words", "n_errors", "first_word"])

    # Lines come to the pairs first: they are short, whereas a text would be shuffled again for each of its lines.
    asked = pairs.join(distinct, "line_key")
    texts = batches.select("batch_id", F.posexplode("texts").alias("text_no", "text")).where("text is not null")
    wide = texts.join(asked, ["batch_id", "text_no"]).select("batch_id", "text_no", "line_key", "text", "line_words", "from", "to")
    spans = wide.mapInArrow(extend, f"batch_id {kind}, text_no int, line_key string, n_words int, n_errors int, first_word int")
    best = spans.groupBy("batch_id", "line_key").agg(F.min(F.struct((-F.col("n_words")).alias("long"), "text_no", "n_errors", "first_word")).alias("s"))
    return best.join(ids, "line_key").select("batch_id", F.col("s.text_no").alias("text_no"), "line_id", (-F.col("s.long")).alias("n_words"), F.col("s.n_errors").alias("n_errors"), F.col("s.first_word").alias("first_word"))
