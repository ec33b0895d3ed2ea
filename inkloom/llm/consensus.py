"""Consensus of several readers: the triplet moment method over look-alike forms, and log-odds votes.

A reader's reliability p is the chance that a read is right. Two readers agree where
both are right, and by chance where both make the same mistake: with c the rate at
which two wrong reads are equal, ``a_ij = p_i p_j + c (1 - p_i)(1 - p_j)``, that is
``(a_ij - s) / (1 + c) = (p_i - s)(p_j - s)`` with ``s = c / (1 + c)``. For every
three readers the middle ones cancel: ``(p_i - s)^2 = m_ij m_ik / m_jk``; all triplets
of a reader are taken together by least squares. A reader then votes with ``max(0, log(p / (1 - p)))``: who is wrong more often than
right supports nothing.

Odd input: a line that comes several times is taken once (the row of least hash);
null or empty reads, reads without a reader and readers without a read support
nothing; of several reads of one reader the last stands; lines with no usable read
have a null consensus and null agreement; readers without any triplet get the mean
reliability; ties go to the stored text, then to the least text; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.lookalike import Lookalikes
from inkloom.session import release, settle

COUNTS = ("n", "same", "lost", "lost_same")
#: Readers whose weights are sent to all tasks; with more of them the weights are joined to the reads.
MOST_SENT = 100_000
#: Pairs of readers that a task counts before it gives them out.
MOST_PAIRS = 200_000
VOTES = "line_id string, stored string, readers array<string>, forms array<string>"


def votes(spark: SparkSession, lines: DataFrame, classes: Lookalikes) -> DataFrame:
    """``(line_id, stored, readers, forms)``: each line once, its text and reads in one form, one read a reader."""
    shared = spark.sparkContext.broadcast(classes)  # bounded by the code points of Unicode
    once = lines.select("line_id", F.struct("text", "reads", "reader_ids").alias("r")).groupBy("line_id").agg(F.min_by("r", F.xxhash64("r")).alias("r")).select("line_id", "r.*")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value.rewrite
        for b in batches:
            stored, readers, forms = [], [], []
            for text, reads, ids in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                stored.append(None if text is None else f(text))
                last: dict[str, str] = {}
                for i, r in zip(ids or (), reads or (), strict=False):
                    if i is not None and r:
                        form = f(r)
                        last.pop(i, None)
                        if form:
                            last[i] = form
                readers.append(list(last))
                forms.append(list(last.values()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stored, pa.string()), pa.array(readers, pa.list_(pa.string())), pa.array(forms, pa.list_(pa.string()))], names=["line_id", "stored", "readers", "forms"])

    return once.mapInArrow(go, VOTES)


def agreements(voted: DataFrame) -> DataFrame:
    """``(i, j, n, same, lost, lost_same)``: for readers i < j the lines both read, those where they agree, and the same of
    lines where both lost against a text of two readers or more. Counted in each task, given out whenever ``MOST_PAIRS`` are
    reached, then summed."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*(pa.array([k[x] for k in n], pa.string()) for x in (0, 1)), *(pa.array([c[x] for c in n.values()], pa.int64()) for x in range(4))], names=["i", "j", *COUNTS])
            n.clear()
            return out

        for b in batches:
            for readers, forms in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = sorted(zip(readers, forms, strict=True))
                top, most = min(Counter(forms).items(), key=lambda x: (-x[1], x[0]), default=("", 0))
                for k, (i, x) in enumerate(got):
                    for j, y in got[k + 1 :]:
                        c, lost = n[i, j], most > 1 and x != top and y != top
                        c[0] += 1
                        c[1] += x == y
                        c[2] += lost
                        c[3] += lost and x == y
                    if len(n) > MOST_PAIRS:
                        yield flush()
        yield flush()

    return voted.select("readers", "forms").mapInArrow(go, "i string, j string, n bigint, same bigint, lost bigint, lost_same bigint").groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in COUNTS))


def solve(pairs: DataFrame, s: float) -> DataFrame:
    """``(reader_id, p)`` from ``(i, j, n, m)`` in both directions, by least squares over all triplets."""
    ij = pairs.select("i", "j", F.col("m").alias("mij"))
    ik = pairs.select("i", F.col("j").alias("k"), F.col("m").alias("mik"))
    jk = pairs.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("m").alias("mjk"))
    each = ij.join(ik, "i").where("j < k").join(jk, ["j", "k"])
    return each.groupBy(F.col("i").alias("reader_id")).agg((F.sqrt(F.greatest(F.sum(F.expr("mij * mik * mjk")) / F.nullif(F.sum(F.expr("mjk * mjk")), F.lit(0.0)), F.lit(0.0))) + s).alias("p"))


def reliabilities(voted: DataFrame) -> DataFrame:
    """``(reader_id, n_reads, reliability, weight)`` of every reader."""
    one = settle(agreements(voted), "agreements")
    pairs = settle(one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), *COUNTS)), "pairs")
    # Two sums go to the driver: how often two losing reads were there, and were equal.
    chance = one.agg(F.sum("lost").alias("lost"), F.sum("lost_same").alias("same")).first()
    c = min(chance.same / chance.lost, 0.9) if chance.lost else 0.0
    s = c / (1 + c)
    found = solve(pairs.withColumn("m", (F.col("same") / F.col("n") - s) / (1 + c)), s)
    readers = voted.select(F.explode("readers").alias("reader_id")).groupBy("reader_id").agg(F.count(F.lit(1)).alias("n_reads"))
    mean = found.agg(F.avg("p").alias("mean"))
    p = F.least(F.greatest(F.coalesce("p", "mean", F.lit(0.5)), F.lit(0.01)), F.lit(0.99))
    out = settle(readers.join(found, "reader_id", "left").crossJoin(F.broadcast(mean)).select("reader_id", "n_reads", p.alias("reliability"), F.greatest(F.log(p / (1 - p)), F.lit(0.0)).alias("weight")), "readers")
    release(one, pairs)
    return out


def weighed(voted: DataFrame, readers: DataFrame) -> DataFrame:
    """The votes with the column ``weights``, one for each read."""
    known = readers.select("reader_id", "weight").limit(MOST_SENT + 1).collect()
    if len(known) <= MOST_SENT:
        shared = voted.sparkSession.sparkContext.broadcast({r.reader_id: r.weight for r in known})

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value
            for b in batches:
                yield b.append_column("weights", pa.array([[w.get(i, 0.0) for i in ids] for ids in b.column("readers").to_pylist()], pa.list_(pa.float64())))

        return voted.mapInArrow(go, VOTES + ", weights array<double>")
    reads = voted.select("line_id", F.posexplode(F.arrays_zip("readers", "forms"))).select("line_id", "pos", F.col("col.readers").alias("reader_id"), F.col("col.forms").alias("form"))
    back = reads.join(readers.select("reader_id", "weight"), "reader_id").groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("pos", "reader_id", "form", "weight"))).alias("v"))
    return voted.select("line_id", "stored").join(back, "line_id", "left").select("line_id", "stored", *(F.coalesce(F.col(f"v.{x}"), F.array().cast(k)).alias(y) for x, y, k in (("reader_id", "readers", "array<string>"), ("form", "forms", "array<string>"), ("weight", "weights", "array<double>"))))


def decide(weighted: DataFrame) -> DataFrame:
    """``(line_id, stored, consensus, n_reads, support, agreement, rival)`` of each line.

    Texts are in their one form, composed. ``support`` is the consensus' part of all weight, ``agreement`` the part of the pairs
    of reads that are equal. ``rival`` is a text of two readers or more that has more
    weight than the stored text, if there is one.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("stored", "consensus", "n_reads", "support", "agreement", "rival")}
            for stored, forms, weights in zip(*(b.column(x).to_pylist() for x in ("stored", "forms", "weights")), strict=True):
                weight: dict[str, list[float]] = defaultdict(list)
                for x, w in zip(forms, weights, strict=True):
                    weight[x].append(w)
                total = {x: math.fsum(w) for x, w in weight.items()}
                rank = lambda x: (-round(total[x], 9), -len(weight[x]), x != stored, x)
                best = min(total, key=rank, default=None)
                n, all_ = len(forms), math.fsum(weights)
                rivals = [x for x, w in weight.items() if len(w) > 1 and x != stored and total[x] > total.get(stored, 0.0) + 1e-9]
                composed = lambda t: None if t is None else unicodedata.normalize("NFC", t)
                for k, v in (("stored", composed(stored)), ("consensus", composed(best)), ("n_reads", n), ("support", total[best] / all_ if best is not None and all_ else None), ("agreement", sum(len(w) * (len(w) - 1) for w in weight.values()) / (n * (n - 1)) if n > 1 else None), ("rival", composed(min(rivals, key=rank, default=None)))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column("line_id"), *(pa.array(v, t) for v, t in zip(out.values(), (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()), strict=True))], names=["line_id", *out])

    return weighted.mapInArrow(go, "line_id string, stored string, consensus string, n_reads int, support double, agreement double, rival string")


def consensus(spark: SparkSession, lines: DataFrame, classes: Lookalikes) -> tuple[DataFrame, DataFrame]:
    """The decisions by line and the reliabilities by reader."""
    voted = settle(votes(spark, lines, classes), "votes")
    readers = reliabilities(voted)
    return decide(weighed(voted, readers)), readers
