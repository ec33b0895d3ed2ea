"""Decoding of CTC frames held as ``ARRAY<ARRAY<DOUBLE>>`` (frames of log-probabilities by class; class 0 is the blank).

Greedy decoding, confidences, top classes, log-softmax and averaging are higher-order
functions inside whole-stage code; the beam search runs in Arrow batches. Null frames decode
to the empty text with confidence 0; of equal classes the first stands.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.lm import Model


def valid(frames: Column, n: Column | None = None) -> Column:
    """The first ``n`` frames; all of them without n."""
    return frames if n is None else F.slice(frames, F.lit(1), n)


def log_softmax(scores: Column) -> Column:
    """Log-probabilities of one frame's scores."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(scores, lambda x: x - top - F.log(total))


def best_path(frames: Column) -> Column:
    """The best class (from 0) of every frame."""
    return F.transform(frames, lambda f: (F.array_position(f, F.array_max(f)) - 1).cast("int"))


def collapse(path: Column) -> Column:
    """The path without repeats and blanks; a repeat is one of the frame before, blank or not."""
    return F.filter(path, lambda c, i: (c != 0) & ((i == 0) | (c != F.try_element_at(path, i.cast("int")))))


def greedy(frames: Column, symbols: list[str]) -> Column:
    """The text of the best path; ``symbols`` gives each class' string."""
    table = F.array(*map(F.lit, symbols))
    return F.coalesce(F.array_join(F.transform(collapse(best_path(frames)), lambda c: F.element_at(table, c + 1)), ""), F.lit(""))


def confidence(frames: Column, emitting: bool = False) -> Column:
    """The mean probability of the best class over all frames, or over those whose best class isn't the blank."""
    best = F.transform(frames, lambda f: F.struct(F.array_max(f).alias("p"), (F.array_position(f, F.array_max(f)) - 1).alias("c")))
    kept = F.filter(best, lambda b: b["c"] != 0) if emitting else best
    total = F.aggregate(kept, F.lit(0.0), lambda a, b: a + F.exp(b["p"]))
    return F.coalesce(F.when(F.size(kept) > 0, total / F.size(kept)), F.lit(0.0))


def top_classes(frame: Column, k: int) -> Column:
    """The k best classes of a frame, best first."""
    order = F.array_sort(F.transform(frame, lambda x, i: F.struct((-x).alias("s"), i.alias("c"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["c"])


def average(a: Column, b: Column, wa: float = 0.5, floor: float = 1e-9) -> Column:
    """The frame whose probabilities are the weighted mean of two frames' over the same classes."""
    return F.zip_with(a, b, lambda x, y: F.log(F.greatest(wa * F.exp(x) + (1 - wa) * F.exp(y), F.lit(floor))))


def _add(a: float, b: float) -> float:
    hi, lo = (a, b) if a >= b else (b, a)
    return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))


def beam_text(frames: np.ndarray, symbols: list[str], width: int = 16, top: int = 8, lm: Callable[[str, str], float] | None = None, lm_weight: float = 0.4, length_bonus: float = 0.6, bonus: Callable[[str], float] | None = None, word_weight: float = 0.0) -> str:
    """The best text by prefix beam search.

    A beam holds, for every prefix, the log-probability of ending in a blank and of
    ending in its last character. Language model and length bonus count for each
    character, word bonuses for each word once it is closed, the last one at the end.
    """
    beam: dict[str, tuple[float, float]] = {"": (0.0, -math.inf)}
    for frame in frames:
        classes = np.argsort(-frame, kind="stable")[:top]
        grown: dict[str, list[float]] = {}

        def put(prefix: str, blank: float, char: float, grown: dict[str, list[float]] = grown) -> None:
            cell = grown.setdefault(prefix, [-math.inf, -math.inf])
            cell[0], cell[1] = _add(cell[0], blank), _add(cell[1], char)

        for prefix, (pb, pc) in beam.items():
            both = _add(pb, pc)
            for c in classes:
                p, s = float(frame[c]), symbols[c]
                if c == 0:
                    put(prefix, both + p, -math.inf)
                    continue
                source = both
                if prefix.endswith(s):
                    put(prefix, -math.inf, pc + p)
                    source = pb
                if source == -math.inf:
                    continue
                extra = lm_weight * lm(prefix, s) + length_bonus if lm else 0.0
                if s == " " and bonus and word_weight and (word := prefix.rpartition(" ")[2]):
                    extra += word_weight * bonus(word)
                put(prefix + s, -math.inf, source + p + extra)
        kept = sorted(grown.items(), key=lambda x: -_add(*x[1]))[:width]
        beam = {k: (v[0], v[1]) for k, v in kept} or {"": (0.0, -math.inf)}

    def final(item: tuple[str, tuple[float, float]]) -> float:
        word = item[0].rpartition(" ")[2]
        return _add(*item[1]) + (word_weight * bonus(word) if bonus and word_weight and word else 0.0)

    return max(beam.items(), key=final)[0]


def average_shared(frames: DataFrame, alphabets: DataFrame, weights: DataFrame, key: str, floor: float = 1e-9) -> DataFrame:
    """``(key, t, ch, lp)``: the weighted mean of the probabilities of any number of systems over the characters that all of them have.

    ``frames(key, system, t, c, lp)``, ``alphabets(system, c, ch)``, ``weights(system, weight)``. Probabilities are first brought to
    sum 1 over the shared characters. Alphabets are small, so the join with them stays on the frames' side; one exchange by (key, t).
    """
    n = alphabets.agg(F.count_distinct("system").alias("n"))
    shared = alphabets.groupBy("ch").agg(F.count_distinct("system").alias("k")).join(n, F.col("k") == F.col("n")).select("ch")
    parts = weights.crossJoin(weights.agg(F.sum("weight").alias("all"))).select("system", (F.col("weight") / F.col("all")).alias("part"))
    known = alphabets.join(shared, "ch").join(parts, "system")
    each = frames.join(known, ["system", "c"]).withColumn("p", F.exp("lp"))
    alone = each.withColumn("sum", F.sum("p").over(Window.partitionBy(key, "t", "system")))
    return alone.groupBy(key, "t", "ch").agg(F.log(F.greatest(F.sum(F.col("part") * F.col("p") / F.col("sum")), F.lit(floor))).alias("lp"))


def beam(df: DataFrame, key: str, frames: str, symbols: list[str], width: int = 16, top: int = 8, model: Model | None = None, word_weight: float = 0.0, **options: object) -> DataFrame:
    """``(key, decoded)`` by prefix beam search, in Arrow batches; with a model its characters and, by ``word_weight``, its words count."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # of bounded size

    def go(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        if m is not None:
            options.update(lm=m.logprob, bonus=m.bonus, word_weight=word_weight)
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "decoded": ["" if f is None or not len(f) else beam_text(np.array([np.asarray(x, float) for x in f]), symbols, width, top, **options) for f in pdf[frames]]})

    return df.select(key, frames).mapInPandas(go, f"{key} {kind}, decoded string")
