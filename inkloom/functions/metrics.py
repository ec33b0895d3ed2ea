"""Edit distance and word coverage of texts, and the reports over them.

Both sides are expected in their scoring form. An empty reference has character error
rate 0 against an empty hypothesis and 1 against any other; a rate may exceed 1. Empty
reports have null medians.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate: edits per character of the reference."""
    return F.when(ref == "", F.when(hyp == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(ref, hyp) / F.length(ref))


def shared_words(ref: Column, hyp: Column) -> Column:
    """How many words two arrays share, each as often as it is in both.

    Per distinct word of the reference the smaller of both counts, inside the row: no
    explode and no shuffle.
    """
    both = F.array_intersect(ref, hyp)
    count = lambda a, w: F.size(F.filter(a, lambda x: x == w))
    return F.aggregate(both, F.lit(0), lambda acc, w: acc + F.least(count(ref, w), count(hyp, w)))


def coverage(ref: Column, hyp: Column) -> Column:
    """The part of the reference's words that the hypothesis has; 0 for an empty reference."""
    return F.when(F.size(ref) > 0, shared_words(ref, hyp) / F.size(ref)).otherwise(0.0)


def scored(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """The pairs with ``d`` (edits), ``n`` (characters), ``cer``, ``hit`` and ``words`` (shared and all words of the reference)."""
    from inkloom.functions.text import split_words

    r, h = F.col(ref), F.col(hyp)
    # One edit distance a row serves the rate and the sums.
    with_d = pairs.withColumn("d", F.levenshtein(r, h).cast("bigint")).withColumn("n", F.length(r).cast("bigint"))
    with_d = with_d.withColumn("cer", F.when(r == "", F.when(h == "", 0.0).otherwise(1.0)).otherwise(F.col("d") / F.col("n")))
    return with_d.withColumn("hit", shared_words(split_words(r), split_words(h)).cast("bigint")).withColumn("words", F.size(split_words(r)).cast("bigint"))


def line_report(hyp: str = "hyp", digits: int = 6, keep: list[str] | None = None) -> list[Column]:
    """The aggregates of a report over scored pairs, or those named in ``keep``; blank hypotheses are left out but for the no-drop median, which charges them in full."""
    said = F.col(hyp) != ""
    cer_, q = F.when(said, F.col("cer")), lambda x: F.round(x, digits)
    part = lambda a, b: q(F.sum(F.when(said, a)) / F.nullif(F.sum(F.when(said, b)), F.lit(0)))
    each = F.when(F.col("words") > 0, F.col("hit") / F.col("words")).otherwise(0.0)
    quartiles = F.percentile(cer_, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))  # one buffer for all three
    named = {
        "n_total": F.count(F.lit(1)),
        "n_scored": F.count_if(said),
        "n_blank": F.count_if(~said),
        "cer_median": q(F.get(quartiles, F.lit(1))),
        "cer_q1": q(F.get(quartiles, F.lit(0))),
        "cer_q3": q(F.get(quartiles, F.lit(2))),
        "cer_micro": part(F.col("d"), F.col("n")),
        "cer_median_nodrop": q(F.percentile(F.when(said, F.col("cer")).otherwise(1.0), F.lit(0.5))),
        "wcov_macro": q(F.avg(F.when(said, each))),
        "wcov_micro": part(F.col("hit"), F.col("words")),
    }
    return [named[k].alias(k) for k in keep or named]


def page_report(hyp: str = "hyp", digits: int = 6) -> list[Column]:
    """The same over pages, where blank ones are left out altogether."""
    return [F.count(F.lit(1)).alias("n_pages"), *line_report(hyp, digits, ["n_scored", "n_blank", "cer_micro", "cer_median", "wcov_macro", "wcov_micro"])]


def zipped(gold: DataFrame, said: DataFrame, place: str) -> DataFrame:
    """Gold and said rows by their place; sides of unlike length, or places that don't match, are an error."""
    n, m = gold.count(), said.count()
    if n != m:
        raise ValueError(f"{n} references and {m} hypotheses")
    out = gold.join(said, place)
    if out.count() != n:
        raise ValueError(f"the values of {place} don't match")
    return out


def summary(digits: int = 4) -> Column:
    """A line report in one sentence, as a column over its row."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c))).otherwise("-")
    count = lambda c: F.col(c).cast("string")
    return F.concat(F.lit("median "), number("cer_median"), F.lit(" ["), number("cer_q1"), F.lit(", "), number("cer_q3"), F.lit("], micro "), number("cer_micro"), F.lit(", no drop "), number("cer_median_nodrop"), F.lit(", words "), number("wcov_micro"), F.lit(", scored "), count("n_scored"), F.lit(" of "), count("n_total"))


# ---- the same in SQL, for comparisons ----------------------------------------------------------------------------------


def sql_levenshtein(x: str, y: str) -> str:
    """Edit distance of two lists of characters: rows of the distance table folded over both."""
    row = f"list_reduce(range(1, len({y}) + 1), lambda acc, j: list_append(acc, least(prev[j + 1] + 1, acc[j] + 1, prev[j] + (case when {y}[j] = ca then 0 else 1 end))), [prev[1] + 1])"
    return f"list_last(list_reduce({x}, lambda prev, ca: {row}, range(0, len({y}) + 1)))"


def sql_shared(ref: str, hyp: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({ref}, {hyp})), lambda w: least(len(list_filter({ref}, lambda v: v = w)), len(list_filter({hyp}, lambda v: v = w))))), 0)"


def sql_report(group: str = "") -> str:
    """The report over a relation ``scored(d, n, cer, hit, words, hyp)``."""
    head = f"{group}, " if group else ""
    return f"""select {head}count(*) as n_total, count(*) filter (hyp <> '') as n_scored, count(*) filter (hyp = '') as n_blank,
 round(quantile_cont(cer, 0.5::double) filter (hyp <> ''), 6) as cer_median, round(quantile_cont(cer, 0.25::double) filter (hyp <> ''), 6) as cer_q1,
 round(quantile_cont(cer, 0.75::double) filter (hyp <> ''), 6) as cer_q3, round(sum(d) filter (hyp <> '')::double / nullif(sum(n) filter (hyp <> ''), 0), 6) as cer_micro,
 round(quantile_cont(case when hyp <> '' then cer else 1e0 end, 0.5::double), 6) as cer_median_nodrop,
 round(avg(case when words > 0 then hit::double / words else 0e0 end) filter (hyp <> ''), 6) as wcov_macro,
 round(sum(hit) filter (hyp <> '')::double / nullif(sum(words) filter (hyp <> ''), 0), 6) as wcov_micro
 from scored""" + (f" group by {group}" if group else "")


def sql_scored(pairs: str, extra: str = "") -> str:
    """CTEs ``raw`` (of ``pairs``: ref and hyp in scoring form) to ``scored``."""
    from inkloom.functions.text import sql_words

    least = "least(len(cx), len(cy))"
    # What both texts have at their beginning and end adds nothing to the distance.
    lead = f"coalesce(list_position(list_transform(range(1, {least} + 1), lambda i: cx[i] <> cy[i]), true) - 1, {least})"
    tail = f"coalesce(list_position(list_transform(range(0, {least} - p), lambda i: cx[len(cx) - i] <> cy[len(cy) - i]), true) - 1, {least} - p)"
    return f"""raw as ({pairs}), chars as (select *, regexp_extract_all(ref, '(?s).') as cx, regexp_extract_all(hyp, '(?s).') as cy from raw),
 leads as (select *, {lead} as p from chars), tails as (select *, {tail} as q from leads),
 trimmed as (select * exclude (cx, cy), cx[p + 1:len(cx) - q] as cx, cy[p + 1:len(cy) - q] as cy from tails),
 edits as (select *, {sql_levenshtein("cx", "cy")}::bigint as d0, {sql_words("ref")} as rw, {sql_words("hyp")} as hw from trimmed),
 scored as (select *, (case when ref = '' then length(hyp) else d0 end)::bigint as d, length(ref)::bigint as n,
 case when ref = '' then (case when hyp = '' then 0e0 else 1e0 end) else d0::double / length(ref) end as cer, {sql_shared("rw", "hw")}::bigint as hit, len(rw)::bigint as words{extra} from edits)"""
