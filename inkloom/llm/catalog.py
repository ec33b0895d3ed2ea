"""Queries of the llm problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm import consensus, forms_sql, leaks, lookalike, mixing, packing, pii
from inkloom.llm.tokens import with_tokens


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def gold_classes(spark: SparkSession, d: str) -> lookalike.Lookalikes:
    """The look-alike classes of the gold texts, with the representatives they use most."""
    return lookalike.learn([(table(spark, d, "gold_lines"), "text"), (table(spark, d, "gold_pages"), "page_text")])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.equal_looking(spark, [(table(spark, d, "gold_lines"), "line_id", "text"), (table(spark, d, "gold_pages"), "page_id", "page_text")], gold_classes(spark, d))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    classes = gold_classes(spark, d)
    lines = table(spark, d, "gold_lines").select(F.lit("gold_lines").alias("table_name"), F.col("line_id").alias("rec_id"), F.col("text"))
    pages = table(spark, d, "gold_pages").select(F.lit("gold_pages").alias("table_name"), F.col("page_id").alias("rec_id"), F.col("page_text").alias("text"))
    return lookalike.with_form(spark, lines.unionByName(pages), classes, "text").drop("text")


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spark, table(spark, d, "train_batches"), table(spark, d, "gold_lines"), lookalike.standard(keep_breaks=False))


def gold_consensus(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(spark, table(spark, d, "gold_lines"), lookalike.standard(keep_breaks=False))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return gold_consensus(spark, d)[0].where("stored <> '' and rival is not null").select("line_id")


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p5_containers(spark, d), table(spark, d, "container_specs"))


def p5_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every capacity: documents placed, those placed whole (cut only where they must be), containers over their capacity."""
    packed, specs = p5_containers(spark, d), table(spark, d, "container_specs").select("spec_id", "capacity_tokens").distinct()
    placed = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    sized = with_tokens(table(spark, d, "documents"), ["doc_id"], "text").where("n_tokens is not null")
    whole = (F.col("tokens") == F.col("n_tokens")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity_tokens"))))
    each = placed.join(specs, "spec_id").join(sized, "doc_id").groupBy("spec_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(whole).alias("n_whole"))
    return each.join(packing.fill_report(packed, specs).select("spec_id", F.col("fullest") > F.col("capacity_tokens")).toDF("spec_id", "over"), "spec_id")


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "source_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    sized, targets = mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "source_targets")
    return mixing.shares(sized, mixing.mix(sized, targets), targets)


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every target: documents it could take, documents taken more often than allowed, and documents taken twice over."""
    sized, targets = mixing.sized_documents(table(spark, d, "documents")), table(spark, d, "source_targets")
    limits = targets.groupBy("source").agg(F.min("max_repeats").alias("max_repeats"))
    took = mixing.mix(sized, targets).join(limits, "source").groupBy("source").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("n_over"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n_twice"))
    could = sized.where("n_tokens is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"))
    out = limits.join(could, "source", "left").join(took, "source", "left").select("source", "max_repeats", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_over", "n_twice")))
    return out


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to nine digits, beyond which the order of summing shows."""
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def learned(spark: SparkSession, d: str) -> tuple[pii.Known, pii.Folding]:
    return pii.learn(spark, table(spark, d, "documents"), table(spark, d, "known_names"), lookalike.standard(keep_breaks=False))


QUERIES = {
    "p1_found": p1_found,
    "p1_forms": p1_forms,
    "p3_found": lambda s, d: p3_spans(s, d).select("batch_id", "text_no", "line_id"),
    "p3_spans": p3_spans,
    "p4_found": p4_found,
    "p4_lines": lambda s, d: rounded(gold_consensus(s, d)[0]),
    "p4_readers": lambda s, d: rounded(gold_consensus(s, d)[1]),
    "p5_containers": p5_containers,
    "p5_fill": p5_fill,
    "p5_rules": p5_rules,
    "p6_mixture": p6_mixture,
    "p6_shares": p6_shares,
    "p6_rules": p6_rules,
    "p7_found": lambda s, d: pii.identifiers(table(s, d, "documents"), *learned(s, d)).drop("end_pos"),
    "p7_redacted": lambda s, d: pii.redacted(table(s, d, "documents"), *learned(s, d)),
}

# ---- the same in SQL ---------------------------------------------------------------------------------------------------

RECORDS = "records as (select 'l' as k, line_id as id, text as t from gold_lines where line_id is not null union all select 'p', page_id, page_text from gold_pages where page_id is not null)"
VOTES = f"""with lines as (select distinct line_id, text, reads, reader_ids from gold_lines), {forms_sql.forms("f", "select text as t from lines union all select unnest(reads) from lines", False)},
 said as (select line_id, i, reader_ids[i] as reader, reads[i] as t from (select line_id, reads, reader_ids, unnest(range(1, least(len(reads), len(reader_ids)) + 1)) as i from lines) where reader_ids[i] is not null and reads[i] <> ''),
 votes as (select line_id, reader, form from (select * from said qualify row_number() over (partition by line_id, reader order by i desc) = 1) join f using (t) where form <> ''),
 stored as (select line_id, case when text = '' then '' else form end as stored from lines left join f on t = text),
 tops as (select line_id, form as top, count(*) as most from votes group by line_id, form qualify row_number() over (partition by line_id order by most desc, form) = 1),
 one as (select a.reader as i, b.reader as j, count(*) as n, count(*) filter (a.form = b.form) as same, count(*) filter (most > 1 and a.form <> top and b.form <> top) as lost, count(*) filter (most > 1 and a.form <> top and a.form = b.form) as lost_same from votes a join votes b on a.line_id = b.line_id and a.reader < b.reader join tops t on t.line_id = a.line_id group by all),
 chance as (select c / (1 + c) as s, c from (select coalesce(least(sum(lost_same)::double / nullif(sum(lost), 0), 0.9e0), 0e0) as c from one)),
 pairs as (select i, j, (same::double / n - s) / (1 + c) as m from one, chance union all select j, i, (same::double / n - s) / (1 + c) from one, chance),
 solved as (select a.i as reader, sqrt(greatest(sum(a.m * b.m * c.m) / nullif(sum(c.m * c.m), 0), 0e0)) + any_value(s) as p from pairs a join pairs b on a.i = b.i and a.j < b.j join pairs c on c.i = a.j and c.j = b.j, chance group by a.i),
 readers_ as (select v.reader, count(*) as n_reads, least(greatest(coalesce(any_value(p), (select avg(p) from solved), 0.5e0), 0.01e0), 0.99e0) as p from votes v left join solved using (reader) group by v.reader),
 weighed as (select line_id, form, count(*) as k, sum(greatest(ln(p / (1 - p)), 0e0)) as w from votes join readers_ using (reader) group by all),
 sums as (select line_id, sum(k) as n, sum(w) as all_w, sum(k * (k - 1)) as equal from weighed group by line_id),
 ranked as (select w.*, stored, row_number() over (partition by line_id order by -round(w, 9), -k, form is distinct from stored, form) as r, coalesce(max(w) filter (form = stored) over (partition by line_id), 0e0) as stored_w from weighed w join stored using (line_id)),
 rivals as (select line_id, form as rival from ranked where k > 1 and form is distinct from stored and w > stored_w + 1e-9 qualify row_number() over (partition by line_id order by r) = 1)"""
#: Both are checked against SQL over whole tables; the rest is tested against brute force, round trips and invariants in tests.
SQL: dict[str, str] = {
    "p1_found": f"with {RECORDS}, {forms_sql.forms('f', 'select t from records', True)}, keyed as (select distinct k, id, t, form from records join f using (t) where form <> '') select distinct least(a.id, b.id) as rec_a, greatest(a.id, b.id) as rec_b from keyed a join keyed b on a.k = b.k and a.form = b.form and a.t <> b.t and a.id <> b.id",
    "p4_found": f"{VOTES} select line_id from rivals join stored using (line_id) where stored <> ''",
    "p4_lines": f"{VOTES} select s.line_id, s.stored, r.form as consensus, coalesce(n, 0)::int as n_reads, round(r.w / nullif(all_w, 0), 9) as support, round(equal / nullif(n * (n - 1), 0)::double, 9) as agreement, rival from stored s left join ranked r on r.line_id = s.line_id and r.r = 1 left join sums u on u.line_id = s.line_id left join rivals v on v.line_id = s.line_id",
    "p4_readers": f"{VOTES} select reader as reader_id, n_reads, round(p, 9) as reliability, round(greatest(ln(p / (1 - p)), 0e0), 9) as weight from readers_",
    "p5_rules": "select spec_id, capacity_tokens, count(*) as n_documents, count(*) as n_whole, false as over from (select distinct spec_id, capacity_tokens from container_specs), documents where text is not null group by all",
    "p6_rules": "select t.source, min(max_repeats)::int as max_repeats, (select count(*) from documents d where d.source = t.source and text is not null) as n_documents, 0::bigint as n_over, 0::bigint as n_twice from source_targets t group by t.source",
}
