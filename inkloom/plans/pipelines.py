"""Queries of pipelines: models kept and used in decoding, sources and archives, sweeps over configurations, reports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import metrics, text
from inkloom.operators import augment, charset, combine, ctc, geometry, lm
from inkloom.plans.reference import BOARD, CHARS, GOLD, GRAMS, LONG, PAIRS, PAGES, READ_SCORED, SCORED, SET, WORDS, board, built, gold, grams, load, normal_gold, pairs, page_means, query, read_pairs, soft
from inkloom.session import settle, shared_folder
from inkloom.sources import readers, sinks


def place(s: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_folder(s), f"{name}-{uuid.uuid4().hex}")


# ---- models -----------------------------------------------------------------------------------------------------------


@query("q_lm_roundtrip", f"with {GOLD}, {GRAMS} select n, gram, cnt, 3e0 as model_order, 0.4e0 as backoff from grams where n < 3 or cnt >= 2")
def q_lm_roundtrip(s, d):
    path = place(s, "lm")
    lm.save(lm.prune_ngrams(grams(s, d), 2), path, order=3, backoff=lm.BACKOFF)
    back, meta = lm.restore(s, path)
    return back.select("n", "gram", "cnt", F.lit(meta["order"]).alias("model_order"), F.lit(meta["backoff"]).alias("backoff"))


@query("q_word_lm_roundtrip", f"with {GOLD}, {WORDS} select word, cnt, (select sum(cnt) from words)::double as total, -14e0 as oov, -2.5e0 as prefix_cost from words where cnt >= 2")
def q_word_lm_roundtrip(s, d):
    words, path = lm.word_counts(normal_gold(s, d), "t"), place(s, "words")
    total = words.agg(F.sum("cnt").alias("t")).first().t
    lm.save(lm.prune_words(words, 2), path, total=total, oov=lm.OOV, prefix_cost=lm.PREFIX_COST)
    back, meta = lm.restore(s, path)
    return back.select("word", "cnt", *(F.lit(meta[k]).alias(k) for k in ("total", "oov", "prefix_cost")))


@query("q_charset_roundtrip", f"with {GOLD}, {CHARS}, {SET} select idx, ch from built")
def q_charset_roundtrip(s, d):
    path = place(s, "charset")
    charset.save(built(s, d), path)
    return charset.restore(s, path)


@query("q_charset_standard_part", f"with {GOLD}, t as (select line_id, {text.sql_normalize('text')} as t from gold) select line_id, round(case when t = '' then 1e0 else len(regexp_extract_all(t, '[א-ת0-9 ''\"\\-.,:;!?()\\[\\]{{}}/\\\\|*+=%&#@_<>~^$a-zA-Z]'))::double / length(t) end, 6) as known_part from t")
def q_charset_standard_part(s, d):
    codec = charset.Codec(charset.standard(s))
    return normal_gold(s, d).select("line_id", F.round(codec.known_part(F.col("t"), codec.encode(F.col("t"))), 6).alias("known_part"))


SPOKEN = ["", "a", "b", " "]
SAY = "case s.c when 1 then 'a' when 2 then 'b' else ' ' end"
ADD = "greatest({0}, {1}) + ln(1 + exp(least({0}, {1}) - greatest({0}, {1})))"
LAST = "split_part(prefix, ' ', -1)"
BONUS = f"0.2e0 * coalesce((select greatest(ln(cnt::double / total) + 14e0, 0e0) from said_words w where w.word = {LAST} and {LAST} <> ''), 0e0)"


@query(
    "q_ctc_beam_lm",
    f"""with recursive {LONG}, path as (select *, lag(c) over (partition by vec_id order by t) as prev from best), said as (select vec_id, coalesce(string_agg(case c when 1 then 'a' when 2 then 'b' else ' ' end, '' order by t) filter (c <> 0 and c is distinct from prev), '') as t from path group by vec_id),
 counts as (select n::int as n, substr(p, i, n) as gram, count(*) as cnt from (select chr(2) || t as p from said where t <> ''), range(1, 4) as o(n), range(1, length(p) - n + 2) as q(i) group by all), total as (select sum(length(t)) as total from said),
 lms as (select a.gram, ln(a.cnt::double / (case when a.n = 1 then total else b.cnt end)) as lp from counts a join total on true left join counts b on b.n = a.n - 1 and b.gram = a.gram[1:a.n - 1]),
 said_words as (select word, count(*) as cnt, any_value(total) as total from (select word, count(*) over () as total from (select unnest(regexp_extract_all(t, '[ab]+')) as word from said)) group by word),
 beam as (select vec_id, 0 as t, '' as prefix, 0e0 as pb, -1e300 as pc from embeddings union all
 select vec_id, t, prefix, pb, pc from (select vec_id, t, prefix, pb, pc, row_number() over (partition by vec_id order by {ADD.format('pb', 'pc')} desc) as r from (
  select vec_id, t, prefix, max(b) + ln(sum(exp(b - mb))) as pb, max(c) + ln(sum(exp(c - mc))) as pc from (select *, max(b) over (partition by vec_id, prefix) as mb, max(c) over (partition by vec_id, prefix) as mc from (
   select vec_id, t, unnest(case when c = 0 then [struct_pack(prefix := prefix, b := {ADD.format('pb', 'pc')} + lp, c := -1e300)] when right(prefix, 1) = ch then [struct_pack(prefix := prefix, b := -1e300, c := greatest(pc + lp, -1e300)), struct_pack(prefix := prefix || ch, b := -1e300, c := greatest(pb + lp + extra, -1e300))] else [struct_pack(prefix := prefix || ch, b := -1e300, c := {ADD.format('pb', 'pc')} + lp + extra)] end, recursive := true) from (
    select b.vec_id, b.t + 1 as t, prefix, pb, pc, s.c, s.lp, {SAY} as ch, 0.6e0 + 0.4e0 * coalesce(l3.lp, l2.lp + (case when length(prefix) > 1 then ln(0.4e0) else 0e0 end), l1.lp + least(2, length(prefix)) * ln(0.4e0), (1 + least(2, length(prefix))) * ln(0.4e0) - ln((select total from total)::double)) + (case when s.c = 3 then {BONUS} else 0e0 end) as extra
    from beam b join soft s on s.vec_id = b.vec_id and s.t = b.t left join lms l3 on length(prefix) > 1 and l3.gram = right(prefix, 2) || {SAY} left join lms l2 on length(prefix) > 0 and l2.gram = right(prefix, 1) || {SAY} left join lms l1 on l1.gram = {SAY}))) group by vec_id, t, prefix)) where r <= 12)
 select vec_id, arg_max(prefix, {ADD.format('pb', 'pc')} + {BONUS}) as decoded from beam where t = 16 group by vec_id""",
)
def q_ctc_beam_lm(s, d):
    """Beam search with a character model and a word model of what greedy decoding says."""
    said = soft(s, d).select("vec_id", ctc.greedy(F.col("frames"), SPOKEN).alias("t"))
    words = lm.word_counts(said, "t", "[ab]+")
    model = lm.Model.load(lm.char_ngrams(said, "t", 3), 3, words)
    return ctc.beam(soft(s, d), "vec_id", "frames", SPOKEN, 12, 4, model=model, word_weight=0.2)


SYSTEMS = [["", "a", "b", "c"], ["", "b", "a", "d"], ["", "e", "a", "b"]]
WEIGHTS = [1.0, 0.9, 0.8]


@query("q_shared_average", f"with {LONG}, names(system, c, ch) as (values {', '.join(f'''({i}, {c}, '{ch}')''' for i, chs in enumerate(SYSTEMS) for c, ch in enumerate(chs))}), weights(system, weight) as (values {', '.join(f'({i}, {w}::double)' for i, w in enumerate(WEIGHTS))}), shared as (select ch from names group by ch having count(distinct system) = 3), each as (select s.vec_id - system as vec_id, system, t, ch, weight / 2.7e0 as w, exp(lp) as p from soft s join names n on n.c = s.c join weights using (system) join shared using (ch)), norm as (select *, p / sum(p) over (partition by vec_id, t, system) as q from each) select vec_id, t::int as t, ch, round(ln(greatest(sum(w * q), 1e-9)), 6) as lp from norm group by all having count(*) = 3")
def q_shared_average(s, d):
    """Three systems (a vector and the two after it) with alphabets of their own, averaged over what all of them can say."""
    systems = s.createDataFrame([(i,) for i in range(3)], "system int")
    long = soft(s, d).select("vec_id", F.posexplode("frames").alias("t", "f")).select("vec_id", "t", F.posexplode("f").alias("c", "lp"))
    frames = long.crossJoin(F.broadcast(systems)).withColumn("vec_id", F.col("vec_id") - F.col("system"))
    whole = frames.groupBy("vec_id").agg(F.count_distinct("system").alias("k")).where("k = 3").select("vec_id")
    names = s.createDataFrame([(i, c, ch) for i, chs in enumerate(SYSTEMS) for c, ch in enumerate(chs)], "system int, c int, ch string")
    weights = s.createDataFrame(list(enumerate(WEIGHTS)), "system int, weight double")
    return ctc.average_shared(frames.join(whole, "vec_id", "left_semi"), names, weights, "vec_id").withColumn("lp", F.round("lp", 6))


# ---- sources ----------------------------------------------------------------------------------------------------------


@query("q_archive_pages", "select split_name, page_file || '#' || xml_id as entry, md5(any_value(body)) as h, length(any_value(body)) as n from page_xml where body is not null and split_name is not null group by xml_id, page_file, split_name")
def q_archive_pages(s, d):
    """Exports packed into an archive a split, and read back entry by entry."""
    pages = load(s, d, "page_xml").where("body is not null").select("split_name", F.concat("page_file", F.lit("#"), F.col("xml_id").cast("string")).alias("entry"), "body").distinct()
    packed = readers.archived(pages, "split_name", "entry", "body")
    body = F.col("content").cast("string")
    return readers.archive_entries(packed, "split_name", "content").select("split_name", "entry", F.md5("content").alias("h"), F.length(body).cast("bigint").alias("n"))


CAPS = {"letters": 40, "notebooks": None, "encyclo": 15, "foreign_ink": 10}


@query("q_composite_sources", "select source_name, source_no, doc_id, rank from (select source as source_name, no::int as source_no, doc_id, row_number() over (partition by source order by md5('5:' || doc_id), doc_id) as r, cap, case when cap is null then null else r end::int as rank from documents join (values ('letters', 0, 40), ('notebooks', 1, null), ('encyclo', 2, 15)) as c(name, no, cap) on name = source) where cap is null or r <= cap")
def q_composite_sources(s, d):
    docs = load(s, d, "documents")
    registry = {n: readers.Registered(lambda n=n: docs.where(F.col("source") == n), cap, n != "foreign_ink") for n, cap in CAPS.items()}
    return readers.composite(registry, "all", ["doc_id"], "doc_id", seed=5).select("source_name", "source_no", "doc_id", "rank")


@query("q_prefix_limit", f"{READ_SCORED} select line_id, reader_id, round(cer, 6) as cer from scored where cer <= 0.5e0 order by line_id, reader_id limit 200")
def q_prefix_limit(s, d):
    good = metrics.scored(read_pairs(s, d)).where("cer <= 0.5")
    return good.orderBy("line_id", "reader_id").limit(200).select("line_id", "reader_id", F.round("cer", 6).alias("cer"))


@query("q_matching_shapes", f"with {GOLD}, have as (select page_id, count(*) as n from gold group by page_id) select distinct p.page_id, n_lines from gold_pages p join have h on h.page_id = p.page_id and h.n = p.n_lines")
def q_matching_shapes(s, d):
    """Pages whose name and number of lines are those of their gold lines."""
    have = gold(s, d).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return load(s, d, "gold_pages").select("page_id", "n_lines").distinct().join(have, ["page_id", "n_lines"], "left_semi")


@query("q_skipped_keys", f"with {GOLD}, have as (select page_id, count(*)::int as n from gold group by page_id) select page_id, n_lines from gold_pages except select page_id, n from have")
def q_skipped_keys(s, d):
    """The set difference of keys that the matching above leaves out."""
    have = gold(s, d).groupBy("page_id").agg(F.count(F.lit(1)).cast("int").alias("n_lines"))
    return load(s, d, "gold_pages").select("page_id", "n_lines").subtract(have)


@query("q_rejection_draw", f"with names as (select name_text, row_number() over (order by name_id, name_text) - 1 as no from known_names where name_text is not null), tries as (select i as draw, k as attempt, {readers.SQL_NUMBER.format(4, '(i * 8 + k)')} % (select count(*) from names) as no from range(500) as r(i), range(8) as t(k)) select draw, min(attempt)::int as attempt, arg_min(name_text, attempt) as name_text from tries join names using (no) where length(name_text) >= 4 group by draw")
def q_rejection_draw(s, d):
    """For each draw the first of up to eight tries that is long enough; the names are a table of fixed size."""
    names = load(s, d, "known_names").where("name_text is not null").select("name_text", (F.row_number().over(Window.orderBy("name_id", "name_text")) - 1).alias("no"))
    total = names.agg(F.count(F.lit(1)).alias("n"))
    tries = s.range(500 * 8).select(F.floor(F.col("id") / 8).alias("draw"), (F.col("id") % 8).cast("int").alias("attempt"), readers.number(4, F.col("id")).alias("h")).crossJoin(F.broadcast(total)).withColumn("no", F.col("h") % F.col("n"))
    good = tries.join(F.broadcast(names), "no").where(F.length("name_text") >= 4)
    return good.groupBy("draw").agg(F.min("attempt").alias("attempt"), F.min_by("name_text", "attempt").alias("name_text"))


@query("q_dev_set", f"with {GOLD} select line_id, {text.sql_normalize('text')} as t from gold where {text.sql_normalize('text')} <> '' order by md5('7:' || line_id), line_id limit 60")
def q_dev_set(s, d):
    """A sample of lines, kept in the shared folder and read back."""
    return settle(readers.sample(normal_gold(s, d).where("t <> ''").select("line_id", "t"), "line_id", 60, seed=7), "dev")


@query("q_renderable", f"with {GOLD}, t as (select line_id, trim(regexp_replace(regexp_replace({text.sql_normalize('text')}, '[^א-ת ]+', '', 'g'), ' +', ' ', 'g')) as t from gold) select line_id, t from t where length(t) >= 4")
def q_renderable(s, d):
    return normal_gold(s, d).select("line_id", augment.renderable_text(F.col("t"), "א-ת").alias("t")).where(F.length("t") >= 4)


@query("q_glyph_ratios", "with g as (select l_returnflag || l_linestatus as ch, (30 + l_linenumber * 6 + l_orderkey % 7)::int as h, l_orderkey * 10 + l_linenumber as k from lineitem), few as (select * from (select *, row_number() over (partition by ch order by k) as r from g) where r <= 200), m as (select ch, median(h) as m, count(*) as n from few group by ch) select ch, n, round(m / (select median(m) from m where ch in ('AF', 'RF')), 6) as ratio from m")
def q_glyph_ratios(s, d):
    """Line items as glyphs of four characters: at most 200 of each, and their median heights against the plain ones'."""
    c = F.col
    glyphs = load(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ch"), (30 + c("l_linenumber") * 6 + c("l_orderkey") % 7).cast("int").alias("h"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("k"))
    return augment.glyph_ratios(augment.glyph_bank(glyphs, "ch", "k", 200), "ch", "h", ["AF", "RF"]).withColumn("ratio", F.round("ratio", 6))


@query("q_image_text", "select line_id, md5(base64(image)) as h, length(base64(image)) as n from (select line_id, image from gold_lines where image is not null)")
def q_image_text(s, d):
    coded = F.translate(F.base64("image"), "\r\n", "")  # in one line
    return load(s, d, "gold_lines").where("image is not null").select("line_id", F.md5(coded).alias("h"), F.length(coded).cast("bigint").alias("n"))


# ---- evaluation -------------------------------------------------------------------------------------------------------


@query("q_prediction_records", f"with {GOLD} select line_id, page_id, coalesce(text, '') as gold, coalesce(reads[len(reads)], '') as pred from gold")
def q_prediction_records(s, d):
    said = F.get("reads", F.size("reads") - 1)
    return gold(s, d).select("line_id", "page_id", F.coalesce("text", F.lit("")).alias("gold"), F.coalesce(said, F.lit("")).alias("pred"))


@query("q_unequal_sides", f"with {GOLD} select line_id, len(reads)::int as n_reads, len(reader_ids)::int as n_readers from gold where len(reads) <> len(reader_ids)")
def q_unequal_sides(s, d):
    """Lines whose reads and readers can't be put side by side."""
    return gold(s, d).where(F.size("reads") != F.size("reader_ids")).select("line_id", F.size("reads").alias("n_reads"), F.size("reader_ids").alias("n_readers"))


# The configurations of a sweep, written down before anything is scored: which read, or the longest of several views.
CONFIGS = [("first", '{"kind": "single", "place": 0}'), ("second", '{"kind": "single", "place": 1}'), ("last", '{"kind": "single", "place": -1}'), ("views", '{"kind": "views", "tta": 3}'), ("vote", '{"kind": "vote"}')]
SPEC = "kind string, place int, tta int, beam_width int"
SWEPT = ", ".join(["n_total", "n_scored", "n_blank", "cer_median", "cer_median_nodrop", "cer_micro", "wcov_micro"])


def sql_config(name: str, said: str) -> str:
    pairs_ = f"select line_id, {text.sql_normalize('text')} as ref, {text.sql_normalize(said)} as hyp from gold"
    return f"select '{name}' as name, {SWEPT} from (with {metrics.sql_scored(pairs_)} {metrics.sql_report()})"


LONGEST = "coalesce(list_reduce(list_filter(reads[1:3], lambda x: trim(coalesce(x, '')) <> ''), lambda a, b: case when length(b) > length(a) then b else a end, ''), '')"


@query("q_config_sweep", f"with {GOLD} " + " union all ".join(sql_config(n, e) for n, e in (("first", "reads[1]"), ("second", "reads[2]"), ("last", "reads[len(reads)]"), ("views", LONGEST))))
def q_config_sweep(s, d):
    """A report for each configuration: one pass over the lines, exploded by configuration."""
    specs = s.createDataFrame([c for c in CONFIGS if c[0] != "vote"], "name string, spec string").withColumn("p", F.from_json("spec", SPEC))
    views = F.filter(F.transform(F.slice("reads", 1, 3), lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t"))), lambda v: F.trim(F.coalesce(v["t"], F.lit(""))) != "")
    one = F.get("reads", F.when(F.col("p.place") < 0, F.size("reads") + F.col("p.place")).otherwise(F.col("p.place")))
    said = F.when(F.col("p.kind") == "views", F.array_max(views)["t"]).otherwise(one)
    each = gold(s, d).crossJoin(F.broadcast(specs)).select("name", text.normalize(F.col("text")).alias("ref"), text.normalize(said).alias("hyp"))
    return metrics.scored(each).groupBy("name").agg(*metrics.line_report(keep=SWEPT.split(", ")))


GRID = "grid as (select a as most, b as least from (values (0.05::double), (0.1::double), (0.2::double), (1.0::double)) as x(a), (values (2), (8), (20)) as y(b))"


@query("q_decode_grid", f"{READ_SCORED}, {GRID}, cells as (select most, least, count(*) as n, round(sum(d)::double / nullif(sum(n), 0), 6) as micro from grid join scored on cer <= most and n >= least group by all) select most, least, n, micro, micro = min(micro) over () and n = max(n) filter (micro = (select min(micro) from cells)) over () as best from cells")
def q_decode_grid(s, d):
    """A grid of gates on error rate and length: what each keeps, and the one of least error (with most rows on a tie)."""
    grid = s.createDataFrame([(a, b) for a in (0.05, 0.1, 0.2, 1.0) for b in (2, 8, 20)], "most double, least int")
    rows = metrics.scored(read_pairs(s, d)).select("cer", "d", F.col("n").alias("chars"))
    cells = rows.join(F.broadcast(grid), (F.col("cer") <= F.col("most")) & (F.col("chars") >= F.col("least"))).groupBy("most", "least").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d") / F.nullif(F.sum("chars"), F.lit(0)), 6).alias("micro"))
    first = cells.agg(F.min(F.struct("micro", (-F.col("n")).alias("n"))).alias("top"))
    return cells.crossJoin(F.broadcast(first)).select("most", "least", "n", "micro", ((F.col("micro") == F.col("top.micro")) & (F.col("n") == -F.col("top.n"))).alias("best"))


@query("q_coverage_board", f"{READ_SCORED} select reader_id, wcov_micro, rank() over (order by wcov_micro desc)::int as rank from ({metrics.sql_report('reader_id')})")
def q_coverage_board(s, d):
    rows = metrics.scored(read_pairs(s, d)).groupBy("reader_id").agg(*metrics.line_report(keep=["wcov_micro"]))
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.desc("wcov_micro"))))


OURS = f"ours as (with {GOLD}, {metrics.sql_scored(PAIRS)} {metrics.sql_report()})"
NEAR = "near as (select arg_min(model, (abs(v - cer_median), place)) as rival, arg_min(v, (abs(v - cer_median), place)) as rival_v from board, ours)"
VERDICT = "case when cer_median < rival_v and cer_median_nodrop > rival_v then 'a tie until the blanks are recovered' when cer_median_nodrop < rival_v then 'ahead of ' || rival || ' on both readings' else 'behind ' || rival || ' on both readings' end"


@query("q_results_report", f"{READ_SCORED}, {BOARD}, {OURS}, {NEAR}, entries as (select model, v from board union all select 'second read', cer_median from ours) select '| model | CER median |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || model || ' | ' || format('{{:.3f}}', v) || ' |', chr(10) order by v, model) as board, (select {VERDICT} from ours, near) as verdict from entries")
def q_results_report(s, d):
    """A board as a table in Markdown, and what the nearest entry makes of our figures with and without blanks."""
    ours = metrics.scored(pairs(s, d)).agg(*metrics.line_report())
    nearest = combine.nearest_in(ours, "cer_median", b := settle(board(s, d), "board"), "model", "v", "place")
    rival = nearest.join(b.select(F.col("model").alias("nearest"), F.col("v").alias("rival_v")), "nearest")
    both = lambda w: F.concat(F.lit(w + " of "), "nearest", F.lit(" on both readings"))
    said = F.when((F.col("cer_median") < F.col("rival_v")) & (F.col("cer_median_nodrop") > F.col("rival_v")), "a tie until the blanks are recovered").when(F.col("cer_median_nodrop") < F.col("rival_v"), both("ahead")).otherwise(F.concat(F.lit("behind "), "nearest", F.lit(" on both readings")))
    entries = b.select("model", "v").unionByName(ours.select(F.lit("second read").alias("model"), F.col("cer_median").alias("v")))
    lines = entries.select(F.struct("v", "model").alias("o"), F.concat(F.lit("| "), "model", F.lit(" | "), F.format_string("%.3f", "v"), F.lit(" |")).alias("l"))
    table = sinks.joined_markdown(lines, "o", "l").select(F.concat(F.lit("| model | CER median |\n|---|---|\n"), "text").alias("board"))
    return table.crossJoin(F.broadcast(rival.select(said.alias("verdict"))))


@query("q_report_line", f"{SCORED} select printf('scored %d of %d, %d blank, median %.4f, micro %.4f, words %.4f', n_scored, n_total, n_blank, cer_median, cer_micro, wcov_micro) as line from ({metrics.sql_report()})")
def q_report_line(s, d):
    r = metrics.scored(pairs(s, d)).agg(*metrics.line_report())
    return r.select(F.format_string("scored %d of %d, %d blank, median %.4f, micro %.4f, words %.4f", "n_scored", "n_total", "n_blank", "cer_median", "cer_micro", "wcov_micro").alias("line"))


@query("q_confident_transcript", f"with {GOLD}, said as (select page_id, line_index, reads[len(reads)] as said, n from gold join (select line_id, max(n_votes) as n from gold_lines group by line_id) using (line_id)) select page_id, string_agg(said, chr(10) order by line_index, said) as transcript, count(*) as n_lines from said where trim(coalesce(said, '')) <> '' and n >= 2 group by page_id")
def q_confident_transcript(s, d):
    """Page transcripts of the lines that at least two votes stand behind."""
    votes = load(s, d, "gold_lines").groupBy("line_id").agg(F.max("n_votes").alias("n"))
    lines = gold(s, d).withColumn("said", F.get("reads", F.size("reads") - 1)).join(votes, "line_id")
    return geometry.transcript(lines, "page_id", "line_index", "said", F.col("n") >= 2)


@query("q_page_rank", f"with {PAGES} select page_id, v, (1 + (select count(*) from (values (0.02::double), (0.05::double), (0.1::double)) as b(x) where x < v))::int as rank from pages")
def q_page_rank(s, d):
    """Pages against a short published board."""
    published = s.createDataFrame([(0.02,), (0.05,), (0.1,)], "x double")
    return combine.rank_in(page_means(s, d), "v", published, "x").withColumn("rank", F.col("rank").cast("int"))


@query("q_best_rows", "with runs as (select event_type as arm, datediff('day', date '2024-01-01', ts::date)::int as epoch, round(avg(value), 4) as score from events group by all) select arm, min(score) as score, arg_min(epoch, (score, epoch)) as epoch from runs group by arm")
def q_best_rows(s, d):
    """The best epoch of each arm, the earliest of equals."""
    runs = load(s, d, "events").groupBy(F.col("event_type").alias("arm"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.round(F.avg("value"), 4).alias("score"))
    return runs.groupBy("arm").agg(F.min(F.struct("score", "epoch")).alias("b")).select("arm", "b.score", "b.epoch")


@query("q_epoch_means", "select event_type as arm, ts::date::varchar as day, round(avg(value), 6) as loss, round(count(*) / greatest(1e0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::double), 9) as per_second from events group by all")
def q_epoch_means(s, d):
    """The mean loss of each epoch and the steps a second."""
    us = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    seconds = (us(F.max) - us(F.min)) / 1e6
    return load(s, d, "events").groupBy(F.col("event_type").alias("arm"), F.col("ts").cast("date").cast("string").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"), F.round(F.count(F.lit(1)) / F.greatest(F.lit(1.0), seconds), 9).alias("per_second"))
