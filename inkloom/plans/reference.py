"""Queries of the transcription-scoring operators over the given tables, each with its equivalent in SQL where there is one.

Views: gold lines against the last of their reads (a second transcription), the reads of
each reader against the gold lines (readers are the systems of a sweep), embeddings as
CTC frames of four classes, line items as boxes on pages, events as views of lines and
as run logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import metrics, text
from inkloom.operators import batching, charset, combine, ctc, geometry, image, lm, runlog
from inkloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def load(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


# ---- views ------------------------------------------------------------------------------------------------------------


def gold(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "gold_lines").select("line_id", "page_id", "line_index", "text", "reads", "reader_ids", "chosen_read_index").distinct()


GOLD = "gold as (select distinct line_id, page_id, line_index, text, reads, reader_ids, chosen_read_index from gold_lines)"


def pairs(s: SparkSession, d: str) -> DataFrame:
    """``(line_id, page_id, ref, hyp)``: the stored text and the last read, in scoring form."""
    return gold(s, d).select("line_id", "page_id", text.normalize(F.col("text")).alias("ref"), text.normalize(F.get("reads", F.size("reads") - 1)).alias("hyp"))


PAIRS = f"select line_id, page_id, {text.sql_normalize('text')} as ref, {text.sql_normalize('reads[len(reads)]')} as hyp from gold"


def read_pairs(s: SparkSession, d: str) -> DataFrame:
    """``(line_id, reader_id, ref, hyp)``: every reader's standing read of a line against its stored text."""
    last = load(s, d, "line_reads").distinct().groupBy("line_id", "reader_id").agg(F.max_by(F.struct("read_text"), F.struct("submitted_at", "read_id")).alias("r"))
    refs = gold(s, d).select("line_id", "text")
    return last.join(refs, "line_id").select("line_id", "reader_id", text.normalize(F.col("text")).alias("ref"), text.normalize(F.col("r.read_text")).alias("hyp"))


LAST = "last as (select line_id, reader_id, read_text from (select distinct * from line_reads) qualify row_number() over (partition by line_id, reader_id order by submitted_at desc, read_id desc) = 1)"
READ_PAIRS = f"select line_id, reader_id, {text.sql_normalize('text')} as ref, {text.sql_normalize('read_text')} as hyp from last join gold using (line_id)"
SCORED = f"with {GOLD}, {metrics.sql_scored(PAIRS)}"
READ_SCORED = f"with {GOLD}, {LAST}, {metrics.sql_scored(READ_PAIRS)}"


# ---- scoring ----------------------------------------------------------------------------------------------------------


@query("q_line_report", f"{SCORED} {metrics.sql_report()}")
def q_line_report(s, d):
    return metrics.scored(pairs(s, d)).agg(*metrics.line_report())


@query("q_line_report_by_reader", f"{READ_SCORED} {metrics.sql_report('reader_id')}")
def q_line_report_by_reader(s, d):
    return metrics.scored(read_pairs(s, d)).groupBy("reader_id").agg(*metrics.line_report())


@query("q_line_report_by_experience", f"with {GOLD}, {LAST}, {metrics.sql_scored(READ_PAIRS.replace('reader_id,', 'experience,', 1) + ' join readers using (reader_id)')} {metrics.sql_report('experience')}")
def q_line_report_by_experience(s, d):
    people = load(s, d, "readers").select("reader_id", "experience")
    return metrics.scored(read_pairs(s, d)).join(people, "reader_id").groupBy("experience").agg(*metrics.line_report())


@query("q_cer_rows", f"{SCORED} select line_id, d, n, round(cer, 6) as cer, hit, words from scored")
def q_cer_rows(s, d):
    return metrics.scored(pairs(s, d)).select("line_id", "d", "n", F.round("cer", 6).alias("cer"), "hit", "words")


@query("q_exact_agreement", f"{SCORED} select count(*) as n, count(*) filter (cer = 0) as n_exact, round(avg(case when words > 0 then hit::double / words else 0e0 end), 6) as coverage from scored")
def q_exact_agreement(s, d):
    each = F.when(F.col("words") > 0, F.col("hit") / F.col("words")).otherwise(0.0)
    return metrics.scored(pairs(s, d)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cer") == 0).alias("n_exact"), F.round(F.avg(each), 6).alias("coverage"))


def others(s: SparkSession, d: str) -> DataFrame:
    """The first read that isn't the chosen one, of lines that have such."""
    rest = F.filter("reads", lambda r, i: i != F.coalesce(F.col("chosen_read_index"), F.lit(-1)))
    return gold(s, d).withColumn("rest", rest).where(F.size("rest") > 0).select("line_id", text.normalize(F.col("text")).alias("ref"), text.normalize(F.get("rest", F.lit(0))).alias("hyp"))


OTHERS = f"select line_id, {text.sql_normalize('text')} as ref, {text.sql_normalize('rest[1]')} as hyp from (select *, list_filter(reads, lambda r, i: i - 1 <> coalesce(chosen_read_index, -1)) as rest from gold) where len(rest) > 0"


@query("q_human_floor", f"with {GOLD}, {metrics.sql_scored(OTHERS)} {metrics.sql_report()}")
def q_human_floor(s, d):
    return metrics.scored(others(s, d)).agg(*metrics.line_report())


@query("q_quartiles", f"{SCORED} select page_id, round(quantile_cont(cer, 0.25::double), 6) as q1, round(median(cer), 6) as q2, round(quantile_cont(cer, 0.75::double), 6) as q3 from scored group by page_id")
def q_quartiles(s, d):
    q = F.percentile("cer", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return metrics.scored(pairs(s, d)).groupBy("page_id").agg(q.alias("q")).select("page_id", *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)))


def page_pairs(s: SparkSession, d: str) -> DataFrame:
    """Each page's text against the last reads of its lines, one under the other."""
    said = geometry.transcript(gold(s, d).withColumn("said", F.get("reads", F.size("reads") - 1)), "page_id", "line_index", "said")
    pages = load(s, d, "gold_pages").select("page_id", "page_text").distinct()
    return pages.join(said, "page_id", "left").select("page_id", text.normalize(F.col("page_text")).alias("ref"), text.normalize(F.col("transcript")).alias("hyp"))


TRANSCRIPTS = "said as (select page_id, string_agg(said, chr(10) order by line_index, said) as transcript, count(*) as n_lines from (select *, reads[len(reads)] as said from gold) where trim(coalesce(said, '')) <> '' group by page_id)"


@query("q_page_coverage", f"with {GOLD}, {TRANSCRIPTS}, raw as (select page_id, {text.sql_normalize('page_text')} as ref, {text.sql_normalize('transcript')} as hyp from (select distinct page_id, page_text from gold_pages) left join said using (page_id)), split as (select page_id, {text.sql_words('ref')} as rw, {text.sql_words('hyp')} as hw from raw) select page_id, len(rw)::bigint as words, {metrics.sql_shared('rw', 'hw')}::bigint as hit from split")
def q_page_coverage(s, d):
    words = lambda c: text.split_words(F.col(c))
    return page_pairs(s, d).select("page_id", F.size(words("ref")).cast("bigint").alias("words"), metrics.shared_words(words("ref"), words("hyp")).cast("bigint").alias("hit"))


SMALL = "translate({0}, array_to_string(cs, ''), array_to_string(list_transform(range(1, len(cs) + 1), lambda i: chr(i::int)), ''))"


# The built-in distance counts bytes, so each pair's characters (fewer than 128) are written as one byte each.
@query("q_page_report", f"with {GOLD}, {TRANSCRIPTS}, raw as (select page_id, {text.sql_normalize('page_text')} as ref, {text.sql_normalize('transcript')} as hyp from (select distinct page_id, page_text from gold_pages) left join said using (page_id)), chars as (select *, list_distinct(regexp_extract_all(ref || hyp, '(?s).')) as cs, {text.sql_words('ref')} as rw, {text.sql_words('hyp')} as hw from raw), scored as (select hyp, length(ref) as n, levenshtein({SMALL.format('ref')}, {SMALL.format('hyp')})::bigint as d, {metrics.sql_shared('rw', 'hw')}::bigint as hit, len(rw)::bigint as words, case when ref = '' then (case when hyp = '' then 0e0 else 1e0 end) else d::double / n end as cer from chars) select count(*) as n_pages, count(*) filter (hyp <> '') as n_scored, count(*) filter (hyp = '') as n_blank, round(sum(d) filter (hyp <> '')::double / nullif(sum(n) filter (hyp <> ''), 0), 6) as cer_micro, round(median(cer) filter (hyp <> ''), 6) as cer_median, round(avg(case when words > 0 then hit::double / words else 0e0 end) filter (hyp <> ''), 6) as wcov_macro, round(sum(hit) filter (hyp <> '')::double / nullif(sum(words) filter (hyp <> ''), 0), 6) as wcov_micro from scored")
def q_page_report(s, d):
    return metrics.scored(page_pairs(s, d)).agg(*metrics.page_report())


@query("q_page_transcript", f"with {GOLD}, {TRANSCRIPTS} select page_id, transcript, n_lines from said")
def q_page_transcript(s, d):
    return geometry.transcript(gold(s, d).withColumn("said", F.get("reads", F.size("reads") - 1)), "page_id", "line_index", "said")


# ---- text -------------------------------------------------------------------------------------------------------------


@query("q_normalize", f"select doc_id, {text.sql_normalize('text')} as norm from documents")
def q_normalize(s, d):
    return load(s, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query("q_normalize_composed", f"select doc_id, md5({text.sql_normalize('text', False)}) as h from documents")
def q_normalize_composed(s, d):
    return load(s, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text"), compose=False)).alias("h"))


@query("q_tokens", f"with {GOLD}, t as (select line_id, {text.sql_normalize('text')} as n from gold) select line_id, len({text.sql_words('n')})::bigint as n_tokens, array_to_string({text.sql_words('n')}, '|') as tokens from t")
def q_tokens(s, d):
    words = text.split_words(text.normalize(F.col("text")))
    return gold(s, d).select("line_id", words.alias("w")).select("line_id", F.size("w").cast("bigint").alias("n_tokens"), F.array_join("w", "|").alias("tokens"))


@query("q_blank_lines", f"with {GOLD} select line_id from gold where {text.sql_normalize('text')} = ''")
def q_blank_lines(s, d):
    return gold(s, d).where(text.is_blank(F.col("text"))).select("line_id")


@query("q_usable_lines", f"with {GOLD}, t as (select line_id, {text.sql_normalize('text')} as n from gold), c as (select *, len(regexp_extract_all(n, '[א-ת]')) as k from t) select line_id from c where length(n) >= 2 and k >= greatest(1, 0.5 * length(replace(n, ' ', '')))")
def q_usable_lines(s, d):
    return gold(s, d).select("line_id", text.normalize(F.col("text")).alias("n")).where(text.usable(F.col("n"))).select("line_id")


@query("q_clean_sentences", """with s as (select doc_id, trim(regexp_replace(regexp_replace(u, '[^\\x{590}-\\x{5ff}0-9 ''\\x{22}\\-,:()\\[\\]/]+', ' ', 'g'), ' +', ' ', 'g')) as sentence from (select doc_id, unnest(regexp_split_to_array(text, '[\\n.!?;]+')) as u from documents where text is not null))
 select doc_id, sentence, count(*) as n from s where length(sentence) >= 12 and len(regexp_extract_all(sentence, '[\\x{590}-\\x{5ff}]')) >= 0.5 * length(sentence) group by all""")
def q_clean_sentences(s, d):
    each = load(s, d, "documents").where("text is not null").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))
    return each.where(text.good_sentence(F.col("sentence"))).groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


BUDGET = 250_000


@query("q_char_budget", f"select doc_id, len, so_far from (select doc_id, length(text) as len, coalesce(sum(length(text)) over (order by doc_id, text rows between unbounded preceding and 1 preceding), 0)::bigint as so_far from documents where text is not null) where so_far < {BUDGET}")
def q_char_budget(s, d):
    return readers.corpus_lines(load(s, d, "documents").select("doc_id", "text"), "doc_id", "text", BUDGET).select("doc_id", "len", "so_far")


# ---- character sets ---------------------------------------------------------------------------------------------------

CHARS = f"chars as (select unnest(regexp_extract_all({text.sql_normalize('text')}, '(?s).')) as ch from gold)"
LEAST = 20
SET = f"built as (select 0::int as idx, '' as ch union all select row_number() over (order by ch)::int, ch from (select ch from chars group by ch having count(*) >= {LEAST}))"


def normal_gold(s: SparkSession, d: str) -> DataFrame:
    return gold(s, d).select("line_id", "page_id", "line_index", text.normalize(F.col("text")).alias("t"))


def built(s: SparkSession, d: str) -> DataFrame:
    return charset.build(normal_gold(s, d), "t", LEAST)


@query("q_charset_build", f"with {GOLD}, {CHARS}, {SET} select idx, ch from built")
def q_charset_build(s, d):
    return built(s, d)


@query("q_charset_extend", f"with {GOLD}, {CHARS}, {SET}, more as (select unnest(regexp_extract_all(text, '(?s).')) as ch from documents), new as (select ch from more where ch not in (select ch from built) group by ch having count(*) >= {LEAST}) select idx, ch from built union all select (row_number() over (order by ch) + (select max(idx) from built))::int, ch from new")
def q_charset_extend(s, d):
    return charset.extend(built(s, d), load(s, d, "documents"), "text", LEAST)


@query("q_charset_intersect", f"with {GOLD}, {CHARS}, {SET}, more as (select distinct unnest(regexp_extract_all(text, '(?s).')) as ch from documents where lang = 'en') select ch from built intersect select ch from more")
def q_charset_intersect(s, d):
    english = charset.build(load(s, d, "documents").where("lang = 'en'"), "text").where("idx > 0")
    return charset.intersect(built(s, d), english)


ENCODED = f"with {GOLD}, {CHARS}, {SET}, each as (select line_id, t, unnest(regexp_extract_all(t, '(?s).')) as ch, generate_subscripts(regexp_extract_all(t, '(?s).'), 1) as i from (select line_id, {text.sql_normalize('text')} as t from gold)), coded as (select line_id, string_agg(idx::varchar, ',' order by i) as codes, string_agg(ch, '' order by i) as decoded, count(*) as k from each join built using (ch) group by line_id)"


@query("q_charset_encode", f"{ENCODED} select g.line_id, coalesce(codes, '') as codes, coalesce(decoded, '') as decoded, round(case when length({text.sql_normalize('g.text')}) = 0 then 1e0 else coalesce(k, 0)::double / length({text.sql_normalize('g.text')}) end, 6) as known_part from gold g left join coded using (line_id)")
def q_charset_encode(s, d):
    codec = charset.Codec(built(s, d))
    coded = normal_gold(s, d).withColumn("codes", codec.encode(F.col("t")))
    codes = F.col("codes")
    return coded.select("line_id", F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"), codec.decode(codes).alias("decoded"), F.round(codec.known_part(F.col("t"), codes), 6).alias("known_part"))


# ---- language models --------------------------------------------------------------------------------------------------

ORDER = 3
GRAMS = f"lines as (select line_id, {text.sql_normalize('text')} as t from gold), padded as (select chr(2) || t as t from lines where t <> ''), grams as (select n::int as n, substr(t, i, n) as gram, count(*) as cnt from padded, range(1, {ORDER + 1}) as o(n), range(1, length(t) - n + 2) as p(i) group by all)"


def grams(s: SparkSession, d: str) -> DataFrame:
    return lm.char_ngrams(normal_gold(s, d), "t", ORDER)


@query("q_char_ngrams", f"with {GOLD}, {GRAMS} select n, gram, cnt from grams")
def q_char_ngrams(s, d):
    return grams(s, d)


@query("q_char_ngram_prune", f"with {GOLD}, {GRAMS} select n, gram, cnt from grams where n < 3 or cnt >= 2")
def q_char_ngram_prune(s, d):
    return lm.prune_ngrams(grams(s, d), 2)


@query("q_lm_stats", f"with {GOLD}, {GRAMS} select n, count(*) as n_grams, sum(cnt)::bigint as total from grams group by n")
def q_lm_stats(s, d):
    return lm.ngram_stats(grams(s, d))


@query(
    "q_char_lm_score",
    f"""with {GOLD}, {GRAMS}, total as (select sum(length(t))::bigint as total from lines), hyps as (select line_id, hyp from ({PAIRS}) where hyp <> ''),
 ends as (select line_id, hyp, e, least({ORDER}, e) as longest from hyps, range(1, length(hyp) + 1) as r(e)),
 asked as (select *, substr(hyp, e - n + 1, n) as gram, substr(hyp, e - n + 1, n - 1) as context from ends, range(1, longest + 1) as o(n)),
 hit as (select a.line_id, e, longest, a.n, ln(g.cnt::double / (case when a.n = 1 then total else c.cnt end)) + (longest - a.n) * ln(0.4e0) as s from asked a join total on true left join grams g on g.n = a.n and g.gram = a.gram left join grams c on c.n = a.n - 1 and c.gram = a.context),
 best as (select line_id, e, coalesce(arg_max(s, n) filter (s is not null), any_value(longest) * ln(0.4e0) - ln(any_value(total)::double)) as lp from hit join total on true group by line_id, e)
 select line_id, count(*) as n_chars, round(sum(lp), 4) as logprob from best group by line_id""",
)
def q_char_lm_score(s, d):
    hyps = pairs(s, d).where("hyp <> ''").select("line_id", "hyp")
    return lm.char_logprobs(hyps, "line_id", "hyp", grams(s, d), ORDER).withColumn("logprob", F.round("logprob", 4))


WORDS = f"words as (select word, count(*) as cnt from (select unnest(regexp_extract_all({text.sql_normalize('text')}, '[א-ת'']+')) as word from gold) group by word)"


@query("q_word_counts", f"with {GOLD}, {WORDS} select word, cnt from words")
def q_word_counts(s, d):
    return lm.word_counts(normal_gold(s, d), "t")


@query(
    "q_word_logprob",
    f"""with {GOLD}, {WORDS}, kept as (select * from words where cnt >= 2), total as (select sum(cnt)::bigint as total from words),
 asked as (select distinct unnest(regexp_extract_all({text.sql_normalize('reads[len(reads)]')}, '[א-ת'']+')) as word from gold),
 found as (select a.word, k.cnt, p.cnt as scnt, total from asked a join total on true left join kept k using (word) left join kept p on p.word = substr(a.word, 2) and length(a.word) > 2 and contains('{lm.PREFIX_LETTERS}', substr(a.word, 1, 1))),
 lp as (select *, coalesce(ln(cnt::double / total), ln(scnt::double / total) - 2.5e0, -14e0) as lp from found)
 select word, coalesce(cnt, 0) as cnt, (cnt is not null or scnt is not null) as known, round(lp, 6) as logprob, round(greatest(lp + 14e0, 0e0), 6) as bonus from lp""",
)
def q_word_logprob(s, d):
    words = lm.word_counts(normal_gold(s, d), "t")
    asked = lm.word_counts(pairs(s, d), "hyp").select("word")
    out = lm.word_logprobs(asked, lm.prune_words(words, 2), words.agg(F.sum("cnt").alias("total")))
    return out.select("word", "cnt", "known", F.round("logprob", 6).alias("logprob"), F.round("bonus", 6).alias("bonus"))


# ---- decoding ---------------------------------------------------------------------------------------------------------

SYMBOLS = ["", "a", "b", "c"]


def frames(s: SparkSession, d: str) -> DataFrame:
    """``(vec_id, frames)``: 64 numbers as 16 frames of 4 classes."""
    e = F.col("embedding")
    return load(s, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice(e, t * 4 + 1, 4), lambda x: x.cast("double"))).alias("frames"))


LONG = "long as (select vec_id, t, c, embedding[t * 4 + c + 1]::double as x from embeddings, range(16) as f(t), range(4) as k(c)), soft as (select vec_id, t, c, x - max(x) over w - ln(sum(exp(x - mx)) over w) as lp from (select *, max(x) over (partition by vec_id, t) as mx from long) window w as (partition by vec_id, t)), best as (select vec_id, t, arg_max(c, (lp, -c)) as c, max(lp) as lp from soft group by vec_id, t)"


def soft(s: SparkSession, d: str) -> DataFrame:
    return frames(s, d).withColumn("frames", F.transform("frames", ctc.log_softmax))


@query("q_ctc_greedy", f"with {LONG}, path as (select *, lag(c) over (partition by vec_id order by t) as prev from best) select e.vec_id, coalesce(string_agg(chr((96 + c)::int), '' order by t) filter (c <> 0 and c is distinct from prev), '') as decoded from embeddings e join path using (vec_id) group by e.vec_id")
def q_ctc_greedy(s, d):
    return frames(s, d).select("vec_id", ctc.greedy(F.col("frames"), SYMBOLS).alias("decoded"))


@query("q_ctc_confidence", f"with {LONG} select vec_id, round(avg(exp(lp)), 6) as all_frames, round(coalesce(avg(exp(lp)) filter (c <> 0), 0e0), 6) as emitting from best group by vec_id")
def q_ctc_confidence(s, d):
    return soft(s, d).select("vec_id", F.round(ctc.confidence(F.col("frames")), 6).alias("all_frames"), F.round(ctc.confidence(F.col("frames"), True), 6).alias("emitting"))


@query("q_log_softmax", f"with {LONG} select vec_id, t::int as t, c::int as c, round(lp, 6) as lp from soft")
def q_log_softmax(s, d):
    return soft(s, d).select("vec_id", F.posexplode("frames").alias("t", "f")).select("vec_id", "t", F.posexplode("f").alias("c", "lp")).withColumn("lp", F.round("lp", 6))


@query("q_frame_average", f"with {LONG} select a.vec_id, a.t::int as t, a.c::int as c, round(ln(greatest(0.7e0 * exp(a.lp) + 0.3e0 * exp(b.lp), 1e-9)), 6) as lp from soft a join soft b on b.vec_id = a.vec_id + 1 and b.t = a.t and b.c = a.c")
def q_frame_average(s, d):
    a = soft(s, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("frames").alias("next"))
    mixed = a.join(b, "vec_id").select("vec_id", F.zip_with("frames", "next", lambda x, y: ctc.average(x, y, 0.7)).alias("frames"))
    return mixed.select("vec_id", F.posexplode("frames").alias("t", "f")).select("vec_id", "t", F.posexplode("f").alias("c", "lp")).withColumn("lp", F.round("lp", 6))


@query("q_ctc_topk", f"with {LONG}, ranked as (select *, row_number() over (partition by vec_id, t order by x desc, c) as r from long) select vec_id, t::int as t, string_agg(c::varchar, ',' order by r) as top from ranked where r <= 2 group by vec_id, t")
def q_ctc_topk(s, d):
    each = frames(s, d).select("vec_id", F.posexplode("frames").alias("t", "f"))
    return each.select("vec_id", "t", F.array_join(F.transform(ctc.top_classes(F.col("f"), 2), lambda c: c.cast("string")), ",").alias("top"))


ADD = "greatest({0}, {1}) + ln(1 + exp(least({0}, {1}) - greatest({0}, {1})))"


# Prefixes of the beam grow frame by frame; -1e300 stands for the logarithm of nothing.
@query("q_ctc_beam", f"""with recursive {LONG}, beam as (select vec_id, 0 as t, '' as prefix, 0e0 as pb, -1e300 as pc from embeddings union all
 select vec_id, t, prefix, pb, pc from (select vec_id, t, prefix, pb, pc, row_number() over (partition by vec_id order by {ADD.format('pb', 'pc')} desc) as r from (
  select vec_id, t, prefix, max(b) + ln(sum(exp(b - mb))) as pb, max(c) + ln(sum(exp(c - mc))) as pc from (select *, max(b) over (partition by vec_id, prefix) as mb, max(c) over (partition by vec_id, prefix) as mc from (
   select b.vec_id, b.t + 1 as t, unnest(case when s.c = 0 then [struct_pack(prefix := prefix, b := {ADD.format('pb', 'pc')} + lp, c := -1e300)] when right(prefix, 1) = chr((96 + s.c)::int) then [struct_pack(prefix := prefix, b := -1e300, c := greatest(pc + lp, -1e300)), struct_pack(prefix := prefix || chr((96 + s.c)::int), b := -1e300, c := greatest(pb + lp, -1e300))] else [struct_pack(prefix := prefix || chr((96 + s.c)::int), b := -1e300, c := {ADD.format('pb', 'pc')} + lp)] end, recursive := true)
   from beam b join soft s on s.vec_id = b.vec_id and s.t = b.t)) group by vec_id, t, prefix)) where r <= 12)
 select vec_id, arg_max(prefix, {ADD.format('pb', 'pc')}) as decoded from beam where t = 16 group by vec_id""")
def q_ctc_beam(s, d):
    return ctc.beam(soft(s, d), "vec_id", "frames", SYMBOLS, 12, 4)


# ---- combining --------------------------------------------------------------------------------------------------------


# Every other read is aligned to the first by a table of distances, walked back from its end: keep or replace, else delete, else insert.
VOTED = f"""{GOLD}, hy as (select row_number() over () as rid, line_id, list_transform(coalesce(reads, []), lambda x: {text.sql_normalize('x')}) as ts from gold),
 each as (select rid, k, ts[1] as p, ts[k] as o from (select rid, ts, unnest(range(1, len(ts) + 1)) as k from hy)),
 mats as (select p, o, px, ox, list_reduce(px, lambda acc, ca: list_append(acc, list_reduce(range(1, len(ox) + 1), lambda r, j: list_append(r, least(acc[-1][j + 1] + 1, r[j] + 1, acc[-1][j] + (case when ox[j] = ca then 0 else 1 end))), [acc[-1][1] + 1])), [range(0, len(ox) + 1)]) as cost from (select p, o, regexp_extract_all(p, '(?s).') as px, regexp_extract_all(o, '(?s).') as ox from (select distinct p, o from each where p <> o))),
 walk as (select p, o, len(px) as i, len(ox) as j, 0 as op, 0 as place, '' as ch from mats union all select p, o, i - (op < 3)::int, j - (op <> 2)::int, op, i, case when op = 2 then '' else ox[j] end from (select w.p, w.o, w.i, w.j, px, ox, case when w.i > 0 and w.j > 0 and cost[w.i + 1][w.j + 1] = cost[w.i][w.j] + (case when px[w.i] = ox[w.j] then 0 else 1 end) then 1 when w.i > 0 and cost[w.i + 1][w.j + 1] = cost[w.i][w.j + 1] + 1 then 2 else 3 end as op from walk w join mats m on m.p = w.p and m.o = w.o where w.i > 0 or w.j > 0)),
 at_ as (select p, o, place as i, ch from walk where op in (1, 2) union all select distinct p, p, unnest(range(1, len(regexp_extract_all(p, '(?s).')) + 1)), unnest(regexp_extract_all(p, '(?s).')) from each),
 ins as (select p, o, place as i, string_agg(ch, '' order by j) as said from walk where op = 3 group by all),
 chosen as (select rid, i, ch from (select rid, i, ch, count(*) as n, min(k) as k from each join at_ using (p, o) group by all) qualify row_number() over (partition by rid, i order by n desc, k) = 1),
 added as (select rid, i, said from each join ins using (p, o) join (select rid, len(ts) as m from hy) using (rid) group by rid, i, said, m having count(*) * 2 > m),
 parts as (select rid, i * 2 as o, ch from chosen union all select rid, i * 2 + 1, said from added)"""


@query("q_rover", f"with recursive {VOTED} select line_id, coalesce(any_value(v), '') as voted from hy left join (select rid, string_agg(ch, '' order by o) as v from parts group by rid) using (rid) group by rid, line_id")
def q_rover(s, d):
    return gold(s, d).select("line_id", combine.voted(text.normalize_each(F.col("reads"))).alias("voted"))


@query("q_tta_select", "with v as (select user_id as line_id, event_id % 5 as scale, round(max(value), 4) as score, max(event_type) as said from events group by all), r as (select *, row_number() over (partition by line_id order by score desc, scale) as k from v) select line_id, said as text, scale::bigint as view from r where k = 1")
def q_tta_select(s, d):
    views = load(s, d, "events").groupBy(F.col("user_id").alias("line_id"), (F.col("event_id") % 5).alias("scale")).agg(F.round(F.max("value"), 4).alias("score"), F.max("event_type").alias("said"))
    return combine.choose_view(views, ["line_id"], "score", "scale", "said")


BOARD = f"board as (select reader_id as model, row_number() over (order by reader_id)::int as place, cer_median as v from ({metrics.sql_report('reader_id')}))"
PAGES = f"pages as (select page_id, round(avg(cer), 6) as v from (with {GOLD}, {metrics.sql_scored(PAIRS)} select page_id, cer from scored) group by page_id)"


def board(s: SparkSession, d: str) -> DataFrame:
    """The readers' medians as a board: one row a reader."""
    r = q_line_report_by_reader(s, d).select(F.col("reader_id").alias("model"), F.col("cer_median").alias("v"))
    return r.withColumn("place", F.row_number().over(Window.orderBy("model")).cast("int"))


def page_means(s: SparkSession, d: str) -> DataFrame:
    return metrics.scored(pairs(s, d)).groupBy("page_id").agg(F.round(F.avg("cer"), 6).alias("v"))


@query("q_rank_in_board", f"{READ_SCORED}, {BOARD}, {PAGES} select page_id, p.v, (1 + (select count(*) from board b where b.v < p.v))::int as rank from pages p")
def q_rank_in_board(s, d):
    return combine.rank_in(page_means(s, d), "v", board(s, d), "v").withColumn("rank", F.col("rank").cast("int"))


@query("q_nearest_in_board", f"{READ_SCORED}, {BOARD}, {PAGES} select page_id, p.v, arg_min(model, (abs(b.v - p.v), place)) as nearest from pages p join board b on true group by page_id, p.v")
def q_nearest_in_board(s, d):
    return combine.nearest_in(page_means(s, d), "v", board(s, d), "model", "v", "place")


@query("q_leaderboard", f"{READ_SCORED}, {BOARD}, ours as (select 'second read' as model, round(median(cer), 6) as v from (with {GOLD}, {metrics.sql_scored(PAIRS)} select cer from scored)) select model, v, rank() over (order by v)::int as rank from (select model, v from board union all select model, v from ours)")
def q_leaderboard(s, d):
    ours = metrics.scored(pairs(s, d)).agg(F.lit("second read").alias("model"), F.round(F.median("cer"), 6).alias("v"))
    rows = board(s, d).select("model", "v").unionByName(ours)
    return rows.withColumn("rank", F.rank().over(Window.orderBy("v")))


# ---- sources, joins, samples ------------------------------------------------------------------------------------------


@query("q_split_semi_join", "select distinct x.xml_id from page_xml x where regexp_extract(page_file, '([^/]*)$', 1) in (select regexp_extract(page_file, '([^/]*)$', 1) from page_xml where split_name = 'test')")
def q_split_semi_join(s, d):
    pages = load(s, d, "page_xml").select("xml_id", "split_name", readers.base_name(F.col("page_file")).alias("name"))
    listed = pages.where("split_name = 'test'").select("name").distinct()
    return pages.join(listed, "name", "left_semi").select("xml_id").distinct()


@query("q_stem_join", "with p as (select distinct xml_id, regexp_replace(regexp_extract(page_file, '([^/]*)$', 1), '\\.[^.]*$', '') as stem, regexp_replace(regexp_extract(regexp_extract(body, 'imageFilename\\s*=\\s*[\x22'']([^\x22'']*)', 1), '([^/]*)$', 1), '\\.[^.]*$', '') as image from page_xml where body is not null) select a.stem, a.xml_id, b.n_images from p a join (select image as stem, count(*) as n_images from p where image <> '' group by image) b using (stem)")
def q_stem_join(s, d):
    """Exports against the images that exports name, by stem; the images are counted first, so that a stem that comes often makes no pairs."""
    named = F.regexp_extract("body", r"imageFilename\s*=\s*[\"']([^\"']*)", 1)
    p = load(s, d, "page_xml").where("body is not null").select("xml_id", readers.stem(F.col("page_file")).alias("stem"), readers.stem(named).alias("image")).distinct()
    images = p.where("image <> ''").groupBy(F.col("image").alias("stem")).agg(F.count(F.lit(1)).alias("n_images"))
    return p.drop("image").join(images, "stem")


@query("q_system_zip", f"with {GOLD} select line_id, (i - 1)::int as place, reader_ids[i] as reader_id, reads[i] as read from (select *, generate_subscripts(reads, 1) as i from gold)")
def q_system_zip(s, d):
    return gold(s, d).select("line_id", F.posexplode(F.arrays_zip("reader_ids", "reads")).alias("place", "z")).select("line_id", "place", F.col("z.reader_ids").alias("reader_id"), F.col("z.reads").alias("read"))


@query("q_quality_gate", f"{READ_SCORED} select line_id, reader_id, round(cer, 6) as cer from scored where cer <= 0.1e0")
def q_quality_gate(s, d):
    return metrics.scored(read_pairs(s, d)).where("cer <= 0.1").select("line_id", "reader_id", F.round("cer", 6).alias("cer"))


@query("q_source_cap_sample", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5('5:' || doc_id), doc_id) as r from documents where source is not null) where r <= case when source = 'letters' then 40 else 15 end")
def q_source_cap_sample(s, d):
    docs = load(s, d, "documents").where("source is not null").select("source", "doc_id")
    return readers.capped(docs, "source", "doc_id", {"letters": 40}, 15, seed=5).select("source", "doc_id")


@query("q_seeded_sample", "select doc_id from documents order by md5('3:' || doc_id), doc_id limit 100")
def q_seeded_sample(s, d):
    return readers.sample(load(s, d, "documents").select("doc_id"), "doc_id", 100, seed=3)


@query("q_bootstrap_widths", f"with rows as (select doc_id, n_chars as width, row_number() over (order by {readers.SQL_NUMBER.format(0, 'doc_id')} % 256, md5('1:' || doc_id), doc_id) - 1 as no from documents), draws as (select i as draw, {readers.SQL_NUMBER.format(1, 'i')} % (select count(*) from documents) as no from range(10000) as r(i)) select draw, doc_id, width from draws join rows using (no)")
def q_bootstrap_widths(s, d):
    widths = load(s, d, "documents").select("doc_id", F.col("n_chars").alias("width"))
    return readers.resample(widths, "doc_id", 10_000, seed=1).select("draw", "doc_id", "width")


@query("q_epoch_order", "select l.line_id, row_number() over (partition by page_id order by md5('2:' || line_id), line_id)::int as place from (select distinct line_id, page_id from gold_lines) l")
def q_epoch_order(s, d):
    lines = load(s, d, "gold_lines").select("line_id", "page_id").distinct()
    return lines.select("line_id", F.row_number().over(Window.partitionBy("page_id").orderBy(readers.seeded(2, F.col("line_id")), "line_id")).alias("place"))


@query("q_union_sources", "select 'gold' as source_name, 0 as source_no, line_id as k, length(text) as n from gold_lines union all select 'reads', 1, read_id::varchar, length(read_text) from line_reads union all select 'documents', 2, doc_id::varchar, length(text) from documents")
def q_union_sources(s, d):
    n = lambda t, k, c: load(s, d, t).select(F.col(k).cast("string").alias("k"), F.length(c).cast("bigint").alias("n"))
    return readers.union({"gold": n("gold_lines", "line_id", "text"), "reads": n("line_reads", "read_id", "read_text"), "documents": n("documents", "doc_id", "text")}, ["k", "n"])


@query("q_dedup_first", "select min(doc_id) as doc_id, count(*) as n from documents where text is not null group by text")
def q_dedup_first(s, d):
    # grouped by a digest, so that long texts aren't shuffled
    docs = load(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@query("q_unknown_sources", "select distinct source from documents where source is not null except select source from source_targets")
def q_unknown_sources(s, d):
    return load(s, d, "documents").where("source is not null").select("source").distinct().join(load(s, d, "source_targets"), "source", "left_anti")


@query("q_image_sizes", "select line_id, case when png then ('0x' || substr(x, 33, 8))::int end as width, case when png then ('0x' || substr(x, 41, 8))::int end as height from (select line_id, x, x[1:16] = '89504E470D0A1A0A' and length(x) >= 48 as png from (select line_id, hex(image) as x from gold_lines where image is not null))")
def q_image_sizes(s, d):
    return readers.image_sizes(load(s, d, "gold_lines").where("image is not null").select("line_id", "image"), "line_id", "image")


@query("q_image_measures")
def q_image_measures(s, d):
    return image.measures(load(s, d, "gold_pages").select("page_id", "image"), "page_id", "image")


# ---- geometry ---------------------------------------------------------------------------------------------------------


def boxes(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return load(s, d, "lineitem").select(F.floor(c("l_orderkey") / 50).alias("page"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("box_id"), (c("l_partkey") % 1500).cast("int").alias("x"), ((c("l_suppkey") * 13) % 2000).cast("int").alias("y"), (20 + c("l_quantity") * 8).cast("int").alias("w"), (30 + c("l_linenumber") * 6).cast("int").alias("h"))


BOXES = "boxes as (select l_orderkey // 50 as page, l_orderkey * 10 + l_linenumber as box_id, (l_partkey % 1500)::int as x, ((l_suppkey * 13) % 2000)::int as y, (20 + l_quantity * 8)::int as w, (30 + l_linenumber * 6)::int as h from lineitem)"


@query("q_box_recall", f"with {BOXES}, best as (select g.page, g.box_id, max(case when d.box_id is null then 0e0 else greatest(0, least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x)) * greatest(0, least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y)) / (g.w * g.h)::double end) as part from boxes g left join (select * from boxes where box_id % 3 <> 0) d on d.page = g.page where g.box_id % 3 = 0 group by all) select page, count(*) as n_gold, count(*) filter (part >= 0.5) as n_hit from best group by rollup (page)")
def q_box_recall(s, d):
    b = boxes(s, d)
    return geometry.recall(b.where("box_id % 3 = 0"), b.where("box_id % 3 <> 0"), "page", "box_id")


@query("q_box_corners", "select distinct page_id, (i - 1)::int as box_no, b.x as x0, b.y as y0, b.x + b.w as x1, b.y + b.h as y1 from (select page_id, generate_subscripts(lines, 1) as i, unnest(lines).bbox as b from gold_pages)")
def q_box_corners(s, d):
    each = load(s, d, "gold_pages").select("page_id", F.posexplode("lines").alias("box_no", "l")).select("page_id", "box_no", geometry.corners(F.col("l.bbox")).alias("c"))
    return each.select("page_id", "box_no", "c.*").distinct()


@query("q_box_filter", f"with {BOXES} select page, box_id from boxes where w >= 0.8 * 60 and h >= 0.25 * 60 and h <= 12 * 60 and w * h >= 0.12 * 3600")
def q_box_filter(s, d):
    return boxes(s, d).where(geometry.plausible(F.lit(60.0))).select("page", "box_id")


MEETS = "list_position(list_transform(acc, lambda o: least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y) > 0.5 * least(b.h, o.h) and greatest(b.x, o.x) - least(b.x + b.w, o.x + o.w) < 72), true)"
JOINED = "struct_pack(x := least(b.x, acc[{0}].x), y := least(b.y, acc[{0}].y), w := greatest(b.x + b.w, acc[{0}].x + acc[{0}].w) - least(b.x, acc[{0}].x), h := greatest(b.y + b.h, acc[{0}].y + acc[{0}].h) - least(b.y, acc[{0}].y))".format(MEETS)


@query("q_box_merge", f"with {BOXES}, sorted as (select page, list(struct_pack(x := x, y := y, w := w, h := h) order by y, x, w, h) as bs from boxes group by page), joined as (select page, list_reduce(bs[2:], lambda acc, b: case when coalesce({MEETS}, 0) = 0 then list_append(acc, b) else acc[1:{MEETS} - 1] || [{JOINED}] || acc[{MEETS} + 1:] end, bs[1:1]) as js from sorted) select page, (i - 1)::int as box_no, j.x, j.y, j.w, j.h from (select page, unnest(js) as j, generate_subscripts(js, 1) as i from joined)")
def q_box_merge(s, d):
    return geometry.merged(boxes(s, d), "page", 60.0)


@query("q_reading_order", f"with {BOXES}, sorted as (select page, list(struct_pack(x := x, y := y, w := w, h := h) order by y + h / 2e0, x, y, w, h) as bs from boxes group by page), ordered as (select page, list_reduce(bs, lambda a, b: case when a.n > 0 and abs(b.y + b.h / 2e0 - a.total / a.n) < 27e0 then struct_pack(r := a.r, n := a.n + 1, total := a.total + b.y + b.h / 2e0, rows := list_append(a.rows, a.r)) else struct_pack(r := a.r + 1, n := 1::bigint, total := b.y + b.h / 2e0, rows := list_append(a.rows, a.r + 1)) end, struct_pack(r := -1::bigint, n := 0::bigint, total := 0e0, rows := []::bigint[])).rows as rs, bs from sorted), each as (select page, unnest(rs) as row_no, unnest(bs) as b, generate_subscripts(bs, 1) as i from ordered) select page, (row_number() over (partition by page order by row_no, -(b.x + b.w), i) - 1)::int as place, row_no::int as row_no, b.x, b.y, b.w, b.h from each")
def q_reading_order(s, d):
    return geometry.reading_order(boxes(s, d), "page", 60.0)


@query("q_box_rescale", f"with {BOXES} select box_id, trunc(x * 1.37e0)::int as x, trunc(y * 1.37e0)::int as y from boxes")
def q_box_rescale(s, d):
    return boxes(s, d).select("box_id", geometry.rescaled("x", 1.37).alias("x"), geometry.rescaled("y", 1.37).alias("y"))


# ---- batches ----------------------------------------------------------------------------------------------------------


@query("q_budget_batches", f"with recursive pools as (select doc_id, n_chars, {readers.SQL_NUMBER.format(0, 'doc_id')} % greatest(1, (select (count(n_chars) + 4095) // 4096 from documents)) as pool_no from documents where n_chars is not null), r as (select *, row_number() over (partition by pool_no order by n_chars, doc_id) as i from pools), f as (select *, 0 as batch_no, 1 as n from r where i = 1 union all select r.doc_id, r.n_chars, r.pool_no, r.i, case when (n + 1) * r.n_chars > 20000 or n >= 64 then batch_no + 1 else batch_no end, case when (n + 1) * r.n_chars > 20000 or n >= 64 then 1 else n + 1 end from f join r on r.pool_no = f.pool_no and r.i = f.i + 1) select doc_id, n_chars, pool_no::int as pool_no, batch_no from f")
def q_budget_batches(s, d):
    return batching.budget_batches(load(s, d, "documents"), "doc_id", "n_chars", 20_000)


@query("q_width_stats", "select round(avg(n_chars), 6) as mean, round(quantile_cont(n_chars, 0.95::double), 6) as p95, max(n_chars) as widest from documents")
def q_width_stats(s, d):
    n = F.col("n_chars")
    return load(s, d, "documents").agg(F.round(F.avg(n), 6).alias("mean"), F.round(F.percentile(n, F.lit(0.95)), 6).alias("p95"), F.max(n).alias("widest"))


@query("q_scaled_width", f"with {BOXES} select box_id, least(greatest(round_even(w * 64 / greatest(h, 1)::double, 0), 16), 2560)::int as scaled from boxes")
def q_scaled_width(s, d):
    return boxes(s, d).select("box_id", batching.scaled_width(F.col("w"), F.col("h")).alias("scaled"))


@query("q_alignable", "select batch_id, count(*) as n, count(*) filter (greatest(1, w // 4) >= t) as n_alignable from (select batch_id, unnest(widths) as w, unnest(target_lengths) as t from (select distinct batch_id, widths, target_lengths from train_batches)) group by batch_id")
def q_alignable(s, d):
    each = load(s, d, "train_batches").select("batch_id", "widths", "target_lengths").distinct().select("batch_id", F.explode(F.arrays_zip("widths", "target_lengths")).alias("z"))
    return each.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(batching.steps(F.col("z.widths")) >= F.col("z.target_lengths")).alias("n_alignable"))


@query("q_joined_lines", f"with recursive {GOLD}, l as (select page_id, list({text.sql_normalize('text')} order by line_index nulls first, {text.sql_normalize('text')}) as ts from gold group by page_id), r as (select page_id, ts, 1 as i, 0 as row_no, 12 * length(ts[1]) as total from l union all select page_id, ts, i + 1, case when total + 24 + 12 * length(ts[i + 1]) <= 1792 then row_no else row_no + 1 end, case when total + 24 + 12 * length(ts[i + 1]) <= 1792 then total + 24 else 0 end + 12 * length(ts[i + 1]) from r where i < len(ts)) select page_id, row_no, string_agg(ts[i], ' ' order by i) as text, max(total)::bigint as width, count(*) as n_lines from r group by page_id, row_no")
def q_joined_lines(s, d):
    lines = normal_gold(s, d).withColumn("w", F.length("t") * 12)
    return batching.joined_rows(lines, "page_id", "line_index", "t", "w")


@query("q_estimated_batches", "select greatest(1, count(*) // greatest(1, least(64, floor(20000 / greatest(avg(n_chars), 1e0))::bigint)))::bigint as n_batches, round(avg(n_chars), 6) as mean_width from documents where n_chars is not null")
def q_estimated_batches(s, d):
    return batching.estimated_batches(load(s, d, "documents").where("n_chars is not null"), "n_chars", 20_000)


# Characters are numbered over the texts themselves, so that none is unknown and dropped.
@query("q_collate", f"with b as (select row_number() over () as no, * from (select distinct batch_id, texts from train_batches)), each as (select no, batch_id, i, {text.sql_normalize('t')} as t from (select no, batch_id, generate_subscripts(texts, 1) as i, unnest(texts) as t from b)), chars as (select coalesce(list(ch order by ch), []) as chs from (select distinct unnest(regexp_extract_all(t, '(?s).')) as ch from each)), coded as (select no, batch_id, i, list_transform(regexp_extract_all(t, '(?s).'), lambda c: list_position(chs, c)::int) as codes from each, chars) select batch_id, i::int as place, list_resize(codes, max(len(codes)) over (partition by no), 0)::varchar as padded from coded")
def q_collate(s, d):
    texts = load(s, d, "train_batches").select("batch_id", "texts").distinct().select("batch_id", text.normalize_each(F.col("texts")).alias("ts"))
    codec = charset.Codec(charset.build(texts.select(F.explode("ts").alias("t")), "t"))
    # every character has a number, so a text has as many as characters
    widest = F.array_max(F.transform("ts", F.length))
    each = texts.select("batch_id", widest.alias("widest"), F.posexplode("ts").alias("i", "t"))
    codes = F.array_join(F.transform(codec.encode(F.col("t")), lambda x: x.cast("string")), ", ")
    zeros = F.repeat(F.lit(", 0"), F.col("widest") - F.length("t"))
    # a text without characters begins with a zero, not with a comma
    inner = F.when(F.length("t") > 0, F.concat(codes, zeros)).otherwise(F.substr(zeros, F.lit(3)))
    return each.select("batch_id", (F.col("i") + 1).alias("place"), F.concat(F.lit("["), inner, F.lit("]")).alias("padded"))


# ---- run logs ---------------------------------------------------------------------------------------------------------

RUNS = "runs as (select event_type as arm, datediff('day', date '2024-01-01', ts::date)::int as epoch, round(avg(value), 4) as score, count(*) as cost from events group by all)"


def runs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").groupBy(F.col("event_type").alias("arm"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("epoch")).agg(F.round(F.avg("value"), 4).alias("score"), F.count(F.lit(1)).alias("cost"))


@query("q_cumulative_hours", f"with {RUNS} select arm, epoch, sum(cost) over (partition by arm order by epoch)::bigint as total from runs")
def q_cumulative_hours(s, d):
    return runlog.running(runs(s, d), "arm", "epoch", "cost", "total").select("arm", "epoch", "total")


@query("q_best_so_far", f"with {RUNS} select arm, epoch, score from (select *, min(score) over (partition by arm order by epoch rows between unbounded preceding and 1 preceding) as b from runs) where b is null or score < b")
def q_best_so_far(s, d):
    return runlog.best_so_far(runs(s, d), "arm", "epoch", "score").select("arm", "epoch", "score")


@query("q_ab_verdict", f"with {RUNS}, a as (select min(score) as best_a, sum(cost)::bigint as cost_a from runs where arm = 'view'), b as (select min(score) as best_b, sum(cost)::bigint as cost_b from runs where arm = 'click') select best_a, cost_a, best_b, cost_b, round(100 * (best_b - best_a) / best_a, 6) as change_pct, case when best_b < best_a then 'click' else 'view' end as better from a, b")
def q_ab_verdict(s, d):
    return runlog.verdict(runs(s, d), "arm", "score", "cost", "view", "click").withColumn("change_pct", F.round("change_pct", 6))


@query("q_stalls", "select user_id, from_ts, to_ts, idle_s from (select user_id, lag(ts) over w as from_ts, ts as to_ts, ((epoch_us(ts) - epoch_us(lag(ts) over w)) // 1000000)::bigint as idle_s from events window w as (partition by user_id order by ts)) where idle_s >= 86400")
def q_stalls(s, d):
    return runlog.stalls(load(s, d, "events"), "user_id", "ts", 86_400)


@query("q_ema", f"with {RUNS}, s as (select arm, list(score order by epoch) as v from runs group by arm) select arm, round(list_reduce(list_transform(range(1, len(v)), lambda n: struct_pack(n := n::double, e := v[n + 1])), lambda a, x: struct_pack(n := x.n, e := a.e + (1 - least(0.9e0, (1 + x.n) / (10 + x.n))) * (x.e - a.e)), struct_pack(n := 0e0, e := v[1])).e, 4) as ema from s")
def q_ema(s, d):
    return runlog.moving_average(runs(s, d), "arm", "epoch", "score", 0.9).withColumn("ema", F.round("ema", 4))


@query("q_lr_schedule", "select i as step, round(case when i < 100 then 1e-3 * (i + 1) / 100 else 1e-5 + 0.5e0 * (1e-3 - 1e-5) * (1 + cos(pi() * least(1e0, (i - 100) / 1900e0))) end, 12) as lr from range(2000) as r(i)")
def q_lr_schedule(s, d):
    return s.range(2000).select(F.col("id").alias("step"), F.round(runlog.learning_rate(F.col("id"), 2000, 100, 1e-3, 1e-5), 12).alias("lr"))


@query("q_config_specs", "select event_id, coalesce((props->>'k')::int, 12) as beam_width, coalesce((props->>'lm')::double, 0.4e0) as char_weight, coalesce(props->>'kind', 'single') as kind from events")
def q_config_specs(s, d):
    spec = F.from_json("props", "k int, lm double, kind string")
    return load(s, d, "events").select("event_id", spec.alias("p")).select("event_id", F.coalesce("p.k", F.lit(12)).alias("beam_width"), F.coalesce("p.lm", F.lit(0.4)).alias("char_weight"), F.coalesce("p.kind", F.lit("single")).alias("kind"))

