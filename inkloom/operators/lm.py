"""Character n-gram and word language models as count tables, queried by joins.

Texts are expected in scoring form; null and empty ones add nothing. Scores are natural
logarithms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAD = "\x02"
BACKOFF = 0.4
OOV, PREFIX_COST = -14.0, -2.5
# What makes up a word, and the letters written together with the word after them.
WORD = "[א-ת']+"
PREFIX_LETTERS = "בהוכלמש"


def char_ngrams(texts: DataFrame, column: str, order: int) -> DataFrame:
    """``(n, gram, cnt)`` for n up to the order, of each text behind one start mark."""
    padded = texts.where(F.col(column) != "").select(F.concat(F.lit(PAD), F.col(column)).alias("t"))
    starts = padded.select("t", F.explode(F.sequence(F.lit(1), F.length("t"))).alias("at"))
    grams = starts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.substring("t", F.col("at"), F.lit(n)).alias("gram")) for n in range(1, order + 1)))).alias("g"))
    return grams.where(F.length("g.gram") == F.col("g.n")).groupBy("g.n", "g.gram").agg(F.count(F.lit(1)).alias("cnt"))


def prune_ngrams(grams: DataFrame, least: int, above: int = 2) -> DataFrame:
    """Without the rare grams of more than ``above`` characters."""
    return grams.where((F.col("n") <= above) | (F.col("cnt") >= least))


def ngram_stats(grams: DataFrame) -> DataFrame:
    return grams.groupBy("n").agg(F.count(F.lit(1)).alias("n_grams"), F.sum("cnt").alias("total"))


def scored_grams(grams: DataFrame) -> DataFrame:
    """``(gram, lp)``: the log-probability of each gram's last character behind the others, for grams whose context is known."""
    total = grams.where((F.col("n") == 1) & (F.col("gram") != PAD)).agg(F.sum("cnt").alias("total"))
    contexts = grams.select(F.col("gram").alias("context"), F.col("cnt").alias("ccnt"))
    each = grams.withColumn("context", F.expr("substring(gram, 1, n - 1)")).join(contexts, "context", "left").crossJoin(F.broadcast(total))
    base = F.when(F.col("n") == 1, F.col("total")).otherwise(F.col("ccnt"))
    return each.where((F.col("cnt") > 0) & (base > 0)).select("gram", F.log(F.col("cnt") / base).alias("lp"))


def char_logprobs(texts: DataFrame, key: str, column: str, grams: DataFrame, order: int) -> DataFrame:
    """``(key, n_chars, logprob)``: the sum of each text's stupid-backoff scores.

    Of every character's contexts the longest known one counts, each step back costs log
    0.4; contexts don't reach before the text. Each text's distinct grams are counted
    first, and only grams that differ in the whole corpus are looked up with all their
    endings, so blanks and common letters, whatever their number, are one row a text.
    """
    chars = texts.where(F.length(column) > 0).select(F.col(key).alias("_key"), F.col(column).alias("t"), F.explode(F.sequence(F.lit(1), F.length(column))).alias("end"))
    asked = chars.select("_key", F.expr(f"substring(t, greatest(1, end - {order} + 1), least({order}, end))").alias("gram")).groupBy("_key", "gram").agg(F.count(F.lit(1)).alias("k"))
    total = grams.where((F.col("n") == 1) & (F.col("gram") != PAD)).agg(F.sum("cnt").alias("total"))
    known = scored_grams(grams).withColumnRenamed("gram", "ending")
    endings = asked.select("gram").distinct().select("gram", F.explode(F.sequence(F.lit(1), F.length("gram"))).alias("n")).withColumn("ending", F.expr("substring(gram, -n, n)"))
    longest = endings.join(known, "ending").groupBy("gram").agg(F.max_by(F.col("lp"), "n").alias("lp"), F.max("n").alias("n"))
    lp = F.coalesce(F.col("lp") + (F.length("gram") - F.col("n")) * math.log(BACKOFF), F.length("gram") * math.log(BACKOFF) - F.log(F.greatest(F.coalesce("total", F.lit(1)), F.lit(1))))
    return asked.join(longest, "gram", "left").crossJoin(F.broadcast(total)).groupBy(F.col("_key").alias(key)).agg(F.sum("k").alias("n_chars"), F.sum(F.col("k") * lp).alias("logprob"))


#: Grams and words that a model in memory may have.
MOST_IN_MEMORY = 5_000_000


class Model:
    """A character model and a word model in memory, for decoding; bounded by ``MOST_IN_MEMORY``, beyond which texts are scored by joins."""

    def __init__(self, grams: dict[str, float], total: int, order: int, words: dict[str, float] | None = None) -> None:
        self.grams, self.order, self.words = grams, order, words or {}
        self.back, self.floor = math.log(BACKOFF), -math.log(max(total, 1))

    @classmethod
    def load(cls, grams: DataFrame, order: int, words: DataFrame | None = None, most: int = MOST_IN_MEMORY) -> Model:
        """The models of count tables ``(n, gram, cnt)`` and ``(word, cnt)``."""
        rows = scored_grams(grams).limit(most + 1).collect()
        said = [] if words is None else words.crossJoin(F.broadcast(words.agg(F.sum("cnt").alias("total")))).select("word", F.log(F.col("cnt") / F.col("total")).alias("lp")).limit(most + 1).collect()
        if len(rows) + len(said) > most:
            raise ValueError(f"a model in memory has at most {most} grams and words")
        total = grams.where((F.col("n") == 1) & (F.col("gram") != PAD)).agg(F.sum("cnt").alias("t")).first().t
        return cls({r.gram: r.lp for r in rows}, total or 0, order, {r.word: r.lp for r in said})

    def logprob(self, prefix: str, ch: str) -> float:
        """The stupid-backoff score of a character behind a prefix."""
        context = prefix[max(0, len(prefix) - self.order + 1) :]
        for k in range(len(context) + 1):
            lp = self.grams.get(context[k:] + ch)
            if lp is not None:
                return lp + k * self.back
        return (len(context) + 1) * self.back + self.floor

    def word_logprob(self, word: str) -> float:
        """The word's own score, else that of the word without one prefix letter at a cost, else the floor."""
        if not word:
            return 0.0
        if word in self.words:
            return self.words[word]
        if len(word) > 2 and word[0] in PREFIX_LETTERS and word[1:] in self.words:
            return self.words[word[1:]] + PREFIX_COST
        return OOV

    def bonus(self, word: str) -> float:
        """What a closed word is worth above an unknown one."""
        return max(0.0, self.word_logprob(word) - OOV)


def save(counts: DataFrame, path: str, **meta: float) -> None:
    """Writes a count table, and what belongs to it (order, costs) as one row beside it."""
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    rows = [(k, float(v)) for k, v in meta.items()]
    counts.sparkSession.createDataFrame(rows, "name string, value double").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """The count table written by ``save``, and what belongs to it."""
    meta = {r.name: r.value for r in spark.read.schema("name string, value double").json(f"{path}/meta").collect()}
    return spark.read.parquet(f"{path}/counts"), meta


def word_counts(texts: DataFrame, column: str, word: str = WORD) -> DataFrame:
    """``(word, cnt)`` of the words that the pattern finds."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(word), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def prune_words(words: DataFrame, least: int) -> DataFrame:
    return words.where(F.col("cnt") >= least)


def word_logprobs(asked: DataFrame, words: DataFrame, total: DataFrame) -> DataFrame:
    """``asked(word)`` with ``known``, ``logprob`` and ``bonus``: the word's own count, else that of the word without one prefix letter at a cost, else the floor."""
    stripped = F.when((F.length("word") > 2) & F.substring("word", 1, 1).isin(list(PREFIX_LETTERS)), F.expr("substring(word, 2)"))
    counts = words.select(F.col("word").alias("stem"), F.col("cnt").alias("scnt"))
    out = asked.join(words, "word", "left").withColumn("stem", stripped).join(counts, "stem", "left").crossJoin(F.broadcast(total))
    lp = F.when(F.col("word") == "", 0.0).otherwise(F.coalesce(F.log(F.col("cnt") / F.col("total")), F.log(F.col("scnt") / F.col("total")) + PREFIX_COST, F.lit(OOV)))
    return out.select("word", F.coalesce(F.col("cnt"), F.lit(0)).alias("cnt"), (F.col("cnt").isNotNull() | F.col("scnt").isNotNull()).alias("known"), lp.alias("logprob"), F.greatest(lp - OOV, F.lit(0.0)).alias("bonus"))


def last_word(prefix: Column) -> Column:
    return F.substring_index(prefix, " ", -1)
