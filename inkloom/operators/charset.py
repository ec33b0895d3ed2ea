"""Character sets as tables ``(idx INT, ch STRING)``; index 0 is the blank of CTC and has the empty string.

Joins on ``ch`` stay within whole-stage code; for encoding, the set goes along as literals, whose size
is bounded by the alphabet. Null texts count as empty; characters outside the set are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The characters of the standard set, in order (letters, digits, punctuation, Latin letters).
STANDARD = "אבגדהוזחטיכךלמםנןסעפףצץקרשת" "0123456789" " '\"-.,:;!?()[]{}/\\|*+=%&#@_<>~^$" "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
MOST = 65_000  # characters that a set may have for encoding


def characters(texts: DataFrame, column: str) -> DataFrame:
    """``(ch, n)``: how often each character occurs."""
    return texts.select(F.explode(F.split(F.col(column), "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def numbered(chars: DataFrame, start: int = 1) -> DataFrame:
    """The characters numbered in code point order; an alphabet is small, so one task may sort it."""
    return chars.select((F.row_number().over(Window.orderBy("ch")) + (start - 1)).cast("int").alias("idx"), "ch")


def build(texts: DataFrame, column: str, least: int = 1) -> DataFrame:
    """The set of the characters that occur ``least`` times or more."""
    found = numbered(characters(texts, column).where(F.col("n") >= least))
    return found.unionByName(texts.sparkSession.createDataFrame([(0, "")], "idx int, ch string"))


def standard(spark: SparkSession) -> DataFrame:
    """The standard set as a table."""
    return spark.createDataFrame(list(enumerate(["", *STANDARD])), "idx int, ch string")


def save(charset: DataFrame, path: str) -> None:
    """Writes a set as JSON lines, one a character; an alphabet is one small file."""
    charset.select("idx", "ch").orderBy("idx").coalesce(1).write.mode("overwrite").json(path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """A set written by ``save``; one whose index 0 isn't the blank is an error."""
    found = spark.read.schema("idx int, ch string").json(path)
    blank = found.where("idx = 0").limit(2).collect()
    if len(blank) != 1 or blank[0].ch != "":
        raise ValueError("index 0 of a character set is the blank")
    return found


def extend(base: DataFrame, texts: DataFrame, column: str, least: int = 1) -> DataFrame:
    """The set with the frequent characters it lacks behind its own."""
    new = characters(texts, column).where(F.col("n") >= least).join(base.select("ch"), "ch", "left_anti")
    top = base.agg(F.max("idx").alias("top"))
    return base.select("idx", "ch").unionByName(numbered(new).crossJoin(F.broadcast(top)).select((F.col("idx") + F.col("top")).cast("int").alias("idx"), "ch"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The characters of both sets."""
    return a.select("ch").intersect(b.select("ch"))


class Codec:
    """Texts to indices and back by one character set, as expressions.

    Encoding is one ``translate`` of known characters to code points from U+F0000 on, whose
    number is the index; it looks characters up by hash where a map column would search.
    """

    FIRST = 0xF0000

    def __init__(self, charset: DataFrame) -> None:
        rows = charset.where("ch <> '' and idx > 0").orderBy("idx").limit(MOST + 1).collect()
        if len(rows) > MOST:
            raise ValueError("a character set can't have so many characters")
        self.chars = {r.idx: r.ch for r in rows}

    def encode(self, text: Column) -> Column:
        """The indices of a text's characters; unknown ones are dropped."""
        to = "".join(chr(self.FIRST + i) for i in self.chars)
        coded = F.translate(F.coalesce(text, F.lit("")), "".join(self.chars.values()), to)
        return F.transform(F.filter(F.split(coded, ""), lambda c: c >= chr(self.FIRST)), lambda c: F.ascii(c) - self.FIRST)

    def decode(self, codes: Column) -> Column:
        """The text of indices; the blank and unknown indices give nothing."""
        table = F.array(*(F.lit(self.chars.get(i, "")) for i in range(max(self.chars, default=0) + 1)))
        return F.array_join(F.transform(codes, lambda i: F.coalesce(F.get(table, i), F.lit(""))), "")

    @staticmethod
    def known_part(text: Column, codes: Column) -> Column:
        """The part of a text's characters that its indices stand for; 1 for an empty text."""
        n = F.length(text)
        return F.when(n > 0, F.size(codes) / n).otherwise(1.0)
