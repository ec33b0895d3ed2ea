"""Look-alike text: one consistent form for texts that cannot be told apart by eye.

Strings and code points that look the same are put into transitive classes by
union-find, every class gets the member that the corpus uses most as its
representative, and texts are rewritten greedily (leftmost, longest) with an
Aho-Corasick automaton until nothing is left to rewrite.

Results for odd input, of every function here that takes a column or a table:

* null text: stays null and belongs to no group; empty or blank text (nothing but
  spaces and invisible characters) becomes ``''`` and belongs to no group;
* texts of any length are rewritten whole; a run of n blanks takes log2(n) passes;
* repeated rows and repeated ids count once; an id that occurs with several texts
  stands for each of them, and is never paired with itself;
* an empty table gives an empty result with the same columns;
* further columns of the input, whatever their names, are left alone.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.text import SAME
from inkloom.session import settle

# Letters of other scripts drawn like a Latin one, as "plain: others".
LETTERS = """
A: Α А; B: Β В; C: С Ϲ; E: Ε Е; H: Η Н; I: Ι І; J: Ј Ϳ; K: Κ К; M: Μ М Ϻ; N: Ν; O: Ο О;
P: Ρ Р; Q: Ԛ; S: Ѕ; T: Τ Т; W: Ԝ; X: Χ Х; Y: Υ Ү; Z: Ζ; a: а; c: с ϲ; d: ԁ; e: е; h: һ;
i: і; j: ј ϳ; o: ο о; p: р; q: ԛ; s: ѕ; v: ν ѵ; w: ԝ; x: х; y: у
"""
# Strings drawn like a single character, as "character: string".
LIGATURES = "װ: וו; ױ: וי; ײ: יי; ֺ: ֹ"
# Further characters of the look of a punctuation mark, beside those that scoring puts together.
PUNCTUATION = [*((plain, others) for plain, others in SAME if plain != " "), ("'", "ʼʹ"), (":", "∶꞉")]
TWO_APOSTROPHES, ELLIPSIS = ("''", '"'), ("…", "...")
# Visible although of category Cf (Arabic, Syriac and Kaithi number and verse signs).
VISIBLE_CF = [0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD]
# Invisible although not of category Cf, as inclusive ranges.
INVISIBLE = [(0, 8), (0xE, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF)]
BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x85", " ", " "]


def invisible(ch: str) -> bool:
    cp = ord(ch)
    return any(a <= cp <= b for a, b in INVISIBLE) or unicodedata.category(ch) == "Cf" and cp not in VISIBLE_CF


def blank(ch: str) -> bool:
    return ch == "\t" or ch in "\x1c\x1d\x1e\x1f" or unicodedata.category(ch) == "Zs"


class UnionFind:
    """Disjoint sets of strings, with path halving and union by size."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}
        self.n: dict[str, int] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.n.get(a, 1) < self.n.get(b, 1):
                a, b = b, a
            self.up[b] = a
            self.n[a] = self.n.get(a, 1) + self.n.get(b, 1)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for x in self.up:
            out[self.find(x)].append(x)
        return [sorted(v) for _, v in sorted(out.items())]


def fixed_pairs() -> list[tuple[str, str]]:
    """The pairs that hold for any corpus."""
    pairs = [TWO_APOSTROPHES, ELLIPSIS]
    for item in LETTERS.split(";"):
        plain, others = item.strip().split(": ")
        pairs += [(plain, x) for x in others.split()]
    pairs += [tuple(x.strip().split(": ")) for x in LIGATURES.split(";")]
    return pairs + [(plain, x) for plain, others in PUNCTUATION for x in others]


class Lookalikes:
    """Classes of look-alike strings over an inventory of code points, and the rewriting by them.

    ``counts`` holds how often the corpus has each code point and each string of
    :meth:`strings`; without it the plain member represents its class. With
    ``keep_breaks`` a line break differs from a blank, else it is one more blank.
    """

    def __init__(self, inventory: Iterable[str], counts: dict[str, int] | None = None, keep_breaks: bool = True) -> None:
        pairs, counts = fixed_pairs(), counts or {}
        mapped = {x for p in pairs for x in p if len(x) == 1}
        uf = UnionFind()
        for a, b in pairs:
            uf.union(a, b)
        todo = sorted({c for c in inventory} | {c for p in pairs for x in p for c in x})
        seen: set[str] = set()
        while todo:
            ch = todo.pop()
            if ch in seen:
                continue
            seen.add(ch)
            if ch in BREAKS:
                uf.union(ch, "\n" if keep_breaks else " ")
            elif blank(ch):
                uf.union(ch, " ")
            elif invisible(ch):
                uf.union(ch, "")
            elif ch not in mapped and (plain := unicodedata.normalize("NFKD", ch)) != ch and plain.strip():
                uf.union(ch, plain)
                todo += plain
        for a, b in [("  ", " ")] + ([(" \n", "\n"), ("\n ", "\n"), ("\r\n", "\n")] if keep_breaks else []):
            uf.union(a, b)
        self.keep_breaks = keep_breaks
        self.members = uf.classes()
        parts = dict(x.strip().split(": ") for x in LIGATURES.split(";"))
        plain = {p[0] for p in pairs if p != ELLIPSIS and p != TWO_APOSTROPHES and p[0] not in parts} | {'"', "..."} | {*parts.values()}

        def best(members: list[str]) -> str:
            # "" stands for all that cannot be seen; blanks and breaks are never written longer than needed
            fixed = next((x for x in ("", "\n" if keep_breaks else " ", " ") if x in members), None)
            if fixed is not None:
                return fixed
            return min(members, key=lambda x: (-counts.get(x, 0), x not in plain, any(unicodedata.normalize("NFKD", c) != c for c in x), len(x), x))

        rules = {x: r for m in self.members for r in [best(m)] for x in m if x != r and x}
        # Patterns and representatives are themselves rewritten by the rules of their parts, so that rewriting ends in one form.
        for _ in range(64):
            single = {x: r for x, r in rules.items() if len(x) == 1}
            new: dict[str, str] = {}
            for x, r in rules.items():
                r2 = "".join(single.get(c, c) for c in r) if len(r) > 1 else r
                new[x] = r2
                x2 = "".join(single.get(c, c) for c in x)
                if len(x) > 1 and x2 not in ("", r2):
                    new.setdefault(x2, r2)
            if new == rules:
                break
            rules = new
        else:
            raise ValueError("the classes lead to no single form")
        self.rules = rules
        self._start()

    def _start(self) -> None:
        """The state of one process: the automaton holds the patterns of the characters met so far."""
        self._single = {x for x in self.rules if len(x) == 1}
        self._multi = [x for x in self.rules if len(x) > 1]
        self._met: set[str] = set()
        self._automaton = ahocorasick.Automaton()

    @classmethod
    def strings(cls) -> list[str]:
        """The strings of more than one code point whose frequency matters."""
        return sorted({x for p in fixed_pairs() for x in p if len(x) > 1})

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _meet(self, characters: set[str]) -> None:
        """Adds the patterns of further characters, and of those they are rewritten to. The cost of a step of the automaton
        grows with the patterns at its root, so it isn't filled with all of Unicode."""
        while characters := characters - self._met:
            self._met |= characters
            characters = {c for x in characters for c in self.rules.get(x, "")}
        a = ahocorasick.Automaton()
        for x, r in self.rules.items():
            if self._met.issuperset(x):
                a.add_word(x, (len(x), r))
        a.make_automaton()
        self._automaton = a

    def rewrite(self, text: str) -> str:
        """One form of the text: greedy rewriting to the end, marks in canonical order, no blanks at the ends."""
        characters = set(text)
        if self._single.isdisjoint(characters) and not any(x in text for x in self._multi):
            return self._end(text)
        if not characters <= self._met:
            self._meet(characters)
        most = len(text) + 64  # far more passes than any text takes: a run of n blanks, the slowest, takes log2(n)
        for _ in range(most):
            parts, at = [], 0
            for end, (n, r) in self._automaton.iter_long(text):
                parts += (text[at : end - n + 1], r)
                at = end + 1
            if not parts:
                return self._end(text)
            text = "".join(parts) + text[at:]
        raise ValueError("the rewriting of a text doesn't end")

    @staticmethod
    def _end(text: str) -> str:
        text = text.strip(" \n")
        return text if text.isascii() else unicodedata.normalize("NFD", text)


@lru_cache(maxsize=4)
def standard(keep_breaks: bool = False) -> Lookalikes:
    """Classes over all of Unicode with the plain representatives, for comparisons that need no corpus."""
    return Lookalikes((chr(c) for c in range(0x110000) if not 0xAC00 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")), None, keep_breaks)


def inventory(texts: DataFrame, column: str) -> DataFrame:
    """``(symbol STRING, n BIGINT)``: how often the column has each code point and each string of :meth:`Lookalikes.strings`.

    Counted in each batch, then summed; at most one row a code point of Unicode comes out.
    """
    strings = Lookalikes.strings()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    total.update(t)
                    for s in strings:
                        if s in t:
                            total[s] += t.count(s)
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return texts.select(F.col(column).alias("t")).mapInArrow(count, "symbol string, n bigint").groupBy("symbol").agg(F.sum("n").alias("n"))


def learn(texts: list[tuple[DataFrame, str]], keep_breaks: bool = True) -> Lookalikes:
    """The classes over the code points of all given columns, with the representatives the corpus uses most.

    The driver gets one row a distinct code point (bounded by Unicode, not by the data).
    """
    every = reduce(DataFrame.unionByName, [df.select(F.col(c).alias("t")) for df, c in texts])
    counts = {r.symbol: r.n for r in inventory(every, "t").collect()}
    return Lookalikes((s for s in counts if len(s) == 1), counts, keep_breaks)


def one_form(spark: SparkSession, classes: Lookalikes, column: Column) -> Column:
    """The column rewritten to one form; null stays null."""
    shared = spark.sparkContext.broadcast(classes)  # bounded by the code points of Unicode

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        f = shared.value.rewrite
        return pd.Series([None if t is None else f(t) for t in texts], dtype=object)

    return rewrite(column)


def with_form(spark: SparkSession, df: DataFrame, classes: Lookalikes, column: str, into: str = "form") -> DataFrame:
    """The table with the column ``into``: the one form of ``column``."""
    return df.withColumn(into, one_form(spark, classes, F.col(column)))


def spellings(spark: SparkSession, tables: list[tuple[DataFrame, str, str]], classes: Lookalikes) -> DataFrame:
    """``(id, form, spelling)``: 128-bit hashes of the one form (which tells the tables apart too) and of the text as it is, for every id with a text that isn't blank.

    ``tables`` are (table, column of ids, column of texts), ids of one type. Each text is read and rewritten once; only ids and hashes go on.
    """
    shared = spark.sparkContext.broadcast(classes)  # bounded by the code points of Unicode
    kind = tables[0][0].schema[tables[0][1]].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, h = shared.value.rewrite, xxhash.xxh3_128_digest
        for b in batches:
            texts = b.column(1).to_pylist()
            forms = [f(t) for t in texts]
            keep = [i for i, x in enumerate(forms) if x]
            no = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array([h(f"{no[i]} {forms[i]}") for i in keep], pa.binary()), pa.array([h(texts[i]) for i in keep], pa.binary())], names=["id", "form", "spelling"])

    each = [df.select(F.col(i).alias("id"), F.col(t).alias("t"), F.lit(no).alias("no")) for no, (df, i, t) in enumerate(tables)]
    return reduce(DataFrame.unionByName, each).where("id is not null and t is not null").mapInArrow(go, f"id {kind}, form binary, spelling binary")


#: Ids of one spelling that are joined in one piece.
PIECE = 4096


def equal_looking(spark: SparkSession, tables: list[tuple[DataFrame, str, str]], classes: Lookalikes) -> DataFrame:
    """``(rec_a, rec_b)``, rec_a < rec_b: ids of one table whose texts have one form but are different strings.

    Forms and texts are compared by 128-bit hashes. Not ids but the spellings of a form are paired,
    so ids of one spelling never meet; each pair of spellings is then given its ids by two joins,
    for which the ids of a spelling that very many have are cut into pieces.
    """
    rows = settle(spellings(spark, tables, classes).distinct(), "spellings")
    each = rows.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("n"))
    several = each.groupBy("form").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("form")
    each = each.join(several, "form").withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")).drop("n")
    ids = rows.join(each, ["form", "spelling"]).select("form", "spelling", "id", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"))
    side = lambda x: each.select("form", F.col("spelling").alias(f"s{x}"), F.col("pieces").alias(f"n{x}"))
    of = lambda x: ids.select("form", F.col("spelling").alias(f"s{x}"), F.col("piece").alias(f"p{x}"), F.col("id").alias(f"id_{x}"))
    pieces = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = side("a").join(side("b"), "form").where("sa < sb").withColumn("pa", pieces("na")).join(of("a"), ["form", "sa", "pa"])
    pairs = pairs.select("form", "sb", "nb", "id_a").withColumn("pb", pieces("nb")).join(of("b"), ["form", "sb", "pb"]).where("id_a <> id_b")
    return pairs.select(F.least("id_a", "id_b").alias("rec_a"), F.greatest("id_a", "id_b").alias("rec_b")).distinct()
