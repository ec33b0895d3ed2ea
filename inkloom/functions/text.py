"""Text functions over columns: the scoring form of a text, blanks, tokens, sentences, usable texts.

Null counts as the empty text throughout. All of it is Catalyst expressions but for
NFC, which Spark lacks: that step is an Arrow UDF and can be left out for text known
to be composed. Letters, vowel points and final forms are never changed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Directional and zero-width characters that scoring ignores.
IGNORED = "\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u200b\u200c\u200d\ufeff"
# Punctuation of one look, written as the first of each pair.
SAME = [
    ("'", "׳‘’‚‛′´`"),
    ('"', "״“”„‟″«»"),
    ("-", "־‐‑‒–—―−"),
    (":", "׃"),
    ("|", "׀"),
    (" ", "\u00a0\u2007\u202f\u2009\u200a\u3000\t"),
]
ELLIPSIS = "…"
#: Every character that counts as white space, as a class for Java's and RE2's regular expressions.
SPACES = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
FROM, TO = "".join(o for _, o in SAME), "".join(p * len(o) for p, o in SAME)


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed (NFC) text."""
    return s.str.normalize("NFC")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfc_each(s: pd.Series) -> pd.Series:
    """Arrays of texts, each composed (NFC)."""
    return pd.Series([None if a is None else [None if t is None else unicodedata.normalize("NFC", t) for t in a] for a in s], dtype=object)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def normalize(c: Column, compose: bool = True) -> Column:
    """The form in which texts are scored: composed, without ignored characters, punctuation and blanks unified."""
    c = F.coalesce(c, F.lit(""))
    c = nfc(c) if compose else c
    # One translate deletes and maps: characters beyond the end of the second list are dropped.
    c = F.translate(c, FROM + IGNORED, TO)
    return collapse(F.replace(F.replace(c, F.lit(ELLIPSIS), F.lit("...")), F.lit("''"), F.lit('"')))


def normalize_each(c: Column) -> Column:
    """The scoring form of each text of an array; Python UDFs can't stand within ``transform``, so NFC takes the array at once."""
    return F.transform(nfc_each(c), lambda t: normalize(t, compose=False))


def is_blank(c: Column) -> Column:
    return normalize(c) == ""


def split_words(normal: Column) -> Column:
    """The blank-separated words of a normalized text."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def share_of(c: Column, among: str, of: Column) -> Column:
    """Characters of a class per character counted by ``of``; 0 for none."""
    return F.when(of > 0, F.regexp_count(c, F.lit(among)) / of).otherwise(0.0)


def usable(c: Column, letters: str = "[א-ת]") -> Column:
    """Whether a normalized text has two characters or more and at least half of the visible ones are letters of the alphabet (one at least)."""
    visible = F.length(F.replace(c, F.lit(" "), F.lit("")))
    n = F.regexp_count(c, F.lit(letters))
    return (F.length(c) >= 2) & (n >= F.greatest(F.lit(1.0), 0.5 * visible))


def sentences(c: Column, allowed: str = r"[^\x{590}-\x{5ff}0-9 '\x{22}\-,:()\[\]/]+") -> Column:
    """The sentences of a text: cut at line ends and . ! ? ; with other characters blanked and blanks collapsed."""
    return F.transform(F.split(c, r"[\n.!?;]+"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, allowed, " "), " +", " ")))


def good_sentence(s: Column, block: str = r"[\x{590}-\x{5ff}]", least: int = 12) -> Column:
    """Whether a sentence is long enough and half of all its characters belong to the block."""
    return (F.length(s) >= least) & (F.regexp_count(s, F.lit(block)) >= 0.5 * F.length(s))


# ---- the same in SQL, for comparisons ----------------------------------------------------------------------------------


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_normalize(expr: str, compose: bool = True) -> str:
    x = f"coalesce({expr}, '')"
    x = f"nfc_normalize({x})" if compose else x
    x = f"translate({x}, {quote(FROM + IGNORED)}, {quote(TO)})"
    x = f"replace(replace({x}, '{ELLIPSIS}', '...'), '''''', '\"')"
    return f"trim(regexp_replace({x}, '{SPACES}', ' ', 'g'))"


def sql_words(expr: str) -> str:
    return f"(case when {expr} = '' then []::varchar[] else string_split({expr}, ' ') end)"
