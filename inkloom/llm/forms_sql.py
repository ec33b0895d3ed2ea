"""The one form of texts in SQL, for comparisons: the same classes as a table of characters, joined character by character.

DuckDB composes but doesn't decompose, so characters that differ from their plain spelling
only by composition are left to it, and the table has what remains: compatibility forms,
look-alike letters, punctuation, blanks, line ends and invisible characters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from inkloom.functions.text import quote
from inkloom.llm.lookalike import standard


@lru_cache(maxsize=2)
def table(keep_breaks: bool) -> str:
    """``(x, r)`` rows: characters and what they are written as."""
    nfc = lambda t: unicodedata.normalize("NFC", t)
    rules = {x: nfc(r) for x, r in standard(keep_breaks).rules.items() if len(x) == 1 and nfc(x) == x and nfc(r) != x}
    literal = lambda t: "||".join(f"chr({ord(c)})" for c in t) or "''"
    return ", ".join(f"({literal(x)}, {literal(r) if not r.isalnum() else quote(r)})" for x, r in sorted(rules.items()))


def forms(name: str, source: str, keep_breaks: bool) -> str:
    """CTEs that end in ``name(t, form)``: the form of every distinct text of the query ``source``, whose one column is ``t``."""
    ends = r"regexp_replace(regexp_replace(f, ' *\n *', chr(10), 'g'), ' +', ' ', 'g')"
    two = "replace(replace(string_agg(coalesce(r, c), '' order by i), chr(13) || chr(10), chr(10)), '''''', '\"')"
    return f"""{name}_rules(x, r) as (values {table(keep_breaks)}), {name}_texts as (select distinct t from ({source}) where t is not null and t <> ''),
 {name}_chars as (select t, unnest(cs) as c, generate_subscripts(cs, 1) as i from (select t, regexp_extract_all(replace(nfc_normalize(t), chr(13) || chr(10), chr(10)), '(?s).') as cs from {name}_texts)),
 {name}_written as (select t, {two} as f from {name}_chars left join {name}_rules on x = c group by t),
 {name} as (select t, nfc_normalize(trim({ends}, ' ' || chr(10))) as form from {name}_written)"""
