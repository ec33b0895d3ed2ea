"""Personal information in free text: bootstrapped contextual extraction, and typed placeholders.

Seed entities (listed names; streets named after a street word; numbers of a known
shape) induce lexical patterns: the words to the left and right of a full name, the other
name it stands with, what a line has around a given name, the town after a house number,
the word before a number. Spark scores the graph of patterns and instances, and what
high-confidence patterns support well becomes a seed of the next round, until a round
brings nothing new. A later round goes only through texts that have a new name and
corrects the counts by what has changed there. The names, line templates, streets, towns
and number labels learned in this way then find the identifiers of all texts: numbers of
unseen shapes behind a label of phone numbers are phone numbers, and nine digits behind a
label whose numbers pass the check digit no more often than by chance are no identity
numbers. E-mail addresses have a grammar of their own.

Texts are compared in a folded spelling (look-alikes, vowel points, invisible
characters, letter case); positions are those of the text as it is stored.

Odd input: null and blank texts have no identifiers, their redacted text is what they
were; texts of any length are taken whole; repeated rows give repeated identifiers,
once each for every row's doc_id; an empty list of names leaves the names to be found
by nothing, the other kinds are still found; empty tables give no rows. Other columns
are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.lookalike import Lookalikes
from inkloom.session import release, settle

#: Names, streets and towns together that may be learned; they are sent to all tasks.
MOST_LEARNED = 1_000_000
#: An instance needs so many different partners, such a mean confidence of its patterns, and may stand just outside of full names in such a part of its windows.
PARTNERS, SUPPORT, OUTSIDE = 3, 0.25, 0.15
#: A label stands before numbers in such a part of its occurrences; its numbers are so surely phone numbers; nine-digit numbers seen behind a label, and the part of them with a right check digit that is no more than chance.
LABEL_SURE, LABEL_SEEN, LABEL_CHANCE, LABEL_SHARE = 0.9, 20, 0.2, 0.2
#: The part of a word's occurrences that must be in name windows.
SHARE = {"family": 0.2, "given": 0.05}

# What is written before a house number, and kinds of English streets.
STREET_WORDS = ["רחוב", "רח'", "סמטת", "דרך", "שדרות", "שד'"]
ENGLISH_STREETS = "Lane|Road|Rd|Street|St|Close|Avenue|Ave|Row|Way|Court|Drive|Place|Hill|Square|Crescent|Terrace|Gardens|Boulevard|Blvd"
# Hebrew letters that are written together with the word after them.
PREFIXES, JOINING = "ולמבשכה", "ושכ"
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnum": "[IDNUM]", "address": "[ADDRESS]", "name": "[NAME]"}

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|[\n\t]")
PLAIN = re.compile(r"[\n -~א-ת]*")
EMAIL = re.compile(r"[a-z0-9][a-z0-9._+\-]*(?: ?@ ?| ?[\[({] ?at ?[\])}] ?| שטרודל | כרוכית | at (?=[a-z0-9\-]+ (?:dot|\[dot\]) ))[a-z0-9\-]+(?:(?:\.| ?[\[({] ?dot ?[\])}] ?| dot | נקודה )[a-z0-9\-]+)+")
PHONE = re.compile(r"(?<![0-9a-z+])(?<!\d[-./])(?:(?:(?:\+972|00972)[-. ]?\(?0?\)?|\(?0)(?:[57]\d|[23489])\)?(?:[-. ]?\d){7}|(?:(?:\+|00)44[-. ]?|\(?0)7\d{3}\)?[-. ]?\d{3}[-. ]?\d{3}|(?:\+1[-. ])?\(?[2-9]\d{2}\)?[-. ]\d{3}[-. ]\d{4})(?![-.]?\d)")
NINE = re.compile(r"(?<!\d)(?<!\d[-./])(?=((?:\d[ -]?){8}\d|\d(?:\.?\d){8})(?![-./]?\d))")
#: Where numbers of eight characters or more can be; the patterns above are tried only there.
ZONE = re.compile(r"[+(\d][\d()+. \-]{7,}")
MAILBOX = frozenset("abcdefghijklmnopqrstuvwxyz0123456789._+-")
AT = re.compile(r"@|[\[({] ?at ?[\])}]| at (?=[a-z0-9\-]+ (?:dot|\[dot\]) )|שטרודל|כרוכית")
ADDRESS = re.compile(r"(?<![א-ת'])(?:[ולמבשכה]{0,2})(" + "|".join(STREET_WORDS) + r") ([א-ת]{2,}(?: [א-ת]{2,}){0,2}) (?:מס' )?(\d{1,4})(?!\d)(/\d+)?")
REST = re.compile(r"(?: דירה \d+)?(?:, ?כניסה [א-ת]'?)?(?:, ?קומה [א-ת\d]+)?")
HOUSE = re.compile(r" (?:מס' )?\d{1,4}(?!\d)(?:/\d+)?")
#: The word before a number on the same line, and a number of any shape.
LABEL = re.compile(r"([^\W\d_]{2,})['\".:#\- ]*$")
NUMBER = re.compile(r"\+?\(?\d[\d()+. \-]*\d")
POSTCODE = re.compile(r" \d{5,7}(?![-. ]?\d)")
TOWN = re.compile(r", ?([א-ת]{2,}(?:[ -][א-ת]{2,}){0,2})")
ENGLISH = re.compile(r"(?<![\w/])(?:Flat \d+[A-Za-z]?, ?)?\d{1,5}(?:/\d+)?[A-Za-z]? (?:[A-Z][A-Za-z'\-]+ ){1,3}(?:" + ENGLISH_STREETS + r")\b\.?")
ENGLISH_TOWN = re.compile(r", ?([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?)")


class Folding(dict):
    """Code point to its folded spelling: look-alikes plain, marks and invisible characters gone; tabs and line breaks stay."""

    def __init__(self, classes: Lookalikes) -> None:
        super().__init__({9: "\t", 10: "\n", 13: "\n"})
        self.rules = {k: v for k, v in classes.rules.items() if len(k) == 1}

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        plain = self.rules.get(ch, ch)
        self[cp] = out = "".join(c for c in unicodedata.normalize("NFD", plain) if unicodedata.category(c) != "Mn")
        return out


def fold(folding: Folding, text: str) -> tuple[str, list[int] | None]:
    """The folded text, and for each of its characters the place in the text, None where places are equal."""
    if PLAIN.fullmatch(text):
        return text, None
    parts = [folding[ord(c)] for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def folded(folding: Folding, text: str) -> str:
    """The folded text alone."""
    return text if PLAIN.fullmatch(text) else text.translate(folding)


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Known:
    """What has been learned: lower-case names by role, templates of lines with a lone given name, streets, towns."""

    given: set[str] = field(default_factory=set)
    family: set[str] = field(default_factory=set)
    templates: dict[str, str] = field(default_factory=dict)
    streets: set[str] = field(default_factory=set)
    towns: set[str] = field(default_factory=set)
    phone_labels: set[str] = field(default_factory=set)
    no_id_labels: set[str] = field(default_factory=set)

    def names(self) -> set[str]:
        return self.given | self.family


def anchored(word: str, names: set[str]) -> bool:
    """Whether the word is a name of the set, or one behind the prefix letters that it can be written together with."""
    if word in names:
        return True
    if word[1:] in names and word[0] in PREFIXES:
        return True
    return word[2:] in names and word[0] in JOINING and word[1] in PREFIXES and "א" <= word[2] <= "ת"


class Names:
    """A set of names, and which of the words met so far are one, with or without prefix letters; no list of all spellings is needed."""

    #: Words that a process remembers; beyond that it begins anew.
    MOST_SEEN = 500_000

    def __init__(self, names: set[str]) -> None:
        self.names, self.seen, self.hits = names, set(), set()

    def __getstate__(self) -> set[str]:
        return self.names

    def __setstate__(self, names: set[str]) -> None:
        self.__init__(names)

    def among(self, words: set[str]) -> set[str]:
        """Those of the words that are names."""
        if new := words - self.seen:
            if len(self.seen) > self.MOST_SEEN:
                self.seen, self.hits, new = set(), set(), words
            n = self.names
            self.seen |= new
            self.hits.update(w for w in new if (w in n or w[1:] in n or w[2:] in n) and anchored(w, n))
        return words & self.hits


def places(tokens: list[str], names: Names) -> list[int]:
    """Where the tokens have a name."""
    hits = names.among(set(tokens))
    return [i for i, t in enumerate(tokens) if t in hits] if hits else []


def stem(word: str, names: set[str]) -> int:
    """How many letters of prefix stand before a name of the set; -1 if there is none."""
    for k in (0, 1, 2):
        if word[k:] in names and all(c in PREFIXES for c in word[:k]):
            return k
    return -1


def boundary(tokens: list[str], i: int) -> str:
    """The token at i as a context: numbers are alike, and so are the ends of lines and texts."""
    t = tokens[i] if 0 <= i < len(tokens) else "\n"
    return "#" if t.isdigit() else t


def is_word(t: str) -> bool:
    return len(t) > 1 and t.isalpha()


def windows(tokens: list[str], known: Known, where: list[int], out: Counter, by: int = 1) -> None:
    """Counts what stands in name windows: (kind, word, partner, left, right); kind is pos, given or family. ``by`` is what one is counted as."""
    given, family, n = known.given, known.family, len(tokens)
    at = lambda i: tokens[i] if 0 <= i < n else "\n"
    for i in where:
        t = tokens[i]
        f = stem(t, family)
        if f >= 0:
            name, left, right = t[f:], at(i - 1), at(i + 1)
            left_given, right_given = stem(left, given) if f == 0 else -1, right in given
            if left_given >= 0:
                out["pos", left[left_given:], name, boundary(tokens, i - 2) if not left_given else left[:left_given] + "_", boundary(tokens, i + 1)] += by
            elif right_given:
                out["pos", right, name, boundary(tokens, i - 1) if not f else t[:f] + "_", boundary(tokens, i + 2)] += by
            elif left not in "-'." or left == "\n":
                if f == 0 and is_word(left):
                    out["given", left, name, boundary(tokens, i - 2), boundary(tokens, i + 1)] += by
                if is_word(right):
                    out["given", right, name, boundary(tokens, i - 1), boundary(tokens, i + 2)] += by
            continue
        g = stem(t, given)
        name, left, right = t[g:], at(i - 1), at(i + 1)
        if stem(right, family) == 0 or g == 0 and stem(left, family) >= 0 or right in given:
            continue
        if is_word(right):
            out["family", right, name, boundary(tokens, i - 1) if not g else t[:g] + "_", boundary(tokens, i + 2)] += by
        if g == 0 and is_word(left):
            out["family", left, name, boundary(tokens, i - 2), boundary(tokens, i + 1)] += by


def template(around: str) -> str:
    """The key of what a line has around a word, from its beginning to its end; ``_`` stands for the word."""
    return xxhash.xxh3_64_hexdigest(around)


def line_at(tokens: list[str], i: int) -> tuple[list[str], int]:
    """The line that the token at i is in, and the token's place in it."""
    a = i
    while a and tokens[a - 1] != "\n":
        a -= 1
    b = i + 1
    while b < len(tokens) and tokens[b] != "\n":
        b += 1
    return tokens[a:b], i - a


def alone(tokens: list[str], where: list[int]) -> list[int]:
    """Those of the ascending places with no other on their line."""
    ends = [-1, *(i for i, t in enumerate(tokens) if t == "\n"), len(tokens)] if where else []
    lines = Counter(bisect_left(ends, i) for i in where)
    return [i for i in where if lines[bisect_left(ends, i)] == 1]


def fillings(line: list[str], i: int) -> list[tuple[str, str]]:
    """(template, filler) of the word at i of a line: the word itself, and what follows a ``ל`` (to) that it begins with."""
    if not is_word(line[i]) or any(t.isdigit() for t in line):
        return []
    w, around = line[i], lambda mark: template(" ".join([*line[:i], mark, *line[i + 1 :]]))
    return [(around("_"), w)] + ([(around("ל_"), w[1:])] if w[0] == "ל" and len(w) > 2 else [])


def label(low: str, at: int) -> str:
    """The word before a number on its line, '' if there is none."""
    m = LABEL.search(low, max(0, at - 40), at)
    return m[1] if m else ""


def count_town(total: Counter, words: str, partner: str) -> None:
    """Counts the words after a house number, and every beginning of them, as a town."""
    parts = words.split(" ")
    for k in range(1, len(parts) + 1):
        total["town", " ".join(parts[:k]), partner, "", ""] += 1


ROWS = "kind string, word string, partner string, l string, r string, n bigint"


#: Counts that a task holds before it gives them out.
MOST_HELD = 200_000


def counted(texts: DataFrame, shared: object, count: Callable[[object, str, Counter, Counter], None]) -> DataFrame:
    """The sums of what ``count`` counts in each text (and of words, by themselves): within a task first, given out whenever ``MOST_HELD`` counts are held."""
    sent = texts.sparkSession.sparkContext.broadcast(shared)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            total.update({("word", t, "", "", ""): k for t, k in words.items() if is_word(t)})
            words.clear()
            columns = list(zip(*total, strict=True)) or [[]] * 5
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(total.values()), pa.int64())], names=["kind", "word", "partner", "l", "r", "n"])
            total.clear()
            return batch

        for b in batches:
            for text in b.column(0).to_pylist():
                count(sent.value, text, total, words)
                if len(total) + len(words) > MOST_HELD:
                    yield flush()
        yield flush()

    return texts.mapInArrow(go, ROWS)


def first_scan(texts: DataFrame, folding: Folding, known: Known) -> DataFrame:
    """What the texts have in the patterns of the seeds: words, name windows, lines around seed names, streets, towns and labels of numbers."""

    def count(shared: tuple, text: str, total: Counter, words: Counter) -> None:
        folding, known, names, finder = shared
        plain = folded(folding, text)
        low = lowered(plain)
        tokens = TOKEN.findall(low)
        words.update(tokens)
        where = places(tokens, names)
        windows(tokens, known, where, total)
        for i in alone(tokens, where):
            line, j = line_at(tokens, i)
            for key, filler in fillings(line, j):
                if filler in known.given:
                    total["line", filler, key, shape(line, j), ""] += 1
        for m in ADDRESS.finditer(low) if any(w in low for w in STREET_WORDS) else ():
            rest = REST.match(low, m.end())
            town = TOWN.match(low, rest.end())
            total["street", m[2], m[3], "", ""] += 1
            if town:
                count_town(total, town[1], m[2])
        for m in ENGLISH.finditer(plain) if plain != low else ():
            if town := ENGLISH_TOWN.match(plain, m.end()):
                count_town(total, town[1].lower(), m[0].lower())
        for kind, a, b, digits in finder.shapes(low):
            if (word := label(low, a)) and (kind != "other" or len(digits) >= 7):
                total["label", word, digits, kind, ""] += 1

    summed = counted(texts, (folding, known, Names(known.names()), Finder(known)), count)
    return summed.groupBy("kind", "word", "partner", "l", "r").agg(F.sum("n").alias("n"))


def shape(line: list[str], i: int) -> str:
    """What can be seen of the template of a line's word at i at a glance: number of tokens, place of the word, first and last token."""
    return "\x1f".join((str(len(line)), str(i), line[0] if i else "", line[-1] if i + 1 < len(line) else ""))


class Shapes:
    """Candidate templates by what can be seen of them at a glance: number of tokens, place of the word, first and last token ('' where the word itself is)."""

    def __init__(self, candidates: dict[str, str]) -> None:
        self.keys = set(candidates)
        parts = [(int(n), int(i), first, last) for n, i, first, last in (x.split("\x1f") for x in candidates.values())]
        self.at: dict[int, set[int]] = defaultdict(set)
        for n, i, _, _ in parts:
            self.at[n].add(i)
        self.longest = max(self.at, default=0)
        self.both = {(first, last) for _, _, first, last in parts}
        self.lasts = tuple({last for _, _, _, last in parts if last})
        self.open = any(not last for _, _, _, last in parts)

    def fillers(self, line: str) -> Iterator[tuple[str, str, int, list[str]]]:
        """(template, filler, place of the word, tokens) of every word of a line that stands in a candidate template."""
        line = line.strip(" ")
        # most lines end, begin or are as long as no template
        if not line or not (self.open or line.endswith(self.lasts)) or len(line.split(None, self.longest)) > self.longest:
            return
        tokens = TOKEN.findall(line)
        first, last, n = tokens[0], tokens[-1], len(tokens)
        if n in self.at and ((first, last) in self.both or ("", last) in self.both or (first, "") in self.both or ("", "") in self.both):
            for i in self.at[n]:
                if (first if i else "", last if i + 1 < n else "") in self.both:
                    for key, filler in fillings(tokens, i):
                        if key in self.keys:
                            yield key, filler, i, tokens


def later_scan(texts: DataFrame, folding: Folding, old: Known, new: Known, candidates: dict[str, str]) -> DataFrame:
    """The changes to the name windows where texts have a new name, and the fillers of the candidate templates (key to shape) in all lines."""

    def count(shared: tuple, text: str, total: Counter, words: Counter) -> None:
        folding, old, new, was, now, added, automaton, shapes = shared
        low = lowered(folded(folding, text))
        if automaton and automaton.search(low):
            tokens = TOKEN.findall(low)
            # A window reaches two tokens to either side, so only those near a new name can have changed.
            if near := {j for i in places(tokens, added) for j in range(i - 2, i + 3)}:
                windows(tokens, new, [i for i in places(tokens, now) if i in near], total)
                windows(tokens, old, [i for i in places(tokens, was) if i in near], total, -1)
        for line in low.split("\n") if shapes else ():
            for key, filler, _, _ in shapes.fillers(line):
                total["fill", filler, key, "", ""] += 1

    added = new.names() - old.names()
    shared = (folding, old, new, Names(old.names()), Names(new.names()), Names(added), Words(added) if added else None, Shapes(candidates) if candidates else None)
    return counted(texts, shared, count)


class Words:
    """An automaton that tells whether a text has any of many words, at the cost of one pass over the text."""

    def __init__(self, names: set[str]) -> None:
        self.names = names
        self._start()

    def _start(self) -> None:
        self._automaton = ahocorasick.Automaton()
        for n in self.names:
            self._automaton.add_word(n, len(n))
        self._automaton.make_automaton()

    def __getstate__(self) -> set[str]:
        return self.names

    def __setstate__(self, names: set[str]) -> None:
        self.names = names
        self._start()

    def search(self, text: str) -> bool:
        """Whether one stands in the text as a word, or behind prefix letters."""
        for a, b in self.found(text):
            if not text[b : b + 1].isalpha():
                k = a
                while k and a - k < 2 and text[k - 1] in PREFIXES:
                    k -= 1
                # with one prefix letter less the word may begin as well
                if any(not text[max(0, j - 1) : j].isalpha() for j in range(k, a + 1)):
                    return True
        return False

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every occurrence of every word."""
        for end, n in self._automaton.iter(text):
            yield end - n + 1, end + 1


def score(found: DataFrame, words: DataFrame, known_words: DataFrame) -> DataFrame:
    """``(role, word)`` of new instances, from the graph of patterns (left and right context) and instances (names with their partners)."""
    pos = found.where("kind = 'pos'")
    patterns = pos.groupBy("l", "r").agg(F.count_distinct("word", "partner").alias("k")).select("l", "r", (F.col("k") / (F.col("k") + 2)).alias("conf"))
    outside = pos.select(F.explode(F.array("l", "r")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("outside"))
    seen = found.where("kind in ('given', 'family')").join(known_words, "word", "left_anti").join(patterns, ["l", "r"], "left")
    each = seen.groupBy(F.col("kind").alias("role"), "word").agg(F.count_distinct("partner").alias("partners"), F.sum("n").alias("windows"), (F.sum(F.coalesce("conf", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("support"))
    share = F.when(F.col("role") == "family", SHARE["family"]).otherwise(SHARE["given"])
    good = each.where((F.col("partners") >= PARTNERS) & (F.col("support") >= SUPPORT)).join(words, "word").join(outside, "word", "left")
    good = good.where((F.col("windows") >= share * F.col("total")) & (F.coalesce("outside", F.lit(0)) <= OUTSIDE * F.col("windows")))
    return good.groupBy("word").agg(F.max_by("role", F.struct("windows", "role")).alias("role")).select("role", "word")


def bounded(df: DataFrame) -> list:
    rows = df.limit(MOST_LEARNED + 1).collect()
    if len(rows) > MOST_LEARNED:
        raise ValueError(f"more than {MOST_LEARNED} names, streets or towns")
    return rows


def learn(spark: SparkSession, documents: DataFrame, names: DataFrame, classes: Lookalikes) -> tuple[Known, Folding]:
    """The names, line templates, streets, towns and labels that the seeds lead to; only these go to the driver, up to a stated number."""
    folding, known = Folding(classes), Known()
    for r in bounded(names.where("name_text is not null and name_role in ('given', 'family')").select("name_role", "name_text").distinct()):
        word = lowered(fold(folding, r.name_text.strip())[0])
        if word:
            getattr(known, r.name_role).add(word)
    texts = documents.select("text").where("text is not null")
    found = settle(first_scan(texts, folding, known), "windows")
    words = found.where("kind = 'word'").select("word", F.col("n").alias("total"))
    streets = found.where("kind = 'street'").groupBy("word").agg(F.count_distinct("partner").alias("k")).where(F.col("k") >= PARTNERS)
    known.streets = {r.word for r in bounded(streets)}
    towns = found.where("kind = 'town'").groupBy("word").agg(F.count_distinct("partner").alias("k"), F.sum("n").alias("n")).where(F.col("k") >= PARTNERS)
    count = {r.word: r.n for r in bounded(towns)}
    # Of a town and its beginnings the longest stands that loses less than half of the occurrences.
    parent = {t: t.rpartition(" ")[0] for t in count}
    longer = {parent[t] for t in count if parent[t] in count and count[t] >= 0.5 * count[parent[t]]}
    known.towns = {t for t in count if t not in longer and (parent[t] not in count or count[t] >= 0.5 * count[parent[t]])}
    of = lambda kind: F.sum(F.when(F.col("l") == kind, F.col("n")).otherwise(0)) / F.sum("n")
    labels = found.where("kind = 'label'").groupBy("word").agg(of("phone").alias("phone"), of("idnum").alias("idnum"), (F.sum(F.when(F.col("l").isin("idnum", "nine"), F.col("n")).otherwise(0))).alias("nine"), F.count_distinct(F.when(F.col("l") == "phone", F.col("partner"))).alias("phones"), F.sum("n").alias("n"), F.sum(F.when(F.col("l") == "idnum", F.col("n")).otherwise(0)).alias("ids"))
    # A label is a word that stands before numbers more often than by the way, and no name.
    labels = labels.join(words, "word").where(F.col("n") >= LABEL_SHARE * F.col("total"))
    labels = labels.join(spark.createDataFrame([(w,) for w in sorted(known.names())], "word string"), "word", "left_anti")
    known.phone_labels = {r.word for r in bounded(labels.where((F.col("phone") >= LABEL_SURE) & (F.col("phones") >= PARTNERS)).select("word"))}
    known.no_id_labels = {r.word for r in bounded(labels.where((F.col("nine") >= LABEL_SEEN) & (F.col("ids") <= LABEL_CHANCE * F.col("nine"))).select("word"))}
    # Lines are told apart by what at least two seed names fill; how else they are filled is counted in the next scan.
    lines = found.where("kind = 'line'").groupBy("partner").agg(F.count_distinct("word").alias("k"), F.max("l").alias("shape")).where("k >= 2")
    candidates = {r.partner: r.shape for r in bounded(lines.select("partner", "shape"))}
    fills, passing, changes = None, [], []
    while True:
        before = spark.createDataFrame([(w,) for w in sorted(known.names())], "word string")
        role = {r.word: r.role for r in bounded(score(found, words, before))}
        every, old = known.names() | role.keys(), known
        known = replace(known, given=set(known.given), family=set(known.family))
        for word in role:
            # A name written together with a prefix isn't another name.
            if not any(word[k:] in every and all(c in PREFIXES for c in word[:k]) for k in (1, 2)):
                getattr(known, role[word]).add(word)
        if known.names() == old.names() and (fills is not None or not candidates):
            break
        changed = settle(later_scan(texts, folding, old, known, candidates if fills is None else {}), "changes")
        changes.append(changed)
        fills = changed.where("kind = 'fill'") if fills is None else fills
        both = found.unionByName(changed.where("kind <> 'fill'"))
        passing.append(found)
        found = settle(both.where("kind in ('pos', 'given', 'family')").groupBy("kind", "word", "partner", "l", "r").agg(F.sum("n").alias("n")).where("n <> 0"), "windows")
    names = known.names()
    known.towns = {t for t in known.towns if names.isdisjoint(t.split(" "))}  # what follows a house number may also be a name
    if fills is not None:
        given = spark.createDataFrame([(w, 1) for w in sorted(known.given)], "word string, known int")
        by_template = fills.join(given, "word", "left").groupBy("partner").agg(F.count_distinct(F.when(F.col("known") == 1, F.col("word"))).alias("k"), (F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("part"))
        known.templates = {r.partner: candidates[r.partner] for r in bounded(by_template.where((F.col("k") >= PARTNERS) & (F.col("part") >= 0.3)).select("partner"))}
    release(found, *passing, *changes)
    return known, folding


def check_digit(digits: str) -> bool:
    """Whether the last of nine digits is the Israeli check digit of the others."""
    total = 0
    for i, d in enumerate(map(int, digits)):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Finder:
    """Finds the identifiers of a folded text with what is known."""

    def __init__(self, known: Known) -> None:
        self.known, self.all = known, known.names()
        self.names_ = Names(self.all)
        self.shapes_ = Shapes(known.templates) if known.templates else None
        self.bare = Words(known.streets) if known.streets and known.towns else None
        self.word = re.compile(r"[^\W\d_]+")

    def town(self, low: str, at: int, shape: re.Pattern[str] = TOWN, text: str = "") -> int:
        """The end of a known town (and its post code) that follows, or -1."""
        if m := shape.match(text or low, at):
            for end in sorted({m.end(), *(m.start(1) + x.start() for x in re.finditer(r"[ ]", m[1]))}, reverse=True):
                if low[m.start(1) : end] in self.known.towns:
                    code = POSTCODE.match(low, end)
                    return code.end() if code else end
        return -1

    def addresses(self, text: str, low: str) -> Iterator[tuple[str, int, int]]:
        for m in ADDRESS.finditer(low) if any(w in low for w in STREET_WORDS) else ():
            # One word after a street word names a street; more words only if that name was learned.
            if " " in m[2] and m[2] not in self.known.streets or m[1] == "דרך" and m[2] not in self.known.streets:
                continue
            end = REST.match(low, m.end()).end()
            yield "address", m.start(1), max(end, self.town(low, end))
        # A street that was learned, without its street word, counts before a house number and a town that was learned.
        done = 0
        for a, b in sorted(self.bare.found(low), key=lambda x: (x[0], -x[1])) if self.bare else ():
            if a >= done and (m := HOUSE.match(low, b)) and not (a and (low[a - 1] == "'" or "א" <= low[a - 1] <= "ת")):
                done = m.end()
                if (far := self.town(low, REST.match(low, m.end()).end())) > 0:
                    yield "address", a, far
        for m in ENGLISH.finditer(text) if text != low else ():
            yield "address", m.start(), max(m.end(), self.town(low, m.end(), ENGLISH_TOWN, text))

    def emails(self, low: str) -> Iterator[tuple[str, int, int]]:
        """From every sign for "at" back to the beginning of the mailbox name."""
        for m in AT.finditer(low):
            at = m.start()
            while at and low[at - 1] == " ":
                at -= 1
            while at and low[at - 1] in MAILBOX:
                at -= 1
            while at < m.start() and not low[at].isalnum():
                at += 1
            if found := EMAIL.match(low, at):
                yield "email", at, found.end()

    def shapes(self, low: str) -> Iterator[tuple[str, int, int, str]]:
        """(kind, start, end, digits) of every number: phone and idnum by shape and check digit, nine digits that fail it, and what else there is."""
        zones = [(z.start(), min(z.end() + 2, len(low))) for z in ZONE.finditer(low)]
        for a, b in zones:
            seen = []
            for m in PHONE.finditer(low, a, b):
                seen.append((m.start(), m.end()))
                yield "phone", m.start(), m.end(), re.sub(r"\D", "", m[0])
            for m in NINE.finditer(low, a, b):
                digits = re.sub(r"\D", "", m[1])
                seen.append(m.span(1))
                yield "idnum" if check_digit(digits) else "nine", m.start(1), m.end(1), digits
            if not seen and (m := NUMBER.search(low, a, b)):
                yield "other", m.start(), m.end(), re.sub(r"\D", "", m[0])

    def numbers(self, low: str) -> Iterator[tuple[str, int, int]]:
        found = list(self.shapes(low))
        for kind, a, b, _ in found:
            if kind == "phone":
                yield kind, a, b
        for kind, a, b, digits in found:
            if kind == "idnum" and not (self.known.no_id_labels and label(low, a) in self.known.no_id_labels):
                yield kind, a, b
            elif kind == "other" and 7 <= len(digits) <= 15 and self.known.phone_labels and label(low, a) in self.known.phone_labels:
                yield "phone", a, b

    def names(self, text: str, low: str) -> Iterator[tuple[str, int, int]]:
        given, family = self.known.given, self.known.family
        # The document's words that are names; only lines that have one of them are looked at word by word.
        hits = self.names_.among(set(self.word.findall(low)))
        if not hits:
            return
        lines: dict[int, bool] = {}
        for w in hits:
            of_family, at = anchored(w, family), low.find(w)
            while at >= 0:
                base = low.rfind("\n", 0, at) + 1
                lines[base] = lines.get(base, False) or of_family
                end = low.find("\n", at)
                at = low.find(w, end) if end >= 0 else -1
        for base, of_family in sorted(lines.items()):
            end = low.find("\n", base)
            line = low[base:] if end < 0 else low[base:end]
            # But for the lone names of whole lines every name has a family name in it.
            if of_family:
                spans = [(m.group(), base + m.start(), base + m.end()) for m in self.word.finditer(line)]
                yield from self.in_line(low, text, spans, given, family)
            for _, filler, i, tokens in self.shapes_.fillers(line) if self.shapes_ else ():
                if filler in given and sum(t in hits for t in tokens) == 1:
                    end = base + [m.end() for m in TOKEN.finditer(line)][i]
                    yield "name", end - len(filler), end
                    break

    def in_line(self, low: str, text: str, spans: list, given: set[str], family: set[str]) -> Iterator[tuple[str, int, int]]:
        n, done = len(spans), -1
        gap = lambda i: low[spans[i][2] : spans[i + 1][1]] if i + 1 < n else "\n"

        def whole_family(i: int) -> int:
            """The last word of the family name at i, which may be double."""
            return i + 1 if gap(i) == "-" and spans[i + 1][0] in family else i

        def initial(i: int) -> bool:
            w, a, b = spans[i]
            mark = low[b : b + 1]
            return len(w) == 1 and (mark == "'" and "א" <= w <= "ת" or mark == "." and "A" <= text[a] <= "Z")

        for i, (w, a, _) in enumerate(spans):
            if i <= done:
                continue
            hebrew_initial = len(w) <= 2 and (len(w) == 1 or w[0] in PREFIXES) and "א" <= w[-1] <= "ת" and gap(i) in ("' ", "'")
            latin_initial = (len(w) == 1 or len(w) == 2 and w[0] in PREFIXES) and gap(i) in (". ", ".") and "A" <= text[a + len(w) - 1] <= "Z"
            if (hebrew_initial or latin_initial) and i + 1 < n and spans[i + 1][0] in family:
                done = whole_family(i + 1)
                yield "name", a + len(w) - 1, spans[done][2]
                continue
            if not anchored(w, self.all):
                continue
            if (k := stem(w, given)) >= 0:
                j = i
                while j + 1 < n and j < i + 2 and (gap(j) == " " and spans[j + 1][0] in given and spans[j + 1][0] not in family or gap(j) == " " and initial(j + 1)):
                    j += 1
                if gap(j) in (" ", ". ", "' ") and j + 1 < n and spans[j + 1][0] in family and (gap(j) == " " or initial(j)):
                    done = whole_family(j + 1)
                    yield "name", a + k, spans[done][2]
                    continue
            if (k := stem(w, family)) >= 0:
                j = whole_family(i)
                if gap(j) == " " and j + 1 < n and (spans[j + 1][0] in given or initial(j + 1) and gap(j + 1).startswith("'")):
                    done = j + 1
                    while gap(done) == " " and done + 1 < n and done < j + 2 and spans[done + 1][0] in given:
                        done += 1
                    yield "name", a + k, spans[done][2]

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in the folded text; of overlapping ones the first kind listed here stands."""
        low = lowered(text)
        found: list[tuple[str, int, int]] = []
        taken = bytearray(len(low) + 1)

        def take(items: Iterator[tuple[str, int, int]]) -> None:
            for kind, a, b in items:
                # An address reaches as far as nothing else stands in it.
                if kind == "address" and (other := taken.find(1, a + 1, b)) > 0 and not taken[a] and any(c.isdigit() for c in low[a:other]):
                    b = a + len(low[a:other].rstrip(" ,"))
                if taken.find(1, a, b) < 0:
                    taken[a:b] = b"\1" * (b - a)
                    found.append((kind, a, b))

        take(self.emails(low))
        take(self.numbers(low))
        take(self.addresses(text, low))
        take(self.names(text, low))
        return sorted(found, key=lambda x: x[1])


def _runner(documents: DataFrame, known: Known, folding: Folding, redact: bool) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast((known, folding))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, folding = shared.value
        finder = Finder(known)
        for b in batches:
            row, kinds, start, end, texts = [], [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                parts, last = [], 0
                if text:
                    found = finder.find(folded(folding, text))
                    places = fold(folding, text)[1] if found else None
                    for k, x, y in found:
                        x, y = (x, y) if places is None else (places[x], places[y - 1] + 1)
                        if redact:
                            parts += (text[last:x], PLACEHOLDERS[k])
                            last = y
                        else:
                            row.append(r)
                            kinds.append(k)
                            start.append(x)
                            end.append(y)
                if redact:
                    texts.append(None if text is None else "".join(parts) + text[last:])
            if redact:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(kinds, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "pii_kind", "start_pos", "end_pos"])

    return documents.select("doc_id", "text").mapInArrow(go, f"doc_id {kind}, text string" if redact else f"doc_id {kind}, pii_kind string, start_pos int, end_pos int")


def identifiers(documents: DataFrame, known: Known, folding: Folding) -> DataFrame:
    """``(doc_id, pii_kind, start_pos, end_pos)``: every identifier, in code points of the stored text."""
    return _runner(documents, known, folding, False)


def redacted(documents: DataFrame, known: Known, folding: Folding) -> DataFrame:
    """``(doc_id, text)``: the texts with a typed placeholder for each identifier."""
    return _runner(documents, known, folding, True)
