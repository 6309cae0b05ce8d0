"""Boolean full-text search: clauses are ANDed, alternatives inside a clause ORed, negatives excluded.

Two forms with the same answers: `matches` is a filter over the text columns (one scan, no shuffle); `search_tokens`
and `matching_ids` work on a stored token table, which is the form for repeated searches over large tables.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as TX
from .keyed import computed

FIELDS = ["title", "company", "location", "department", "city", "region", "country"]
SUBSTRING_FIELDS = ["title", "company", "location", "department", "city", "region"]


@dataclass(frozen=True)
class Term:
    """A word (matches as a prefix), a quoted phrase or a place (both match whole tokens)."""

    text: str
    kind: str = "word"

    def alternatives(self, gazetteer=None) -> list[tuple[str | None, str, bool]]:
        """(field or None, phrase, prefix?) for the term and what it also stands for."""
        if self.kind == "phrase":
            return [(None, self.text, False)]
        prefix = self.kind == "word" and len(re.sub(r"\W", "", self.text)) >= 2
        more = gazetteer.expand(self.text)[1:] if gazetteer else []
        return [(None, self.text, prefix), *[(field, phrase, False) for field, phrase in more]]


@dataclass(frozen=True)
class Search:
    """`all_of` holds clauses, each a list of alternatives; `none_of` holds excluded terms."""

    all_of: tuple[tuple[Term, ...], ...] = ()
    none_of: tuple[Term, ...] = ()

    @classmethod
    def of(cls, all_of: Sequence = (), none_of: Sequence = (), gazetteer=None) -> Search:
        """Strings become words, `"quoted"` strings phrases; a clause may be one term or a list of alternatives.

        Strings of two or three words that name a place the gazetteer knows count as one place.
        """
        def term(x) -> Term:
            if isinstance(x, Term):
                return x
            if len(x) >= 2 and x[0] == x[-1] == '"':
                return Term(x[1:-1].strip(), "phrase")
            if " " in x.strip():
                place = gazetteer is not None and len(x.split()) <= 3 and gazetteer.is_known_place(x)
                return Term(x.strip(), "place" if place else "phrase")
            return Term(x.strip())

        def wordy(terms):
            return tuple(t for t in terms if re.search(r"\w", t.text))

        clauses = [wordy(map(term, c if isinstance(c, (list, tuple)) else [c])) for c in all_of]
        return cls(tuple(c for c in clauses if c), wordy(map(term, none_of)))


def _plain(c: Column) -> Column:
    """Lower case without accents, punctuation kept."""
    source, target, _ = TX._fold_map()
    marks = "".join(ch for ch in source[len(target):] if unicodedata.combining(ch))
    return F.translate(c, source[:len(target)] + marks, target)


def tokens(c: Column) -> Column:
    """Text as its tokens (runs of letters and digits, case and accents removed), one space around each."""
    spaced = F.regexp_replace(_plain(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def token_list(phrase: str) -> list[str]:
    """`tokens` for a search phrase."""
    text = "".join(ch for ch in unicodedata.normalize("NFKD", phrase) if not unicodedata.combining(ch)).lower()
    return [t for t in re.split(r"[\W_]+", text) if t]


def _phrase_in(padded: Column, phrase: str, prefix: bool) -> Column:
    words = token_list(phrase)
    if not words:
        return F.lit(False)
    return F.contains(padded, F.lit(" " + " ".join(words) + ("" if prefix else " ")))


def _either(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def matches(search: Search, padded: dict[str, Column], gazetteer=None) -> Column:
    """The search as one condition; `padded` maps field names to columns made with `tokens`."""
    def term(t: Term) -> Column:
        return _either([_phrase_in(padded[field], phrase, prefix)
                        for column, phrase, prefix in t.alternatives(gazetteer)
                        for field in ([column] if column else padded) if field in padded])

    wanted = [_either([term(t) for t in clause]) for clause in search.all_of]
    return reduce(lambda a, b: a & b, [*wanted, *[~term(t) for t in search.none_of]], F.lit(True))


def search(df: DataFrame, query: Search, fields: Sequence[str] = FIELDS, gazetteer=None) -> DataFrame:
    """Rows matching the search in the given text columns."""
    padded = {f: f"__t_{f}" for f in fields}
    work = computed(df, **{name: tokens(F.col(f)) for f, name in padded.items()})
    hit = matches(query, {f: F.col(name) for f, name in padded.items()}, gazetteer)
    return work.filter(hit).select(*df.columns)


def substring_condition(query: Search, fields: Sequence[str] = SUBSTRING_FIELDS, gazetteer=None,
                        country: str | None = "country") -> Column:
    """Search by substrings of the joined fields instead of tokens."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f), F.lit("")) for f in fields]))

    def term(t: Term) -> Column:
        parts = [F.coalesce(F.col(country) == phrase, F.lit(False)) if column == "country" and country
                 else F.contains(text, F.lit(phrase.lower()))
                 for column, phrase, _ in t.alternatives(gazetteer) if column is None or country]
        return _either(parts)

    wanted = [_either([term(t) for t in clause]) for clause in query.all_of]
    return reduce(lambda a, b: a & b, [*wanted, *[~term(t) for t in query.none_of]], F.lit(True))


# ---- the stored token table ----

def search_tokens(df: DataFrame, key: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Inverted index: key, field, pos, term. Write it bucketed or sorted by term."""
    arrays = F.array(*[F.struct(F.lit(f).alias("field"), F.split(F.trim(tokens(F.col(f))), " ").alias("terms")) for f in fields])
    per_field = df.select(key, F.inline(arrays))
    return per_field.select(key, "field", F.posexplode("terms").alias("pos", "term")).filter(F.col("term") != "")


def refresh_tokens(index: DataFrame, changed: DataFrame, key: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """The index after an update: only the changed rows are tokenised again."""
    kept = index.join(changed.select(key), key, "left_anti")
    return kept.unionByName(search_tokens(changed, key, fields))


def _slots(key: str, phrases: Sequence[tuple[int, str | None, list[str], bool]]) -> list[tuple[Column, Column]]:
    """(does a token fill this place of a phrase, which place it is) for every word of the phrases (mark, field, words, prefix?).

    A place names the phrase, where in which field it would start, and the word. Several tokens must follow each other
    inside one field; a single word needs no place in the text, so all its tokens of a key are one.
    """
    slots = []
    for number, (mark, field, words, prefix) in enumerate(phrases):
        for i, word in enumerate(words):
            test = F.startswith("term", F.lit(word)) if prefix and i == len(words) - 1 else F.col("term") == word
            test = test if field is None else test & (F.col("field") == field)
            alone = len(words) == 1
            place = F.struct(F.lit(number).alias("phrase"), F.lit(mark).alias("mark"), F.lit(len(words)).alias("size"), F.lit(i).alias("word"),
                             F.lit(None).cast("string").alias("field") if alone else F.col("field").alias("field"),
                             F.lit(0).alias("start") if alone else (F.col("pos") - i).cast("int").alias("start"))
            slots.append((test if alone else test & F.col(key).isNotNull(), place))
    return slots


def matching_ids(index: DataFrame, query: Search, key: str, everything: DataFrame | None = None, gazetteer=None) -> DataFrame:
    """Keys matching the search. `everything` (the keys) is needed only when there are exclusions and no clause.

    All words, those of phrases too, are found in one pass over the index; each key then carries one mark per clause.
    """
    clauses = [*query.all_of, *[(t,) for t in query.none_of]]
    n = len(query.all_of)
    phrases = []
    for mark, clause in enumerate(clauses):
        for t in clause:
            for field, phrase, prefix in t.alternatives(gazetteer):
                words = token_list(phrase)
                if words:
                    phrases.append((mark, field, words, prefix))
    if not phrases:
        found = None
    else:
        slots = _slots(key, phrases)
        places = F.array_compact(F.array(*[F.when(test, place) for test, place in slots]))
        tokens_ = index.filter(_either([test for test, _ in slots])).select(key, F.inline(places))
        # equal places of a key are combined before the shuffle: of a long text only the words of phrases are sent
        words_ = tokens_.groupBy(key, "phrase", "mark", "size", "field", "start", "word").agg(F.lit(1).alias("__one")).drop("__one")
        whole = words_.groupBy(key, "phrase", "mark", "size", "field", "start").agg(F.count("*").alias("__n")).filter(F.col("__n") == F.col("size"))
        found = whole.groupBy(key).agg(
            *[F.bool_or(F.col("mark") == m).alias(f"m{m}") for m in range(len(clauses))])
    if n == 0:
        if found is None:
            return everything.select(key)
        excluded = found.filter(_either([F.col(f"m{m}") for m in range(len(clauses))]))
        return everything.select(key).join(excluded.select(key), key, "left_anti")
    if found is None:
        raise ValueError("the search has no searchable term")
    keep = reduce(lambda a, b: a & b, [F.col(f"m{m}") for m in range(n)])
    for m in range(n, len(clauses)):
        keep = keep & ~F.col(f"m{m}")
    return found.filter(keep).select(key)
