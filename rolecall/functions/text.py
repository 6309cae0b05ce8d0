"""Text expressions: cleaning, folding, slugs, names, whole words. All stay inside the JVM."""
from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

WS = r"(?U)[\s\x1c-\x1f]+"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS, " "))


def clean(c: Column) -> Column:
    """Collapsed text, NULL when nothing is left."""
    return F.nullif(collapse(c), F.lit(""))


def clean_list(items: Column) -> Column:
    """Array of texts -> cleaned, repeats dropped in order, joined with ' | '; NULL when empty."""
    kept = F.filter(F.transform(items, clean), lambda x: x.isNotNull())
    return F.nullif(F.array_join(F.array_distinct(kept), " | "), F.lit(""))


_IGNORED = str.maketrans("", "", ".'’")
_HANGUL = range(0xAC00, 0xD7A4)  # syllables are taken apart by their rule below, not by a table


def _folded(text: str) -> str:
    text = "".join(x for x in unicodedata.normalize("NFKD", text) if not unicodedata.combining(x))
    return text.casefold().translate(_IGNORED)


@lru_cache(maxsize=1)
def _fold_map() -> tuple[str, str, dict[str, str]]:
    """(from, to) for `translate`, and the characters that fold to several; all of Unicode but private use and Hangul."""
    source, target, deleted, several = [], [], [], {}
    for code in (*range(0xD800), *range(0xF900, 0xF0000)):
        char = chr(code)
        base = char if code in _HANGUL else _folded(char)
        if base == char:
            continue
        if base == "":
            deleted.append(char)
        elif len(base) == 1:
            source.append(char)
            target.append(base)
        else:
            several[char] = base
    return "".join(source + deleted), "".join(target), several


def _class_of(chars) -> str:
    """A pattern for one of the characters."""
    codes, runs = sorted(map(ord, chars)), []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\x{{{low:X}}}-\\x{{{high:X}}}" for low, high in runs) + "]"


def _spelled_out(c: Column, several: dict[str, str]) -> Column:
    """Text with every character that folds to several written as those; syllables as their two or three letters."""
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    first, second, last = ("".join(map(chr, range(low, low + n))) for low, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def letters(char: Column) -> Column:
        at = F.ascii(char) - 0xAC00
        final = F.when(at % 28 > 0, F.substr(F.lit(last), (at % 28).cast("int"), F.lit(1))).otherwise("")
        syllable = F.concat(F.substr(F.lit(first), F.floor(at / 588).cast("int") + 1, F.lit(1)),
                            F.substr(F.lit(second), F.floor(at % 588 / 28).cast("int") + 1, F.lit(1)), final)
        return (F.when(char.between("가", "힣"), syllable).when(char > "~", F.coalesce(F.try_element_at(table, char), char))
                .otherwise(char))

    return F.array_join(F.transform(F.split(c, ""), letters), "")


# Of the characters that fold to several, those that occur in ordinary text; they go by plain replacement.
_COMMON = "ßẞﬁﬂ…™№"


def fold(c: Column) -> Column:
    """Case-, accent- and punctuation-insensitive form used for every lookup of names and places."""
    source, target, several = _fold_map()
    text = c
    for char in _COMMON:
        text = F.replace(text, F.lit(char), F.lit(several.get(char, "")))
    rare = {char: base for char, base in several.items() if char not in _COMMON}
    beyond = "".join(char for char in rare if char < "Ā")
    # most texts end at the first test, which needs no long list of ranges
    seldom = text.rlike(f"[{beyond}\\x{{100}}-\\x{{10FFFF}}]") & text.rlike(_class_of([*rare, *map(chr, _HANGUL)]))
    return collapse(F.translate(F.when(seldom, _spelled_out(text, rare)).otherwise(text), source, target))


def fold_text(text: str) -> str:
    """`fold` for a Python value: used once per filter argument or dimension row, never per data row."""
    return re.sub(r"\s+", " ", _folded(text)).strip()


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """`fold` by Python's own decomposition, to check the other by."""
    return texts.map(fold_text, na_action="ignore")


def slug(c: Column) -> Column:
    """Runs of anything but a-z and 0-9 become '-', ends stripped."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def title_case(c: Column) -> Column:
    """Every run of letters starts with a capital and goes on in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                             F.lower(F.substr(r, F.lit(2))))), "")


def title_from_path(path: Column) -> Column:
    """A readable title from the last step of a URL path; NULL when it is shorter than three characters."""
    last = F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)
    words = F.trim(F.regexp_replace(F.regexp_replace(last, r"[-_]?\d{4,}$", ""), "[-_]+", " "))
    return F.when(F.length(words) >= 3, title_case(words))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def names_match(name: Column, slug_: Column) -> Column:
    """Loose company-name check: one contains the other; names under three characters must be equal."""
    a, b = alnum(F.coalesce(name, F.lit(""))), alnum(F.coalesce(slug_, F.lit("")))
    short = (F.length(a) < 3) | (F.length(b) < 3)
    return F.when(short, (a == b) & (a != "")).otherwise(F.contains(a, b) | F.contains(b, a))


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def word_pattern(word: str) -> str:
    """Whole word or phrase, any case; a word character is a letter, digit or underscore of any script."""
    return r"(?iU)(?<![\p{L}\p{N}_])" + quote(word) + r"(?![\p{L}\p{N}_])"


def has_word(c: Column, word: str) -> Column:
    return F.coalesce(c.rlike(word_pattern(word)), F.lit(False))


def has_any_word(c: Column, words: list[str]) -> Column:
    """One pass over the text for any of several whole words."""
    if not words:
        return F.lit(False)
    either = "|".join(quote(w) for w in words)
    return F.coalesce(c.rlike(rf"(?iU)(?<![\p{{L}}\p{{N}}_])(?:{either})(?![\p{{L}}\p{{N}}_])"), F.lit(False))


def register_has_word(spark) -> None:
    """`has_word(text, word)` for SQL users, as a SQL function over built-in expressions."""
    spark.sql(r"""
        CREATE OR REPLACE TEMPORARY FUNCTION has_word(t STRING, w STRING) RETURNS BOOLEAN RETURN
        coalesce(regexp_like(t, concat('(?iU)(?<![\\p{L}\\p{N}_])',
                 regexp_replace(w, '([\\\\.^$|?*+()\\[\\]{}])', '\\\\$1'),
                 '(?![\\p{L}\\p{N}_])')), false)""")


# The usual names stand first in the table of all names.
_USUAL_NAMES = "amp lt gt quot nbsp apos copy reg trade hellip middot bull ndash mdash lsquo rsquo ldquo rdquo eacute sol colon comma".split()


@lru_cache(maxsize=1)
def _reference_names() -> tuple[str, str]:
    """Every HTML5 name and its characters as JSON (with ';' where one belongs to it), and a pattern for names without ';'."""
    names = {**{f"{n};": html5[f"{n};"] for n in _USUAL_NAMES}, **html5}
    bare = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
    return json.dumps(names), "^(?:" + "|".join(bare) + ")"


@lru_cache(maxsize=1)
def _windows_characters() -> list[str]:
    """The characters that references to 128..159 stand for: Windows-1252 where it has one, else the code itself."""
    def char(code: int) -> str:
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)
    return [char(code) for code in range(128, 160)]


def _character(code: Column) -> Column:
    """The character of a number in a reference; control codes vanish, numbers that are none give U+FFFD."""
    unknown = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    nothing = (code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF)
               | (code % 65536 >= 0xFFFE))
    windows = F.array(*[F.lit(c) for c in _windows_characters()])
    return (F.when(unknown, F.lit("\ufffd")).when(code.between(128, 159), F.get(windows, (code - 128).cast("int")))
            .when(nothing, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")))


def _decoded(part: Column) -> Column:
    """What follows an '&', its reference undone once; the '&' comes back where none stands."""
    table, bare = _reference_names()
    names = F.from_json(F.lit(table), "map<string,string>")

    def after(reference: Column) -> Column:
        return F.substr(part, F.length(reference) + 1)

    def number(pattern: str, base: int) -> Column:
        digits = F.regexp_extract(part, pattern, 1)
        code = F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("bigint"))  # longer ones are no character
        return F.concat(_character(code), after(F.regexp_extract(part, pattern, 0)))

    whole, short = F.regexp_extract(part, "^[A-Za-z][A-Za-z0-9]{0,31};", 0), F.regexp_extract(part, bare, 0)
    named = F.coalesce(F.when(whole != "", F.concat(F.try_element_at(names, whole), after(whole))),
                       F.when(short != "", F.concat(F.try_element_at(names, short), after(short))))
    undone = (F.when(part.rlike("^#[0-9]"), number("^#0*([0-9]+);?", 10))
              .when(part.rlike("^#[xX][0-9a-fA-F]"), number("^#[xX]0*([0-9a-fA-F]+);?", 16))
              .when(part.rlike("^[A-Za-z]"), named))
    return F.coalesce(undone, F.concat(F.lit("&"), part))


def unescape(c: Column) -> Column:
    """Undo HTML references, each once and from left to right: numeric ones, all names of HTML5, old names without ';'."""
    return F.array_join(F.transform(F.split(c, "&"), lambda part, i: F.when(i == 0, part).otherwise(_decoded(part))), "")


def unescape_markup(c: Column) -> Column:
    """`unescape` behind a cheap test, so that text without a reference is passed through."""
    return F.when(F.contains(c, F.lit("&")), unescape(c)).otherwise(c)


def prepare(c: Column) -> Column:
    """Text in which URLs inside attributes and scripts can be matched: references and JSON-escaped slashes undone."""
    text = unescape_markup(c)
    for escaped in ("\\/", "\\u002F", "\\u002f"):
        text = F.replace(text, F.lit(escaped), F.lit("/"))
    return text


def tidy_city(c: Column) -> Column:
    """A city as written: none with digits or over 60 characters; LONG CAPITALS become Title Case."""
    shouted = (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) > 3)
    return F.when(c.rlike(r"\p{Nd}") | (F.length(c) > 60), F.lit(None).cast("string")).when(
        shouted, title_case(c)).otherwise(c)


def safe_cell(c: Column) -> Column:
    """A leading apostrophe stops spreadsheets from running a cell as a formula."""
    from .vocab import FORMULA_START
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)
