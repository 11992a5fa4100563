"""Text normalisation and segmentation as native column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and characters that decide results.
CODE_PATTERN = r"\w\d+.\d+"
LATIN_PATTERN = r"\s\w+"
SUFFIX_PATTERN = "([病塞症痛])"
SPLIT_PATTERN = r"[()（），,。.;；、：°\s+*\[\]?？]"
LOCATION_PATTERN = "[上下左右正前后侧][间壁室]+"
NEGATION_PATTERN = "[不非]"
IN_SCOPE = ("I20", "I21", "I22", "I23", "I24", "I25")


def expand_acronyms(text: Column, pairs: Column) -> Column:
    """Replace each ``short`` of ``pairs`` (array of structs) by its ``long``, in order, forward only."""
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["short"], p["long"]))


def clean_spaces(text: Column) -> Column:
    """``&nbsp;`` and the ideographic space become a space."""
    return F.translate(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), "　", " ")


def strip_codes(text: Column) -> Column:
    return F.regexp_replace(text, CODE_PATTERN, "")


def strip_latin(text: Column) -> Column:
    return F.regexp_replace(text, LATIN_PATTERN, "")


def space_suffixes(text: Column) -> Column:
    return F.regexp_replace(text, SUFFIX_PATTERN, "$1 ")


def split_segments(text: Column) -> Column:
    return F.split(text, SPLIT_PATTERN)


def drop_short(segments: Column, least: int = 2) -> Column:
    return F.filter(segments, lambda x: F.length(x) >= least)


def merge_short(segments: Column, least: int = 3) -> Column:
    """Append segments shorter than ``least`` to the one before.

    Leading short ones are held (the last of them wins); in the end the held one is appended to the second result, or
    is a segment of its own where there is only one or none.
    """
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["out"])
        short = F.length(x) < least
        out = F.when(short & (n > 0), F.concat(F.slice(acc["out"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(acc["out"], -1), x)))).when(short, acc["out"]).otherwise(F.concat(acc["out"], F.array(x)))
        return F.struct(out.alias("out"), F.when(short & (n == 0), x).otherwise(acc["held"]).alias("held"))

    # element_at over an empty array gives null without ANSI mode; the guard below keeps ANSI mode safe too
    def safe(acc: Column, x: Column) -> Column:
        padded = F.struct(F.when(F.size(acc["out"]) > 0, acc["out"]).otherwise(F.array(F.lit(""))).alias("out"), acc["held"].alias("held"))
        some = step(padded, x)
        none = F.struct(F.when(F.length(x) < least, acc["out"]).otherwise(F.array(x)).alias("out"), F.when(F.length(x) < least, x).otherwise(acc["held"]).alias("held"))
        return F.when(F.size(acc["out"]) > 0, some).otherwise(none)

    def finish(acc: Column) -> Column:
        n = F.size(acc["out"])
        second = F.transform(acc["out"], lambda x, i: F.when(i == 1, F.concat(x, acc["held"])).otherwise(x))
        return F.when(acc["held"] == "", acc["out"]).when(n >= 2, second).otherwise(F.concat(acc["out"], F.array(acc["held"])))

    return F.aggregate(segments, start, safe, finish)


def segments(text: Column, acronyms: Column | None = None, merge: bool = False) -> Column:
    """The whole chain from a raw mention to its segments."""
    if acronyms is not None:
        text = expand_acronyms(text, acronyms)
    out = drop_short(split_segments(space_suffixes(strip_latin(strip_codes(clean_spaces(text))))))
    return merge_short(out) if merge else out


def negation(text: Column) -> Column:
    return text.rlike(NEGATION_PATTERN).cast("int")


def locations(text: Column, pattern: str = LOCATION_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def strip_locations(text: Column, pattern: str = LOCATION_PATTERN) -> Column:
    return F.regexp_replace(text, pattern, "")


def location_share(mine: Column, other: Column) -> Column:
    """The share of ``mine``, repeats counted, that occurs in ``other``; null for no location."""
    return F.size(F.filter(mine, lambda x: F.array_contains(other, x))) / F.nullif(F.size(mine), F.lit(0))


def chars(text: Column) -> Column:
    """The set of characters."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))


def covers(target: Column, pattern: Column) -> Column:
    """``pattern`` is a substring of ``target``, or all its characters occur there."""
    return F.contains(target, pattern) | (F.size(F.array_except(chars(pattern), chars(target))) == 0)


def l3(code: Column) -> Column:
    return F.substring(code, 1, 3)


def l4(code: Column) -> Column:
    return F.substring(code, 1, 5)


def before_dot(code: Column) -> Column:
    return F.substring_index(code, ".", 1)


def in_scope(code: Column, prefixes: tuple[str, ...] = IN_SCOPE) -> Column:
    return l3(code).isin(*prefixes)


def syllables(text: Column, table: Column) -> Column:
    """Each character by ``table`` (a map); characters that aren't in it pass through."""
    return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda c: F.coalesce(table[c], c))


def longest_match(lexicon: set[str]):
    """A tokenizer over a supplied lexicon: at each place the longest word, else a run of Latin letters and digits, else a character."""
    most = max(map(len, lexicon), default=1)

    def cut(text: str) -> list[str]:
        out, at = [], 0
        while at < len(text):
            word = next((text[at : at + n] for n in range(min(most, len(text) - at), 1, -1) if text[at : at + n] in lexicon), None)
            if word is None:
                stop = at
                while stop < len(text) and text[stop].isascii() and text[stop].isalnum():
                    stop += 1
                word = text[at : max(stop, at + 1)]
            out.append(word)
            at += len(word)
        return [w for w in out if not w.isspace()]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda x: None if x is None else cut(x))

    return tokens
