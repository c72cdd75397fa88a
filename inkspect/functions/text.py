"""Column helpers over text: tokens, sentences, character classes, run lengths.

Everything here stays inside the JVM and inside one row, so no helper shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode white space plus the four ASCII separators U+001C to U+001F.
WS = r"(?U)[\s\x1c-\x1f]"
NOT_WS = r"(?U)[^\s\x1c-\x1f]"
SENTENCE_BREAK = r"[.!?]+"
AFTER_SENTENCE = r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, WS + "+"), "")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), rf"{WS}+\z", "")


def pieces(text: Column) -> Column:
    """Text between sentence ends, blank pieces included."""
    return F.split(text, SENTENCE_BREAK)


def sentence_lengths(text: Column) -> Column:
    """Words per non-blank sentence."""
    return F.filter(F.transform(pieces(text), n_tokens), lambda n: n > 0)


def sentence_openers(text: Column) -> Column:
    """First word of every non-blank sentence."""
    return F.array_remove(
        F.transform(pieces(text), lambda s: F.regexp_extract(s, NOT_WS + "+", 0)), ""
    )


def total(values: Column) -> Column:
    """Sum of an integer array as a long."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v)


def total_squares(values: Column) -> Column:
    return F.aggregate(
        values, F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v.cast("long")
    )


def population_variance(n: Column, s: Column, s2: Column) -> Column:
    """Variance from integer moments; one division, so no cancellation. 0 below two values."""
    spread = (n * s2 - s * s).cast("double")
    return F.when(n > 1, spread / (n * n)).otherwise(F.lit(0.0))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))
    return gone if len(needle) == 1 else (gone / len(needle)).cast("int")


def in_class(text: Column, char_class: str) -> Column:
    """Characters in a class that covers few of the text's characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def outside_class(text: Column, char_class: str) -> Column:
    """Characters outside a class that covers most of the text's characters."""
    return F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def quoted(words: list[str]) -> str:
    """A word list as SQL string literals."""
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def members(words: str, lexicon: list[str]) -> Column:
    """How many entries of a token column belong to a word list."""
    return F.expr(f"size(filter({words}, w -> w in ({quoted(lexicon)})))")


def phrases_present(text: str, phrases: list[str]) -> Column:
    """How many of the distinct phrases occur somewhere in a text column."""
    return F.expr(f"size(filter(array({quoted(phrases)}), p -> contains({text}, p)))")


def shouted(words: Column) -> Column:
    """Tokens of two or more characters whose letters are all capitals."""
    return F.size(
        F.filter(
            words, lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)
        )
    )


def syllables(lowered: Column, words: Column, closing: str = "") -> Column:
    """Syllables of a whole text, given its lower-cased form and lower-cased tokens.

    Per word: vowel groups, less one for a final ``e`` when there are several,
    at least one. Summed over the text that is (all vowel groups) - (words with
    several groups ending in ``e``) + (words without a vowel), so the vowel
    groups take one scan of the text. ``closing`` lists punctuation that does
    not count as part of the word end.
    """
    groups = F.regexp_count(lowered, F.lit("[aeiouy]+"))

    def silent(word: Column) -> Column:
        bare = F.rtrim(word, F.lit(closing)) if closing else word
        return F.endswith(bare, F.lit("e")) & bare.rlike("[aeiouy][^aeiouy]")

    voiceless = F.regexp_count(
        lowered,
        F.lit(r"(?U)(?<![^\s\x1c-\x1f])[^aeiouy\s\x1c-\x1f]++(?![^\s\x1c-\x1f])"),
    )
    return groups - F.size(F.filter(words, silent)) + voiceless


def run_starts(ordered: Column) -> Column:
    """Start positions of the runs of equal neighbours in a sorted array column.

    Pass a column, not an expression: the array is indexed once per element.
    """
    n = F.size(ordered)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
    )


def gaps(starts: Column, n: Column) -> Column:
    """Differences between neighbouring run starts, the last one measured to ``n``."""
    following = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(n))
    return F.zip_with(starts, following, lambda a, b: b - a)


def plogp(counts: Column) -> Column:
    """Sum of n * log2(n) over an array of counts."""
    return F.aggregate(counts, F.lit(0.0), lambda a, n: a + n * F.log2(n.cast("double")))
