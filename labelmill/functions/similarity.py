"""Trigram similarity and what is decided by it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelmill.functions import extract, normalize

NAME_SHARE, MAKER_SHARE = 0.7, 0.3
LEAST_MAKER = 0.3


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the text with two spaces in front and one behind; empty for '' or null."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def word_trigrams(c: Column) -> Column:
    """Distinct trigrams of each letter-or-digit word, lower-cased, each word padded alike."""
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def word_similarity(a: Column, b: Column) -> Column:
    return jaccard(word_trigrams(a), word_trigrams(b))


def length_threshold(c: Column, short: float = 0.8, other: float = 0.7, length: int = 5) -> Column:
    """Short names must agree more."""
    return F.when(F.length(c) <= length, F.lit(short)).otherwise(F.lit(other))


def composite(name_a: Column, maker_a: Column, name_b: Column, maker_b: Column) -> Column:
    """0.7 of the names' similarity and 0.3 of the makers'; 0 if volumes or makers clearly differ."""
    names = similarity(normalize.name(name_a), normalize.name(name_b))
    m_a, m_b = normalize.manufacturer(maker_a), normalize.manufacturer(maker_b)
    makers = similarity(m_a, m_b)
    v_a, v_b = extract.volume(name_a), extract.volume(name_b)
    other_size = F.coalesce(v_a != v_b, F.lit(False))
    other_maker = (F.length(m_a) > 1) & (F.length(m_b) > 1) & (makers < LEAST_MAKER)
    return F.when(other_size | other_maker, F.lit(0.0)).otherwise(names * NAME_SHARE + makers * MAKER_SHARE)


def same_maker(a: Column, b: Column) -> Column:
    """Equal normal forms, or one inside the other; empty ones never."""
    return F.coalesce((a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a)), F.lit(False))
