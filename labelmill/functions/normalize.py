"""Text normalisers, as column expressions. Each one is a join key of its own; null gives ''."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The legal forms, plant and branch words, packaging words and quantities that
# the normal forms leave out. Where one word begins another the longer one stands first, as
# Java takes the first that fits.
COMPANY_FORMS = ["유한책임회사", "주식회사", "유한회사", "합자회사", "합명회사", "(주)", "㈜"]
CORPORATE_INDICATORS = ["유한책임회사", "주식회사", "유한회사", "(주)", "㈜"]
COOPERATIVE_FORMS = ["사회적협동조합", "농업회사법인", "영농조합법인", "협동조합"]
SITE_PATTERNS = ["제?\\d+공장", "[가-힣]+공장", "[가-힣]+지점", "[가-힣]+센터"]
PACKAGING_WORDS = ["페트", "캔", "파우치", "컵", "병", "봉지", "봉", "팩", "번들", "기획", "증정", "리필", "대용량", "미니", "멀티팩", "세트", "묶음", "박스"]
PACKAGING_WORDS_APART = ["페트", "캔", "파우치", "컵", "병", "봉", "봉지", "팩", "번들", "기획", "증정", "리필", "대용량", "미니", "소용량", "멀티팩", "세트", "묶음", "박스", "입", "개입", "PET", "CAN"]
QUANTITY = "(?i)\\d+[.,]?\\d*\\s*(ml|l|g|kg|oz|리터|밀리리터|그램|킬로그램)"
SEPARATORS = "[\\s()（）\\[\\]【】,，·•_\\-]+"
PUNCTUATION = "[\\s()（）\\[\\]【】,，·•\\-_×x*+&/]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _drop(c: Column, *patterns: str) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def _literal(words: list[str]) -> str:
    return "|".join(w.replace("(", "\\(").replace(")", "\\)") for w in words)


def product_name(c: Column) -> Column:
    """Without white space, round, square and corner brackets and separators, lower-cased."""
    return F.lower(_drop(_text(c), SEPARATORS))


def strip_corporate(c: Column) -> Column:
    """A maker without its legal form and white space; case is kept."""
    return _drop(_text(c), _literal(CORPORATE_INDICATORS), "\\s+")


def deep(c: Column) -> Column:
    """The core of a product name: no round brackets, quantities, packaging words anywhere, trailing digits, punctuation."""
    return F.lower(_drop(_text(c), "\\([^)]*\\)", QUANTITY, _literal(PACKAGING_WORDS), "\\d+\\s*$", PUNCTUATION))


def deep_words(c: Column) -> Column:
    """As ``deep``, but what stands in any kind of bracket goes, a packaging word only where a word of
    ASCII letters and digits begins before it and ends behind it, and a trailing number, decimals
    included, only after white space."""
    letter = "[A-Za-z0-9_]"
    korean, latin = ([w for w in PACKAGING_WORDS_APART if w.isascii() == ascii_] for ascii_ in (False, True))
    # An edge of an ASCII word: before and behind a Korean word there must be such a letter, at a Latin one none.
    apart = f"(?i)(?<={letter})({_literal(korean)})(?={letter})|(?<!{letter})({_literal(latin)})(?!{letter})"
    brackets = ["\\([^)]*\\)", "（[^）]*）", "\\[[^\\]]*\\]", "【[^】]*】"]
    return F.lower(_drop(_text(c), *brackets, QUANTITY, "\\s+\\d+[.,]?\\d*\\s*$", apart, PUNCTUATION))


def name(c: Column) -> Column:
    """Words of a name: brackets dropped, separators to spaces, quantities dropped, lower-cased."""
    x = F.regexp_replace(F.trim(_text(c)), "\\s+", " ")
    x = F.regexp_replace(_drop(x, "[()（）\\[\\]【】]"), "[,，·•]", " ")
    x = _drop(x, "\\d+\\s*[gG][rR]?", "\\d+\\s*[mM][lL]", "\\d+\\s*[kK][gG]", "\\d+\\s*[lL]")
    return F.lower(F.trim(F.regexp_replace(x, "\\s+", " ")))


def manufacturer(c: Column) -> Column:
    """A maker without the commonest legal forms and white space, lower-cased."""
    return F.lower(_drop(_text(c), "\\(주\\)", "주식회사", "㈜", "\\s+"))


def maker(c: Column, parity: bool = False) -> Column:
    """A maker without legal forms, cooperatives, plants, branches and white space, lower-cased.

    With parity every 주 goes, as an unescaped bracket pair made it in earlier data.
    """
    forms = _literal(COMPANY_FORMS) + ("|주" if parity else "")
    return F.lower(_drop(_text(c), f"\\s*({forms})\\s*", _literal(COOPERATIVE_FORMS), *SITE_PATTERNS, "\\s+"))


def key(c: Column) -> Column:
    """Without white space, lower-cased."""
    return F.lower(_drop(_text(c), "\\s+"))


def half_width(c: Column) -> Column:
    """Full-width ASCII (U+FF01 to U+FF5E) as plain ASCII."""
    return F.translate(c, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))


def folded_key(c: Column) -> Column:
    """``key`` of the half-width form."""
    return key(half_width(_text(c)))


def blank_to_null(c: Column) -> Column:
    """Trimmed; null if nothing stays."""
    return F.nullif(F.trim(c), F.lit(""))


def corrected(c: Column, pairs: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after replacing each wrong form in turn, and the pairs that applied as 'wrong→right'.

    Later pairs see what earlier ones made.
    """
    applied, running = [], _text(c)
    for wrong, right in pairs:
        applied.append(F.when(F.contains(running, F.lit(wrong)), F.lit(f"{wrong}→{right}")))
        running = F.replace(running, F.lit(wrong), F.lit(right))
    return running, F.array_compact(F.array(*applied))


def humanised(c: Column, words: dict[str, str]) -> Column:
    """Code words such as 'sat_fat' replaced by their labels, as whole words only."""
    return reduce(lambda x, w: F.regexp_replace(x, f"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])", words[w]), sorted(words), c)
