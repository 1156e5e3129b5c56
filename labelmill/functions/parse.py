"""Ingredient lists with nested brackets, as Arrow-batched pandas functions.

Brackets of any depth aren't regular, so these three read characters in Python; each call
handles one label, and Spark does the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_ITEM = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("detail", T.StringType()), ("origin", T.StringType()), ("percentage", T.DoubleType()), ("raw", T.StringType()), ("sub_ingredients", T.ArrayType(T.StringType())))]))
TREE_ITEM = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("raw", T.StringType()), T.StructField("sub_ingredients", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("percentage", T.DoubleType())])))]))
ADDITIVE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("name", "category", "raw", "match_type")]))


# Bracket pairs of printed labels, and what shares and notes look like.
OPENING, CLOSING = "(（[", ")）]"
PERCENT = re.compile(r"(\d+[.,]?\d*)\s*%")
ALLERGEN_NOTE = re.compile(r"\[?알레르기\s*유발물질\s*[:]\s*[^\]]*\]?")
STARRED_NOTE = re.compile(r"\*[^*]*\*")


def items_with_brackets(text: str, opening: str, closing: str) -> list[tuple[str, list[tuple[int, int]], bool]]:
    """(item, bracket spans in it, whether its last bracket stays open) between commas outside brackets, in one pass.

    A stray closing bracket counts nothing; blank items are left out.
    """
    found, spans, depth, start, opened = [], [], 0, 0, 0
    for mark in re.finditer("[,%s%s]" % (re.escape(opening), re.escape(closing)), text + ","):
        at, last = mark.start(), mark.end() > len(text)
        if mark[0] in opening:
            opened = opened if depth else at
            depth += 1
        elif mark[0] in closing:
            if depth == 1:
                spans.append((opened - start, at - start))
            depth = max(0, depth - 1)
        elif last or not depth:
            if depth:
                spans.append((opened - start, at - start))
            if text[start:at].strip():
                found.append((text[start:at], spans, depth > 0))
            spans, start = [], at + 1
    return found


def _percent(text: str) -> float | None:
    found = PERCENT.search(text)
    return float(found[1].replace(",", ".")) if found else None


def _head(text: str, stop: str) -> str:
    """What stands before the first of these characters, a digit or a percent sign."""
    return re.split(f"[{re.escape(stop)}0-9%]", text, maxsplit=1)[0].strip()


def label_items(text: str | None) -> list[dict]:
    """Items of a label's ingredient list with name, detail, origin, percentage and sub-ingredients.

    The detail is what stands in an item's first bracket that closes. Its parts are sub-ingredients
    if there are several: two characters or more, and no origin (ending in 산).
    """
    text = re.sub(r"[,，\s]*(함유|포함|사용)\s*$", "", " ".join((text or "").split()))
    text = ALLERGEN_NOTE.sub("", text).translate(str.maketrans("{}", "()"))
    out = []
    for item, spans, is_open in items_with_brackets(text, OPENING, CLOSING):
        closed = spans[: len(spans) - is_open]
        detail = item[closed[0][0] + 1 : closed[0][1]] if closed else ""
        parts = [_head(x.strip(), "(（[:") for x in detail.split(",")] if "," in detail else []
        raw, origin = item.strip(), re.search(r"[(（]([^)）]*산)[)）]", item)
        out.append({
            "name": _head(raw, "(（[") or raw,
            "detail": detail,
            "origin": origin[1] if origin else None,
            "percentage": _percent(raw),
            "raw": raw,
            "sub_ingredients": [x for x in parts if len(x) >= 2 and not x.endswith("산")],
        })
    return out


def ingredient_tree(text: str | None) -> list[dict]:
    """Items of a registered ingredient list: name, raw (what stands in its bracket) and sub-ingredients.

    Curly, corner and full-width round brackets count as round, square ones as letters; allergen
    and starred notes go first. A bracket holds the sub-ingredients of the name before it, split
    at all commas; one without a name before it is text. What follows a bracket is an item of its
    own. A bracket that stays open reaches to the end; its parts keep their percentages in the name.
    """
    text = " ".join((text or "").split()).translate(str.maketrans("{}【】（）", "()()()"))
    text = STARRED_NOTE.sub("", ALLERGEN_NOTE.sub("", text))
    out = []
    for item, spans, is_open in items_with_brackets(text, "(", ")"):
        name, at = "", 0
        for k, (first, end) in enumerate(spans):
            name, inner, at = name + item[at:first], item[first + 1 : end], end + 1
            still_open = is_open and k == len(spans) - 1
            if not name.strip():
                name += inner + ")" * (not still_open)
                continue
            parts = [p.strip() for p in inner.split(",") if p.strip()]
            subs = [{"name": p, "percentage": None} if still_open else {"name": PERCENT.sub("", p, count=1).strip(), "percentage": _percent(p)} for p in parts]
            if parts or not still_open:
                out.append({"name": name.strip(), "raw": inner.strip(), "sub_ingredients": subs})
            name = ""
        name = (name + item[at:]).strip()
        if name:
            out.append({"name": name, "raw": "", "sub_ingredients": []})
    return out


class Dictionary:
    """Words with their categories, in order of priority, and an automaton that finds all of them in one pass over a text.

    Of a word that repeats the first place and the last category count; blank words are left out.
    """

    def __init__(self, words: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.category = {w: c for w, c in words if w}
        self._words, self._automaton = list(self.category), ahocorasick.Automaton()
        for place, word in enumerate(self._words):
            self._automaton.add_word(word, place)
        if self._words:
            self._automaton.make_automaton()

    def inside(self, text: str) -> list[str]:
        """The words that stand in a text, in order of priority."""
        return [self._words[k] for k in sorted({k for _, k in self._automaton.iter(text)})] if self._words and text else []


def additives_of(items: list[dict], words: Dictionary) -> list[dict]:
    """Additives that items name, each once, where it comes first.

    Every name of an item claims one entry: itself, or else the first entry inside it that is not
    found yet; then the item's detail claims all entries inside it. Names of one character claim none.
    """
    category, found = words.category, {}
    claims = [
        (item["raw"], how, options, many)
        for item in items
        for how, options, many in [
            *((f"{kind}({place})", [name] if kind == "exact" else words.inside(name), False)
              for place, name in [("main", item["name"].strip()), *(("sub", x.strip()) for x in item["sub_ingredients"])] if len(name) > 1
              for kind in ["exact" if name in category else "partial"]),
            ("detail_scan", words.inside(item["detail"] or ""), True),
        ]
    ]
    for raw, how, options, many in claims:
        fresh = [w for w in options if w not in found]
        found |= {w: (raw, how) for w in (fresh if many else fresh[:1])}
    return [{"name": w, "category": category[w], "raw": raw, "match_type": how} for w, (raw, how) in found.items()]


@F.pandas_udf(LABEL_ITEM)
def parse_label_items(text: pd.Series) -> pd.Series:
    return text.map(label_items)


@F.pandas_udf(TREE_ITEM)
def parse_ingredient_tree(text: pd.Series) -> pd.Series:
    return text.map(ingredient_tree)


def read_labels(dictionary: list[tuple[str, str]]):
    """A pandas function from label text to its items and additives, with one parse; the dictionary is made ready once a task."""

    @F.pandas_udf(T.StructType([T.StructField("items", LABEL_ITEM), T.StructField("additives", ADDITIVE)]))
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Dictionary(dictionary)
        for texts in batches:
            items = [label_items(x) for x in texts]
            yield pd.DataFrame({"items": items, "additives": [additives_of(x, words) for x in items]})

    return read


def identify_additives(dictionary: list[tuple[str, str]]):
    """A function from label text to the additives of ``dictionary``, (word, category) in order of priority."""
    return lambda text: read_labels(dictionary)(text)["additives"]


def ingredient_names(tree):
    """All names of a parsed tree: each parent, then its sub-ingredients."""
    return F.flatten(F.transform(tree, lambda x: F.concat(F.array(x["name"]), F.transform(x["sub_ingredients"], lambda s: s["name"]))))
