"""Weighted terms of prompts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# Words that carry no meaning alone, and the marks trimmed from terms.
STOPWORDS = ("a", "an", "the", "in", "is", "at", "to", "by", "of")
TRIMMED = " \t\n\r\"'`,;:.!?#<>[]{}()"
IMPLICIT_WEIGHT = 1.1

# How a number is written, and what is replaced in a term, in this order.
_NUMBER = r"\d+\.?\d*"
_REPLACED = ((r"\\", ""), (r"\s+", " "), (r"\|", ""))
_TRAILING_WEIGHT = rf":\s*{_NUMBER}$"
#: Text in parentheses: named with a number behind a colon, or bare.
_WRAPPED = re.compile(rf"\((?:\s*(?P<named>.*?)\s*:\s*(?P<number>{_NUMBER})\s*|(?s:(?P<bare>.*)))\)")


def paren_weight(text: str) -> tuple[str, float]:
    """(content, weight) of "(x:1.5)", of "(x)", which weighs 1.1, or of plain text."""
    m = _WRAPPED.fullmatch(text.strip())
    if m is None:
        return text.strip(), 1.0
    return (m["bare"].strip(), IMPLICIT_WEIGHT) if m["number"] is None else (m["named"].strip(), float(m["number"]))


@lru_cache
def _lexer(splitters: tuple[str, ...]) -> re.Pattern:
    """Finds parentheses, marks, and splitter words that follow a blank or begin the text."""
    marks = "|".join(re.escape(s) for s in splitters if not s.isalnum())
    words = "|".join(re.escape(s) for s in splitters if s.isalnum())
    cuts = [c for c in (marks, rf"(?:\A\s*|\s+)(?:{words})(?![^\W_])" if words else "") if c]
    return re.compile("|".join([r"(?P<open>\()", r"(?P<close>\))", *([f"(?P<cut>{'|'.join(cuts)})"] if cuts else [])]))


def segments(text: str, lexer: re.Pattern) -> Iterator[str]:
    """text cut at marks and words outside of parentheses, and around its outermost parentheses."""
    begin = depth = 0
    for m in lexer.finditer(text):
        if m.lastgroup == "open":
            depth += 1
            if depth > 1:
                continue
            end = after = m.start()
        elif m.lastgroup == "close":
            depth = max(depth - 1, 0)
            end = after = m.end()
        else:
            end, after = m.span()
        if depth == 0 or m.lastgroup == "open":
            yield text[begin:end]
            begin = after
    yield text[begin:]


def weighted(text: str, splitters: tuple[str, ...]) -> Iterator[tuple[str, float]]:
    """Terms with their weights, from left to right.

    A stack holds what is still to be read: a stretch with the weight around it, and whether it may be cut. Parentheses
    with a number set the weight, others multiply it by 1.1 (or set it to 1.1 if there is a colon anywhere inside).
    """
    stack = [(text, 1.0, True)]
    while stack:
        part, weight, whole = stack.pop()
        part = part.strip()
        if len(part) > 1 and _WRAPPED.fullmatch(part):
            content, own = paren_weight(part)
            stack.append((content, own if ":" in part else own * weight, True))
        elif whole:
            stack += [(s, weight, False) for s in reversed(list(segments(part, _lexer(splitters))))]
        elif part:
            yield part, weight


def clean(term: str) -> str:
    for pattern, new in _REPLACED:
        term = re.sub(pattern, new, term)
    return re.sub(_TRAILING_WEIGHT, "", term.strip(TRIMMED)).lower()


def extract(text: str | None, connectors: tuple[str, ...] = ("and", "or"), splitters: tuple[str, ...] = (",", "but", "not")) -> dict[str, list]:
    """terms, raw, filtered_out, stripped and duplicates of a prompt, each (term, weight, place); all empty for null or empty text.

    A term that occurs again keeps its first position in terms, with the largest weight and that one's place; the other goes to duplicates.
    Stopwords that are connectors or splitters are terms.
    """
    out: dict[str, list] = {p: [] for p in _PARTS}
    best: dict[str, tuple[str, float, int]] = {}
    dropped = set(STOPWORDS).difference(connectors, splitters)
    for place, (raw, weight) in enumerate(weighted(text or "", splitters)):
        out["raw"].append((raw, weight, place))
        entry = (clean(raw), weight, place)
        if entry[0] in dropped or not entry[0]:
            out["filtered_out" if entry[0] else "stripped"].append(entry)
        elif (held := best.setdefault(entry[0], entry)) is not entry:
            best[entry[0]], loser = (entry, held) if weight > held[1] else (held, entry)
            out["duplicates"].append(loser)
    out["terms"] = list(best.values())
    return out


TERM = StructType().add("term", StringType()).add("weight", DoubleType()).add("idx", IntegerType())
_PARTS = ("terms", "raw", "filtered_out", "stripped", "duplicates")


@F.pandas_udf(StructType([StructField(p, ArrayType(TERM)) for p in _PARTS]))
def extract_terms(text: pd.Series) -> pd.DataFrame:
    """extract() on a column; prompts that repeat are parsed once a batch."""
    known: dict = {}

    def one(t):
        if t not in known:
            known[t] = {k: [{"term": a, "weight": b, "idx": c} for a, b, c in v] for k, v in extract(t).items()}
        return known[t]

    return pd.DataFrame([one(t) for t in text], columns=list(_PARTS))


def explode_terms(prompts: DataFrame, id_col: str, prompt_col: str) -> DataFrame:
    """(id, term, weight, idx)."""
    out = prompts.select(id_col, F.explode(extract_terms(prompt_col)["terms"]).alias("t"))
    return out.select(id_col, "t.term", "t.weight", "t.idx")


def clean_column(c: Column) -> Column:
    """clean() as built-in expressions."""
    for pattern, new in _REPLACED:
        c = F.regexp_replace(c, pattern, new)
    return F.lower(F.regexp_replace(F.btrim(c, F.lit(TRIMMED)), _TRAILING_WEIGHT, ""))


def weight_columns(c: Column) -> tuple[Column, Column]:
    """paren_weight() as built-in expressions: (content, weight)."""
    s = F.trim(c)
    pattern = rf"^\(\s*(.*?)\s*:\s*({_NUMBER})\s*\)$"
    explicit, plain = s.rlike(pattern), s.startswith("(") & s.endswith(")")
    content = F.when(explicit, F.trim(F.regexp_extract(s, pattern, 1))).when(plain, F.trim(F.substring(s, F.lit(2), F.length(s) - 2))).otherwise(s)
    weight = F.when(explicit, F.regexp_extract(s, pattern, 2).try_cast("double")).when(plain, F.lit(IMPLICIT_WEIGHT)).otherwise(1.0)
    return content, weight


def label_weight(c: Column) -> tuple[Column, Column]:
    """(name, weight) of "name:1.2" without parentheses; the last part is the weight, 1 if there is none."""
    parts = F.split(F.trim(F.regexp_replace(c, r"[()]", "")), ":")
    name = F.lower(F.regexp_replace(F.trim(parts[0]), r"\s+", " "))
    return name, F.when(F.size(parts) > 1, F.element_at(parts, -1).try_cast("double")).otherwise(1.0)


@F.udtf(returnType=TERM)
class TermTable:
    """TABLE(terms(prompt)) in SQL."""

    def eval(self, prompt: str) -> Iterator[tuple[str, float, int]]:
        yield from extract(prompt)["terms"]
