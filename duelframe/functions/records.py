"""Values of free-form JSON records: nested parsing, parameters as strings, weighted names, text embeddings."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType

from .arrays import l2_normalised, once


def unfolded(value: Any) -> Any:
    """value with every string that is itself a JSON object or array replaced by what it holds, at any depth.

    A string that only looks like one ("{red|blue}") stays as it is.
    """
    if isinstance(value, dict):
        return {k: unfolded(v) for k, v in value.items()}
    if isinstance(value, list):
        return [unfolded(v) for v in value]
    if isinstance(value, str) and (t := value.strip()) and t[0] + t[-1] in ("{}", "[]"):
        try:
            return unfolded(json.loads(value))
        except ValueError:
            return value
    return value


@F.pandas_udf(StringType())
def unfold_json(entry: pd.Series) -> pd.Series:
    """unfolded() of JSON text, as JSON text with sorted keys; null for null and for text that isn't JSON."""

    def one(text):
        try:
            return None if text is None else json.dumps(unfolded(json.loads(text)), sort_keys=True, ensure_ascii=False)
        except ValueError:
            return None

    return entry.map(one).astype(object)


def found(value: Any, key: str) -> Any:
    """The first value under key, at the top or below it, a level's own fields first."""
    if isinstance(value, dict):
        if value.get(key) is not None:
            return value[key]
        value = list(value.values())
    if isinstance(value, list):
        for v in value:
            if (hit := found(v, key)) is not None:
                return hit
    return None


@F.pandas_udf(StringType())
def prompt_of(entry: pd.Series) -> pd.Series:
    """The first positive_prompt in JSON text; null if there is none."""

    def one(text):
        try:
            hit = found(unfolded(json.loads(text)), "positive_prompt") if text is not None else None
        except ValueError:
            return None
        return hit if hit is None or isinstance(hit, str) else json.dumps(hit)

    return entry.map(one).astype(object)


def own_prompt(value: Any) -> str | None:
    """The first positive_prompt that is text and not empty, of an object or of the objects in it, its own before theirs."""
    if not isinstance(value, dict):
        return None
    mine = value.get("positive_prompt")
    if isinstance(mine, str) and mine:
        return mine
    return next(filter(None, map(own_prompt, value.values())), None)


@F.pandas_udf(StringType())
def prompt_tags(entry: pd.Series) -> pd.Series:
    """own_prompt() of JSON text."""
    return entry.map(lambda text: None if text is None else own_prompt(json.loads(text))).astype(object)


def labelled(text: str) -> tuple[str, float]:
    """("name", 1.2) of "(Name:1.2)"; the weight is 1 where what follows the last colon is no number."""
    plain = re.sub(r"[()]", "", text)
    name, number = " ".join(plain.partition(":")[0].lower().split()), plain.rpartition(":")[2].strip()
    return name, float(number) if ":" in plain and _NUMBER.fullmatch(number) else 1.0


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?", re.IGNORECASE)


def _number(x: Any) -> bool:
    return isinstance(x, (int, float))


def _loras(value: Any, record: dict[str, Any]) -> Iterator[str]:
    """"lora:name_weight" for each name; a single name has the record's lora_weight."""
    if isinstance(value, str):
        value = {value: record.get("lora_weight", 0)}
    for name, weight in value.items() if isinstance(value, dict) else ():
        if name:
            yield f"lora:{labelled(str(name))[0]}_{round(float(weight) if _number(weight) else 0, 2)}"


def _downwards(key: str, value: Any) -> Iterator[str]:
    return _values(key, -abs(float(value))) if _number(value) else iter(())


def _values(key: str, value: Any) -> Iterator[str]:
    """"name:value" for a value, or for each item of a list; an item [name, weight] has both."""
    name, weight = labelled(key)
    for item in value if isinstance(value, (list, tuple)) else [value]:
        match item:
            case float():
                shown = str(round(item * weight, 2))
            case str() | int():
                shown = str(item)
            case [head, *rest]:
                own, factor = labelled(str(head))
                tail = rest[0] if rest else ""
                shown = f"{own}_{round(tail * weight * factor, 2) if _number(tail) else tail}"
            case _:
                continue
        yield f"{name}:{shown}".strip()


#: What a field gives; all others give their values.
_FIELDS: dict[str, Callable[[str, Any], Iterator[str]]] = {"lora": lambda *_: iter(()), "lora_weight": lambda *_: iter(()), "clip_skip": _downwards}


def record_parameters(record: dict[str, Any]) -> list[str]:
    """"name:value" strings of a record's fields, loras first.

    Floats are multiplied by the weight in the field's name and rounded to two places; lists give one string
    for each item, items [name, weight] one with both; clip_skip counts downwards; a lora is its name and weight.
    Nulls and empty strings give nothing.
    """
    fields = ((k, v) for k, v in record.items() if v is not None and v != "")
    return [*_loras(record.get("lora"), record), *chain.from_iterable(_FIELDS.get(k.lower(), _values)(k, v) for k, v in fields)]


@F.pandas_udf(ArrayType(StringType()))
def parameter_strings(entry: pd.Series) -> pd.Series:
    """record_parameters() of JSON text; null for null, empty for text that isn't an object."""

    def one(text):
        if text is None:
            return None
        try:
            record = json.loads(text)
        except ValueError:
            return []
        return record_parameters(record) if isinstance(record, dict) else []

    return entry.map(one)


@F.pandas_udf(MapType(StringType(), DoubleType()))
def lora_map(entry: pd.Series) -> pd.Series:
    """The weighted names in a record's lora field: an object as it is, a list's items at 1, a name at lora_weight (or 1)."""

    def one(text):
        try:
            record = json.loads(text) if text is not None else None
        except ValueError:
            return None
        if not isinstance(record, dict):
            return None
        value, weight = record.get("lora"), record.get("lora_weight")
        if isinstance(value, dict):
            return {str(k): float(v) for k, v in value.items() if _number(v)}
        if isinstance(value, list):
            return {str(x): 1.0 for x in value if x}
        return {value: 1.0 if weight is None else float(weight)} if isinstance(value, str) and value else None

    return entry.map(one)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A stand-in for a sentence model: signed counts of hashed words, to unit length; null and empty text is all zeros.

    Built-in expressions only: the words' signed places are summed place by place.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    places = F.transform(F.transform(words, F.md5), lambda h: F.struct(F.pmod(F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), F.lit(size)).alias("i"), F.when(F.substring(h, 5, 1) < "8", 1.0).otherwise(-1.0).alias("s")))

    def summed(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(p, lambda x: x["i"] == k), F.lit(0.0), lambda a, x: a + x["s"]))

    return l2_normalised(once(once(places, summed), lambda v: v))
