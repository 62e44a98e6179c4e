"""Fixed-width feature vectors from semi-structured values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from ..functions.arrays import l2_normalised, once, softmax

_EMPTY = "array<double>"


@dataclass(frozen=True)
class Slot:
    """One part of the vector: its name, kind (number, map, person_map, structs, embedding), width, and what the kind needs."""

    name: str
    kind: str
    size: int
    most: float | None = None
    fields: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    alias: tuple[str, ...] = ()


def first_alias(entry: DataFrame, slot: Slot) -> Column:
    """The first value that an alias, or else the slot's name, has in the entry or in its custom_text (a struct or a map); the entry's own fields go first."""
    inner = entry.schema["custom_text"].dataType if "custom_text" in entry.columns else None
    found = []
    for a in (*slot.alias, slot.name):
        if a in entry.columns:
            found.append(F.col(f"`{a}`"))
        if isinstance(inner, StructType) and a in inner.names:
            found.append(F.col("custom_text").getField(a))
        elif isinstance(inner, MapType):
            found.append(F.try_element_at("custom_text", F.lit(a)))
    return F.coalesce(*found) if found else F.lit(None)


def clamped(c: Column, most: float | None) -> Column:
    """One number: null and NaN are 0, never above most."""
    x = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.array(x if most is None else F.least(x, F.lit(float(most))))


def padded(v: Column, size: int, name: str = "vector") -> Column:
    """v with zeros up to size; a longer one is an error."""
    v = F.coalesce(v, F.array().cast(_EMPTY))
    too_long = F.raise_error(F.concat(F.lit(f"{name}: length "), F.size(v).cast("string"), F.lit(f" exceeds {size}")))
    return F.when(F.size(v) > size, too_long.cast(_EMPTY)).otherwise(F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(v), F.lit(0)))))


def multi_hot(m: Column, categories: tuple[str, ...]) -> Column:
    """The map's weights in the order of the categories; others are 0."""
    return F.array(*[F.coalesce(F.try_element_at(m, F.lit(c)).cast("double"), F.lit(0.0)) for c in categories]) if categories else F.array().cast(_EMPTY)


def as_map(value: Column, kind: str) -> Column:
    """A weighted map from a string, an array of strings, a map or an array of maps (its first)."""
    if kind == "string":
        return F.when(value != "", F.create_map(value, F.lit(1.0)))
    if kind == "array<string>":
        kept = F.array_distinct(F.filter(value, lambda x: x != ""))
        return F.map_from_arrays(kept, F.transform(kept, lambda x: F.lit(1.0)))
    m = F.try_element_at(value, F.lit(1)) if kind.startswith("array") else value
    return F.map_filter(m, lambda k, v: k != "")


def person_blocks(maps: Column, categories: tuple[str, ...]) -> Column:
    """One block of weights for each map of an array."""
    return F.flatten(F.transform(F.coalesce(maps, F.array().cast("array<map<string,double>>")), lambda m: multi_hot(m, categories)))


def flat_structs(items: Column, fields: tuple[str, ...]) -> Column:
    """The fields of each struct, one after the other; null is 0."""
    return F.flatten(F.transform(items, lambda s: F.array(*[F.coalesce(s[f].cast("double"), F.lit(0.0)) for f in fields])))


def gather(v: Column, kept: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(i) for i in kept]), lambda i: F.get(v, i))


def interactions(v: Column) -> Column:
    """Products of elements i < j, in order."""
    def products(x: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 2, F.lit(0))), lambda i: F.transform(F.slice(x, i + 2, F.greatest(F.size(x) - i - 1, F.lit(0))), lambda y: F.get(x, i) * y))
        return F.flatten(rows)

    return once(v, products)


def slot_vector(entry: DataFrame, slot: Slot) -> Column:
    """The padded vector of one slot."""
    value = first_alias(entry, slot)
    if slot.kind == "number":
        v = clamped(value, slot.most)
    elif slot.kind == "map":
        v = multi_hot(value, slot.categories)
    elif slot.kind == "person_map":
        v = person_blocks(value, slot.categories)
    elif slot.kind == "structs":
        v = flat_structs(value, slot.fields)
    elif slot.kind == "embedding":
        v = l2_normalised(value)
    else:
        raise ValueError(f"unknown slot kind: {slot.kind}")
    return padded(v, slot.size, slot.name)


def vectorise(entries: DataFrame, id_col: str, slots: list[Slot]) -> DataFrame:
    """(id, vector): all slots side by side, in one projection."""
    return entries.select(id_col, F.concat(*[slot_vector(entries, s) for s in slots]).alias("vector"))


def layout(slots: list[Slot]) -> list[tuple[int, str, int]]:
    """(feature index, slot, place in the slot)."""
    out, at = [], 0
    for s in slots:
        out += [(at + i, s.name, i) for i in range(s.size)]
        at += s.size
    return out


def vocabulary(entries: DataFrame, map_col: str, most: int = 100) -> DataFrame:
    """(category, idx): the map's keys, trimmed, by frequency, then name; blanks and "unknown" are none. More than `most` (the slot's width) are an error."""
    c = entries.select(F.explode(F.map_keys(map_col)).alias("k")).select(F.trim("k").alias("category")).where("category not in ('', 'unknown')").groupBy("category").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "category").limit(most + 1).withColumn("idx", F.row_number().over(W.orderBy(F.desc("n"), "category")) - 1)
    over = F.raise_error(F.lit(f"{map_col}: more than {most} categories"))
    return top.select("category", F.when(F.col("idx") >= most, over.cast("int")).otherwise(F.col("idx")).alias("idx"))


def slot_growth(entries: DataFrame, array_col: str, unit: int) -> DataFrame:
    """The width that the largest array needs."""
    return entries.agg((F.coalesce(F.max(F.size(F.coalesce(array_col, F.expr("array()")))), F.lit(0)) * unit).alias("size"))


def complete_ids(split: DataFrame, slots: int) -> DataFrame:
    """Ids that have a value in all slots."""
    return split.groupBy("id").agg(F.count_distinct("vector_name").alias("n")).where(F.col("n") == slots).select("id")


def unprocessed(files: DataFrame, split: DataFrame, slots: int) -> DataFrame:
    return files.join(complete_ids(split, slots), "id", "left_anti")


def without_slot(entries: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Entries that slot `name` does not have yet."""
    return entries.join(split.where(F.col("vector_name") == name).select("id"), "id", "left_anti")


def valid_split(split: DataFrame) -> DataFrame:
    return split.where(F.col("raw").isNotNull() & (F.size("vector") > 0))


def join_slots(split: DataFrame, names: list[str]) -> DataFrame:
    """(id, vector) of the ids that have every slot; the slots' arrays side by side; of repeated rows the largest array. One shuffle by id."""
    firsts = [F.max(F.when(F.col("vector_name") == n, F.col("vector"))).alias(f"_{i}") for i, n in enumerate(names)]
    g = split.where(F.col("vector_name").isin(names)).groupBy("id").agg(*firsts)
    every = [F.col(f"_{i}") for i in range(len(names))]
    ok = every[0].isNotNull()
    for c in every[1:]:
        ok = ok & c.isNotNull()
    return g.where(ok).select("id", F.concat(*every).alias("vector"))


def with_scores(vectors: DataFrame, scores: DataFrame, strict: bool = False) -> DataFrame:
    """(id, vector, score); ids without a vector are dropped, or with strict raise an error when read."""
    if not strict:
        return vectors.join(scores.select("id", "score"), "id")
    j = scores.select("id", "score").join(vectors, "id", "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col("id").cast("string")))
    return j.withColumn("vector", F.when(F.col("vector").isNull(), missing.cast("array<double>")).otherwise(F.col("vector")))


def expected_class(probabilities: Column) -> Column:
    """The mean class of a distribution over 0 .. k-1, scaled to 0 .. 1."""

    def mean(p: Column) -> Column:
        total = F.aggregate(F.zip_with(p, F.sequence(F.lit(0), F.size(p) - 1), lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
        return total / F.greatest(F.size(p) - 1, F.lit(1))

    return once(probabilities, mean)


def kept_by_gain(gains: DataFrame, part: float = 0.99) -> DataFrame:
    """(feature, gain): features with a gain, largest first, until `part` of the total is reached; one at least."""
    from .stats import cumulative

    g = gains.where("gain > 0")
    sums = g.groupBy("gain").agg(F.sum("gain").alias("s"), F.count("*").alias("n")).withColumn("less", -F.col("gain"))
    total = g.agg(F.sum("gain").alias("total"), F.max("gain").alias("top"))
    before = cumulative(sums, "less", "s").withColumn("before", F.col("upto") - F.col("s")).select("gain", "before", "n")
    w = W.partitionBy("gain").orderBy("feature")  # equal gains by feature
    g = g.join(before, "gain").crossJoin(F.broadcast(total)).withColumn("place", F.row_number().over(w))
    upto = (F.col("before") + F.col("place") * F.col("gain")) / F.col("total")
    return g.where((upto <= part) | ((F.col("gain") == F.col("top")) & (F.col("place") == 1))).select("feature", "gain")
