"""Plans for files: discovery, sidecars, duplicates, orphans, tiers and sync. A plan is rows; moving is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RANKING, RATING
from ..functions.records import prompt_tags

# Fields that an imported sidecar loses.
DROPPED = ("score", "score_modifier", "volatility", "confidence", "image", "comparison_count", "rating_mu", "rating_sigma")
IMAGE_TYPES = ("png", "jpg", "jpeg", "webp", "gif", "bmp")


def path_parts(path: Column) -> dict[str, Column]:
    """dir, stem and ext of a path."""
    name = F.element_at(F.split(path, "/"), -1)
    return {"dir": F.regexp_replace(path, "/[^/]*$", ""), "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))}


def paired(files: DataFrame, path: str = "path") -> DataFrame:
    """(dir, stem, image, sidecar): full outer by folder and stem; null where one is missing."""
    f = files.withColumns(path_parts(F.col(path)))
    keys = ["dir", "stem"]
    images = f.where(F.col("ext").isin(*IMAGE_TYPES)).select(*keys, F.col(path).alias("image"))
    return images.join(f.where("ext = 'json'").select(*keys, F.col(path).alias("sidecar")), keys, "full_outer")


def orphan_plan(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """(path, action, target): unpaired files go to the root, pairs at the root to the default tier, unpaired ones at the root are deleted."""
    p = paired(files, path)
    whole, top = F.col("image").isNotNull() & F.col("sidecar").isNotNull(), F.col("dir") == root
    action = F.when(whole & top, "move").when(~whole & top, "delete").when(~whole, "move")
    folder = F.when(whole, F.lit(f"{root}/scored_{RANKING.default_score}")).otherwise(F.lit(root))
    p = p.withColumn("action", action).where("action is not null").withColumn("path", F.explode(F.array_compact(F.array("image", "sidecar"))))
    return p.select("path", "action", F.when(F.col("action") == "move", F.concat(folder, F.lit("/"), F.element_at(F.split("path", "/"), -1))).alias("target"))


def duplicate_plan(files: DataFrame) -> DataFrame:
    """(path, action, keeper) from (path, hash, modified): copies of a content merge into the newest; same stem, other content is renamed."""
    f = files.withColumns(path_parts(F.col("path")))
    newest = W.partitionBy("hash").orderBy(F.desc("modified"), "path")
    f = f.withColumn("keeper", F.first("path").over(newest)).withColumn("_n", F.row_number().over(newest))
    kept = f.where("_n = 1").withColumn("_s", F.row_number().over(W.partitionBy("stem").orderBy(F.desc("modified"), "path")))
    kept = kept.select("path", F.when(F.col("_s") > 1, F.lit("rename")).otherwise(F.lit("keep")).alias("action"), "keeper", F.when(F.col("_s") > 1, F.concat("stem", F.lit("_"), F.col("_s").cast("string"))).otherwise(F.col("stem")).alias("stem"))
    return kept.union(f.where("_n > 1").select("path", F.lit("merge"), "keeper", "stem"))


def _unit(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def tier(score: Column) -> Column:
    """The folder's tenth: the score within 0 .. 1, rounded down."""
    return F.floor(_unit(score) * 10) / 10


def split_tiers(files: DataFrame, path: str = "path") -> DataFrame:
    """(tier): the folders of a tenth that have folders of hundredths already."""
    found = F.regexp_extract(path, r"(?:^|/)scored_([01]\.\d)/scored_[01]\.\d\d/", 1)
    return files.select(found.alias("t")).where("t <> ''").select(F.col("t").cast("double").alias("tier")).distinct()


def tier_plan(images: DataFrame, threshold: int = RANKING.subfolder_threshold, split: DataFrame | None = None) -> DataFrame:
    """(filename, folder): by tenth; in folders of at least threshold images, and in those split already (`split`: tier), by hundredth, but never in that of 1.0."""
    t = images.withColumn("tier", tier(F.col("score")))
    big = t.groupBy("tier").agg((F.count("*") >= threshold).alias("parted"))
    if split is not None:
        big = big.join(split.select("tier", F.lit(True).alias("_split")), "tier", "left").select("tier", (F.col("parted") | F.col("_split").isNotNull()).alias("parted"))
    one = F.concat(F.lit("scored_"), F.format_number("tier", 1))
    folder = F.when(F.col("parted") & (F.col("tier") < 1.0), F.concat(one, F.lit("/scored_"), F.format_number(F.floor(_unit(F.col("score")) * 100) / 100, 2))).otherwise(one)
    return t.join(F.broadcast(big), "tier").select("filename", folder.alias("folder"))  # one row for each of eleven tiers


_FIELDS = "map<string,variant>"


def clean_sidecar(entry: Column, filename: Column | None = None, score: float = RANKING.default_score) -> Column:
    """JSON text of a sidecar without what an earlier rating has left, and with a fresh rating, its file's name and its prompt.

    A single inner object that has a prompt is unwrapped; if nothing is left, the first inner object is cleaned in its place. Values keep their types. Text
    that is no JSON object, and null, give the fresh fields alone.
    """
    m = F.coalesce(F.from_json(entry, _FIELDS), F.from_json(F.lit("{}"), _FIELDS))

    def inner(v: Column) -> Column:
        return F.from_json(F.to_json(v), _FIELDS)

    def kept(fields: Column) -> Column:
        return F.map_filter(fields, lambda k, v: ~k.isin(*DROPPED))

    only = inner(F.get(F.map_values(m), F.lit(0)))
    data = F.when((F.size(m) == 1) & F.coalesce(F.map_contains_key(only, F.lit("positive_prompt")), F.lit(False)), only).otherwise(m)
    first = F.get(F.filter(F.map_values(data), lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))), F.lit(0))
    base = F.when(F.size(kept(data)) > 0, kept(data)).otherwise(F.coalesce(kept(inner(first)), F.from_json(F.lit("{}"), _FIELDS)))
    tags = prompt_tags(F.to_json(data))
    fresh = {
        "score": F.parse_json(F.lit(str(round(score, 3)))), "rating_mu": F.parse_json(F.lit(str(RATING.mean))), "rating_sigma": F.parse_json(F.lit(repr(RATING.deviation))),
        "comparison_count": F.parse_json(F.lit("0")), "comparison_history": F.parse_json(F.lit("[]")), "prompt_tags": F.coalesce(tags.cast("variant"), F.parse_json(F.lit("null"))),
    }
    out = F.map_concat(F.map_filter(base, lambda k, v: ~k.isin(*fresh)), F.create_map(*[x for k, v in fresh.items() for x in (F.lit(k), v)]))
    if filename is not None:
        named = F.map_concat(F.map_filter(out, lambda k, v: k != "filename"), F.create_map(F.lit("filename"), filename.cast("variant")))
        out = F.when(F.coalesce(filename != "", F.lit(False)), named).otherwise(out)
    return F.to_json(out)


def unwrap(entry: Column) -> Column:
    """The inner object of {timestamp: {...}}: a JSON object of fewer than five keys without a score, whose first value is an object."""
    keys = F.json_object_keys(entry)
    first = F.get(F.map_values(F.from_json(entry, "map<string,string>")), F.lit(0))
    wrapped = (F.size(keys) < 5) & ~F.array_contains(keys, "score") & F.startswith(F.coalesce(first, F.lit("")), F.lit("{"))
    return F.when(F.coalesce(wrapped, F.lit(False)), first).otherwise(entry)


def has_fields(entry: Column, fields: list[str]) -> Column:
    """All fields are keys of the JSON object, or of its custom_text object."""
    keys = F.coalesce(F.json_object_keys(entry), F.array().cast("array<string>"))
    inner = F.coalesce(F.json_object_keys(F.get_json_object(entry, "$.custom_text")), F.array().cast("array<string>"))
    return F.size(F.array_except(F.array(*[F.lit(f) for f in fields]), F.concat(keys, inner))) == 0


def sync_plan(images: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Images whose sidecar (filename, score, comparison_count) is missing or differs; unchanged ones are skipped."""
    s = sidecars.select("filename", F.col("score").alias("_s"), F.col("comparison_count").alias("_c"), F.lit(True).alias("_k"))
    j = images.join(s, "filename", "left")
    same = F.col("_k").isNotNull() & F.col("score").eqNullSafe(F.col("_s")) & F.col("comparison_count").eqNullSafe(F.col("_c"))
    return j.where(~same).select(*images.columns)


def rebuild(history: DataFrame) -> DataFrame:
    """Comparisons from (filename, history) arrays: both sides' records of one comparison become one row."""
    h = history.select("filename", F.explode("history").alias("h"))
    a, b = F.least("filename", F.col("h.other")), F.greatest("filename", F.col("h.other"))
    rows = h.select(F.col("h.comparison_id").alias("id"), a.alias("filename_a"), b.alias("filename_b"), F.when(F.col("h.winner"), F.col("filename")).otherwise(F.col("h.other")).alias("winner"), F.col("h.timestamp").alias("timestamp"), F.col("h.weight").alias("weight"), F.col("h.transitive_depth").alias("transitive_depth"))
    return rows.dropDuplicates(["filename_a", "filename_b", "winner", "timestamp", "weight", "transitive_depth", "id"])
