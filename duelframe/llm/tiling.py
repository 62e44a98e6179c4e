"""Benchmark decontamination by greedy string tiling (operator 2)."""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_has, mix64, read, scratch, slices, text_bytes

_BASE = 0x9E3779B97F4A7C15
_MARKS = string.punctuation + "«»“”„’‘…–—¿¡"


def normal(chunk: bytes) -> str:
    return chunk.decode("utf-8", "replace").lower().strip(_MARKS)


_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of size ids, by differences of one running sum."""
    n = len(ids)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(ids.view(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:n])])
    return (sums[size:] - sums[:-size]) * _powers(_INVERSE, n)[: n - size + 1]


def tiles(p: np.ndarray, t: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in p, start in t, length): greedy string tiling of two id arrays by running Karp-Rabin.

    Each pass hashes the unmarked windows of one search length, extends equal ones and marks the longest
    matches first, none overlapping in p or in t; the search length then falls until it is `least`.
    Equal ids are equal words. Places are grouped by their window and the word before it: two places after the same
    word are inside a match that began earlier, so in runs of repeated words only the ends of the runs are compared.
    """
    free_p, free_t = np.ones(len(p), bool), np.ones(len(t), bool)
    left = len(p)  # words of p that are not marked
    out: list[tuple[int, int, int]] = []
    size = min(len(p), len(t), max(least, 16))
    while size >= least and left >= least:
        longest = 0
        found: list[tuple[int, int, int]] = []

        def words_before(x: np.ndarray, free: np.ndarray, at: np.ndarray) -> list[int | None]:
            """The unmarked word before each place; None where a match cannot have begun earlier."""
            inside = (at > 0) & free[at - 1]
            return np.where(inside, x[at - 1].astype(object), None).tolist()

        def windows(x: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            full = np.concatenate([[0], np.cumsum(free)])
            at = np.flatnonzero(full[size:] - full[:-size] == size)
            return at, window_hashes(x, size)[at]

        if len(p) >= size and len(t) >= size:
            at_p, hp = windows(p, free_p, size)
            at_t, ht = windows(t, free_t, size)
            hit = np.isin(ht, hp)
            where: dict[int, dict[int | None, list[int]]] = {}
            for i, h, before in zip(at_p.tolist(), hp.tolist(), words_before(p, free_p, at_p), strict=True):
                where.setdefault(h, {}).setdefault(before, []).append(i)
            places: dict[tuple[int, int | None], list[int]] = {}
            for j, h, before in zip(at_t[hit].tolist(), ht[hit].tolist(), words_before(t, free_t, at_t[hit]), strict=True):
                places.setdefault((h, before), []).append(j)
            for (h, before), js in places.items():
                for i in [i for other, found_at in where[h].items() if other is None or other != before for i in found_at]:
                    for j in js:
                        n = min(len(p) - i, len(t) - j)
                        same = (p[i : i + n] == t[j : j + n]) & free_p[i : i + n] & free_t[j : j + n]
                        n = n if same.all() else int(same.argmin())
                        if n >= size:
                            found.append((n, i, j))
                            longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        found = [(-n, i, j) for n, i, j in found]
        heapq.heapify(found)
        while found and left >= size:
            n, i, j = heapq.heappop(found)
            n = -n
            ok = free_p[i : i + n] & free_t[j : j + n]
            if ok.all():
                free_p[i : i + n] = False
                free_t[j : j + n] = False
                left -= n
                out.append((i, j, n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= size:  # what is left of it, among those of its length
                    heapq.heappush(found, (a - b, i + a, j + a))
        if size == least:
            break
        size = max(least, size // 2)
    return out


class Words:
    """64-bit hashes of a text's words; chunks without a letter or digit are left out."""

    def __init__(self, limit: int = 400_000):
        self.known, self.limit = {}, limit

    def __call__(self, text: bytes) -> np.ndarray:
        import xxhash

        known, chunks = self.known, text.split()
        if len(known) > self.limit:
            known.clear()
        for c in set(chunks).difference(known):
            w = normal(c)
            known[c] = xxhash.xxh3_64_intdigest(w.encode()) | 1 if w else 0
        ids = np.fromiter(map(known.__getitem__, chunks), np.uint64, len(chunks))
        return ids[ids != 0].view(np.int64)


def seeds(words: np.ndarray, size: int) -> np.ndarray:
    """The different hashes of all runs of size words."""
    n = len(words) - size + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        h = mix64(h * np.uint64(_BASE) + words[k : k + n].view(np.uint64))
    return np.unique(h).view(np.int64)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 5, threshold: float = 0.5, filter_bits: int = 1 << 27) -> DataFrame:
    """(id, item_id, coverage, n_items, contaminated) for every document.

    coverage: the largest part of a test item's words that tiles of at least `seed` words cover, whatever
    their order; item_id: that item (the smallest on a tie; null if none shares a seed); n_items: the items
    covered by at least threshold; contaminated: n_items > 0. Candidate pairs come from a join of both sides' runs
    of seed words; a filter of at most filter_bits bits spares the join those runs that no item has. Only such pairs are tiled.
    Items under seed words and null texts match nothing; null and empty documents are clean; repeated rows, and
    rows of one id with different texts, are compared each; null ids are handled like others; an empty benchmark leaves all clean.
    Rows of one item id are items of their own with that id. Ids may have any type.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            ids = [words(t) for t in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([seeds(x, seed) for x in ids], pa.list_(pa.int64()))], names=["item_id", "words", "seeds"])

    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text").mapInArrow(read_items, f"item_id {item_kind}, words binary, seeds array<long>")
    items = scratch(items.where("size(seeds) > 0").withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]), "items")
    item_seeds = scratch(items.select("item", F.explode("seeds").alias("h")), "item-seeds")
    known = bloom_filter(item_seeds.select("h"), filter_bits)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, some = Words(), shared.value
        for b in batches:
            for part in slices(b, 2, 1000, 8 << 20):
                held, found = [], []
                for text in text_bytes(part.column(2)):
                    ids = words(text)
                    h = seeds(ids, seed)
                    h = h[bloom_has(some, h.view(np.uint64))]
                    held.append(ids.tobytes() if len(h) else None)
                    found.append(h)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["rid", "id", "words", "seeds"])

    tagged = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = scratch(tagged.mapInArrow(read_docs, f"rid long, id {kind}, words binary, seeds array<long>"), "seeded")
    asked = base.where("words is not null")
    pairs = asked.select("rid", F.explode("seeds").alias("h")).join(item_seeds, "h").select("rid", "item").distinct()
    pairs = pairs.join(asked.select("rid", "words"), "rid").join(items.select("item", "item_id", F.col("words").alias("own")), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            share = []
            for own, words in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, t = np.frombuffer(own, np.int64), np.frombuffer(words, np.int64)
                share.append(sum(x[2] for x in tiles(p, t, seed)) / len(p))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64())], names=["rid", "item_id", "share"])

    tiled = pairs.select("rid", "item_id", "own", "words").mapInArrow(compare, f"rid long, item_id {item_kind}, share double")
    most = tiled.groupBy("rid").agg(F.max("share").alias("coverage"), F.min_by("item_id", F.struct(-F.col("share"), "item_id")).alias("item_id"), F.sum((F.col("share") >= threshold).cast("long")).alias("n_items"))
    out = base.select("rid", "id").join(scratch(most, "tiled"), "rid", "left")
    n = F.coalesce("n_items", F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), n.alias("n_items"), (n > 0).alias("contaminated"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
