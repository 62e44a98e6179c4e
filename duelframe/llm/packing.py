"""Packing of tokenised documents into sequences (operator 6).

The pieces' lengths are grouped into classes; a sequence's make-up is a multiset of classes that fits, a
configuration. The linear program over all configurations (fewest sequences that hold every class's count) is
solved by multiplicative weights: a class's price grows as it falls behind in being covered, and the best configurations
at these prices come from a knapsack dynamic program. The solution is rounded to whole sequences, and what that leaves is
put in by best fit. The driver holds only the histogram (at most `limit` lengths) and the configurations; the pieces
stay distributed.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunk_encoder, crc32, ordinals, read, scratch, vocabulary

END_ID = 1


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and the end id, cut only where longer than limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = chunk_encoder(tokenizer), np.uint32(end_id).tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, data in enumerate(encode(part.column(1).to_pylist())):
                    data += end
                    for i, s in enumerate(range(0, len(data), 4 * limit)):
                        cut = data[s : s + 4 * limit]
                        row.append(k)
                        piece.append(i)
                        start.append(s // 4)
                        length.append(len(cut) // 4)
                        crc.append(crc32(cut))
                        if with_ids:
                            ids.append(cut)
                arrays = [part.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity up to the given one: the value of the best multiset of classes, and the class to take first (-1: none).

    A capacity that a smaller one equals in value points to the class of that one.
    """
    best, first = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], first[c] = best[c - 1], first[c - 1]
        if n := fits[c]:
            value = best[c - sizes[:n]] + prices[:n]
            k = value.argmax()
            if value[k] > best[c]:
                best[c], first[c] = value[k], k
    return best, first


def start_prices(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """(prices with which no configuration is worth more than 1, their worth for all counts): the best of some known families.

    Size over capacity; the same with sizes below some limit free and those that leave less than it at 1 (one for each limit); and
    sizes rounded to p-ths of a capacity of p + 1 parts.
    """
    share = sizes / capacity
    families = [np.where(sizes > capacity - limit, 1.0, np.where(sizes < limit, 0.0, share)) for limit in sizes[2 * sizes <= capacity]]
    families += [np.where((p + 1) * sizes % capacity == 0, share, (p + 1) * sizes // capacity / p) for p in range(1, 33)]
    best = max([share, *families], key=lambda y: float((y * counts).sum()))
    return best, float((best * counts).sum())


def linear_program(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 40, eta: float = 4.0) -> tuple[dict[tuple, float], float]:
    """({configuration (class, ...): sequences}, a lower bound for the number of sequences): fractional, at most counts of each class.

    Multiplicative weights: each round covers 1/rounds of every class. A class's price is its price in a known dual solution (start_prices) times a weight that
    grows exponentially with how far it is behind; one knapsack program over these prices gives, for every class, the best
    configuration that holds it. No round uses more than two shares of a class. Prices scaled so that no configuration is worth more
    than 1 are a solution of the dual program, whose value is the bound.
    """
    used = np.zeros(len(sizes))
    start, bound = start_prices(sizes, counts, capacity)
    start = 0.9 * start + 0.1 * sizes / capacity
    out: dict[tuple, float] = {}
    for t in range(rounds):
        prices = start * np.exp(np.clip(eta * (t / rounds - used / counts), -20, 20))
        best, first = knapsack(prices, sizes, capacity)
        bound = max(bound, float((prices * counts).sum() / best[capacity]))
        most = np.minimum(counts - used, 2 * counts / rounds)  # that may be used this round
        share = np.minimum(counts - used, counts / rounds)
        now = np.zeros(len(sizes))
        for i in range(len(sizes) - 1, -1, -1):
            if (want := share[i] - now[i]) <= 1e-9:
                continue
            times, c = {i: 1}, capacity - int(sizes[i])
            while (k := int(first[c])) >= 0:
                times[k] = times.get(k, 0) + 1
                c -= int(sizes[k])
            amount = min(want, *((most[k] - now[k]) / n for k, n in times.items()))
            if amount > 1e-9:
                for k, n in times.items():
                    now[k] += n * amount
                key = tuple(sorted(times.items(), reverse=True))
                out[key] = out.get(key, 0.0) + amount
        used += now
    return out, bound


def best_fit(open_: list[tuple[int, dict[int, int], int]], counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[({size: times}, sequences)]: pieces of the given sizes put, largest first, where they leave the least room.

    open_: (room, {size: times}, sequences) that are there already. Equal sequences are handled at once.
    """
    rooms: list[int] = []
    by: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, times: dict[int, int], n: int) -> None:
        if room not in by:
            by[room] = []
            insort(rooms, room)
        by[room].append((times, n))

    for room, times, n in open_:
        put(room, times, n)
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                room, times, n = capacity, {}, left
            else:
                room = rooms[at]
                times, n = by[room].pop()
                if not by[room]:
                    del by[room], rooms[at]
            k = min(room // s, left)  # as many as fit: what is left is again the least room
            m = min(n, left // k)
            if m < n and times:
                put(room, times, n - m)
            put(room - k * s, times | {s: times.get(s, 0) + k}, m)
            left -= k * m
    return [x for group in by.values() for x in group]


def configurations(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """([(configuration {size: times}, sequences)], a lower bound for their number), which together hold exactly counts {size: pieces}.

    The linear program's solution is rounded along its running sum, so that the configurations' numbers keep to it; what this leaves
    is put in by best fit. Best fit alone takes its place where it needs fewer sequences. A size over capacity stands alone.
    """
    alone = [({s: 1}, n) for s, n in counts.items() if s >= capacity]
    counts = {s: n for s, n in counts.items() if s < capacity}
    over = float(sum(n for _, n in alone))
    if not counts:
        return alone, over
    sizes = np.array(sorted(counts), np.int64)
    left = np.array([counts[s] for s in sizes.tolist()], np.int64)
    solution, bound = linear_program(sizes, left.astype(np.float64), capacity)
    filled, total, given = [], 0.0, 0
    for key, amount in sorted(solution.items(), reverse=True):
        total += amount
        n = min(int(total + 0.5) - given, *(int(left[k]) // m for k, m in key))
        given = int(total + 0.5)
        if n > 0:
            for k, m in key:
                left[k] -= m * n
            times = {int(sizes[k]): m for k, m in key}
            filled.append((capacity - sum(s * m for s, m in times.items()), times, n))
    rounded = best_fit(filled, {int(s): int(n) for s, n in zip(sizes, left, strict=True) if n}, capacity)
    plain = best_fit([], counts, capacity)
    return alone + min(rounded, plain, key=lambda x: sum(n for _, n in x)), over + bound


def pack(cut: DataFrame, id_col: str = "doc_id", limit: int = 4096, width: int = 1) -> DataFrame:
    """The pieces with sequence_id and offset; a sequence holds at most limit tokens, without gaps.

    cut has (id, piece, length, ...), 1 <= length <= limit. A class is a length; with a larger `width` (for limits of which the driver's
    knapsack program, quadratic in limit / width, takes too long) lengths that round up to the same multiple of it, which loses room. Which piece gets which place follows from its rank in its class, by id
    and piece; ties (repeated rows) get different places. An empty table gives an empty result.
    """
    spark = cut.sparkSession
    size = (F.ceil(F.col("length") / F.lit(width))).cast("long")
    cut = scratch(cut, "pieces").withColumn("_class", size)
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("_class").count().collect()}
    rows, first, used = [], 0, dict.fromkeys(counts, 0)
    for times, n in configurations(counts, limit // width)[0]:
        k = 0
        for s in sorted(times, reverse=True):
            rows.append((s, used[s], first, times[s], k))
            used[s] += times[s] * n
            k += times[s]
        first += n
    rows.sort()
    begins, at = {}, 0
    for s in sorted(counts):
        begins[s] = at
        at += counts[s]
    keys = np.array([begins[r[0]] + r[1] for r in rows], np.int64)
    base, times_, slot0 = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [c for c in ("_class", id_col, "piece")]
    ranked = ordinals(cut.repartitionByRange(parts, *order).sortWithinPartitions(*order), "_rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy()
            k = np.searchsorted(keys, rank, side="right") - 1
            i = rank - keys[k]
            out = {n: b.column(j) for j, n in enumerate(b.schema.names) if n != "_rank" and n != "_class"}
            out["sequence_id"] = pa.array(base[k] + i // times_[k])
            out["_slot"] = pa.array(slot0[k] + i % times_[k])
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kept = [f for f in ranked.schema if f.name not in ("_rank", "_class")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, _slot long"
    placed = ranked.mapInArrow(place, schema)
    before = W.partitionBy("sequence_id").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("_slot")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """Every document, tokenised, cut and packed: one row per piece.

    A null or empty text is the end id alone. Null ids and repeated rows are packed like any other.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, limit), id_col, limit)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
