"""Removal of repeated byte strings (operator 3).

Every window of `size` bytes has one anchor, the place in it with the least hash of a short string (the
leftmost on a tie), so equal windows have equal anchors at equal places. The windows of one anchor are a
range of starts, its span. Anchors whose short string occurs once are unique and go first. Of spans with
the same bytes around the same anchor only the first can hold first occurrences; the others are removed
whole. What is left, different spans around the same short string, is laid out in shards of bounded size,
and external induced sorting gives each shard's suffix and common-prefix arrays: neighbours that share
`size` bytes are one window, of which the first place stays. Short strings with very many spans are dealt
into several shards, whose windows then meet by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, mix64, numbered, read, scratch, text_bytes
from .induced import suffix_array

_K, _CHUNK = 40, 1 << 17  # the bytes of an anchor; the bytes scanned at a time, which should fit the processor's cache
_RNG = np.random.Generator(np.random.PCG64(100))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


_POWER = _powers(_BASE, _CHUNK * 2)
_INVERSE = _powers(pow(_BASE, -1, 1 << 64), _CHUNK * 2)


def short_hashes(x: np.ndarray) -> np.ndarray:
    """A hash of the _K bytes from each place on."""
    h = x.astype(np.uint64)
    for shift in (1, 2, 4):
        h = h[:-shift] | (h[shift:] << np.uint64(8 * shift))
    n = len(x) - _K + 1
    out = np.zeros(n, np.uint64)
    for at in range(0, _K, 8):
        out = mix64(out + h[at : at + n] * np.uint64(0xC2B2AE3D27D4EB4F))
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    out, done = x, 1
    while done * 2 <= w:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    n = len(x) - w + 1
    return np.minimum(out[:n], out[w - done : w - done + n])


def anchors(x: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(short hash, span hash, anchor, first start, last start) of the windows that begin at the valid starts of x."""
    h = short_hashes(x)
    mask = np.uint64((1 << 19) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    at = (_sliding_min(key, size - _K + 1) & mask).astype(np.int64)
    at = np.where(starts[: len(at)], at, -1)
    edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    last = np.append(edge[1:], len(at)) - 1
    ok = at[edge] >= 0
    lo, hi = edge[ok], last[ok]
    anchor = at[lo]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[x] * _POWER[: len(x)])])
    span = (sums[hi + size] - sums[lo]) * _INVERSE[lo]
    span = mix64(span + (anchor - lo).astype(np.uint64) * np.uint64(1000003) + (hi - lo).astype(np.uint64))
    return h[anchor], span, anchor, lo, hi


def _chunks(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, valid starts, first place of each text, (row, place in the row) by text) of about _CHUNK bytes."""
    held, length = [], 0

    def made():
        x = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        begin = np.concatenate([[0], np.cumsum([len(t) for _, _, t in held])])
        ok = np.ones(len(x), bool)
        for e in begin[1:]:
            ok[max(0, e - size + 1) : e] = False
        return x, ok, begin[:-1], np.array([(r, p) for r, p, _ in held], np.int64)

    for row, text in enumerate(texts):
        if len(text) < size:
            continue
        for at in range(0, len(text) - size + 1, _CHUNK):
            part = text[at : at + _CHUNK + size - 1]
            if held and length + len(part) > _CHUNK * 1.5:
                yield made()
                held, length = [], 0
            held.append((row, at, part))
            length += len(part)
    if held:
        yield made()


def find_repeats(docs: DataFrame, id_col: str, text_col: str, size: int = 100, shard_bytes: int = 500_000, hot: int = 2_000) -> DataFrame:
    """(id, start, end): byte ranges of windows that occur earlier, for each row with an id, a long that differs between different texts; ranges may overlap."""
    base = docs.where(F.col(id_col).isNotNull() & (F.octet_length(text_col) >= size)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def batch(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["kh", "sh", "id", "lo", "at", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                rows = b.slice(start, 1000)
                ids = rows.column(0).to_numpy()
                held: list[tuple] = []
                for x, ok, begin, origin in _chunks(text_bytes(rows.column(1)), size):
                    kh, sh, at, lo, hi = anchors(x, ok, size)
                    text = np.searchsorted(begin, lo, side="right") - 1
                    place = origin[text, 1] - begin[text]
                    held.append((kh.view(np.int64), sh.view(np.int64), ids[origin[text, 0]], lo + place, (at - lo).astype(np.int16), (hi - lo).astype(np.int16)))
                    if len(held) == 64:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    found = base.mapInArrow(scan, "kh long, sh long, id long, lo long, at short, n short")
    shared = found.groupBy("kh").agg(F.count("*").alias("m")).where("m > 1").select("kh")
    # written first: a join of two plain exchanges is one whose hot keys adaptive execution can split
    rows = scratch(found.join(scratch(shared, "shared-anchors"), "kh"), "anchors")
    first = rows.groupBy("kh", "sh").agg(F.min(F.struct("id", "lo", "at", "n")).alias("f"))
    first = scratch(first.select("kh", "sh", "f.*"), "first-spans")
    copies = rows.join(first.select("kh", "sh", F.col("id").alias("_i"), F.col("lo").alias("_l")), ["kh", "sh"])
    copies = copies.where("id > _i or (id = _i and lo > _l)").select("id", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + size).alias("end"))

    many = first.groupBy("kh").agg(F.count("*").alias("m")).where("m > 1")
    spans = first.join(scratch(many, "many-spans"), "kh").withColumn("salts", F.ceil(F.col("m") / F.lit(hot)).cast("int"))
    amount = spans.agg(F.sum(F.col("n") + size + 1)).first()[0] or 0
    shards = int(amount // shard_bytes) + 1
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "lo"), F.col("salts"))).otherwise(0)
    spans = spans.withColumn("shard", F.pmod(F.xxhash64("kh", salt), F.lit(shards)).cast("int"))
    spans = spans.select("id", F.struct("lo", "n", "shard", (F.col("salts") > 1).alias("hot"), "at", "kh").alias("s"))
    lists = spans.groupBy("id").agg(F.collect_list("s").alias("spans"))
    packed = squeeze(base, ["id"], "text")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        unpack = expander()
        out: list[list] = [[] for _ in range(7)]
        for i, data, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = unpack(data)
            for s in own:
                for x, v in zip(out, (s["shard"], i, s["lo"], text[s["lo"] : s["lo"] + s["n"] + size], s["hot"], s["at"], s["kh"]), strict=True):
                    x.append(v)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int16(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["shard", "id", "lo", "span", "hot", "at", "kh"])

    laid = arrow_map(packed.join(lists, "id"), cut, "shard int, id long, lo long, span binary, hot boolean, at short, kh long")

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        text = np.frombuffer(b"\0".join(pdf["span"]) + b"\0", np.uint8).astype(np.int64)
        lengths = pdf["span"].str.len().to_numpy()
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        text += 1
        text[begin + lengths] = 0
        order, lcp = suffix_array(text)
        span = np.searchsorted(begin, order, side="right") - 1
        place = order - begin[span]
        window = place + size <= lengths[span]
        group = np.cumsum(lcp < size)[window]
        span, place = span[window], place[window]
        ids, los, hot_ = pdf["id"].to_numpy(), pdf["lo"].to_numpy(), pdf["hot"].to_numpy()
        i, start = ids[span], los[span] + place
        by = np.lexsort((start, i, group))
        lead = np.append(True, np.diff(group[by]) != 0)
        head = by[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        later = (i[by] != i[head]) | (start[by] != start[head])
        gi, gs = i[by][later], start[by][later]
        o = np.lexsort((gs, gi))
        gi, gs = gi[o], gs[o]
        edge = np.flatnonzero(np.append(True, (gi[1:] != gi[:-1]) | (gs[1:] > gs[:-1] + 1))) if len(gi) else np.zeros(0, np.int64)
        stop = np.append(edge[1:], len(gi)) - 1 if len(gi) else edge
        out = pd.DataFrame({"id": gi[edge], "start": gs[edge], "end": gs[stop] + size, "h1": 0, "h2": 0})
        w = by[lead]
        w = w[hot_[span[w]]]
        if len(w):  # the first windows here of strings that other shards have, too
            import xxhash

            data = pdf["span"].tolist()
            digest = b"".join(xxhash.xxh3_128_digest(data[s][p : p + size]) for s, p in zip(span[w].tolist(), place[w].tolist(), strict=True))
            h = np.frombuffer(digest, np.int64).reshape(-1, 2)
            out = pd.concat([out, pd.DataFrame({"id": i[w], "start": start[w], "end": -1, "h1": h[:, 0], "h2": h[:, 1]})])
        return out

    sorted_ = scratch(laid.groupBy("shard").applyInPandas(sort, "id long, start long, end long, h1 long, h2 long"), "windows")
    heads = sorted_.where("end < 0")
    least = heads.groupBy("h1", "h2").agg(F.min(F.struct("id", "start")).alias("f"))
    beaten = heads.join(least, ["h1", "h2"]).where("id > f.id or (id = f.id and start > f.start)").select("id", "start", (F.col("start") + size).alias("end"))
    return copies.union(sorted_.where("end >= 0").select("id", "start", "end")).union(beaten)


def squeeze(df: DataFrame, ids: list[str], text_col: str) -> DataFrame:
    """(ids, compressed text): texts that go through a shuffle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([pack(t) for t in text_bytes(b.column(len(ids)))], pa.binary())], names=[*ids, text_col])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    return arrow_map(df.select(*ids, text_col), run, f"{kinds}, `{text_col}` binary")


def expander():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) for every row.

    A byte goes if some string of `size` bytes that covers it also starts earlier: in a text with a smaller id, or
    at an earlier place of the same text. All is judged on the input. n_spans counts maximal removed runs;
    kept_sha256 is that of the bytes left. Null texts are empty; a null id takes no part and keeps its text;
    repeated rows are at one place, so they lose nothing to their like; different texts of one id are at different
    places, ordered by a hash; an empty table gives an empty result. Ids may have any type that has an order.
    """
    rows, _ = numbered(docs.select(id_col, text_col), id_col, text_col)
    gone = find_repeats(rows, "_row", text_col, size)
    gone = gone.distinct().groupBy(F.col("id").alias("_gone_id")).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = squeeze(rows, [id_col, "_row"], text_col).join(gone, F.col("_row") == F.col("_gone_id"), "left").select(id_col, text_col, "gone")

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        unpack = expander()
        size_, removed, runs, sha, kept = [], [], [], [], []
        for data, ranges in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            text = unpack(data)
            size_.append(len(text))
            n, k, at = 0, 0, 0
            left = []
            for start, end in merged(ranges or []):
                left.append(text[at:start])
                n, k, at = n + end - start, k + 1, end
            left.append(text[at:])
            text = b"".join(left)
            removed.append(n)
            runs.append(k)
            sha.append(hashlib.sha256(text).hexdigest())
            if keep_text:
                kept.append(text)
        columns = [b.column(0), pa.array(size_, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())]
        names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            columns.append(pa.array(kept, pa.binary()))
            names.append("kept")
        return pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(joined, cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def merged(ranges: list) -> list[tuple[int, int]]:
    """Ranges {start, end} as disjoint ones that do not touch, in order."""
    out: list[list[int]] = []
    for s, e in sorted((r["start"], r["end"]) for r in ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))
