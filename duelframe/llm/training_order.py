"""Token ids in training order (operator 7).

Documents become token ids and an end id, cut into sequences of a fixed number of ids. The sequences are
written once, as they come, and get dense ordinals from one count per partition. A keyed Feistel network
with cycle-walking, a permutation of 0 .. N-1, turns the ordinal into the sequence's slot in training
order. A shard is the slots of one range of fixed length; each is written by one task, in slot order,
records of a fixed width: slot s is record s % stride of shard s // stride.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32, mix64, read, scratch, shared_folder, vocabulary

END_ID, PAD_ID = 50256, 65535
_ENCODINGS: dict = {}


def permute(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slots of the ordinals x under the permutation of 0 .. n-1 that key chooses."""
    half = np.uint64(max(1, ((max(n - 1, 1)).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix64(right ^ k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]  # walk on along the cycle until it is back in range
    return out.astype(np.int64)


def _encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def sequences(docs: DataFrame, ranks: str, id_col: str, text_col: str, length: int) -> DataFrame:
    """(part, place, id, piece, n_tokens, ids_crc32, ids): ids as little-endian 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding, part, place = _encoding(ranks), TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                row, piece, n, crc, ids = [], [], [], [], []
                for k, text in enumerate(rows.column(1).to_pylist()):
                    found = array("H", encoding.encode_ordinary(text) if text else [])
                    found.append(END_ID)
                    data = found.tobytes()
                    for i, s in enumerate(range(0, len(data), 2 * length)):
                        cut = data[s : s + 2 * length]
                        row.append(k)
                        piece.append(i)
                        n.append(len(cut) // 2)
                        crc.append(crc32(cut))
                        ids.append(cut)
                m = len(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, part, np.int32)), pa.array(np.arange(place, place + m)), rows.column(0).take(pa.array(row, pa.int64())),
                        pa.array(piece, pa.int32()), pa.array(n, pa.int32()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()),
                    ],
                    names=["part", "place", id_col, "piece", "n_tokens", "ids_crc32", "ids"],
                )
                place += m

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"part int, place long, `{id_col}` {kind}, piece int, n_tokens int, ids_crc32 long, ids binary")


def write_training_order(docs: DataFrame, path: str, ranks: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, stride: int = 4096, key: int = 20_240_607, most_tasks: int = 20_000) -> int:
    """Writes all sequences of docs under path, in training order; returns their number.

    path/shard=K holds the slots K * stride up to the next shard's, sorted: (slot, id, piece, n_tokens,
    ids_crc32, ids), ids padded to length ids of 16 bits. A null or empty text is the end id alone; null ids and
    repeated rows are written like any other; an empty table writes an empty shard 0.
    """
    held = scratch(sequences(docs, ranks, id_col, text_col, length), "sequences")
    counts = dict(held.groupBy("part").count().collect())
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            part, place = b.column(0).to_numpy(), b.column(1).to_numpy()
            u, inverse = np.unique(part, return_inverse=True)
            slot = permute(np.array([starts[int(p)] for p in u])[inverse] + place, total, key)
            yield pa.RecordBatch.from_arrays([pa.array((slot // stride).astype(np.int32)), pa.array(slot), *b.columns[2:]], names=["shard", "slot", *b.schema.names[2:]])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[2:])
    placed = held.mapInArrow(run, f"shard int, slot long, {kept}")
    shards = max(1, -(-total // stride))
    tasks = min(shards, most_tasks)  # each writes the shards of one range
    ordered = placed.withColumn("_task", F.floor(F.col("shard").cast("long") * tasks / shards).cast("int")).repartitionById(tasks, "_task").sortWithinPartitions("slot").drop("_task")
    pad = np.full(length, PAD_ID, np.uint16).tobytes()
    padded = ordered.withColumn("ids", F.substring(F.concat("ids", F.lit(bytearray(pad))), 1, 2 * length))
    padded.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return total


def read_training_order(spark: SparkSession, path: str, start: int = 0, stride: int = 4096) -> DataFrame:
    """The records from slot start on; earlier shards are not opened."""
    return spark.read.parquet(path).where((F.col("shard") >= start // stride) & (F.col("slot") >= start))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, slot, shard, and the checksum of the ids as read back from the shards."""
    path = f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}"
    write_training_order(read(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.tiktoken"))
    ids = F.substring(F.col("ids"), F.lit(1), F.col("n_tokens") * 2)
    return read_training_order(spark, path).select("doc_id", "piece", "n_tokens", "slot", F.col("shard").cast("int").alias("shard"), F.crc32(ids).alias("ids_crc32"))
