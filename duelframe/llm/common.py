"""What the training-data operators share: scratch tables, components, ordinals, chunk-wise encoding."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..operators.connected import connected_components
from ..scratch import discard, scratch, shared_folder, shuffles_freed, sweep

__all__ = ["connected_components", "discard", "scratch", "shared_folder", "shuffles_freed", "sweep"]  # of the engine, for the modules here


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, with the partitions and the order that it has."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(b: pa.RecordBatch, column: int, rows: int = 400, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """b in slices of at most `rows` rows and, but for single longer texts, `most` bytes of text."""
    sizes = np.array(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < b.num_rows:
        stop = int(np.searchsorted(upto, upto[at] + most, side="right")) - 1
        stop = min(max(stop, at + 1), at + rows, b.num_rows)
        yield b.slice(at, stop - at)
        at = stop


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow by batch, some rows at a time, so that what f makes of texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                if (out := f(b.slice(at, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BLOCKS = 256  # of a Bloom filter; a key's places are all in one


def _bloom_places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h, width = mix64(keys), np.uint64(bits // _BLOCKS)
    for k in range(4):
        yield (h >> np.uint64(56)) * width + (mix64(h + np.uint64(k)) & (width - np.uint64(1)))


def bloom_filter(keys: DataFrame, most: int = 1 << 27) -> np.ndarray:
    """A Bloom filter of a one-column table of longs, as bytes: about 12 bits for each row, at most `most` (a power of two) in all.

    Each block is made by a task of its own. It is for tasks that would send rows to a join: what it lets through is joined all the same.
    """
    column = keys.columns[0]
    bits = min(most, max(1 << 16, 1 << int(12 * max(1, keys.count())).bit_length()))
    width = bits // _BLOCKS // 8

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((mix64(b.column(0).to_numpy().view(np.uint64)) >> np.uint64(56)).astype(np.int32)), b.column(0)], names=["block", "h"])

    def block(key: tuple, group: pa.Table) -> pa.Table:
        mine, first = np.zeros(width, np.uint8), np.uint64(key[0].as_py() * width * 8)
        for at in _bloom_places(group.column("h").to_numpy().view(np.uint64), bits):
            np.bitwise_or.at(mine, ((at - first) >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), ((at - first) & np.uint64(7)).astype(np.uint8)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([mine.tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in keys.select(column).mapInArrow(number, "block int, h long").groupBy("block").applyInArrow(block, "block int, bits binary").collect():
        out[r[0] * width : (r[0] + 1) * width] = np.frombuffer(r[1], np.uint8)
    return out


def bloom_has(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may have the keys; never wrong about those that it has."""
    out = np.ones(len(keys), bool)
    for at in _bloom_places(keys, len(bloom) * 8):
        out &= (bloom[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


class WordHash:
    """64-bit hashes of words (bytes), remembered in a bounded table."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.of, self.limit, self.known = xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            of = self.of
            for w in set(words).difference(known):
                known[w] = of(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def forest(pairs: np.ndarray) -> np.ndarray:
    """Star edges (root, member), root the smallest, with the same components as pairs (k x 2 of int64)."""
    if not len(pairs):
        return pairs.reshape(0, 2)
    nodes, flat = np.unique(pairs, return_inverse=True)
    ends = flat.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[ends[:, 0]], root[ends[:, 1]])
        new = root.copy()
        np.minimum.at(new, ends[:, 0], low)
        np.minimum.at(new, ends[:, 1], low)
        np.minimum.at(new, root[ends[:, 0]], low)
        np.minimum.at(new, root[ends[:, 1]], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return np.stack([nodes[root[moved]], nodes[moved]], axis=1)


def ordinals(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """A scratch copy of df with dense row numbers from 0, partition after partition, in the order df has.

    Only one count per partition goes to the driver; no row passes through a single task.
    """
    kept = checkpoint(df)
    tagged = kept.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright("_mid", 33)
    counts = dict(tagged.groupBy(pid.alias("p")).count().collect())
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    table = df.sparkSession.createDataFrame([(int(p), int(s)) for p, s in starts.items()], "_p long, _start long")
    out = tagged.withColumn("_p", pid).join(F.broadcast(table), "_p")
    return out.withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_p", "_start")


def places(df: DataFrame, key: str, *order: str | Column, name: str = "place") -> DataFrame:
    """df with a long: a row's place, from 0, among the rows of its key (not null) in the order given.

    One range exchange by key and order; a hot key lies in many partitions. Of the keys only one count per partition goes to the driver;
    the keys' first places are a written table that is joined back.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = ordinals(df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order), "_nth")
    first = scratch(rows.groupBy(F.col(key).alias("_key_of")).agg(F.min("_nth").alias("_least")), "first-places")
    out = rows.join(first, F.col(key) == F.col("_key_of"))
    return out.withColumn(name, F.col("_nth") - F.col("_least")).drop("_nth", "_least", "_key_of")


def numbered(df: DataFrame, id_col: str, text_col: str | None = None, name: str = "_row") -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(df with a long that orders its rows by id, what turns columns of such longs back into ids).

    Whole-number ids are taken as they are. Ids of other types are numbered in their order; so are, if text_col is
    given and ids occur more than once, the different texts of an id, by a hash. Repeated rows share their number; a null id has none.
    """
    kind = df.schema[id_col].dataType
    whole = isinstance(kind, (ByteType, ShortType, IntegerType, LongType))
    if whole and (text_col is None or df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()):
        return df.withColumn(name, F.col(id_col).cast("long")), lambda out, *columns: out.withColumns({c: F.col(c).cast(kind) for c in columns})
    digest = F.xxhash64(text_col) if text_col else F.lit(0).cast("long")
    keys = df.select(F.col(id_col).alias("_of"), digest.alias("_digest")).where(F.col("_of").isNotNull()).distinct()
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = scratch(ordinals(keys.repartitionByRange(parts, "_of", "_digest").sortWithinPartitions("_of", "_digest"), "_number"), "ids")
    names = df.columns
    own, given = unused(df, "_given"), unused(df, "_given_digest")
    out = df.withColumns({own: F.col(id_col), given: digest}).join(table, (F.col(own) == F.col("_of")) & (F.col(given) == F.col("_digest")), "left")
    out = out.select(*[df[f"`{c}`"] for c in names], F.col("_number").alias(name))

    def back(out: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            others = out.columns
            ids = table.select(F.col("_of").alias("_id_of"), F.col("_number").alias("_id_number"))
            out = out.withColumnRenamed(c, "_its_number").join(ids, F.col("_its_number") == F.col("_id_number"), "left").withColumn(c, F.col("_id_of")).select(*[f"`{x}`" for x in others])
        return out

    return out, back


class ChunkEncoder:
    """Token ids of whole texts, chunk by chunk, for a vocabulary whose words end in "</w>".

    A chunk is what stands between blanks, tabs and line ends. The vocabulary's pre-tokenizer drops white
    space and no pre-token crosses it, so a text's ids are its chunks' ids in order; each different chunk
    is encoded once by the library and remembered in a table of bounded size. Texts of any length work,
    as a chunk border is always a safe place to cut. Texts of Latin-1 characters are lower-cased before the
    look-up (the vocabulary ignores case), unless they may hold a special token. Of such texts, new words
    are encoded many at a time, joined by blanks, and told apart by the ids that end a word; a word with
    marks behind it is two pre-tokens.
    """

    def __init__(self, path: str, limit: int = 800_000, dtype: str = "<u4"):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.dtype = Tokenizer.from_file(path), limit, dtype
        # for lower-case words of letters between blanks, neither normalising nor the split pattern does anything
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.width = np.dtype(dtype).itemsize
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _words(self, words: list[str]) -> None:
        """Adds words of letters alone."""
        for i in range(0, len(words), 4000):
            block = words[i : i + 4000]
            ids = np.array(self.plain.encode_batch_fast([" ".join(block)], add_special_tokens=False)[0].ids, np.int64)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.width
            if len(stops) != len(block):
                raise ValueError("the vocabulary doesn't mark word ends")
            data, start = ids.astype(self.dtype).tobytes(), 0
            for w, stop in zip(block, stops.tolist(), strict=True):
                self.known[w] = data[start:stop]
                start = stop

    def _chunks(self, chunks: list[str]) -> None:
        """Adds chunks of any kind."""
        for i in range(0, len(chunks), 10_000):
            block = chunks[i : i + 10_000]
            for w, e in zip(block, self.tokenizer.encode_batch_fast(block, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        if len(self.known) > self.limit:
            self.known = {"": b""}
        known, parts = self.known, []
        plain: set[str] = set()
        other: set[str] = set()
        for t in texts:
            t = (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
            latin = "<|" not in t
            if latin:
                try:
                    t.encode("latin-1")
                    t = t.lower()
                except UnicodeEncodeError:
                    latin = False
            parts.append(t.split(" "))
            (plain if latin else other).update(parts[-1])
        plain = plain.difference(known)  # walks the small set, unlike difference_update
        words, marked = set(), []
        for c in plain:
            if c.isalpha():
                words.add(c)
            elif (w := c.rstrip(".,;:!?")).isalpha():
                marked.append((c, w, c[len(w) :]))
                words.add(w)
                other.add(c[len(w) :])
            else:
                other.add(c)
        self._words(list(words.difference(known)))
        self._chunks(list(other.difference(known)))
        for c, w, m in marked:
            known[c] = known[w] + known[m]
        return [b"".join(map(known.__getitem__, p)) for p in parts]


_ENCODERS: dict = {}


def chunk_encoder(path: str, dtype: str = "<u4") -> ChunkEncoder:
    """One encoder for each worker process; what earlier tasks of the process have left unused goes back first."""
    import os

    pa.default_memory_pool().release_unused()

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = ChunkEncoder(path, dtype=dtype)
    return _ENCODERS[path, dtype]


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
