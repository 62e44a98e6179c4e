"""Language-model scores by logistic context mixing (operator 10).

A text is its bytes and an end, each coded as the bits of its path in a Huffman tree. Six predictors, for
contexts of 0 to 5 symbols, look up how often each bit was 0 and 1 at (context, node) in hashed tables that
grow with the corpus up to a bound and tell contexts apart by a check byte. Their stretched probabilities are combined by a weight vector that a gate picks (how many
contexts are known, and how well the longest one is); weights are learned online, batch by batch, on
leave-one-out counts, and an adaptive map of (gate, mixed probability) refines the result. The model's
probability of a text is the product over its bits; its base-10 logarithm is the score.

All training text is gathered: each task sends its different six-symbol windows once, with counts, and
tables, weights and map are made from their totals. Weights are learned in shards by a hash of the window, each in
the order of another hash, and added up as whole numbers, so that they do not depend on how Spark splits the
windows. Scoring is a function of the window alone, so each
worker remembers windows it has scored.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read, scratch, slices, text_bytes

END, SYMBOL_BITS, ORDERS = 256, 9, 6
#: The most that the base-2 logarithm of a table's size may be; smaller corpora get smaller tables.
MOST_BITS = 23
_MASK = (1 << (SYMBOL_BITS * ORDERS)) - 1


def windows(text: bytes, size: int = 1 << 22) -> Iterator[np.ndarray]:
    """The six-symbol windows that end at each byte and at the end, as integers; long texts part by part."""
    tail = np.full(ORDERS - 1, END, np.uint64)
    for at in range(0, len(text) + 1, size):
        x = np.frombuffer(text[at : at + size], np.uint8).astype(np.uint64)
        if at + size > len(text):
            x = np.append(x, np.uint64(END))
        x = np.concatenate([tail, x])
        n = len(x) - ORDERS + 1
        w = np.zeros(max(n, 0), np.uint64)
        for k in range(ORDERS):
            w <<= np.uint64(SYMBOL_BITS)
            w |= x[k : k + n]
        yield w
        tail = x[-(ORDERS - 1) :]


class Code:
    """A Huffman tree over the 257 symbols: the inner nodes on each symbol's path and the bits taken there."""

    def __init__(self, counts: np.ndarray):
        heap = [(float(c) + 0.01, s, s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        inner: list[tuple] = []
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            inner.append((a[2], b[2]))
            heapq.heappush(heap, (a[0] + b[0], 257 + len(inner), 256 + len(inner)))
        parent: dict[int, tuple[int, int]] = {}
        for node, (a, b) in enumerate(inner):
            parent[a], parent[b] = (node, 0), (node, 1)
        paths = []
        for s in range(257):
            path, at = [], s
            while at in parent:
                node, bit = parent[at]
                path.append((node, bit))
                at = 257 + node
            paths.append(path[::-1])
        self.length = np.array([len(p) for p in paths])
        depth = int(self.length.max())
        self.node = np.zeros((depth, 257), np.uint64)
        self.bit = np.zeros((depth, 257), bool)
        for s, p in enumerate(paths):
            for d, (node, bit) in enumerate(p):
                self.node[d, s], self.bit[d, s] = node, bit


class Layout:
    """Where the tables of the orders begin, one after the other, for sizes of 2^bits."""

    def __init__(self, bits: tuple[int, ...]):
        self.bits, self.offset = bits, np.concatenate([[0], np.cumsum([1 << b for b in bits])])

    def places(self, order: int, windows: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, check bytes) for the order's context (the symbols before the last) and the code node."""
        context = (windows >> np.uint64(SYMBOL_BITS)) & np.uint64((1 << (SYMBOL_BITS * order)) - 1)
        h = mix64((context * np.uint64(0x9E3779B97F4A7C15)) ^ (node + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        return self.offset[order] + (h >> np.uint64(64 - self.bits[order])).astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


class Model:
    def __init__(self, code: Code, layout: Layout, zeros: np.ndarray, ones: np.ndarray, check: np.ndarray):
        self.code, self.layout, self.zeros, self.ones, self.check = code, layout, zeros, ones, check
        self.weights = np.full((GATES, ORDERS), 0.3)
        self.map = None

    def inputs(self, w: np.ndarray, node: np.ndarray, bit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(stretched predictions, gate); with a bit given, as if it had been seen once less."""
        st = np.empty((len(w), ORDERS))
        known = np.zeros(len(w), np.int64)
        last = np.zeros(len(w))
        for k in range(ORDERS):
            s, check = self.layout.places(k, w, node)
            own = self.check[s] == check  # else the place is another context's
            n0, n1 = self.zeros[s] * own.astype(np.float64), self.ones[s] * own.astype(np.float64)
            if bit is not None:
                n0 = np.maximum(n0 - ~bit, 0)
                n1 = np.maximum(n1 - bit, 0)
            st[:, k] = np.log((n1 + PRIOR) / (n0 + PRIOR))
            total = n0 + n1
            known += total > 0
            last = np.where(total > 0, total, last)
        level = np.digitize(last, (2.5, 8.5, 64.5))
        return st, np.maximum(known - 1, 0) * 4 + level

    def bits(self, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, nodes, bits) level by level of the code tree."""
        last = (w & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)
        for d in range(len(self.code.node)):
            rows = np.flatnonzero(self.code.length[last] > d)
            if len(rows):
                yield rows, self.code.node[d, last[rows]], self.code.bit[d, last[rows]]

    def logp(self, w: np.ndarray) -> np.ndarray:
        """log10 of the probability of each window's last symbol after the others."""
        out = np.zeros(len(w))
        for rows, node, bit in self.bits(w):
            st, gate = self.inputs(w[rows], node)
            z = self.refine((st * self.weights[gate]).sum(axis=1), gate)
            out[rows] -= np.logaddexp(0, np.where(bit, -z, z))
        return out / np.log(10)

    def refine(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.clip(z, -LIMIT, LIMIT)
        return z if self.map is None else (z + self.map[gate, _bucket(z)]) / 2


#: The online learning rate, and what is added to each count.
RATE, PRIOR = 0.05, 0.1
GATES, LIMIT, STEPS = ORDERS * 4, 11.0, 44
#: Windows of one shard of learning, and the unit in which its weights are added up.
SHARD, FIXED = 250_000, 1 << 32


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.minimum(((z + LIMIT) * (STEPS / (2 * LIMIT))).astype(np.int64), STEPS - 1)


def _share(sc, model: Model):
    """A broadcast of the model, compressed: most of a small corpus's tables is 0."""
    return sc.broadcast(zlib.compress(pickle.dumps(model, 5), 1))


_MODELS: dict = {}


def _received(shared) -> Model:
    """The model of a broadcast, unpacked once in each worker."""
    if _MODELS.get("of") is not shared.value:
        _MODELS.clear()
        _MODELS.update(of=shared.value, model=pickle.loads(zlib.decompress(shared.value)))
    return _MODELS["model"]


def _crc_is_held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 1


def gather_windows(texts: DataFrame) -> DataFrame:
    """(w, n): the different windows of a one-column table of texts, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

        for b in batches:
            for text in text_bytes(b.column(0)):
                for w in windows(text):
                    held.append(w)
                    size += len(w)
                    if size > 5_000_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, most_bits: int = MOST_BITS) -> Model:
    """The model of a one-column table of texts.

    A table has two to four places for each different window, at most 2^most_bits: then the contexts seen most often keep
    their places, told apart by a check byte, and the others count as unknown.
    """
    spark = texts.sparkSession
    sc = spark.sparkContext
    grams = scratch(gather_windows(texts), "windows")
    counts = np.zeros(257, np.int64)
    for s, n in grams.groupBy(F.col("w").bitwiseAND(F.lit((1 << SYMBOL_BITS) - 1)).alias("s")).agg(F.sum("n")).collect():
        counts[s] = n
    code = Code(counts)
    different = grams.agg(*[F.approx_count_distinct(F.expr(f"w & (shiftleft(cast(1 as bigint), {SYMBOL_BITS} * {k + 1}) - 1)"), 0.02) for k in range(ORDERS)]).first()
    layout = Layout(tuple(min(most_bits, max(9, int(2 * (n or 1)).bit_length())) for n in different))

    order = F.explode(F.array(*[F.lit(k) for k in range(ORDERS)]))
    cut = F.expr(f"w & (shiftleft(cast(1 as bigint), {SYMBOL_BITS} * (k + 1)) - 1)")
    each = grams.select("w", "n", order.alias("k")).groupBy("k", cut.alias("w")).agg(F.sum("n").alias("n"))
    each = each.repartition("k", F.shiftright("w", SYMBOL_BITS))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = Model(code, layout, None, None, None)
        for b in batches:
            ks, ws, ns = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint64), b.column(2).to_numpy()
            place, weight = [], []
            for k in range(ORDERS):
                m = ks == k
                if m.any():
                    w, n = ws[m], ns[m]
                    for rows, node, bit in blank.bits(w):
                        at, check = layout.places(k, w[rows], node)
                        place.append((at * 256 + check) * 2 + bit)
                        weight.append(n[rows])
            u, inverse = np.unique(np.concatenate(place), return_inverse=True)
            n = np.bincount(inverse, np.concatenate(weight)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["slot", "n"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.stack([b.column(2).to_numpy(), b.column(3).to_numpy()])
            scale = np.maximum(n.max(axis=0) / 65535, 1)
            n = np.where(n > 0, np.maximum(np.rint(n / scale), 1), 0).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (b.column(0).to_numpy().astype(np.int32).tobytes(), b.column(1).to_numpy().astype(np.uint8).tobytes(), n.tobytes())], names=["places", "checks", "counts"])

    bit = F.col("slot").bitwiseAND(F.lit(1))
    table = each.mapInArrow(tally, "slot long, n long").groupBy(F.shiftright("slot", 1).alias("s"))
    table = table.agg(F.sum(F.when(bit == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(bit == 1, F.col("n")).otherwise(0)).alias("n1"))
    best = F.max(F.struct((F.col("n0") + F.col("n1")).alias("n"), F.col("s").bitwiseAND(F.lit(255)).alias("c"), "n0", "n1")).alias("b")  # of contexts that share a place
    table = table.groupBy(F.shiftright("s", 8).alias("place")).agg(best).select("place", "b.c", "b.n0", "b.n1")
    zeros, ones, checks = (np.zeros(layout.offset[-1], kind) for kind in (np.uint16, np.uint16, np.uint8))
    for row in table.mapInArrow(squeeze, "places binary, checks binary, counts binary").toLocalIterator(prefetchPartitions=True):
        at = np.frombuffer(row[0], np.int32)
        checks[at] = np.frombuffer(row[1], np.uint8)
        zeros[at], ones[at] = np.frombuffer(row[2], np.uint16).reshape(2, -1)
    model = Model(code, layout, zeros, ones, checks)

    shared = _share(sc, model)

    def learn(table: pa.Table) -> pa.Table:
        m = _received(shared)
        weights, total, seen, steps = m.weights.copy(), np.zeros((GATES, ORDERS)), np.zeros(GATES), 0
        w, n = table.column("w").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64)
        shuffled = np.argsort(mix64(w))  # different windows have different hashes, so the order they come in does not matter
        for at in range(0, len(w), 2000):
            part = shuffled[at : at + 2000]
            for rows, node, bit in m.bits(w[part]):
                own = part[rows]
                st, gate = m.inputs(w[own], node, bit)
                z = np.clip((st * weights[gate]).sum(axis=1), -LIMIT, LIMIT)
                error = (bit - 1 / (1 + np.exp(-z))) * n[own]
                mass = np.bincount(gate, n[own], minlength=GATES)
                rate = RATE / (1 + steps / 200)
                for k in range(ORDERS):
                    step = np.bincount(gate, error * st[:, k], minlength=GATES)
                    weights[:, k] += rate * step / np.maximum(mass, 1)
                seen += mass
                total += weights * mass[:, None]  # the mean of the path is steadier than its end
                steps += 1
        mean = total / np.maximum(seen, 1)[:, None]
        return pa.table({"place": pa.array(np.arange(GATES * ORDERS)), "weight": pa.array(np.rint(mean * FIXED).astype(np.int64).ravel()), "seen": pa.array(np.repeat(seen.astype(np.int64), ORDERS))})

    # whole numbers add up to the same in any order
    shards = max(1, grams.count() // SHARD)
    parts = grams.groupBy(F.pmod(F.xxhash64("w"), F.lit(shards)).alias("shard")).applyInArrow(learn, "place long, weight long, seen long")
    exact = F.col("weight").cast("decimal(19,0)") * F.col("seen").cast("decimal(18,0)")
    for place, a, s in parts.where("seen > 0").groupBy("place").agg(F.sum(exact), F.sum("seen")).collect():
        model.weights[divmod(place, ORDERS)] = int(a) / (FIXED * s)

    shared.destroy()
    mixed = _share(sc, model)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _received(mixed)
        sums = np.zeros((2, GATES * STEPS))
        for b in batches:
            w, n = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().astype(np.float64)
            for rows, node, bit in m.bits(w):
                st, gate = m.inputs(w[rows], node, bit)
                at = gate * STEPS + _bucket(np.clip((st * m.weights[gate]).sum(axis=1), -LIMIT, LIMIT))
                sums[0] += np.bincount(at, n[rows], minlength=GATES * STEPS)
                sums[1] += np.bincount(at, n[rows] * bit, minlength=GATES * STEPS)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(x[some].astype(np.int64)) for x in sums]], names=["at", "n", "ones"])

    sums = np.zeros((2, GATES * STEPS))
    for at, n, ones in grams.mapInArrow(refine, "at long, n long, ones long").groupBy("at").agg(F.sum("n"), F.sum("ones")).collect():
        sums[:, at] = n, ones
    mixed.destroy()
    middle = 1 / (1 + np.exp(-(np.tile(np.arange(STEPS) + 0.5, GATES) * (2 * LIMIT / STEPS) - LIMIT)))
    p = (sums[1] + 8 * middle) / (sums[0] + 8)
    model.map = np.log(p / (1 - p)).reshape(GATES, STEPS)
    return model


class Scorer:
    """A model and a table of windows scored before, of bounded size."""

    def __init__(self, model: Model, bits: int = 21):
        self.model, self.bits = model, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max)
        self.values = np.zeros(1 << bits)

    def __call__(self, w: np.ndarray) -> np.ndarray:
        out = np.empty(len(w))
        miss = np.arange(len(w))
        places = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            part = w[miss]
            at = ((part * np.uint64(salt)) ^ (part >> np.uint64(23))) * np.uint64(0xD6E8FEB86659FD93) >> self.bits
            hit = self.keys[at] == part
            out[miss[hit]] = self.values[at[hit]]
            places.append(at[~hit] if not places else at)
            miss = miss[~hit]
        if len(miss):
            u, first, inverse = np.unique(w[miss], return_index=True, return_inverse=True)
            value = np.concatenate([self.model.logp(u[k : k + 50_000]) for k in range(0, len(u), 50_000)])
            out[miss] = value[inverse]
            salt = np.uint64(0x9E3779B97F4A7C15)
            one = ((u * salt) ^ (u >> np.uint64(23))) * np.uint64(0xD6E8FEB86659FD93) >> self.bits
            two = ((u * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (u >> np.uint64(23))) * np.uint64(0xD6E8FEB86659FD93) >> self.bits
            free = self.keys[one] == np.iinfo(np.uint64).max
            at = np.where(free, one, two)
            self.keys[at] = u
            self.values[at] = value
            bad = self.keys[at] != u  # two windows of one place: the last one's key stands, so must its value
            self.values[at[bad]] = 0
            self.keys[at[bad]] = np.iinfo(np.uint64).max
        return out


_SCORERS: dict = {}


def _scorer(shared) -> Scorer:
    """One scorer for each worker and model."""
    model = _received(shared)
    if _SCORERS.get("of") is not model:
        _SCORERS.clear()
        _SCORERS.update(of=model, scorer=Scorer(model))
    return _SCORERS["scorer"]


def _tokens(text: bytes) -> list[bytes]:
    """The words; ASCII letters in lower case, cut at blanks and the control characters 9 to 13."""
    return text.lower().split()


def count_words(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """(token, c) of a one-column table of texts; the end of a text is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return out

        for b in batches:
            for text in text_bytes(b.column(0)):
                held.update(_tokens(text))
                held[b""] += 1
                if len(held) > most:
                    yield flush()
        if held:
            yield flush()

    return texts.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 200_000) -> DataFrame:
    """(id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Held out are rows with crc32(id as text) mod 5 = 1; the model and the counts learn from all others.
    base_score: the unigram score of the tokens (words and one end); the counts of the `frequent` most
    frequent tokens are given to every task, those of all other tokens are joined. score: log10 of the
    mixing model's probability of the text. A null text is empty and has the end alone; a null id counts
    as an empty one in the fold; repeated rows are scored each; an empty table gives an empty result, and
    without any training row the counts are 0.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = _crc_is_held_out(id_col)
    training = docs.where(~held).select(text_col)
    model = _share(sc, fit(training))
    words = scratch(count_words(training), "words")
    total, different = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least, held_rows = 1 << 62, 0  # the smallest count that at most `frequent` tokens reach
    for c, n in sorted(words.where(f"c > {int(total) // max(1, frequent) // 1000}").groupBy("c").count().collect(), reverse=True):
        held_rows += n
        if held_rows > frequent:
            break
        least = c
    top = sc.broadcast({bytes(r[0]): float(np.log10(r[1] + 0.5)) for r in words.where(F.col("c") >= least).toLocalIterator()})
    bottom = np.log10(total + 0.5 * (different + 1))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["rid", "id", "n_bytes", "n_tokens", "known", "base", "score", "token", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, logs = _scorer(model), top.value
        for b in batches:
            for part in slices(b, 2):
                rid = part.column(0).to_pylist()
                texts = text_bytes(part.column(2))
                edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
                p = np.concatenate([scorer(x) for x in _groups(w for t in texts for w in windows(t))])
                score = np.add.reduceat(p, edges[:-1])
                base, known, number, row, token, tf = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    found = _tokens(text)
                    number.append(len(found) + 1)
                    found.append(b"")
                    values = list(map(logs.get, found))
                    rest = [t for t, v in zip(found, values, strict=True) if v is None]
                    base.append(sum(v for v in values if v is not None) if rest else sum(values))
                    known.append(len(found) - len(rest))
                    for t, n in Counter(rest).items():
                        row.append(rid[k])
                        token.append(t)
                        tf.append(n)
                n, m = len(texts), len(row)
                none = [None] * m

                def both(own: list, kind: pa.DataType, none=none) -> pa.Array:
                    return pa.array(own + none, kind)

                ids = pa.concat_arrays([part.column(1), pa.nulls(m, part.column(1).type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rid + row, pa.int64()), ids, both([len(t) for t in texts], pa.int64()), both(number, pa.int64()), both(known, pa.int64()),
                        both(base, pa.float64()), both(score.tolist(), pa.float64()), pa.array([None] * n + token, pa.binary()), pa.array([0] * n + tf, pa.int64()),
                    ],
                    names=names,
                )

    tagged = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col), F.col(text_col))
    rows = tagged.mapInArrow(run, f"rid long, id {kind}, n_bytes long, n_tokens long, known long, base double, score double, token binary, tf long")
    # a row of a document itself has no token; a key of its own keeps such rows from meeting in one task
    key = F.when(F.col("token").isNull(), F.concat(F.lit("\n"), F.col("rid").cast("string")).cast("binary")).otherwise(F.col("token"))
    joined = rows.withColumn("key", key).join(words.select(F.col("token").alias("key"), "c"), "key", "left")
    c = F.coalesce("c", F.lit(0))
    rare = F.col("tf") * F.log10(c + F.lit(0.5))
    out = joined.groupBy("rid").agg(
        F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("known", F.lit(0))) + F.sum(F.when(c > 0, F.col("tf")).otherwise(0))).alias("n_known"),
        (F.sum(F.coalesce("base", F.lit(0.0))) + F.sum(rare)).alias("base"), F.max("score").alias("score"),
    )
    return out.select(
        id_col, held.alias("held_out"), "n_bytes", "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(float(bottom))).alias("base_score"), "score",
        (-F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )


def _groups(parts: Iterator[np.ndarray], most: int = 1_000_000) -> Iterator[np.ndarray]:
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p)
        if size >= most:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
