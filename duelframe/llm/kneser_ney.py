"""Quality classifier: interpolated modified Kneser-Ney models of trusted text (operator 1).

A model of words and pairs of words, and a model of letters that spells the words the first has not seen.
Both are fitted on all trusted documents of one half, counts, continuation counts and context totals
as DataFrames that are sharded and joined by context. Scoring is a sharded count join: each document asks for
the pairs it holds. What most of them ask for is answered in the tasks: the most frequent single words and
pairs, and Bloom filters that tell which other words and pairs the trusted text has at all; every other
word and pair goes through a join with its table, and a document's bits are summed up behind it. Words with letters that
the tasks' tables lack are spelled by joins with the whole tables. Documents are scored in
passes, so that the disk holds what one of them asks for, and intermediate tables and shuffles go once they are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_has, discard, mix64, read, scratch, shuffles_freed, slices

ORDER, BITS = 4, 16
#: Letters numbered from here on are spelled as two symbols, of which the first is no other letter's.
_TWO = 0xFF00
#: What thresholds are for, each per symbol.
_FIGURES = ("bits", "words", "worst")
_WORD = re.compile(r"\w+|[^\w\s]+")


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number of each word, its place among the different words, the different words).

    Words are runs of letters and digits or of marks, without case; each text ends in an empty word.
    """
    known: dict[str, int] = {}
    at: list[int] = []
    sizes = []
    for text in texts:
        low, before = (text or "").lower(), len(at)
        found = _WORD.findall(low) if len(low) < 1 << 22 else (m[0] for m in _WORD.finditer(low))
        at.extend([known.setdefault(w, len(known)) for w in found])
        at.append(known.setdefault("", len(known)))
        sizes.append(len(at) - before)
    return np.repeat(np.arange(len(texts)), sizes), np.array(at, np.int64), list(known)


def _hashes(words: list[str]) -> np.ndarray:
    import xxhash

    of = xxhash.xxh3_64_intdigest
    return np.fromiter((of(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _pair_keys(owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the word before, key of both) for each word; before a text's first stands 0."""
    before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])
    before[np.flatnonzero(np.diff(owner, prepend=-1))] = 0
    return before, _key_of(before, word)


def _key_of(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before ^ np.uint64(0x5851F42D4C957F2D)) ^ (word << np.uint64(1) | word >> np.uint64(63))


def _batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from slices(b, text, 1000, 8 << 20)


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of n-grams that occur 1 to 4 times."""
    k = {int(r[0]): r[1] for r in grams.groupBy(F.least("n", F.lit(4)).alias("k")).count().collect()}
    n1, n2, n3, n4 = (k.get(i, 0) or 0.5 for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(v, 0.1), i - 0.1) for i, v in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _shares(grams: DataFrame, by: str | Column) -> tuple[DataFrame, DataFrame]:
    """(grams with share and gamma, contexts with gamma): what is left of a count after its discount, and what a context gives to the lower order."""
    one, two, more = _discounts(grams)
    g = grams.withColumn("ctx", by if isinstance(by, Column) else F.col(by))
    g = g.withColumn("d", F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more))
    contexts = scratch(g.groupBy("ctx").agg(F.sum("n").alias("s"), (F.sum("d") / F.sum("n")).alias("gamma")), "contexts")  # written, so that the join's hot keys can be split
    return g.join(contexts, "ctx").withColumn("share", (F.col("n") - F.col("d")) / F.col("s")), contexts.select("ctx", "gamma")


class Letters:
    """-log2 p of letters after the three before them, within words; any script.

    Letters are numbers below 65,536 (0: a word's border, 1: any letter that the trusted text lacks), an n-gram is its letters'
    numbers in one 64-bit key; of more letters the least frequent ones are two symbols each. tables: for each order the sorted keys, their shares, the sorted contexts and their gammas.
    Where these are not all, more is a filter of the other n-grams and contexts, and what may depend on them costs NaN here (spelled_words has it).
    """

    def __init__(self, alphabet: dict[int, int], tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], more: np.ndarray | None = None):
        self.alphabet, self.tables, self.more = alphabet, tables, more
        self.whole: list[tuple[DataFrame, DataFrame]] = []  # with more, for each order all (code, share) and (ctx, gamma); stays with the driver
        last = max(alphabet.values(), default=1)
        self.floor = 1.0 / (last + 1 if last < _TWO else _TWO + (last - _TWO >> 15) + 1)
        self.number = numbers_of(alphabet)
        self.slot = np.full(1 << 20, np.iinfo(np.uint64).max)
        self.bits = np.zeros(1 << 20)

    def __reduce__(self):
        return Letters, (self.alphabet, self.tables, self.more)

    def keys(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-gram keys of all letters and ends, one word after the other; where each word begins)."""
        return letter_keys(self.number, words)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        at = (mix64(keys) >> np.uint64(44)).astype(np.int64)
        miss = np.flatnonzero(self.slot[at] != keys)
        if len(miss):
            u, inverse = np.unique(keys[miss], return_inverse=True)
            p, unknown = np.full(len(u), self.floor), np.zeros(len(u), bool)
            for k, (grams, share, contexts, gamma) in enumerate(self.tables, 1):
                own = u & np.uint64((1 << (BITS * k)) - 1)
                before = own >> np.uint64(BITS)
                p = _find(grams, share, own, 0.0) + _find(contexts, gamma, before, 1.0) * p
                if self.more is not None:
                    for kind, known, x in ((0, grams, own), (1, contexts, before)):
                        unknown |= ~_among(known, x) & bloom_has(self.more, _marked(x, k, kind))
            value = np.where(unknown, np.nan, -np.log2(p))
            out = self.bits[at]
            out[miss] = value[inverse]
            self.slot[at[miss]], self.bits[at[miss]] = keys[miss], out[miss]
            return out
        return self.bits[at]

    def __call__(self, words: list[str]) -> np.ndarray:
        """Bits of each word with its end (NaN: see above)."""
        keys, begin = self.keys(words)
        return np.add.reduceat(self.cost(keys), begin) if len(words) else np.zeros(0)


def _kind(c: str) -> str:
    """Decimal digits are one letter, and so are marks within sentences and all other marks, lest numbers and codes seem surprising."""
    return c if c.isalpha() else "0" if c.isdecimal() else "." if c in ".,;:'-" else "#"


@lru_cache
def _no_letters() -> dict[str, np.ndarray]:
    """The code points below 65,536 of each kind that isn't a letter of its own."""
    kinds = np.array([_kind(chr(c)) if not chr(c).isalpha() else "" for c in range(1, 1 << 16)])
    return {k: np.flatnonzero(kinds == k) + 1 for k in "0.#"}


def numbers_of(alphabet: dict[int, int]) -> np.ndarray:
    number = np.ones(0x110000, np.uint32)
    number[0] = 0
    for cp, i in alphabet.items():  # what the trusted text has of a kind stands for all of the kind
        if not chr(cp).isalpha():
            number[_no_letters()[_kind(chr(cp))]] = i
    number[np.array(list(alphabet), np.int64)] = np.array(list(alphabet.values()), np.uint32)
    return number


def letter_keys(number: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    pad = ORDER - 1
    line = ("\0" * pad).join(["", *words, ""]).encode("utf-32-le", "surrogatepass")
    x = number[np.frombuffer(line, np.uint32)].astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    two = x >= _TWO
    if two.any():
        first = pad + np.concatenate([[0], np.cumsum(lengths + pad)[:-1]])
        more = np.concatenate([[0], np.cumsum(two)])
        lengths = lengths + more[first + lengths] - more[first]
        rank, at = x - _TWO, np.arange(len(x)) + more[:-1]
        y = np.zeros(len(x) + more[-1], np.int64)
        y[at] = np.where(two, _TWO + (rank >> 15), x)
        y[at[two] + 1] = 2 + (rank[two] & 0x7FFF)
        x = y
    x = x.astype(np.uint64)
    key = np.zeros(len(x) - pad, np.uint64)
    for k in range(ORDER):
        key = (key << np.uint64(BITS)) | x[k : len(x) - pad + k]
    begin = np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]).astype(np.int64)
    inside = np.ones(len(key), bool)  # of the letters between two words only the first is the end of one
    for k in range(1, pad):
        inside[(begin + lengths + k)[begin + lengths + k < len(key)]] = False
    return key[inside], np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)


def _find(keys: np.ndarray, values: np.ndarray, x: np.ndarray, default: float) -> np.ndarray:
    """The values of x in sorted keys."""
    if not len(keys):
        return np.full(len(x), default)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, values[i], default)


def _among(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether x are among sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _marked(x: np.ndarray, order: int, kind: int) -> np.ndarray:
    """What stands in the filter for an n-gram (kind 0) or a context (1) of an order."""
    return mix64(x ^ np.uint64((2 * order + kind) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _most(table: DataFrame, most: int, key: str) -> DataFrame:
    """The rows of table with the largest n if it has more than `most`."""
    return table.orderBy(F.desc("n"), key).limit(most) if table.count() > most else table


def _sorted(table: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded table by its first one, a 64-bit key."""
    key, *values = table.toArrow().columns
    key = key.to_numpy().view(np.uint64)
    order = np.argsort(key)
    return [key[order], *(v.to_numpy()[order] for v in values)]


def fit_letters(trusted: DataFrame, text_col: str = "text", most: int = 1 << 20, filter_bits: int = 1 << 27) -> Letters:
    """The letter model of all n-grams; of more than `most` of an order tasks know the most frequent, the others are in tables to join with."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                total.update((text or "").lower())
        yield pa.RecordBatch.from_arrays([pa.array([ord(c) for c in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cp", "n"])

    found = trusted.select(text_col).mapInArrow(numbers, "cp long, n long").where("cp > 0").groupBy("cp").agg(F.sum("n").alias("n"))
    ids: dict[str, int] = {}
    alphabet = {int(r[0]): ids.setdefault(_kind(chr(r[0])), len(ids) + 2) for r in found.orderBy(F.desc("n"), "cp").collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers_of(alphabet)
        for b in _batches(batches, 0):
            _, at, words = _tokens(b.column(0).to_pylist())
            keys, begin = letter_keys(number, words)
            times = np.repeat(np.bincount(at, minlength=len(words)), np.diff(np.append(begin, len(keys))))
            u, inverse = np.unique(keys, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inverse, times).astype(np.int64))], names=["code", "n"])

    grams = scratch(trusted.where(F.length(text_col) > 0).select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "letters")
    orders = [grams]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different letters before the n-gram
        orders.insert(0, scratch(orders[0].groupBy(F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1)).alias("code")).agg(F.count("*").alias("n")), "letters"))
    tables, whole, rest = [], [], []
    for k, grams in enumerate(orders, 1):
        shares, contexts = _shares(grams, F.shiftrightunsigned("code", BITS))
        known = shares = shares.select("code", F.col("share").cast("float"), "ctx", F.col("gamma").cast("float"), "n")
        whole.append((shares.select("code", "share"), contexts.select("ctx", F.col("gamma").cast("float"))))
        if grams.count() > most:
            known = scratch(_most(shares, most, "code"), "frequent-letters")
            rest.append(_marks(grams.select("code").join(known.select("code"), "code", "left_anti"), k, 0))
            rest.append(_marks(contexts.select("ctx").join(known.select("ctx").distinct(), "ctx", "left_anti"), k, 1))
        code, share, ctx, gamma = _sorted(known.select("code", "share", "ctx", "gamma"))
        ctx, first = np.unique(ctx.view(np.uint64), return_index=True)
        tables.append((code, share, ctx, gamma[first]))
    letters = Letters(alphabet, tables, bloom_filter(scratch(reduce(DataFrame.union, rest), "letter-marks"), filter_bits) if rest else None)
    letters.whole = whole if rest else []
    return letters


def _marks(keys: DataFrame, order: int, kind: int) -> DataFrame:
    """The one column of keys as _marked has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_marked(b.column(0).to_numpy().view(np.uint64), order, kind).view(np.int64))], names=["h"])

    return keys.mapInArrow(run, "h long")


def spelled_words(docs: DataFrame, shared: Broadcast, letters: Letters, text_col: str) -> DataFrame:
    """(word, spelled), written: the bits of all words of docs that the tasks' tables don't suffice for, by joins of their different n-grams with the whole tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = shared.value[0]
        for b in _batches(batches, 0):
            words = _tokens(b.column(0).to_pylist())[2]
            words = [w for w, bits in zip(words, spell(words), strict=True) if np.isnan(bits)]
            if words:
                keys, begin = spell.keys(words)
                of = np.repeat(_hashes(words), np.diff(np.append(begin, len(keys))))
                yield pa.RecordBatch.from_arrays([pa.array(of.view(np.int64)), pa.array(keys.view(np.int64)), pa.array(np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys)))))], names=["word", "code", "place"])

    asked = scratch(docs.select(text_col).mapInArrow(run, "word long, code long, place long").distinct(), "asked-letters")
    codes = asked.select("code").distinct().withColumn("p", F.lit(letters.floor))
    for k, (grams, contexts) in enumerate(letters.whole, 1):
        codes = codes.withColumn("own", F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1)) if k < ORDER else F.col("code")).withColumn("ctx", F.shiftrightunsigned("own", BITS))
        codes = codes.join(grams.withColumnRenamed("code", "own"), "own", "left").join(contexts, "ctx", "left")
        codes = codes.select("code", (F.coalesce("share", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")).alias("p"))
    out = scratch(asked.join(scratch(codes, "letter-costs"), "code").groupBy("word").agg(F.sum(-F.log2("p")).alias("spelled")), "spelled-words")
    discard(asked)
    return out


class Words:
    """What tasks know of the word model: the most frequent words and pairs, and which other pairs and (rare, or None if there are none) words there are."""

    def __init__(self, known: list[np.ndarray], start: float, weight: float, hot: list[np.ndarray], bloom: np.ndarray, rare: np.ndarray | None):
        self.known, self.start, self.weight, self.hot, self.bloom, self.rare = known, start, weight, hot, bloom, rare
        self.table: DataFrame | None = None  # (word, share, gamma) of the rare words; stays with the driver

    def __reduce__(self):
        return Words, (self.known, self.start, self.weight, self.hot, self.bloom, self.rare)


def fit_words(trusted: DataFrame, text_col: str = "text", vocabulary: int = 1 << 22, hot: int = 1 << 20, filter_bits: int = 1 << 27) -> tuple[DataFrame, Words]:
    """((h, share) of each pair, what tasks know).

    64-bit hashes name the words. Of more different words than `vocabulary` tasks know the most frequent, the others are a table to join with.
    The filter (bloom_filter) has about 12 bits for each pair, and at most filter_bits in all.
    """
    spark = trusted.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches, 0):
            owner, at, words = _tokens(b.column(0).to_pylist())
            if len(owner):
                word = _hashes(words)[at]
                before, pair = _pair_keys(owner, word)
                _, first, n = np.unique(pair, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(n)], names=["before", "word", "n"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = _key_of(*(b.column(k).to_numpy().view(np.uint64) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), b.column(2), b.column(3)], names=["h", "share", "n"])

    pairs = trusted.where(F.length(text_col) > 0).select(text_col).mapInArrow(run, "before long, word long, n long")
    pairs = scratch(pairs.groupBy("before", "word").agg(F.sum("n").alias("n")), "word-pairs")
    words = scratch(pairs.groupBy("word").agg(F.count("*").alias("n")), "words")
    one, two, more = _discounts(words)
    d = F.when(F.col("n") == 1, one).when(F.col("n") == 2, two).otherwise(more)
    total, off = words.agg(F.sum("n"), F.sum(d)).first()
    total = float(total or 1)
    shares, contexts = _shares(pairs, "before")
    model = scratch(shares.select(F.col("ctx").alias("before"), "word", F.col("share").cast("float"), "n").mapInArrow(keyed, "h long, share float, n long"), "pair-shares")
    table = words.select("word", ((F.col("n") - d) / F.lit(total)).cast("float").alias("share"), "n").join(contexts.select(F.col("ctx").alias("word"), F.col("gamma").cast("float")), "word", "left")
    table = table.select("word", "share", F.coalesce("gamma", F.lit(1.0)).cast("float").alias("gamma"), "n")
    others = None
    if words.count() > vocabulary:
        whole = scratch(table, "known-words")
        table = most = scratch(_most(whole, vocabulary, "word"), "frequent-words")
        others = scratch(whole.join(most.select("word"), "word", "left_anti").select("word", "share", "gamma"), "rare-words")
    known = _sorted(table.select("word", "share", "gamma"))
    start = contexts.where("ctx = 0").select("gamma").first()
    discard(pairs, words, contexts, *([] if others is None else [whole, most]))

    least, held = 1 << 62, 0  # the smallest count that at most `hot` pairs reach
    for n, m in sorted((int(r[0]), int(r[1])) for r in model.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect())[::-1]:
        held += m
        if held > hot or n == 1:
            break
        least = n
    hottest = _sorted(model.where(F.col("n") >= least).select("h", "share"))
    rest = model.where(F.col("n") < least).select("h", "share")
    filter_ = bloom_filter(rest.select("h"), filter_bits)
    model = Words(known, float(start[0]) if start else 1.0, off / total if off else 1.0, hottest, filter_, None if others is None else bloom_filter(others.select("word"), filter_bits))
    model.table = others
    return rest, model


def score(docs: DataFrame, letters: Letters, pairs: DataFrame, words: Words, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, n_symbols, bits, words, worst): per symbol, bits by letters, bits by words, and bits of the worst word (null for a null or empty text)."""
    shared = docs.sparkSession.sparkContext.broadcast((letters, words))
    spelled = spelled_words(docs, shared, letters, text_col) if letters.whole else None
    joined = words.table is not None or spelled is not None
    rows = asks(docs, shared, id_col, text_col, lang_col, joined)
    return answered(scratch(rows, "asks") if joined else rows, pairs, words, id_col, lang_col, spelled)


def asks(docs: DataFrame, shared: Broadcast, id_col: str, text_col: str, lang_col: str, joined: bool) -> DataFrame:
    """A row for each document, with what the tasks know of it, and one for each pair that is to be joined (where words are joined, with them: w and s are the word, c is the one before)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell, model = shared.value
        for b in _batches(batches, 3):
            texts = b.column(3).to_pylist()
            owner, at, different = _tokens(texts)
            hashes, spelled = _hashes(different), spell(different)
            share, gamma = (_find(model.known[0], v, hashes, x) for v, x in ((model.known[1], 0.0), (model.known[2], 1.0)))
            unspelled = np.isnan(spelled)
            low = share + model.weight * np.where(unspelled, 0.0, np.exp2(-np.minimum(spelled, 900.0)))
            spelled[unspelled] = 0.0
            lengths = np.fromiter(map(len, different), np.int64, len(different)) + 1
            word = hashes[at]
            _, pair = _pair_keys(owner, word)
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            back = np.concatenate([[1.0], gamma[at[:-1]]])
            back[begin] = model.start
            seen = (share > 0)[at] & (back < 1)  # only then can the pair have been seen
            base = back * low[at]
            p = base.copy()
            if joined:  # what their tables answer: the word's own share, the context's gamma, the word's letters
                rare = (np.zeros(len(hashes), bool) if model.rare is None else (share == 0) & bloom_has(model.rare, hashes))[at]
                after = np.concatenate([[False], rare[:-1]])
                after[begin] = False
                far = unspelled[at]
                open_ = rare | after | far
                seen |= open_
            some = np.flatnonzero(seen)
            known = _find(*model.hot, pair[some], 0.0)
            p[some] += known
            if not joined:
                ask = some[known == 0]
                ask = ask[bloom_has(model.bloom, pair[ask])]
            else:
                hot = np.zeros(len(at))
                hot[some] = known
                ask = some[open_[some] | ((known == 0) & bloom_has(model.bloom, pair[some]))]
            size = lengths[at]
            p[ask] = 1.0
            bits = -np.log2(p)
            rate = bits / size
            ends = np.append(begin[1:], len(at)) - 1
            rate[ends] = 0.0  # the end is no word
            asked = ~np.isin(ask, ends)
            n, m = len(texts), len(ask)
            has = np.array([bool(t) for t in texts])
            total = np.add.reduceat(size, begin)
            more = []
            if joined:
                for value, there in ((word[ask].view(np.int64), rare[ask]), (np.concatenate([[np.uint64(0)], word[:-1]])[ask].view(np.int64), after[ask]), (word[ask].view(np.int64), far[ask])):
                    more.append(pa.array(np.append(np.zeros(n, np.int64), value), mask=np.append(np.ones(n, bool), ~there)))
                plain = np.append(np.ones(n, bool), ~open_[ask])
                more += [pa.array(np.append(np.zeros(n), x[ask]), mask=plain) for x in (low[at], np.where(after, 1.0, back), hot)]
            figures = [
                b.column(1), b.column(2), pa.array([len(t or "") for t in texts], pa.int64()), pa.array(np.where(has, total, 0)),
                *(pa.array(f(x, begin)) for f, x in ((np.add.reduceat, spelled[at]), (np.add.reduceat, bits), (np.maximum.reduceat, rate))),
            ]
            doc = pa.StructArray.from_arrays(figures, names=["id", "lang", "n_symbols", "size", "letters", "sum", "top"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([b.column(0), b.column(0).take(pa.array(owner[ask]))]), pa.concat_arrays([doc, pa.nulls(m, doc.type)]),
                    pa.array(np.append(mix64(b.column(0).to_numpy().view(np.uint64)), pair[ask]).view(np.int64)),
                    pa.array(np.append(np.zeros(n), base[ask]), mask=np.append(np.ones(n, bool), np.zeros(m, bool))), pa.array(np.append(np.zeros(n, np.int64), np.where(asked, size[ask], 0)).astype(np.int32)), *more,
                ],
                names=["rid", "doc", "h", "base", "len", *(["w", "c", "s", "low", "back", "hot"] if more else [])],
            )

    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, lang_col)}
    tagged = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    doc = f"struct<id: {kinds[id_col]}, lang: {kinds[lang_col]}, n_symbols: bigint, size: bigint, letters: double, sum: double, top: double>"
    return tagged.mapInArrow(run, f"rid long, doc {doc}, h long, base double, len int" + (", w long, c long, s long, low double, back double, hot double" if joined else ""))


def answered(rows: DataFrame, pairs: DataFrame, words: Words, id_col: str, lang_col: str, spelled: DataFrame | None = None) -> DataFrame:
    """What score returns, from the rows of asks; where words are joined, these have to be written, as they are read twice: pairs without such a word pass by its joins."""
    letters = F.col("doc.letters")
    if words.table is not None or spelled is not None:
        open_, same = F.col("w").isNotNull() | F.col("c").isNotNull() | F.col("s").isNotNull(), ("rid", "doc", "h", "base", "len")
        own = gamma = F.lit(None).cast("double")
        bits, joined = own, rows.where(open_)
        if (rare := words.table) is not None:
            joined = joined.join(rare.select(F.col("word").alias("w"), F.col("share").alias("_own")), "w", "left").join(rare.select(F.col("word").alias("c"), F.col("gamma").alias("_gamma")), "c", "left")
            own, gamma = F.col("_own"), F.col("_gamma")
        if spelled is not None:
            joined, bits = joined.join(spelled.select(F.col("word").alias("s"), F.col("spelled").alias("_spelled")), "s", "left"), F.col("_spelled")
        low = F.col("low") + F.coalesce(own, F.lit(0.0)) + F.when(bits.isNull(), 0.0).otherwise(F.lit(words.weight) * F.pow(F.lit(2.0), -F.least(bits, F.lit(900.0))))
        joined = joined.withColumn("base", F.col("back") * F.coalesce(gamma, F.lit(1.0)) * low + F.col("hot"))
        rows = rows.where(~open_).select(*same, F.lit(0.0).alias("letters")).union(joined.select(*same, F.coalesce(bits, F.lit(0.0)).alias("letters")))
        letters = letters + F.col("letters")
    joined = rows.join(pairs, "h", "left")
    bits = F.when(F.col("base").isNotNull(), -F.log2(F.col("base") + F.coalesce("share", F.lit(0.0))))
    more = [F.sum("letters").alias("letters")] if "letters" in rows.columns else []
    out = joined.withColumn("b", bits).groupBy("rid").agg(F.max("doc").alias("doc"), F.sum("b").alias("b"), F.max(F.when(F.col("len") > 0, F.col("b") / F.col("len"))).alias("rate"), *more)
    out = out.select(
        F.col("doc.id").alias(id_col), F.col("doc.lang").alias(lang_col), "doc.n_symbols", "doc.size", letters.alias("letters"),
        (F.col("doc.sum") + F.coalesce("b", F.lit(0.0))).alias("all"), F.greatest("doc.top", "rate").alias("worst"),
    )
    full = F.col("size") > 0
    return out.select(id_col, lang_col, "n_symbols", F.when(full, F.col("letters") / F.col("size")).alias("bits"), F.when(full, F.col("all") / F.col("size")).alias("words"), F.when(full, F.col("worst")).alias("worst"))


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, few: int = 100_000) -> DataFrame:
    """The texts of all documents whose ids are among `ids` (_tid); of more than `few` ids a Bloom filter keeps the other texts out of the join's exchange."""
    ids, rows = scratch(ids, "trusted-ids"), docs.select(id_col, text_col)
    if ids.count() <= few:
        return rows.join(F.broadcast(ids), rows[id_col] == F.col("_tid"), "left_semi").select(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(bloom_filter(ids.select(F.xxhash64("_tid").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select([0, 1]).filter(pa.array(bloom_has(shared.value, b.column(2).to_numpy().view(np.uint64))))

    likely = rows.select(id_col, text_col, F.xxhash64(id_col).alias("_h")).mapInArrow(run, rows.schema)
    return likely.join(ids, likely[id_col] == F.col("_tid"), "left_semi").select(text_col)


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    low: float = 0.004, high: float = 0.996, least: int = 100, passes: int = 2,
) -> DataFrame:
    """(id, lang, n_symbols, perplexity, low, high, words, words_high, worst, worst_high, keep) for every document.

    Trusted are labelled documents of good quality that are not toxic. The models are fitted on all of one half of
    them by a hash of the id; the thresholds are quantiles by language and length class over the whole other half, on a grid of
    1/1000 bit. Three figures are compared, all per symbol: bits by letters (low and high), bits by words and bits of the worst word
    (high only, as the texts fitted on score lower). Cells with under `least` texts take those of the language over the
    neighbouring length classes, too, then over all lengths, then over everything, always quantiles; without any trusted document
    all are kept. Documents outside are rejected: too surprising as a whole or in one word, or (a few words over and over) too far
    from what text of that length has. Null and empty texts have no perplexity and are rejected. Null languages are a language of
    their own; null ids are never trusted; repeated rows, and rows of one id with different texts, are scored each;
    repeated labels count as trusted if all are. Ids and languages may have any type. Every document is in one of the `passes` in
    which they are scored, by a hash of its id; where words are joined, there are twice as many.
    """
    docs, labels = docs.select(id_col, lang_col, text_col), labels.select(id_col, "quality", "toxic")
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    trusted = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_tid")).agg(F.min(good).alias("ok")).where("ok").select("_tid")
    half = F.pmod(F.xxhash64("_tid"), F.lit(2))
    with shuffles_freed(docs.sparkSession):
        text = scratch(texts_of(docs, trusted.where(half == 0), id_col, text_col), "trusted")
        letters = fit_letters(text, text_col)
        pairs, words = fit_words(text, text_col)
        discard(text)
        shared = docs.sparkSession.sparkContext.broadcast((letters, words))
        spelled = spelled_words(docs, shared, letters, text_col) if letters.whole else None
        tables = [t for t in (words.table, spelled) if t is not None]
        passes *= 1 + bool(tables)
        turn, parts = F.pmod(F.hash(id_col), F.lit(passes)), []
        for k in range(passes):
            rows = asks(docs.where(turn == k), shared, id_col, text_col, lang_col, bool(tables))
            rows = scratch(rows, "asks") if tables else rows
            parts.append(scratch(answered(rows, pairs, words, id_col, lang_col, spelled), "scores"))
            if tables:
                discard(rows)
        discard(pairs, *tables)
        shared.destroy()

    length = F.least(F.lit(10), F.floor(F.log2(F.col("n_symbols") + 1))).cast("int")
    scored = reduce(DataFrame.union, parts).withColumn("_len", length)
    held = scored.join(trusted.where(half == 1), scored[id_col] == F.col("_tid"), "left_semi").where("bits is not null")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("\0"))
    held = held.select(lang.alias("_lang"), "_len", F.explode(F.array(*(F.struct(F.lit(k).alias("what"), F.floor(F.col(k) * 1000).alias("bin")) for k in _FIGURES))).alias("x"))
    bins = scratch(held.groupBy("_lang", "_len", "x.what", "x.bin").agg(F.count("*").alias("n")), "bins")

    def limits(bins: DataFrame, *by: str, least: int = least) -> DataFrame:
        g = bins.groupBy(*by, "what", "bin").agg(F.sum("n").alias("n"))
        w = W.partitionBy(*by, "what")
        g = g.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w)).where(F.col("total") >= least)

        def first(what: str, share: float) -> Column:
            return F.min(F.when((F.col("what") == what) & (F.col("upto") >= F.lit(share) * F.col("total")), F.col("bin")))

        return g.groupBy(*by).agg(first("bits", low).alias("lo"), *((first(k, high) + 1).alias(f"hi_{k}") for k in _FIGURES))

    near = bins.withColumn("_len", F.explode(F.array(F.col("_len") - 1, "_len", F.col("_len") + 1)))
    names = ["lo", *(f"hi_{k}" for k in _FIGURES)]
    out = scored.withColumn("_lang", lang)
    for k, (level, by) in enumerate(((limits(bins, "_lang", "_len"), ["_lang", "_len"]), (limits(near, "_lang", "_len"), ["_lang", "_len"]), (limits(bins, "_lang"), ["_lang"]))):
        level = scratch(level.withColumnsRenamed({c: f"{c}{k}" for c in names}), "limits")
        out = out.join(F.broadcast(level) if level.count() <= 100_000 else level, by, "left")  # one row for each language and length class
    out = out.join(F.broadcast(limits(bins, least=0).withColumnsRenamed({c: f"{c}3" for c in names})), how="left")
    lo, *tops = (F.coalesce(*(f"{c}{k}" for k in range(4))) / 1000 for c in names)
    inside = F.col("bits") >= lo
    for k, top in zip(_FIGURES, tops, strict=True):
        inside = inside & (F.col(k) < top)
    two = F.lit(2.0)
    perplexities = [F.pow(two, c).alias(n) for c, n in zip(("words", tops[1], "worst", tops[2]), ("words", "words_high", "worst", "worst_high"), strict=True)]
    keep = F.col("bits").isNotNull() & F.coalesce(inside, F.lit(True))
    return out.select(id_col, lang_col, "n_symbols", F.pow(two, "bits").alias("perplexity"), F.pow(two, lo).alias("low"), F.pow(two, tops[0]).alias("high"), *perplexities, keep.alias("keep"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
