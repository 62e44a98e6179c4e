"""Removal of repeated sentence spans (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, numbered, read, scratch, slices, unused

#: A sentence with what follows it up to the next one; the matches of a text are the whole text.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \n]*|[^.!?\n]+"
_SENTENCE = re.compile(SENTENCE.encode())


def split(text: bytes) -> tuple[list[bytes], list[list[bytes]]]:
    """The sentences of a text and their words."""
    parts = _SENTENCE.findall(text)
    return parts, [p.split() for p in parts]


def spans(text: bytes, min_sentences: int, min_words: int, alone: int) -> list[tuple[bytes, int, int]]:
    """(key, first sentence, last sentence): the shortest runs with enough sentences and words, from each sentence and up to
    each, and the sentences of at least `alone` words.

    They cover every longer run: the last sentence from which a run to its end has enough of both starts a run that ends there.
    """
    _, words = split(text)
    n = len(words)
    keys = [b" ".join(w) for w in words]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    last = np.maximum(np.searchsorted(ends, ends[:-1] + min_words) - 1, np.arange(n) + min_sentences - 1)
    first = np.minimum(np.searchsorted(ends, ends[1:] - min_words, "right") - 1, np.arange(n) - min_sentences + 1)
    runs = {(i, j) for i, j in enumerate(last.tolist()) if j < n}
    runs.update((i, j) for j, i in enumerate(first.tolist()) if i >= 0)
    runs.update((i, i) for i, w in enumerate(words) if len(w) >= alone)
    return [(b"\n".join(keys[i : j + 1]), i, j) for i, j in sorted(runs)]


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = 2, min_words: int = 16, alone: int = 50) -> DataFrame:
    """docs with sentences removed from text that lie in a span which occurs earlier, and two counts.

    Spans are runs of at least min_sentences consecutive sentences with at least min_words words, and single sentences of at least
    `alone` words. The shortest from each sentence and up to each, which cover all others, are hashed (128 bits); equal hashes are
    joined over the whole table; every sentence covered by an occurrence other than the first (smallest id, then place) goes.
    Adds n_sentences and n_removed. Null texts stay null, with 0 sentences; rows with a null id pass unchanged and are compared
    with nothing; repeated rows are one place, so a repeated row stays while no earlier one has the span; different texts of
    one id are different places, ordered by a hash. Ids may have any type that has an order.
    Columns of the input called n_sentences or n_removed are replaced. Texts of any length are handled whole.
    """
    docs = docs.drop("n_sentences", "n_removed")
    number = unused(docs, "_row")
    rows, _ = numbered(docs, id_col, text_col, number)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh3_128_digest
        for b in batches:
            for part in slices(b, 1, 1000, 8 << 20):
                row, hashes, first, last, again = [], [], [], [], []
                for k, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    seen = set()
                    for key, i, j in spans(text, min_sentences, min_words, alone):
                        h = of(key)
                        row.append(k)
                        hashes.append(h)
                        first.append(i)
                        last.append(j)
                        again.append(h in seen)
                        seen.add(h)
                if row:
                    h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[:, 0]), pa.array(h[:, 1]), part.column(0).take(pa.array(row, pa.int64())), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(again)],
                        names=["h1", "h2", "_id", "i", "j", "again"],
                    )

    found = rows.where(F.col(number).isNotNull() & F.col(text_col).isNotNull()).select(number, text_col).mapInArrow(hashed, "h1 long, h2 long, _id long, i int, j int, again boolean")
    once = found.where("not again").select("h1", "h2", "_id", "i", "j")
    shared = once.groupBy("h1", "h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last").drop("_last")
    shared = scratch(shared, "shared-spans")  # so that adaptive execution can split the join's hot keys
    later = once.join(shared, ["h1", "h2"]).where("_id > _first").select("_id", "i", "j")
    gone = later.union(found.where("again").select("_id", "i", "j")).distinct()
    key, runs = unused(docs, "_id"), unused(docs, "_gone")
    gone = gone.groupBy(F.col("_id").alias(key)).agg(F.collect_list(F.struct("i", "j")).alias(runs))  # at most two runs for each sentence of a text
    rest = [c for c in docs.columns if c != text_col]
    joined = rows.join(gone, rows[number] == gone[key], "left").drop(key)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, lists = b.column(len(rest)).cast(pa.binary()).to_pylist(), b.column(len(rest) + 1).to_pylist()
        out, total, removed = [], [], []
        for text, runs in zip(texts, lists, strict=True):
            parts = _SENTENCE.findall(text) if text else []
            total.append(len(parts))
            if runs:
                cover = np.zeros(len(parts) + 1, np.int64)
                for r in runs:
                    cover[r["i"]] += 1
                    cover[r["j"] + 1] -= 1
                keep = np.cumsum(cover)[:-1] == 0
                text = b"".join(p for p, k in zip(parts, keep, strict=True) if k)
                removed.append(int((~keep).sum()))
            else:
                removed.append(0)
            out.append(text)
        texts = pa.array(out, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([*b.columns[: len(rest)], texts, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*rest, text_col, "n_sentences", "n_removed"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*rest, text_col]) + ", n_sentences long, n_removed long"
    return arrow_map(joined.select(*[f"`{c}`" for c in rest], text_col, runs), cut, schema).select(*[f"`{c}`" for c in docs.columns], "n_sentences", "n_removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP5_SQL = r"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+[ \n]*|[^.!?\n]+') AS p FROM documents
), s AS (
  SELECT doc_id, i, p[i] AS raw, trim(regexp_replace(p[i], '[\t\n\x0b\f\r ]+', ' ', 'g')) AS k
  FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)
), c AS (
  SELECT *, sum(CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END) OVER (PARTITION BY doc_id ORDER BY i) AS upto,
         CASE WHEN k = '' THEN 0 ELSE len(string_split(k, ' ')) END AS words
  FROM s
), runs AS (
  SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i + 1 AND b.upto - a.upto + a.words >= 16 GROUP BY ALL
  UNION
  SELECT a.doc_id, max(a.i) AS i, b.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i + 1 AND b.upto - a.upto + a.words >= 16 GROUP BY a.doc_id, b.i
  UNION
  SELECT doc_id, i, i FROM c WHERE words >= 50
), lists AS (SELECT doc_id, list(k ORDER BY i) AS ks FROM s GROUP BY doc_id),
keyed AS (SELECT doc_id, i, j, array_to_string(ks[i:j], chr(10)) AS key FROM runs JOIN lists USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM keyed),
gone AS (SELECT DISTINCT r.doc_id, u.i FROM ranked r, LATERAL (SELECT unnest(range(r.i, r.j + 1)) AS i) u WHERE n > 1)
SELECT d.doc_id, count(s.i) AS n_sentences, count(g.i) AS n_removed,
       CAST(coalesce(length(string_agg(CASE WHEN g.i IS NULL THEN s.raw END, '' ORDER BY s.i)), 0) AS BIGINT) AS kept_chars,
       md5(coalesce(string_agg(CASE WHEN g.i IS NULL THEN s.raw END, '' ORDER BY s.i), '')) AS kept_md5
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i
GROUP BY d.doc_id
"""
