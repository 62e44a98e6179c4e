"""Token counts of whole texts (operator 4)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, read, text_bytes, vocabulary

#: Before white space that follows something else, and between a letter or digit and a mark (but for that in special tokens).
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[^\W_])(?=[^\w\s|])")
_TOKENIZERS: dict = {}


def safe_pieces(text: str, size: int) -> list[str]:
    """text cut into pieces of about size characters where the pre-tokenizer always splits, in any script.

    Its pre-tokens are white space, or letters, digits or marks with at most one blank before them: none goes on over a place
    where white space begins or where a mark follows a letter. A text without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def _lengths(path: str, texts: list[str], piece: int, batch_bytes: int) -> np.ndarray:
    """Tokens of each text; the library's batches get about batch_bytes each."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    tokenizer = _TOKENIZERS[path]
    counts = np.zeros(len(texts), np.int64)
    batch: list[str] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if batch:
            np.add.at(counts, owner, [len(e) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)])
            batch.clear()
            owner.clear()
            held = 0

    for k, text in enumerate(texts):
        for p in safe_pieces(text, piece) if text else ():
            batch.append(p)
            owner.append(k)
            held += len(p) if p.isascii() else len(p.encode())
            if held >= batch_bytes:
                flush()
    flush()
    return counts


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, piece: int = 32_768, batch_bytes: int = 1 << 20
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    Batch encoding in an Arrow function that returns lengths only. Batches are filled by bytes, not rows,
    and long texts are cut at safe boundaries, so the lengths are those of the whole text.
    Null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows are kept as they are;
    an empty table gives an empty result; other columns are not read.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = text_bytes(b.column(1))
        tokens = _lengths(tokenizer, ["" if x is None else x for x in b.column(1).to_pylist()], piece, batch_bytes)
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
            names=[id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
