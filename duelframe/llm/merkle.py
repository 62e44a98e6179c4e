"""A manifest of a dataset as a Merkle tree, with a proof for each record (operator 12)."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ordinals, places, read, scratch

_PROOF = "array<struct<left: string, right: string>>"
_SIDES = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def record_digest(*fields: Column) -> Column:
    """SHA-256, as hex, of the fields one after the other: "-" if null, else the length in bytes, ":" and the value as text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest gives with the digests beside its path."""
    return F.aggregate(proof, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def traverse(digests: list[str], fanout: int, height: int, sides: list[list] | None = None) -> str:
    """The digest over a block of at most fanout ** height nodes; sides[i] gets (digests to the left, to the right) of node i's path.

    Postorder: a subtree gives its digest back; while unwinding, the digests beside each child are appended to the leaves that it holds.
    """

    def visit(lo: int, hi: int, h: int) -> str:
        if h == 0:
            return digests[lo]
        step = fanout ** (h - 1)
        starts = range(lo, hi, step)
        parts = [visit(s, min(s + step, hi), h - 1) for s in starts]
        if sides is not None:
            for k, s in enumerate(starts):
                beside = {"left": "".join(parts[:k]), "right": "".join(parts[k + 1 :])}
                for leaf in range(s, min(s + step, hi)):
                    sides[leaf].append(beside)
        return sha256("".join(parts).encode()).hexdigest()

    return visit(0, len(digests), height)


def block_height(n: int, block: int, fanout: int, height: int) -> int:
    """The levels of a block of n nodes: all of them unless it is the only block of its tree and not full."""
    if block > 0:
        return height
    h = 0
    while fanout**h < n:
        h += 1
    return h


def _in_order(group: pa.Table) -> pa.Table:
    return group.sort_by("place")


def _climb(nodes: DataFrame, fanout: int, height: int) -> list[DataFrame]:
    """[(key, place, digest, ...) given, the roots of its aligned blocks, the roots of blocks of those, ...] up to one node for each key."""
    size = fanout**height

    def root(key: tuple, group: pa.Table) -> pa.Table:
        digests, block = _in_order(group).column("digest").to_pylist(), key[1].as_py()
        return pa.table({"key": [key[0].as_py()], "place": pa.array([block], pa.int64()), "digest": [traverse(digests, fanout, block_height(len(digests), block, fanout, height))]})

    out = [nodes]
    while not out[-1].where("place > 0").isEmpty():
        some = out[-1].select("key", "place", "digest", F.floor(F.col("place") / size).alias("block"))
        out.append(scratch(some.groupBy("key", "block").applyInArrow(root, "key string, place long, digest string"), "block-roots"))
    return out


def _joined(names: tuple[str, ...], fanout: int, height: int) -> Callable:
    """What a block and its row of the level above give: the block's rows with their whole proofs."""

    def run(key: tuple, group: pa.Table, upper: pa.Table) -> pa.Table:
        group = _in_order(group)
        digests, block = group.column("digest").to_pylist(), key[1].as_py()
        sides: list[list] = [[] for _ in digests]
        traverse(digests, fanout, block_height(len(digests), block, fanout, height), sides)
        rest = upper.column("proof")[0].as_py()
        for s in sides:
            s += rest
        same = {c: pa.array([upper.column(c)[0].as_py()] * len(digests), pa.string()) for c in ("subroot", "root")}
        return pa.table({c: group.column(c) for c in names} | {"proof": pa.array(sides, _SIDES)} | same)

    return run


def _unwind(levels: list[DataFrame], top: DataFrame, keep: list[str], fanout: int, height: int) -> DataFrame:
    """(keep..., key, place, digest, proof, subroot, root) of the nodes of levels[0]; top is (key, proof, subroot, root), one row for each key.

    Each level is dealt by block together with the block's own row of the level above, whose proof every node of the block goes on with.
    """
    size = fanout**height
    known = top.select("key", F.lit(0).cast("long").alias("place"), "proof", "subroot", "root")
    for k in range(len(levels) - 1, -1, -1):
        if k == len(levels) - 1:  # one node for each key: it is the tree's root
            extra = keep if k == 0 else []
            known = levels[k].join(known.drop("place"), "key").select(*extra, "key", "place", "digest", "proof", "subroot", "root")
            continue
        extra = keep if k == 0 else []
        nodes = levels[k].select(*extra, "key", "place", "digest", F.floor(F.col("place") / size).alias("block"))
        above = known.select("key", F.col("place").alias("block"), "proof", "subroot", "root")

        fields = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in (*extra, "key", "place", "digest"))
        known = nodes.groupBy("key", "block").cogroup(above.groupBy("key", "block")).applyInArrow(_joined((*extra, "key", "place", "digest"), fanout, height), f"{fields}, proof {_PROOF}, subroot string, root string")
        if k:
            known = scratch(known, "block-proofs")
    return known


def manifest(records: DataFrame, digest: str = "leaf", order: str = "doc_id", by: str = "source", keep: tuple[str, ...] = (), fanout: int = 3, height: int = 6) -> DataFrame:
    """(keep..., order, by, place, leaf, proof, subroot, root) for each record; the column `digest` of records is its digest as hex.

    Each value of `by` (null is one, and the first) is a tree: leaves ascend by `order` (null first; equal ones by digest), and while several nodes remain,
    every `fanout` consecutive ones become the SHA-256 of their digests' text, one after the other; the last run may be shorter, even one node. What remains is
    subroot; the subroots in the order of `by` (bytes) form one more tree of the kind, whose root is root. proof has, for each level from the leaf up to
    the root, the digests of the same run to the left and to the right; `folded` recomputes the root from a leaf and a proof.

    A leaf's place is its rank in its tree. Trees are cut into aligned blocks of fanout ** height nodes; each block is a group that is traversed
    recursively, and the block roots are the nodes of another such pass, until each tree has one node. On the way down every block is traversed
    again next to the proof of its root. A hot tree is many blocks; only digests and the columns kept are dealt, no texts.
    Repeated rows are leaves of their own. An empty table gives no rows and no root.
    """
    names = [c for c in dict.fromkeys((*keep, order, by)) if c != digest]
    columns = [f"_{i}" for i in range(len(names))]
    leaves = records.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(names, columns, strict=True)], F.coalesce(F.concat(F.lit("+"), F.col(f"`{by}`").cast("string")), F.lit("")).alias("key"), F.col(f"`{order}`").alias("_order"), F.col(f"`{digest}`").alias("digest"))
    leaves = places(scratch(leaves, "leaves"), "key", F.asc_nulls_first("_order"), F.asc("digest"))
    trees = _climb(leaves, fanout, height)
    roots = trees[-1].select("key", "digest")
    parts = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranked = ordinals(roots.repartitionByRange(parts, "key").sortWithinPartitions("key"), "place").select(F.col("key").alias("tree"), F.lit("").alias("key"), "place", "digest")
    forest = _climb(ranked, fanout, height)
    top = forest[-1].select("key", F.array().cast(_PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = scratch(_unwind(forest, top, ["tree"], fanout, height).select(F.col("tree").alias("key"), "proof", F.col("digest").alias("subroot"), "root"), "subroots")
    out = _unwind(trees, over, columns, fanout, height)
    return out.select(*[F.col(a).alias(c) for c, a in zip(names, columns, strict=True)], "place", F.col("digest").alias("leaf"), "proof", "subroot", "root")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's proof, checked after line ends were deleted from the texts of even CRC-32 of the id."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    altered = F.when(even, record_digest(*fields, F.replace("text", F.lit("\n"), F.lit(""))))
    records = read(spark, sf_dir, "documents").select("doc_id", "source", record_digest(*fields, F.col("text")).alias("leaf"), altered.alias("altered"))
    found = manifest(records, keep=("altered",)).withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"


OP12_SQL = f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
records AS (
  SELECT doc_id, source, {" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))} AS head, text,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) & 1 AS odd
  FROM documents, tab
), leaves AS (
  SELECT doc_id, source, sha256(head || {_field("text")}) AS leaf, sha256(head || {_field("CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END")}) AS altered FROM records
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes(source, level, place, n, digest) AS (
  SELECT source, 0, place, n, leaf FROM placed
  UNION ALL
  SELECT source, any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY source, place // 3
), subroots AS (
  SELECT source, level AS depth, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, place, n, digest) AS (
  SELECT 0, place, n, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, place // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY place // 3
), steps AS (
  SELECT s.source, s.level, s.place, string_agg(CASE WHEN o.place < s.place THEN o.digest END, '' ORDER BY o.place) AS l, string_agg(CASE WHEN o.place > s.place THEN o.digest END, '' ORDER BY o.place) AS r
  FROM nodes s JOIN nodes o ON o.source IS NOT DISTINCT FROM s.source AND o.level = s.level AND o.place // 3 = s.place // 3 WHERE s.n > 1 GROUP BY s.source, s.level, s.place
), top_steps AS (
  SELECT s.level, s.place, string_agg(CASE WHEN o.place < s.place THEN o.digest END, '' ORDER BY o.place) AS l, string_agg(CASE WHEN o.place > s.place THEN o.digest END, '' ORDER BY o.place) AS r
  FROM tops s JOIN tops o ON o.level = s.level AND o.place // 3 = s.place // 3 WHERE s.n > 1 GROUP BY s.level, s.place
), path AS (
  SELECT p.source, p.place AS leaf_place, s.level, coalesce(s.l, '') AS l, coalesce(s.r, '') AS r FROM placed p JOIN steps s ON s.source IS NOT DISTINCT FROM p.source AND s.place = p.place // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT p.source, p.place, 1000 + s.level, coalesce(s.l, ''), coalesce(s.r, '') FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source JOIN top_steps s ON s.place = u.place // CAST(pow(3, s.level) AS BIGINT)
), whole AS (
  SELECT source, leaf_place, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs, string_agg(l || r, '' ORDER BY level) AS sides FROM path GROUP BY source, leaf_place
), fold(source, place, step, h, ls, rs) AS (
  SELECT p.source, p.place, 0, p.altered, coalesce(w.ls, []), coalesce(w.rs, []) FROM placed p LEFT JOIN whole w ON w.source IS NOT DISTINCT FROM p.source AND w.leaf_place = p.place
  UNION ALL
  SELECT source, place, step + 1, sha256(ls[step + 1] || h || rs[step + 1]), ls, rs FROM fold WHERE step < len(ls)
)
SELECT p.doc_id, p.leaf, u.digest AS subroot, t.digest AS root, sha256(coalesce(w.sides, '')) AS proof_sha256, f.h AS folded_root, f.h = t.digest AS verified
FROM placed p JOIN subroots u ON u.source IS NOT DISTINCT FROM p.source JOIN fold f ON f.source IS NOT DISTINCT FROM p.source AND f.place = p.place AND f.step = len(f.ls)
LEFT JOIN whole w ON w.source IS NOT DISTINCT FROM p.source AND w.leaf_place = p.place CROSS JOIN (SELECT digest FROM tops WHERE n = 1) t
"""
