"""Merkle manifest of a dataset, its nodes stored in van Emde Boas order.

Every row is a leaf, every lang a binary tree of leaves in the order of doc_id, and the langs' roots are the leaves of one more
tree. A tree is cut into aligned subtrees of `HEIGHT` levels; each is one row of the manifest, whose nodes lie in one array: the
upper half of the levels first, then each subtree of the lower half, both laid out in the same way. Where a node lies is found
by arithmetic on its depth and index alone (`address`), and serves both building a subtree and reading the siblings of a leaf.
The roots of a tier's subtrees are the leaves of the next tier; three or four tiers hold any number of rows.

A single row or task holds one subtree at a time. Siblings are read from the top tier down: what a subtree's root needs to
reach the root of all travels to the subtree as one short array.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import columns, crc_sql, materialize, numbered, per_batch

#: Levels that a stored subtree climbs: 2**HEIGHT leaves.
HEIGHT = 10
DIGEST = 32
#: In a path: no sibling, sibling on the left, sibling on the right.
ALONE, LEFT, RIGHT = 0, 1, 2


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes `index` of a depth (root: 0) lie in the van Emde Boas order of a complete tree of `height` levels."""
    at = np.zeros(len(index), np.int64)
    while height > 1:
        upper = height // 2
        lower = height - upper
        if depth < upper:
            height = upper
            continue
        below = depth - upper
        at += (1 << upper) - 1 + (index >> below) * ((1 << lower) - 1)
        index, depth, height = index & ((1 << below) - 1), below, lower
    return at


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def grown(leaves: list[bytes], climb: int) -> bytes:
    """The nodes over some leaves, `climb` levels up, in van Emde Boas order; nodes that are missing are zeros.

    Two consecutive nodes make one above them, a last odd one makes one by itself.
    """
    height = climb + 1
    nodes = np.zeros(((1 << height) - 1, DIGEST), np.uint8)
    level = [x.hex() for x in leaves]
    for up in range(height):
        if up:
            level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        nodes[address(height, climb - up, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
    return nodes.tobytes()


class Subtree:
    """Reads a stored subtree: n leaves, `climb` levels over them."""

    def __init__(self, nodes: bytes, n: int, climb: int):
        self.n, self.climb = n, climb
        self.nodes = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)

    def read(self, up: int, index: np.ndarray) -> list[str]:
        """Digests of the nodes `index` of the level `up` over the leaves."""
        flat = self.nodes[address(self.climb + 1, self.climb - up, index)].tobytes().hex()
        return [flat[i : i + 2 * DIGEST] for i in range(0, len(flat), 2 * DIGEST)]

    def siblings(self) -> list[list[tuple[int, str]]]:
        """For each level below the root the (side, digest) of each leaf's ancestor's sibling."""
        out, index, width = [], np.arange(self.n), self.n
        for up in range(self.climb):
            beside = index ^ 1
            there = beside < width
            found = self.read(up, np.where(there, beside, 0))
            sides = np.where(there, np.where(index & 1, LEFT, RIGHT), ALONE).tolist()
            out.append([(side, digest if side else "") for side, digest in zip(sides, found)])
            index, width = index >> 1, (width + 1) // 2
        return out


def path_bytes(path: list[tuple[int, str]]) -> bytes:
    return b"".join(bytes([side]) + (bytes.fromhex(digest) if side else b"") for side, digest in path)


def path_read(path: bytes) -> list[tuple[int, str]]:
    out, at = [], 0
    while at < len(path):
        side, at = path[at], at + 1
        end = at + DIGEST if side else at
        out.append((side, path[at:end].hex()))
        at = end
    return out


def folded(digest: str, path: list[tuple[int, str]]) -> str:
    """The root that a digest leads to by a path of siblings."""
    for side, beside in path:
        digest = sha(beside + digest if side == LEFT else digest + beside)
    return digest


def _levels(total: Column) -> Column:
    """Levels over `total` leaves until one node is left."""
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def _tier(rows: DataFrame) -> DataFrame:
    """Subtrees of one tier, one row each and written, of rows(tree, place, levels = how many are still to climb, digest, doc_id, tampered)."""
    items = F.sort_array(F.collect_list(F.struct("place", "digest", "doc_id", "tampered")))
    packed = rows.groupBy("tree", F.shiftright("place", HEIGHT).alias("block"), "levels").agg(items.alias("items"))
    schema = T.StructType([*packed.schema.fields, T.StructField("nodes", T.BinaryType()), T.StructField("root", T.BinaryType())])

    def grow(batches):
        for batch in batches:
            nodes = []
            for items, levels in zip(batch.column("items"), batch.column("levels").to_pylist()):
                nodes.append(grown(items.values.field("digest").to_pylist(), min(HEIGHT, levels)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()), pa.array([x[:DIGEST] for x in nodes], pa.binary())], names=schema.names)

    return materialize(packed.mapInArrow(grow, schema))


def tiers(rows: DataFrame) -> list[DataFrame]:
    """The manifest of rows(tree, place, total, digest, doc_id, tampered): the tiers of its trees, leaves' subtrees first."""
    found = [_tier(rows.withColumn("levels", _levels(F.col("total"))))]
    while not (more := found[-1].where(f"levels > {HEIGHT}")).isEmpty():
        none = (F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))
        found.append(_tier(more.select("tree", F.col("block").alias("place"), (F.col("levels") - HEIGHT).alias("levels"), F.col("root").alias("digest"), *none)))
    return found


def roots(found: list[DataFrame]) -> DataFrame:
    """tree and its root."""
    parts = [t.where(f"levels <= {HEIGHT}").select("tree", F.col("root").alias("subroot")) for t in found]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _handed(blocks: DataFrame) -> DataFrame:
    """For each leaf of blocks(tree, block, levels, items, nodes, up, subroot, top): tree, place, the path from it to the top."""

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {"tree": [], "place": [], "up": [], "subroot": [], "top": []}
            names = ("tree", "block", "levels", "n", "nodes", "up", "subroot", "top")
            for tree, block, levels, n, nodes, up, subroot, top in zip(*(batch.column(c).to_pylist() for c in names)):
                inner = Subtree(nodes, n, min(HEIGHT, levels)).siblings()
                for i in range(n):
                    for name, x in zip(out, (tree, (block << HEIGHT) + i, path_bytes([level[i] for level in inner]) + up, subroot, top)):
                        out[name].append(x)
            yield out

    kept = blocks.select("tree", "block", "levels", F.size("items").alias("n"), "nodes", "up", "subroot", "top")
    return per_batch(kept, work, "tree string, place long, up binary, subroot binary, top binary")


def _with_paths(found: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The subtrees of the leaves with the path over their roots, given outer(tree, up, subroot, top)."""
    below: DataFrame | None = None
    for tier in reversed(found):
        rows = tier.where(f"levels <= {HEIGHT}").join(outer, "tree")
        if below is not None:
            rows = rows.unionByName(tier.where(f"levels > {HEIGHT}").join(below.withColumnRenamed("place", "block"), ["tree", "block"]).select(*rows.columns))
        if tier is not found[0]:
            below = materialize(_handed(rows))
    return rows


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256 of a row: each value as its number of bytes, a colon and itself; `-` where null."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(said(c.cast("string")) for c in (doc_id, source, lang, n_chars, text))), 256))


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Tiers of the langs' trees, tiers of the tree over the langs, and the langs' roots with their places in it."""
    docs = columns(docs, doc_id="long", source="string", lang="string", n_chars="long", text="string")
    of = lambda n: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.col("n_chars").cast("decimal(20,0)") + 1  # the largest long has a successor too
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # null first
    leaves = docs.select("doc_id", tree.alias("tree"), of(F.col("n_chars")).alias("digest"), F.when(hit, of(more)).alias("tampered"))
    by_lang = tiers(numbered(leaves, "tree", "doc_id", "digest"))
    langs = materialize(numbered(roots(by_lang).withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), "tree", "name"))
    none = (F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("tampered"))
    over = tiers(langs.select("tree", "place", "total", F.col("subroot").alias("digest"), *none))
    return by_lang, over, langs


def proved(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of docs(doc_id, source, lang, n_chars, text).

    A lang's leaves ascend by doc_id, nulls first, and by digest where rows share one; equal rows are leaves each. The langs'
    roots ascend by lang, null first. Where 7 divides crc32 of the decimal doc_id, the folded leaf has one more in n_chars; a row
    without n_chars or without doc_id isn't changed. An empty table gives an empty one; other columns play no part.
    """
    by_lang, over, langs = manifest(docs)
    top = roots(over).select("tree", F.lit(b"").alias("up"), "subroot", F.col("subroot").alias("top"))
    outer = _handed(_with_paths(over, top)).join(langs.select("place", "name", F.col("subroot").alias("own")), "place")
    outer = materialize(outer.select(F.col("name").alias("tree"), "up", F.col("own").alias("subroot"), "top"))
    blocks = _with_paths(by_lang, outer)

    def work(batches):
        for batch in batches:
            names = ("levels", "nodes", "up", "subroot", "top")
            for items, levels, nodes, up, subroot, top in zip(batch.column("items"), *(batch.column(c).to_pylist() for c in names)):
                rows = items.values
                digests, tampered = rows.field("digest").to_pylist(), rows.field("tampered").to_pylist()
                over_, root = path_read(up), top.hex()
                rest = "".join(digest for _, digest in over_)
                paths = list(zip(*Subtree(nodes, len(digests), min(HEIGHT, levels)).siblings())) or [()] * len(digests)
                ends = [folded((t or d).hex(), [*path, *over_]) for d, t, path in zip(digests, tampered, paths)]
                yield {
                    "doc_id": rows.field("doc_id"),
                    "leaf": [d.hex() for d in digests],
                    "subroot": [subroot.hex()] * len(digests),
                    "root": [root] * len(digests),
                    "proof_sha256": [sha("".join(digest for _, digest in path) + rest) for path in paths],
                    "folded_root": ends,
                    "verified": [end == root for end in ends],
                }

    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return per_batch(blocks.select("items", "levels", "nodes", "up", "subroot", "top"), work, kind)


def _leaf_sql(n_chars: str) -> str:
    said = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(said(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _grown_sql(name: str, leaves: str) -> str:
    return f"""{name} AS (
  SELECT tree, 0 AS up, place, n, h FROM {leaves}
  UNION ALL SELECT tree, up + 1, place // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY place)) FROM {name} WHERE n > 1 GROUP BY tree, up, place // 2, n)"""


ORACLE_SQL = f"""
WITH RECURSIVE raw AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("n_chars")} AS h,
         CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 AND doc_id IS NOT NULL AND n_chars IS NOT NULL THEN {_leaf_sql("(n_chars::HUGEINT + 1)")} ELSE {_leaf_sql("n_chars")} END AS start
  FROM documents),
leaves AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM raw),
{_grown_sql("low", "leaves")},
langs AS MATERIALIZED (SELECT '/' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
{_grown_sql("high", "langs")},
nodes AS MATERIALIZED (SELECT tree, up, place, n, h FROM low UNION ALL SELECT tree, up, place, n, h FROM high),
heights AS MATERIALIZED (SELECT tree, max(up) AS height FROM nodes GROUP BY tree),
steps AS MATERIALIZED (
  SELECT id, k, s.h AS beside, (pos >> x.up) & 1 AS odd FROM (
    SELECT id, tree, up, place AS pos, up AS k FROM leaves JOIN heights USING (tree), LATERAL (SELECT unnest(range(height)) AS up)
    UNION ALL
    SELECT l.id, '/', up, langs.place, o.height + up FROM leaves l JOIN langs ON langs.name = l.tree JOIN heights o ON o.tree = l.tree JOIN heights t ON t.tree = '/', LATERAL (SELECT unnest(range(t.height)) AS up)) x
  LEFT JOIN nodes s ON s.tree = x.tree AND s.up = x.up AND s.place = xor(x.pos >> x.up, 1)),
fold AS (
  SELECT id, 0 AS k, start AS h FROM leaves
  UNION ALL SELECT f.id, f.k + 1, sha256(CASE WHEN beside IS NULL THEN f.h WHEN odd = 1 THEN beside || f.h ELSE f.h || beside END) FROM fold f JOIN steps s ON s.id = f.id AND s.k = f.k),
ends AS (SELECT id, arg_max(h, k) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, string_agg(beside, '' ORDER BY k) AS said FROM steps GROUP BY id)
SELECT doc_id, l.h AS leaf, langs.h AS subroot, top.h AS root, sha256(coalesce(said, '')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM leaves l JOIN langs ON langs.name = l.tree JOIN high top ON top.n = 1 JOIN ends USING (id) LEFT JOIN proofs USING (id)
"""
