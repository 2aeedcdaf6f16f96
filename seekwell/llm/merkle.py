"""A Merkle tree of a dataset whose changes make versions that share all nodes they leave alone.

Every language has a binary tree over its documents in order of their ids, and a tree over the
languages has the dataset's root. Leaves are numbered by ranges, and every ``BLOCK`` consecutive nodes are an
aligned block: a task builds the block's tree, whose top is a node of the level above, which is
cut into blocks in turn. So nothing larger than a block is ever in one task, and a tree of
10^10 leaves takes three such levels.

A changed leaf makes a version of the tree. ``Tree.changed`` copies the leaf's ancestors within
the block and shares every other node; the version goes on above with its block, by the
siblings which the upper trees give for that block, so versions are as spread as the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import crc32_sql, read, written
from seekwell.llm.scans import ranked

#: Leaves of an aligned block, as a power of two.
BITS = 12
_SIZE = 64


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row: each value with its length in bytes, so that no two rows read alike."""

    def shown(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(shown, (doc_id, source, lang, n_chars, text))), 256)


class Tree:
    """The nodes of an aligned block: level 0 has what it is made of, each further one half of them.

    ``height`` levels lie above level 0; a block that isn't full still has all of them, a node
    without a sibling being hashed alone.
    """

    def __init__(self, leaves: list[str], height: int) -> None:
        self.levels = [leaves]
        for _ in range(height):
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def siblings(self, i: int) -> list[tuple[int, str]]:
        """Level by level, whether the node on the way up is the right one, and its sibling ('' if none)."""
        out = []
        for level in self.levels[:-1]:
            other = i ^ 1
            out.append((i & 1, level[other] if other < len(level) else ""))
            i >>= 1
        return out

    def changed(self, i: int, new: str) -> list[str]:
        """A version: the new nodes from leaf ``i`` to the top. It has all others in common with this tree."""
        copied = [new]
        for level in self.levels[:-1]:
            other = level[i ^ 1] if i ^ 1 < len(level) else ""
            copied.append(digest(other, copied[-1]) if i & 1 else digest(copied[-1], other))
            i >>= 1
        return copied


def _packed(siblings: list[tuple[int, str]]) -> str:
    """A path as text: an ``l`` or ``r`` for the node's own side, and the sibling if there is one."""
    return "".join("lr"[side] + (other or "-") for side, other in siblings)


def _unpacked(path: str) -> list[tuple[int, str]]:
    out, at = [], 0
    while at < len(path):
        size = 1 if path[at + 1] == "-" else _SIZE
        out.append(("lr".index(path[at]), "" if size == 1 else path[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def _height(n: int, bits: int) -> int:
    """Levels above the nodes of a block of a level of ``n`` nodes."""
    return bits if n > 1 << bits else (n - 1).bit_length()


def _block_tree(nodes: pd.DataFrame, bits: int) -> tuple[pd.DataFrame, Tree]:
    nodes = nodes.sort_values("pos", kind="stable", ignore_index=True)
    return nodes, Tree(nodes["node"].tolist(), _height(int(nodes["n"].iloc[0]), bits))


_NODE = "part string, pos long, n long, node string"
_ABOVE = "part string, pos long, path string, top string"


def _tops(level: DataFrame, bits: int) -> DataFrame:
    """The nodes of the level above the blocks of ``level(part, pos, n, node)``."""

    def top(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes, tree = _block_tree(nodes, bits)
        block, n = int(nodes["pos"].iloc[0]) >> bits, int(nodes["n"].iloc[0])
        return pd.DataFrame({"part": [nodes["part"].iloc[0]], "pos": [block], "n": [-(-n >> bits)], "node": [tree.top]})

    return written(level.select(*(c.split()[0] for c in _NODE.split(", "))).groupBy("part", _block(bits)).applyInPandas(top, _NODE))


def _block(bits: int) -> Column:
    return F.shiftright("pos", bits).alias("block")


def _above(level: DataFrame, bits: int) -> DataFrame:
    """For every node of a level the packed path of siblings to its tree's top, and the top."""
    blocks = _tops(level, bits)
    deep = blocks.where("n > 1").isEmpty()
    higher = blocks.select("part", "pos", F.lit("").alias("path"), F.col("node").alias("top")) if deep else _above(blocks, bits)

    def paths(nodes: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        nodes, tree = _block_tree(nodes, bits)
        rest, top = up["path"].iloc[0], up["top"].iloc[0]
        found = [_packed(tree.siblings(i)) + rest for i in range(len(nodes))]
        return pd.DataFrame({"part": nodes["part"], "pos": nodes["pos"], "path": found, "top": top})

    right = higher.withColumnRenamed("pos", "block").groupBy("part", "block")
    return written(level.groupBy("part", _block(bits)).cogroup(right).applyInPandas(paths, _ABOVE))


def numbered_leaves(rows: DataFrame) -> DataFrame:
    """``rows(part, doc_id, node, ...)`` with ``pos`` and ``n``: by id, null last, then by digest."""
    keyed = rows.withColumn("_null", F.col("doc_id").isNull())
    return ranked(keyed, ["part"], ["_null", "doc_id", "node"]).drop("_null")


def _grown(leaves: DataFrame, bits: int) -> DataFrame:
    """For every block of leaves ``(part, block, path, subroot, root)``: its way up through both trees."""
    blocks = _tops(leaves, bits)
    single = blocks.where("n > 1").isEmpty()
    inside = blocks.select("part", "pos", F.lit("").alias("path"), F.col("node").alias("top")) if single else _above(blocks, bits)
    subroots = inside.where("pos = 0").select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("top").alias("node"))
    languages = ranked(subroots, [], ["name"])
    upper = _above(languages, bits).select("pos", F.col("path").alias("_path"), F.col("top").alias("root"))
    named = languages.select("pos", F.col("name").alias("part")).join(upper, "pos").drop("pos")
    return inside.join(named, "part").select(
        "part", F.col("pos").alias("block"), F.concat("path", "_path").alias("path"), F.col("top").alias("subroot"), "root"
    )


def _leaves(docs: DataFrame) -> DataFrame:
    """Every row's digest, and that of its changed row where there is one; texts aren't sent anywhere."""
    c = {n: F.col(n) for n in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.coalesce(F.crc32(c["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False)) & c["n_chars"].isNotNull()
    return docs.select(
        # null before all names, which keep their order
        F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("n")).alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(**c).alias("node"),
        F.when(hit, leaf(**c | {"n_chars": c["n_chars"].cast("decimal(38,0)") + 1})).alias("changed"),
    )


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Digests, roots and proofs of ``docs(doc_id, source, lang, n_chars, text, ...)``, a row each.

    Rows whose id's CRC-32 seven divides are tampered with: their ``n_chars`` is one more, unless it is
    null. ``folded_root`` is the root of the version which that makes, the tree's own root for
    all others, and ``verified`` tells whether both are equal. A null id is never tampered with and comes
    last in its language; rows with equal ids go by their digest, repeated rows are leaves of
    their own. A null language is the first one. Other columns are ignored; an empty table has no rows.
    """
    return _versions(docs, _PROOF, _proofs, bits)


def _versions(docs: DataFrame, schema: str, finish: Callable, bits: int) -> DataFrame:
    leaves = numbered_leaves(_leaves(docs))
    up = _grown(leaves, bits)

    def finished(nodes: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        return finish(nodes, above, bits)

    return leaves.groupBy("part", _block(bits)).cogroup(up.groupBy("part", "block")).applyInPandas(finished, schema)


def _fold(node: str, path: list[tuple[int, str]]) -> list[str]:
    """The new nodes of a version above ``node``, level by level."""
    out = []
    for side, other in path:
        node = digest(other, node) if side else digest(node, other)
        out.append(node)
    return out


def _proofs(nodes: pd.DataFrame, up: pd.DataFrame, bits: int) -> pd.DataFrame:
    nodes, tree = _block_tree(nodes, bits)
    above = _unpacked(up["path"].iloc[0])
    subroot, root = up["subroot"].iloc[0], up["root"].iloc[0]
    rest = "".join(other for _, other in above)
    proofs, folded = [], []
    for i, new in enumerate(nodes["changed"]):
        proofs.append(digest(*(other for _, other in tree.siblings(i)), rest))
        node = tree.top if new is None else tree.changed(i, new)[-1]
        folded.append(([node] + _fold(node, above))[-1])
    ids = nodes["doc_id"].astype("Int64")
    return pd.DataFrame({"doc_id": ids, "leaf": nodes["node"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": np.array(folded) == root})


_COPIED = "doc_id long, lang string, level int, pos long, node string"


def copied_nodes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """What each version of ``manifest`` has of its own: ``(doc_id, lang, level, pos, node)``.

    Level 0 is the changed leaf. The levels of the tree over languages come last, with a null
    language. All other nodes of a version are those of the tree itself.
    """

    def copied(nodes: pd.DataFrame, up: pd.DataFrame, bits: int) -> pd.DataFrame:
        nodes, tree = _block_tree(nodes, bits)
        above = _unpacked(up["path"].iloc[0])
        part, n = nodes["part"].iloc[0], int(nodes["n"].iloc[0])
        depth = (n - 1).bit_length()  # levels of the language's own tree
        out = []
        for i, new in enumerate(nodes["changed"]):
            if new is None:
                continue
            way = tree.changed(i, new)
            way += _fold(way[-1], above)
            side = sum(s << k for k, (s, _) in enumerate(above[max(0, depth - bits) :]))
            at, doc_id = int(nodes["pos"].iloc[i]), nodes["doc_id"].iloc[i]
            for level, node in enumerate(way):
                own = level <= depth
                place = at >> level if own else side >> (level - depth)
                out.append((doc_id, part[1:] if own and part[0] == "v" else None, level, place, node))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _COPIED.split(", ")]).astype({"doc_id": "Int64"})

    return _versions(docs, _COPIED, copied, bits)


def op13_merkle_versions(spark, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"))


def _shown(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


_LEAF = "sha256(" + " || ".join(map(_shown, ("doc_id", "source", "lang", "{0}", "text"))) + ")"

OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND n_chars IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 7 = 0
              THEN {_LEAF.format("(n_chars::HUGEINT + 1)")} END AS changed
  FROM documents),
p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d WINDOW w AS (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf)),
t AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM p
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lang, level, n, pos // 2),
s AS (SELECT lang, level AS height, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM s
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, n, pos // 2),
r AS (SELECT node AS root FROM u WHERE n = 1),
q AS (
  SELECT row_number() OVER () AS row, p.doc_id, p.lang, p.leaf, coalesce(p.changed, p.leaf) AS start, p.pos, s.pos AS upper_pos, s.height, s.subroot
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang),
b AS (
  SELECT q.row, t.level, (q.pos >> t.level) & 1 AS side, x.node AS other
  FROM q JOIN (SELECT DISTINCT lang, level FROM t WHERE n > 1) t ON q.lang IS NOT DISTINCT FROM t.lang
  LEFT JOIN t x ON x.lang IS NOT DISTINCT FROM q.lang AND x.level = t.level AND x.pos = xor(q.pos >> t.level, 1)
  UNION ALL
  SELECT q.row, q.height + u.level, (q.upper_pos >> u.level) & 1, x.node
  FROM q CROSS JOIN (SELECT DISTINCT level FROM u WHERE n > 1) u LEFT JOIN u x ON x.level = u.level AND x.pos = xor(q.upper_pos >> u.level, 1)),
f AS (
  SELECT row, 0 AS level, start AS node FROM q
  UNION ALL
  SELECT f.row, f.level + 1, CASE WHEN b.side = 1 THEN sha256(coalesce(b.other, '') || f.node) ELSE sha256(f.node || coalesce(b.other, '')) END
  FROM f JOIN b ON f.row = b.row AND f.level = b.level),
e AS (SELECT row, arg_max(node, level) AS folded_root FROM f GROUP BY row),
g AS (SELECT q.row, sha256(coalesce(string_agg(b.other, '' ORDER BY b.level), '')) AS proof_sha256 FROM q LEFT JOIN b ON q.row = b.row GROUP BY q.row)
SELECT q.doc_id, q.leaf, q.subroot, r.root, g.proof_sha256, e.folded_root, e.folded_root = r.root AS verified
FROM q JOIN e ON q.row = e.row JOIN g ON q.row = g.row CROSS JOIN r
"""
