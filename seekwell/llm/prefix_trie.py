"""The trie of conversations' common beginnings, measured by its Euler tour.

A node is a distinct sequence of turns; it is named by the smallest conversation that begins with
it, and its depth. The tour walks around the trie: each node gives an arc that enters it and one
that leaves it, each arc has one successor, and a list ranking gives every arc its place. What
lies below a node is then what the tour meets between its two arcs, so sums over a subtree are
differences of two running totals.

The list is ranked in three steps. Nodes in order of name lie along the paths of the trie, so
batches of them first join arcs that follow each other into runs; runs are then ranked by pointer
jumping, the distance doubling in each round; and arcs count on from the start of their run. No step
holds a node's children, a conversation or a subtree in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import crc32_sql, read, written
from seekwell.llm.scans import ranked, running

#: A conversation begins like the last one before it whose number this divides, for up to ``MOST_SHARED`` - 1 turns.
FAMILY, MOST_SHARED = 5, 9
#: Bytes of ids that are sent together.
_CHUNK = 1 << 16
#: Jumps between two written tables.
_JUMPS = 3
NODE = ["depth", "p1", "p2"]


def original_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, said, size)``: turns numbered from 0, with a digest of role and text and the text's bytes."""
    c = {n: F.coalesce(F.col(n), F.lit("")) for n in ("role", "text")}
    said = F.unhex(F.md5(F.concat(F.octet_length(c["role"]).cast("string"), F.lit(":"), c["role"], c["text"])))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), said.alias("said"), F.octet_length(c["text"]).cast("long").alias("size")
    )
    return ranked(turns, ["conv_id"], ["turn", "said"])


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, depth, said, size)`` of rebuilt conversations, from depth 1, and their ``lengths(conv_id, length)``.

    The first h turns are those of the family's first conversation, the rest are the
    conversation's own after its first h; h comes from the checksum of its id.
    """
    ids = turns.where("pos = 0").select("conv_id", F.col("n").alias("own"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).alias("shared")
    base = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n"))
    plan = ids.select("conv_id", "own", shared, (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).join(base, "base", "left")
    given = F.least(F.col("shared"), F.coalesce("base_n", F.lit(0)))
    rest = F.greatest(F.col("own") - F.col("shared"), F.lit(0))
    plan = written(plan.select("conv_id", "base", "shared", given.alias("given"), (given + rest).alias("length")))
    first = turns.where(F.col("pos") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), "pos", "said", "size")
    taken = plan.where("given > 0").join(first, "base").where("pos < given").select("conv_id", (F.col("pos") + 1).alias("depth"), "said", "size")
    own = turns.join(plan.select("conv_id", "shared", "given"), "conv_id").where("pos >= shared").select(
        "conv_id", (F.col("pos") - F.col("shared") + F.col("given") + 1).alias("depth"), "said", "size"
    )
    return taken.unionByName(own), plan.select("conv_id", "length")


def paths(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, p1, p2, b1, b2, size)``: 128 bits that name the turns up to here, and those before.

    A turn's bits depend on its place, and a sequence's bits are those of its turns, summed bitwise; so
    long conversations are added up in blocks.
    """
    bits = [F.xxhash64("depth", "said"), F.xxhash64(F.lit(7), "said", "depth")]
    own = turns.select("conv_id", "depth", "size", *(b.alias(n) for b, n in zip(bits, ("t1", "t2"), strict=True)))
    summed = running(own, ["conv_id"], "depth", {"p1": F.col("t1"), "p2": F.col("t2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return summed.select(
        "conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("t1")).alias("b1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("b2"), "size"
    )


def _nodes(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """Nodes ``(conv_id, depth, p1, p2, n_convs, size, parent)``; the root is at depth 0, without bits."""
    named = path.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.first("b1").alias("b1"), F.first("b2").alias("b2")
    )
    zero = F.lit(0).cast("long")
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("size"), zero.alias("b1"), zero.alias("b2")
    )
    every = written(named.unionByName(root))
    above = every.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("b1"), F.col("p2").alias("b2"), F.col("conv_id").alias("parent"))
    return every.join(above, ["depth", "b1", "b2"], "left").select("conv_id", *NODE, "n_convs", "size", "parent")


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with their number of children, first child and next sibling, both by conversation.

    Siblings are numbered by ranges, so a node with very many children is no task's own.
    """
    placed = ranked(nodes.drop("p1", "p2"), ["parent", "depth"], ["conv_id"]).withColumnRenamed("n", "_siblings")
    placed = written(placed)
    firsts = placed.where("pos = 0 AND depth > 0").select(
        F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("child"), F.col("_siblings").alias("n_children")
    )
    after = placed.where("pos > 0").select("parent", "depth", (F.col("pos") - 1).alias("pos"), F.col("conv_id").alias("sibling"))
    out = placed.join(firsts, ["conv_id", "depth"], "left").join(after, ["parent", "depth", "pos"], "left")
    return out.select("conv_id", "depth", "parent", "n_convs", "size", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "child", "sibling")


_ARC = np.dtype([("conv", "<i8"), ("depth", "<i8"), ("leaves", "<i8")])
_RUN_SCHEMA = "conv_id long, depth long, leaves boolean, head_conv long, head_depth long, head_leaves boolean, at long, next_conv long, next_depth long, next_leaves boolean"


def _arcs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Arcs of some nodes, entering and leaving ones by turns, and their successors; the tour's end has depth -1."""
    n = len(pdf)
    conv, depth = pdf["conv_id"].to_numpy(np.int64), pdf["depth"].to_numpy(np.int64)
    child, sibling, parent = (pdf[c].fillna(0).to_numpy(np.int64) for c in ("child", "sibling", "parent"))
    has_child, has_sibling = pdf["n_children"].to_numpy(np.int64) > 0, pdf["sibling"].notna().to_numpy()
    arcs, nexts = np.empty(2 * n, _ARC), np.empty(2 * n, _ARC)
    for side in (0, 1):
        arcs["conv"][side::2], arcs["depth"][side::2], arcs["leaves"][side::2] = conv, depth, side
    nexts["conv"][::2] = np.where(has_child, child, conv)
    nexts["depth"][::2] = np.where(has_child, depth + 1, depth)
    nexts["leaves"][::2] = ~has_child
    nexts["conv"][1::2] = np.where(has_sibling, sibling, parent)
    nexts["depth"][1::2] = np.where(has_sibling, depth, depth - 1)  # the root has neither
    nexts["leaves"][1::2] = ~has_sibling
    return arcs, nexts


def joined_runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Arcs of a batch of nodes in runs: each arc with its run's first one and its place in the run.

    A run's last arc also tells the arc that comes next, which is the first of another run.
    """
    for pdf in parts:
        arcs, nexts = _arcs(pdf)
        if not len(arcs):
            continue
        order = np.argsort(arcs, order=("conv", "depth", "leaves"))
        there = np.minimum(np.searchsorted(arcs[order], nexts), len(arcs) - 1)
        inside = arcs[order][there] == nexts
        jump = np.where(inside, order[there], -1)
        first = np.ones(len(arcs), bool)
        first[jump[inside]] = False
        head, at = np.empty(len(arcs), np.int64), np.empty(len(arcs), np.int64)
        front = np.flatnonzero(first)
        start, step = front.copy(), 0
        while len(front):  # all runs grow by an arc at a time
            head[front], at[front] = start, step
            onward = jump[front]
            front, start, step = onward[onward >= 0], start[onward >= 0], step + 1
        last = ~inside
        columns = {"conv_id": arcs["conv"], "depth": arcs["depth"], "leaves": arcs["leaves"] == 1}
        columns |= {"head_conv": arcs["conv"][head], "head_depth": arcs["depth"][head], "head_leaves": arcs["leaves"][head] == 1, "at": at}
        columns |= {n: pd.array(np.where(last, nexts[f], 0), "Int64") for n, f in (("next_conv", "conv"), ("next_depth", "depth"))}
        out = pd.DataFrame(columns | {"next_leaves": pd.array(nexts["leaves"] == 1, "boolean")})
        out.loc[~last, ["next_conv", "next_depth", "next_leaves"]] = pd.NA
        yield out


def _to_end(runs: DataFrame) -> DataFrame:
    """``runs(conv, depth, leaves, length, next_*)`` to ``(conv, depth, leaves, left)``: arcs from a run's start to the tour's end.

    Pointer jumping: each run knows a run further on and the arcs up to it, and takes over what that one knows.
    """
    key = ["conv", "depth", "leaves"]
    state = written(runs.select(*key, F.col("length").alias("left"), *(f"next_{k}" for k in key)))
    while not state.where("next_depth >= 0").isEmpty():
        for _ in range(_JUMPS):
            far = state.select(*(F.col(k).alias(f"next_{k}") for k in key), F.col("left").alias("_more"), *(F.col(f"next_{k}").alias(f"_{k}") for k in key))
            done = state.where("next_depth < 0")
            on = state.where("next_depth >= 0").join(far, [f"next_{k}" for k in key])
            state = on.select(*key, (F.col("left") + F.col("_more")).alias("left"), *(F.col(f"_{k}").alias(f"next_{k}") for k in key)).unionByName(done)
        state = written(state)
    return state.select(*key, "left")


def tour(nodes: DataFrame) -> DataFrame:
    """``(conv_id, depth, leaves, place)``: the arcs of the Euler tour of ``nodes``, numbered from 0."""
    along = nodes.select("conv_id", "depth", "parent", "child", "sibling", "n_children").repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    arcs = written(along.mapInPandas(joined_runs, _RUN_SCHEMA))
    head = {f"head_{k}": k for k in ("conv", "depth", "leaves")}
    runs = arcs.where("next_depth IS NOT NULL").select(*(F.col(a).alias(b) for a, b in head.items()), (F.col("at") + 1).alias("length"), "next_conv", "next_depth", "next_leaves")
    left = _to_end(runs)
    ranks = left.select(*(F.col(b).alias(a) for a, b in head.items()), "left")
    total = nodes.agg((2 * F.count("*")).alias("_all"))
    return arcs.join(ranks, list(head)).crossJoin(F.broadcast(total)).select("conv_id", "depth", "leaves", (F.col("_all") - F.col("left") + F.col("at")).alias("place"))


def _chunks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows ``(depth, p1, p2, conv_id)`` to pieces of the joined ids of a node, in order."""
    part, seq = TaskContext.get().partitionId(), 0
    for pdf in parts:
        out = []
        for key, ids in pdf.groupby(NODE, sort=False)["conv_id"]:
            texts, size = [], 0
            for text in map(str, ids.tolist()):
                texts.append(text)
                size += len(text) + 1
                if size >= _CHUNK:
                    out.append((*key, part, seq, ",".join(texts)))
                    texts, size, seq = [], 0, seq + 1
            if texts:
                out.append((*key, part, seq, ",".join(texts)))
                seq += 1
        yield pd.DataFrame(out, columns=[*NODE, "part", "seq", "ids"])


def _hashed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces in order to a hash for each node; a hash goes on over batches."""
    key, hashed, out = None, None, []
    for pdf in parts:
        for depth, p1, p2, ids in pdf[[*NODE, "ids"]].itertuples(index=False, name=None):
            if (depth, p1, p2) != key:
                if key is not None:
                    out.append((*key, hashed.hexdigest()))
                key, hashed = (depth, p1, p2), hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=[*NODE, "ends"])
        out = []
    if key is not None:
        yield pd.DataFrame([(*key, hashed.hexdigest())], columns=[*NODE, "ends"])


def _ends(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """For each node at which conversations end the hash of their ids.

    Ids are sorted by ranges, so those of a node with very many come as some long pieces, and one task only hashes these.
    """
    zero = F.lit(0).cast("long")
    last = path.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(*NODE, "conv_id")
    none = lengths.where("length = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id")
    order = [*NODE, "conv_id"]
    pieces = last.unionByName(none).repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_chunks, "depth long, p1 long, p2 long, part int, seq long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq").mapInPandas(_hashed, "depth long, p1 long, p2 long, ends string")


NO_ENDS = hashlib.sha256(b"").hexdigest()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt ``conversations(conv_id, turn, role, text, ...)``.

    Columns: ``conv_id`` (the smallest member) and ``depth``, which together name a node, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Turns go by their number, null first, and
    then by role and text digest; null role and text are empty, repeated rows are turns of their own. Rows
    without a conv_id belong to no conversation and are left out. Other columns are ignored; an
    empty table has no nodes, not even a root.
    """
    turns, lengths = rebuilt_turns(original_turns(conversations))
    path = written(paths(turns))
    named = written(_nodes(path, lengths))
    nodes = written(_linked(named))
    at = {"conv_id": F.col("conv_id"), "depth": F.col("depth")}
    worth = nodes.select(*at, (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("own"))
    enters = ~F.col("leaves")
    tolled = tour(nodes).join(worth, list(at)).select(*at, "leaves", "place", *(F.when(enters, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "own")))
    totals = running(written(tolled), [], "place", {"_leaf": F.col("leaf"), "_own": F.col("own")})
    # the sum below a node: up to its leaving arc, less what came before its entering one
    below = totals.groupBy(*at).agg(
        *(F.sum(F.when(enters, F.col(c) - F.col(t)).otherwise(F.col(t))).alias(n) for n, t, c in (("n_leaves", "_leaf", "leaf"), ("saved_tokens", "_own", "own")))
    )
    ended = named.select(*at, *[c for c in NODE if c != "depth"]).join(_ends(path, lengths), NODE).select(*at, "ends")
    whole = nodes.join(below, list(at)).join(ended, list(at), "left")
    return whole.select(
        *at, F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def op12_prefix_trie_euler(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH RECURSIVE o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % {FAMILY} AS base, {crc32_sql("conv_id::VARCHAR")} % {MOST_SHARED} AS h FROM o GROUP BY conv_id),
k AS (SELECT n.*, least(n.h, coalesce(b.own, 0)) AS given, least(n.h, coalesce(b.own, 0)) + greatest(n.own - n.h, 0) AS length FROM n LEFT JOIN n b ON b.conv_id = n.base),
t AS (
  SELECT k.conv_id, o.pos + 1 AS depth, o.role, o.text FROM k JOIN o ON o.conv_id = k.base AND o.pos < k.given
  UNION ALL
  SELECT k.conv_id, o.pos - k.h + k.given + 1, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos >= k.h),
p AS (
  SELECT conv_id, 0 AS depth, '' AS name, 0 AS size FROM k
  UNION ALL
  SELECT t.conv_id, t.depth, sha256(p.name || ':' || strlen(t.role)::VARCHAR || ':' || t.role || t.text), strlen(t.text) FROM p JOIN t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1),
v AS (
  SELECT depth, name, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
         sha256(coalesce(string_agg(CASE WHEN k.length = depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM p JOIN k ON k.conv_id = p.conv_id GROUP BY depth, name),
a AS (
  -- every node with all nodes above it and itself
  SELECT v.name, v.depth, u.name AS top, u.depth AS top_depth, u.conv_id AS top_conv
  FROM v JOIN p ON p.conv_id = v.conv_id AND p.depth <= v.depth JOIN v u ON u.name = p.name AND u.depth = p.depth),
c AS (SELECT top AS name, top_depth AS depth, count(*) AS n_children FROM a WHERE depth = top_depth + 1 GROUP BY ALL),
w AS (
  SELECT a.top AS name, a.top_depth AS depth, sum((c.n_children IS NULL)::INT) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved_tokens
  FROM a JOIN v ON v.name = a.name AND v.depth = a.depth LEFT JOIN c ON c.name = a.name AND c.depth = a.depth GROUP BY a.top, a.top_depth)
SELECT v.conv_id, v.depth::BIGINT AS depth, u.top_conv AS parent_conv_id, v.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       w.n_leaves::BIGINT AS n_leaves, w.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN w ON w.name = v.name AND w.depth = v.depth LEFT JOIN c ON c.name = v.name AND c.depth = v.depth
LEFT JOIN a u ON u.name = v.name AND u.depth = v.depth AND u.top_depth = v.depth - 1
"""
