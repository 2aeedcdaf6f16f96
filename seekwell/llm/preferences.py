"""Preference pairs of conversations: a shared prompt, and two completions with loss masks.

A turn is rendered as ``<|role|>``, a line end, its text, a line end. The longest common
prefix of the two lists of turns is rendered once as the prompt; what follows on either
side is its completion. A mask lists the stretches of a completion that count for the
loss, the texts of assistant turns with their line end, as ``start:end`` in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.llm.common import read

_RENDERED = "concat('<|', t.role, '|>\\n', t.text, '\\n')"


def conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` to ``(conv_id, turns)``, in order of the turn.

    Turns with equal numbers go by role, then text, and null numbers first. A null role or
    text is empty. Turns without a conv_id belong to no conversation.
    """
    clean = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return clean.groupBy("conv_id").agg(ordered.alias("turns")).withColumn(
        "turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    )


def _common(a: str, b: str) -> Column:
    """Number of turns that two lists share from their start on."""
    return F.expr(
        f"CASE WHEN least(size({a}), size({b})) = 0 THEN 0 ELSE coalesce(array_min(filter("
        f"sequence(0, least(size({a}), size({b})) - 1), i -> {a}[i] <> {b}[i])), least(size({a}), size({b}))) END"
    )


def _joined(turns: str) -> str:
    return f"array_join(transform({turns}, t -> {_RENDERED}), '')"


def _mask(turns: str) -> str:
    return f"""aggregate({turns}, named_struct('at', 0, 'spans', cast(array() AS array<string>)),
        (s, t) -> named_struct(
            'at', s.at + length({_RENDERED}),
            'spans', CASE WHEN t.role = 'assistant' THEN concat(s.spans, array(concat(
                cast(s.at + length(t.role) + 5 AS string), ':', cast(s.at + length({_RENDERED}) AS string))))
                ELSE s.spans END),
        s -> array_join(s.spans, ','))"""


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen_turns, rejected_turns)`` to prompts and masked completions.

    Gives ``(pair_id, n_common, prompt, chosen, chosen_mask, rejected, rejected_mask)``. A side
    that is a prefix of the other has an empty completion and mask; pairs stay as they
    come, repeats included. A null list of turns is empty; a null role or text is empty too.
    """
    sides = ("chosen_turns", "rejected_turns")
    clean = "coalesce(transform({0}, t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, ''))), array())".format
    pairs = pairs.select("pair_id", *(F.expr(clean(c)).alias(c) for c in sides))
    cut = pairs.withColumn("n_common", _common("chosen_turns", "rejected_turns"))
    tail = "slice({0}_turns, n_common + 1, size({0}_turns))".format
    return cut.select(
        "pair_id",
        "n_common",
        F.expr(_joined("slice(chosen_turns, 1, n_common)")).alias("prompt"),
        F.expr(_joined(tail("chosen"))).alias("chosen"),
        F.expr(_mask(tail("chosen"))).alias("chosen_mask"),
        F.expr(_joined(tail("rejected"))).alias("rejected"),
        F.expr(_mask(tail("rejected"))).alias("rejected_mask"),
    )


#: Conversations that are put in order to find each one's neighbour, on average.
NEIGHBOURS = 1000
_HASH = "cast(conv(substring(md5(cast(conv_id AS string)), 1, 15), 16, 10) AS bigint)"


def branched(turns: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``(pair_id, chosen_turns, rejected_turns)``: each conversation, and itself going on as another one does.

    The other is the next by id of those in the same bucket of a hash of the id, after the
    last the first; ids need not be numbers or follow each other. The place where the two part
    goes by the hash too, from before the first turn to behind the last. A conversation alone
    in its bucket is cut short there, and so is one whose neighbour has no turn after it. Every
    conversation gives a pair.
    """
    convs = conversations(turns).withColumn("_h", F.expr(_HASH))
    buckets = max(1, -(-convs.count() // neighbours))
    bucket = W.partitionBy(F.pmod("_h", F.lit(buckets)))
    order = bucket.orderBy("conv_id")
    other = F.when(F.count("*").over(bucket) > 1, F.coalesce(F.lead("turns").over(order), F.first("turns").over(order)))
    paired = convs.withColumn("_other", other).withColumn("_k", F.expr("cast(pmod(_h, size(turns) + 1) AS int)"))
    return paired.select(
        F.col("conv_id").alias("pair_id"),
        F.col("turns").alias("chosen_turns"),
        F.expr("concat(slice(turns, 1, _k), coalesce(slice(_other, _k + 1, size(_other)), slice(turns, 1, 0)))").alias("rejected_turns"),
    )


def op4_preference_pairs(spark, sf_dir: str) -> DataFrame:
    return formatted(branched(read(spark, sf_dir, "conversations")))


def _shown(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || chr(10)), '')"


def _spans(turns: str) -> str:
    """DuckDB: the mask of a list of turns."""
    before = f"length({_shown(f'{turns}[1:i - 1]')})"
    return f"""array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'),
    lambda i: ({before} + length({turns}[i].role) + 5)::VARCHAR || ':' || ({before} + length({turns}[i].role) + length({turns}[i].text) + 6)::VARCHAR), ',')"""


OP4_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS ts,
             ('0x' || substr(md5(conv_id::VARCHAR), 1, 15))::BIGINT AS h FROM t GROUP BY conv_id),
b AS (SELECT *, h % greatest(1, ceil(count(*) OVER () / {NEIGHBOURS}.0)::BIGINT) AS bucket, (h % (len(ts) + 1))::INTEGER AS k FROM c),
p AS (SELECT *, lead(ts) OVER (PARTITION BY bucket ORDER BY conv_id) AS later, first(ts) OVER (PARTITION BY bucket ORDER BY conv_id) AS front,
             count(*) OVER (PARTITION BY bucket) AS m FROM b),
s AS (SELECT conv_id, ts AS ch, list_concat(ts[1:k], CASE WHEN m > 1 THEN coalesce(later, front)[k + 1:] ELSE ts[1:0] END) AS rj FROM p),
n AS (SELECT *, coalesce(list_min(list_filter(range(least(len(ch), len(rj))), lambda i: ch[i + 1] <> rj[i + 1])), least(len(ch), len(rj)))::INTEGER AS n_common FROM s),
x AS (SELECT conv_id, n_common, ch[1:n_common] AS pr, ch[n_common + 1:] AS a, rj[n_common + 1:] AS b FROM n)
SELECT conv_id AS pair_id, n_common, {_shown("pr")} AS prompt, {_shown("a")} AS chosen, {_spans("a")} AS chosen_mask,
       {_shown("b")} AS rejected, {_spans("b")} AS rejected_mask FROM x
"""
