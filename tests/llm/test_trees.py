"""The prefix trie and the Merkle tree against plain versions of both."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from seekwell.llm import merkle, prefix_trie, scans


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_ranks_and_totals_go_on_over_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_BITS", 3)
    r = random.Random(1)
    rows = [(r.choice("aaab") if r.random() < 0.9 else None, r.randrange(40)) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(6)
    found = scans.ranked(df, ["g"], ["v"]).collect()
    by = defaultdict(list)
    for x in found:
        by[x.g].append((x.pos, x.v))
        assert x.n == sum(g == x.g for g, _ in rows)
    for g, got in by.items():
        assert sorted(p for p, _ in got) == list(range(len(got)))
        assert [v for _, v in sorted(got)] == sorted(v for k, v in rows if k == g)
    summed = scans.running(scans.ranked(df.na.fill("none"), ["g"], ["v"]), ["g"], "pos", {"s": scans.F.col("v")}).collect()
    for g in {x.g for x in summed}:
        total = 0
        for x in sorted((x for x in summed if x.g == g), key=lambda x: x.pos):
            total += x.v
            assert x.s == total


# --- Merkle tree


def plain_manifest(rows, sep=2):
    def up(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + sep]) for i in range(0, len(out[-1]), sep)])
        return out

    def others(levels, i):
        for level in levels[:-1]:
            yield i & 1, level[i ^ 1] if i ^ 1 < len(level) else ""
            i >>= 1

    def leaf(row):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    langs = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        changed = n_chars
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
            changed = n_chars + 1
        langs[lang].append((doc_id, leaf((doc_id, source, lang, n_chars, text)), leaf((doc_id, source, lang, changed, text))))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        langs[name].sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    trees = {n: up([x[1] for x in langs[n]]) for n in names}
    top = up([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, (doc_id, node, changed) in enumerate(langs[name]):
            way = [*others(trees[name], i), *others(top, k)]
            folded = changed
            for side, other in way:
                folded = sha(other, folded) if side else sha(folded, other)
            root = top[-1][0]
            out.append((doc_id, node, trees[name][-1][0], root, sha(*(o for _, o in way)), folded, folded == root))
    return sorted(out, key=str)


DOC = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_proofs_and_versions_of_a_tree_of_several_blocks(spark, bits):
    r = random.Random(3)
    langs = ["en"] * 6 + ["é", "de", "", None]
    rows = [(i, r.choice(["s", None, ""]), r.choice(langs), r.choice([None, 3, 10**12]), r.choice(["a:b", None, "", "é" * 9])) for i in range(45)]
    rows += [rows[0], rows[0], (7, None, "en", 4, "x"), (7, None, "en", 5, "x"), (None, "s", "en", 1, "t"), (None, None, None, None, None), (-14, "s", "alone", 1, "y")]
    df = spark.createDataFrame(rows, DOC)
    clashing = df.selectExpr("*", "1 AS pos", "2 AS n", "'x' AS part", "3 AS block", "4 AS path", "5 AS node")
    got = merkle.manifest(clashing, bits)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_manifest(rows)


def test_a_version_copies_only_the_way_to_the_root(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"text {i}") for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    copied, proofs = merkle.copied_nodes(df, 2).collect(), {p.doc_id: p for p in merkle.manifest(df, 2).collect()}
    changed = {i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 0}
    assert {c.doc_id for c in copied} == changed == {i for i, p in proofs.items() if not p.verified}
    for doc_id in changed:
        own = sorted((c for c in copied if c.doc_id == doc_id), key=lambda c: c.level)
        size = sum(("en" if i % 3 else "de") == own[0].lang for i in range(60))
        assert len(own) == 1 + (size - 1).bit_length() + 1  # the leaf, its language's levels, the tree of two languages
        assert own[-1].node == proofs[doc_id].folded_root
        assert own[-1].lang is None and own[-1].pos == 0
        assert [c.pos for c in own[1:-1]] == [own[0].pos >> k for k in range(1, len(own) - 1)]


def test_an_empty_table_has_no_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 2, "t")], DOC)).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha()


# --- prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = [str(c) for c in convs if len(rebuilt[c]) == len(node)]
        parent = members[node[:-1]][0] if node else None
        out.append((convs[0], len(node), parent, len(convs), len(children), len(leaves), saved, sha(",".join(ends))))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


def test_nodes_of_rebuilt_conversations(spark, monkeypatch):
    monkeypatch.setattr(scans, "BLOCK_BITS", 2)
    r = random.Random(5)
    rows = []
    for c in [*range(0, 60), 100, 101, 1003, -7, -5]:
        for t in range(r.randrange(1, 13)):
            rows.append((c, r.choice([t, t, None]), r.choice(["user", "assistant", None]), r.choice(["hi", "é", "", None, f"t{t % 3}"])))
    rows += [(200 + k, t, "user", "same") for k in range(30) for t in range(3)]  # a node with very many members
    rows += [(300, t, "user", "x" * (t % 5)) for t in range(70)]  # a long one
    rows += [rows[0], rows[0], (None, 1, "user", "lost")]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    clashing = df.selectExpr("*", "1 AS pos", "2 AS n", "3 AS depth", "4 AS size", "5 AS parent", "6 AS said")
    got = prefix_trie.prefix_trie(clashing)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)


def test_the_tour_enters_and_leaves_every_node_once(spark):
    rows = [(c, t, "u", f"{t}" if t < 2 else f"{c}-{t}") for c in range(0, 50, 5) for t in range(12)]
    turns, lengths = prefix_trie.rebuilt_turns(prefix_trie.original_turns(spark.createDataFrame(rows, CONV)))
    nodes = prefix_trie._linked(prefix_trie._nodes(prefix_trie.paths(turns), lengths))
    arcs = sorted(prefix_trie.tour(nodes).collect(), key=lambda a: a.place)
    assert [a.place for a in arcs] == list(range(2 * nodes.count()))
    open_ = []
    for a in arcs:  # arcs nest
        if a.leaves:
            assert open_.pop() == (a.conv_id, a.depth)
        else:
            assert len(open_) == a.depth
            open_.append((a.conv_id, a.depth))
    assert not open_


def test_tables_without_conversations_have_no_nodes(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], CONV)).count() == 0
    # 7 of its turns would be another's, which isn't there: the root is all there is
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 7)
    (root,) = prefix_trie.prefix_trie(spark.createDataFrame([(c, 1, None, None)], CONV)).collect()
    assert tuple(root) == (c, 0, None, 1, 0, 1, 0, sha(str(c)))
