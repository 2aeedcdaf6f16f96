"""Repeats and near-duplicates against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seekwell.llm import repeats, simhash, suffix_array, suffix_automaton
from seekwell.llm.components import connected_components
from seekwell.llm.repeats import gram_hashes, sliding
from seekwell.llm.suffix_automaton import SuffixAutomaton

SCHEMA = "doc_id long, text string, key string, block int, k1 string, fp double, id string"


def frame(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 0.5, "z") for i, t in rows], SCHEMA)


def corpus(seed=3, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(12, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80)))]
        for _ in range(r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        rows.append((i * 3, "\n".join(parts)))
    rows += [(900, rows[5][1]), (901, rows[5][1]), (902, "ab " * 400), (903, "a" * 3000), (904, None), (905, ""), (906, "\x00" * 250)]
    rows += [(rows[7][0], rows[7][1]), (None, rows[5][1]), (None, None), (None, "b" * 130)]
    r.shuffle(rows)
    return rows


def order(i):
    return (1 << 63) - 1 if i is None else i


def byte_repeats(rows, n=100):
    first = {}
    raw = [(order(i), (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for s in range(len(b) - n + 1):
            w = b[s : s + n]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = []
    for (i, b), (name, _) in zip(raw, rows, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (i, s):
                gone[s : s + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((name, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def word_repeats(rows, n=13):
    first = {}
    split = [(order(i), (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (name, _) in zip(split, rows, strict=True):
        gone = set()
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone.update(range(s, s + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((name, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def as_sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", [3, 4])
def test_byte_repeats(spark, seed):
    rows = corpus(seed)
    assert as_sorted(suffix_array.digests(frame(spark, rows)).collect()) == as_sorted(byte_repeats(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_word_repeats(spark, seed):
    rows = corpus(seed)
    assert as_sorted(suffix_automaton.digests(frame(spark, rows)).collect()) == as_sorted(word_repeats(rows))


@pytest.mark.parametrize("module", [suffix_array, suffix_automaton])
def test_nothing_goes_but_by_the_method(spark, module, monkeypatch):
    rule = module.byte_rule() if module is suffix_array else module.word_rule()
    rule.compare = lambda *_: iter(())
    found = repeats.without_repeats(frame(spark, corpus()), rule, lambda text, spans: (len(spans),), "n int")
    assert {r.n for r in found.collect()} == {0}


def hot_line(n, words):
    """A line that stands in texts of random surroundings, some of which have a copy."""
    r = random.Random(8)
    line = "this line of a licence stands in very many texts, " + "and goes on " * words
    rows = []
    for i in range(n):
        text = " ".join(f"{r.choice('abcd')}{r.randrange(10**6)}" for _ in range(30)) + f" {line} " + " ".join(f"z{r.randrange(10**6)}" for _ in range(30))
        rows += [(i, text)] + [(n + i, text)] * (i % 5 == 0)
    return rows


@pytest.mark.parametrize("words", [0, 9])
def test_keys_of_very_many_tiles_are_split(spark, monkeypatch, words):
    monkeypatch.setattr(repeats, "HOT", 3)
    rows = hot_line(150, words)
    assert as_sorted(suffix_array.digests(frame(spark, rows)).collect()) == as_sorted(byte_repeats(rows))
    assert as_sorted(suffix_automaton.digests(frame(spark, rows)).collect()) == as_sorted(word_repeats(rows))


def test_splitting_leaves_few_tiles_with_a_key():
    rule, texts = suffix_array.byte_rule(), [t for _, t in hot_line(400, 0)]
    count = lambda tiles: np.unique(np.concatenate([t.key for t in tiles]), return_counts=True)
    keys, counts = count(rule.tiles(texts))
    hot = keys[counts > 100]
    split, after = count(rule.tiles(texts, (hot, np.full(len(hot), 6))))
    assert len(hot) and after.max() < counts.max() / 8
    assert sum(t.windows.sum() for t in rule.tiles(texts)) == sum(t.windows.sum() for t in rule.tiles(texts, (hot, np.full(len(hot), 6))))


def in_segments(rule):
    """A rule that cuts texts every few hundred bytes."""
    whole = rule.segments
    rule.segments = lambda raw, _: whole(raw, 300)
    return rule


def test_long_texts_are_compared_in_segments(spark, monkeypatch):
    r = random.Random(5)
    base = " ".join(f"w{r.randrange(500)}" for _ in range(900))
    rows = [(1, base), (2, "x " * 40 + base[1000:] + " " + base[:3000]), (3, base[700:2000] + "a" * 2000), (4, "q" * 900)]
    for make, brute in ((suffix_array, byte_repeats), (suffix_automaton, word_repeats)):
        name = "byte_rule" if make is suffix_array else "word_rule"
        plain = getattr(make, name)
        monkeypatch.setattr(make, name, lambda *a, f=plain: in_segments(f(*a)))
        assert as_sorted(make.digests(frame(spark, rows)).collect()) == as_sorted(brute(rows))


def test_very_long_words_are_words(spark):
    word, other = "v" * 70_000, "v" * 70_000 + "w"
    text = lambda w: " ".join([*(f"a{i}" for i in range(9)), w, *(f"b{i}" for i in range(9))])
    rows = [(1, text(word)), (2, text(other)), (3, text(word))]
    assert as_sorted(suffix_automaton.digests(frame(spark, rows)).collect()) == as_sorted(word_repeats(rows))


def test_groups_have_all_occurrences(spark):
    rows = [r for r in corpus(3, 25) if r[0] not in (902, 903, 906)]
    got = suffix_array.repeat_groups(frame(spark, rows)).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    groups = {}
    for g in got:
        groups.setdefault((g["repeat"], g.length), []).append((g.doc_id, g.start))
    assert groups
    for (_, n), places in groups.items():
        content = {b[s : s + n] for i, s in places for k, b in raw if k == i and len(b) >= s + n} if None not in [i for i, _ in places] else set()
        if not content:
            continue
        (one,) = [c for c in content if all(any(k == i and b[s : s + n] == c for k, b in raw) for i, s in places)]
        want = [(k, s) for k, b in raw for s in range(len(b) - n + 1) if b[s : s + n] == one]
        assert n >= 100 and sorted(places, key=repr) == sorted(want, key=repr)
    covered = {(g.doc_id, s) for g in got for s in range(g.start, g.start + g.length)}
    counts = {}
    for k, b in raw:
        for s in range(len(b) - 99):
            counts.setdefault(b[s : s + 100], []).append((k, s))
    assert covered == {(k, x) for places in counts.values() if len(set(places)) > 1 for k, s in places for x in range(s, s + 100)}


def test_occurrences_leave_a_task_in_pieces(monkeypatch):
    """Verdicts and occurrences of a block with many nested repeats are never one frame."""
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh", k=1200))
    rule = suffix_array.byte_rule()
    docs = pd.DataFrame({"block": np.int32(0), "id": range(60), "there": True, "text": [base[a : a + r.randrange(150, 400)] for a in r.choices(range(700), k=60)]})

    def made():
        wanted = repeats._keys(rule, docs).assign(level=0)
        tiles = repeats._cut_tiles(rule, docs, wanted).sort_values(["key", "digest", "id", "start"])
        said = list(repeats._compared(rule, repeats._grouped, iter([tiles])))
        return said, list(repeats._marked(rule, docs, pd.concat(said)))

    whole = pd.concat(made()[1])
    monkeypatch.setattr(repeats, "_SENT", 500)
    monkeypatch.setattr(repeats, "_ROWS", 100)
    said, found = made()
    most = max(len(s) for f in said for s in f["spans"])
    assert len(said) > 5 and max(f["spans"].map(len).sum() for f in said) <= 500 + most
    assert len(found) > 5 and max(map(len, found)) <= 100 + most // repeats._MARK.itemsize
    order = list(whole.columns)
    assert pd.concat(found).sort_values(order).to_numpy().tolist() == whole.sort_values(order).to_numpy().tolist()


def test_no_rows(spark):
    none = frame(spark, [])
    assert suffix_array.digests(none).collect() == []
    assert suffix_automaton.digests(none).collect() == []
    assert simhash.near_duplicates(none).collect() == []
    assert simhash.first_of_each_group(none).collect() == []
    assert suffix_array.deduplicated(none).collect() == []


def test_deduplicated_keeps_rows_columns_and_characters(spark):
    rows = [(1, "é" * 80), (2, "x" + "é" * 80), (3, "clean"), (3, "clean"), (None, "é" * 80), (4, None)]
    out = suffix_array.deduplicated(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    got = as_sorted((r.doc_id, r.text) for r in out.collect())
    # every window of é's starts earlier too, but for the two that begin with either byte of the first é
    assert got == as_sorted([(1, "é"), (2, "x"), (3, "clean"), (3, "clean"), (None, ""), (4, "")])
    assert len(got) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=40), min_size=2, max_size=5))
def test_later_repeats_find_every_window(texts):
    tiles = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    n = 4
    got = [set() for _ in tiles]
    for i, at, length, _ in suffix_array.later_repeats(tiles, [(i, 0) for i in range(len(tiles))], [False] * len(tiles), n):
        got[i].update(range(at, at + length))
    seen = set()
    for i, t in enumerate(texts):
        want = set()
        for s in range(len(t) - n + 1):
            if t[s : s + n] in seen:
                want.update(range(s, s + n))
            seen.add(t[s : s + n])
        assert got[i] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=30), min_size=1, max_size=5))
def test_automaton_knows_first_owners(sequences):
    machine = SuffixAutomaton()
    for i, s in reversed(list(enumerate(sequences))):
        machine.add(s, i)
    machine.settle()
    first = {}
    for i, s in enumerate(sequences):
        for k in range(len(s) - 2):
            first.setdefault(tuple(s[k : k + 3]), i)
    for s in sequences:
        want = [(k + 3, first[tuple(s[k : k + 3])]) for k in range(len(s) - 2)]
        assert list(machine.first_owners(s, 3)) == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 13, 69, 100])
def test_gram_hashes_and_minima(n):
    values = np.array([xxhash.xxh64_intdigest(bytes([i % 7])) for i in range(300)], np.uint64)
    h = gram_hashes(values, n)[: 300 - n + 1]
    for a in range(0, 300 - n + 1, 11):
        for b in range(0, 300 - n + 1, 13):
            assert (h[a] == h[b]) == bool((values[a : a + n] == values[b : b + n]).all())
    assert sliding(values, n).tolist() == [int(values[i : i + n].min()) for i in range(300 - n + 1)]


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(spark):
    rows = [r for r in corpus(9, 80)]
    base = "one two three four five six seven eight nine ten " * 20
    rows += [(5000 + i, base + f"tail{i}") for i in range(30)] + [(4000, None), (4001, " \n")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    name = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            name[find(k)] = min(name.get(find(k), i), i)
    want = [(i, f"{fps[k]:016x}", name.get(find(k))) for k, (i, _) in enumerate(rows)]
    assert as_sorted(got) == as_sorted(want)
    kept = simhash.first_of_each_group(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert kept.count() == len({find(k) for k in range(len(rows))})


def test_golay_keys_meet_within_four_bits():
    r = np.random.default_rng(1)
    table = simhash.decoding_table()
    assert sorted({(row >= 0).sum() for row in table}) == [1, 6]
    for _ in range(200):
        a = r.integers(0, 1 << 63, dtype=np.uint64)
        b = a
        for bit in r.choice(64, r.integers(0, 5), replace=False):
            b ^= np.uint64(1) << np.uint64(bit)
        keys = [set(simhash.golay_keys(np.array([x], np.uint64), table)[1].tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def test_large_groups_keep_their_connections():
    r = np.random.default_rng(2)
    fps = np.unique(np.concatenate([r.integers(0, 1 << 16, 60, dtype=np.uint64), np.uint64(1 << 40) + np.arange(64, dtype=np.uint64)]))
    u, v = simhash.linked(np.zeros(len(fps), np.int32), fps, 4)
    assert len(u) < len(fps)

    def parts(pairs):
        of = {int(f): int(f) for f in fps}

        def find(x):
            while of[x] != x:
                x = of[x]
            return x

        for a, b in pairs:
            of[find(int(a))] = find(int(b))
        return {frozenset(int(g) for g in fps if find(int(g)) == find(int(f))) for f in fps}

    every = [(a, b) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= 4]
    assert parts(zip(u, v, strict=True)) == parts(every)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert got == want
