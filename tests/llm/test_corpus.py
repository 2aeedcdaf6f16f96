"""Quality, mixing, packing and sharding."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from seekwell.llm import mixing, packing, quality, sharding

SCHEMA = "doc_id long, text string, source string, words string, h int, size string, rank int, score string, _t int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "w", 1, "s", 2, "x", 3) for i, t, s in rows], SCHEMA)


TEXTS = [
    None,
    "",
    " \t\n",
    "one two three",
    "a b c d e f g h i j k l m n o p",
    "a b c d e a b c d e a b c d e f",
    "x x x x x x x x x x x x",
    "l one\nl one\n\n \nl two\nl one\n" + "word " * 3 + "z # $ | < >",
    "ein schöner Tag, an dem alle Worte länger sind als gestern und heute",
    "\x1c odd\x1dspace\x85kept\xa0together in one word or two " * 2,
    "the cat sat on the mat " * 300,
]


def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, covered = collections.Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    out = (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return (*out, n < 10 or 100 * len(covered) > 20 * n)


def test_base_counts_and_verdict(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "s"), (None, TEXTS[8], None)]
    labels = spark.createDataFrame([(8, 1, 0), (4, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judged(frame(spark, rows), labels).select("doc_id", *quality.COLUMNS).collect()
    assert sorted((repr(tuple(r)[:7]) for r in got)) == sorted(repr((i, *plain_base(t))) for i, t, _ in rows)
    assert all(r.kept <= (not r.base_failed) for r in got)
    assert [r.kept for r in got if r.doc_id == 8] == [True]
    kept = quality.kept_documents(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.kept for r in got)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_grams(text):
    w = [xxhash.xxh64_intdigest(x, 42) for x in (text or "").encode().split()]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(w, w[1:], strict=False)]
    return [signed(x) % quality.BUCKETS for x in w + two]


def test_likelihood_ratio(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    labels = spark.createDataFrame([(8, 1, 0), (5, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    weights, threshold = quality.fit(docs, labels)
    raw = collections.Counter(g for t in TEXTS for g in plain_grams(t))
    n = sum(raw.values())

    def plain_weights(ids):
        good = collections.Counter(g for k in ids for g in plain_grams(TEXTS[k]))
        m = sum(good.values())
        want = [0.0] * quality.BUCKETS
        for b, c in raw.items():
            want[b] = math.log((good[b] + quality.BUCKETS * c / n) / (m + quality.BUCKETS) / (c / n))
        return want

    def plain_score(want, t):
        g = plain_grams(t)
        return sum(want[x] for x in g) / len(g) if g else 0

    both = plain_weights((5, 6, 8))
    assert np.allclose(weights, both, atol=2e-6)
    scores = {r.doc_id: r.score for r in quality.judged(docs, labels).select("doc_id", "score").collect()}
    for i, t in enumerate(TEXTS):
        assert scores[i] == pytest.approx(plain_score(both, t), abs=1e-5)
    half = {k: signed(xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42))) % 2 for k in (5, 6, 8)}
    passing = [r.doc_id for r in quality.judged(docs, labels).collect() if r.doc_id in half and not r.base_failed]
    held_out = [plain_score(plain_weights([j for j in half if half[j] != half[k]]), TEXTS[k]) for k in passing]
    deviation = math.sqrt((len(passing) * np.var(held_out) + 1) / (len(passing) + 1))
    assert passing and threshold == pytest.approx(np.quantile(held_out, 0.01) - 7.4 * deviation / math.sqrt(len(passing)), abs=1e-5)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judged(frame(spark, []), none).collect() == []
    rows = [(1, TEXTS[4], "s"), (2, "short", "s")]
    assert sorted((r.doc_id, r.kept) for r in quality.judged(frame(spark, rows), none).collect()) == [(1, True), (2, False)]


def filled(sizes, weights, total):
    """Targets by handing the excess round until none is above."""
    fixed = {}
    while True:
        rest = total - sum(fixed.values())
        left = {s: weights[s] for s in sizes if s not in fixed}
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    r = np.random.default_rng(5)
    names = ["b", "a", "Z", "é", None, "", "ab"]
    rows = [(int(i), "w " * int(r.integers(0, 30)), names[int(r.integers(0, 7)) if i % 3 else 0]) for i in range(900)]
    rows += [(1, None, "a"), (None, "x y z", "only"), rows[10], rows[10]]
    got = mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    ordered = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ordered)}
    want = filled(sizes, weights, 1.5 * sum(sizes.values()))
    by_size = {v: k for k, v in sizes.items()}
    taken = collections.Counter()
    for x in got:
        source = by_size[x.source_size]
        assert x.target == pytest.approx(want[source])
        assert x.taken in (0, x.size, 2 * x.size)
        taken[source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    again = mixing.mixed(frame(spark, rows[::-1])).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    mix = mixing.mixture(frame(spark, rows))
    assert mix.columns == frame(spark, rows).columns
    assert sum(len(x.text.split()) for x in mix.collect()) == sum(taken.values())


@pytest.mark.parametrize("kind", ["null ids", "three ids", "equal rows"])
def test_targets_are_met_whatever_the_ids(spark, kind):
    word = "one two three four "
    if kind == "null ids":
        rows = [(None, f"{word}{i}", "abc"[i % 3]) for i in range(3000)]
    elif kind == "three ids":
        rows = [(i % 3, f"{word}{i}", "abc"[i % 2]) for i in range(3000)]
    else:
        rows = [(i % 3, word * (1 + i % 3), "abc"[i % 3]) for i in range(3000)]
    got = mixing.mixed(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by, sizes, longest = collections.Counter(), {}, 0
    for x in got:
        key = (x.source_size, x.target)
        by[key] += x.taken
        sizes[key] = x.target
        longest = max(longest, x.size)
        assert x.taken in (0, x.size, 2 * x.size)
    assert all(abs(by[k] - target) <= longest / 2 for k, target in sizes.items())
    mix = mixing.mixture(frame(spark, rows))
    assert sum(len(x.text.split()) for x in mix.collect()) == sum(by.values())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixed(frame(spark, rows[::-1]).repartition(7)).collect()))


def test_mixing_nothing(spark):
    assert mixing.mixed(frame(spark, [])).collect() == []
    assert [tuple(r) for r in mixing.mixed(frame(spark, [(1, None, "a")])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = [*TEXTS, "a<|endoftext|>b", "café x́", "İstanbul ΣΑΣ ODOS.", "don't we'll x's", "　  ", "word " * 9000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s"), (None, "no id", "s")]
    pieces = packing.tokenized(frame(spark, rows), with_ids=True)
    got = packing.packed(pieces).collect()
    joined = collections.defaultdict(list)
    for x in sorted(got, key=lambda x: x.start):
        joined[x.doc_id].append(x)
    for i, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = joined[i][:: 2 if i == 3 else 1]
        assert [k for x in own for k in x.ids] == ids
        for x in own:
            part = ids[x.start : x.start + x.length]
            assert x.length == len(part) <= 4096 and x.start == 4096 * x.piece
            assert x.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    bins = collections.defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(got) == pieces.count()


def test_open_bins_are_bounded_and_fullest_closes_first():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(8) == (2, 0)  # the bin with 3 free closes; 4 and 2 stay
    assert bins.open == 2
    assert bins.place(4) == (0, 6)
    assert bins.place(3) == (3, 0)
    assert bins.place(2) == (2, 8)
    assert bins.place(10)[1] == 0


def test_ids_are_those_of_the_tokenizer():
    """Random texts over signs, scripts, marks, odd spaces and special tokens."""
    from tokenizers import Tokenizer

    whole, encode, r = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path()), np.random.default_rng(6)
    pools = [
        [chr(c) for c in range(32, 127)],
        list("aAbBzZ.,;:!?%$#&*|'’<>|"),
        [chr(c) for c in range(0x80, 0x250)],
        list("İıſßŉǰΣςσΐßÅ\u030a\u0307\u0300\u0301\u0302 "),
        list("  \t\n\r\x0b\x0c\x1c\x85\xa0\u3000"),
        ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "a", "I"],
        [chr(c) for c in range(0x250, 0x3000)],
        [chr(c) for c in [*range(0x3000, 0xD800, 7), *range(0xE000, 0x11000, 11), *range(0x1D400, 0x1D800)]],
    ]
    texts = ["DİYARBAKIR, İ.", "Mİ? Sİ. ALİ,"]
    for _ in range(100_000):
        some = [pools[k] for k in r.choice(len(pools), r.integers(1, 4), replace=False)]
        texts.append("".join(p[r.integers(len(p))] for p in (some[r.integers(len(some))] for _ in range(r.integers(1, 15)))))
    wrong = [
        t
        for t, got in zip(texts, map(encode, texts), strict=True)
        if got != np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    ]
    assert wrong == []


def test_packing_fills_well():
    r = np.random.default_rng(1)
    bins, lengths = packing.BestFit(4096, packing.OPEN_BINS), r.integers(1, 4097, 30_000)
    for n in lengths.tolist():
        bins.place(n)
    assert lengths.sum() / 4096 / bins.made > 0.97


def test_packing_nothing(spark):
    assert packing.packed_documents(frame(spark, [])).collect() == []


@pytest.mark.parametrize("levels", [sharding._LEVELS, 2])
def test_shards_fit(spark, monkeypatch, levels):
    monkeypatch.setattr(sharding, "_LEVELS", levels)
    r = np.random.default_rng(4)
    rows = [(int(i), "x" * int(r.integers(0, 400)), "s") for i in range(500)]
    rows += [(1000, "y" * 5000, "s"), (1001, None, "s"), (None, "z", "s"), (7, "same", "s"), (7, "same", "s")]
    got = sharding.shards(frame(spark, rows), 3000).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    names = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))  # a tree's leaves
    for name, members in by.items():
        total = sum(x.n_bytes for x in members)
        assert all(x.shard_bytes == total and x.shard_docs == len(members) and x.depth == len(name) for x in members)
        assert total <= 3000 or len(members) == 1
        up = [x for x in got if name and x.shard.startswith(name[:-1])]
        assert not name or sum(x.n_bytes for x in up) > 3000  # only what was too large has split
    assert [x.fits for x in got if x.n_bytes == 5000] == [False]
    assert sharding.shards(frame(spark, [])).collect() == []
    assert [x.shard for x in sharding.shards(frame(spark, rows[:3])).collect()] == ["", "", ""]
