"""GIF images, URL filters, preference pairs, and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seekwell.llm import gif, preferences, urls


def screen(*frames, wide=2, high=1, palette=b"\x00\x00\x00\xff\x00\x00\x00\xff\x00\x00\x00\xff"):
    """A GIF of frames (left, width, samples, disposal, clear index or None, delay)."""
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0x81, 0, 0), palette]
    for left, w, samples, disposal, clear, delay in frames:
        codes = [4, *samples, 5]
        bits = sum(c << (3 * i) for i, c in enumerate(codes[:4]))
        at = 12
        for c in codes[4:]:  # the table grows past 3 bits after the third sample
            bits |= c << at
            at += 4 if len(samples) > 2 else 3
        data = bits.to_bytes((at + 7) // 8, "little")
        out += [
            b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay, clear or 0, 0),
            b"\x2c" + struct.pack("<HHHHB", left, 0, w, high, 0) + b"\x02" + bytes([len(data)]) + data + b"\0",
        ]
    return b"".join([*out, b"\x3b"])


def colours(frame):
    return [tuple(p) for p in frame.screen.reshape(-1, 4).tolist()]


RED, GREEN, BLUE, BLACK, NONE = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 255), (0, 0, 0, 0)


def test_frames_times_disposal_and_transparency():
    keep = gif.decode(screen((0, 2, [1, 2], 1, None, 5), (1, 1, [3], 1, None, 7)))
    assert [colours(f) for f in keep] == [[RED, GREEN], [RED, BLUE]]
    assert [(f.start_ms, f.delay_ms) for f in keep] == [(0, 50), (50, 70)]
    clear = gif.decode(screen((0, 2, [1, 2], 2, None, 1), (1, 1, [3], 1, None, 1)))
    assert colours(clear[1]) == [NONE, BLUE]
    back = gif.decode(screen((0, 2, [1, 2], 1, None, 1), (0, 2, [3, 3], 3, None, 1), (1, 1, [0], 1, None, 1)))
    assert [colours(f) for f in back] == [[RED, GREEN], [BLUE, BLUE], [RED, BLACK]]
    through = gif.decode(screen((0, 2, [1, 2], 1, None, 1), (0, 2, [3, 0], 1, 3, 1)))
    assert colours(through[1]) == [RED, BLACK]
    assert through[0].histogram() == [[1, 0, 0, 1], [1, 0, 0, 1], [2, 0, 0, 0]]


def test_broken_images():
    whole = gif.encode(b"x" * gif.ROW)
    for data in (b"", b"GIF89a", b"PNG", whole[:-20], whole[:400], whole[:13]):
        with pytest.raises(gif.BrokenImage):
            gif.decode(data)
    with pytest.raises(ValueError):
        gif.encode(b"short")


@pytest.mark.parametrize("rows", [1, 63, 64, 65, 200])
@pytest.mark.parametrize("kind", ["noise", "same", "text"])
def test_round_trip(rows, kind):
    r, n = random.Random(rows), rows * gif.ROW
    data = {"noise": r.randbytes(n), "same": b"a" * n, "text": (b"the quick brown fox " * n)[:n]}[kind]
    frames = gif.decode(gif.encode(data))
    assert b"".join(f.samples for f in frames) == data
    assert len(frames) == -(-rows // gif.MOST_ROWS)
    assert gif.feature_of(frames) == plain_feature(data)


def plain_feature(payload):
    """The stored frames put together pixel by pixel."""
    wide, screen, shown = gif.ROW, {}, []
    size = wide * gif.MOST_ROWS
    for f, at in enumerate(range(0, len(payload), size)):
        before, part = dict(screen), payload[at : at + size]
        for i, b in enumerate(part):
            if b != 32:
                screen[i] = (b, 255 - b, b * 7 % 256) if f % 2 else (b, b, b)
        shown.append(dict(screen))
        if f % 3 == 1:
            for i in range(len(part)):
                screen.pop(i, None)
        elif f % 3 == 2:
            screen = before
    bins = [[sum(p[k] // 64 == q for s in shown for p in s.values()) for q in range(4)] for k in range(3)]
    return f"frames={len(shown)};ms={100 * len(shown)};" + ";".join(f"{c}={','.join(map(str, b))}" for c, b in zip("rgb", bins, strict=True))


def test_digests_and_frames(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (3, ""), (None, "é" * 96), (4, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, "g", 1) for i, t in rows], "doc_id long, text string, gif string, frame int")
    got = gif.digests(docs).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        same = [x for x in got if x.doc_id == i]
        for x in same:
            assert (x.n_bytes, x.payload_bytes) == (len(raw), len(padded))
            assert x.payload_sha256 == hashlib.sha256(padded).hexdigest()
            assert x.tail_crc32 == zlib.crc32(padded[-16:])
            assert x.media_sha256 == hashlib.sha256(gif.encode(padded)).hexdigest() and x.media_bytes == len(gif.encode(padded))
            assert x.feature == plain_feature(padded)
    frames = gif.timed_frames(gif.stored(docs)).collect()
    assert sorted(f.start_ms for f in frames if f.doc_id == 4) == [0, 100, 200]
    odd = spark.createDataFrame([(1, bytearray(b"no")), (2, None)], "doc_id long, gif binary")
    assert [(f.doc_id, f.frame, f.error) for f in gif.timed_frames(odd).collect()] == [(1, None, "no GIF header")]
    assert gif.digests(docs.limit(0)).collect() == []


URLS = [
    None,
    "",
    "no scheme/path",
    "http://EXAMPLE.org/es/x",
    "https://a.example.org/en/1?utm_source=z",
    "https://a.example.org/en/2#frag",
    "http://org/",
    "http://notorg/",
    "http://xorg/fr/",
    "http://shop.com/fr/a",
    "http://shop.com/de/a",
    "http://shop.com/it/a?utm_source=feed",
    "http://shop.com/it/a",
    "http://shop.com/it/b",
    "ftp://net?x=/://",
    "http://ÄB.net/Pfad",
]


def plain_rule(host, path):
    best = None
    for said, rh, rp in urls.RULES:
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp) and (best is None or len(rh + rp) > len(best[0])):
            best = (rh + rp, said)
    return best or (None, None)


@pytest.mark.parametrize("most", [urls.BROADCAST_BYTES, 0])
def test_rules_and_cascade(spark, most):
    rows = [(i, u) for i, u in enumerate(URLS * 3)] + [(None, URLS[11]), (7, URLS[11])]
    rows += [(1000 + i, f"http://h{i % 37}.net/p{i}" + ("?utm_source=1" if i % 5 == 0 else "")) for i in range(2000)]
    pages = spark.createDataFrame([(i, u, "k", 1, True) for i, u in rows], "page_id long, url string, host string, k1 int, listed boolean")
    got = urls.judged(pages, urls.tracked_addresses(pages), broadcast_bytes=most).collect()

    def parts(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        return "".join(c.lower() if c.isascii() else c for c in rest[:cut]), path

    listed = {"".join(parts(u)) for _, u in rows if u and "utm_source=" in u}
    want = []
    for i, u in rows:
        host, path = parts(u)
        rule, said = plain_rule(host, path)
        want.append((i, host, path, rule, said or ("block" if host + path in listed else "allow")))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert urls.judged(pages.limit(0), urls.tracked_addresses(pages.limit(0)), broadcast_bytes=most).collect() == []


@pytest.mark.parametrize("most", [urls.BROADCAST_BYTES, 0])
def test_membership_leaves_other_columns_alone(spark, most):
    big = (1 << 62) + 1
    rows = [(f"k{i % 50}" if i % 7 else None, big + i, [i], i) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, k1 long, _shard array<int>, _salt int").withColumn("listed", F.lit("old"))
    universe = df.selectExpr("key", "key IN ('k3', 'k44') AS listed")
    filters, shards = urls.cascades(universe, 10)
    got = urls.with_membership(df, "key", filters, shards, most)
    assert got.columns == ["key", "k1", "_shard", "_salt", "listed"] and shards > 3
    want = [(*r[:4], r[0] in ("k3", "k44")) for r in rows]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_cascade_is_exact():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, (20_000, 2), dtype=np.uint64)
    for share in (0, 0.01, 0.5, 1):
        listed = r.random(len(keys)) < share
        data = urls.build_cascade(keys, listed)
        assert (urls.Cascade(data).listed(keys) == listed).all()
        assert len(data) < 4 * max(1000, listed.sum() * 8)


def test_preference_pairs(spark):
    a = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": "héllo"}, {"role": "user", "text": ""}]
    b = a[:1] + [{"role": "assistant", "text": "go\naway"}]
    cases = [(1, a, b), (1, a, b), (2, a, a), (3, a, a[:1]), (None, [], b)]
    schema = "pair_id long, chosen_turns array<struct<role:string,text:string>>, rejected_turns array<struct<role:string,text:string>>"
    got = sorted(preferences.formatted(spark.createDataFrame(cases, schema)).collect(), key=lambda x: (x.pair_id is None, x.pair_id or 0))
    show = lambda t: f"<|{t['role']}|>\n{t['text']}\n"
    first = got[0]
    assert (first.n_common, first.prompt, first.chosen, first.rejected) == (1, show(a[0]), show(a[1]) + show(a[2]), show(b[1]))
    start, end = map(int, first.chosen_mask.split(":"))
    assert first.chosen[start:end] == "héllo\n"
    start, end = map(int, first.rejected_mask.split(":"))
    assert first.rejected[start:end] == "go\naway\n"
    assert (got[2].n_common, got[2].chosen, got[2].rejected_mask) == (3, "", "")
    assert (got[3].n_common, got[3].rejected) == (1, "")
    assert (got[4].n_common, got[4].prompt, got[4].chosen) == (0, "", "")


def test_conversations_handle_nulls_and_ties(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, None, "user", "y")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in preferences.conversations(turns).collect()}
    assert got == {1: [("", ""), ("assistant", "a"), ("user", "b")], 2: [("user", "y")]}
    pairs = preferences.formatted(preferences.branched(turns)).collect()
    assert sorted(r.pair_id for r in pairs) == [1, 2]
    alone = {r.pair_id: r for r in preferences.formatted(preferences.branched(turns, 1)).collect()}
    assert all(r.rejected == "" or r.chosen for r in alone.values()) and len(alone) == 2
    assert preferences.branched(turns.limit(0)).collect() == []
    schema = "pair_id string, chosen_turns array<struct<role:string,text:string>>, rejected_turns array<struct<role:string,text:string>>"
    odd = preferences.formatted(spark.createDataFrame([("x", None, [("user", None)]), ("y", [], None)], schema)).orderBy("pair_id").collect()
    assert [(r.n_common, r.chosen, r.rejected) for r in odd] == [(0, "", "<|user|>\n\n"), (0, "", "")]


def test_branches_part_anywhere_and_leave_none_out(spark):
    rows = [(f"c{i}", t, ("user", "assistant")[t % 2], "hello" if t == 0 and i % 3 else f"{i}-{t}") for i in range(0, 200, 7) for t in range(1 + i % 5)]
    turns = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = preferences.formatted(preferences.branched(turns, 10)).collect()
    assert {r.pair_id for r in got} == {r[0] for r in rows} and len({r.n_common for r in got}) > 3
    assert any(r.n_common and r.chosen and r.rejected for r in got)


def test_pipeline_stages(spark):
    import corpus_pipeline

    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = line(60)
    rows = [(i, line(80) + ("\n" + shared if i % 4 == 0 else "")) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1] + " x"), (102, "junk"), (103, "spam spam spam spam spam " * 20), (104, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], schema)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    from seekwell.llm.mixing import mixture
    from seekwell.llm.quality import kept_documents
    from seekwell.llm.simhash import first_of_each_group
    from seekwell.llm.suffix_array import deduplicated

    kept = kept_documents(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {*range(60), 100, 101}
    single = first_of_each_group(kept)
    ids = {r.doc_id for r in single.collect()}
    assert ids >= set(range(60)) and 100 not in ids
    clean = deduplicated(single)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == ids
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert shared in texts[0] and all(shared not in texts[i] for i in range(4, 60, 4))
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    mix = mixture(clean)
    assert mix.columns == docs.columns and {r.doc_id for r in mix.collect()} <= ids
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mix", "packing"]


class OneBatch:
    """Stands in for a table of one batch of images."""

    dtypes = [("doc_id", "bigint"), ("gif", "binary")]

    def __init__(self, images):
        self.images = images

    def selectExpr(self, *names):
        return self

    def mapInPandas(self, read_all, schema):
        return list(read_all(iter([pd.DataFrame({"key": range(len(self.images)), "image": self.images})])))


def test_frames_of_many_images_are_sent_together(monkeypatch):
    images = [gif.encode(bytes([65 + i % 20]) * 192 * (1 + i % 3 * 50)) for i in range(300)] + [None, b"no image"]
    sent = gif.timed_frames(OneBatch(images))
    assert len(sent) == 1 and len(sent[0]) == sum(len(gif.decode(g)) for g in images[:300]) + 1
    monkeypatch.setattr(gif, "SENT_ROWS", 50)
    parts = gif.timed_frames(OneBatch(images))
    assert len(parts) > 5 and max(map(len, parts)) < 60
    assert pd.concat(parts).drop(columns="samples").to_dict("list") == sent[0].drop(columns="samples").to_dict("list")
