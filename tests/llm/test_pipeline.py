"""The whole pipeline on small tables, stage by stage against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from seekwell.llm import mixing, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def some_documents():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(2, 7))) for _ in range(500)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = line(70)
    texts = [line(80) + ("\n" + shared if i % 4 == 0 else "") for i in range(50)]
    texts += [texts[3], texts[3], texts[5].replace(" ", "  "), " ".join(texts[6].split()[:-1] + ["other"]), "junk", "spam spam spam spam spam " * 20, None, ""]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(3, texts[3], "en", None, 7), (None, texts[4], None, "s1", None)]


def rank(i):
    return (i is None, i or 0)


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_near_duplicates(rows):
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    return sorted((min(ids, key=rank) for ids in groups.values()), key=rank)


def plain_passages(rows, n=100):
    """Texts without byte strings that start earlier, cut at whole characters."""
    first, raw = {}, [(r.doc_id, (r.text or "").encode()) for r in rows]
    for i, b in raw:
        for s in range(len(b) - n + 1):
            place = (rank(i), s)
            first[b[s : s + n]] = min(first.get(b[s : s + n], place), place)
    out = []
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < (rank(i), s):
                gone[s : s + n] = True
        text = b.decode()
        ends = np.cumsum([len(c.encode()) for c in text]) if text else []
        kept = [c for c, e in zip(text, ends, strict=True) if not gone[e - len(c.encode()) : e].all()]
        out.append((i, "".join(kept)))
    return sorted(out, key=lambda x: (rank(x[0]), x[1]))


def test_each_stage_does_its_whole_job(spark, tmp_path):
    path = tables(spark, tmp_path, some_documents(), [(i, 1, 0) for i in range(20)] + [(None, 1, 0), (3, None, 0)])
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = stages["quality"](spark, docs, path)
    texts = {r.text for r in kept.collect()}
    assert kept.columns == docs.columns and len(kept.collect()) == 56 and not texts & {None, "", "junk"}
    single = stages["near_duplicates"](spark, kept, path)
    assert sorted((r.doc_id for r in single.collect()), key=rank) == plain_near_duplicates(kept.collect())
    clean = stages["passages"](spark, single, path)
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=lambda x: (rank(x[0]), x[1])) == plain_passages(single.collect())
    mixed = stages["mix"](spark, clean, path)
    taken = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(taken.values()) <= 2
    words = {r.doc_id: len((r.text or "").split()) for r in clean.collect()}
    sources = {r.doc_id: r.source for r in clean.collect()}
    targets = {sources[r.doc_id]: r.target for r in mixing.mixed(clean).collect()}
    for source, target in targets.items():
        got = sum(words[i] * n for i, n in taken.items() if sources[i] == source)
        assert abs(got - target) <= max(w for i, w in words.items() if sources[i] == source)
    pieces = stages["packing"](spark, mixed, path).collect()
    encode = packing.Encoder(packing.tokenizer_path())
    want = collections.Counter()
    for r in mixed.collect():
        ids = encode(r.text) + (1).to_bytes(4, "little")
        want[(r.doc_id, len(ids) // 4, zlib.crc32(ids))] += 1
    assert collections.Counter((p.doc_id, p.length, p.ids_crc32) for p in pieces) == want
    places = collections.defaultdict(list)
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 4096


def test_the_run_is_its_stages(spark, tmp_path):
    path = tables(spark, tmp_path, some_documents(), [(i, 1, 0) for i in range(20)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    digest = lambda df: hashlib.sha256(repr(sorted((repr(r) for r in df.select("doc_id", "piece", "length", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, path)) == digest(docs)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)]])
def test_an_empty_table_gives_an_empty_table(spark, tmp_path, labels):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], labels)).collect() == []
