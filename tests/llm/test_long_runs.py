"""Repeats in long runs of a few words, whose tiles have one key."""

import random

import numpy as np
import pandas as pd

from seekwell.llm import repeats, suffix_array


def block_of(texts):
    return pd.DataFrame({"block": np.int32(0), "id": range(len(texts)), "there": True, "text": texts})


def occurrences(rule, docs, level):
    wanted = repeats._keys(rule, docs).assign(level=level)
    tiles = repeats._cut_tiles(rule, docs, wanted).sort_values(["key", "digest", "id", "start"])
    said = list(repeats._compared(rule, repeats._grouped, iter([tiles])))
    return said, pd.concat(repeats._marked(rule, docs, pd.concat(said)))


def test_repeats_of_a_tile_leave_a_task_in_pieces(monkeypatch):
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefgh", k=20)) + "the " * r.randrange(60, 200) + "".join(r.choices("abcdefgh", k=20)) for _ in range(40)]
    rule, docs = suffix_array.byte_rule(), block_of(texts)
    said, whole = occurrences(rule, docs, 1)
    assert max(len(s) for f in said for s in f["spans"]) <= 500 * repeats._MARK.itemsize
    assert whole.groupby(["doc_id", "start"]).size().max() > 50
    raw = [t.encode() for t in texts]
    names = {}
    for name, n, doc, start in whole.itertuples(index=False):
        assert names.setdefault((name, n), raw[doc][start : start + n]) == raw[doc][start : start + n]
    assert not whole.duplicated().any()
    monkeypatch.setattr(repeats, "_HELD", 50)
    monkeypatch.setattr(repeats, "_OF_ROW", 3)
    pieces = occurrences(rule, docs, 1)[1]
    order = list(whole.columns)
    assert pieces.sort_values(order).to_numpy().tolist() == whole.sort_values(order).to_numpy().tolist()


def test_long_tiles_that_differ_in_the_middle_have_other_digests():
    rule = suffix_array.byte_rule()
    found = None
    for i in range(300):
        phrase = f"some words that come again {i:03} "
        pair = [phrase * 9 + w + phrase * 9 for w in "!?"]
        base = [np.unique(np.concatenate([t.key for t in rule.tiles([p])])) for p in pair]
        if all(len(b) == 1 for b in base) and base[0] == base[1]:
            made = [next(rule.tiles([p], (base[0], np.array([1])), True)) for p in pair]
            if all(len(t.key) == 1 for t in made) and made[0].key == made[1].key:
                found = made
                break
    assert found and found[0].windows.tolist() == found[1].windows.tolist()
    assert found[0].digest.tolist() != found[1].digest.tolist()
