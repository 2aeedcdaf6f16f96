"""What the packing stage holds doesn't grow with the texts that a worker has met."""

import random
import tracemalloc

import numpy as np
import pytest

from seekwell.llm import packing


@pytest.mark.parametrize(("words", "letters", "most_mb"), [(400_000, 8, 40), (300, 10_000, 5)], ids=["many", "long"])
def test_an_encoder_keeps_little_of_what_it_met(words, letters, most_mb):
    """Also of one text with very many different words, and of long parts, which scripts without spaces have."""
    r, encode = random.Random(3), packing.Encoder(packing.tokenizer_path())
    encode("warm up")
    text = " ".join("".join(r.choices("abcdefghijklmnop", k=letters)) for _ in range(words))
    tracemalloc.start()
    ids = encode(text)
    held = tracemalloc.get_traced_memory()[0] - len(ids)
    tracemalloc.stop()
    assert held < most_mb * 1e6


def test_parts_that_were_dropped_are_found_again():
    encode = packing.Encoder(packing.tokenizer_path())
    words = ["one", "Two", "three,", "four", "é", "six…", "x" * 100, ""] * 3
    want = [encode(w) for w in words]
    encode.known.most = encode.signs.most = 2
    encode.known.clear()
    assert [encode(w) for w in words] == want and len(encode.known) <= 2 and len(encode.known.older) <= 2
    assert encode(" ".join(words)) == b"".join(want)


@pytest.mark.parametrize("sent", [1, 3, 5_000_000])
def test_pieces_are_the_same_however_many_leave_at_once(spark, monkeypatch, sent):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "some words here " * 9), (3, "some words here " * 9), (4, "é")]
    docs, encode = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), packing.Encoder(packing.tokenizer_path())
    monkeypatch.setattr(packing, "SENT", sent)
    want = []
    for i, t in rows:
        ids = [*np.frombuffer(encode(t), "<u4").tolist(), packing.END_ID]
        want += [(i, k, at, ids[at : at + 4]) for k, at in enumerate(range(0, len(ids), 4))]
    got = packing.tokenized(docs, capacity=4, with_ids=True).collect()
    assert [(p.doc_id, p.piece, p.start, p.ids) for p in got] == want and all(p.length == len(p.ids) for p in got)
