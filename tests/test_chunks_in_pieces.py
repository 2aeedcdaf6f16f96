"""Chunks leave a task in pieces, whatever a batch of texts holds."""

import pyarrow as pa

from seekwell.operators import chunking


class Rows:
    """Stands in for a table of one batch."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *names):
        return self

    def mapInArrow(self, cut, schema):
        return list(cut(iter([self.batch])))


def test_a_batch_of_texts_is_sent_in_pieces(monkeypatch):
    bodies = [f"line {i} of the text\n" * (40 * i) for i in range(40)] + [None, "", "ein Wort é"]
    names = [f"h{i}" for i in range(len(bodies))]
    monkeypatch.setattr(chunking, "SENT", 20_000)
    sent = chunking.chunked(Rows(pa.RecordBatch.from_arrays([pa.array(names), pa.array(bodies)], names=["content_hash", "body"])))
    assert len(sent) > 20 and all(sum(map(len, b.column("body").to_pylist())) < 20_000 + 3 * chunking.TARGET * 4 for b in sent)
    got = [tuple(r.values()) for b in sent for r in b.to_pylist()]
    assert got == [
        (n, i, a, b, t[a:b], chunking.default_tokens(t[a:b])) for n, t in zip(names, bodies, strict=True) if t is not None for i, (a, b) in enumerate(chunking.chunks(t))
    ]
