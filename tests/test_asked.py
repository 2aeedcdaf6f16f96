"""Queries and the cells that they ask come in small frames."""

import numpy as np

from seekwell.operators import vector


def test_cells_that_queries_ask_come_in_bounded_frames():
    q, cells = np.zeros(2), np.arange(vector.ASKED_ROWS - 1)
    frames = list(vector._rows(((i, q), None if i else "p", cells) for i in range(3)))
    assert max(map(len, frames)) <= vector.ASKED_ROWS
    found = [(i, c) for f in frames for i, c in zip(f["query_id"], f["cell"], strict=True)]
    assert found == [(i, c) for i in range(3) for c in range(len(cells))]
