"""Finding windows of symbols that repeat across a corpus, without gathering any group whole.

A window is ``length`` consecutive symbols of one document. Its key is the smallest hash
among its grams of ``gram`` symbols, so equal windows have equal keys. Consecutive windows
with the same key make a tile, about a third as long again as a window. Five steps, each a
shuffle of far less than the text but for the first:

1. Documents are dealt into blocks by hash. This exchange is used three times.
2. Each block sends each of its keys once. Those that two blocks have, or that a block has
   twice, go back to their blocks, with a level: 0, or how often a key that very many tiles
   have must be split. A split adds the smallest gram under another hash to the key.
3. Blocks cut the tiles of those keys. Equal tiles of a block make one row, with their first
   place and whether there are others.
4. Tiles meet by key, and each different one is taken once, with a weight for its copies.
   ``compare`` finds what each has in common with an earlier place, copies included; nothing
   else decides. Its verdicts go to the blocks that have the tile.
5. Blocks find the tiles again and remove what the verdicts say.

So a block sends one row for a passage, however many of its documents have it, and a task of
step 4 holds the different tiles of a key, which splitting keeps few. Contents are told apart by 64 bits
of key and 64 bits of digest.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from seekwell.llm.common import task_count

#: Rows without an id come after all others.
LAST_ID = (1 << 63) - 1
BLOCK_MB = 4
_BLOCKS_OF_TASK = 3
#: Tiles of a key, counted in each block, above which it is split.
HOT = 2000
_MOST_LEVELS = 16
_CHUNK = 1 << 19
_BATCH = 100_000
#: Bytes of verdicts, and occurrences, that a task sends at a time.
_SENT, _ROWS = 8_000_000, 100_000
#: Repeats of tiles that a task holds before it sends them, and most of a row.
_HELD, _OF_ROW = 250_000, 500
_NO_HASHES = np.zeros(0, np.uint64)


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i]), 99) for i in range(256)), np.uint64)


@lru_cache(256)
def _mix(level: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(bytes([level]), 7) | 1)


def gram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` values from each place on; places near the end have those that fit wrongly."""
    out, have, power, size, level = None, 0, values, 1, 0
    while True:
        if n & size:
            if out is None:
                out = power.copy()
            else:
                # append this run behind what is there already
                out[: len(out) - have] = out[: len(out) - have] * _mix(40 + level) + power[have:]
            have += size
        if have == n:
            return out
        nxt = power * _mix(level)
        nxt[: len(nxt) - size] += power[size:]
        power, size, level = nxt, size * 2, level + 1


def sliding(values: np.ndarray, n: int, pick: Callable = np.minimum) -> np.ndarray:
    """Minimum or maximum of the ``n`` values from each place on; shorter by n - 1."""
    size, out = 1, values
    while size * 2 <= n:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges [start, start + size) one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


@dataclass
class Tiles:
    """Tiles of a group of texts, an array entry each."""

    cut: Callable[[int, int], bytes]
    #: Names the content of a tile, with its key.
    digest: np.ndarray
    text: np.ndarray
    start: np.ndarray
    place: np.ndarray
    windows: np.ndarray
    key: np.ndarray
    base: np.ndarray
    #: Unsplit keys whose gram may be in a tile more than once.
    twice: np.ndarray

    def pick(self, keys: np.ndarray) -> np.ndarray:
        """Which tiles have one of the keys, which are sorted."""
        there = np.minimum(np.searchsorted(keys, self.base), len(keys) - 1)
        return np.flatnonzero(keys[there] == self.base)


@dataclass
class Rule:
    """What repeats, and how it is compared.

    ``segments`` cuts an encoded text into parts for counting and comparing, each with the
    number of its first symbol; a part ends with the first ``length`` - 1 symbols of the next.
    ``symbols`` turns such parts into one array of symbols, the number of each part, and a
    function that gives the bytes of a range of symbols; ``parse`` turns such bytes into
    symbols again. ``within``: an earlier place in the same document counts too. A text under
    ``shortest`` bytes has no window.
    """

    segments: Callable[[bytes, int], Iterator[tuple[int, bytes]]]
    symbols: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]]
    parse: Callable[[list[bytes]], list[np.ndarray]]
    values: Callable[[np.ndarray], np.ndarray]
    length: int
    gram: int
    within: bool
    shortest: int
    compare: Callable = field(repr=False, default=None)
    groups: Callable = field(repr=False, default=None)

    def chunks(self, texts: list[str]) -> Iterator[tuple]:
        """Segments together, about ``_CHUNK`` bytes at a time; none is much longer."""
        texts_of, firsts, group, size = [], [], [], 0
        for i, t in enumerate(texts):
            for first, part in self.segments(t.encode("utf-8", "surrogatepass"), _CHUNK):
                texts_of.append(i)
                firsts.append(first)
                group.append(part)
                size += len(part)
                if size >= _CHUNK:
                    yield np.array(texts_of), np.array(firsts), *self.symbols(group)
                    texts_of, firsts, group, size = [], [], [], 0
        if group:
            yield np.array(texts_of), np.array(firsts), *self.symbols(group)

    def tiles(self, texts: list, hot: tuple[np.ndarray, np.ndarray] = (_NO_HASHES, _NO_HASHES), named: bool = False) -> Iterator[Tiles]:
        """Tiles of texts; ``hot`` has the keys to split, sorted, and their levels. Digests are only right if ``named``."""
        span = self.length - self.gram + 1
        for texts_of, firsts, sym, sizes, cut in self.chunks(texts):
            n = len(sym) - self.length + 1
            if n < 1:
                continue
            values = self.values(sym)
            grams = gram_hashes(values, self.gram)[: len(sym) - self.gram + 1]
            keys = sliding(grams, span)
            ends = np.cumsum(sizes)
            good = np.ones(n, bool)
            for back in range(1, self.length):  # windows that would reach into the next part
                pos = ends[:-1] - back
                good[pos[(pos >= 0) & (pos < n)]] = False
            new = good.copy()
            new[1:] &= ~good[:-1] | (keys[1:] != keys[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            stop = np.concatenate([first[1:], [n]])
            gaps = np.flatnonzero(~good)
            if len(gaps):
                nxt = np.searchsorted(gaps, first)
                stop = np.minimum(stop, np.where(nxt < len(gaps), gaps[np.minimum(nxt, len(gaps) - 1)], n))
            windows = stop - first
            if windows.max() > self.length:
                parts = -(-windows // self.length)
                nth = _ranges(np.zeros(len(parts), np.int64), parts) * self.length
                first = np.repeat(first, parts) + nth
                windows = np.minimum(np.repeat(windows, parts) - nth, self.length)
            twice = _NO_HASHES
            if self.within:
                padded = np.concatenate([np.zeros(span - 1, np.uint64), keys, np.zeros(span - 1, np.uint64)])
                anchors = np.flatnonzero(grams == sliding(padded, span, np.maximum))
                worth = grams[anchors]
                twice = worth[1:][(worth[1:] == worth[:-1]) & (np.diff(anchors) <= span)]
            base = key = keys[first]
            if len(hot[0]):
                first, windows, key, base = self._split(grams, first, windows, key, *hot)
            part = np.searchsorted(ends, first, "right")
            start = first - (ends - sizes)[part] + firsts[part]
            # of a tile with no more windows than a window has symbols, the first and last one cover it
            whole = gram_hashes(values, self.length) if named else values
            digest = (whole[first] * _mix(81) + whole[first + windows - 1]) * _mix(82) + windows.astype(np.uint64)
            if named:  # a split joins the parts of a longer run whose key is the same
                for i in np.flatnonzero(windows > self.length).tolist():
                    digest[i] ^= np.uint64(xxhash.xxh64_intdigest(cut(int(first[i]), int(first[i] + windows[i]) + self.length - 1)))
            yield Tiles(cut, digest, texts_of[part], start, first, windows, key, base, twice)

    def _split(self, grams: np.ndarray, first: np.ndarray, windows: np.ndarray, key: np.ndarray, hot: np.ndarray, levels: np.ndarray) -> tuple:
        """Tiles with those of hot keys cut where the smallest gram under one more hash changes."""
        there = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        is_hot = hot[there] == key
        if not is_hot.any():
            return first, windows, key, key
        span = self.length - self.gram + 1
        at, many, level = first[is_hot], windows[is_hot], levels[there[is_hot]]
        some = grams[_ranges(at, many + span - 1)]
        begin = np.cumsum(many + span - 1) - (many + span - 1)
        pick, place = _ranges(begin, many), _ranges(at, many)
        own, level = np.repeat(key[is_hot], many), np.repeat(level, many)
        fine = own.copy()
        for j in range(1, int(level.max()) + 1):
            least = sliding(some * _mix(100 + j), span)[pick]
            fine = np.where(level >= j, (fine ^ least) * _mix(80), fine)
        edge = np.ones(len(fine), bool)
        edge[1:] = (fine[1:] != fine[:-1]) | (place[1:] != place[:-1] + 1) | (own[1:] != own[:-1])
        cuts = np.flatnonzero(edge)
        sized = np.diff(np.concatenate([cuts, [len(fine)]]))
        rest = ~is_hot
        both = lambda a, b: np.concatenate([a[rest], b])
        return both(first, place[cuts]), both(windows, sized), both(key, fine[cuts]), both(key, own[cuts])


def _keys(rule: Rule, pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's keys, how many tiles have each, and whether it is worth comparing alone."""
    found = [(t.key, t.twice) for t in rule.tiles(pdf["text"].tolist())]
    if not found:
        return pd.DataFrame({"key": np.zeros(0, np.int64), "block": np.zeros(0, np.int32), "n": np.zeros(0, np.int32), "more": np.zeros(0, bool)})
    keys, counts = np.unique(np.concatenate([k for k, _ in found]), return_counts=True)
    more = (counts > 1) | np.isin(keys, np.concatenate([t for _, t in found]))
    return pd.DataFrame({"key": keys.view(np.int64), "block": np.int32(pdf["block"].iloc[0]), "n": counts.astype(np.int32), "more": more})


_TILE_SCHEMA = "key long, digest long, tile binary, id long, start int, block int, alone boolean, twice boolean, base long, level int"
_VERDICT_SCHEMA = "block int, key long, digest long, id long, start int, copies boolean, spans binary, base long, level int"
_TILE_NAMES, _VERDICT_NAMES = ([c.split()[0] for c in s.split(", ")] for s in (_TILE_SCHEMA, _VERDICT_SCHEMA))


def _hot(rows: pd.DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with a level, and their levels."""
    hot = rows.loc[rows["level"] > 0, [key, "level"]].drop_duplicates()
    keys = hot[key].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], hot["level"].to_numpy(np.int64)[order]


def _digest(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) - (1 << 63)


def _cut_tiles(rule: Rule, docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """A block's tiles of the wanted keys, a row for each content."""
    if not len(docs) or not len(wanted):
        return pd.DataFrame({c: [] for c in _TILE_NAMES})
    keys = np.unique(wanted["key"].to_numpy(np.int64).view(np.uint64))
    hot = _hot(wanted, "key")
    ids, parts, cuts = docs["id"].to_numpy(np.int64), [], []
    for t in rule.tiles(docs["text"].tolist(), hot, True):
        pick = t.pick(keys)
        level = np.zeros(len(pick), np.int64)
        if len(hot[0]):
            there = np.minimum(np.searchsorted(hot[0], t.base[pick]), len(hot[0]) - 1)
            level = np.where(hot[0][there] == t.base[pick], hot[1][there], 0)
        again = np.isin(t.base[pick], t.twice)
        stop = t.place[pick] + t.windows[pick] + rule.length - 1
        parts.append((t.key[pick], t.digest[pick], ids[t.text[pick]], t.start[pick], t.place[pick], stop, again, t.base[pick], level))
        cuts.append((len(pick), t.cut))
    if not parts:
        return pd.DataFrame({c: [] for c in _TILE_NAMES})
    key, digest, id_, start, place, stop, again, base, level = (np.concatenate(c) for c in zip(*parts, strict=True))
    if not rule.within:
        start = np.zeros(len(start), np.int64)
    order = np.lexsort((start, id_, digest, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (digest[order][1:] != digest[order][:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(order)]]) - 1
    top = order[first]
    alone = (id_[top] == id_[order[last]]) & (start[top] == start[order[last]])
    twice = np.maximum.reduceat(again[order], first) if len(first) else again
    of = np.searchsorted(np.cumsum([n for n, _ in cuts]), top, "right").tolist()
    texts = [cuts[c][1](a, b) for c, a, b in zip(of, place[top].tolist(), stop[top].tolist(), strict=True)]
    hot_base = np.where(level[top] > 0, base[top], 0)
    columns = (key[top].view(np.int64), digest[top].view(np.int64), texts, id_[top], start[top].astype(np.int32), np.int32(docs["block"].iloc[0]), alone, twice)
    columns += (hot_base.astype(np.uint64).view(np.int64), level[top].astype(np.int32))
    return pd.DataFrame(dict(zip(_TILE_NAMES, columns, strict=True)))


class _Content:
    """A different tile of a key: its first place, the blocks of that, and those that have copies only."""

    __slots__ = ("name", "tile", "place", "hot", "first_blocks", "other_blocks", "alone", "twice")

    def __init__(self, name: tuple, tile: bytes, place: tuple, hot: tuple) -> None:
        self.name, self.tile, self.place, self.hot = name, tile, place, hot
        self.first_blocks, self.other_blocks = array("i"), array("i")
        self.alone, self.twice = True, False


def _later(rule: Rule, batch: list[_Content], parsed: list[np.ndarray]) -> Iterator[tuple]:
    """(number, copies go, False, spans that go of the first) of contents of a batch."""
    spans: dict[int, list] = {}
    copies: set[int] = set()
    for i, at, n, whole in rule.compare(parsed, [c.place for c in batch], [not c.alone for c in batch], rule.length):
        if whole:
            copies.add(i)
        else:
            spans.setdefault(i, []).append((at, n))
    for i in copies | spans.keys():
        yield i, i in copies, False, np.array(spans.get(i, []), "<i4").tobytes()


_MARK = np.dtype([("at", "<i4"), ("n", "<i4"), ("repeat", "<i8")])


def _grouped(rule: Rule, batch: list[_Content], parsed: list[np.ndarray]) -> Iterator[tuple]:
    """(number, False, True, repeats in it) of contents of a batch, about ``_HELD`` repeats at a time.

    A content has an entry for each ``_OF_ROW`` of its repeats. If its key is split, one without repeats comes first.
    """
    sizes = np.array([len(t) for t in parsed])
    whole = np.zeros(len(batch), bool)
    told: set[int] = set()
    held: list[tuple] = []
    size = 0

    def packed() -> Iterator[tuple]:
        tile, start = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        many = [len(h[0]) for h in held]
        marks = np.empty(len(tile), _MARK)
        marks["at"], marks["n"], marks["repeat"] = start, np.repeat([h[2] for h in held], many), np.repeat([h[3] for h in held], many)
        order = np.argsort(tile, kind="stable")
        tiles, begin = np.unique(tile[order], return_index=True)
        for i, some in zip(tiles.tolist(), np.split(marks[order], begin[1:]), strict=True):
            if batch[i].hot[1] and i not in told:
                told.add(i)
                yield i, False, True, b""
            for at in range(0, len(some), _OF_ROW):
                yield i, False, True, some[at : at + _OF_ROW].tobytes()

    for length, tile, start in rule.groups(parsed, [c.place for c in batch], [not c.alone for c in batch], rule.length):
        name = _digest(parsed[tile[0]][start[0] : start[0] + length].tobytes())
        # a tile's copies and a longer tile that begins with it make the same repeat
        again = (start == 0) & (sizes[tile] == length)
        if again.any():
            keep = ~(again & whole[tile])
            whole[tile[again]] = True
            tile, start = tile[keep], start[keep]
        if len(tile):
            held.append((tile, start, length, name))
            size += len(tile)
        if size >= _HELD:
            yield from packed()
            held, size = [], 0
    if held:
        yield from packed()


def _compared(rule: Rule, judge: Callable, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tiles sorted by key, content and place, to verdicts of ``judge`` for their blocks."""
    of_key: list[_Content] = []
    batch: list[_Content] = []
    held = sent = 0
    out: list[tuple] = []

    def close_key() -> None:
        nonlocal held
        if len(of_key) > 1 or any(c.twice or not c.alone for c in of_key):
            batch.extend(of_key)
            held += sum(len(c.tile) for c in of_key)
        of_key.clear()

    def close_batch() -> Iterator[pd.DataFrame]:
        nonlocal held, sent
        if batch:
            parsed = rule.parse([c.tile for c in batch])
            for i, copies, everywhere, packed in judge(rule, batch, parsed):
                c = batch[i]
                common = (*c.name, *c.place, copies)
                for b, is_first in chain(zip(c.first_blocks, repeat(True)), zip(c.other_blocks if copies or everywhere else (), repeat(False))):
                    own = packed if is_first or everywhere else b""
                    out.append((b, *common, own, *c.hot))
                    sent += len(own)
                    if len(out) > 20_000 or sent > _SENT:
                        yield verdicts()
        batch.clear()
        held = 0

    def verdicts() -> pd.DataFrame:
        nonlocal sent
        frame = pd.DataFrame(out, columns=_VERDICT_NAMES)
        out.clear()
        sent = 0
        return frame

    key = None
    for pdf in parts:
        for k, digest, tile, id_, start, block, alone, twice, base, level in pdf.itertuples(index=False, name=None):
            if k != key:
                close_key()
                key = k
                if held >= _BATCH:
                    yield from close_batch()
            if of_key and of_key[-1].name[1] == digest:
                found = of_key[-1]
            else:
                found = _Content((k, digest), bytes(tile), (id_, start), (base, level))
                of_key.append(found)
            found.twice |= twice
            if (id_, start) == found.place:
                found.first_blocks.append(block)
            else:
                found.other_blocks.append(block)
                alone = False
            found.alone &= alone
    close_key()
    yield from close_batch()
    yield verdicts()


def _union(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint maximal runs [start, end) of spans (start, n)."""
    order = np.argsort(spans[:, 0], kind="stable")
    start, end = spans[order, 0], (spans[:, 0] + spans[:, 1])[order]
    top = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > top[:-1]])
    last = np.concatenate([new[1:], [True]])
    return np.stack([start[new], top[last]], axis=1)


def _judged(rule: Rule, docs: pd.DataFrame, verdicts: pd.DataFrame) -> Iterator[tuple[Tiles, np.ndarray, np.ndarray]]:
    """A block's tiles, which of them have a verdict, and the number of that."""
    if not len(docs) or not len(verdicts):
        return
    key, digest = (verdicts[c].to_numpy(np.int64).view(np.uint64) for c in ("key", "digest"))
    names = key * _mix(83) + digest
    order = np.argsort(names)
    names = names[order]
    for t in rule.tiles(docs["text"].tolist(), _hot(verdicts, "base"), True):
        own = t.key * _mix(83) + t.digest
        there = np.minimum(np.searchsorted(names, own), len(names) - 1)
        pick = np.flatnonzero(names[there] == own)
        yield t, pick, order[there[pick]]


def _removed(rule: Rule, docs: pd.DataFrame, verdicts: pd.DataFrame) -> dict[int, np.ndarray]:
    """What goes of each text of a block, by its row."""
    ids, spans = docs["id"].to_numpy(np.int64), []
    packed = verdicts["spans"].tolist()
    firsts, starts, copies = (verdicts[c].to_numpy(kind) for c, kind in (("id", np.int64), ("start", np.int64), ("copies", bool)))
    for t, pick, said in _judged(rule, docs, verdicts):
        text, start = t.text[pick], t.start[pick]
        is_first = ids[text] == firsts[said]
        if rule.within:
            is_first &= start == starts[said]
        gone = np.flatnonzero(~is_first & copies[said])
        spans.append(np.stack([text[gone], start[gone], t.windows[pick[gone]] + rule.length - 1], axis=1))
        for i in np.flatnonzero(is_first).tolist():
            if packed[said[i]]:
                found = np.frombuffer(packed[said[i]], "<i4").reshape(-1, 2)
                spans.append(np.stack([np.full(len(found), text[i]), found[:, 0] + start[i], found[:, 1]], axis=1))
    every = np.concatenate([np.zeros((0, 3), np.int64), *spans])
    every = every[np.argsort(every[:, 0], kind="stable")]
    rows, begin = np.unique(every[:, 0], return_index=True)
    return {i: _union(part[:, 1:]) for i, part in zip(rows.tolist(), np.split(every, begin[1:]), strict=False)}


class _Block:
    """Where a block has each tile, by name, for verdicts that come a part at a time."""

    def __init__(self, rule: Rule, hot: tuple[np.ndarray, np.ndarray]) -> None:
        self.rule, self.hot = rule, hot
        self.parts: list[tuple] = []
        self.table: tuple | None = None

    def add(self, docs: pd.DataFrame) -> None:
        there, ids = docs["there"].to_numpy(bool), docs["id"].to_numpy(np.int64)
        for t in self.rule.tiles(docs["text"].tolist(), self.hot, True):
            self.parts.append((t.key * _mix(83) + t.digest, ids[t.text], there[t.text], t.start))

    def occurrences(self, verdicts: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What verdicts say of the block's tiles, about ``_ROWS`` at a time."""
        if self.table is None and self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            order = np.argsort(columns[0])
            self.table = tuple(c[order] for c in columns)
            self.parts.clear()
        if self.table is None or not len(verdicts):
            return
        names, ids, there, start = self.table
        marks = verdicts["spans"].tolist()
        key, digest = (verdicts[c].to_numpy(np.int64).view(np.uint64) for c in ("key", "digest"))
        own = key * _mix(83) + digest
        low, high = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        said = np.repeat(np.arange(len(marks)), high - low)
        pick = _ranges(low, high - low)
        sizes = np.array([len(m) for m in marks], np.int64)[said] // _MARK.itemsize
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) if len(ends) else 0, _ROWS), "right")
        cuts = np.unique(np.concatenate([cuts, [len(said)]]))
        for a, b in zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist(), strict=True):
            found = np.frombuffer(b"".join(marks[v] for v in said[a:b].tolist()), _MARK)
            if not len(found):
                continue
            of = np.repeat(pick[a:b], sizes[a:b])
            distinct, name = np.unique(found["repeat"], return_inverse=True)
            repeats = np.array([f"{r + (1 << 63):016x}" for r in distinct.tolist()], object)
            doc_id = pd.arrays.IntegerArray(ids[of], ~there[of])
            columns = (repeats[name], found["n"].astype(np.int32), doc_id, start[of] + found["at"])
            yield pd.DataFrame(dict(zip(("repeat", "length", "doc_id", "start"), columns, strict=True)))


def _marked(rule: Rule, docs: pd.DataFrame, verdicts: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The occurrences in texts of a block."""
    block = _Block(rule, _hot(verdicts, "base"))
    block.add(docs)
    yield from block.occurrences(verdicts)


def _dealt(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, int]:
    """Rows ``(doc_id, id, text)``, those with a window dealt by ``block``, and the tasks that these are dealt over."""
    blocks = task_count(docs, BLOCK_MB)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    deal = F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int")
    long_enough = rows.where(F.octet_length("text") >= rule.shortest)
    # a task goes through several blocks, one at a time
    tasks = -(-blocks // _BLOCKS_OF_TASK)
    return rows, long_enough.select(deal.alias("block"), "*").repartition(tasks, "block"), tasks


def _verdicts(by_block: GroupedData, rule: Rule, judge: Callable) -> DataFrame:
    """What ``judge`` says of the tiles of each block."""

    def keys(pdf: pd.DataFrame) -> pd.DataFrame:
        return _keys(rule, pdf)

    def tiles(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _cut_tiles(rule, left, right)

    def compared(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _compared(rule, judge, parts)

    one_key = W.partitionBy("key")
    total = F.sum("n").over(one_key)
    level = F.when(total > HOT, F.least(F.ceil(F.log2(total / HOT)), F.lit(_MOST_LEVELS))).otherwise(0).cast("int")
    sent = by_block.applyInPandas(keys, "key long, block int, n int, more boolean")
    repeated = (F.count("*").over(one_key) > 1) | F.col("more")
    wanted = sent.select("key", "block", repeated.alias("again"), level.alias("level")).where("again").drop("again")
    cut = by_block.cogroup(wanted.groupBy("block")).applyInPandas(tiles, _TILE_SCHEMA)
    met = cut.repartition("key").sortWithinPartitions("key", "digest", "id", "start")
    return met.mapInPandas(compared, _VERDICT_SCHEMA)


def without_repeats(docs: DataFrame, rule: Rule, finish: Callable, schema: str) -> DataFrame:
    """Rows ``finish(text, spans)`` of each document, after doc_id; ``schema`` names them.

    ``docs(doc_id, text, ...)``; ``spans`` are sorted disjoint runs (start, end) of symbols that
    lie in a window which also starts at an earlier place. Places are ordered by doc_id, null
    last, and then by start if the rule says so. Rows with the same id are not earlier than
    each other at equal starts. Null texts have no symbols; an empty table gives an empty
    table; other columns are ignored. Rows that repeat an id and text are dealt by the part of
    the input that they are in; those too short for a window aren't dealt at all.
    """
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
    rows, dealt, _ = _dealt(docs, rule)
    by_block = dealt.groupBy("block")
    none = np.zeros((0, 2), np.int64)

    def digested(pdf: pd.DataFrame, spans: dict[int, np.ndarray]) -> pd.DataFrame:
        out = [
            (doc_id if there else None, *finish(text, spans.get(i, none)))
            for i, (doc_id, there, text) in enumerate(zip(pdf["doc_id"], pdf["doc_id"].notna(), pdf["text"], strict=True))
        ]
        return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    def removed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return digested(left, _removed(rule, left, right))

    def untouched(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield digested(pdf, {})

    result = f"doc_id long, {schema}"
    whole = by_block.cogroup(_verdicts(by_block, rule, _later).groupBy("block")).applyInPandas(removed, result)
    short = rows.where(F.octet_length("text") < rule.shortest).select("doc_id", "text")
    return whole.unionByName(short.mapInPandas(untouched, result))


def occurrences(docs: DataFrame, rule: Rule) -> DataFrame:
    """Maximal repeats of ``docs(doc_id, text, ...)`` with all their occurrences.

    Rows ``repeat string, length int, doc_id long, start long``: a repeat is named by its
    content, and told in the symbols of the rule. Nulls and empty tables as in
    ``without_repeats``; rows that repeat an id and text repeat their occurrences.
    """
    _, dealt, tasks = _dealt(docs, rule)

    def marked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by block: the levels of its keys, its texts, and then its verdicts."""
        now, block, levels = None, None, []
        for pdf in parts:
            for (no, turn), some in pdf.groupby(["block", "turn"], sort=True):
                if no != now:
                    now, block, levels = no, None, []
                if turn == _LEVELS:
                    levels.append(some[["base", "level"]].drop_duplicates())
                    continue
                if block is None:
                    block = _Block(rule, _hot(pd.concat(levels), "base") if levels else (_NO_HASHES, _NO_HASHES))
                if turn == _TEXTS:
                    block.add(some)
                else:
                    yield from block.occurrences(some)

    turn = F.when(F.octet_length("spans") == 0, _LEVELS).otherwise(_SPANS)
    verdicts = _verdicts(dealt.groupBy("block"), rule, _grouped).withColumns({"turn": turn, "there": F.lit(False)})
    # no number is null, as pandas would make it a float
    none = {c: F.lit(0).cast(kind) for c, kind in verdicts.dtypes if kind in ("bigint", "int") and c not in ("id", "block")}
    none |= {"copies": F.lit(False), "turn": F.lit(_TEXTS)}
    texts = dealt.select("block", "id", "text", F.col("doc_id").isNotNull().alias("there")).withColumns(none)
    rows = verdicts.unionByName(texts, allowMissingColumns=True)
    met = rows.repartition(tasks, "block").sortWithinPartitions("block", "turn")
    return met.mapInPandas(marked, "repeat string, length int, doc_id long, start long")


#: The order of a block's rows where its occurrences are made.
_LEVELS, _TEXTS, _SPANS = range(3)
