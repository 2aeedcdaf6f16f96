"""Near-duplicate texts by SimHash with Golay-code keys, for sets of five-word shingles.

Texts are near-duplicates if the Jaccard similarity of their sets is 0.8 or more. Fingerprints
of two such sets differ in 15 % of their bits at most, on average, so a wide fingerprint of
``SEGMENTS`` segments of 23 bits is taken. As in ``simhash`` each segment decodes to the
codewords near it, and a pair of codewords of two segments is a key. Sets that meet under a
key are candidates if their first 64 bits differ in at most ``MOST_BITS``, their sizes allow the
similarity, and so do their sketches: 256 bins that have the smallest hash of each bin, three
deviations off at most. What decides is the check of each candidate pair on the sets themselves.

Two sets of similarity 0.8 share a key with a probability of 0.96, of 0.86 with 0.993, of 0.9
with 0.999 (as simulated); what isn't met as a pair may still be connected by others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import doc_key, written
from seekwell.llm.components import connected_components
from seekwell.llm.repeats import gram_hashes
from seekwell.llm.simhash import _UPPER, codewords, decoding_table, first_of_components
from seekwell.llm.suffix_automaton import word_rule

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
SEGMENTS, WIDTH = 6, 23
#: Bits of the first 64 that candidates may differ in: three deviations more than the mean at 0.8.
MOST_BITS = 18
#: Bins of a sketch, and deviations that a sketch may show a pair less alike than it must be.
BINS, DEVIATIONS = 256, 3.0
#: Bits that likely pairs differ in at most.
LIKELY_BITS = 9
#: Larger groups are compared one set at a time.
_SMALL = 24
#: Sets, and shingles of them, that a place has on average at most.
PLACE_SETS, PLACE_SHINGLES = 128, 2_000_000
_WORDS = ("h", "h2", "h3")
_RULE = word_rule(SHINGLE)
_CHUNK = 1 << 20
_PAIRS, _KEYS_OF_PAIR, _KEY_BITS = SEGMENTS * (SEGMENTS - 1) // 2, 29, 28
#: Entries of a bucket of keys, on average, and prints whose keys are sent together.
_BUCKET, _BATCH = 500_000, 1_000
#: Pairs of a bucket that are held before repeated ones go.
_HELD = 500_000


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word shingles, A-Z in small letters.

    A text of fewer words is one shingle, a wordless one has none. Long texts go in segments.
    """
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER)
        if len(raw) > _CHUNK:
            yield from _sets(group)
            yield np.unique(np.concatenate(list(_sets([part for _, part in _RULE.segments(raw, _CHUNK)]))))
            group, size = [], 0
            continue
        group.append(raw)
        size += len(raw)
        if size > _CHUNK:
            yield from _sets(group)
            group, size = [], 0
    yield from _sets(group)


def _sets(group: list[bytes]) -> Iterator[np.ndarray]:
    if not group:
        return
    words, counts, _ = _RULE.symbols(group)
    grams = gram_hashes(words, SHINGLE) if len(words) >= SHINGLE else words
    ends = np.cumsum(counts)
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= SHINGLE:
            yield np.unique(grams[end - n : end - SHINGLE + 1])
        else:
            yield gram_hashes(words[end - n : end], n)[:1] if n else words[:0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of ``LEAST`` at least; empty ones are equal."""
    few, many = sorted((len(a), len(b)))
    if few * LEAST[1] < many * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (len(a) + len(b) - both) * LEAST[0]


#: Odd numbers that make the words of a fingerprint of a shingle's hash.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def wide_fingerprint(s: np.ndarray) -> np.ndarray:
    """Three words of 64 bits of a set: a bit is 1 if it is in over half of the shingles' hashes."""
    ones = np.zeros(64 * len(_ODD), np.int64)
    for at in range(0, len(s), 1 << 14):
        x = s[at : at + (1 << 14)]
        x = x ^ (x >> np.uint64(29))
        words = np.empty((len(x), len(_ODD)), np.uint64)
        for i, odd in enumerate(_ODD):
            y = x * np.uint64(odd)
            y = (y ^ (y >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            words[:, i] = y ^ (y >> np.uint64(31))
        ones += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(s), bitorder="little").view(np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte for each bin of the hashes, from the smallest in it; 0 for an empty bin.

    Two sets have the same byte in as large a share of the bins that either has as their similarity is.
    """
    y = (s ^ (s >> np.uint64(32))) * np.uint64(_ODD[0])
    y = np.sort((y ^ (y >> np.uint64(29))) * np.uint64(_ODD[1]))
    at = np.searchsorted(y, np.arange(BINS, dtype=np.uint64) << np.uint64(56))
    filled = at < np.append(at[1:], len(y))
    out = np.zeros(BINS, np.uint8)
    out[filled] = (y[at[filled]] >> np.uint64(8)) % np.uint64(255) + np.uint64(1)
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which pairs of sets may be, by their sizes and by sketches, a row each."""
    out = np.minimum(size_a, size_b) * LEAST[1] >= np.maximum(size_a, size_b) * LEAST[0]
    least = LEAST[0] / LEAST[1]
    for at in range(0, len(out), 1 << 15):
        x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        used = np.count_nonzero(x | y, axis=1)
        same = np.count_nonzero((x == y) & (x != 0), axis=1)
        out[at : at + (1 << 15)] &= same >= least * used - DEVIATIONS * np.sqrt(least * (1 - least) * used)
    return out


def golay_keys(prints: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (rows of three uint64): their numbers, and a key each."""
    found = []
    for i in range(SEGMENTS):
        word, at = divmod(i * WIDTH, 64)
        segment = prints[:, word] >> np.uint64(at)
        if at + WIDTH > 64:
            segment = segment | prints[:, word + 1] << np.uint64(64 - at)
        found.append(codewords((segment & np.uint64((1 << WIDTH) - 1)).astype(np.int64), table))
    rows, keys = [], []
    for pair, (i, j) in enumerate((i, j) for j in range(SEGMENTS) for i in range(j)):
        both = (found[i][:, :, None] << 12) | found[j][:, None, :]
        ok = (found[i][:, :, None] >= 0) & (found[j][:, None, :] >= 0)
        rows.append(np.nonzero(ok)[0])
        keys.append(both[ok] | (pair << 24))
    return np.concatenate(rows), np.concatenate(keys)


def _marked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row's key, the name of its set, and the set's fingerprint."""
    for pdf in parts:
        names, prints, sizes, sketches = [], [], [], []
        for s in shingle_sets(pdf["text"].tolist()):
            sizes.append(len(s))
            sketches.append(sketch(s).tobytes())
            names.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
            prints.append(wide_fingerprint(s))
        wide = np.array(prints, np.uint64).reshape(-1, len(_ODD)).view(np.int64)
        named = pdf[["doc_id", "k1", "k2"]].assign(fp=np.array(names, np.int64), n=np.array(sizes, np.int32), sketch=sketches)
        yield named.assign(**{c: wide[:, i] for i, c in enumerate(_WORDS)}).astype({"doc_id": "Int64"})


def _large_group(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one large group and their bits; a print that has met a likely one before it is met no more."""
    rest = np.arange(len(prints))
    while len(rest) > 1:
        one, rest = rest[0], rest[1:]
        bits = np.bitwise_count(prints[rest] ^ prints[one])
        near = bits <= MOST_BITS
        got = rest[near]
        yield np.full(len(got), prints[one]), prints[got], bits[near]
        rest = rest[bits > LIKELY_BITS]


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
    return cuts, np.diff(cuts)


def candidates(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (u, v), u < v, of the prints of a bucket, and the prints that have more of them.

    Rows are sorted by key and print. A print is paired with the smallest of its likely partners
    before it, or else with the closest of all. So a group of near copies gives one pair for
    each; what is left out is asked for again (``candidates_between``) by those that the check
    of these pairs doesn't connect.
    """
    cuts, sizes = _groups(keys)
    small = np.repeat((sizes <= _SMALL) & (sizes > 1), sizes)
    k, f = keys[small], prints[small]
    found, more, held = [(f[:0], f[:0], np.zeros(0, np.uint8))], [f[:0]], 0

    def best() -> None:
        """Keep the best pair of each print, and note those that have others."""
        u, v, bits = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((u, np.where(bits <= LIKELY_BITS, 0, bits), v))
        u, v, bits = u[order], v[order], bits[order]
        keep = np.ones(len(u), bool)
        keep[1:] = v[1:] != v[:-1]
        other = ~keep
        other[1:] &= u[1:] != u[:-1]  # the same pair under another key is no other one
        more[:] = [np.unique(np.concatenate([u[other], v[other], *more]))]
        found[:] = [(u[keep], v[keep], bits[keep])]

    def add(u: np.ndarray, v: np.ndarray, bits: np.ndarray) -> None:
        nonlocal held
        found.append((u, v, bits))
        held += len(u)
        if held > _HELD:
            best()
            held = 0

    for lag in range(1, min(_SMALL, len(k))):
        i = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(i):
            break
        bits = np.bitwise_count(f[i] ^ f[i + lag])
        near = bits <= MOST_BITS
        add(f[i[near]], f[i[near] + lag], bits[near])
    for g in np.flatnonzero(sizes > _SMALL):
        group = prints[cuts[g] : cuts[g + 1]]
        for pairs in _large_group(group):
            add(*pairs)
        more.append(group)
    best()
    return *found[0][:2], more[0]


def cells_between(keys: np.ndarray, at: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Cells (lo, hi) of places that have pairs of a bucket, and the prints of each that are in such pairs.

    Pairs are those with different labels that may be similar. ``side`` has the prints of the bucket, of type
    ``_SIDE`` and sorted; ``at`` tells which of them has each key. Pairs are held ``_HELD`` at a time.
    """
    cuts, sizes = _groups(keys)
    small = np.repeat((sizes <= _SMALL) & (sizes > 1), sizes)
    k, own = keys[small], at[small]
    prints, labels, counts = (np.ascontiguousarray(side[c]) for c in ("h", "label", "n"))
    places, place = np.unique(side["place"], return_inverse=True)
    cells, members = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[np.ndarray] = []
    held = 0

    def worth(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = counts[i], counts[j]
        sized = np.minimum(a, b) * LEAST[1] >= np.maximum(a, b) * LEAST[0]
        return sized & (labels[i] != labels[j]) & (np.bitwise_count(prints[i] ^ prints[j]) <= MOST_BITS)

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held
        found.append(np.minimum(i, j) * len(side) + np.maximum(i, j))
        held += len(i)
        if held > _HELD:
            checked()
            held = 0

    def checked() -> None:
        """Of pairs whose sketches allow it, keep the cell and both prints."""
        nonlocal cells, members
        if not found:
            return
        new = np.unique(np.concatenate(found))
        found.clear()
        for start in range(0, len(new), 1 << 16):  # sketches are taken for so many pairs at a time
            i, j = np.divmod(new[start : start + (1 << 16)], len(side))
            a, b = side[i], side[j]
            good = may_be_similar(a["sketch"], b["sketch"], a["n"], b["n"])
            i, j = i[good], j[good]
            cell = np.minimum(place[i], place[j]) * len(places) + np.maximum(place[i], place[j])
            cells, members = np.concatenate([cells, cell, cell]), np.concatenate([members, i, j])
            order = np.lexsort((members, cells))
            cells, members = cells[order], members[order]
            new_one = np.ones(len(cells), bool)
            new_one[1:] = (cells[1:] != cells[:-1]) | (members[1:] != members[:-1])
            cells, members = cells[new_one], members[new_one]

    for lag in range(1, min(_SMALL, len(k))):
        same = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(same):
            break
        i, j = own[same], own[same + lag]
        ok = worth(i, j)
        add(i[ok], j[ok])
    for g in np.flatnonzero(sizes > _SMALL):
        group = at[cuts[g] : cuts[g + 1]]
        if (labels[group] == labels[group[0]]).all():
            continue
        for one in range(len(group) - 1):
            rest = group[one + 1 :]
            rest = rest[worth(rest, np.full(len(rest), group[one]))]
            add(rest, np.full(len(rest), group[one]))
    checked()
    cuts, sizes = _groups(cells)
    lo, hi = np.divmod(cells[cuts[:-1]], max(1, len(places)))
    named = prints.view(np.int64)[members]
    return places[lo], places[hi], [named[c : c + n] for c, n in zip(cuts[:-1].tolist(), sizes.tolist(), strict=True)]


_ENTRY = np.dtype([("key", "<u4"), ("h", "<u8")])
_SIDE = np.dtype([("h", "<u8"), ("label", "<i8"), ("place", "<i8"), ("n", "<i4"), ("sketch", "u1", (BINS,))])


def candidate_pairs(prints: DataFrame) -> DataFrame:
    """``prints(h, h2, h3)``, distinct by ``h``, to candidates ``(u, v)`` of these first 64 bits.

    A row with equal ends is a print that has more candidates.
    """

    def met(found: np.ndarray, side: bytes) -> pd.DataFrame:
        u, v, more = candidates(found["key"].copy(), found["h"].copy())
        u, v = np.concatenate([u, more]), np.concatenate([v, more])
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return _in_buckets(prints, False, met, "u long, v long").distinct()


def candidate_cells(prints: DataFrame) -> DataFrame:
    """``prints(h, h2, h3, label, place, n, sketch)``, distinct by ``h``, to cells ``(lo, hi, hs)`` of places.

    A cell has the prints ``hs`` that have a candidate with another label in it, one of either place. The
    pairs themselves stay in the tasks: there are as many as the square of a group's size. Sketches go once
    to each bucket that has the print.
    """

    def met(found: np.ndarray, side: bytes) -> pd.DataFrame:
        known = np.frombuffer(side, _SIDE)
        known = known[np.argsort(known["h"])]
        lo, hi, hs = cells_between(found["key"].copy(), np.searchsorted(known["h"], found["h"]), known)
        return pd.DataFrame({"lo": lo, "hi": hi, "hs": hs})

    met_in = _in_buckets(prints, True, met, "lo long, hi long, hs array<long>")
    return met_in.groupBy("lo", "hi").agg(F.array_distinct(F.flatten(F.collect_list("hs"))).alias("hs"))


def _in_buckets(prints: DataFrame, labelled: bool, met: Callable[[np.ndarray, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """What ``met`` makes of the entries of each bucket, sorted by key and print, and of their sides, if ``labelled``.

    Keys of equal leading bits make a bucket, of about ``_BUCKET`` entries at every size of the input; a
    batch of prints sends one row to each bucket.
    """
    table = decoding_table()
    entries = prints.count() * _PAIRS * _KEYS_OF_PAIR
    low = max(0, _KEY_BITS - math.ceil(math.log2(max(1, entries / _BUCKET))))

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            wide = pdf[list(_WORDS)].to_numpy(np.int64)
            for at in range(0, len(wide), _BATCH):
                some = np.ascontiguousarray(wide[at : at + _BATCH])
                rows, keys = golay_keys(some.view(np.uint64), table)
                order = np.argsort(keys, kind="stable")
                rows, keys = rows[order], keys[order]
                cuts = np.flatnonzero(np.diff(keys >> low)) + 1
                starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
                packed = np.empty(len(keys), _ENTRY)
                packed["key"], packed["h"] = keys, some[rows, 0].view(np.uint64)
                ranges = list(zip(starts.tolist(), ends.tolist(), strict=True))
                sides = [b""] * len(ranges)
                if labelled:
                    side = np.empty(len(some), _SIDE)
                    side["h"] = some[:, 0].view(np.uint64)
                    for c in ("label", "place", "n"):
                        side[c] = pdf[c].to_numpy(np.int64)[at : at + _BATCH]
                    side["sketch"] = np.frombuffer(b"".join(pdf["sketch"].iloc[at : at + _BATCH]), np.uint8).reshape(-1, BINS)
                    sides = [side[np.unique(rows[a:b])].tobytes() for a, b in ranges]
                sent = [packed[a:b].tobytes() for a, b in ranges]
                yield pd.DataFrame({"bucket": (keys[starts] >> low).astype(np.int32), "entries": sent, "sides": sides})

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket."""
        held: list[bytes] = []
        known: list[bytes] = []
        now = None

        def out() -> pd.DataFrame:
            found = np.frombuffer(b"".join(held), _ENTRY)
            return met(found[np.lexsort((found["h"], found["key"]))], b"".join(known))

        for pdf in parts:
            for bucket, packed, side in zip(pdf["bucket"].tolist(), pdf["entries"], pdf["sides"], strict=True):
                if bucket != now and held:
                    yield out()
                    held.clear()
                    known.clear()
                now = bucket
                held.append(bytes(packed))
                known.append(bytes(side))
        if held:
            yield out()

    more = ("label", "place", "n", "sketch") if labelled else ()
    keyed = prints.select(*_WORDS, *more).mapInPandas(emit, "bucket int, entries binary, sides binary")
    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(meet, schema)


def _checked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell and role: the texts of a cell, then its pairs, to links.

    A pair that the links of the cell connect already isn't checked, so these are a spanning forest.
    """
    sets: dict[int, np.ndarray] = {}
    root: dict[int, int] = {}
    now = None

    def find(name: int) -> int:
        while (up := root.setdefault(name, name)) != name:
            root[name] = name = root[up]
        return name

    for pdf in parts:
        links = []
        columns = (pdf[c].tolist() for c in ("lo", "hi", "role", "fp", "us", "vs"))
        for lo, hi, role, name, us, vs, s in zip(*columns, shingle_sets(pdf["text"].tolist()), strict=True):
            if (lo, hi) != now:
                now = lo, hi
                sets.clear()
                root.clear()
            if role == 0:
                sets[name] = s
                continue
            for u, v in zip(us.tolist(), vs.tolist(), strict=True):
                if (a := find(u)) != (b := find(v)) and similar(sets[u], sets[v]):
                    root[a] = b
                    links.append((u, v))
        yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["u", "v"])


class _Cell:
    """The sets of a cell, and the links between those of different labels that are similar."""

    def __init__(self, lo: int, hi: int) -> None:
        self.key = lo, hi
        self.rows: list[tuple[int, int, int, int]] = []
        self.sets: list[np.ndarray] = []

    def links(self) -> list[tuple[int, int]]:
        """The likeliest pairs are checked first, and none that labels and links connect already: a spanning forest."""
        fp, label, place, print_ = np.array(self.rows, np.int64).reshape(-1, 4).T
        prints, sizes = np.ascontiguousarray(print_).view(np.uint64), np.array([len(s) for s in self.sets])
        sketches = np.array([sketch(s) for s in self.sets])
        us, vs = [], []
        for one in range(len(fp) - 1):
            rest = np.arange(one + 1, len(fp))
            ok = (label[rest] != label[one]) & (np.bitwise_count(prints[rest] ^ prints[one]) <= MOST_BITS)
            if self.key[0] != self.key[1]:  # pairs of one place have a cell of their own
                ok &= place[rest] != place[one]
            rest = rest[ok]
            if len(rest):
                rest = rest[may_be_similar(sketches[rest], sketches[one][None], sizes[rest], sizes[one])]
            us.append(np.full(len(rest), one))
            vs.append(rest)
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
        alike = np.concatenate(
            [np.zeros(0, np.int64), *(np.count_nonzero(sketches[v[at : at + 4096]] == sketches[u[at : at + 4096]], axis=1) for at in range(0, len(u), 4096))]
        )
        root: dict[int, int] = {}

        def find(name: int) -> int:
            while (up := root.setdefault(name, name)) != name:
                root[name] = name = root[up]
            return name

        out = []
        for i in np.argsort(-alike, kind="stable").tolist():
            a, b = u[i], v[i]
            if (x := find(int(label[a]))) != (y := find(int(label[b]))) and similar(self.sets[a], self.sets[b]):
                root[x] = y
                out.append((int(fp[a]), int(fp[b])))
        return out


def _met(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by cell, the sets of each with their texts, to links."""
    cell = _Cell(0, 0)
    for pdf in parts:
        links = []
        columns = (pdf[c].tolist() for c in ("lo", "hi", "fp", "label", "place", "h"))
        for lo, hi, *row, s in zip(*columns, shingle_sets(pdf["text"].tolist()), strict=True):
            if (lo, hi) != cell.key:
                links += cell.links()
                cell = _Cell(lo, hi)
            cell.rows.append(tuple(row))
            cell.sets.append(s)
        yield pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["u", "v"])
    yield pd.DataFrame(np.array(cell.links(), np.int64).reshape(-1, 2), columns=["u", "v"])


def _verified_between(labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect the sets of ``labelled(fp, k, label, place, n, sketch, h, h2, h3)`` that are similar.

    A cell of two places gets the texts that have a candidate in it, each once, and finds their pairs itself.
    """
    names = written(candidate_cells(labelled)).select("lo", "hi", F.explode("hs").alias("h"))
    sent = names.join(labelled.select("h", "fp", "k", "label", "place"), "h").join(texts, "k")
    rows = sent.select("lo", "hi", "fp", "label", "place", "h", "text").repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    return written(rows.mapInPandas(_met, "u long, v long").distinct())


def _places(named: DataFrame, sets: DataFrame) -> DataFrame:
    """Names of the sets in the pairs ``named(u, v)``, with a place each: ``(fp, place)``.

    Families are what the pairs connect. Each is dealt over as many places as its sets and their shingles ask for.
    """
    families = connected_components(named).withColumnRenamed("node", "fp")
    nodes = named.select(F.col("u").alias("fp")).distinct().unionByName(named.select(F.col("v").alias("fp")).distinct()).distinct()
    members = nodes.join(sets.select("fp", "n"), "fp").join(families, "fp", "left")
    members = written(members.select("fp", "n", F.coalesce("component", "fp").alias("family")))
    asked = F.greatest(F.count("*") / F.lit(PLACE_SETS), F.sum("n") / F.lit(PLACE_SHINGLES))
    dealt = members.join(members.groupBy("family").agg(F.ceil(asked).alias("places")), "family")
    return written(dealt.select("fp", F.xxhash64("family", F.pmod(F.xxhash64("fp"), F.greatest("places", F.lit(1)))).alias("place")))


def _named(pairs: DataFrame) -> DataFrame:
    """Pairs ``(u, v)``, u < v, each once."""
    return written(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that connect what those of ``pairs(a, b)`` of set names do that are similar."""
    named = _named(pairs)
    return _checked_pairs(named, _places(named, sets), sets, texts)


def _checked_pairs(named: DataFrame, at: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect what those of the pairs ``named(u, v)`` of set names do that are similar.

    Sets have places ``at(fp, place)``, and two places are a cell, which has the pairs between them. A text goes once to
    each cell that has a pair of it, not to each pair: in a family of m sets to about m / ``PLACE_SETS`` cells
    at most. A cell holds some 2 * ``PLACE_SETS`` sets and the pairs between them.
    """
    side = lambda end: at.select(F.col("fp").alias(end), F.col("place").alias(f"{end}_place"))
    placed = named.join(side("u"), "u").join(side("v"), "v")
    lo, hi = F.least("u_place", "v_place").alias("lo"), F.greatest("u_place", "v_place").alias("hi")
    cells = written(placed.groupBy(lo, hi).agg(F.collect_list(F.struct("u", "v")).alias("pairs")))
    names = cells.select("lo", "hi", F.explode(F.array_distinct(F.concat("pairs.u", "pairs.v"))).alias("fp"))
    sent = names.join(sets.select("fp", "k"), "fp").join(texts, "k").select("lo", "hi", "fp", "text").withColumn("role", F.lit(0))
    asked = cells.select("lo", "hi", F.lit(0).cast("long").alias("fp"), F.lit(1).alias("role"), F.col("pairs.u").alias("us"), F.col("pairs.v").alias("vs"))
    rows = sent.unionByName(asked, allowMissingColumns=True).repartition("lo", "hi").sortWithinPartitions("lo", "hi", "role")
    return written(rows.mapInPandas(_checked, "u long, v long").distinct())


def similar_links(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Links ``(u, v)`` between names of the sets in ``marked(k1, k2, fp, n, sketch, h, h2, h3)`` that are similar.

    A first round checks a few candidates of each set. Sets that have more of them go
    into a second round, with all candidates that the first did not connect them to. These may be
    as many as the square of a group's size, so they are never rows: places come from the first round's
    pairs, and cells of two places find their pairs themselves.
    """
    more = ("n", "sketch", *_WORDS)
    sets = written(marked.groupBy("fp").agg(F.min(F.struct("k1", "k2")).alias("k"), *(F.first(c).alias(c) for c in more)))
    texts = docs.select(doc_key().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    # sets of one fingerprint are all held against one of them
    first = written(sets.groupBy("h").agg(F.min("fp").alias("fp")).join(sets.drop("h"), "fp"))
    side = lambda h, fp: first.select(F.col("h").alias(h), F.col("fp").alias(fp), *(F.col(c).alias(f"{h}_{c}") for c in ("n", "sketch")))

    def ends(met: DataFrame) -> DataFrame:
        """Names of the sets of candidates that may be similar."""
        both = met.join(side("u", "a"), "u").join(side("v", "b"), "v")
        return both.select("a", "b", "u_n", "v_n", "u_sketch", "v_sketch").mapInPandas(_allowed, "a long, b long")

    met = written(candidate_pairs(first))
    same = sets.join(first.select("h", F.col("fp").alias("a")), "h").where("fp <> a").select("a", F.col("fp").alias("b"))
    named = _named(ends(met.where("u <> v")).unionByName(same))
    at = _places(named, sets)
    links = _checked_pairs(named, at, sets, texts)
    parts = connected_components(links).withColumnRenamed("node", "fp")
    left = first.join(met.where("u = v").select(F.col("u").alias("h")), "h", "left_semi").join(parts, "fp", "left").join(at, "fp", "left")
    label, place = F.coalesce("component", "fp").alias("label"), F.coalesce("place", F.xxhash64("fp")).alias("place")
    return links.unionByName(_verified_between(written(left.select("fp", "k", label, place, *more)), texts))


def _allowed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(-1, BINS) for c in ("u_sketch", "v_sketch"))
        yield pdf.loc[may_be_similar(a, b, pdf["u_n"].to_numpy(np.int64), pdf["v_n"].to_numpy(np.int64)), ["a", "b"]]


def first_of_each_similar(docs: DataFrame) -> DataFrame:
    """Keep one row of each group of similar texts, that with the smallest doc_id.

    Groups are connected by similarity of ``LEAST`` at least. Null ids come last, and rows
    with equal ids go by a hash of the text. Of rows that repeat id and text one stays.
    Texts of equal shingle sets are equal; wordless ones are one group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", doc_key().alias("k")).select("doc_id", "text", "k.*")
    marked = written(rows.mapInPandas(_marked, "doc_id long, k1 long, k2 long, fp long, n int, sketch binary, h long, h2 long, h3 long"))
    parts = connected_components(similar_links(docs, marked)).withColumnRenamed("node", "fp")
    nodes = marked.select("fp").distinct()
    named = nodes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    return first_of_components(docs, marked, named)
