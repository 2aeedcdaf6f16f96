"""Repeated byte strings by an enhanced suffix array and its tree of common-prefix intervals.

Suffixes of tiles that begin a window fall into runs that share the window, told by its hash.
A run whose suffixes are all preceded by the same symbol goes on to the left, and the run of
the longer repeat stands for it. The suffixes of the other runs are sorted by seven symbols at
a time: each round splits only groups that are still alike, and what splits them tells the
common prefix of the neighbours. A tile stands for all its copies, so a suffix that begins such
a tile is an interval by itself. A scan with a stack visits the tree of intervals bottom up. An
interval whose suffixes are preceded by different symbols, or begin a tile, is a maximal
repeat: all suffixes of the interval, copies included, are its occurrences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.llm.common import read
from seekwell.llm.repeats import LAST_ID, Rule, _ranges, byte_values, gram_hashes, occurrences, without_repeats

LENGTH, GRAM = 100, 32
_DIVERSE = -1


@lru_cache(1)
def _symbol_values() -> np.ndarray:
    """Values of symbols for hashing: a separator's, and those of bytes."""
    return np.concatenate([[np.uint64(1)], byte_values()])


def sorted_suffixes(symbols: np.ndarray, at: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``at``, and the common prefix of each with the next one in it.

    ``symbols`` are 0 behind each tile and above 0 elsewhere; ``room`` is what is left of a
    suffix's tile. Suffixes that are alike to the end of one of them stay as they come.
    """
    n, padded = len(symbols), np.concatenate([symbols, np.zeros(7, np.int64)])
    word = np.zeros(n + 1, np.int64)
    for j in range(7):
        word[:n] = (word[:n] << 9) | padded[j : j + n]
    order = np.argsort(word[at], kind="stable")
    common = np.full(max(len(at) - 1, 0), -1)
    todo, group, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while len(todo):
        got = word[np.minimum(at[order[todo]] + depth, n)]
        by = np.lexsort((got, group)) if depth else np.arange(len(todo))
        order[todo], got = order[todo][by], got[by]
        inside = (group[1:] == group[:-1]) & (todo[1:] == todo[:-1] + 1)
        differ = inside & (got[1:] != got[:-1])
        bits = (got[1:] ^ got[:-1])[differ]
        common[todo[:-1][differ]] = depth + sum((bits < 1 << 9 * k).astype(np.int64) for k in range(1, 7))
        depth += 7
        # those alike so far go on, if more than one of them has anything left
        alike = inside & ~differ
        group = np.cumsum(np.concatenate([[True], ~alike]))
        tied = np.zeros(len(todo), bool)
        tied[1:] |= alike
        tied[:-1] |= alike
        left = np.bincount(group, room[order[todo]] > depth)[group]
        keep = tied & (left > 0)
        todo, group = todo[keep], group[keep]
    short = np.minimum(room[order[1:]], room[order[:-1]])
    return order, np.where(common < 0, short, np.minimum(common, short))


def scan(places: list, lefts: list, commons: list, least: int, copied: dict[int, int] | None = None) -> Iterator[tuple[int, range, list[int], bool]]:
    """Maximal repeats of one run of the array, deepest first: length, all occurrences, later ones, copies.

    ``places`` are comparable; ``commons[i]`` is the common prefix of suffixes i and i + 1.
    ``copied`` has the suffixes that stand for copies too, with their length: each is an
    interval, yielded with ``copies`` true. Firsts of an interval below go on for it, so over all
    intervals every suffix is among the later ones once at most: under the longest repeat that
    it has with an earlier place.
    """
    stack: list[list] = []  # length, best place, firsts, others, symbol on the left, where it begins
    copied = copied or {}

    def absorb(node: list, best: tuple, firsts: list, left: int) -> None:
        if best < node[1]:
            node[3] += node[2]
            node[1], node[2] = best, list(firsts)
        elif best == node[1]:
            node[2] += firsts
        else:
            node[3] += firsts
        if node[4] != left:
            node[4] = _DIVERSE

    before = least - 1
    for i in range(len(places)):
        if i in copied and lefts[i] == _DIVERSE:
            yield copied[i], range(i, i + 1), [], True
        after = commons[i] if i < len(commons) else least - 1
        if after > before:
            stack.append([after, places[i], [i], [], lefts[i], i])
        elif stack:
            absorb(stack[-1], places[i], [i], lefts[i])
            while stack and stack[-1][0] > after:
                length, best, firsts, others, left, begin = stack.pop()
                if left == _DIVERSE:
                    yield length, range(begin, i + 1), others, False
                if stack and stack[-1][0] >= after:
                    absorb(stack[-1], best, firsts, left)
                elif after >= least:
                    stack.append([after, best, list(firsts), [], left, begin])
        before = after


def maximal_repeats(tiles: list[np.ndarray], firsts: list[tuple], copied: list[bool], least: int) -> Iterator[tuple]:
    """(length, tiles of occurrences, their starts, which are later ones, copies) of the maximal repeats of tiles, ``least`` long or more.

    Occurrences stand for those in a tile's copies too. ``firsts`` has the
    place of each tile: a document, and the start in it. With ``copies`` the repeat is a whole
    tile, and its copies are the later ones.
    """
    sizes = np.array([len(t) for t in tiles])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)
    for t, b in zip(tiles, begin.tolist(), strict=True):
        symbols[b : b + len(t)] = t
        symbols[b : b + len(t)] += 1
    windows = sizes - least + 1
    tile = np.repeat(np.arange(len(tiles)), windows)
    offset = _ranges(np.zeros(len(tiles), np.int64), windows)
    at = begin[tile] + offset
    shared = gram_hashes(_symbol_values()[symbols], least)[at]
    order = np.argsort(shared)
    tile, offset, at, shared = tile[order], offset[order], at[order], shared[order]
    left = np.where(offset > 0, symbols[at - 1], -2)
    stands = np.array(copied, bool)[tile] & (offset == 0)
    starts = np.flatnonzero(np.concatenate([[True], shared[1:] != shared[:-1]]))
    sized = np.diff(np.concatenate([starts, [len(at)]]))
    diverse = (np.minimum.reduceat(left, starts) != np.maximum.reduceat(left, starts)) | (np.minimum.reduceat(left, starts) == -2)
    whole = np.maximum.reduceat(stands, starts)
    for t in tile[starts[whole & (sized == 1)]].tolist():  # intervals of a tile and its copies
        yield len(tiles[t]), np.array([t]), np.zeros(1, np.int64), [], True
    pick = _ranges(starts, sized)[np.repeat((sized > 1) & (diverse | whole), sized)]
    if not len(pick):
        return
    tile, offset, at, left, stands = (x[pick] for x in (tile, offset, at, left, stands))
    order, common = sorted_suffixes(symbols, at, sizes[tile] - offset)
    tile, offset, left, stands = (x[order] for x in (tile, offset, left, stands))
    # a suffix that begins its tile may go on to the left in its document: always diverse
    lefts = np.where(left >= 0, left, _DIVERSE).tolist()
    places = [(firsts[t][0], firsts[t][1] + o) for t, o in zip(tile.tolist(), offset.tolist(), strict=True)]
    commons = common.tolist()
    cuts = np.flatnonzero(np.concatenate([[True], common < least, [True]])).tolist()
    copies_at = np.flatnonzero(stands).tolist()
    c = 0
    for s, e in zip(cuts, cuts[1:], strict=False):
        standing = {}
        while c < len(copies_at) and copies_at[c] < e:
            standing[copies_at[c] - s] = len(tiles[tile[copies_at[c]]])
            c += 1
        for length, every, later, copies in scan(places[s:e], lefts[s:e], commons[s : e - 1], least, standing):
            at = slice(s + every.start, s + every.stop)
            yield length, tile[at], offset[at], [i - every.start for i in later], copies


def later_repeats(tiles: list[np.ndarray], firsts: list[tuple], copied: list[bool], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(tile, start, length, False) of what each tile has in common with an earlier place,
    and (tile, 0, length, True) if its copies are later occurrences of all of it."""
    for length, tile, start, later, copies in maximal_repeats(tiles, firsts, copied, least):
        if copies:
            yield int(tile[0]), int(start[0]), length, True
        for i in later:
            yield int(tile[i]), int(start[i]), length, False


def occurring_repeats(tiles: list[np.ndarray], firsts: list[tuple], copied: list[bool], least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, tiles and starts of all occurrences of each maximal repeat; those of a copied tile may come twice as one."""
    for length, tile, start, _, _ in maximal_repeats(tiles, firsts, copied, least):
        yield length, tile, start


def _bytes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
    raw = b"".join(texts)
    return np.frombuffer(raw, np.uint8), np.array([len(t) for t in texts]), lambda a, b: raw[a:b]


def _parsed(tiles: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in tiles]


def byte_rule(length: int = LENGTH, gram: int = GRAM) -> Rule:
    def segments(raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        for at in range(0, max(len(raw) - length + 1, 1), size):
            yield at, raw[at : at + size + length - 1]

    return Rule(segments, _bytes_of, _parsed, lambda sym: byte_values()[sym], length, gram, True, length, later_repeats, occurring_repeats)


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Maximal repeats with all their occurrences: ``repeat string, length int, doc_id long, start long``.

    ``repeat`` names a repeat by its content. A repeat is maximal within tiles: a longer one
    comes as several that overlap, each told by another key, and a run of one key is cut every
    ``length`` windows, so that places in another part of such a run may be missing. All occurrences are rows, copies
    included, so nothing is gathered. ``docs`` as in ``without_repeats``.
    """
    return occurrences(docs, byte_rule(length, gram))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    if not len(spans):
        return raw
    at, parts = 0, []
    for a, b in spans.tolist():
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Bytes, bytes removed, maximal removed runs and the hash of what is kept, a row a document.

    See ``without_repeats`` for nulls, repeated rows and empty tables.
    """

    def finish(text: str, spans: np.ndarray) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        gone = int((spans[:, 1] - spans[:, 0]).sum())
        return len(raw), gone, len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()

    return without_repeats(docs, byte_rule(length, gram), finish, DIGEST)


def _whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans.tolist():
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with all but the first of each repeated byte string cut from ``text``.

    Cuts keep to whole characters. A null text becomes empty. ``n_chars``, where there is
    one, follows the text. A document may become empty; no row is dropped. Other columns
    stay as they are; rows that repeat id and text get the same new text.
    """

    def finish(text: str, spans: np.ndarray) -> tuple:
        raw = text.encode("utf-8", "surrogatepass")
        new = _kept(raw, _whole_characters(raw, spans)).decode("utf-8", "surrogatepass")
        return new, int(np.uint64(xxhash.xxh64_intdigest(raw, 42)).astype(np.int64))

    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id")
    new = without_repeats(docs, byte_rule(length, gram), finish, "_text string, _k long").select(id_, "_k", "_text")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"),
        id_,
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_k"),
    ).join(new.dropDuplicates(["_id", "_k"]), ["_id", "_k"])
    put = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.length("_text").cast(dict(docs.dtypes)["n_chars"])
    return rows.select([put.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


def repeat_groups_of_documents(spark, sf_dir: str) -> DataFrame:
    """Maximal repeats of 100 bytes and more of ``documents``, with all their occurrences."""
    return repeat_groups(read(spark, sf_dir, "documents"))
