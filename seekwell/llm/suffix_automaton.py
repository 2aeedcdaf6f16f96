"""Repeated word sequences by suffix automata of reference shards.

The corpus is its own reference. A shard of it is what shares a window's key: an automaton
of all of it would grow with the data, so each shard's automaton goes, by the shuffle, only
to the documents that can match it. A shard's distinct tiles are put into one generalised
suffix automaton, whose states know the smallest document that has their words. Then the
tiles are streamed through it for matching statistics: the state of the longest match at
each word, cut back to a window's length, tells the first document of the window there. The
automaton's symbols are runs of seven words, one beginning at each word: a match of so many
symbols is one of six words more, and shorter ones are of no use.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from seekwell.llm.common import read
from seekwell.llm.repeats import Rule, byte_values, gram_hashes, without_repeats

LENGTH, GRAM = 13, 4
#: Words of a symbol of the automata; at most ``LENGTH``.
RUN = 7
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class SuffixAutomaton:
    """All subsequences of some sequences, with the smallest owner of each."""

    def __init__(self) -> None:
        self.steps: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, steps: dict, length: int, link: int, owner) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(owner)
        return len(self.link) - 1

    def _split(self, state: int, word, target: int) -> int:
        """A state for the shorter part of ``target``, as it is reached from ``state``."""
        steps, link, length = self.steps, self.link, self.length
        clone = self._state(dict(steps[target]), length[state] + 1, link[target], self.owner[target])
        link[target] = clone
        while state >= 0 and steps[state].get(word) == target:
            steps[state][word] = clone
            state = link[state]
        return clone

    def add(self, words: list, owner) -> None:
        """Put in a sequence of an owner; smaller owners have precedence."""
        steps, link, length, owners = self.steps, self.link, self.length, self.owner
        last = 0
        for word in words:
            there = steps[last].get(word)
            if there is not None:
                last = there if length[there] == length[last] + 1 else self._split(last, word, there)
                if owners[last] is None or owner < owners[last]:
                    owners[last] = owner
                continue
            new = len(link)
            steps.append({})
            length.append(length[last] + 1)
            owners.append(owner)
            steps[last][word] = new
            state = link[last]
            while state >= 0:
                there = steps[state].setdefault(word, new)
                if there != new:
                    break
                state = link[state]
            else:
                there = 0
            link.append(0)
            if there:
                link[new] = there if length[there] == length[state] + 1 else self._split(state, word, there)
            last = new

    def settle(self) -> None:
        """Hand each state's owner down to the states of its suffixes."""
        link, owners = self.link, self.owner
        for state in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[state]
            if up > 0 and owners[state] < owners[up]:
                owners[up] = owners[state]

    def first_owners(self, words: list, n: int) -> Iterator[tuple[int, object]]:
        """(end, first owner) of the windows of ``n`` words of a sequence that the automaton has."""
        steps, link, length, owners = self.steps, self.link, self.length, self.owner
        state = matched = 0
        for end, word in enumerate(words, 1):
            while state and word not in steps[state]:
                state = link[state]
                matched = length[state]
            if word in steps[state]:
                state, matched = steps[state][word], matched + 1
            if matched >= n:
                at = state
                while length[link[at]] >= n:
                    at = link[at]
                yield end, owners[at]


def earlier_windows(tiles: list[np.ndarray], firsts: list[tuple], copied: list[bool], least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(tile, start, length, False) of each tile's maximal runs of windows that an earlier document has,
    and (tile, 0, length, True) if that is so of all of it for the documents of its copies."""
    shard = SuffixAutomaton()
    sizes = np.array([len(t) for t in tiles])
    ends = np.cumsum(sizes)
    symbols = np.unique(gram_hashes(np.concatenate(tiles), RUN), return_inverse=True)[1].tolist()
    lists = [symbols[end - n : end - RUN + 1] for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    least -= RUN - 1
    for words, (owner, _) in zip(lists, firsts, strict=True):
        shard.add(words, owner)
    shard.settle()
    for i, (words, (owner, _), copies) in enumerate(zip(lists, firsts, copied, strict=True)):
        start = stop = known = 0
        for end, first in shard.first_owners(words, least):
            known += first <= owner
            if first < owner:
                if end != stop + 1 or not stop:
                    if stop:
                        yield i, start, stop - start + RUN - 1, False
                    start = end - least
                stop = end
        if stop:
            yield i, start, stop - start + RUN - 1, False
        # copies are in documents behind the first owner's, so a window known from there is earlier than all of them
        if copies and known == len(words) - least + 1:
            yield i, 0, len(words) + RUN - 1, True


_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
    """Hashes of the words of all texts, how many each text has, and the bytes of a range of words.

    A word's hash is a polynomial of its bytes' random values, taken from a running sum.
    """
    joined = b" ".join([*texts, b""])
    raw = np.frombuffer(joined, np.uint8)
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    powers, inverse = (np.full(len(raw) + 1, x) for x in (_ODD, _INVERSE))
    for x in (powers, inverse):
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_values()[raw] * powers[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    hashes ^= hashes >> np.uint64(31)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    return hashes, counts, lambda a, b: joined[starts[a] : ends[b - 1]]


def _parsed(tiles: list[bytes]) -> list[np.ndarray]:
    hashes, counts, _ = _words_of(tiles)
    return np.split(hashes, np.cumsum(counts)[:-1])


#: A word this long is compared by its hash.
_LONG = 1 << 16
_LONG_WORD = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % _LONG)


def _short_words(raw: bytes) -> bytes:
    """A text with its very long words as hashes of 256 bits."""
    if len(raw) < _LONG:
        return raw
    return _LONG_WORD.sub(lambda m: b"\x00" + hashlib.sha256(m[0]).hexdigest().encode(), raw)


_BLANKS = re.compile(rb"[\x20\x09-\x0D]")


def _slices(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in pieces that end between words, about ``size`` bytes each."""
    at = 0
    while at < len(raw):
        stop = _BLANKS.search(raw, at + size)
        end = stop.end() if stop else len(raw)
        yield raw[at:end]
        at = end


def word_rule(length: int = LENGTH, gram: int = GRAM) -> Rule:
    def segments(raw: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        raw = _short_words(raw)
        if len(raw) <= size:
            yield 0, raw
            return
        before, held = 0, None
        for part in _slices(raw, size):
            words = part.split()
            if held is not None:  # the last piece is sent on with the first words of this one
                if len(words) < length - 1:
                    held = (held[0], held[1] + part)
                    continue
                yield held[0], held[1] + b" ".join(words[: length - 1])
            held = (before, part)
            before += len(words)
        if held:
            yield held

    return Rule(segments, _words_of, _parsed, lambda sym: sym, length, gram, False, 2 * length - 1, earlier_windows)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Words, words removed, and the hash of the words kept, a row a document.

    A word goes if a window of ``length`` words around it also starts in a document with a
    smaller id. See ``without_repeats`` for nulls, repeated rows and empty tables.
    """

    def finish(text: str, spans: np.ndarray) -> tuple:
        n_words = n_kept = 0
        kept = hashlib.sha256()
        for part in _slices(text.encode("utf-8", "surrogatepass"), 1 << 20):
            words = part.split()
            if len(spans):
                gone = np.zeros(len(words) + 1, np.int64)
                at = np.clip(spans - n_words, 0, len(words))
                np.add.at(gone, at[:, 0], 1)
                np.add.at(gone, at[:, 1], -1)
                stay = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
            else:
                stay = words
            n_words += len(words)
            if stay:
                kept.update(b" " * bool(n_kept) + b" ".join(stay))
                n_kept += len(stay)
        return n_words, n_words - n_kept, kept.hexdigest()

    return without_repeats(docs, word_rule(length, gram), finish, "n_words long, n_removed long, kept_sha256 string")


def op7_suffix_automaton_dedup(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
