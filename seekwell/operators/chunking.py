"""Cutting documents into chunks of bounded token counts at headings, fences and line ends."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TARGET, RESERVED, MOST_OVERLAP = 900, 128, 96
#: What the rules are; other rules are another recipe.
RECIPE = ("v2", f"target={TARGET}", f"reserved={RESERVED}", "heading-fence-paragraph-line", f"overlap-after-soft-ends={MOST_OVERLAP}")
#: Characters, and chunks, that a task sends at a time.
SENT, SENT_ROWS = 1_000_000, 10_000
_FENCE = re.compile(r" {0,3}`{3,}")
_HEADING = re.compile(r" {0,3}#{1,6}([ \t\x0b\x0c\r]|$)")
#: White space that breaks lines or words; non-breaking spaces are text.
_BLANK = re.compile(r"[\t-\r\x1c-\x20  -  -    　]*")


def default_tokens(text: str) -> int:
    """A stand-in for a model's tokenizer."""
    return max(1, len(text) // 4)


def structure(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Boundaries (offset, priority) in order, and fences (start, end).

    Headings have 3, edges of a fence 2, blank lines 1, other line ends 0; inside a fence there
    is none. An open fence runs to the end. Lines end with line feeds only.
    """
    marks: dict[int, int] = {}
    fences, opened, at = [], None, 0

    def mark(offset: int, priority: int) -> None:
        marks[offset] = max(priority, marks.get(offset, 0))

    for part in re.findall(r"[^\n]*\n|[^\n]+", text):
        line, end = part.removesuffix("\n").removesuffix("\r"), at + len(part)
        if _FENCE.match(line):
            if opened is None:
                opened = at
                mark(at, 2)
            else:
                fences.append((opened, end))
                opened = None
                mark(end, 2)
        elif opened is None:
            if _HEADING.match(line):
                mark(at, 3)
            mark(end, 1 if _BLANK.fullmatch(line) else 0)
        at = end
    if opened is not None:
        fences.append((opened, len(text)))
    return sorted(marks.items()), fences


def chunks(text: str, count: Callable[[str], int] = default_tokens, most_input: int = 2048) -> list[tuple[int, int]]:
    """Spans of a text's chunks, none for blank text. Offsets count code points.

    A chunk ends before a fence that it would cut, or behind it if that still fits; else at
    the boundary of highest priority in its second half, the last of equals. After a soft end
    the next chunk begins within the last tenth, behind a line end if there is one.
    """
    if _BLANK.fullmatch(text):
        return []
    limit = min(TARGET, most_input - RESERVED)
    boundaries, fences = structure(text)
    offsets = [b for b, _ in boundaries]
    out, start, covered = [], 0, 0

    def fit(begin: int, end: int) -> int:
        while end - begin > 1 and (n := count(text[begin:end])) > limit:
            end = min(end - 1, begin + max(1, (end - begin) * limit // n))
        return end

    def overlap(begin: int, end: int) -> int:
        at = end - max(1, (end - begin) // 10)
        while at < end and count(text[at:end]) > max(1, min(MOST_OVERLAP, limit // 10)):
            at += max(1, (end - at) // 3)
        newline = text.find("\n", at, end - 1)
        at = newline + 1 if newline >= 0 else at
        return at if begin < at < end else end

    while covered < len(text):
        end = fit(start, min(len(text), start + 3 * limit))
        end, strong = max(end, covered + 1), False
        fence = next(((a, b) for a, b in fences if a < end < b), None)
        if fence and fence[0] > max(start, covered):
            end, strong = fence[0], True
        elif fence and count(text[start : fence[1]]) <= limit:
            end, strong = fence[1], True
        elif end < len(text):
            low = max(covered + 1, start + (end - start) // 2)
            i, j = bisect.bisect_left(offsets, low), bisect.bisect_right(offsets, end)
            if i < j:
                end, priority = max(boundaries[i:j], key=lambda b: (b[1], b[0]))
                strong = priority > 0
        out.append((start, end))
        begin, covered = start, end
        start = covered if strong else overlap(begin, end)
    return out


def chunked(contents: DataFrame, count: Callable[[str], int] = default_tokens, most_input: int = 2048) -> DataFrame:
    """``contents(content_hash, body)`` to chunks; each distinct content is given once.

    A task has one text as a string at a time, and sends its chunks in batches of ``SENT`` characters.
    """

    names = ("content_hash", "chunk_index", "char_start_offset", "char_end_offset", "body", "token_count")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for name, body in zip(*batch.columns, strict=True):
                text = body.as_py()
                if text is None:
                    continue
                for i, (a, b) in enumerate(chunks(text, count, most_input)):
                    rows.append((name.as_py(), i, a, b, text[a:b], count(text[a:b])))
                    size += b - a
                    if size >= SENT or len(rows) >= SENT_ROWS:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "content_hash string, chunk_index int, char_start_offset int, char_end_offset int, body string, token_count int"
    return contents.select("content_hash", "body").mapInArrow(cut, schema)
