"""GIF images as columns: LZW streams, palettes, disposal, transparency, timed frames.

``encode`` stores bytes as the pixels of frames, ``decode`` reads any GIF 87a or 89a into
its timed frames as composed on the screen, with a histogram of each colour channel.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from seekwell.llm.common import read, task_count

#: A payload's row of pixels, and the rows of a frame at most.
ROW, MOST_ROWS = 192, 64
DELAY_MS = 100
BINS = 4
#: Bytes of images, and frames, that a task sends at a time.
SENT, SENT_ROWS = 2_000_000, 2000
#: MB of texts that a task stores and reads.
TASK_MB = 4
_FULL = 4096
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
_COLOURS = np.stack([np.arange(256), 255 - np.arange(256), np.arange(256) * 7 % 256], axis=1).astype(np.uint8).tobytes()
#: A frame stays, is cleared, or gives way to what was before it; this sample is see-through.
DISPOSALS, SEE_THROUGH = (1, 2, 3), 32


class BrokenImage(ValueError):
    """The bytes are not a whole GIF."""


@lru_cache(16)
def _schedule(clear: int) -> tuple[np.ndarray, list[bytes]]:
    """Bits of the codes since a clear code, by their number, and the entries that it leaves.

    Each code after the first adds an entry, and the width follows the next entry's number;
    a table holds 4096 entries, so all later codes have 12 bits.
    """
    entry = clear + 1 + np.arange(_FULL)
    least = int(clear).bit_length()
    widths = least + sum((entry >= 1 << b).astype(np.int64) for b in range(least, 12))
    return widths, [bytes([i]) for i in range(clear)] + [b"", b""]


def lzw_codes(data: bytes) -> list[np.ndarray]:
    """Codes of 8-bit samples, in runs that a clear code begins; the last ends with the end code.

    Words are kept shifted by eight bits, so that a word and a sample make a key at once.
    """
    runs, run, known, entry = [], [256 << 8], {}, 258 << 8
    seen, add, samples = known.get, run.append, iter(data)
    word = next(samples, -1) << 8
    for c in samples:
        key = word | c
        longer = seen(key)
        if longer is not None:
            word = longer
            continue
        add(word)
        known[key] = entry
        entry += 256
        word = c << 8
        if entry == _FULL << 8:
            runs.append(run)
            run, known, entry = [256 << 8], {}, 258 << 8
            seen, add = known.get, run.append
    if data:
        add(word)
    add(257 << 8)
    return [np.array(r, np.int64) >> 8 for r in (*runs, run)]


def _packed(runs: list[np.ndarray]) -> bytes:
    """Codes as bits, lowest first. A clear code has the width of the code that it takes the place of."""
    widths, before = _schedule(256)[0], 0
    parts = []
    for run in runs:
        parts += [widths[before : before + 1], widths[: len(run) - 1]]
        before = len(run) - 1
    value, width = np.concatenate(runs), np.concatenate(parts)
    at = np.cumsum(width)
    size = (int(at[-1]) + 7) // 8
    at -= width
    value <<= at & 7
    at >>= 3
    out = np.bincount(at, weights=value & 255, minlength=size + 2)
    out += np.bincount(at + 1, weights=value >> 8 & 255, minlength=size + 2)
    out += np.bincount(at + 2, weights=value >> 16, minlength=size + 2)[: size + 2]
    return out[:size].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, code_size: int, most: int) -> bytes:
    """Samples of one image's code stream, ``most`` at most."""
    if not 1 <= code_size <= 8:
        raise BrokenImage("an unknown code size")
    clear = 1 << code_size
    widths, base = _schedule(clear)
    raw = np.zeros(len(stream) + 4, np.int64)
    raw[: len(stream)] = np.frombuffer(stream, np.uint8)
    total, bit, index, table, last, out, made = 8 * len(stream), 0, 0, list(base), b"", [], 0
    while made < most:
        n = min(1024, max(1, (total - bit) // 9 + 1))
        width = widths[index : index + n] if index + n <= _FULL else widths[np.minimum(np.arange(index, index + n), _FULL - 1)]
        at = np.cumsum(width) + bit
        fit = int(np.searchsorted(at, total, "right"))
        if not fit:
            raise BrokenImage("a code stream ends early")
        ends, width = at[:fit], width[:fit]
        at = ends - width
        byte = at >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes >> 1) == (clear >> 1))
        n = int(stops[0]) if len(stops) else fit
        todo = codes[:n].tolist()
        first = len(out)
        if todo and not last:
            if todo[0] >= clear:
                raise BrokenImage("a code stream begins with an unknown code")
            last = base[todo.pop(0)]
            out.append(last)
        room = _FULL - len(table)
        give, add = out.append, table.append
        for code in todo[:room]:
            try:
                entry = table[code]
            except IndexError:
                if code > len(table):
                    raise BrokenImage("a code stream has an unknown code") from None
                entry = last + last[:1]
            give(entry)
            add(last + entry[:1])
            last = entry
        for code in todo[room:]:
            last = table[code]
            give(last)
        made += sum(map(len, out[first:]))
        if n == fit:
            bit, index = int(ends[-1]), index + n
        elif codes[n] == clear:
            bit, index, table, last = int(ends[n]), 0, list(base), b""
        else:
            break
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p := data[i : i + 255])]) + p for i in range(0, len(data), 255)) + b"\0"


def encode(payload: bytes, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF whose frames' pixels, in order, are the bytes of ``payload``: a positive multiple of ``ROW``.

    Bytes are grey levels, and in every other frame colours of a palette of its own; spaces are
    see-through, and frames stay, are cleared, or give way to what was before, in turn.
    """
    rows, rest = divmod(len(payload), ROW)
    if rest or not rows:
        raise ValueError(f"a payload is a positive multiple of {ROW} bytes")
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, min(rows, MOST_ROWS), 0xF7, 0, 0), _GREY]
    for frame, top in enumerate(range(0, rows, MOST_ROWS)):
        part = payload[top * ROW : (top + MOST_ROWS) * ROW]
        own = _COLOURS if frame % 2 else b""
        out += [
            b"\x21\xf9\x04" + struct.pack("<BHBB", DISPOSALS[frame % 3] << 2 | 1, delay_ms // 10, SEE_THROUGH, 0),
            b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, len(part) // ROW, 0x87 if own else 0) + own + b"\x08",
            _blocks(_packed(lzw_codes(part))),
        ]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    width: int
    height: int
    samples: bytes  # palette indices of the frame's own rectangle, row by row
    screen: np.ndarray  # height x width x 4: the composed picture, red, green, blue, opacity

    def histogram(self) -> list[list[int]]:
        """Opaque pixels of the composed picture by channel and quarter of the range."""
        pixels = self.screen.reshape(-1, 4)
        if not pixels[:, 3].all():
            pixels = pixels[pixels[:, 3] > 0]
        return [np.bincount(pixels[:, k], minlength=256).reshape(BINS, -1).sum(axis=1).tolist() for k in range(3)]


def _rows_in_order(height: int) -> np.ndarray:
    """Rows of an interlaced image in the order in which they are stored."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> list[Frame]:
    """Frames of a GIF with their times, composed by the rules of disposal and transparency."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise BrokenImage("no GIF header")
    try:
        return _decoded(data)
    except (IndexError, struct.error) as e:
        raise BrokenImage("the image ends early") from e


def _decoded(data: bytes) -> list[Frame]:
    wide, high, flags = struct.unpack_from("<HHB", data, 6)
    at = 13

    def palette(bits: int) -> np.ndarray:
        nonlocal at
        n = 3 * (2 << (bits & 7))
        if at + n > len(data):
            raise BrokenImage("a palette ends early")
        found = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
        return found

    def blocks() -> bytes:
        nonlocal at
        found = []
        while n := data[at]:
            found.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(found)

    shared = palette(flags) if flags & 0x80 else None
    screen = np.zeros((high, wide, 4), np.uint8)
    frames: list[Frame] = []
    disposal, delay, clear_index, clock = 0, 0, -1, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return frames
        if kind == 0x21:
            label = data[at]
            at += 1
            body = blocks()
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else -1
            continue
        if kind != 0x2C:
            raise BrokenImage("an unknown block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(bits) if bits & 0x80 else shared
        size = data[at]
        at += 1
        samples = lzw_decode(blocks(), size, w * h)
        if colours is None or len(samples) < w * h:
            raise BrokenImage("an image lacks pixels or a palette")
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        if bits & 0x40:
            straight = np.empty_like(index)
            straight[_rows_in_order(h)] = index
            index, samples = straight, straight.tobytes()
        before = screen.copy() if disposal == 3 else None
        area = screen[top : top + h, left : left + w]
        seen = index[: area.shape[0], : area.shape[1]]
        if seen.size and int(seen.max()) >= len(colours):
            raise BrokenImage("a pixel is outside the palette")
        shown = np.insert(colours, 3, 255, axis=1)[seen]
        if clear_index >= 0:
            opaque = seen != clear_index
            area[opaque] = shown[opaque]
        else:
            area[:] = shown
        frames.append(Frame(clock, 10 * delay, w, h, samples, screen.copy()))
        clock += 10 * delay
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            screen = before
        disposal, delay, clear_index = 0, 0, -1


FRAME_COLUMNS = (
    "frame int, start_ms long, delay_ms long, width int, height int, samples binary, "
    "red array<long>, green array<long>, blue array<long>, error string"
)


def timed_frames(images: DataFrame, column: str = "gif", key: str = "doc_id") -> DataFrame:
    """A row for each frame of each image: its time, pixels and colour histograms.

    A null image has no frames; a broken one has a single row that tells the error.
    """

    def read_all(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for pdf in parts:
            for name, data in zip(pdf["key"], pdf["image"], strict=True):
                if data is None:
                    continue
                try:
                    rows += [
                        (name, i, f.start_ms, f.delay_ms, f.width, f.height, f.samples, *f.histogram(), None)
                        for i, f in enumerate(decode(bytes(data)))
                    ]
                except BrokenImage as e:
                    rows.append((name, *[None] * 9, str(e)))
                size += len(data)
                if size >= SENT or len(rows) >= SENT_ROWS:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names, dtype=object)

    kind = dict(images.dtypes)[key]
    names = [key, *(x.split()[0] for x in FRAME_COLUMNS.split(", "))]
    picked = images.selectExpr(f"`{key}` AS key", f"`{column}` AS image")
    return picked.mapInPandas(read_all, f"`{key}` {kind}, {FRAME_COLUMNS}")


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text, and these padded with spaces to a positive multiple of ``ROW``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (-len(raw) % ROW or (0 if raw else ROW))


def feature_of(frames: list[Frame]) -> str:
    """Frames, running time, and the histograms summed over the frames."""
    sums = np.sum([f.histogram() for f in frames], axis=0).tolist()
    bins = ";".join(f"{c}={','.join(map(str, s))}" for c, s in zip("rgb", sums, strict=True))
    return f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};{bins}"


def stored(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, gif)``; a null text is empty."""

    def store(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "gif": [encode(payload_of(t)[1]) for t in pdf["text"]]})

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInPandas(store, "doc_id long, gif binary")


DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def digests(docs: DataFrame) -> DataFrame:
    """Store every text as a GIF, read the stored bytes back, and digest both.

    A row for each input row, repeated rows included; a null text is empty, which is stored
    as one row of spaces. An empty table gives an empty table.
    """

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for text in pdf["text"]:
                n, payload = payload_of(text)
                media = encode(payload)
                frames = decode(media)
                back = b"".join(f.samples for f in frames)
                rows.append(
                    (
                        n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]),
                        len(media), hashlib.sha256(media).hexdigest(), feature_of(frames),
                    )
                )
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64"))
            yield out

    names = [x.split()[0] for x in DIGEST.split(", ")]
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInPandas(digest, DIGEST)


def op9_gif_media(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))


def gif_timed_frames(spark, sf_dir: str) -> DataFrame:
    """Every frame of every stored text: its time, size and colour histograms, without the pixels."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    # files may have few parts, and a part's texts take seconds a MB
    dealt = docs.repartition(task_count(docs, TASK_MB, spark.sparkContext.defaultParallelism))
    frames = timed_frames(stored(dealt))
    return frames.select("doc_id", "frame", "start_ms", "delay_ms", "width", "height", "red", "green", "blue")
