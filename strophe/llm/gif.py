"""GIF columns: texts as lossless image sequences, decoded to timed frames.

Writing: a text's UTF-8 bytes, filled up with bytes 255 to a positive multiple
of 576, are the palette numbers of 24 x 24 frames of one GIF89a; each frame is
an LZW code stream of its own.  Reading handles any GIF: code streams with
early and deferred clears, global and local palettes, interlace, frames smaller
than the canvas, transparency and the disposal rules; it gives the palette
numbers, the composed canvas, the delay and a colour histogram (4 x 4 x 4
cells) of every frame.

Defined cases: a null text is an empty one, that is one frame of 255s; equal
texts have equal files; null files give no frames; a truncated file raises
ValueError, or gives no frames with ``strict=False``; repeated rows are each
answered; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.llm._text import add_columns, blocks, bytes_of

SIDE = 24
FRAME = SIDE * SIDE
DELAY = 4  # hundredths of a second
_V = np.arange(256)
#: The writer's palette; red alone tells the numbers apart.
PALETTE = np.stack([_V, _V * 5 % 256, _V * 11 % 256], axis=1).astype(np.uint8)
_SINGLE = [bytes([v]) for v in range(256)]
_MOST = 4096


def _widths(bits: int, n: int) -> np.ndarray:
    """Bit widths of the codes 0..n-1 after a clear; the table grows by one
    with every code but the first, and a width holds until it is full."""
    size = (1 << bits) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.frexp(np.minimum(size, _MOST - 1).astype(float))[1]).astype(np.int64)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of codes after a clear, and the bits before each."""
    have = _CACHE.get(bits)
    if have is None or len(have[0]) < n:
        w = _widths(bits, max(n, 1024))
        have = _CACHE[bits] = (w, np.concatenate([[0], np.cumsum(w)]))
    return have


def lzw_codes(pixels: bytes) -> list[int]:
    """Codes of at most ``FRAME``-like runs of 8-bit pixels (no clear inside)."""
    table: dict[int, int] = {}
    get = table.get
    out = []
    push = out.append
    n = 258
    w = pixels[0]
    for c in pixels[1:]:
        k = w << 8 | c
        v = get(k)
        if v is None:
            push(w)
            table[k] = n
            n += 1
            w = c
        else:
            w = v
    push(w)
    return out


def encode(payload: bytes) -> bytes:
    """A GIF of 24 x 24 frames whose palette numbers are ``payload``."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload is not a positive multiple of a frame")
    frames = [[*lzw_codes(payload[k : k + FRAME]), 257] for k in range(0, len(payload), FRAME)]
    sizes = np.array([len(x) for x in frames])
    code = np.concatenate([np.array(x) for x in frames])
    width, before = _schedule(8, int(sizes.max()) + 1)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    n_bytes = (9 + before[sizes] + 7) // 8
    base = np.cumsum(n_bytes) - n_bytes
    at = np.repeat(base * 8, sizes) + 9 + before[place]
    all_at, all_code = np.concatenate([base * 8, at]), np.concatenate([np.full(len(frames), 256), code])
    value = all_code.astype(np.int64) << (all_at & 7)
    spot, total = all_at >> 3, int(n_bytes.sum())
    data = np.bincount(spot, value & 255, total + 2) + np.bincount(spot + 1, value >> 8 & 255, total + 2) + np.bincount(spot + 2, value >> 16, total + 3)[: total + 2]
    data = data.astype(np.uint8).tobytes()
    head = b"GIF89a" + SIDE.to_bytes(2, "little") * 2 + b"\xf7\x00\x00" + PALETTE.tobytes()
    out = [head]
    frame = b"\x21\xf9\x04\x04" + DELAY.to_bytes(2, "little") + b"\x00\x00" + b"\x2c\x00\x00\x00\x00" + SIDE.to_bytes(2, "little") * 2 + b"\x00\x08"
    for b, n in zip(base.tolist(), n_bytes.tolist(), strict=True):
        out.append(frame)
        for k in range(b, b + n, 255):
            part = data[k : min(k + 255, b + n)]
            out.append(bytes([len(part)]) + part)
        out.append(b"\x00")
    out.append(b"\x3b")
    return b"".join(out)


def lzw_pixels(data: bytes, bits: int, n_pixels: int) -> bytes:
    """Decode one code stream to ``n_pixels`` palette numbers."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\x00\x00\x00", np.uint8).astype(np.int64)
    total = 8 * len(data)
    at, out, size = 0, [], 0
    while size < n_pixels:
        # codes up to the next clear or stop, as if there were none
        n = (total - at) // (bits + 1) + 1
        width, before = _schedule(bits, n)
        n = int(np.searchsorted(before, total - at, side="right")) - 1 if before[-1] >= total - at else len(width)
        n = min(n, len(width))
        if n <= 0:
            raise ValueError("a code stream ends early")
        where = at + before[:n]
        spot = where >> 3
        codes = (raw[spot] | raw[spot + 1] << 8 | raw[spot + 2] << 16) >> (where & 7) & ((1 << width[:n]) - 1)
        special = np.flatnonzero((codes == clear) | (codes == stop))
        k = int(special[0]) if len(special) else n
        if k:
            table = [*_SINGLE[:clear], b"", b""]
            add, push = table.append, out.append
            listed = codes[:k].tolist()
            if listed[0] >= clear:
                raise ValueError("a code stream does not begin with a pixel")
            last = table[listed[0]]
            push(last)
            for c in listed[1 : _MOST - clear - 1]:
                try:
                    entry = table[c]
                except IndexError:
                    if c != len(table):
                        raise ValueError("a code beyond the table") from None
                    entry = last + last[:1]
                add(last + entry[:1])
                push(entry)
                last = entry
            for c in listed[_MOST - clear - 1 :]:  # the table is full
                push(table[c])
            size = sum(map(len, out)) if k < n and codes[k] == clear else size
        if k == n or codes[k] == stop:
            break
        at += int(before[k] + width[k])
    pixels = b"".join(out)
    if len(pixels) < n_pixels:
        raise ValueError("a frame has too few pixels")
    return pixels[:n_pixels]


def lzw_pixels_many(streams: list[tuple[bytes, int, int]]) -> list[bytes]:
    """``lzw_pixels`` of many (data, bits, n_pixels) at once.

    A code's string is a run of the output before it: the entry made after
    code e+1 is the string of code e and one more pixel.  So all streams step
    through their codes together, keeping run lengths only, and pixels are then
    found by following runs back to single pixels.  Streams with a later clear
    or over a table's size are decoded alone.
    """
    out: list[bytes | None] = [None] * len(streams)
    own = [i for i, (d, b, n) in enumerate(streams) if b == 8 and n <= _MOST - 300 and len(d) > 2]
    if own:
        data = [streams[i][0] for i in own]
        want = np.array([streams[i][2] for i in own])
        raw = np.frombuffer(b"".join([*data, b"\0\0\0"]), np.uint8).astype(np.int32)
        n_bytes = np.array([len(d) for d in data])
        base = np.cumsum(n_bytes) - n_bytes
        most = int(min(want.max() + 3, n_bytes.max() * 8 // 9 + 1))
        width, before = _schedule(8, most + 1)
        width, before = np.append(9, width[: most - 1]), np.append(0, 9 + before[: most - 1])
        at = base[:, None] * 8 + before[None]
        inside = before[None] + width[None] <= n_bytes[:, None] * 8
        spot = np.minimum(at >> 3, len(raw) - 3)
        codes = (raw[spot] | raw[spot + 1] << 8 | raw[spot + 2] << 16) >> (at & 7).astype(np.int32) & ((1 << width) - 1).astype(np.int32)[None]
        codes = np.where(inside, codes, 257)
        # columns: clear, codes ..., stop
        special = (codes == 256) | (codes == 257)
        special[:, 0] = False
        many = np.where(special.any(axis=1), special.argmax(axis=1), most) - 1
        fine = (codes[:, 0] == 256) & (many > 0) & (codes[np.arange(len(own)), np.minimum(many + 1, most - 1)] == 257) & (codes[:, min(1, most - 1)] < 256)
        codes = codes[:, 1:]
        n, k_most = codes.shape
        entry = codes - 258
        k = np.arange(k_most)[None]
        live = k < many[:, None]
        fine &= ~(live & (entry >= k)).any(axis=1)
        live &= fine[:, None]
        length = np.zeros((n, k_most), np.int32)
        rows = np.arange(n)
        length[:, 0] = live[:, 0]
        for j in range(1, k_most):
            e = entry[:, j]
            length[:, j] = np.where(e < 0, 1, length[rows, np.maximum(e, 0)] + 1) * live[:, j]
        ends = np.cumsum(length.ravel(), dtype=np.int64)
        starts = (ends - length.ravel()).reshape(n, k_most)
        source = np.where(entry < 0, starts, np.take_along_axis(starts, np.maximum(entry, 0).astype(np.int64), axis=1))
        total = int(ends[-1])
        follow = np.arange(total) - np.repeat((starts - source).ravel(), length.ravel())
        value = np.repeat(np.minimum(codes, 255).astype(np.uint8).ravel(), length.ravel())
        todo = np.flatnonzero(follow != np.arange(total))
        while len(todo):
            further = follow[follow[todo]]
            moved = further != follow[todo]
            follow[todo] = further
            todo = todo[moved]
        pixels = value[follow]
        first = starts[:, 0]
        got = length.sum(axis=1)
        for i, a, g, w, ok in zip(own, first.tolist(), got.tolist(), want.tolist(), (fine & (got >= want)).tolist(), strict=True):
            if ok:
                out[i] = pixels[a : a + w].tobytes()
    return [lzw_pixels(*streams[i]) if x is None else x for i, x in enumerate(out)]


@dataclass
class Picture:
    """A frame as stored."""

    x: int
    y: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    bits: int
    stream: bytes
    disposal: int
    delay_ms: int
    clear: int | None  # the transparent palette number


@dataclass
class Frame:
    indices: bytes  # palette numbers, rows from the top
    canvas: np.ndarray  # [height, width, 4] after this frame
    delay_ms: int

    def histogram(self) -> np.ndarray:
        return colours([self.canvas])


def _rows(height: int) -> np.ndarray:
    return np.concatenate([np.arange(0, height, 8), np.arange(4, height, 8), np.arange(2, height, 4), np.arange(1, height, 2)])


def parse(data: bytes) -> tuple[int, int, list[Picture]]:
    """Canvas width and height and the stored frames of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    try:
        return _parse(data)
    except (IndexError, ValueError) as e:
        raise ValueError(f"a damaged GIF: {e}") from None


def _parse(data: bytes) -> tuple[int, int, list[Picture]]:
    size, flags, at, palette = (int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")), data[10], 13, None
    found: list[Picture] = []

    def table(at: int, flags: int) -> np.ndarray:
        n = 2 << (flags & 7)
        rgba = np.full((256, 4), 255, np.uint8)
        rgba[:n, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        return rgba

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    if flags & 0x80:
        palette = table(at, flags)
        at += 3 * (2 << (flags & 7))
    delay, disposal, clear = 0, 0, None
    while (kind := data[at]) != 0x3B:
        if kind == 0x21:
            label = data[at + 1]
            block, at = joined(at + 2)
            if label == 0xF9:
                disposal, delay = block[0] >> 2 & 7, int.from_bytes(block[1:3], "little") * 10
                clear = block[3] if block[0] & 1 else None
        elif kind == 0x2C:
            x, y, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
            own, at = data[at + 9], at + 10
            colours = palette
            if own & 0x80:
                colours = table(at, own)
                at += 3 * (2 << (own & 7))
            if colours is None:
                raise ValueError("a frame without a palette")
            bits = data[at]
            stream, at = joined(at + 1)
            found.append(Picture(x, y, w, h, bool(own & 0x40), colours, bits, stream, disposal, delay, clear))
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("an unknown block")
    return *size, found


def compose(width: int, height: int, pictures: list[Picture], pixels: list[bytes]) -> Iterator[Frame]:
    """Draw the frames one after the other."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for p, indices in zip(pictures, pixels, strict=True):
        square = np.frombuffer(indices, np.uint8).reshape(p.height, p.width)
        if p.interlaced:
            plain = np.empty_like(square)
            plain[_rows(p.height)] = square
            square, indices = plain, plain.tobytes()
        old, canvas = canvas, canvas.copy()
        part = canvas[p.y : p.y + p.height, p.x : p.x + p.width]
        square = square[: part.shape[0], : part.shape[1]]
        part[...] = p.palette[square] if p.clear is None else np.where((square == p.clear)[..., None], part, p.palette[square])
        yield Frame(indices, canvas, p.delay_ms)
        if p.disposal == 3:
            canvas = old
        elif p.disposal == 2:
            canvas = canvas.copy()
            canvas[p.y : p.y + p.height, p.x : p.x + p.width] = 0


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order."""
    width, height, pictures = parse(data)
    yield from compose(width, height, pictures, lzw_pixels_many([(p.stream, p.bits, p.width * p.height) for p in pictures]))


def colours(canvases: list[np.ndarray]) -> np.ndarray:
    """Pixels in 64 cells of colour (4 x 4 x 4)."""
    if not canvases:
        return np.zeros(64, np.int64)
    c = np.concatenate([x.reshape(-1, 4) for x in canvases]).view("<u4").ravel()
    return np.bincount((c >> 6 & 3) << 4 | (c >> 14 & 3) << 2 | (c >> 22 & 3), minlength=64)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME or (0 if text else FRAME))


def store_texts(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_bytes and media, the GIF of each text."""

    def make():
        def apply(text):
            buf, offsets = bytes_of(text)
            media = [encode(padded(buf[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return [pa.array(np.diff(offsets)), pa.array(media, pa.large_binary()).cast(pa.binary())]

        return apply

    return add_columns(docs, [text_col], [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], make, keep=keep)


def read_back(media: DataFrame, *, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``media`` with payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, n_frames, duration_ms, histogram (64 cells) and feature."""

    def make():
        def apply(column):
            buf, offsets = bytes_of(column)
            valid = column.is_valid().to_pylist()
            rows = []
            for i, j in blocks(offsets, 1 << 20):
                files = [(parse(buf[offsets[k] : offsets[k + 1]].tobytes()) if valid[k] else None) for k in range(i, j)]
                pixels = iter(lzw_pixels_many([(p.stream, p.bits, p.width * p.height) for f in files if f for p in f[2]]))
                for k, f in zip(range(i, j), files, strict=True):
                    if f is None:
                        rows.append([None] * 9)
                        continue
                    width, height, pictures = f
                    sha, n, tail, count, ms, hist, held = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, np.int64), []
                    for x in compose(width, height, pictures, [next(pixels) for _ in pictures]):
                        sha.update(x.indices)
                        n += len(x.indices)
                        tail = (tail + x.indices)[-32:]
                        count += 1
                        ms += x.delay_ms
                        held.append(x.canvas)
                        if len(held) == 64:
                            hist += colours(held)
                            held = []
                    hist += colours(held)
                    share = hist * 1000 // max(1, hist.sum())
                    feature = f"{count}f:" + "".join(f"{v:03x}" for v in share.tolist())
                    rows.append([n, sha.hexdigest(), zlib.crc32(tail), int(offsets[k + 1] - offsets[k]), hashlib.sha256(buf[offsets[k] : offsets[k + 1]]).hexdigest(), count, ms, hist.tolist(), feature])
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

        return apply

    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "duration_ms", "histogram", "feature"]
    types = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.StringType()]
    return add_columns(media, [media_col], [T.StructField(n, t) for n, t in zip(names, types, strict=True)], make, keep=keep)


def frames(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media", strict: bool = True) -> DataFrame:
    """A row for each frame: id, frame, start_ms, delay_ms, width, height,
    rgba (the composed canvas) and histogram."""
    src = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram"]
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                try:
                    for k, f in enumerate(decode(data) if data is not None else ()):
                        rows.append((k, at, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), f.histogram().tolist()))
                        at += f.delay_ms
                except ValueError:
                    if strict:
                        raise
                    rows = []
                for i in range(0, len(rows), 1024):
                    part = rows[i : i + 1024]
                    cols = list(zip(*part, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(part), batch.column(0).type), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.list_(pa.int64()))], names=names)

    return src.mapInArrow(run, f"id {kind}, frame long, start_ms long, delay_ms long, width long, height long, rgba binary, histogram array<long>").withColumnRenamed("id", id_col)


def op3_gif_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = store_texts(docs, keep=["doc_id"])
    return read_back(stored, keep=["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms")
