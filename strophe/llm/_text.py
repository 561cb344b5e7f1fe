"""Shared text plumbing: Arrow row functions and a vectorised tokeniser.

The tokeniser works on UTF-8 bytes.  Every separator of the word classes used
here is ASCII and every byte of a multi-byte character is >= 0x80, so a byte
table gives the same words as the character classes do.

Word hashes have 64 bits: a polynomial of the word's bytes modulo 2**64,
mixed with its length.  All heavy arrays are made chunk by chunk, so memory
follows the words of a text, not a multiple of its bytes.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strophe.plans.lineage import checkpoint, shared_folder

__all__ = ["add_columns", "blocks", "bytes_of", "checkpoint", "give_back", "hashes", "held_out", "mix", "shared_folder", "shingles", "stored", "tidy", "words"]

CHUNK = 1 << 18
BLOCK = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, *range(0x09, 0x0E)]] = False

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def give_back() -> None:
    """Return freed memory to the machine: idle Python workers are kept for
    later tasks, and would hold all that their largest task has had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over a task's batches that gives memory back at its end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_P, CHUNK), _powers(_PINV, CHUNK)
_LETTER = LOWER.astype(np.uint64) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary column, and the n+1
    offsets of the values; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of values of about ``most`` bytes; a longer value is alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of all values, and the n+1 places
    among the words where each value's words begin.

    ``buf`` holds values back to back; ``offsets`` starts at 0.  A-Z count as
    a-z.
    """
    solid = kind[LOWER[buf]]
    n = len(buf)
    before = np.zeros(n + 1, dtype=bool)
    before[1:] = solid
    before[offsets[(offsets >= 0) & (offsets <= n)]] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(n + 1, dtype=bool)
    after[:-1] = solid
    after[offsets] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, hashes(buf, starts, ends), at


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        stop = ends[j - 1]
        if stop - base > CHUNK:  # one word longer than a chunk
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                scale = np.uint64(1)
                for k in range(base, stop, CHUNK):
                    part = _LETTER[buf[k : min(k + CHUNK, stop)]]
                    h = h + scale * (part * _POW[: len(part)]).sum(dtype=np.uint64)
                    scale = scale * _POW[-1] * _P
            out[i] = h
        else:
            sums = np.zeros(stop - base + 1, dtype=np.uint64)
            np.cumsum(_LETTER[buf[base:stop]] * _POW[: stop - base], out=sums[1:])
            s = starts[i:j] - base
            out[i:j] = (sums[ends[i:j] - base] - sums[s]) * _INV[s]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


_ORDER = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive word hashes (runs may cross
    from one value into the next; see ``at`` of ``words``)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += h[k : k + n] * _ORDER[k]
    return mix(out)


def held_out(doc_id: str, parts: int, remainder: int):
    """Whether crc32 of the id written as text has that remainder modulo
    ``parts``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts) == remainder, F.lit(False))


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    make: Callable[[], Callable[..., list]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Append columns made by an Arrow function to every row, without a shuffle.

    ``make()`` runs once for each task and returns a function of the input
    arrays that gives one array for each of ``fields``.  ``keep`` names the
    columns carried over (all by default); one that has a new column's name is
    replaced by it.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    # positions, so that doubtful names (dots, other cases) do no harm
    plain = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType, True) for i, c in enumerate(kept)] + [T.StructField(f"o{i}", f.dataType, True) for i, f in enumerate(fields)])
    n_kept, n_in = len(kept), len(inputs)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = None
        for batch in batches:
            if not batch.num_rows:
                continue
            apply = apply or make()
            made = apply(*[batch.column(n_kept + i) for i in range(n_in)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *made], names=names)

    out = plain.mapInArrow(tidy(run), schema)
    return out.toDF(*kept, *[f.name for f in fields])
