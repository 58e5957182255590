"""Helpers that the training-data operators share."""

import gc
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from swayline.scratch import materialise

#: Text bytes that one block or bucket of a shuffled numpy step holds, on average.
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 48


def written(df, label):
    """``df`` written to the shared folder and read back; its shuffle files can then be dropped.

    Spark drops shuffle files when the driver collects the garbage that refers to them, which it
    seldom does by itself; without the hint several steps' shuffles add up on the executors' disks.
    The last job is still referred to, so a small one comes between.
    """
    jvm = df.sparkSession.sparkContext._jvm
    out = materialise(df, label)
    del df  # the last reference, where the caller keeps none
    out.isEmpty()
    gc.collect()
    jvm.System.gc()
    return out


def block_count(docs, text_col="text"):
    """Number of blocks, so that a block's text stays about ``BLOCK_BYTES`` at every size of input."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES)) | 1
    while any(n % d == 0 for d in range(3, int(n**0.5) + 1, 2)):  # ids with a common factor spread over a prime number
        n += 2
    return n, size


def block_of(id_col, n):
    """A document's block; numpy code has the same from ``ids % n``."""
    return F.pmod(F.col(id_col), F.lit(n)).cast("int")


def fold(id_col, n):
    """Remainder of crc32 of the id's decimal text."""
    return F.crc32(F.col(id_col).cast("string")) % n


def sha256(data):
    return hashlib.sha256(data).hexdigest()


def utf8(array):
    """(bytes, starts, ends) of a string column; a missing text is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32) if len(array) else np.zeros(1, np.int64)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    body = array.buffers()[2] if len(array) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets[:-1], offsets[1:]


def chunks(starts, ends, limit):
    """Ranges ``[i, j)`` of neighbouring documents of at most ``limit`` bytes together (or one document)."""
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + limit, "right"))
        j = max(j, i + 1)
        yield i, j
        i = j


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data, starts, ends):
    """Starts, ends and document numbers of the words in ``data``; words never cross documents.

    ``starts`` and ``ends`` are the documents' bounds in ``data``; they lie side by side.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~WHITE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    cut[ends] = True
    first = np.flatnonzero(inside & (~before | cut))
    last = np.flatnonzero(before & (~inside | cut))
    doc = np.searchsorted(starts, first, "right") - 1
    return first, last, doc


def rows_of(rows, schema):
    """An Arrow batch from tuples."""
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def pack(*arrays):
    """Arrays of numbers as one binary value: lengths in front, then the bytes."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob, *types):
    sizes = np.frombuffer(blob, np.int64, len(types), 8)
    out, at = [], 8 * (1 + len(types))
    for size, kind in zip(sizes, types):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def unpack_all(blobs, *types):
    """The same arrays of several blobs, joined; and the number of the blob that each entry is from."""
    parts = [unpack(b, *types) for b in blobs]
    if not parts:
        return [np.zeros(0, t) for t in types], np.zeros(0, np.int64)
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return [np.concatenate([p[i] for p in parts]) for i in range(len(types))], source


def pack_ids(ids):
    """Ascending ids as the first one and the steps between them, in as few bytes as the steps allow."""
    steps = np.diff(ids).astype(np.uint64)
    most = int(steps.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    head = np.array([len(ids), np.dtype(kind).itemsize, *ids[:1]], np.int64)
    return head.tobytes() + steps.astype(kind).tobytes()


def unpack_ids(blob):
    n, size = np.frombuffer(blob, np.int64, 2)
    if not n:
        return np.zeros(0, np.int64)
    steps = np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[int(size)], int(n) - 1, 24)
    return np.cumsum(np.concatenate((np.frombuffer(blob, np.int64, 1, 16), steps.astype(np.int64))))


def narrow(keys):
    """48-bit values as six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def widen(six):
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, :6] = six.reshape(-1, 6)
    return out.view("<u8").ravel()


def split_by(part, n):
    """Order that sorts entries by ``part`` and the bounds of each part, for those that have entries."""
    order = np.argsort(part, kind="stable")
    counts = np.bincount(part, minlength=n)
    ends = np.cumsum(counts)
    for p in np.flatnonzero(counts):
        yield int(p), order[ends[p] - counts[p] : ends[p]]
