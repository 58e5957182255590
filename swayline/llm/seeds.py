"""Shared windows of documents, found from winnowed seeds in two shuffles.

A *window* is ``window`` consecutive symbols (bytes or words) of one document. Its *seed* is the
smallest hashed gram in it, so equal windows have equal seeds. Windows are compared only when their
seed stands in at least two documents:

1. every scan batch sends each distinct seed once, with its smallest document, to the seed's bucket
   (a seed that a third of the documents hold costs one entry per batch); the bucket tells the
   document blocks which seeds repeat;
2. each block of documents sends the surroundings of its repeated seeds to the buckets, equal
   surroundings of one seed once; a bucket's *judge* finds the repeats and answers with spans.

Seeds with more occurrences than ``hot`` are replaced by their single windows, which are dealt by
their own hashes, so no bucket grows with one seed.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from swayline.llm import rolling
from swayline.llm.common import (
    block_count, block_of, chunks, narrow, pack, pack_ids, rows_of, split_by, unpack, unpack_all, unpack_ids, utf8, widen,
    word_bounds, written,
)

#: A seed is hot from this many occurrences, or a millionth of all, whichever is more.
HOT_LEAST = 512
HOT_MOST = 1_000_000
CHUNK = 1 << 20
PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
SEED = np.uint64((1 << 48) - 1)
BODY = {True: np.uint64, False: np.uint8}
SENT = pa.schema([("kind", pa.string()), ("place", pa.int32()), ("body", pa.binary())])
SENT_DDL = "kind string, place int, body binary"


@dataclass(frozen=True)
class Shape:
    """What a symbol is, the length of a window and of a gram, in symbols."""

    words: bool
    window: int
    gram: int


def symbol_chunks(data, starts, ends, shape):
    """Per chunk of documents: (symbols, document of each, symbol number in its document, byte bounds or None).

    Documents over a chunk are cut into overlapping chunks, so each window lies in exactly one.
    """
    for i, j in chunks(starts, ends, CHUNK):
        lo, hi = int(starts[i]), int(ends[j - 1])
        if shape.words:
            first, last, doc = word_bounds(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
            symbols = rolling.span_hashes(rolling.prefix(data[lo:hi]), first, last)
            count = np.bincount(doc, minlength=j - i)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        else:
            symbols = data[lo:hi]
            size = ends[i:j] - starts[i:j]
            doc = np.repeat(np.arange(j - i), size)
            at = np.arange(hi - lo) - np.repeat(starts[i:j] - lo, size)
        left = np.bincount(doc, minlength=j - i)[doc] - at
        doc = doc + i
        for cut in range(0, max(1, len(symbols) - shape.window + 1), 4 * CHUNK):
            part = slice(cut, cut + 4 * CHUNK + shape.window - 1)
            yield symbols[part], doc[part], at[part], left[part]


def occurrences(symbols, doc, at, left, shape):
    """Seeds of a chunk: (prefix sums, first window, windows, seed hash), positions in the chunk."""
    sums = rolling.prefix(symbols)
    grams = rolling.gram_hashes(sums, shape.gram)
    owner = rolling.owners(grams, shape.window - shape.gram + 1)
    valid = left[: len(owner)] >= shape.window
    # a window of the next document must not continue a run
    first, n, own = rolling.runs(owner + (doc[: len(owner)].astype(np.int64) << 32), valid)
    return sums, first, n, grams[own & 0xFFFFFFFF]


def _first_of(sorted_keys):
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def _marks(seed, doc_id):
    """One number for a pair of a seed and a document that holds it."""
    return rolling.mix(seed ^ (doc_id.astype(np.uint64) * PAIR))


def _batch_seeds(ids, texts, shape):
    """All (seed, id) of a batch and what is needed to send its windows on."""
    data, starts, ends = utf8(texts)
    for symbols, doc, at, left in symbol_chunks(data, starts, ends, shape):
        sums, first, n, seed = occurrences(symbols, doc, at, left, shape)
        yield symbols, sums, first, n, seed & SEED, ids[doc[first]], at[first]


def _scan(ids, texts, shape, n_blocks):
    parts = [(seed, own) for _, _, _, _, seed, own, _ in _batch_seeds(ids, texts, shape)]
    if not parts:
        return
    seed, own = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((own, seed))
    seed, own = seed[order], own[order]
    first = _first_of(seed)
    count = np.diff(np.append(first, len(seed)))
    several = own[first] != own[first + count - 1]
    known = np.repeat(several, count)
    for block, rows in split_by(own[known] % n_blocks, n_blocks):
        yield "known", block, np.unique(_marks(seed[known][rows], own[known][rows])).tobytes()
    key, least = seed[first], own[first]
    for bucket, rows in split_by((key % np.uint64(n_blocks)).astype(np.int64), n_blocks):
        rows = rows[np.argsort(least[rows], kind="stable")]
        more = np.flatnonzero(count[rows] > 1)
        body = [narrow(key[rows]), np.frombuffer(pack_ids(least[rows]), np.uint8), more.astype(np.int32), count[rows][more].astype(np.int32), several[rows][more]]
        yield "seed", bucket, pack(*body)


def _meet(kinds, places, bodies, n_blocks, hot):
    """One bucket: marks of the entries whose seed another document has too."""
    keys, docs, counts, flags = [], [], [], []
    for body in (b for k, b in zip(kinds, bodies) if k == "seed"):
        six, ids, more, count, several = unpack(body, np.uint8, np.uint8, np.int32, np.int32, bool)
        keys.append(widen(six))
        docs.append(unpack_ids(ids.tobytes()))
        counts.append(np.ones(len(keys[-1]), np.int64))
        counts[-1][more] = count
        flags.append(np.zeros(len(keys[-1]), bool))
        flags[-1][more] = several
    yield from ((k, p, b) for k, p, b in zip(kinds, places, bodies) if k == "known")
    if not keys:
        return
    key, doc, count, flag = (np.concatenate(x) for x in (keys, docs, counts, flags))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = _first_of(key)
    size = np.diff(np.append(first, len(key)))
    repeats = (doc[first] != doc[first + size - 1]) | np.logical_or.reduceat(flag[order], first)
    total = np.add.reduceat(count[order], first)
    if (total >= hot).any():
        yield "hot", 0, key[first][total >= hot].tobytes()
    keep = np.repeat(repeats, size)
    key, doc = key[keep], doc[keep]
    for block, rows in split_by(doc % n_blocks, n_blocks):
        yield "known", block, _marks(key[rows], doc[rows]).tobytes()


def repeated_seeds(docs, shape, n_blocks, hot):
    """Rows (kind, place, body): ``known`` for a block: marks of its seeds that repeat; ``hot``: frequent seeds."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield rows_of(_scan(ids, batch.column(1), shape, n_blocks), SENT)

    def bucket(table):
        sent = (table.column(c).to_pylist() for c in ("kind", "place", "body"))
        return pa.Table.from_batches([rows_of(_meet(*sent, n_blocks, hot), SENT)])

    sent = docs.select("id", "text").mapInArrow(scan, SENT_DDL)
    return sent.groupBy("place").applyInArrow(bucket, SENT_DDL)


def _send(ids, texts, marks, hot, shape, n_blocks, payloads, local):
    """Surroundings of a block's repeated seeds; those equal to a smaller document's of the block are spans at once."""
    keys, docs, at, counts, bodies = [], [], [], [], []
    for symbols, sums, first, n, seed, own, start in _batch_seeds(ids, texts, shape):
        mine = np.flatnonzero(np.isin(_marks(seed, own), marks))
        first, n, seed, own, start = first[mine], n[mine], seed[mine], own[mine], start[mine]
        big = np.isin(seed, hot)
        if big.any():  # windows of hot seeds travel alone, by their own hash
            size = np.where(big, n, 1)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            alone = np.repeat(big, size)
            first, start, own = np.repeat(first, size) + step, np.repeat(start, size) + step, np.repeat(own, size)
            n = np.where(alone, 1, np.repeat(n, size))
            seed = np.where(alone, rolling.span_hashes(sums, first, first + shape.window) & SEED, np.repeat(seed, size))
        keys.append(seed)
        docs.append(own)
        at.append(start)
        counts.append(n)
        bodies.append(payloads(symbols, sums, first, n, shape))
    if not keys:
        return
    key, doc, start, n = (np.concatenate(x) for x in (keys, docs, at, counts))
    body, size, print_ = bodies[0] if len(bodies) == 1 else tuple(np.concatenate(x) for x in zip(*bodies))
    order = np.lexsort((doc, print_, key))
    same = np.zeros(len(key), bool)
    k, p, d = key[order], print_[order], doc[order]
    first = _first_of(p ^ rolling.mix(k))
    least = np.repeat(d[first], np.diff(np.append(first, len(d))))
    if local:
        same[order] = d > least
    if same.any():
        yield "span", int(doc[0] % n_blocks), spans_body(doc[same], start[same], start[same] + n[same] + shape.window - 1)
    # a second place of the smallest document with the same surroundings is sent as well: it may have smaller partners
    offset = np.cumsum(size) - size
    for bucket, rows in split_by(np.where(same, n_blocks, (key % np.uint64(n_blocks)).astype(np.int64)), n_blocks + 1):
        if bucket < n_blocks:
            rows = rows[np.argsort(doc[rows], kind="stable")]
            parts = [narrow(key[rows]), np.frombuffer(pack_ids(doc[rows]), np.uint8), start[rows].astype(np.int32), n[rows].astype(np.uint16)]
            yield "seed", bucket, pack(*parts, squeezed(take(body, offset[rows], size[rows])))


def take(body, offset, size):
    """Pieces ``[offset, offset + size)`` of ``body``, one after another."""
    return body[np.repeat(offset - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def spans_body(doc, start, end):
    return pack(doc.astype(np.int64), start.astype(np.int32), end.astype(np.int32))


def read_spans(bodies):
    return unpack_all(bodies, np.int64, np.int32, np.int32)


def _gathered(docs, shape, payloads, local=True):
    """(rows for the buckets, documents with blocks, number of blocks) of the two-shuffle search."""
    n_blocks, size = block_count(docs)
    hot = max(HOT_LEAST, size // HOT_MOST)
    docs = docs.withColumn("block", block_of("id", n_blocks))
    found = written(repeated_seeds(docs, shape, n_blocks, hot), "seeds")
    # there are fewer occurrences than bytes, so at most HOT_MOST seeds can have a millionth of them
    frequent = [r[0] for r in found.where("kind = 'hot'").select("body").collect()]
    hot_seeds = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in frequent)])

    def send(left, right):
        ids = left.column("id").to_numpy()
        marks = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, np.uint64) for b in right.column("body").to_pylist())])
        rows = _send(ids, left.column("text"), marks, hot_seeds, shape, n_blocks, payloads, local) if len(ids) and len(marks) else ()
        return pa.Table.from_batches([rows_of(rows, SENT)])

    known = found.where("kind = 'known'").groupBy("place")
    sent = docs.select("block", "id", "text").groupBy("block").cogroup(known).applyInArrow(send, SENT_DDL)
    return sent, docs, n_blocks


def _entries(kinds, bodies, shape):
    """(keys, documents, first windows, numbers of windows, sizes, bodies) of a bucket."""
    parts = []
    for body in (b for k, b in zip(kinds, bodies) if k == "seed"):
        six, ids, start, n, text = unpack(body, np.uint8, np.uint8, np.int32, np.uint16, np.uint8)
        n = n.astype(np.int64)
        size = n if shape.words else n + shape.window - 1
        parts.append((widen(six), unpack_ids(ids.tobytes()), start, n, size, restored(text, BODY[shape.words])))
    return [np.concatenate(x) for x in zip(*parts)]


def squeezed(body):
    """Bytes of an array, compressed where that helps (texts; not hashes)."""
    if body.dtype != np.uint8:
        return body.view(np.uint8)
    return np.frombuffer(zstandard.ZstdCompressor(level=3).compress(body.tobytes()), np.uint8)


def restored(body, kind):
    if kind != np.uint8:
        return np.frombuffer(body.tobytes(), kind)
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body.tobytes()), np.uint8)


def repeat_spans(docs, shape, payloads, judge):
    """Rows (kind, place, body) with the spans of symbols that repeat a smaller document's, by block.

    ``docs`` has id (long) and text. ``payloads`` packs what a bucket compares, ``judge`` compares it:
    it gets (keys, docs, starts, windows, sizes, bodies) of one bucket and returns spans.
    Also returns the documents with their block and the number of blocks.
    """
    sent, docs, n_blocks = _gathered(docs, shape, payloads)

    def bucket(table):
        kinds, places, bodies = (table.column(c).to_pylist() for c in ("kind", "place", "body"))
        out = [(k, p, b) for k, p, b in zip(kinds, places, bodies) if k == "span"]
        if entries := _entries(kinds, bodies, shape):
            doc, start, end = judge(*entries, shape)
            out += [("span", b, spans_body(doc[r], start[r], end[r])) for b, r in split_by(doc % n_blocks, n_blocks)]
        return pa.Table.from_batches([rows_of(out, SENT)])

    return written(sent.groupBy("place").applyInArrow(bucket, SENT_DDL), "spans"), docs, n_blocks


def repeat_rows(docs, shape, payloads, listed, schema, ddl):
    """What ``listed`` makes of each bucket's entries (an Arrow batch), all occurrences included."""
    sent, _, _ = _gathered(docs, shape, payloads, local=False)

    def bucket(table):
        entries = _entries(table.column("kind").to_pylist(), table.column("body").to_pylist(), shape)
        return pa.Table.from_batches([listed(*entries, shape)]) if entries else schema.empty_table()

    return sent.groupBy("place").applyInArrow(bucket, ddl)


def with_id(docs, id_col, text_col, carry=()):
    """(id, text) of the rows that have an id, and the columns ``carry`` in ``rest``."""
    return docs.where(F.col(id_col).isNotNull()).select(*_columns(id_col, text_col, carry))


def _columns(id_col, text_col, carry):
    rest = [F.struct(*carry).alias("rest")] if carry else []
    return [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *rest]


def with_missing(docs, out, work, schema, id_col, text_col, carry=()):
    """``out`` and the rows without an id, with nothing cut."""
    none = np.zeros(0, np.int64)

    def whole(batches):
        for batch in batches:
            data, first, last = utf8(batch.column(0))
            rows = [work(data[a:b].tobytes(), none, none) for a, b in zip(first.tolist(), last.tolist())]
            table = pa.Table.from_pylist(rows, schema=schema) if rows else schema.empty_table()
            for i, name in enumerate(batch.schema.names[1:]):
                table = table.add_column(i, name, batch.column(i + 1))
            yield from table.combine_chunks().to_batches()

    lost = docs.where(F.col(id_col).isNull()).select(*_columns(id_col, text_col, carry)).select("text", "id", *(["rest"] if carry else []))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in lost.schema if f.name != "text"]
    return out.unionByName(lost.mapInArrow(whole, ", ".join([*kept, _ddl(schema)])))


def _ddl(schema):
    types = {"int64": "long", "string": "string", "int32": "int"}
    return ", ".join(f"{f.name} {types.get(str(f.type), 'array<struct<start: long, end: long>>')}" for f in schema)


def merged(start, end):
    """Overlapping or touching spans of one document, joined; ascending."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))) if len(start) else np.zeros(0, np.int64)
    return start[first], reach[np.append(first[1:], len(start)) - 1] if len(start) else reach


def cut(docs, spans, work, ddl):
    """``work(id, text bytes, starts, ends, row number)`` for every document with its merged spans; rows by ``ddl``."""

    def block(left, right):
        (doc, start, end), _ = read_spans(right.column("body").to_pylist())
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
        ids = left.column("id").to_numpy()
        lo, hi = np.searchsorted(doc, ids, "left"), np.searchsorted(doc, ids, "right")
        data, first, last = utf8(left.column("text"))
        whole = data.tobytes()
        rows = [work(whole[a:b], *merged(start[x:y], end[x:y])) for a, b, x, y in zip(first.tolist(), last.tolist(), lo.tolist(), hi.tolist())]
        out = pa.Table.from_pylist(rows, schema=ddl) if rows else ddl.empty_table()
        for name in reversed([c for c in left.column_names if c not in ("block", "text")]):
            out = out.add_column(0, name, left.column(name))
        return out

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("block", "text")]
    schema = ", ".join([*kept, _ddl(ddl)])
    return docs.groupBy("block").cogroup(spans.where("kind = 'span'").groupBy("place")).applyInArrow(block, schema)
