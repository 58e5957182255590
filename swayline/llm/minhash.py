"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds its distinct word shingles (ASCII lower case, words parted by ASCII white
space; with fewer words the whole sequence is one). The sketch has ``bands * rows`` coordinates: in
round ``i`` every shingle is thrown into a hashed bin with a value in [i, i + 1), each bin keeps its
smallest value, and rounds go on until every bin is filled; from round ``bins`` on a round fills one
given bin, so every coordinate is filled for every set. Large sets need one or two rounds. Two sets
agree in a coordinate with a chance equal to their Jaccard similarity, with the concentration of
independent samples.

Equal sets are one node of the graph (with the smallest document as its member); texts of a bucket
(equal ``rows`` coordinates of one band) are candidates. All links are confirmed on the full sets:

1. every node is compared with the leader it shares most bands with; links make components;
2. in buckets that still hold several components, pairs across components whose sketches do not rule
   the threshold out (five standard errors) are compared where the bucket is, best first; a pair whose
   components a link has joined by then is not compared, as it cannot change the result. Large buckets
   are dealt as pairs of blocks. A task returns a spanning forest of the components that it has joined,
   so fewer rows than it has nodes, however many pairs are linked.

At a similarity of 0.8 a pair shares no band with a chance of (1 - 0.8**5)**40, about 1e-7.

Defined results: an empty or missing text has the empty set and is linked with nothing; a missing id
takes part in nothing, keeps its row, and has no component; repeated rows of an id are equal; other
columns do not take part.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from swayline.llm import rolling
from swayline.llm.common import LOWER, chunks, narrow, utf8, widen, word_bounds, written
from swayline.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
#: Nodes of a block of a large bucket.
BLOCK = 1000
#: Candidate pairs that are compared at first before what they join is left out; each step has twice as many.
FIRST_PAIRS = 256
CHUNK = 1 << 20
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts, k):
    """Distinct shingle hashes of a batch: (document numbers, hashes), sorted by both."""
    data, starts, ends = utf8(texts)
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in chunks(starts, ends, CHUNK):
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = LOWER[data[lo:hi]]
        first, last, doc = word_bounds(part, starts[i:j] - lo, ends[i:j] - lo)
        if not len(first):
            continue
        words = rolling.span_hashes(rolling.prefix(part), first, last)
        sums = rolling.prefix(words)
        count = np.bincount(doc, minlength=j - i)
        begin = np.cumsum(count) - count
        grams = rolling.gram_hashes(sums, k)
        inside = np.flatnonzero(doc[: len(grams)] == doc[k - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
        few = np.flatnonzero((count > 0) & (count < k))
        d = np.concatenate((doc[inside], few))
        h = np.concatenate((grams[inside], rolling.span_hashes(sums, begin[few], begin[few] + count[few])))
        order = np.lexsort((h, d))
        d, h = d[order], h[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
        docs.append(d[new] + i)
        hashes.append(h[new])
    return np.concatenate(docs), np.concatenate(hashes)


def fast_sketch(docs, hashes, n, bins):
    """Sketch of each of ``n`` sets, (n, bins) of uint64; an empty set has ``EMPTY`` in all bins."""
    out = np.full(n * bins, EMPTY, np.uint64)
    live = np.unique(docs)
    d, h = docs, hashes
    for i in range(2 * bins):
        if not len(live):
            break
        value = rolling.mix(h + np.uint64((i * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        bin_ = (value % np.uint64(bins)).astype(np.int64) if i < bins else np.full(len(d), i - bins)
        key = (np.uint64(i) << np.uint64(52)) | (rolling.mix(value) >> np.uint64(12))
        np.minimum.at(out, d * bins + bin_, key)
        if i & (i - 1) == 0 or i % 16 == 0 or i >= bins:
            open_ = (out.reshape(n, bins)[live] == EMPTY).any(1)
            if not open_.all():
                live = live[open_]
                keep = np.zeros(n, bool)
                keep[live] = True
                keep = keep[d]
                d, h = d[keep], h[keep]
    return out.reshape(n, bins)


def _sketched(ids, texts, k, bands, rows):
    docs, hashes = shingle_sets(texts, k)
    n = len(ids)
    size = np.bincount(docs, minlength=n)
    node = np.zeros(n, np.uint64)
    np.add.at(node, docs, rolling.mix(hashes))
    node = rolling.mix(node + size.astype(np.uint64)).view(np.int64)
    named = np.flatnonzero((size > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
    alone = np.zeros(n, bool)  # one document with an id of each set of the batch has the sketch
    alone[named[np.unique(node[named], return_index=True)[1]]] = True
    number = np.cumsum(alone) - 1
    mine = alone[docs]
    sketch = np.zeros((0, bands * rows), np.uint64)
    if alone.any():
        parts, d, h = [], number[docs[mine]], hashes[mine]
        for lo in range(0, int(alone.sum()), 512):
            a, b = np.searchsorted(d, [lo, lo + 512])
            parts.append(fast_sketch(d[a:b] - lo, h[a:b], min(512, int(alone.sum()) - lo), bands * rows))
        sketch = np.concatenate(parts)
    keys = np.zeros((len(sketch), bands), np.uint64)
    for r in range(rows):
        keys = rolling.mix(keys + sketch[:, r::rows])
    keys = rolling.mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
    signs = (rolling.mix(sketch) >> np.uint64(56)).astype(np.uint8)
    return size, node, alone, number, keys, signs


SKETCHED = "id long, n_shingles long, node long, bands array<long>, sign binary"


def sketches(docs, k=SHINGLE, bands=BANDS, rows=ROWS):
    """(id, n_shingles, node, bands, sign): node stands for the set; one row of a set and batch has the sketch."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            size, node, alone, number, keys, signs = _sketched(ids, batch.column(1), k, bands, rows)
            offsets = np.concatenate(([0], np.cumsum(np.where(alone, bands, 0)))).astype(np.int32)
            band = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()), mask=pa.array(~alone))
            sign = pa.array([signs[i].tobytes() if a else None for i, a in zip(number.tolist(), alone.tolist())], pa.binary())
            some = size > 0
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(size.astype(np.int64)), pa.array(node, mask=~some), band, sign], ["id", "n_shingles", "node", "bands", "sign"],
            )

    return docs.select("id", "text").mapInArrow(scan, SKETCHED)


def _verified(pairs, texts, k, percent):
    """Pairs (a, b) whose full sets reach the threshold."""

    def scan(batches):
        for batch in batches:
            n = batch.num_rows
            sets = [shingle_sets(batch.column(c), k) for c in (2, 3)]
            keys = [rolling.mix(h + d.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) for d, h in sets]
            both = np.bincount(sets[0][0][np.isin(keys[0], keys[1])], minlength=n)
            union = sum(np.bincount(d, minlength=n) for d, _ in sets) - both
            linked = pa.array((100 * both >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(linked), batch.column(1).filter(linked)], ["a", "b"])

    left = texts.select(F.col("node").alias("a_node"), F.col("text").alias("a_text"))
    right = texts.select(F.col("node").alias("b_node"), F.col("text").alias("b_text"))
    joined = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node"))
    return joined.select("a", "b", "a_text", "b_text").mapInArrow(scan, "a long, b long")


def _across(nodes, roots, signs, sizes, bands, blocks, key, least, threshold):
    """Pairs (i, j) across components that agree in at least ``least`` coordinates, the best first; the rows are sorted by root.

    A pair comes from the first of the bands that it shares only; sets whose sizes alone rule the
    threshold out are not paired. ``blocks`` are given where two blocks meet: then a pair has one of each.
    """
    out = [(np.zeros(0, np.int64),) * 3]
    ends = np.flatnonzero(np.append(roots[1:] != roots[:-1], True)) + 1
    begin = 0
    for end in ends[:-1]:
        for lo in range(begin, end, 64):
            rows = slice(lo, min(lo + 64, end))
            same = (signs[rows, None, :] == signs[None, end:, :]).sum(2, dtype=np.int32)
            near = np.minimum(sizes[rows, None], sizes[None, end:]) >= threshold * np.maximum(sizes[rows, None], sizes[None, end:]) - 1e-9
            if blocks is not None:
                near &= blocks[rows, None] != blocks[None, end:]
            i, j = np.nonzero((same >= least) & near)
            if len(i):
                same = same[i, j]
                i, j = i + lo, j + end
                first = np.argmax(bands[i] == bands[j], 1)
                mine = bands[i, first] == key
                out.append((i[mine], j[mine], same[mine]))
        begin = end
    i, j, same = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((nodes[j], nodes[i], -same))
    return i[order], j[order]


def _reaching(sets, ends, i, j, percent):
    """Which of the pairs of full sets reach the threshold; ``sets`` holds all sets' hashes, ``ends`` where each one ends."""
    out, size = np.zeros(len(i), bool), np.diff(ends, prepend=0)
    total = np.cumsum(size[i] + size[j])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + CHUNK, "right")))
        keys = []
        for side in (i[lo:hi], j[lo:hi]):
            n = size[side]
            pair = np.repeat(np.arange(len(side), dtype=np.uint64), n)
            at = np.arange(n.sum()) + np.repeat(ends[side] - np.cumsum(n), n)
            keys.append(rolling.mix(sets[at] + pair * np.uint64(0xC2B2AE3D27D4EB4F)))
        both = np.isin(*keys)
        both = np.bincount(np.repeat(np.arange(hi - lo), size[i[lo:hi]])[both], minlength=hi - lo)
        out[lo:hi] = 100 * both >= percent * (size[i[lo:hi]] + size[j[lo:hi]] - both)
        lo = hi
    return out


def _joined(group, sets, ends, i, j, percent):
    """Smallest group that each group is joined with by links among the pairs (i, j), which are in the order of their use."""
    root, at, step = np.arange(int(group.max(initial=-1)) + 1), 0, FIRST_PAIRS
    while at < len(i):
        a, b = i[at : at + step], j[at : at + step]
        at, step = at + step, 2 * step
        apart = root[group[a]] != root[group[b]]
        a, b = a[apart], b[apart]
        linked = _reaching(sets, ends, a, b, percent)
        a, b = group[a[linked]], group[b[linked]]
        while (apart := root[a] != root[b]).any():
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
            while (root != root[root]).any():
                root = root[root]
    return root


def _cross_links(buckets, roots, sketched, texts, k, bins, threshold, percent):
    """(a, b): roots of components that links inside one bucket join."""
    # five standard errors below the threshold
    least = int(np.floor(bins * (threshold - 5 * np.sqrt(threshold * (1 - threshold) / bins))))
    rooted = buckets.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    mixed = mixed.select(F.col("key").alias("m_key"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = written(rooted.join(mixed, F.col("key") == F.col("m_key")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "mixed")
    own = F.struct("n_shingles", "bands", "sign")
    sign = sketched.where("sign is not null").groupBy("node").agg(F.min(own).alias("own")).withColumnRenamed("node", "s_node")
    needed = rows.select(F.col("node").alias("needed")).distinct()
    sets = texts.join(needed, F.col("node") == F.col("needed")).select("node", "text")

    def shingled(batches):
        for batch in batches:
            docs, hashes = shingle_sets(batch.column(1), k)
            cut = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            packed = [narrow(np.sort(hashes[a:b] >> np.uint64(16))).tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["t_node", "shingles"])

    sets = sets.mapInArrow(shingled, "t_node long, shingles binary").join(sign, F.col("t_node") == F.col("s_node"))
    sets = written(sets.select("t_node", "own", "shingles"), "sets")
    # a row goes to the block pairs (own, x) and (x, own) with the smaller number first
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), F.col("own").alias("block"), "node", "root")
    rows = rows.join(sets, F.col("node") == F.col("t_node")).select("key", "p", "q", "block", "node", "root", "own.*", "shingles")

    def compare(table):
        table = table.take(pc.sort_indices(table, [("root", "ascending"), ("node", "ascending")])).combine_chunks()
        node, root, size = (table.column(c).to_numpy() for c in ("node", "root", "n_shingles"))
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        key, p, q = (table.column(c)[0].as_py() for c in ("key", "p", "q"))
        blocks = table.column("block").to_numpy() if p != q else None
        i, j = _across(node, root, signs, size, bands, blocks, key, least, threshold)
        names, group = np.unique(root, return_inverse=True)
        own = table.column("shingles").to_pylist() if len(i) else []
        ends = np.cumsum([len(x) // 6 for x in own])
        joined = _joined(group, widen(np.frombuffer(b"".join(own), np.uint8)), ends, i, j, percent)
        moved = np.flatnonzero(joined != np.arange(len(names)))
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[joined[moved]], pa.int64())})

    return rows.groupBy("key", "p", "q").applyInArrow(compare, "a long, b long")


def near_duplicates(docs, threshold=THRESHOLD, k=SHINGLE, bands=BANDS, rows=ROWS, id_col="doc_id", text_col="text"):
    """One row per document: id, n_shingles, component_id (smallest id reachable by links), kept."""
    percent = round(100 * threshold)
    both = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = written(sketches(both, k, bands, rows), "sketches")
    owned = sketched.where("id is not null")
    members = owned.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    buckets = owned.where("bands is not null").select(F.explode("bands").alias("key"), "node").distinct()
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "l_key")
    buckets = written(buckets.join(leaders, F.col("key") == F.col("l_key")).select("key", "node", "leader"), "buckets")
    shared = buckets.where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared.groupBy("node").agg(F.max(F.struct("n", F.col("leader").alias("a"))).alias("best")).select(F.col("best.a").alias("a"), F.col("node").alias("b"))
    needed = buckets.select("node").distinct().join(members, "node").select(F.col("id").alias("n_id"), "node")
    pairs = written(pairs, "pairs")
    texts = both.join(needed, F.col("id") == F.col("n_id")).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "texts")
    roots = components(_verified(pairs, texts, k, percent))
    across = written(_cross_links(buckets.select("key", "node"), roots, sketched, texts, k, bands * rows, threshold, percent), "across")
    if not across.isEmpty():
        roots = components(across.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    grouped = members.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    found = grouped.select("node", "root").join(least, "root").select(F.col("node").alias("g_node"), "component_id")
    out = sketched.select("id", "n_shingles", "node").join(found, F.col("node") == F.col("g_node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_minhash(spark, sf_dir):
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4)
    return out.withColumnRenamed("id", "doc_id")
