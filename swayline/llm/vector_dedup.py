"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Vectors of a label are scaled to unit length and projected on random normal directions. For two of them
at distance ``d`` the projections differ by a normal number of spread ``d``, so they *collide* in a
direction (differ by at most the window's half width) with a known chance that falls with the distance.
Each direction's projections are sorted, a window is centred at each query, and the directions in which
a pair collides are counted. A pair is verified by its exact cosine if it reaches the count that a pair at
the threshold reaches with the target recall; ``calibrate`` takes the window that lets the fewest
unrelated pairs reach it.

Equal vectors of a label are one class with its number of ids and its smallest id. The classes of a label
are dealt into blocks of a bounded size by hash, so a label with a third of all rows becomes many tasks of
two blocks each. A task tallies each class's links and reports them with a spanning forest of what it
linked, so it returns at most one row per class it has, however many pairs are linked. The windows of
directions hold a share of a label, whatever the method's parameters, so its work grows with the square of
a label's classes (in numpy, a few nanoseconds a pair and direction); what is shuffled grows with their
number times the number of blocks.

Defined results: a missing label, a missing, empty or zero vector and one with missing or non-finite
components link with nothing, nor do vectors of different lengths; a missing id takes part in nothing,
keeps its row and has no component; rows that repeat an id with its vector are one vector, those with
another vector link on their own and share the id's component; no rows give no rows; other columns do
not take part.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swayline.llm.common import written
from swayline.llm.components import components

THRESHOLD = 0.93
#: Chance that a pair at the threshold is verified; those above it have a better one.
RECALL = 1 - 1e-7
DIRECTIONS = 48
#: Classes and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
#: Queries that are counted side by side; candidates that are verified at once.
TILE, CHECKED = 32, 4096


def _at_least(n, p):
    """Chances that n tries of chance p succeed 0, 1, ... n times at least."""
    each = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    return np.cumsum(each[::-1])[::-1]


def calibrate(threshold=THRESHOLD, directions=DIRECTIONS, recall=RECALL):
    """(half width of the window, least count): recall is met at the threshold, and fewest orthogonal vectors pass."""
    distance, best = math.sqrt(max(0.0, 2 - 2 * threshold)), None
    for z in np.arange(0.2, 4.0, 0.05):
        met = np.flatnonzero(_at_least(directions, math.erf(z / math.sqrt(2))) >= recall)
        least = int(met[-1]) if len(met) else 0
        passing = _at_least(directions, math.erf(z * distance / 2))[least]  # at a distance of sqrt(2)
        if best is None or passing < best[0]:
            best = passing, z * distance + 1e-9, max(least, 1)
    return best[1], best[2]


def unit(vectors):
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # no square over- or underflows
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def project(vectors, directions):
    """Projections, a row for each direction; equal for a direction whatever the task."""
    rng = np.random.default_rng([directions, vectors.shape[1]])
    return rng.standard_normal((directions, vectors.shape[1])) @ vectors.T


def windows(queries, others, width):
    """For each direction: ranks of ``others`` by projection, and a query's window as first rank and number of ranks."""
    kind = np.uint16 if others.shape[1] < 1 << 16 else np.uint32
    rank, first, size = np.empty(others.shape, kind), np.empty(queries.shape, kind), np.empty(queries.shape, kind)
    for k, (mine, line) in enumerate(zip(queries, others)):
        order = np.argsort(line, kind="stable")
        rank[k, order] = np.arange(len(line), dtype=kind)
        ordered = line[order]
        first[k] = np.searchsorted(ordered, mine - width, "left")
        size[k] = np.searchsorted(ordered, mine + width, "right") - first[k]
    return rank, first, size


def colliding(queries, others, width, least, same):
    """Pairs (i, j) of columns with ``least`` collisions, a tile of queries at a time; i < j where both sides are the ``same``."""
    rank, first, size = windows(queries, others, width)
    for lo in range(0, queries.shape[1], TILE):
        hi = min(lo + TILE, queries.shape[1])
        begin = lo + 1 if same else 0
        count = np.zeros((hi - lo, others.shape[1] - begin), np.uint16)
        for k in range(len(queries)):
            # ranks before the window wrap round to large numbers
            count += (rank[k, None, begin:] - first[k, lo:hi, None]) < size[k, lo:hi, None]
        i, j = np.nonzero(count >= least)
        i, j = i + lo, j + begin
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def merged(root, i, j):
    """``root`` (smallest member of each node's component) after links i - j."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def linked(left, right, weight, threshold, width, least, directions):
    """(links of each vector of left and right, by the other's weight; root of each) for two blocks; ``right`` None: one block."""
    same = right is None
    other, shift = (left, 0) if same else (right, len(left))
    queries = project(left, directions)
    lines = queries if same else project(right, directions)
    links, root = np.zeros(len(weight), np.int64), np.arange(len(weight))
    for i, j in colliding(queries, lines, width, least, same):
        near = np.concatenate([
            np.einsum("ij,ij->i", left[i[a : a + CHECKED]], other[j[a : a + CHECKED]]) >= threshold for a in range(0, len(i), CHECKED)
        ])
        i, j = i[near], j[near] + shift
        if len(i):
            links += np.bincount(i, weight[j], len(weight)).astype(np.int64) + np.bincount(j, weight[i], len(weight)).astype(np.int64)
            root = merged(root, i, j)
    return links, root


def classes(rows):
    """(label, vec, node, key, ids): one row per distinct vector of a label that may link; node is its smallest id."""
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.coalesce(sound, F.lit(False)))
    grouped = usable.groupBy("label", "vec").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("ids"))
    return grouped.select("label", "vec", "node", F.xxhash64("label", "vec").alias("key"), "ids")


LINKED = "node long, key long, other long, links long"


def class_links(found, threshold=THRESHOLD, recall=RECALL, directions=DIRECTIONS):
    """(node, key, other, links) of the classes that link: ``other`` is in the same component, ``links`` counts ids; to be summed."""
    width, least = calibrate(threshold, directions, recall)
    dim = F.size("vec")
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.first("dim")))))
    sizes = found.select("label", dim.alias("dim")).groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))
    sizes = sizes.withColumnsRenamed({"label": "s_label", "dim": "s_dim"})
    rows = found.join(sizes, (F.col("label") == F.col("s_label")) & (dim == F.col("s_dim")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key", "node"), "blocks").cast("int"))
    # a class goes to the block pairs (own, x) and (x, own) with the smaller number first
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("label", "s_dim", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "node", "key", "ids", "vec")

    def compare(table):
        table = table.combine_chunks()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        own = table.column("own").to_numpy()
        order = np.argsort(own, kind="stable")
        table, cut = table.take(pa.array(order)), int((own == p).sum())
        vectors = unit(table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(own), -1).astype(np.float64))
        node, key, ids = (table.column(c).to_numpy() for c in ("node", "key", "ids"))
        links, root = linked(vectors[:cut], None if p == q else vectors[cut:], ids, threshold, width, least, directions)
        some = links > 0
        return pa.table({"node": node[some], "key": key[some], "other": node[root[some]], "links": links[some]})

    return rows.groupBy("label", "s_dim", "p", "q").applyInArrow(compare, LINKED)


def near_vectors(embeddings, threshold=THRESHOLD, recall=RECALL, directions=DIRECTIONS, id_col="vec_id", vector_col="embedding", label_col="label"):
    """One row per vector: vec_id, n_links, component_id (smallest id reachable by links), kept."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vec"))
    found = written(classes(rows), "classes")
    links = written(class_links(found, threshold, recall, directions), "links")
    mine = rows.join(
        found.withColumnsRenamed({"label": "c_label", "vec": "c_vec"}),
        (F.xxhash64("label", "vec") == F.col("key")) & (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")), "left",
    ).select("vec_id", "node", "key", "ids")
    mine = written(mine, "members")
    # an id and the smallest one of its class are one vector
    edges = links.select(F.col("node").alias("a"), F.col("other").alias("b")).where("a <> b")
    edges = edges.unionByName(mine.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    roots = components(edges).withColumnRenamed("node", "r_id")
    sums = links.groupBy("node", "key").agg(F.sum("links").alias("links")).withColumnsRenamed({"node": "l_node", "key": "l_key"})
    out = mine.join(sums, (F.col("node") == F.col("l_node")) & (F.col("key") == F.col("l_key")), "left")
    out = out.join(roots, F.col("vec_id") == F.col("r_id"), "left")
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce(F.col("ids") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op12_vector_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.93 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))),
reach AS (SELECT DISTINCT x AS vec_id, x AS other FROM links UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x),
roots AS (SELECT vec_id, min(other) AS root FROM reach GROUP BY vec_id),
counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, e.vec_id)::BIGINT AS component_id, coalesce(root, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN counts c ON c.vec_id = e.vec_id LEFT JOIN roots r ON r.vec_id = e.vec_id
"""
