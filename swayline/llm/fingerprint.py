"""Document fingerprints: a threshold-scaled sketch of word shingles.

A document's shingles are its distinct runs of five words (lower-cased, split at white space; with
fewer words the whole sequence). The sketch keeps every shingle hash below a fixed fraction of the
hash range, so it grows with the document, two sketches merge by union, and the share of one sketch
inside another estimates containment however unequal the documents are. A document none of whose
hashes is below the fraction keeps its smallest one. The fingerprint is the sorted list of kept
hashes in hexadecimal.

Only DataFrame functions run. Defined results: a missing or blank text has an empty sketch; two empty
sketches are alike (1.0), an empty and another one are not (0.0); repeated rows have equal
fingerprints; other columns are carried through by the operator.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 4


def sketch(words, scale=SCALE, k=SHINGLE):
    """Kept shingle hashes of an array of words, ascending."""
    hashes = F.when(
        F.size(words) >= k,
        F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])),
    ).when(F.size(words) > 0, F.array(F.xxhash64(words)))
    hashes = F.coalesce(hashes, F.array().cast("array<long>"))
    # the signed range from its least value up: a fixed fraction of all hashes
    limit = -(1 << 63) + (1 << 64) // scale
    return hashes, lambda h: F.array_sort(F.array_distinct(F.filter(h, lambda x: x < limit)))


def words_of(text):
    """Lower-cased words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def with_sketch(docs, text, name, scale=SCALE, k=SHINGLE):
    """``docs`` with the sketch of column ``text`` in column ``name``."""
    words, hashes = f"{name}__words", f"{name}__hashes"
    made, keep = sketch(F.col(words), scale, k)
    docs = docs.withColumn(words, words_of(F.col(text))).withColumn(hashes, made).drop(words)
    kept = docs.withColumn(name, keep(F.col(hashes)))
    least = F.when((F.size(name) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(F.col(name))
    return kept.withColumn(name, least).drop(hashes)


def fingerprint(sketched):
    return F.array_join(F.transform(sketched, lambda h: F.hex(h)), ",")


def merged(left, right):
    """Sketch of two documents together."""
    return F.array_sort(F.array_union(left, right))


def containment(inner, outer):
    """Estimated share of ``inner``'s shingles that ``outer`` has."""
    return F.when(F.size(inner) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(inner, outer)) / F.size(inner))


def resemblance(left, right):
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def fingerprints(docs, text_col="text", scale=SCALE, k=SHINGLE):
    """``docs`` with columns sketch and fingerprint (they replace columns of those names)."""
    out = with_sketch(docs.withColumn("__text", F.col(text_col)), "__text", "__sketch", scale, k)
    return out.withColumn("sketch", F.col("__sketch")).withColumn("fingerprint", fingerprint(F.col("__sketch"))).drop("__text", "__sketch")


def _parted(docs, parts):
    """``docs`` with the number of its range of ids, descending; the bounds are quantiles, one for each part."""
    bounds = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    below = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b >= F.col("doc_id"))) if bounds else F.lit(0)
    return docs.withColumn("part", F.coalesce(F.when(F.col("doc_id").isNotNull(), below), F.lit(len(bounds) + 1)))


def with_following(docs, parts, scale=SCALE, k=SHINGLE):
    """(doc_id, text) with its sketch ``own``, and text and sketch of the document that follows by descending id.

    After the last document comes the first. Documents without an id come last, equal ids by text.
    A part is sorted in one task; what follows its last row is the first row of the next part.
    """
    docs = _parted(docs, parts)
    heads = docs.groupBy("part").agg(F.max("doc_id").alias("doc_id"))
    ring = W.orderBy("part")  # one row for each part
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.withColumn("before", F.coalesce(F.lag("part").over(ring), F.last("part").over(whole)))
    texts = docs.join(heads.select("before", F.col("part").alias("h_part"), F.col("doc_id").alias("h_id")), (F.col("part") == F.col("h_part")) & F.col("doc_id").eqNullSafe(F.col("h_id")))
    follows = texts.groupBy("before").agg(F.max("text").alias("head"))
    follows = with_sketch(follows, "head", "head_sketch", scale, k)
    down = W.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = with_sketch(docs.repartition(parts, "part"), "text", "own", scale, k)
    rows = rows.withColumn("below", F.lead(F.struct("text", "own")).over(down)).join(follows, F.col("part") == F.col("before"))
    inside = F.col("below").isNotNull()
    return rows.select(
        "doc_id", "text", "own", F.when(inside, F.col("below.text")).otherwise(F.col("head")).alias("next"),
        F.when(inside, F.col("below.own")).otherwise(F.col("head_sketch")).alias("next_sketch"),
    )


def with_edits(docs, parts):
    """Fingerprints of each text and of its edited text, and their likeness."""
    rows = with_following(docs, parts).withColumn("n_chars", F.char_length("text").cast("long"))
    gone = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - gone), F.substring("next", F.lit(1), gone)))
    rows = with_sketch(rows, "edited", "changed")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"), resemblance(F.col("own"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("own"), F.col("changed")).alias("kept_in_edited"),
    )


def op9_fingerprint(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return with_edits(docs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 25))
