"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams are ordered by how many words hold them, rarest first. A word's *prefix* holds its three rarest
bigrams (and others that tie with the third by being the same bigram). One edit harms at most one of two
disjoint bigrams, so of two words one edit apart, both ranked by their third bigram, the one that ranks
first keeps one of any two disjoint bigrams of its prefix, and the other word has it in its own prefix.
Dynamic programming over the prefix picks the two disjoint bigrams that fewest words hold, the *pivots*.

Positions limit what a pivot meets: the edit lies on one side of a bigram that it leaves alone, so either
everything up to its end or everything from its start on is equal in both words, lengths differ by at most
one, and of the rest the first or the last half is equal. Pivots are joined with prefixes on a hash of these
parts and the length; pairs are verified by their edit distance inside the join. A word of m letters has at
most (2 m + 1) near words for each letter there is, so results stay in proportion to the words.

Words are counted by a map-side combined aggregate over whole texts. There are at most 90 letters (26 lower
and 64 from U+00C0 on), so at most 8,100 bigrams whose counts go to the tasks. Joins are sort-merge joins
that adaptive execution splits where a key is hot. A word's form has at least ``ratio`` times its count,
so chains of forms have at most log(count) steps and are followed by doubling.

Defined results: a missing or empty text has no words; a missing id is empty in the typing errors' key;
repeated rows count again; ties of a form go to the first word in code-point order; no words give no rows;
other columns do not take part.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swayline.llm import rolling
from swayline.llm.common import written

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FAR = 1 << 60


def runs(docs, least_length=LEAST_LENGTH, id_col="doc_id", text_col="text"):
    """(id, word): maximal runs of at least ``least_length`` letters, A-Z in lower case."""
    found = F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("word")).select("id", F.translate("word", UPPER, LOWERED).alias("word"))


def mistyped(found):
    """``runs`` with a code point left out where 31 divides crc32 of ``<id>:<word>``."""
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word")
    rows = found.withColumn("h", F.crc32(key))
    at = (F.col("h") % F.char_length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return rows.select("id", F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("word")).alias("word"))


def counted(found, least_length=LEAST_LENGTH, least_count=LEAST_COUNT):
    return found.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def gram_order(words):
    """(number of words that hold it, place in the order by it and by code) of each two letters, by their codes."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2)))
    counts = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    held = np.zeros(1 << 16, np.int64)
    for r in counts:
        a, b = r.gram.encode("latin-1")
        held[a << 8 | b] = r.n
    place = np.empty(1 << 16, np.int64)
    place[np.lexsort((np.arange(1 << 16), held))] = np.arange(1 << 16)
    return held, place


def pivots_of(grams, held, place):
    """For words of one length, as rows of bigrams: (place of the third, whether in the prefix, two pivots)."""
    order = place[grams]
    third = np.partition(order, 2, axis=1)[:, 2]
    prefix = order <= third[:, None]
    cost = np.where(prefix, held[grams], FAR)
    # least cost of one bigram up to each place, and where; then of a second one that does not touch it
    one = np.minimum.accumulate(cost, axis=1)
    where = np.maximum.accumulate(np.where(cost == one, np.arange(cost.shape[1]), 0), axis=1)
    second = np.argmin(cost[:, 2:] + one[:, :-2], axis=1) + 2
    return third, prefix, np.stack([where[np.arange(len(cost)), second - 2], second], 1)


def key_rows(letters, held, place, probing):
    """(row, key) of words of one length, given as rows of letters: what they are looked up by, or look up if ``probing``.

    A key hashes a bigram's position, the part that is equal with it (up to its end if the edit lies behind,
    else from its start on), the length of the word looked up, and one end of the rest: an edit in the rest
    leaves its first or its last half alone, less one letter as lengths may differ by one.
    """
    m, length = letters.shape
    sums = np.zeros((m, length + 1), np.uint64)
    for i in range(length):
        sums[:, i + 1] = sums[:, i] * rolling.BASE + letters[:, i].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(length, rolling.BASE))), dtype=np.uint64)

    def span(rows, a, b):
        return sums[rows, b] - sums[rows, a] * powers[b - a]

    _, prefix, pivots = pivots_of(letters[:, :-1] << 8 | letters[:, 1:], held, place)
    if probing:
        wanted = np.zeros_like(prefix)
        np.put_along_axis(wanted, pivots, True, axis=1)
    else:
        wanted = prefix
    out = []
    for at in np.flatnonzero(wanted.any(0)).tolist():
        rows = np.flatnonzero(wanted[:, at])
        for other in (length - 1, length, length + 1) if probing else (length,):
            # behind the bigram, then before it: bounds of the rest and of the equal part, distance that names the bigram
            for side, (lo, hi, a, b, rest, name) in enumerate(((at + 2, length, 0, at + 2, other - at - 2, at), (0, at, at, length, other - length + at, length - at))):
                if rest < 0:
                    continue
                half = max(0, (rest - 1) // 2)
                equal = rolling.mix(span(rows, a, b) + np.uint64(((name * 64 + other) * 2 + side) * 2))
                out.append((rows, rolling.mix(equal + span(rows, lo, lo + half))))
                if half:
                    out.append((rows, rolling.mix(equal + np.uint64(1) + span(rows, hi - half, hi))))
    return (np.concatenate(x) for x in zip(*out))


def keyed(words, held, place, probing):
    """(key, word, info): info holds the word's count and, in its low 16 bits, the place of its third bigram."""

    def scan(batches):
        for batch in batches:
            word = batch.column(0)
            texts = word.to_pylist()
            letters = np.frombuffer("".join(texts).encode("latin-1"), np.uint8).astype(np.int64)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            start, count = np.cumsum(size) - size, batch.column(1).to_numpy()
            for length in np.unique(size).tolist():
                mine = np.flatnonzero(size == length)
                for some in np.array_split(mine, -(-len(mine) // 2048)):
                    table = letters[start[some, None] + np.arange(length)]
                    third = pivots_of(table[:, :-1] << 8 | table[:, 1:], held, place)[0]
                    rows, keys = key_rows(table, held, place, probing)
                    info = (count[some] << 16 | third)[rows]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), word.take(pa.array(some[rows])), pa.array(info)], ["key", "word", "info"])

    return words.select("word", "n").mapInArrow(scan, "key long, word string, info long")


def near_pairs(words):
    """(a, b, a_n, b_n): words one edit apart, each pair once with a < b in code-point order."""
    if words.isEmpty():
        return words.select(F.col("word").alias("a"), F.col("word").alias("b"), F.col("n").alias("a_n"), F.col("n").alias("b_n"))
    order = gram_order(words)
    index = keyed(words, *order, probing=False)
    probes = keyed(words, *order, probing=True).toDF("p_key", "p_word", "p_info")

    def third(info):
        return F.col(info).bitwiseAND(F.lit(0xFFFF))

    near = (third("p_info") <= third("info")) & (F.col("p_word") != F.col("word")) & (F.levenshtein("p_word", "word", 1) == 1)
    found = probes.join(index, (F.col("p_key") == F.col("key")) & near)
    first = F.col("p_word") < F.col("word")
    n, p_n = F.shiftright("info", 16), F.shiftright("p_info", 16)
    pairs = found.select(
        F.least("p_word", "word").alias("a"), F.greatest("p_word", "word").alias("b"),
        F.when(first, p_n).otherwise(n).alias("a_n"), F.when(first, n).otherwise(p_n).alias("b_n"),
    )
    return pairs.groupBy("a", "b").agg(F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"))


def roots_of(forms):
    """(word, root) from (word, form): the last word of each chain, by doubling the steps that one row takes."""
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps.select(F.col("word").alias("via"), F.col("root").alias("further"))
        if steps.join(onward, F.col("root") == F.col("via"), "left_semi").isEmpty():
            return steps
        joined = steps.join(onward, F.col("root") == F.col("via"), "left")
        steps = written(joined.select("word", F.coalesce("further", "root").alias("root")), "forms")


def variants(words, ratio=RATIO):
    """One row per (word, n): word, form, root, n, n_near, form_n."""
    pairs = near_pairs(words)
    sides = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                                           F.struct(F.col("b").alias("w"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("side")).select("side.*")
    best = sides.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best"))
    told = words.join(best, F.col("word") == F.col("w"), "left")
    takes = -F.col("best.less") >= ratio * F.col("n")
    told = told.select(
        "word", F.when(takes, F.col("best.word")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, -F.col("best.less")).alias("form_n"),
    )
    told = written(told, "variants")
    roots = roots_of(told.where("form IS NOT NULL")).withColumnRenamed("word", "r_word")
    out = told.join(roots, F.col("word") == F.col("r_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, ratio=RATIO, id_col="doc_id", text_col="text", change=None):
    """``variants`` of the words of ``docs``; ``change`` maps the (id, word) rows before they are counted.

    A prefix of three bigrams needs words of four code points at least.
    """
    if least_length < 4:
        raise ValueError("words need four code points at least")
    found = runs(docs, least_length, id_col, text_col)
    words = counted(change(found) if change else found, least_length, least_count)
    return variants(written(words, "words"), ratio)


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), change=mistyped)


SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
found AS (
  SELECT doc_id, translate(run, '{UPPER}', '{LOWERED}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[{LETTERS}]+')) AS run FROM documents) GROUP BY ALL),
keys AS (
  SELECT run, n, h FROM (
    SELECT run, n, xor(list_reduce(flatten(list_transform(range(1, length(key) + 1), lambda i: CASE WHEN unicode(substr(key, i, 1)) < 128 THEN [unicode(substr(key, i, 1))::BIGINT]
             ELSE [192 + unicode(substr(key, i, 1)) // 64, 128 + unicode(substr(key, i, 1)) % 64] END)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM found), crc)),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM keys)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cuts b ON a.word = b.rest
  UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cuts b ON a.word = b.rest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
told AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND place = 1),
chain AS (SELECT word, word AS root FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.root WHERE t.form IS NOT NULL)
SELECT t.word, t.form, c.root, t.n, t.n_near, t.form_n
FROM told t JOIN chain c ON c.word = t.word JOIN told last ON last.word = c.root WHERE last.form IS NULL
"""
