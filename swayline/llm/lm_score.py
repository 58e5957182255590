"""LM scoring: interpolated modified Kneser-Ney bigram model, counted and stored in shards.

Tokens are words (ASCII lower case, parted by ASCII white space) and one end per text; a start stands
before the first. Counting and scoring are one round trip per block of documents:

1. a block sends each of its distinct pairs (context, token) once, with its count in training
   documents, to the shard of the context; frequent contexts are spread by token over all shards;
2. a shard adds the counts up, answers with them and with the counts of counts of each context, and
   sends the numbers of distinct contexts of each token to the shard of the token, which adds these up
   and answers with them and with the token's own count;
3. a block gets its slice of the model as arrays sorted by hash, writes them to a task's own unnamed
   file, and scores its texts by binary search in the mapped file.

What all blocks need (counts of counts, totals, the few frequent contexts) is a fixed number of sums.
Tokens are known by 48-bit hashes, a pair by the hashes of both.

Defined results: a missing text is empty and has the end alone; a missing id is scored like a held-out
row; repeated rows count as often as they come; with no training row every probability is that of an
unknown token (1.0 among none, score 0); other columns do not take part.
"""

import mmap
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swayline.llm import rolling
from swayline.llm.common import (
    LOWER, block_count, block_of, chunks, fold, narrow, pack, rows_of, split_by, unpack, utf8, widen, word_bounds, written,
)

HASH = np.uint64((1 << 48) - 1)
END, START = np.uint64(1), np.uint64(2)
#: A context is spread over the shards from this share of a scan batch's tokens (so at most 2 / share of them).
FREQUENT = 0.002
CHUNK = 1 << 20
SENT = pa.schema([("kind", pa.string()), ("place", pa.int32()), ("origin", pa.int32()), ("body", pa.binary())])
SENT_DDL = "kind string, place int, origin int, body binary"


def tokens(texts):
    """(hash of each token, document of each token) of a batch, every document closed by its end."""
    data, starts, ends = utf8(texts)
    hashes, docs = [], []
    for i, j in chunks(starts, ends, CHUNK):
        lo, hi = int(starts[i]), int(ends[j - 1])
        part = LOWER[data[lo:hi]]
        first, last, doc = word_bounds(part, starts[i:j] - lo, ends[i:j] - lo)
        hashes.append(np.maximum(rolling.span_hashes(rolling.prefix(part), first, last) & HASH, np.uint64(3)))
        docs.append((doc + i).astype(np.int32))
    docs = np.concatenate([*docs, np.arange(len(starts), dtype=np.int32)])
    order = np.argsort(docs, kind="stable")  # the ends come last, so after the words of their documents
    return np.concatenate([*hashes, np.full(len(starts), END)])[order], docs[order]


def counts_body(values):
    """Counts as bytes, with the large ones beside."""
    values = np.asarray(values, np.int64)
    big = np.flatnonzero(values >= 255)
    return [np.minimum(values, 255).astype(np.uint8), big.astype(np.int32), values[big]]


def read_counts(small, big, values):
    out = small.astype(np.int64)
    out[big] = values
    return out


COUNTS = (np.uint8, np.int32, np.int64)


class Pairs:
    """Distinct (context, token) pairs of a block, sorted, with the shard of each."""

    def __init__(self, texts, trained, frequent, n):
        token, doc = tokens(texts)
        context = np.concatenate(([START], token[:-1])) if len(token) else token
        context = np.where(np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool), START, context)
        self.doc, learned = doc, trained[doc]
        self.words, word_of = np.unique(token, return_inverse=True)
        self.word_of = word_of.astype(np.int32)
        del token, word_of
        contexts, code = np.unique(context, return_inverse=True)
        del context
        code = code * len(self.words) + self.word_of
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
        self.pair_of = np.empty(len(code), np.int32)
        self.pair_of[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(code))))
        code = code[first]
        self.context, self.token = contexts[code // max(1, len(self.words))], (code % max(1, len(self.words))).astype(np.int32)
        del order, code
        self.count = np.bincount(self.pair_of, weights=learned, minlength=len(first)).astype(np.int32)
        self.word_count = np.bincount(self.word_of, weights=learned, minlength=len(self.words)).astype(np.int64)
        spread = np.isin(self.context, frequent)
        self.shard = (np.where(spread, rolling.mix(self.words[self.token]), rolling.mix(self.context)) % np.uint64(n)).astype(np.int32)
        self.word_shard = (rolling.mix(self.words) % np.uint64(n)).astype(np.int64)

    def sent(self, block, n):
        for shard, rows in split_by(self.shard, n):
            context = self.context[rows]
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            size = np.diff(np.append(first, len(rows)))
            yield "pair", shard, block, pack(narrow(context[first]), *counts_body(size), narrow(self.words[self.token[rows]]), *counts_body(self.count[rows]))
        for shard, rows in split_by(self.word_shard, n):
            yield "word", shard, block, pack(narrow(self.words[rows]), *counts_body(self.word_count[rows]))


def _read_pairs(body):
    six, *rest = unpack(body, np.uint8, *COUNTS, np.uint8, *COUNTS)
    context = np.repeat(widen(six), read_counts(*rest[:3]))
    return context, widen(rest[3]), read_counts(*rest[4:])


def _group(*keys):
    """(order, first of each group in that order, group number of each entry)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    if len(new):
        new[0] = True
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), of


def _pair_shard(kinds, origins, bodies, n, frequent):
    yield from (("word", p, o, b) for k, p, o, b in zip(kinds, bodies[1], origins, bodies[0]) if k == "word")
    mine = [(o, b) for k, o, b in zip(kinds, origins, bodies[0]) if k == "pair"]
    if not mine:
        return
    place = bodies[1][0]
    parts = [_read_pairs(b) for _, b in mine]
    context, token, count = (np.concatenate(x) for x in zip(*parts))
    order, first, of = _group(context, token)
    total = np.bincount(of, weights=count).astype(np.int64)
    ctx, tok = context[order[first]], token[order[first]]
    own = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1])))
    size = np.diff(np.append(own, len(ctx)))
    sums = [np.add.reduceat(x.astype(np.int64), own) for x in (total, total == 1, total == 2, total >= 3)]
    yield "stat", 0, place, pack(np.array([(total == i).sum() for i in (1, 2, 3, 4)], np.int64))
    # distinct contexts of each token
    seen = tok[total > 0]
    word, times = np.unique(seen, return_counts=True)
    for shard, rows in split_by((rolling.mix(word) % np.uint64(n)).astype(np.int64), n):
        yield "follows", shard, place, pack(narrow(word[rows]), *counts_body(times[rows]))
    shared = np.flatnonzero(np.isin(ctx[own], frequent))
    yield "context", 0, place, pack(narrow(ctx[own][shared]), *(np.asarray(s[shared], np.int64) for s in sums))
    number = np.repeat(np.arange(len(own)), size)
    at = 0
    for (origin, _), (c, _, _) in zip(mine, parts):
        groups = of[at : at + len(c)]
        at += len(c)
        heads = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        rows = number[groups[heads]]
        body = [x for s in sums for x in counts_body(s[rows])]
        yield "pairs", origin, place, pack(*counts_body(total[groups]), *body)


def _word_shard(kinds, origins, bodies):
    parts = [(k, o, unpack(b, np.uint8, *COUNTS)) for k, o, b in zip(kinds, origins, bodies)]
    if not parts:
        return
    word = np.concatenate([widen(p[0]) for _, _, p in parts])
    value = np.concatenate([read_counts(*p[1:]) for _, _, p in parts])
    follows = np.concatenate([np.full(len(p[0]) // 6, k == "follows") for k, _, p in parts])
    order, first, of = _group(word)
    types = np.bincount(of, weights=value * follows, minlength=len(first)).astype(np.int64)
    count = np.bincount(of, weights=value * ~follows, minlength=len(first)).astype(np.int64)
    yield "words_stat", 0, 0, pack(np.array([*((types == i).sum() for i in (1, 2, 3, 4)), types.sum(), (types >= 3).sum(), (count > 0).sum(), count.sum()], np.int64))
    at = 0
    for kind, origin, p in parts:
        groups = of[at : at + len(p[0]) // 6]
        at += len(groups)
        if kind == "word":
            yield "words", origin, -1, pack(*counts_body(count[groups]), *counts_body(types[groups]))


def discounts(n1, n2, n3, n4):
    """Modified Kneser-Ney discounts for counts 1, 2 and more; 0.5, 1 and 1.5 where counts of counts are missing."""
    if not min(n1, n2, n3, n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *(min(max(d, 0.0), float(i)) for i, d in enumerate(found, 1))])


def _mapped(*arrays):
    """Arrays moved into an unnamed file and mapped from there; the file goes with the mapping."""
    with tempfile.TemporaryFile() as file:
        for a in arrays:
            file.write(np.ascontiguousarray(a).tobytes())
        file.flush()
        size = sum(a.nbytes for a in arrays)
        view = mmap.mmap(file.fileno(), size, access=mmap.ACCESS_READ) if size else b""
    out, at = [], 0
    for a in arrays:
        out.append(np.frombuffer(view, a.dtype, len(a), at))
        at += a.nbytes
    return out


def _scores(texts, trained, frequent, n, rows, totals):
    """(tokens, known tokens, base score, score) of each text of a block."""
    block = Pairs(texts, trained, frequent, n)
    total = np.zeros(len(block.count), np.int32)
    heads = np.concatenate(([True], block.context[1:] != block.context[:-1])) if len(total) else np.zeros(0, bool)
    contexts, context_of = block.context[heads], (np.cumsum(heads) - 1).astype(np.int32)
    of_context = np.zeros((4, len(contexts)), np.int64)
    word_count, word_types = np.zeros((2, len(block.words)), np.int64)
    shards, word_shards = dict(split_by(block.shard, n)), dict(split_by(block.word_shard, n))
    for kind, shard, body in rows:
        if kind == "pairs":
            at = shards[shard]
            parts = unpack(body, *COUNTS * 5)
            total[at] = read_counts(*parts[:3])
            own = context_of[at]
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            for i in range(4):
                of_context[i, own] = read_counts(*parts[3 + 3 * i : 6 + 3 * i])
        else:
            at = word_shards[shard]
            parts = unpack(body, *COUNTS * 2)
            word_count[at], word_types[at] = read_counts(*parts[:3]), read_counts(*parts[3:])
    del shards, word_shards, block.shard, block.count
    hot = np.flatnonzero(np.isin(contexts, totals["hot"][0]))
    if len(hot):
        where = np.searchsorted(totals["hot"][0], contexts[hot])
        of_context[:, hot] = totals["hot"][1][:, where]
    d, e = totals["pair_discounts"], totals["word_discounts"]
    types, more = totals["types"], totals["vocabulary"] + 1
    single = (np.maximum(word_types - e[np.minimum(word_types, 3)], 0) / types + totals["word_rest"] / types / more) if types else np.full(len(block.words), 1 / more)
    lower = single[block.token]
    seen = of_context[0]
    rest = np.where(seen > 0, d[1] * of_context[1] + d[2] * of_context[2] + d[3] * of_context[3], 1.0)
    safe = np.maximum(seen, 1)  # a context that was never seen leaves all to the lower order
    chance = (np.maximum(total - d[np.minimum(total, 3)], 0) + rest[context_of] * lower) / safe[context_of]
    # the slice of the model: hashes in order, log-probabilities beside
    hashes = rolling.mix(block.context + rolling.mix(block.words[block.token]))
    order = np.argsort(hashes, kind="stable")
    keys, values, words, bases, known = _mapped(
        hashes[order], np.log10(chance)[order], block.words,
        np.log10((word_count + 0.5) / (totals["tokens"] + 0.5 * (totals["vocabulary"] + 1))), (word_count > 0).astype(np.int64),
    )
    del order, chance, lower, total
    doc, size = block.doc, len(texts)
    found = np.searchsorted(keys, hashes)[block.pair_of]
    word = np.searchsorted(words, block.words)[block.word_of]
    return (
        np.bincount(doc, minlength=size), np.bincount(doc, weights=known[word], minlength=size).astype(np.int64),
        np.bincount(doc, weights=bases[word], minlength=size), np.bincount(doc, weights=values[found], minlength=size),
    )


def _frequent(docs):
    """Words with a share of the tokens of some scan batch; adding their counts keeps at most 2 / FREQUENT."""

    def scan(batches):
        for batch in batches:
            token, _ = tokens(batch.column(0))
            word, count = np.unique(token, return_counts=True)
            many = count >= FREQUENT * len(token)
            yield pa.RecordBatch.from_arrays([pa.array(word[many].astype(np.int64)), pa.array(count[many]), pa.array(np.full(many.sum(), 0))], ["word", "n", "all"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0]), pa.array([len(token)])], ["word", "n", "all"])

    sums = docs.select("text").mapInArrow(scan, "word long, n long, all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    sums = written(sums, "frequent")
    total = sums.agg(F.sum("all")).first()[0] or 0
    rows = sums.where((F.col("word") >= 0) & (F.col("n") >= FREQUENT / 2 * total)).select("word").collect()
    return np.unique(np.array([START, *(r.word for r in rows)], np.uint64))


def score_documents(docs, trained, id_col="doc_id", text_col="text"):
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``trained`` is a condition on ``docs``: the rows to learn from.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    n, size = block_count(rows)
    n = max(48, n // 2) | 1
    rows = rows.withColumn("block", F.coalesce(block_of("id", n), F.lit(0)))
    frequent = _frequent(rows)

    def send(table):
        block = table.column("block")[0].as_py()
        pairs = Pairs(table.column("text"), table.column("trained").to_numpy(zero_copy_only=False), frequent, n)
        return pa.Table.from_batches([rows_of(pairs.sent(block, n), SENT)])

    def pair_shard(table):
        kinds, places, origins, bodies = (table.column(c).to_pylist() for c in SENT.names)
        return pa.Table.from_batches([rows_of(_pair_shard(kinds, origins, (bodies, places), n, frequent), SENT)])

    def word_shard(table):
        kinds, origins, bodies = (table.column(c).to_pylist() for c in ("kind", "origin", "body"))
        out = [(k, p, places, b) for (k, p, _, b), places in ((r, table.column("place")[0].as_py()) for r in _word_shard(kinds, origins, bodies))]
        return pa.Table.from_batches([rows_of(out, SENT)])

    paired = written(rows.groupBy("block").applyInArrow(send, SENT_DDL).groupBy("place").applyInArrow(pair_shard, SENT_DDL), "pairs")
    worded = written(paired.where("kind in ('word', 'follows')").groupBy("place").applyInArrow(word_shard, SENT_DDL), "words")
    totals = _totals(paired, worded, frequent)

    def score(left, right):
        answers = zip(*(right.column(c).to_pylist() for c in ("kind", "origin", "body")))
        learned = left.column("trained").to_numpy(zero_copy_only=False)
        found = _scores(left.column("text"), learned, frequent, n, answers, totals) if left.num_rows else [np.zeros(0)] * 4
        whole = np.full(left.num_rows, totals["tokens"])
        return pa.table([left.column("id"), pa.array(~learned), *(pa.array(found[i].astype(np.int64)) for i in (0, 1)), pa.array(whole.astype(np.int64)), pa.array(found[2]), pa.array(found[3])], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = paired.where("kind = 'pairs'").unionByName(worded.where("kind = 'words'"))
    return rows.groupBy("block").cogroup(answers.groupBy("place")).applyInArrow(score, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _totals(paired, worded, frequent):
    """Sums that every block needs: one row per shard, and those of the frequent contexts."""
    pairs = np.sum([np.zeros(4, np.int64), *(unpack(r.body, np.int64)[0] for r in paired.where("kind = 'stat'").select("body").collect())], axis=0)
    words = np.sum([np.zeros(8, np.int64), *(unpack(r.body, np.int64)[0] for r in worded.where("kind = 'words_stat'").select("body").collect())], axis=0)
    sums = np.zeros((4, len(frequent)), np.int64)

    def listed(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                six, *values = unpack(body, np.uint8, np.int64, np.int64, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(widen(six).astype(np.int64)), *map(pa.array, values)], ["c", "n0", "n1", "n2", "n3"])

    ddl = "c long, n0 long, n1 long, n2 long, n3 long"
    rows = paired.where("kind = 'context'").select("body").mapInArrow(listed, ddl).groupBy("c").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(4))).collect()
    for r in rows:
        sums[:, np.searchsorted(frequent, np.uint64(r.c))] = r.n0, r.n1, r.n2, r.n3
    e = discounts(*words[:4])
    return {
        "pair_discounts": discounts(*pairs), "word_discounts": e, "types": int(words[4]),
        "word_rest": float(e[1] * words[0] + e[2] * words[1] + e[3] * words[5]), "vocabulary": int(words[6]), "tokens": int(words[7]), "hot": (frequent, sums),
    }


def op7_lm_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fold("doc_id", 5) != 1).withColumnRenamed("id", "doc_id")
