"""Best-fit packing: best-two-fit over the histogram of piece lengths.

Documents are tokenised, closed with an end id and cut into pieces of at most ``max_len`` ids (only
longer documents are cut; their first piece may be shorter). Packing needs only how many pieces there
are of each length, at most ``max_len`` numbers, whatever the size of the corpus. A sequence is filled
greedily with the longest piece that fits; then its smallest piece is replaced by the two unpacked
pieces that fit the expanded gap most tightly, as long as that makes the gap smaller. The sequence so
found is used as often as the counts allow: the same steps would come again. Pieces are numbered
within their length by a salted rank, and the rank picks the sequence and the offset, so no task and
no driver ever holds the pieces.

Defined results: a missing text is empty and gives the end id alone; a missing id and repeated rows
are packed like any other rows; an empty table gives no sequence; other columns do not take part.
"""

import bisect
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from swayline.llm.common import written

MAX_LEN = 2048
END = 0
#: Pieces of one length and salt, about, and the fewest salts.
SALTED, SALTS = 1 << 20, 64
#: Characters whose classes (letter, digit, space) no version of Unicode disputes, and controls that some call space.
FOREIGN = re.compile("[^\x00-\u024f]|[\x1c-\x1f\x85]")
#: Longest word and most white space beyond two characters a word that the fast encoder is given.
LONG_WORD, MUCH_SPACE = 2000, 500
#: The split of byte-level tokenizers that use their regular expression.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranked(model):
    """Bytes of each token and its id, if merges come in the order of ids, so that the ids say which merge is first; else None."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocabulary[a + b] for a, b in merges]
    if any(a >= b for a, b in zip(ids, ids[1:])) or len(vocabulary) != 256 + len(ids) or not all(set(t) <= set(letters) for t in vocabulary):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    A byte-level tokenizer whose ids rank its merges is run as ranks, which gives the same ids several
    times faster. Texts with characters that the two may class differently, or with words or white space
    of great length, are encoded by the tokenizer itself, and so is everything if it is of another kind.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        told = json.loads(self.tokenizer.to_str())
        split, ranks = told["pre_tokenizer"] or {}, None
        known = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if known and told["normalizer"] is None and told["model"]["type"] == "BPE":
            ranks = ranked(told["model"])
        self.fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def _plain(self, text):
        if self.fast is None or FOREIGN.search(text):
            return False
        size = list(map(len, text.split()))
        return max(size, default=0) <= LONG_WORD and len(text) - sum(size) <= 2 * len(size) + MUCH_SPACE

    def encode(self, texts):
        out, odd = [None] * len(texts), []
        for i, text in enumerate(texts):
            if text and self._plain(text):
                out[i] = self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            else:
                odd.append(i)
        for i, e in zip(odd, self.tokenizer.encode_batch([texts[i] or "" for i in odd], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


_encoders = {}


def encoder(path):
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs, path, max_len, with_ids):
    """(id, piece, start, length, ids_crc32[, ids]) of every document."""
    ddl = "id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def scan(batches):
        coder = encoder(path)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 200):
                ids, texts = (batch.column(c).slice(lo, 200).to_pylist() for c in (0, 1))
                for i, body in zip(ids, coder.encode(texts)):
                    body += end
                    n = len(body) // 4
                    bounds = [0, *range(n % max_len or max_len, n + 1, max_len)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        part = body[4 * a : 4 * b]
                        rows.append((i, k, a, b - a, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            keep = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds)], names[:keep])

    return docs.mapInArrow(scan, ddl)


def best_two_fit(counts, max_len):
    """Sequences for ``counts`` (length to number of pieces): list of (lengths, how many such sequences)."""
    left = dict(counts)
    lengths = sorted(left)
    out = []
    while lengths:
        used, filled, gap = {}, [], max_len

        def free(v):
            return left.get(v, 0) - used.get(v, 0)

        while gap:
            at = bisect.bisect_right(lengths, gap) - 1
            while at >= 0 and not free(lengths[at]):
                at -= 1
            if at < 0:
                break
            v = lengths[at]
            filled.append(v)
            used[v] = used.get(v, 0) + 1
            gap -= v
        while gap:
            small = min(filled)
            used[small] -= 1
            pair = _tightest(lengths, free, gap + small)
            if not pair or sum(pair) <= small:
                used[small] += 1
                break
            filled.remove(small)
            for v in pair:
                filled.append(v)
                used[v] = used.get(v, 0) + 1
            gap += small - sum(pair)
        times = min(left[v] // n for v, n in used.items() if n)
        out.append((sorted(filled, reverse=True), times))
        for v, n in used.items():
            left[v] -= n * times
            if not left[v]:
                lengths.remove(v)
    return out


def _tightest(lengths, free, room):
    """The two free lengths with the largest sum of at most ``room``."""
    best, pair = 0, None
    hi = bisect.bisect_right(lengths, room) - 1
    lo = 0
    while lo <= hi:
        a, b = lengths[lo], lengths[hi]
        if not free(a) or (a + b <= room and lo == hi and free(a) < 2):
            lo += 1
        elif not free(b) or a + b > room:
            hi -= 1
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            lo += 1
    return pair


def segments(plan):
    """The plan by (length, rank): arrays (key, first rank, first sequence, offset); a key orders both."""
    rank, rows, sequence = {}, [], 0
    for filled, times in plan:
        offset = 0
        for v in filled:
            start = rank.get(v, 0)
            rows.append((v, start, sequence, offset))
            rank[v] = start + times
            offset += v
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack_documents(docs, path, max_len=MAX_LEN, id_col="doc_id", text_col="text", with_ids=False):
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids as 32-bit bytes)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = written(pieces(rows, path, max_len, with_ids), "pieces")
    salts = max(SALTS, -(-cut.count() // SALTED))  # counted from the files' footers
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    cells = written(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "cells")
    counts = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    table = segments(best_two_fit(counts, max_len))
    earlier = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    begin = cells.select(F.col("length").alias("c_length"), F.col("salt").alias("c_salt"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    own = W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1)
    ranked = ranked.join(begin, (F.col("length") == F.col("c_length")) & (F.col("salt") == F.col("c_salt")))
    ranked = ranked.select(*cut.columns, (F.col("begin") + F.col("own")).alias("rank"))

    def place(batches):
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            batch = batch.set_column(batch.schema.get_field_index("rank"), "sequence_id", pa.array(table[at, 2] + rank - table[at, 1]))
            yield batch.append_column("offset", pa.array(table[at, 3]))

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, ddl)


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, default_tokenizer()).withColumnRenamed("id", "doc_id")
