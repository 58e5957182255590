"""Benchmark decontamination: random-walk embedding, bit sampling, exact edit verification.

Texts become words (ASCII lower case; runs of ASCII letters, digits and all non-ASCII bytes), joined by
a space. The CGK embedding walks over the characters of a window as long as the item: at step ``j`` it
writes the character under its pointer and moves on if bit ``j`` of that character's random bits is set.
Two windows with few edits meet again after an edit, so their walks agree in many steps: edit distance
becomes Hamming distance. A repetition samples a few steps of a walk; a document window and an item
collide if they agree in all of them. ``repetitions`` are as many as reach the target recall at the
agreement that windows with ``edit_rate`` of their characters edited have (``agreement``, simulated).

Windows are placed by short runs of characters that a document shares with an item: they start where the
item would, so that walks begin side by side. The run's length and how many blocks of the item must share
a run on neighbouring diagonals follow the item's number of words (``RUNS``): of an item with a letter
edited in every word, blocks of six to eight characters still stand. A place is looked at once, however
many runs it has. What collides is verified: one piece of the item must have no more edits than its share,
then the exact edit distance in characters (of the words joined by a space) must be at most ``max_edit``
of the item's length. The query set (the benchmark) is dealt with in blocks of a bounded size, each
compared with all documents; documents are not shuffled.

Defined results: missing or empty texts, and items without words, match nothing; a missing id is
reported as such; repeated rows give repeated results; other columns do not take part.
"""

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swayline.llm.common import LOWER, chunks, utf8

#: (least words of an item, characters of a shared run, blocks of the item that must share one)
RUNS = ((48, 8, 6), (36, 8, 5), (24, 8, 3), (16, 7, 3), (12, 6, 4), (6, 5, 2), (3, 4, 1), (1, 2, 1))
#: Characters of a piece that is compared at first; walks, and steps of one for each character; steps of a sample.
PIECE, WALKS, STRIDE, SAMPLE = 64, 1, 2, 2
#: Steps that the agreement of walks is simulated over; characters of a word and the space after it, about.
STEPS, WORD_SIZE = 256, 6
RECALL, MAX_EDIT = 0.95, 0.2
EDIT_RATE = MAX_EDIT
#: Benchmark text that one pass over the documents compares.
BLOCK_BYTES = 4 << 20
CHUNK = 4 << 20
#: Five bits of each character: letters and the space have their own, others share four.
CLASS = (np.arange(256) % 4 + 28).astype(np.uint32)
CLASS[97:123] = np.arange(1, 27)
CLASS[32] = 0
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_in(data, starts, ends):
    """(lower-cased bytes, word starts, word ends, document of each word)."""
    low = LOWER[data]
    inside = np.zeros(len(low) + 2, bool)
    inside[1:-1] = WORD[low]
    cut = np.zeros(len(low) + 1, bool)
    cut[starts] = cut[ends] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return low, first, last, np.searchsorted(starts, first, "right") - 1


def joined(low, first, last):
    """(bytes of the words, each with a space after it, start of each word in them)."""
    size = last - first + 1
    ends = np.cumsum(size)
    text, inside = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8), np.ones(int(ends[-1]) if len(ends) else 0, bool)
    inside[ends - 1] = False
    text[inside] = low[WORD[low]]
    return text, ends - size


def run_of(n_words):
    """(characters of a shared run, blocks that must share one) for an item of so many words."""
    return next((run, blocks) for least, run, blocks in RUNS if n_words >= least)


@lru_cache(maxsize=4)
def _walk(walk):
    return np.random.default_rng([walk, 7]).integers(0, 2, (4096, 256), dtype=np.int64)


def embed(text, starts, stops, steps, walk):
    """The walk from every start, (starts, steps); behind its stop it reads nothing, so windows stay apart."""
    out = np.zeros((len(starts), steps), np.uint8)
    moves, at = _walk(walk), starts.astype(np.int64)
    for j in range(steps):
        inside = at < stops
        read = np.where(inside, text[np.minimum(at, len(text) - 1)], 0)
        out[:, j] = read
        at = at + moves[j % len(moves), read]
    return out


@lru_cache(maxsize=64)
def agreement(edit_rate, steps=STEPS, quantile=0.05, tries=300):
    """Share of the steps in which walks over a random window and its edited copy agree, at a low quantile."""
    rng, shares = np.random.default_rng(3), []
    for _ in range(tries):
        window = rng.integers(97, 123, steps).astype(np.uint8)
        edited = []
        for c in window.tolist():
            kind = rng.integers(3) if rng.random() < edit_rate else 3
            edited += [int(rng.integers(97, 123))] if kind == 0 else [] if kind == 1 else [c, int(rng.integers(97, 123))] if kind == 2 else [c]
        pair = np.concatenate((window, np.array(edited, np.uint8)))
        both = embed(pair, np.array([0, len(window)]), np.array([len(window), len(pair)]), steps, 0)
        shares.append((both[0] == both[1]).mean())
    return float(np.quantile(shares, quantile))


def repetitions(least_words, steps, recall=RECALL, edit_rate=EDIT_RATE):
    """Least number of samples of which one agrees altogether with the target recall, for walks over so many words."""
    steps = min(steps, STRIDE * WORD_SIZE * least_words)
    agreed = min(max(agreement(edit_rate, steps), 1 / steps), 1 - 1e-9)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agreed**SAMPLE)))


def edit_distance(pattern, text):
    """(least edit distance of ``pattern`` to a part of ``text``, end of that part), by bit vectors."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    equal = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | (1 << i)
    plus, minus, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, i
    return best, end


def doubled(text, longest):
    """Codes of runs of 1, 2, 4, ... characters, five bits each, up to ``longest``; the least type that holds them."""
    out, size = {1: CLASS[text]}, 1
    while 2 * size <= longest:
        half = out[size]
        size *= 2
        if 5 * size > 32 and half.dtype == np.uint32:
            half = half.astype(np.uint64)
        kind = half.dtype.type
        out[size] = half[: max(0, len(half) - size // 2)] << kind(5 * size // 2) | half[size // 2 :]
    return out


def runs_of(codes, length, total):
    """One number for each run of ``length`` characters of a text of ``total``; at most twelve fit."""
    n, width, out = max(0, total - length + 1), 0, None
    for size in sorted(codes, reverse=True):
        if length & size:
            part = codes[size][width : width + n]
            if out is None:
                out = part if 5 * length <= 32 else part.astype(np.uint64)
            else:
                out = out << out.dtype.type(5 * size) | part
            width += size
    return out[:n]


def slot(runs):
    if runs.dtype == np.uint32:
        return (runs * np.uint32(0x9E3779B1)) >> np.uint32(10)
    return (runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


class Items:
    """Runs and walks of a block of benchmark items."""

    def __init__(self, ids, texts, recall, edit_rate):
        self.ids, self.words, self.patterns = ids, [], []
        arrays = []
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            low, first, last, _ = words_in(data, np.zeros(1, np.int64), np.array([len(data)]))
            body = low.tobytes()
            self.words.append([body[a:b] for a, b in zip(first.tolist(), last.tolist())])
            self.patterns.append(b" ".join(self.words[-1]))
            arrays.append(np.frombuffer(self.patterns[-1], np.uint8))
        self.size = np.array([len(p) for p in self.patterns], np.int64)
        self.text = np.concatenate([*arrays, np.zeros(1, np.uint8)])
        self.begin = np.cumsum(self.size) - self.size
        # a run is no longer than the item, and no more blocks are asked for than it has
        told = [run_of(len(w)) if w else (1, 1) for w in self.words]
        self.run = np.array([max(1, min(run, n)) for (run, _), n in zip(told, self.size.tolist())], np.int64)
        self.least = np.array([max(1, min(blocks, n // r)) for (_, blocks), n, r in zip(told, self.size.tolist(), self.run.tolist())], np.int64)
        self.repetitions = repetitions(RUNS[2][0], STEPS, recall, edit_rate)
        self.passes = []
        for run in np.unique(self.run[self.size > 0]).tolist():
            mine = np.flatnonzero((self.run == run) & (self.size > 0))
            runs = [runs_of(doubled(arrays[i], run), run, len(arrays[i])) for i in mine]
            item = np.repeat(mine, [len(r) for r in runs])
            place = np.concatenate([np.arange(len(r)) for r in runs])
            runs = np.concatenate(runs)
            order = np.argsort(runs, kind="stable")
            known, first = np.unique(runs[order], return_index=True)
            seen = np.zeros(1 << 22, bool)
            seen[slot(known)] = True
            self.passes.append((run, known, np.append(first, len(runs)), item[order], place[order], seen))

    def candidates(self, text):
        """(place in the text, item, place in the item) of shared runs."""
        out = [(np.zeros(0, np.int64),) * 3]
        codes = doubled(text, int(self.run.max(initial=1)))
        for run, known, first, item, place, seen in self.passes:
            mine = runs_of(codes, run, len(text))
            at = np.flatnonzero(seen[slot(mine)])
            which = np.searchsorted(known, mine[at])
            good = known[np.minimum(which, len(known) - 1)] == mine[at]
            at, which = at[good], which[good]
            size = first[which + 1] - first[which]
            j = np.repeat(first[which], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out.append((np.repeat(at, size), item[j], place[j]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def colliding(self, text, starts, stops, item):
        """Which windows of the text agree with their item in all steps of one sample at least."""
        out = np.zeros(len(item), bool)
        each = -(-self.repetitions // WALKS)
        for lo in range(0, len(item), 4096):
            some = np.arange(lo, min(lo + 4096, len(item)))
            for walk in range(WALKS):
                some = some[~out[some]]
                if not len(some):
                    break
                size = self.size[item[some]]
                steps = int(STRIDE * size.max())
                here = embed(text, starts[some], stops[some], steps, walk)
                there = embed(self.text, self.begin[item[some]], self.begin[item[some]] + size, steps, walk)
                same, row = here == there, np.arange(len(some))
                rng = np.random.default_rng([walk, 11])
                for _ in range(0, each, 32):  # samples of each window's own steps
                    at = (rng.random((32, SAMPLE, 1)) * (STRIDE * size)).astype(np.int64)
                    out[some] |= same[row, at].all(1).any(0)
        return out


def plausible(items, text, low, high, item, bounds, slack):
    """Which candidates have a piece of the item with no more edits than its share; no true place is lost.

    If an item has at most ``slack`` edits, one of its pieces has at most its share of them. ``low`` and
    ``high`` bound where the item may start; all candidates step through a piece's region side by side.
    """
    out = np.zeros(len(item), bool)
    for n in np.unique(-(-items.size[item] // PIECE)).tolist():
        mine = np.flatnonzero(-(-items.size[item] // PIECE) == n)
        for p in range(n):
            for some in np.array_split(mine, -(-len(mine) // 8192)):
                some = some[~out[some]]
                if not len(some):
                    continue
                used, row = np.unique(item[some], return_inverse=True)
                cuts = [(items.size[used] * q // n) for q in (p, p + 1)]
                table = np.zeros((len(used), 256), np.uint64)
                for u, (k, x, y) in enumerate(zip(used.tolist(), *(c.tolist() for c in cuts))):
                    for bit, c in enumerate(items.patterns[k][x:y]):
                        table[u, c] |= np.uint64(1 << bit)
                table = table.ravel()
                size = (cuts[1] - cuts[0])[row]
                a = np.maximum(low[some] + cuts[0][row], bounds[0][some])
                b = np.minimum(high[some] + cuts[1][row], bounds[1][some])
                most = slack[some] * size // items.size[item[some]]
                top, one, row = (size - 1).astype(np.uint64), np.uint64(1), row * 256
                plus, minus = np.full(len(some), ~np.uint64(0)), np.zeros(len(some), np.uint64)
                score, best = size.copy(), size.copy()
                for t in range(int((b - a).max(initial=0))):
                    at = a + t
                    eq = table[row + np.where(at < b, text[np.minimum(at, len(text) - 1)], 0)]
                    vertical = eq | minus
                    horizontal = (((eq & plus) + plus) ^ plus) | eq
                    up, down = minus | ~(horizontal | plus), plus & horizontal
                    score += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
                    np.minimum(best, score, out=best)
                    up <<= one
                    down <<= one
                    plus, minus = down | ~(vertical | up), up & vertical
                out[some] = best <= most
    return out


def _leaks(items, data, starts, ends, max_edit):
    """(document, item, distance, first word, last word) of every place where an item stands."""
    for i, j in chunks(starts, ends, CHUNK):
        lo, hi = int(starts[i]), int(ends[j - 1])
        low, first, last, doc = words_in(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo)
        if not len(first):
            continue
        text, at_char = joined(low, first, last)
        begin = np.searchsorted(doc, np.arange(j - i + 1), "left")
        bounds = np.append(at_char, len(text))[begin]
        slack = (max_edit * items.size).astype(np.int64)  # edits shift the item's start by so much at most
        wide = np.maximum(slack // 2, 8)  # two bands of diagonals side by side count together
        at, item, place = items.candidates(text)
        d = np.searchsorted(bounds, at, "right") - 1
        inside = at + items.run[item] <= bounds[d + 1]  # a run does not cross documents
        at, item, place, d = at[inside], item[inside], place[inside], d[inside]
        if not len(at):
            continue
        shift = int(items.size.max())
        most = len(text) + 2 * shift
        part = (at - place + shift) // wide[item]
        key = (d * len(items.ids) + item) * most + part
        each = key  # of each shared run
        hits = np.sort(key * 64 + place // items.run[item] % 64)
        key = hits[np.append(True, hits[1:] != hits[:-1])] >> 6
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count, key = np.diff(np.append(head, len(key))), key[head]
        pair, part = key // most, key % most
        beside = np.append((key[1:] == key[:-1] + 1) & (pair[1:] == pair[:-1]), False)
        count = count + np.maximum(np.where(beside, np.roll(count, -1), 0), np.where(np.roll(beside, 1), np.roll(count, 1), 0))
        d, k = pair // len(items.ids), pair % len(items.ids)
        # of neighbouring bands the one with most blocks stands for the place
        less = np.where(beside, count < np.roll(count, -1), False) | np.where(np.roll(beside, 1), count <= np.roll(count, 1), False)
        enough = (count >= items.least[k]) & ~less
        d, k, part, key = d[enough], k[enough], part[enough], key[enough]
        if not len(d):
            continue
        # the window starts where the item would by the first run that it shares
        mine = np.flatnonzero(key[np.minimum(np.searchsorted(key, each), len(key) - 1)] == each)
        mine = mine[np.lexsort((place[mine], each[mine]))]
        mine = mine[np.append(True, each[mine[1:]] != each[mine[:-1]])]
        start = at[mine] - place[mine]
        low_start, high_start = (part - 1) * wide[k] - shift, (part + 2) * wide[k] - shift
        a = np.maximum(low_start - slack[k], bounds[d])
        b = np.minimum(high_start + items.size[k] + slack[k], bounds[d + 1] - 1)  # without the last space
        start = np.clip(start, a, b)
        near = items.colliding(text, start, np.minimum(b, start + items.size[k] + slack[k]), k)
        d, k, low_start, high_start, a, b = d[near], k[near], low_start[near], high_start[near], a[near], b[near]
        body = text.tobytes()
        ok = plausible(items, text, low_start - slack[k], high_start + slack[k], k, (bounds[d], bounds[d + 1] - 1), slack[k])
        past = None  # the last verified place: document, item, end, row; the least distance of those that overlap counts
        for d, k, a, b, most in np.stack([d, k, a, b, slack[k]], 1)[ok].tolist():
            pattern, region = items.patterns[k], body[a:b]
            found = region.find(pattern)
            distance, end = (0, found + len(pattern)) if found >= 0 else edit_distance(pattern, region)
            if distance > most:
                continue
            end += a
            same = past and past[:2] == (d, k) and abs(end - past[2]) < (len(pattern) + 1) // 2
            if same and distance >= past[3][2]:
                continue
            if past and not same:
                yield past[3]
            stop = int(np.searchsorted(at_char, end - 1, "right")) - 1
            past = d, k, end, (i + d, k, distance, max(int(stop - len(items.words[k]) + 1 - begin[d]), 0), int(stop - begin[d]))
        if past:
            yield past[3]


LEAK = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("distance", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def find_leaks(docs, benchmark, max_edit=MAX_EDIT, recall=RECALL, edit_rate=EDIT_RATE, id_col="doc_id", text_col="text", item_col="item_id"):
    """One row per place: id, item, distance, similarity, first_word, last_word (about, of the document's words)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES) or 1
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in range(n_blocks):
        # a block holds about BLOCK_BYTES of the query set
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == block).collect()
        known = Items([r.item for r in mine], [r.text for r in mine], recall, edit_rate)

        def scan(batches, known=known):
            for batch in batches:
                ids = batch.column(0)
                found = list(_leaks(known, *utf8(batch.column(1)), max_edit))
                doc, item, distance, first, last = ([f[c] for f in found] for c in range(5))
                length = [len(b" ".join(known.words[k])) for k in item]
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(doc, pa.int64())), pa.array([known.ids[k] for k in item], pa.int64()), pa.array(distance, pa.int64()),
                    pa.array([1 - d / n for d, n in zip(distance, length)], pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                ], schema=LEAK)

        part = rows.mapInArrow(scan, "id long, item long, distance long, similarity double, first_word long, last_word long")
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs, benchmark, id_col="doc_id", **options):
    """``docs`` without the documents that hold a benchmark item; rows without an id stay."""
    named = docs.where(F.col(id_col).isNotNull())
    leaked = find_leaks(named, benchmark, id_col=id_col, **options).select(F.col("id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs[id_col] == leaked["leaked_id"], "left_anti")


def op5_decontaminate(spark, sf_dir):
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return find_leaks(docs, benchmark).withColumnsRenamed({"id": "doc_id", "item": "item_id"})
