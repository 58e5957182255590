"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text's UTF-8 bytes in segments, once forwards and once backwards; both states at a
position give the language probabilities of that position, and a document's probabilities are the mean
over all its positions. Training is backpropagation through time with the Adam rule. ``fit`` learns from
segments of a bounded sample of labelled rows: at most ``per_language`` documents of each language, those
with the smallest hash of their id, so the sample is the same wherever it is drawn. ``fit_all`` learns from
every byte of all labelled rows, in Spark tasks. Whole texts are predicted.

Defined results: a missing text, or one without a letter, is ``und`` with score 0.0; rows without a
label are not learned from; a missing id is predicted like any other; repeated rows get equal results;
with no labelled row at all every text is ``und``; other columns do not take part.

The network only tells the learned languages from each other. Whether a text is of any of them tells
``Familiar``: its cost in bits a byte under the best of the languages' byte trigram models. Bytes that no
model expects cost eight bits, however many languages there are.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swayline.llm.common import LOWER, chunks, fold, utf8

#: Bounds and sizes of the training: documents of a language, segments of a document, segment length.
PER_LANGUAGE, SEGMENTS, LENGTH = 600, 4, 64
HIDDEN, STEPS, BATCH, RATE = 10, 350, 96, 0.02
#: Learning from all labelled texts: rounds, bytes of a block, segments of a step, least steps of a block in all rounds, parts of a weight that sums count.
ROUNDS, PASS_BYTES, PASS_BATCH, PASS_STEPS, WHOLE = 8, 1 << 20, 256, 400, 1 << 24
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
CHUNK = 1 << 19
TRIGRAM_CHUNK = 1 << 22
#: Byte trigrams: classes of bytes, weight of the even spread, steps of a stored cost in a bit.
CLASSES, EVEN, FINE = 128, 12.8, 16
#: Lengths in bytes that have a level of their own; held-out rows that a level needs; the share of them it keeps for certain.
LENGTHS, LEAST_HELD, KEEPS = (1, 16, 32, 64, 256, 1024), 50, 0.999


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Direction:
    """One gated recurrent layer: reset and update gates, candidate state; inputs are byte numbers."""

    NAMES = ("inp", "rec", "cand", "bias")

    def __init__(self, hidden, rng):
        scale = 1 / np.sqrt(hidden)
        self.inp = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.rec = rng.normal(0, scale, (hidden, 2 * hidden)).astype(np.float32)
        self.cand = rng.normal(0, scale, (hidden, hidden)).astype(np.float32)
        self.bias = np.zeros(3 * hidden, np.float32)
        self.hidden = hidden

    def forward(self, text, keep=False, active=None):
        """States after each step (steps, rows, hidden); ``text`` is (steps, rows).

        Of rows sorted by length, ``active`` tells how many take part in a step; the others stand still.
        """
        n = self.hidden
        table = self.inp + self.bias
        state = whole = np.zeros((text.shape[1], n), np.float32)
        states, inner = np.zeros((*text.shape, n), np.float32), []
        for t in range(len(text)):
            k = text.shape[1] if active is None else active[t]
            state = whole[:k]
            x = table[text[t, :k]]
            gates = _sigmoid(x[:, : 2 * n] + state @ self.rec)
            reset, update = gates[:, :n], gates[:, n:]
            fresh = np.tanh(x[:, 2 * n :] + (reset * state) @ self.cand)
            if keep:
                inner.append((state, reset, update, fresh))
            states[t, :k] = state + update * (fresh - state)
            whole = np.concatenate((states[t, :k], whole[k:])) if k < len(whole) else states[t]
        return (states, inner) if keep else states

    def backward(self, text, inner, grad):
        """Gradients of the parameters, from those of the states."""
        n = self.hidden
        out = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        carry = np.zeros_like(grad[0])
        for t in reversed(range(len(text))):
            state, reset, update, fresh = inner[t]
            total = grad[t] + carry
            d_fresh = total * update * (1 - fresh * fresh)
            d_mixed = d_fresh @ self.cand.T
            d_reset = d_mixed * state * reset * (1 - reset)
            d_update = total * (fresh - state) * update * (1 - update)
            d_gates = np.concatenate((d_reset, d_update), 1)
            out["cand"] += (reset * state).T @ d_fresh
            out["rec"] += state.T @ d_gates
            d_x = np.concatenate((d_gates, d_fresh), 1)
            out["bias"] += d_x.sum(0)
            np.add.at(out["inp"], text[t], d_x)
            carry = total * (1 - update) + d_mixed * reset + d_gates @ self.rec.T
        return out


class Network:
    LAYER = Direction

    def __init__(self, labels, hidden=HIDDEN, seed=7):
        rng = np.random.default_rng(seed)
        self.labels = list(labels)
        self.ahead, self.back = self.LAYER(hidden, rng), self.LAYER(hidden, rng)
        self.out = rng.normal(0, 0.3, (2 * hidden, len(self.labels))).astype(np.float32)
        self.shift = np.zeros(len(self.labels), np.float32)

    def _softmax(self, states):
        logits = states @ self.out + self.shift
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(-1, keepdims=True)

    def probabilities(self, text, active=None):
        """Language probabilities of each position of (steps, rows) bytes."""
        ahead = self.ahead.forward(text, active=active)
        back = self.back.forward(text[::-1], active=None if active is None else active[::-1])
        return self._softmax(np.concatenate((ahead, back[::-1]), 2))

    def gradients(self, text, target):
        """(loss, gradients by parameter) of full segments; ``target`` is the label number of each row."""
        a, kept_a = self.ahead.forward(text, True)
        b, kept_b = self.back.forward(text[::-1], True)
        states = np.concatenate((a, b[::-1]), 2)
        p = self._softmax(states)
        rows = np.arange(len(target))
        loss = -np.log(np.maximum(p[:, rows, target], 1e-12)).mean()
        p[:, rows, target] -= 1
        p /= len(text) * len(target)
        grads = {("self", "out"): np.einsum("trh,trc->hc", states, p), ("self", "shift"): p.sum((0, 1))}
        d = p @ self.out.T
        n = self.ahead.hidden
        for name, layer, own, kept, grad in (("ahead", self.ahead, text, kept_a, d[:, :, :n]), ("back", self.back, text[::-1], kept_b, d[::-1, :, n:])):
            grads |= {(name, k): g for k, g in layer.backward(own, kept, grad).items()}
        return loss, grads

    def parameter(self, key):
        return getattr(self if key[0] == "self" else getattr(self, key[0]), key[1])

    def keys(self):
        return [*((side, k) for side in ("ahead", "back") for k in Direction.NAMES), ("self", "out"), ("self", "shift")]

    def parameter(self, key):
        return getattr(self if key[0] == "self" else getattr(self, key[0]), key[1])

    def weights(self):
        """All parameters as one array."""
        return np.concatenate([self.parameter(k).ravel() for k in self.keys()])

    def with_weights(self, weights):
        """A network of the same labels with these parameters."""
        net, at = type(self)(self.labels, self.ahead.hidden), 0
        for key in net.keys():
            p = net.parameter(key)
            p[...] = weights[at : at + p.size].reshape(p.shape)
            at += p.size
        return net


def _squash(x):
    """In place; by the hyperbolic tangent, which does not overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class LongDirection(Direction):
    """A layer whose states lie (steps, hidden, rows), so that each step works on long rows."""

    def forward(self, text, keep=False, active=None):
        """States after each step (steps, hidden, rows); ``text`` is (steps, rows).

        Of rows sorted by length, ``active`` tells how many take part in a step; the others stand still.
        """
        n = self.hidden
        table, rec, cand = (np.ascontiguousarray(x.T) for x in (self.inp + self.bias, self.rec, self.cand))
        state = np.zeros((n, text.shape[1]), table.dtype)
        states = np.zeros((len(text), *state.shape), table.dtype)
        inner = tuple(np.zeros((len(text), m, text.shape[1]), table.dtype) for m in (n, 2 * n, n)) if keep else ()
        for t in range(len(text)):
            k = text.shape[1] if active is None else active[t]
            old = state[:, :k]
            x = table.take(text[t, :k], axis=1, mode="clip")
            gates = rec @ old
            gates += x[: 2 * n]
            gates = _squash(gates)
            fresh = cand @ (gates[:n] * old)
            fresh += x[2 * n :]
            np.tanh(fresh, out=fresh)
            if keep:
                inner[0][t], inner[1][t], inner[2][t] = old, gates, fresh
            now = states[t, :, :k]
            np.subtract(fresh, old, out=now)
            now *= gates[n:]
            now += old
            if active is None:
                state = states[t]
            else:
                state[:, :k] = now
        return (states, inner) if keep else states

    def backward(self, text, inner, grad):
        """Gradients of the parameters, from those of the states (steps, hidden, rows)."""
        n = self.hidden
        out = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        before, gates, fresh = inner
        reset, update = gates[:, :n], gates[:, n:]
        stay, moved = 1 - update, fresh - before
        to_fresh = update * (1 - fresh * fresh)
        to_reset, to_update = before * reset * (1 - reset), moved * update * stay
        carry = np.zeros_like(grad[0])
        d_all = np.zeros((3 * n, *text.shape), grad.dtype)
        for t in reversed(range(len(text))):
            carry += grad[t]
            d_gates, d_fresh = d_all[: 2 * n, t], d_all[2 * n :, t]
            np.multiply(carry, to_fresh[t], out=d_fresh)
            d_mixed = self.cand @ d_fresh
            np.multiply(d_mixed, to_reset[t], out=d_gates[:n])
            np.multiply(carry, to_update[t], out=d_gates[n:])
            carry *= stay[t]
            d_mixed *= reset[t]
            carry += d_mixed
            carry += self.rec @ d_gates
        by_step = d_all.transpose(1, 2, 0)
        out["cand"] += np.matmul(reset * before, by_step[:, :, 2 * n :]).sum(0)
        out["rec"] += np.matmul(before, by_step[:, :, : 2 * n]).sum(0)
        d_all = d_all.reshape(3 * n, -1)
        out["bias"] += d_all.sum(1)
        flat = text.ravel()
        for column, d in enumerate(d_all):
            out["inp"][:, column] = np.bincount(flat, d, 256)
        return out


class LongNetwork(Network):
    """The same network for large inputs, with states as in ``LongDirection``; equal but for rounding."""

    LAYER = LongDirection

    def _softmax(self, ahead, back):
        """(steps, labels, rows) of the states of both directions."""
        n = self.ahead.hidden
        p = self.out[:n].T @ ahead
        p += self.out[n:].T @ back
        p += self.shift[:, None]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def probabilities(self, text, active=None):
        """Language probabilities of each position of (steps, rows) bytes."""
        ahead = self.ahead.forward(text, active=active)
        back = self.back.forward(text[::-1], active=None if active is None else active[::-1])
        return self._softmax(ahead, back[::-1]).transpose(0, 2, 1)

    def gradients(self, text, target, weight=None):
        """(loss, gradients by parameter) of full segments; ``target`` is the label number of each row, ``weight`` its weight (1)."""
        ahead, kept_a = self.ahead.forward(text, True)
        back, kept_b = self.back.forward(text[::-1], True)
        back = back[::-1]
        p = self._softmax(ahead, back)
        rows = np.arange(len(target))
        loss = -np.log(np.maximum(p[:, target, rows], 1e-12))
        p[:, target, rows] -= 1
        p /= len(text) * len(target)
        if weight is not None:
            loss, weight = loss * weight, weight.astype(p.dtype)
            p *= weight
        grads = {("self", "out"): np.concatenate([np.matmul(x, p.transpose(0, 2, 1)).sum(0) for x in (ahead, back)]), ("self", "shift"): p.sum((0, 2))}
        n = self.ahead.hidden
        for name, layer, own, kept, grad in (("ahead", self.ahead, text, kept_a, self.out[:n] @ p), ("back", self.back, text[::-1], kept_b, (self.out[n:] @ p)[::-1])):
            grads |= {(name, k): g for k, g in layer.backward(own, kept, grad).items()}
        return loss.mean(), grads


class Adam:
    """The steps of the Adam rule for one network; gradients are cut to length one."""

    def __init__(self, net):
        self.net, self.step, self.first, self.second = net, 0, {}, {}

    def move(self, grads, rate):
        self.step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        for k, g in grads.items():
            g = g * min(1.0, 1 / (size + 1e-12))
            self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * g
            self.second[k] = 0.99 * self.second.get(k, 0) + 0.01 * g * g
            p = self.net.parameter(k)
            p -= (rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)


def train(texts, labels, steps=STEPS, seed=7):
    """A network from byte texts and their labels; every language weighs the same."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    cut = [[] for _ in names]
    for text, label in zip(texts, labels):
        data = np.frombuffer(text, np.uint8)
        if len(data) >= 8:
            for _ in range(min(SEGMENTS, -(-len(data) // LENGTH))):
                start = int(rng.integers(0, max(1, len(data) - LENGTH + 1)))
                cut[names.index(label)].append(np.resize(data[start : start + LENGTH], LENGTH))
    names = [n for n, c in zip(names, cut) if c]
    cut = [np.stack(c) for c in cut if c]
    if not names:
        return None
    net = Network(names, seed=seed)
    rule = Adam(net)
    for step in range(1, steps + 1):
        target = rng.integers(0, len(names), BATCH)
        text = np.stack([cut[k][rng.integers(len(cut[k]))] for k in target], 1)
        rule.move(net.gradients(text, target)[1], RATE * min(1.0, 2 * (1 - step / (steps + 1))))
    return net


def document_probabilities(net, data, starts, ends):
    """Mean probabilities over all positions of each document (documents, languages)."""
    total = np.zeros((len(starts), len(net.labels)))
    for i, j in chunks(starts, ends, CHUNK):
        for lo in range(int(starts[i]), int(ends[j - 1]), CHUNK):  # a long document in several pieces
            hi = min(lo + CHUNK, int(ends[j - 1]))
            a, b = np.maximum(starts[i:j], lo), np.minimum(ends[i:j], hi)
            size = np.maximum(b - a, 0)
            count = -(-size // LENGTH)
            doc = np.repeat(np.arange(i, j), count)
            begin = np.repeat(a, count) + LENGTH * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            length = np.minimum(np.repeat(b, count) - begin, LENGTH)
            order = np.argsort(-length, kind="stable")
            for part in np.array_split(order, max(1, len(order) // 2048)):
                if not len(part):
                    continue
                steps = int(length[part].max())
                inside = np.arange(steps)[:, None] < length[part]
                at = begin[part] + np.minimum(np.arange(steps)[:, None], length[part] - 1)
                p = net.probabilities(data[at], inside.sum(1).tolist()) * inside[:, :, None]
                np.add.at(total, doc[part], p.sum(0))
    return total / np.maximum(ends - starts, 1)[:, None]


class Familiar:
    """Costs of texts under byte trigram models, and the level by text length up to which a text is familiar.

    The level of a length lies two thirds of the way from what the first so many bytes of held-out
    labelled texts cost at most (``KEEPS`` of them) to the eight bits of random bytes. With fewer than
    ``LEAST_HELD`` texts to learn from or to hold against there is no level, and every text is familiar.
    """

    def __init__(self, counts):
        """``counts``: how often each (lower-cased) byte stands in the texts to learn from."""
        often = np.argsort(-counts, kind="stable")[: CLASSES - 1]
        self.classes = np.zeros(256, np.uint32)
        self.classes[often] = np.arange(1, CLASSES)
        self.classes = self.classes[LOWER]
        self.tables, self.levels = [], None

    def learn(self, codes, counts):
        """One more language, by how often each class trigram stands in its texts."""
        seen = np.zeros(CLASSES**3)
        seen[codes] = counts
        context = seen.reshape(-1, CLASSES).sum(1)
        even = np.full(CLASSES, EVEN / 256)
        even[0] *= 257 - CLASSES  # the rare bytes share a class
        share = (seen.reshape(-1, CLASSES) + even) / (context + EVEN)[:, None]
        share[:, 0] /= 257 - CLASSES
        self.tables.append(np.minimum(np.rint(-FINE * np.log2(share)), 255).astype(np.uint8).ravel())

    def hold(self, costs):
        """Sets the levels; ``costs`` has for each of ``LENGTHS`` (distinct bits a byte, number of texts)."""
        self.levels = []
        for bits, n in costs:
            if n.sum() >= LEAST_HELD:
                most = weighted_quantile(bits, n, KEEPS)
                self.levels.append(min(most + (8 - most) * 2 / 3, 8.0))
            else:  # too few that long: as for the next shorter length
                self.levels += self.levels[-1:] or [8.0]

    def _codes(self, data, starts):
        """Class trigrams that end at each byte; a text begins after two spaces."""
        c = self.classes[data]
        before = [np.concatenate((np.full(k, self.classes[32], np.uint32), c))[: len(c)] for k in (1, 2)]
        first = starts[starts < len(c)]
        before[0][first] = before[1][first] = self.classes[32]
        before[1][first[first + 1 < len(c)] + 1] = self.classes[32]
        return (before[1] * np.uint32(CLASSES) + before[0]) * np.uint32(CLASSES) + c

    def trigrams(self, data, starts, ends):
        """Distinct class trigrams of texts that lie side by side, and how often each one stands there."""
        codes, n = [], []
        for i, j in chunks(starts, ends, TRIGRAM_CHUNK):
            lo = int(starts[i])
            seen = np.bincount(self._codes(data[lo : int(ends[j - 1])], starts[i:j] - lo))
            codes.append(np.flatnonzero(seen))
            n.append(seen[codes[-1]])
        return np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0, np.int64), *n])

    def beginnings(self, data, starts, ends):
        """Costs of the first bytes of texts, as (number in ``LENGTHS``, bytes, stored cost), one row for a length of a text."""
        out = [np.zeros((0, 3), np.int64)]
        for i, j in chunks(starts, ends, CHUNK):
            size = (ends - starts)[i:j]
            cut = np.minimum(size, max(LENGTHS))
            at = np.cumsum(cut) - cut
            some = data[np.repeat(starts[i:j] - at, cut) + np.arange(cut.sum())]
            codes = self._codes(some, at)
            reach = [np.minimum(cut, max(n, 8)) for n in LENGTHS]
            least = None
            for table in self.tables:
                sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(table[codes], dtype=np.int64)))
                cost = np.stack([sums[at + r] - sums[at] for r in reach])
                least = cost if least is None else np.minimum(least, cost)
            for k, (n, r) in enumerate(zip(LENGTHS, reach)):
                long = size >= n
                out.append(np.stack((np.full(long.sum(), k), r[long], least[k][long]), 1))
        return np.concatenate(out)

    def costs(self, data, starts, ends):
        """Bits a byte of each document, under the model of the language that has the fewest."""
        out = np.zeros((len(self.tables), len(starts)))
        for i, j in chunks(starts, ends, CHUNK):
            for lo in range(int(starts[i]), int(ends[j - 1]), CHUNK):  # a long document in several pieces
                hi = min(lo + CHUNK, int(ends[j - 1]))
                a, b = np.clip(starts[i:j], lo, hi) - lo, np.clip(ends[i:j], lo, hi) - lo
                codes = self._codes(data[lo:hi], a)
                for table, total in zip(self.tables, out):
                    sums = np.concatenate((np.zeros(1), np.cumsum(table[codes], dtype=np.int64)))
                    total[i:j] += sums[b] - sums[a]
        return out.min(0, initial=np.inf) / FINE / np.maximum(ends - starts, 1)

    def known(self, data, starts, ends):
        """Which documents are familiar."""
        if self.levels is None:
            return np.ones(len(starts), bool)
        level = np.array(self.levels)[np.maximum(np.searchsorted(LENGTHS, ends - starts, "right") - 1, 0)]
        return self.costs(data, starts, ends) <= level


def weighted_quantile(values, counts, share):
    """``np.quantile`` of values that occur ``counts`` times."""
    order = np.argsort(values, kind="stable")
    ends = np.cumsum(counts[order])
    at = (int(ends[-1]) - 1) * share
    low, high = (float(values[order][np.searchsorted(ends, k, "right")]) for k in (int(np.floor(at)), int(np.ceil(at))))
    return low + (high - low) * (at - np.floor(at))


def labelled(docs, id_col="doc_id", text_col="text", label_col="lang"):
    """(id, text, label) of the rows that can be learned from."""
    known = docs.where(F.col(label_col).isNotNull() & (F.length(text_col) > 0))
    return known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))


def _labels(batch):
    """(label, rows with it) of a batch of (label, text)."""
    column = batch.column(0).dictionary_encode()
    number = column.indices.to_numpy()
    for k, label in enumerate(column.dictionary.to_pylist()):
        yield label, batch.filter(pa.array(number == k))


def byte_counts(known):
    """{label: array of 257} of all rows: how often each lower-cased byte stands in their texts, and the number of rows."""

    def scan(batches):
        for batch in batches:
            for label, rows in _labels(batch):
                data, starts, ends = utf8(rows.column(1))
                counts = np.append(np.bincount(LOWER[data[int(starts[0]) : int(ends[-1])]], minlength=256), len(starts))
                yield pa.RecordBatch.from_arrays([pa.array([label] * 257), pa.array(np.arange(257)), pa.array(counts)], ["label", "at", "n"])

    rows = known.select("label", "text").mapInArrow(scan, "label string, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n"))
    out = {}
    for r in rows.collect():  # 257 for each label
        out.setdefault(r.label, np.zeros(257, np.int64))[r.at] = r.n
    return out


def familiar(docs, held, **columns):
    """``Familiar`` learned from all labelled ``docs`` and held against all labelled ``held``.

    Only counts reach the driver: of a label's trigrams (at most ``CLASSES`` cubed) and of the distinct costs
    of the first bytes (whole numbers, bounded by the length).
    """
    known, against = labelled(docs, **columns), labelled(held, **columns)
    counts = byte_counts(known)
    model = Familiar(sum((n[:256] for n in counts.values()), np.zeros(256, np.int64)))

    def scan(batches):
        for batch in batches:
            for label, rows in _labels(batch):
                codes, n = model.trigrams(*utf8(rows.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["label", "code", "n"])

    seen = known.select("label", "text").mapInArrow(scan, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    seen = seen.orderBy("label", "code").toArrow()
    for label in sorted(counts):
        mine = seen.filter(pc.equal(seen.column("label"), label))
        model.learn(mine.column("code").to_numpy(), mine.column("n").to_numpy())

    def measure(batches):
        for batch in batches:
            rows, n = np.unique(model.beginnings(*utf8(batch.column(0))), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[:, c]) for c in range(3)), pa.array(n)], ["length", "size", "cost", "n"])

    if model.tables and sum(int(n[256]) for n in counts.values()) >= LEAST_HELD:
        costs = against.select("text").mapInArrow(measure, "length long, size long, cost long, n long")
        costs = costs.groupBy("length", "size", "cost").agg(F.sum("n").alias("n")).toArrow()
        length, size, cost, n = (costs.column(c).to_numpy() for c in ("length", "size", "cost", "n"))
        # a text of one byte or more has a cost of the first length
        if n[length == 0].sum() >= LEAST_HELD:
            model.hold([(cost[mine] / FINE / size[mine], n[mine]) for mine in (length == k for k in range(len(LENGTHS)))])
    return model


def training_rows(docs, id_col="doc_id", text_col="text", label_col="lang", per_language=PER_LANGUAGE):
    """At most ``per_language`` labelled rows of each language, by hash of the id."""
    known = labelled(docs, id_col, text_col, label_col)
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id"), "id", "text"))
    return known.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("label", "rank").select("text", "label")


def fit(docs, **columns):
    """The network learned from a bounded sample of labelled ``docs``; None when there is none."""
    rows = training_rows(docs, **columns).collect()
    return train([r.text.encode() for r in rows], [r.label for r in rows])


def segments(data, starts, ends):
    """(document, segment of ``LENGTH`` bytes) of all bytes of texts; a text's last segment ends with it, a short text is repeated."""
    size = ends - starts
    count = -(-size // LENGTH)
    doc = np.repeat(np.arange(len(starts)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(LENGTH * number, np.maximum(size - LENGTH, 0)[doc])
    return doc, data[starts[doc][:, None] + (begin[:, None] + np.arange(LENGTH)) % size[doc][:, None]]


def fit_all(docs, **columns):
    """The network learned from every byte of all labelled ``docs``; None when there is none.

    Rows are dealt by hash to rounds, and within a round to blocks of about ``PASS_BYTES``. Each block moves the
    round's weights by its own segments, and the next round starts from the mean of what the blocks came to (federated
    averaging; a block counts by its steps). The rate falls to nothing with the last round. Few texts are gone through
    as often as ``PASS_STEPS`` need. Sums are of whole numbers, so their order does not matter. Every language weighs the same.
    """
    known = labelled(docs, **columns)
    size = {r.label: r.size for r in known.groupBy("label").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if not size:
        return None
    net, total = LongNetwork(sorted(size)), sum(size.values())
    weight = np.array([total / len(size) / size[k] for k in net.labels])
    rounds = min(ROUNDS, -(-total // PASS_BYTES))
    blocks = -(-total // rounds // PASS_BYTES)
    passes = -(-PASS_STEPS // max(rounds, total // (blocks * PASS_BATCH * LENGTH)))
    known = known.withColumn("h", F.xxhash64("id", "text"))
    for turn in range(rounds):
        mine = known.where(F.pmod("h", F.lit(rounds)) == turn) if rounds > 1 else known
        dealt = mine.repartition(blocks, "h").sortWithinPartitions("h", "id", "text", "label")
        net = net.with_weights(net.weights() + _learned(dealt.select("label", "text"), net, weight, passes, turn / rounds, 1 / rounds))
    return net


def _learned(dealt, net, weight, passes, done, share):
    """Mean move of the weights over the blocks (partitions) of a round, which is a ``share`` of all that is to be ``done``."""
    start = net.weights()

    def learn(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        labels = np.array([net.labels.index(k) for b in batches for k in b.column(0).to_pylist()])
        doc, parts = segments(*utf8(pa.Table.from_batches(batches).column(1)))
        mine, rng = net.with_weights(start), np.random.default_rng(7)
        rule, each = Adam(mine), max(1, len(doc) // PASS_BATCH)
        order = [some for _ in range(passes) for some in np.array_split(rng.permutation(len(doc)), each)]
        for step, some in enumerate(order, 1):
            target = labels[doc[some]]
            rate = RATE * min(1.0, 2 * (1 - done - share * step / (len(order) + 1)))
            rule.move(mine.gradients(np.ascontiguousarray(parts[some].T), target, weight[target])[1], rate)
        whole = np.append(np.rint((mine.weights() - start).astype(np.float64) * WHOLE) * each, each).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(whole))), pa.array(whole)], ["at", "moved"])

    moved = dealt.mapInArrow(learn, "at long, moved long").groupBy("at").agg(F.sum("moved").alias("moved")).collect()
    moved = np.array([float(r.moved) for r in sorted(moved, key=lambda r: r.at)])
    return moved[:-1] / WHOLE / moved[-1] if len(moved) else np.zeros(len(start))


def predict(docs, net, text_col="text", model=None):
    """``docs`` with lang_pred and score (they replace columns of those names); rows keep their order.

    With a ``model`` (``Familiar``) also a column ``familiar``, from the same pass; a missing text is not. The
    text may be a field of a struct column (``row.text``).
    """
    added = ["lang_pred", "score"] + ["familiar"] * (model is not None)
    others = [c for c in docs.columns if c not in added]
    name, *fields = text_col.split(".")
    at = others.index(name)

    def scan(batches):
        for batch in batches:
            column = batch.column(at)
            for field in fields:
                column = pc.struct_field(column, field)
            texts = utf8(column)
            letters = np.fromiter((t is not None and LETTER.search(t) is not None for t in (s.as_py() for s in column)), bool, len(column))
            known = letters if net is not None else np.zeros(len(column), bool)
            names, scores = [UNKNOWN] * len(column), np.zeros(len(column))
            if known.any():
                p = document_probabilities(net, *texts)
                best = p.argmax(1)
                names = [net.labels[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                scores = np.where(known, np.minimum(p[np.arange(len(best)), best], 1.0), 0.0)
            new = [pa.array(names, pa.string()), pa.array(scores)]
            if model is not None:
                new.append(pa.array(model.known(*texts) & column.is_valid().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    rows = docs.select(*others)
    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, kind) for n, kind in zip(added, kinds))])
    return rows.mapInArrow(scan, schema)


def op4_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold("doc_id", 3) == 1
    net = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), net).drop("text")
