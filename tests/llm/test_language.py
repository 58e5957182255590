"""Language ID: gradients, held-out accuracy, odd input, learning from all rows."""

from functools import partial

import numpy as np
import pytest

from swayline.llm import language_id
from swayline.llm.common import LOWER
from swayline.llm.language_id import Familiar, LongNetwork, Network, document_probabilities, familiar, fit, fit_all, op4_language_id, predict, segments, train, training_rows

DATA = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    net = Network(["a", "b", "c"], hidden=4)
    for layer in (net.ahead, net.back):
        for k in layer.NAMES:
            setattr(layer, k, getattr(layer, k).astype(np.float64))
    net.out, net.shift = net.out.astype(np.float64), net.shift.astype(np.float64)
    text, target = rng.integers(97, 103, (7, 5)), rng.integers(0, 3, 5)
    _, grads = net.gradients(text, target)
    for key, grad in grads.items():
        p = net.parameter(key)
        for at in (tuple(rng.integers(0, s) for s in p.shape) if key[1] != "inp" else (int(text[2, 1]), int(rng.integers(0, 12))) for _ in range(3)):
            keep = p[at]
            p[at] = keep + 1e-3
            up, _ = net.gradients(text, target)
            p[at] = keep - 1e-3
            down, _ = net.gradients(text, target)
            p[at] = keep
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-3, (key, at)


def test_long_texts_are_pooled_whole(monkeypatch):
    net = Network(["a", "b"], hidden=3)
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 63, 64, 65, 700])
    data = rng.integers(0, 256, sizes.sum(), dtype=np.uint8)
    ends = np.cumsum(sizes)
    got = document_probabilities(net, data, ends - sizes, ends)
    for i, (a, b) in enumerate(zip(ends - sizes, ends)):
        parts = [net.probabilities(data[x : min(x + 64, b)][:, None])[:, 0] for x in range(a, b, 64)]
        want = np.concatenate(parts).mean(0) if parts else np.zeros(2)
        assert np.allclose(got[i], want, atol=1e-5)


def test_held_out_accuracy(spark):
    rows = op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture
def two():
    return train([b"abab abba baab " * 20, b"xyxy yxxy xxyy " * 20] * 6, ["ab", "xy"] * 6, steps=60)


def test_odd_input(spark, two):
    rows = [(1, "abba abab", "s"), (2, None, "s"), (3, "", "s"), (4, "12 34 !?", "s"), (None, "xyxy xxyy", "s"), (1, "abba abab", "s")]
    got = [(r.doc_id, r.lang_pred) for r in predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), two).collect()]
    assert sorted(got, key=str) == sorted([(1, "ab"), (1, "ab"), (2, "und"), (3, "und"), (4, "und"), (None, "xy")], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert fit(empty) is None
    assert predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).first().lang_pred == "und"
    assert fit_all(empty) is None and familiar(empty, empty).levels is None


SCHEMA = "doc_id long, text string, lang string"


def many(n):
    """More rows of each language than the sample of ``fit`` holds, of many lengths; some without label or text."""
    rng = np.random.default_rng(n)
    rows = [(i, "".join(rng.choice(list(letters), int(rng.integers(1, 1500) if i % 9 == 0 else rng.integers(1, 90)))), k) for i in range(n) for k, letters in (("ab", "abAB \u00e9"), ("xy", "xyz zq"))]
    return [(2 * i + (r[2] == "xy"), *r[1:]) for i, r in enumerate(rows)] + [(None, "no id", "ab"), (9, "", "ab"), (8, None, "xy"), (7, "what is this", None)]


def test_byte_models_and_levels_come_from_all_rows(spark):
    learned, held = many(700), many(801)
    got = familiar(*(spark.createDataFrame(r, SCHEMA).repartition(5) for r in (learned, held)))
    texts = [(np.frombuffer(t.encode(), np.uint8), k) for _, t, k in learned if t and k]
    want = Familiar(sum(np.bincount(LOWER[t], minlength=256) for t, _ in texts))
    for label in ("ab", "xy"):
        codes = np.concatenate([want._codes(t, np.zeros(1, int)) for t, k in texts if k == label])
        want.learn(*np.unique(codes, return_counts=True))
    assert len(got.tables) == 2 and all((a == b).all() for a, b in zip(got.tables, want.tables))
    parts, levels = [t.encode() for _, t, k in held if t and k], []
    for n in language_id.LENGTHS:
        cut = [b[: max(n, 8)] for b in parts if len(b) >= n]
        ends = np.cumsum([len(b) for b in cut])
        most = np.quantile(want.costs(np.frombuffer(b"".join(cut), np.uint8), np.concatenate(([0], ends[:-1])), ends), language_id.KEEPS)
        levels.append(min(most + (8 - most) * 2 / 3, 8.0))
    assert np.allclose(got.levels, levels)


def test_network_learns_from_every_row(spark, monkeypatch):
    monkeypatch.setattr(language_id, "train", partial(train, steps=4))
    monkeypatch.setattr(language_id, "PASS_BYTES", 40_000)
    rows = many(700)
    docs = spark.createDataFrame(rows, SCHEMA)
    sampled = {r.text for r in training_rows(docs).collect()}
    out = next(i for i, r in enumerate(rows) if r[1] and r[2] and r[0] is not None and r[1] not in sampled)
    other = spark.createDataFrame([*rows[:out], (rows[out][0], "quite another text", rows[out][2]), *rows[out + 1 :]], SCHEMA)
    assert (fit(docs).weights() == fit(other).weights()).all()
    net = fit_all(docs).weights()
    assert (net != fit(docs).weights()).any() and (net != fit_all(other).weights()).any()
    assert (net == fit_all(docs.repartition(7)).weights()).all()  # wherever the rows lie


def test_both_layouts_are_one_network():
    net, rng = Network(["a", "b", "c"], hidden=4), np.random.default_rng(5)
    long = LongNetwork(net.labels, hidden=4).with_weights(net.weights())
    text, target = rng.integers(0, 256, (9, 6)), rng.integers(0, 3, 6)
    active = [6, 6, 6, 5, 5, 3, 2, 2, 1]
    inside = np.arange(6) < np.array(active)[:, None]
    assert np.allclose(net.probabilities(text), long.probabilities(text), atol=1e-5)
    assert np.allclose(net.probabilities(text, active)[inside], long.probabilities(text, active)[inside], atol=1e-5)
    (loss, want), (other, got) = net.gradients(text, target), long.gradients(text, target)
    assert abs(loss - other) < 1e-5 and all(np.allclose(want[k], got[k], atol=1e-5) for k in want)


def test_segments_hold_every_byte():
    sizes = np.array([1, 0, 63, 64, 65, 700])
    ends = np.cumsum(sizes)
    data = np.arange(sizes.sum(), dtype=np.int64)
    doc, parts = segments(data, ends - sizes, ends)
    assert parts.shape[1] == 64 and (np.unique(parts) == data).all()
    assert all(((p >= ends[d] - sizes[d]) & (p < ends[d])).all() for d, p in zip(doc, parts))


def test_no_part_of_the_network_is_learned_from_a_sample(spark, monkeypatch):
    """Languages with short texts only are learned too, and no bounded sample is drawn."""
    rows = [(i, t, k) for i in range(80) for t, k in (("abba baab ", "ab"), ("xy", "xy"), ("q", "q"))]
    rows = [(3 * i + j, *r[1:]) for i, r in enumerate(rows) for j in range(3)] + [(None, "ab ab", "ab"), (1, None, "none"), (2, "", "none")]

    def sampled(*args, **options):
        raise AssertionError("a sample is drawn")

    for name in ("fit", "train", "training_rows"):
        monkeypatch.setattr(language_id, name, sampled)
    docs = spark.createDataFrame(rows, SCHEMA)
    net = fit_all(docs)
    assert net.labels == ["ab", "q", "xy"]
    got = predict(docs.where("lang is not null and text <> ''"), net).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99
    monkeypatch.setattr(language_id, "PASS_BYTES", 800)  # several rounds and blocks
    got = predict(docs.where("lang is not null and text <> ''"), fit_all(docs)).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99
