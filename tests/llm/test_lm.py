"""Kneser-Ney scoring against a plain Python model."""

import math
import re
from collections import Counter

import pytest
from fixtures import SCHEMA, tricky_docs
from pyspark.sql import functions as F

from swayline.llm import lm_score
from swayline.llm.lm_score import discounts, score_documents


def toks(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def model(texts):
    pairs, words = Counter(), Counter()
    for t in texts:
        seq = toks(t)
        words.update(seq)
        pairs.update(zip([0, *seq[:-1]], seq))
    types = Counter(w for _, w in pairs)
    context, kinds = Counter(), Counter()
    for (v, w), c in pairs.items():
        context[v] += c
        kinds[v, min(c, 3)] += 1
    d = discounts(*(sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)))
    e = discounts(*(sum(c == i for c in types.values()) for i in (1, 2, 3, 4)))
    total, V, N = sum(types.values()), len(words), sum(words.values())
    rest = sum(e[min(c, 3)] for c in types.values())

    def single(w):
        return max(types[w] - e[min(types[w], 3)], 0) / total + rest / total / (V + 1) if total else 1 / (V + 1)

    def chance(v, w):
        if not context[v]:
            return single(w)
        c = pairs[v, w]
        return (max(c - d[min(c, 3)], 0) + sum(d[i] * kinds[v, i] for i in (1, 2, 3)) * single(w)) / context[v]

    return words, V, N, chance, pairs


@pytest.mark.parametrize("share", [0.002, 0.3])
def test_against_plain_model(spark, monkeypatch, share):
    monkeypatch.setattr(lm_score, "FREQUENT", share)
    rows = tricky_docs(21) + [(2000 + i, "Tick tock tick TOCK done " * (i + 1), None, None, None) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = score_documents(docs, F.pmod("doc_id", F.lit(5)) != 1).collect()
    words, V, N, chance, pairs = model([r[1] for r in rows if r[0] is not None and r[0] % 5 != 1])
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        seq = toks(text[r.id])
        assert r.held_out == (r.id is None or r.id % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(seq), sum(words[w] > 0 for w in seq), N)
        assert math.isclose(r.base_score, sum(math.log10((words[w] + 0.5) / (N + 0.5 * (V + 1))) for w in seq), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(chance(v, w)) for v, w in zip([0, *seq[:-1]], seq)), rel_tol=1e-9)
    # probabilities of a context add up to one, with the share of unknown tokens
    for v in (0, "tick", "never seen"):
        assert math.isclose(sum(chance(v, w) for w in words) + chance(v, "unknown"), 1.0, rel_tol=1e-9)


def test_empty_and_nothing_to_learn_from(spark):
    assert score_documents(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    r = score_documents(spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, block string"), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
