"""Spelling variants against all pairs of words; pivots against all choices."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import tricky_docs

from swayline.llm.spelling import mistyped, near_pairs, op11_spelling_variants, pivots_of, roots_of, spelling_variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows, change=True):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if change and h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def texts(seed, letters="abcàÿé÷E", n=60):
    rng = random.Random(seed)
    roots = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(25)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 120)):
            word = roots[min(int(rng.expovariate(0.2)), 24)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(word) + 1), rng.choice(letters)
                word = rng.choice([word[:at] + c + word[at:], word[:at] + word[at + 1 :], word[:at] + c + word[at + 1 :]])
            words.append(word)
        rows.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words), None, None, None))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "abcàÿé÷E"), (2, "ab"), (3, "aaaaaab")])
def test_against_all_pairs(spark, tmp_path, seed, letters):
    rows = texts(seed, letters) + tricky_docs(seed)
    rows += [(9000, "repeatedly " * 5000 + "x" * 4000 + " repeatadly repeatadly", None, None, None), rows[0]]
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "'x' AS id", "3 AS h").write.parquet(f"{folder}/documents.parquet")
    got = op11_spelling_variants(spark, folder).collect()
    want = brute(words_of(rows))
    assert len(got) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want


def test_chain_of_forms_ties_and_no_change(spark):
    counts = {"spelling": 2000, "speling": 200, "spelin": 15, "spellingx": 20, "zzzzzzzz": 2000, "spellinq": 2, "once": 1, "variantb": 50, "variantc": 50, "varianta": 3}
    rows = [(1, " ".join(w for w, n in counts.items() for _ in range(n)), None, None, None)]
    got = {r.word: (r.form, r.root) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA), least_length=6).collect()}
    assert got["spelin"] == ("speling", "spelling") and got["speling"] == ("spelling", "spelling") and got["spelling"] == (None, "spelling")
    assert got["varianta"] == ("variantb", "variantb") and got["variantb"] == (None, "variantb") and "once" not in got
    with pytest.raises(ValueError):
        spelling_variants(spark.createDataFrame(rows, SCHEMA), least_length=3)


def test_empty_tables_and_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(empty).count() == 0 and spelling_variants(empty, change=mistyped).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None, None, None, None), (None, "", None, None, None), (2, "short", None, None, None)], SCHEMA)).count() == 0
    assert near_pairs(spark.createDataFrame([], "word string, n long")).count() == 0


def test_long_chain_is_followed(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(19)]
    assert {r.word: r.root for r in roots_of(spark.createDataFrame(chain, "word string, form string")).collect()} == {w: "w19" for w, _ in chain}


def test_pivots_are_the_rarest_disjoint_pair_of_the_prefix():
    rng = np.random.default_rng(1)
    held = rng.integers(0, 9, 40)
    place = np.empty(40, np.int64)
    place[np.lexsort((np.arange(40), held))] = np.arange(40)
    grams = rng.integers(0, 40, (300, 7))
    third, prefix, pivots = pivots_of(grams, held, place)
    for g, t, inside, (p, q) in zip(grams, third, prefix, pivots):
        assert t == sorted(place[g])[2] and (inside == (place[g] <= t)).all()
        assert inside[p] and inside[q] and q - p >= 2
        least = min(held[g[a]] + held[g[b]] for a, b in itertools.combinations(np.flatnonzero(inside), 2) if b - a >= 2)
        assert held[g[p]] + held[g[q]] == least
