"""Decontamination: planted passages with edits, clean documents, the edit distance itself."""

import random

from fixtures import SCHEMA, tricky_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from swayline.llm import decontaminate
from swayline.llm.decontaminate import edit_distance, find_leaks, repetitions, without_leaks


def dynamic(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=80).map(lambda b: bytes(c % 3 for c in b)), st.binary(max_size=90).map(lambda b: bytes(c % 3 for c in b)))
def test_edit_distance(pattern, text):
    assert edit_distance(pattern, text)[0] == dynamic(pattern, text)


def planted(rate, seed=5, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    vocab = [word() for _ in range(800)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(12, 50)))) for i in range(n)]
    docs, want = [], set()
    for i, text in items:
        words = text.split()
        for k in range(len(words)):
            if rng.random() < rate:
                words[k] = rng.choice([word(), words[k] + "x", ""])
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(body))
        docs.append((i, " ".join([*body[:at], *words, *body[at:]]).upper() if i % 2 else " ".join([*body[:at], *words, *body[at:]]), None, None, None))
        a, b = " ".join(text.split()).encode(), " ".join(w for w in words if w).encode()
        if dynamic(a, b) <= int(0.2 * len(a)):
            want.add((i, i))
    clean = [(1000 + i, " ".join(rng.choice(vocab) for _ in range(300)), None, None, None) for i in range(60)]
    return items, docs, clean, want


def test_planted_passages(spark):
    for rate, least in ((0.0, 1.0), (0.1, 0.95)):
        items, docs, clean, want = planted(rate)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        got = find_leaks(spark.createDataFrame(docs + clean, SCHEMA), benchmark).collect()
        pairs = {(r.id, r.item) for r in got}
        assert not {i for i, _ in pairs} & {r[0] for r in clean}
        assert len(pairs & want) >= least * len(want)
        assert all(i == k for i, k in pairs)
        if not rate:
            assert all(r.distance == 0 for r in got)


def test_blocks_give_the_same(spark, monkeypatch):
    items, docs, clean, _ = planted(0.05, n=30)
    docs, benchmark = spark.createDataFrame(docs + clean + tricky_docs(), SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in find_leaks(docs, benchmark).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1500)
    assert sorted(tuple(r) for r in find_leaks(docs, benchmark).collect()) == whole


def test_odd_input(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, "  "), (4, "lone word"), (None, "x y z u v w")], "item_id long, text string")
    rows = [(1, "well Alpha, beta: gamma delta epsilon zeta eta theta!", "a"), (1, None, "b"), (None, "alpha beta gamma delta epsilon zeta eta theta", "c"), (3, "a lone word here", "d"), (4, "", "e"), (5, "clean", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    assert sorted(((r.id, r.item) for r in find_leaks(docs, benchmark).collect()), key=str) == [(1, 1), (3, 4), (None, 1)]
    assert sorted((r.item for r in without_leaks(docs, benchmark).collect())) == ["c", "e", "f"]
    assert find_leaks(docs, benchmark.limit(0)).count() == 0 and find_leaks(docs.limit(0), benchmark).count() == 0


def test_repetitions_follow_the_target():
    assert repetitions(12, 16, 0.95, 0.0001) == 1
    assert repetitions(12, 16, 0.95, 0.1) < repetitions(12, 16, 0.999, 0.1) < repetitions(12, 16, 0.999, 0.3)


def mistyped(text, rng, every):
    """One letter of a word changed, put in or left out, in one of ``every`` words."""
    words = text.split()
    for k in range(len(words)):
        if rng.random() < 1 / every:
            w, at, c = words[k], rng.randrange(len(words[k])), rng.choice("abcdefghijklmnopqrstuvwxyz")
            words[k] = rng.choice([w[:at] + c + w[at + 1 :], w[:at] + c + w[at:], w[:at] + w[at + 1 :]])
    return " ".join(w for w in words if w)


def test_letters_edited_up_to_the_bound(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    norm = lambda t: b" ".join(decontaminate_words(t)).decode()
    rng = random.Random(9)
    for n in (12, 16, 24):
        items = [(i, " ".join(norm(t).split()[:n])) for i, t in enumerate(given)]
        for every in (5, 3, 1):
            docs = [(i, "zq " * 20 + mistyped(t, rng, every) + " zq" * 20, None, None, None) for i, t in items]
            want = {i for (i, t), d in zip(items, docs) if edit_distance(t.encode(), d[1].encode())[0] <= int(0.2 * len(t.encode()))}
            got = {(r.id, r.item) for r in find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
            assert sum((i, i) in got for i in want) >= 0.9 * len(want), (n, every)


def decontaminate_words(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    low, first, last, _ = decontaminate.words_in(data, np.zeros(1, np.int64), np.array([len(data)]))
    return [low[a:b].tobytes() for a, b in zip(first, last)]


def test_recall_up_to_the_bound_at_every_size(spark):
    """Items of 12 to 80 words with a letter edited in every word or in every second one: found as brute force finds them."""
    given = [" ".join(decontaminate_words_text(r.text)) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    rng = random.Random(12)
    for n in (12, 16, 24, 36, 48, 80):
        items = [(i, " ".join((t + " " + given[i - 1]).split()[:n])) for i, t in enumerate(given[:60])]
        docs = [(i, "zq " * 20 + mistyped(t, rng, 1 + i % 2) + " zq" * 20, None, None, None) for i, t in items]
        want = {i for (i, t), d in zip(items, docs) if edit_distance(t.encode(), d[1].encode())[0] <= int(0.2 * len(t.encode()))}
        rows = find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
        got = {(r.id, r.item): r.distance for r in rows}
        assert sum((i, i) in got for i in want) >= 0.95 * len(want), n
        assert all(got[i, i] == edit_distance(items[i][1].encode(), docs[i][1].encode())[0] for i in want if (i, i) in got)


def decontaminate_words_text(text):
    return [w.decode() for w in decontaminate_words(text)]


def test_walks_of_equal_windows_agree_and_of_edited_ones_mostly():
    import numpy as np

    text = np.frombuffer(b"the quick brown fox jumps over the lazy dog and the quick brown fax jumps over the lazy dog and", np.uint8)
    walk = decontaminate.embed(text, np.array([0, 48, 0]), np.array([44, 92, 44]), 80, 0)
    assert (walk[0] == walk[2]).all() and 0.2 < (walk[0] == walk[1]).mean() < 1
    assert decontaminate.agreement(0.0) == 1.0 and decontaminate.agreement(0.05) > decontaminate.agreement(0.2)


def test_one_long_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    text = "filler words go on " * 300_000 + item.replace("kappa", "kapa") + " more" * 1000
    got = find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.id, r.item, r.distance) for r in got] == [(1, 7, 1)]
