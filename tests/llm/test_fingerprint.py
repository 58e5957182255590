"""Fingerprints: contract columns, likeness against exact sets, merging."""

import hashlib
import re

from fixtures import SCHEMA, tricky_docs
from pyspark.sql import functions as F

from swayline.llm.fingerprint import containment, fingerprints, merged, resemblance, with_edits, with_sketch


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_rows_against_plain_python(spark):
    rows = [r for r in {r[0]: r for r in tricky_docs(11) if r[0] is not None}.values()]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    down = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    exact = {}
    for i, (doc, text) in enumerate(down):
        after = down[(i + 1) % len(down)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, b = shingles(text), shingles(edited)
        exact[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), len(a & b) / len(a | b) if a | b else 1.0, len(a | b), text)
    by_text = {}
    for parts in (1, 5):
        got = with_edits(docs, parts).collect()
        assert len(got) == len(rows)
        for r in got:
            n, digest, near, size, text = exact[r.doc_id]
            assert (r.n_chars, r.edited_sha256) == (n, digest)
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if size > 100:
                assert abs(r.near_edited - near) < 0.3
            assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_sketches_merge_and_estimate_containment(spark):
    words = [f"w{i * i % 9973}" for i in range(6000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:600])), (3, " ".join(words[3000:])), (4, ""), (5, None)]
    docs = with_sketch(spark.createDataFrame(rows, "doc_id long, text string"), "text", "s")
    s = {r.doc_id: r.s for r in docs.collect()}
    pair = spark.createDataFrame([(s[1], s[2], s[3])], "a array<long>, b array<long>, c array<long>")
    r = pair.select(containment(F.col("b"), F.col("a")).alias("whole"), containment(F.col("a"), F.col("b")).alias("part"), resemblance(F.col("a"), F.col("a")).alias("same"), merged(F.col("b"), F.col("c")).alias("m")).first()
    assert r.whole == 1.0 and abs(r.part - 0.1) < 0.03 and r.same == 1.0 and set(r.m) == set(s[2]) | set(s[3])
    assert abs(len(s[1]) - 5996 / 4) < 150 and s[4] == s[5] == []


def test_empty_and_clashing_names(spark):
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    assert with_edits(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0
    r = fingerprints(spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, sketch string")).first()
    assert r.doc_id == 1 and len(r.sketch) == 1
    odd = spark.createDataFrame([(None, "a b c"), (None, "d"), (3, ""), (3, "")], "doc_id long, text string")
    assert with_edits(odd, 2).count() == 4
