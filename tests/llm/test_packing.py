"""Packing: contract columns, whole documents, few sequences; encoding equal to the tokenizer's."""

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from fixtures import SCHEMA, tricky_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from swayline.llm.packing import Encoder, best_two_fit, pack_documents, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "a", "Word", "'s", "12", "é", "!", " ", "<|endoftext|>", "  ", " \n"]), max_size=14))
def test_encoder_equals_tokenizer(parts):
    text = "".join(parts)
    got = np.frombuffer(SHARED[0].encode([text])[0], "<u4").tolist()
    assert got == SHARED[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_encoder_equals_tokenizer_on_any_text(text):
    got = np.frombuffer(SHARED[0].encode([text])[0], "<u4").tolist()
    assert got == SHARED[1].encode(text, add_special_tokens=False).ids


def test_encoder_equals_tokenizer_on_every_character():
    """Each character of the fast encoder's alphabet beside letters, digits, signs and spaces."""
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)} .{chr(c)}\n{chr(c)} " for c in range(0x260)]
    texts += ["a" * 300_000, " " * 300_000 + "b", "x\n" * 50_000, "'s 't 'll'd'RE", "\u3000\u2003 é\u0301 ﬁ 𝟙 ٣"]
    want = [np.array(e.ids, "<u4").tobytes() for e in SHARED[1].encode_batch(texts, add_special_tokens=False)]
    assert SHARED[0].fast is not None and SHARED[0].encode(texts) == want


def test_encoder_of_another_kind_is_the_tokenizer_itself():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Encoder(path)
    assert own.fast is None
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert np.frombuffer(own.encode(["Some words, é."])[0], "<u4").tolist() == t.encode("Some words, é.", add_special_tokens=False).ids


SHARED = (Encoder(PATH), tokenizer())


def test_rows(spark):
    rows = tricky_docs(13) + [(3000, "one two three " * 300, None, None, None)]
    got = [r.asDict() for r in pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, 128, with_ids=True).collect()]
    t = tokenizer()
    want = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        n = len(ids)
        bounds = [0, *range(n % 128 or 128, n + 1, 128)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.03 * sum(r["length"] for r in got) / 128 + 1


def test_two_fit_beats_greedy_and_uses_every_piece():
    assert sorted(best_two_fit({6: 1, 3: 1, 4: 1}, 10)) == [([3], 1), ([6, 4], 1)]
    # greedy takes 7 and 2; the smallest, 2, gives way to the two pieces that fill its expanded gap of 3
    assert best_two_fit({7: 1, 2: 1, 1: 1}, 10) == [([7, 2, 1], 1)]
    assert best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    rng = random.Random(4)
    for _ in range(50):
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
        plan = best_two_fit(counts, 100)
        used = {}
        for filled, times in plan:
            assert sum(filled) <= 100
            for v in filled:
                used[v] = used.get(v, 0) + times
        assert used == counts


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    got = pack_documents(spark.createDataFrame([(1, None, "x")], "doc_id long, text string, salt string"), PATH).collect()
    assert [(r.length, r.offset) for r in got] == [(1, 0)]


def test_a_batch_is_tokenised_in_parts():
    class Rows:
        def mapInArrow(self, scan, ddl):
            return scan

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=800)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], ["id", "text"])
    scan = pieces(Rows(), PATH, 2048, False)
    next(scan([batch.slice(0, 1)]))  # the tokenizer itself
    tracemalloc.start()
    out = next(scan([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(out.column(0).to_pylist()) == set(range(2000)) and peak < batch.nbytes / 2
