"""Small document sets with copies, shared passages, ties, repeated rows and odd texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tricky_docs(seed=3, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passages = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 120))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 90)))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(passages)
            if rng.random() < 0.5:  # a part of a passage
                words = piece.split()
                a = rng.randrange(len(words))
                piece = " ".join(words[a : a + rng.randint(1, 100)])
            parts.append(piece)
            parts.append(rng.choice([" ", "\n", "\t\n ", "  "]) + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))))
        texts.append(rng.choice([" ", "\n"]).join(parts))
    for _ in range(12):  # copies and near copies
        base = rng.choice(texts)
        words = base.split(" ")
        if len(words) > 3 and rng.random() < 0.6:
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", " \n ", "ab " * 300, "ab " * 200, "a" * 500, "a" * 400, None, "\x00" * 120 + "x" * 60, "\x00" * 130 + "x" * 55]
    rng.shuffle(texts)
    ids = rng.sample(range(-50, 1000), len(texts))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None if t is None else len(t)) for i, t in zip(ids, texts)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, texts[1], None, None, None))
    return rows
