"""License scans: against plain Python, bounds, odd input."""

import re

from fixtures import SCHEMA, tricky_docs

from swayline.llm.license_scan import TEMPLATES, license_scan, template_bigrams


def plain(text, templates, t=0.8):
    units = text.split("\n")
    units += [p for p in re.split(r"\n[ \t\r]*\n", text) if "\n" in p and p != text]
    units += [text] if "\n" in text else []
    found = []
    for unit in units:
        if not re.sub(r"[\W_]+", " ", unit).strip():
            continue
        a = set(template_bigrams(unit))
        scores = sorted((-2 * len(a & set(b)) / (len(a) + len(b)), k) for k, b in templates.items())
        if -scores[0][0] >= t:
            found.append(scores[0])
    return (min(found)[1], -min(found)[0], len(found)) if found else (None, 0.0, 0)


def test_against_plain_python(spark):
    rows = {r[0]: r for r in tricky_docs(2) if r[0] is not None}
    bases = list(TEMPLATES.values())
    extra = [f"Some text\n{b}" for b in bases] + [b.replace(" ", "\n", 3).upper() for b in bases] + ["All rights", "MIT", "all reserved rights all rights reserved", "\n\n", " * Licensed under CC BY-ND 4.0 *\n\nmore\ntext\n \nReleased under\nthe MIT License"]
    docs = [(i, r[1]) for i, r in rows.items()] + [(5000 + i, t) for i, t in enumerate(extra)]
    templates = {k: template_bigrams(v) for k, v in TEMPLATES.items()}
    got = {r.doc_id: (r.license, r.score, r.n_matches) for r in license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        want = plain(text or "", templates)
        assert got[i][0] == want[0] and got[i][2] == want[2] and abs(got[i][1] - want[1]) < 1e-12, (i, text)
    assert got[5000][0] is not None


def test_odd_input(spark):
    assert license_scan(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(None, "Released under the MIT License.", "x"), (1, None, "y"), (1, None, "y")], "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.license, r.n_matches) for r in license_scan(docs).collect()), key=str)
    assert got == [(1, None, 0), (1, None, 0), (None, "mit-notice", 1)]
