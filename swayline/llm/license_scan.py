"""License scans: Dice coefficient over word bigrams between normalised text units and license templates.

Units of a document are its lines, its paragraphs of several lines (parted by blank lines) and, if it
has several lines, the whole text, so a notice is found alone on a line, wrapped over lines, or as the
document itself. A unit and a template are normalised alike: lower case, runs of characters that are
no letters or digits become one space. Both become sets of word bigrams (a single word is a bigram
with nothing). The coefficient 2 |A and B| / (|A| + |B|) can reach ``threshold`` only if |A| lies
between |B| t / (2 - t) and |B| (2 - t) / t: templates outside these bounds are not compared.

Only DataFrame functions run. Templates are part of the program, a fixed list. Defined results: a
missing or empty text has no unit and no license; equal scores go to the template first by id; repeated
rows give repeated results; other columns do not take part.
"""

import re

from pyspark.sql import functions as F

#: Notices and permission texts of common public licenses.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
        "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-3-clause-notice": "Licensed under the BSD 3-Clause License.",
    "bsd-2-clause-notice": "Licensed under the BSD 2-Clause License.",
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0-notice": "Licensed under CC0 1.0 Universal.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}
THRESHOLD = 0.8


def template_bigrams(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, [*words[1:], ""][: max(1, len(words) - 1)])})


def normalised(text):
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))


def bigrams(words):
    """Distinct word bigrams of an array of words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(F.transform(words, lambda w: F.concat(w, F.lit(" ")))))


def bound(value, use):
    """``use(value)`` with the value computed once, however often it is used and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def units(text):
    """(kind, number, text) of the units of a text."""
    of = lambda kind, array: F.transform(array, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), x.alias("unit")))
    paragraphs = F.filter(F.split(text, "\n[ \\t\\r]*\n"), lambda p: p.contains("\n") & (p != text))
    whole = F.when(text.contains("\n"), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(of("line", F.split(text, "\n")), of("paragraph", paragraphs), of("text", whole))


def license_matches(docs, threshold=THRESHOLD, templates=None, id_col="doc_id", text_col="text"):
    """(id, kind, number, license, score): units that reach the threshold, with their best template."""
    templates = {k: template_bigrams(v) for k, v in (TEMPLATES if templates is None else templates).items()}
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = F.array(*[
        F.struct(F.lit(k).alias("license"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("pairs")) for k, b in sorted(templates.items())
    ])
    least, most = min(map(len, templates.values())) * low, max(map(len, templates.values())) * high
    rows = docs.select(F.col(id_col).alias("id"), F.explode(units(F.coalesce(F.col(text_col), F.lit("")))).alias("u"))

    def best(pairs):
        n = F.size(pairs)
        near = F.filter(known, lambda t: (n >= t["n"] * low - 1e-9) & (n <= t["n"] * high + 1e-9))
        scored = F.transform(
            near,
            lambda t: F.struct((-2.0 * F.size(F.array_intersect(pairs, t["pairs"])) / (n + t["n"])).alias("minus"), t["license"].alias("license")),
        )
        # the highest score, then the first id
        return F.when(n.between(least, most), F.array_min(F.filter(scored, lambda s: s["minus"] <= -threshold)))

    # words are one more than bigrams, so a unit with too few words is out before they are made
    enough = lambda words: (F.size(words) >= least) & (F.get(words, F.lit(0)) != "")
    found = bound(F.split(normalised(F.col("u.unit")), " "), lambda words: F.when(enough(words), bound(bigrams(words), best)))
    rows = rows.select("id", "u.kind", "u.number", found.alias("best")).where("best is not null")
    return rows.select("id", "kind", "number", F.col("best.license").alias("license"), (-F.col("best.minus")).alias("score"))


def license_scan(docs, threshold=THRESHOLD, templates=None, id_col="doc_id", text_col="text"):
    """One row per document id: license (best, or NULL), score (0.0 without one), n_matches, licenses (all found)."""
    found = license_matches(docs, threshold, templates, id_col, text_col).groupBy("id").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"), F.count(F.lit(1)).alias("n_matches"),
        F.sort_array(F.collect_set("license")).alias("licenses"),
    )
    ids = docs.select(F.col(id_col).alias("doc"))
    joined = ids.join(found, F.col("doc").eqNullSafe(F.col("id")), "left")
    return joined.select(
        F.col("doc").alias(id_col), F.col("best.license").alias("license"), F.coalesce(-F.col("best.minus"), F.lit(0.0)).alias("score"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.array_join("licenses", ",").alias("licenses"),
    )


def op10_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql():
    rows = ", ".join("('{}', [{}])".format(k, ", ".join("'" + p.replace("'", "''") + "'" for p in template_bigrams(v))) for k, v in sorted(TEMPLATES.items()))
    return f"""
WITH known(license, pairs) AS (VALUES {rows}),
texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM texts
  UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, text, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS unit FROM texts)
    WHERE contains(unit, chr(10)) AND unit <> text
  UNION ALL SELECT doc_id, text FROM texts WHERE contains(text, chr(10))),
units AS (
  SELECT row_number() OVER () AS u, doc_id, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM parts),
pairs AS (
  SELECT u, doc_id, list_distinct(CASE WHEN len(words) > 1 THEN [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))] ELSE [words[1] || ' '] END) AS pairs
  FROM units WHERE words[1] <> ''),
exploded AS (SELECT u, unnest(pairs) AS pair FROM pairs),
known_pairs AS (SELECT license, unnest(pairs) AS pair FROM known),
common AS (SELECT u, license, count(*) AS n FROM exploded JOIN known_pairs USING (pair) GROUP BY ALL),
scored AS (
  SELECT p.doc_id, b.u, b.license, 2.0::DOUBLE * b.n / (len(p.pairs) + len(k.pairs)) AS score
  FROM common b JOIN pairs p USING (u) JOIN known k USING (license) WHERE 2.0::DOUBLE * b.n / (len(p.pairs) + len(k.pairs)) >= {THRESHOLD}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, license) AS place FROM scored) WHERE place = 1),
docs AS (
  SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, max(score) AS score,
         arg_min(license, (-score, license)) AS license FROM best GROUP BY doc_id)
SELECT d.doc_id, b.license, coalesce(b.score, 0.0)::DOUBLE AS score, coalesce(b.n_matches, 0)::BIGINT AS n_matches, b.licenses
FROM documents d LEFT JOIN docs b ON d.doc_id = b.doc_id
"""


SQL = _sql()
