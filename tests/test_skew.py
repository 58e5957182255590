"""Balanced joins and running numbers: every switch gives the same rows."""

import pytest
from dense import simulate
from pyspark.sql import functions as F
from test_mixed import cells_of

from swayline import skew
from swayline.operators import mixed, quantiles


@pytest.fixture
def lowered(monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(skew, "HOT_SHARE", 1 / 50)
    monkeypatch.setattr(skew, "SALTS", 7)


def rows(spark):
    keys = ["hot"] * 300 + [None] * 120 + ["b"] * 10 + ["c"] * 3
    data = [(k, i % 3, float(i)) for i, k in enumerate(keys)]
    return spark.createDataFrame(data, "k string, g int, v double")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("keys", [["k"], ["k", "g"]])
def test_attach_with_several_stats_rows_of_a_key(spark, lowered, monkeypatch, keys):
    frame = rows(spark)
    stats = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.explode(F.array(F.lit("low"), F.lit("high"))))
    salted = skew.attach(frame, stats, keys)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1_000_000)
    plain = skew.attach(frame, stats, keys)
    assert salted.count() == 2 * frame.count()
    assert same(salted, plain)


def test_quantiles_of_hot_keys(spark, lowered, monkeypatch):
    cells = quantiles.value_cells(rows(spark), ["k"], "v")
    want = quantiles.cell_quantiles(cells, ["k"], "v", [0.25, 0.5]).collect()
    monkeypatch.setattr(quantiles, "DIRECT_CELLS", 5)
    got = quantiles.cell_quantiles(cells, ["k"], "v", [0.25, 0.5]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_running_number_of_a_hot_missing_key(spark, lowered):
    frame = rows(spark)
    got = skew.running_number(frame, "k", ["g", "v"], "at")
    seen = {}
    for r in sorted(frame.collect(), key=lambda r: (str(r.k), r.g, r.v)):
        seen.setdefault(r.k, []).append((r.g, r.v))
    assert sorted(((r.k, r.at, r.v) for r in got.collect()), key=str) == sorted(
        ((k, i, v) for k, rs in seen.items() for i, (_, v) in enumerate(rs, 1)), key=str)


def test_running_number_inside_one_hot_cell(spark, lowered):
    """One key holds all rows of one date, a third of them equal in every ordering column."""
    data = [("hot", 1, float(max(i, 100))) for i in range(300)] + [("b", 1, 2.0)]
    frame = spark.createDataFrame(data, "k string, g int, v double").repartition(4)
    written = []
    keep = skew.materialise

    def spy(df, label="table"):
        table = keep(df, label)
        written.append((label, table))
        return table

    skew.materialise = spy
    try:
        got = skew.running_number(frame, "k", ["g", "v"], "at").collect()
    finally:
        skew.materialise = keep
    hot = sorted((r for r in got if r.k == "hot"), key=lambda r: r["at"])
    assert [r["at"] for r in hot] == list(range(1, 301))
    assert [r.v for r in hot] == sorted(v for k, _, v in data if k == "hot")
    assert [r["at"] for r in got if r.k == "b"] == [1]
    ranges = dict(written)["ranges"].groupBy("__range").count().collect()
    assert len(ranges) >= 12 and max(r["count"] for r in ranges) <= 4 * skew.HOT_ROWS


def test_a_bound_on_bytes_as_well_as_rows(spark, monkeypatch):
    frame = rows(spark)
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 64)
    assert not skew.small(frame, 2) and skew.small(frame, 1)


def test_a_covariate_that_varies_inside_an_entity_is_refused(spark):
    cells = cells_of(spark, simulate(3, groups=2, entities=4, rows=30))
    with pytest.raises(ValueError, match="constant within an entity"):
        mixed.fit_mixed(cells.withColumn("moved", F.col("x") * 2), mixed.Form(x="x", m="moved"))
