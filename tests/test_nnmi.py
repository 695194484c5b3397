"""Mutual information with a numeric target, against all pairs in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaprism.frame import Frame, NotComputable
from metaprism.operators import nnmi, phases
from metaprism.session import written as session_written


def psi(m):
    return sum(1.0 / j for j in range(1, m)) - nnmi.EULER


def all_pairs(x, y, k):
    """The estimator over the full distance matrices of jittered coordinates."""
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    near = [((m < r[:, None]).sum(1) + (m.diagonal() >= r)) for m in (dx, dy)]
    return r, near, max(0.0, psi(len(x)) + psi(k) - np.mean([psi(int(a)) + psi(int(b)) for a, b in zip(*near)]))


def table(spark, n=700, seed=5):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n)
    cols = {"line": 2 * y, "noisy": y + rng.normal(size=n), "free": rng.normal(size=n), "steps": np.floor(3 * y),
            "hot": np.where(np.arange(n) % 3, 4.0, rng.normal(size=n)), "same": np.full(n, 2.0), "tail": rng.standard_cauchy(n)}
    rows = [(i, *[float(v[i]) for v in cols.values()], float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols) + ", y double")
    return Frame(df=df, num=tuple(cols), label="y", row_id="id")


def planes(fr, cols):
    rows = nnmi.plane_rows(fr, "y", cols).toPandas()
    return {c: rows[rows["attr"] == i].sort_values("id") for i, c in enumerate(cols)}


@pytest.mark.parametrize("k", [1, 3])
def test_equals_all_pairs(spark, k):
    fr = table(spark)
    cols = list(fr.num)
    got = {r["attr"]: r["mi"] for r in nnmi.mutual_info_numeric(fr, k=k, box_rows=50).collect()}
    assert list(got) == cols
    for c, p in planes(fr, cols).items():
        assert got[c] == pytest.approx(all_pairs(p["x"].to_numpy(), p["y"].to_numpy(), k)[2], abs=1e-9), c
    assert got["line"] > got["noisy"] > got["free"]


def test_radii_and_counts_of_every_row(spark):
    fr = table(spark, 400)
    near = nnmi.radii(nnmi.plane_rows(fr, "y", ["hot", "tail"]), 3, box_rows=20)
    r = {(t["attr"], t["id"]): t["r"] for t in near.collect()}
    m = {(t["attr"], t["id"], t["axis"]): t["m"] for t in nnmi.axis_counts(near).collect()}
    for a, p in enumerate(planes(fr, ["hot", "tail"]).values()):
        want, counts, _ = all_pairs(p["x"].to_numpy(), p["y"].to_numpy(), 3)
        for i, key in enumerate(p["id"]):
            assert r[a, key] == want[i]
            assert [m[a, key, "x"], m[a, key, "y"]] == [counts[0][i], counts[1][i]]


def test_few_rows_leave_their_box_and_ends_inside_runs_are_counted(spark):
    """Only rows near a box's edge are handed on, and with two runs a range most
    ends lie inside one."""
    fr = table(spark, 1500)
    rows = nnmi.plane_rows(fr, "y", ["free", "hot"])
    sent, visits = [], nnmi._reach
    with pytest.MonkeyPatch.context() as m:
        m.setattr(nnmi, "_reach", lambda boxes, first, skip: sent.append((first, skip)) or visits(boxes, first, skip))
        m.setattr(nnmi, "written", lambda df, tag: sent.append((tag, w := session_written(df, tag))) or w)
        near = nnmi.radii(rows, 3, box_rows=300)
    assert near.count() == 3000
    opened = {tag: df.count() for tag, df in sent if isinstance(tag, str)}
    assert 0 < opened["nnmi-open"] < 1500  # the rows that leave their box; all 3000 before
    m = {(t["attr"], t["id"], t["axis"]): t["m"] for t in nnmi.axis_counts(near, most_runs=2).collect()}
    r = {(t["attr"], t["id"]): t["r"] for t in near.collect()}
    for a, p in enumerate(planes(fr, ["free", "hot"]).values()):
        want, counts, _ = all_pairs(p["x"].to_numpy(), p["y"].to_numpy(), 3)
        assert [r[a, i] for i in p["id"]] == list(want)
        assert [m[a, i, "x"] for i in p["id"]] == list(counts[0])
        assert [m[a, i, "y"] for i in p["id"]] == list(counts[1])


def test_known_value(spark):
    """Two normals of correlation 0.9: -ln(1 - 0.81) / 2."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = 0.9 * x + math.sqrt(1 - 0.81) * rng.normal(size=3000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = nnmi.mutual_info_numeric(Frame(df=df, num=("x",), label="y")).first()["mi"]
    assert got == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.06)


def test_nulls_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(float(i), None if i % 2 else float(i), float("nan"), float(i * i)) for i in range(40)],
                               "a double, b double, c double, y double")
    fr = Frame(df=df, num=("a", "b", "c"), label="y")
    got = {r["attr"]: r["mi"] for r in nnmi.mutual_info_numeric(fr).collect()}
    alone = nnmi.mutual_info_numeric(Frame(df=df.where("b IS NOT NULL"), num=("b",), label="y")).first()["mi"]
    assert got["b"] == pytest.approx(alone, abs=0.05) and got["a"] > 0 and math.isnan(got["c"])
    none = nnmi.mutual_info_numeric(Frame(df=df.where("a < 0"), num=("a",), label="y")).collect()
    assert len(none) == 1 and math.isnan(none[0]["mi"])
    few = nnmi.mutual_info_numeric(Frame(df=df.where("a < 3"), num=("a",), label="y")).first()["mi"]
    assert math.isnan(few)
    assert nnmi.mutual_info_numeric(Frame(df=df, num=(), label="y")).collect() == []
    with pytest.raises(NotComputable):
        nnmi.mutual_info_numeric(Frame(df=df, num=("a",)))


def test_selection_with_a_numeric_target(spark):
    fr = table(spark, 300)
    fitted = phases.fit_select_mutual_info(fr, 0.5, task="regresion")
    out = fitted.transform(fr)
    assert "line" in out.num and "free" not in out.num and set(out.df.columns) >= {"id", "y"}


def test_digamma(spark):
    got = spark.range(1, 60).select(nnmi.digamma_of_counts(F.col("id")).alias("p")).collect()
    assert [r["p"] for r in got] == pytest.approx([psi(m) for m in range(1, 60)], abs=1e-11)
    assert nnmi._digamma(40) == pytest.approx(psi(40), abs=1e-12)
