"""Random series against plain loops."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from gridseries import operators as ops
from gridseries.plans import build_anomaly_table
from gridseries.operators import explore

START = dt.date(1999, 11, 20)


def make_series(seed, n_series=8, n_days=120):
    """``{key: {date: value or None}}`` with absent days, missing values at the
    ends and in the middle, and one series without any value."""
    rng = random.Random(seed)
    made = {}
    for key in range(n_series):
        rows = {}
        for i in range(n_days):
            day = START + dt.timedelta(days=i)
            if rng.random() < 0.25:
                continue
            missing = key == 0 or rng.random() < 0.3 or i < key or i > n_days - key
            rows[day] = None if missing else rng.gauss(15, 4)
        made[key] = rows
    return made


def to_frame(spark, made):
    rows = [(k, d, v) for k, series in made.items() for d, v in series.items()]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "k int, date date, sst_celsius double").repartition(3)


def days_of(rows):
    first, last = min(rows), max(rows)
    return [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]


def fill(rows, limit):
    """``{date: (value, interpolated)}`` on the full calendar."""
    days = days_of(rows)
    valid = [d for d in days if rows.get(d) is not None]
    out = {}
    for d in days:
        value = rows.get(d)
        before = max((x for x in valid if x < d), default=None)
        after = min((x for x in valid if x > d), default=None)
        if value is None and before and after and (d - before).days <= limit:
            step = (rows[after] - rows[before]) / (after - before).days
            out[d] = (rows[before] + step * (d - before).days, True)
        else:
            out[d] = (value, False)
    return out


def close(a, b):
    return (a is None and b is None) or (
        a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    )


@pytest.mark.parametrize("limit", [0, 1, 3, 7])
def test_fill(spark, limit):
    made = make_series(limit)
    got = ops.regularize_and_fill(to_frame(spark, made), keys=["k"], max_gap_days=limit).collect()
    expected = {(k, d): x for k, rows in made.items() for d, x in fill(rows, limit).items()}
    assert len(got) == len(expected)
    for row in got:
        value, flag = expected[row.k, row.date]
        assert close(row.sst_celsius, value) and row.is_interpolated is flag


@pytest.mark.parametrize("season", ["dayofyear", "month"])
def test_anomaly_table(spark, season):
    made = make_series(5, n_days=800)
    start, end = dt.date(1999, 12, 1), dt.date(2001, 1, 15)
    got = build_anomaly_table(
        to_frame(spark, made),
        keys=["k"],
        max_gap_days=2,
        climatology=season,
        reference_start="1999-12-01",
        reference_end="2001-01-15",
    ).collect()

    def key(d):
        return d.month if season == "month" else (d.month, d.day)

    seen = 0
    for k, rows in made.items():
        filled = fill(rows, 2)
        groups = {}
        for d, (value, _) in filled.items():
            if value is not None and start <= d <= end:
                groups.setdefault(key(d), []).append(value)
        for row in (r for r in got if r.k == k):
            seen += 1
            value, _ = filled[row.date]
            group = groups.get(key(row.date))
            mean = sum(group) / len(group) if group else None
            assert close(row.climatology_celsius, mean)
            both = value is not None and mean is not None
            assert close(row.anomaly_celsius, value - mean if both else None)
    assert seen == len(got) == sum(len(days_of(rows)) for rows in made.values())


def test_joined_and_windowed_climatology_agree(spark):
    frame = to_frame(spark, make_series(6, n_days=500))
    options = {"keys": ["k"], "reference_start": "1999", "reference_end": "2000-06"}
    mapped, _ = ops.calculate_climatology(frame, **options)
    windowed = ops.with_climatology(frame, **options).drop("sst_celsius")
    a = {(r.k, r.date): r.climatology_celsius for r in mapped.collect()}
    b = {(r.k, r.date): r.climatology_celsius for r in windowed.collect()}
    assert a.keys() == b.keys() and all(close(a[x], b[x]) for x in a)


@pytest.mark.parametrize("fraction", [0.1, 0.2, 0.35, 0.9])
def test_forecast(spark, fraction):
    made = make_series(9)
    frame = to_frame(spark, made)
    test, metadata = ops.evaluate_persistence(
        frame, keys=["k"], value="sst_celsius", test_fraction=fraction
    )
    predictions = ops.persistence_predictions(frame, keys=["k"], value="sst_celsius").collect()
    expected, every = {}, {}
    for k, rows in made.items():
        days = days_of(rows)
        split = max(1, int(len(days) * (1 - fraction)))
        for i, d in enumerate(days):
            before = rows.get(d - dt.timedelta(days=1))
            every[k, d] = before
            if i >= split and rows.get(d) is not None and before is not None:
                expected[k, d] = (rows[d], before)
    assert {(r.k, r.date): r.predicted_anomaly_celsius for r in predictions} == every
    got = {
        (r.k, r.date): (r.observed_anomaly_celsius, r.predicted_anomaly_celsius)
        for r in test.collect()
    }
    assert got == expected
    described = metadata.collect()
    assert {row.k for row in described} == {k for k, rows in made.items() if rows}
    for row in described:
        pairs = {d: v for (k, d), v in expected.items() if k == row.k}
        errors = [p - o for o, p in pairs.values()]
        assert row.metrics.n == len(errors)
        if not errors:
            assert row.metrics.mae is row.metrics.rmse is row.test_start is row.test_end is None
            continue
        assert math.isclose(row.metrics.mae, sum(map(abs, errors)) / len(errors))
        assert math.isclose(row.metrics.rmse, math.sqrt(sum(e * e for e in errors) / len(errors)))
        assert (row.test_start, row.test_end) == (str(min(pairs)), str(max(pairs)))


@pytest.mark.parametrize("block", [8, 50, 8192])
def test_autocorrelation(spark, monkeypatch, block):
    monkeypatch.setattr(explore, "ACF_BLOCK", block)
    made = make_series(11, n_days=150)
    got = ops.autocorrelation(
        to_frame(spark, made), keys=["k"], value="sst_celsius", max_lags=30
    ).collect()
    seen = 0
    for k, rows in made.items():
        x = np.array([rows[d] for d in sorted(rows) if rows[d] is not None])
        c = x - x.mean() if len(x) else x
        lags = range(1, min(30, len(x) // 2 - 1) + 1)
        mine = {r.lag: r for r in got if r.k == k}
        assert sorted(mine) == list(lags)
        for lag in lags:
            seen += 1
            assert math.isclose(mine[lag].acf, (c[lag:] @ c[:-lag]) / (c @ c), abs_tol=1e-12)
            assert mine[lag].n == len(x)
    assert seen > 100


def test_histogram(spark):
    rng = random.Random(3)
    # Values on a coarse lattice, so that many fall on a bin edge.
    rows = [(k, rng.randrange(-30, 31) / 10) for k in range(4) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k int, x double").repartition(3)
    got = ops.histogram(frame, keys=["k"], value="x", bins=20).collect()
    for k in range(4):
        counts, edges = np.histogram([x for key, x in rows if key == k], bins=20)
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.bin)
        assert [r["count"] for r in mine] == counts.tolist()
        assert [r.left_edge for r in mine] == pytest.approx(edges[:-1].tolist())
        assert [r.right_edge for r in mine] == pytest.approx(edges[1:].tolist())


def test_density(spark):
    rng = random.Random(4)
    # Two far groups: most places are out of reach of most kernels.
    rows = [(k, rng.gauss(1000 * (i % 2), 0.001)) for k in range(3) for i in range(500)]
    frame = spark.createDataFrame(rows, "k int, x double").repartition(3)
    got = ops.density_curve(frame, keys=["k"], value="x").collect()
    for k in range(3):
        x = np.array([v for key, v in rows if key == k])
        h = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 200)
        kernel = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1)
        expected = kernel * (x.max() - x.min()) / 50 / (h * math.sqrt(2 * math.pi))
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.point)
        assert [r.x for r in mine] == pytest.approx(grid.tolist())
        assert [r.density for r in mine] == pytest.approx(expected.tolist(), rel=1e-9, abs=1e-300)


def test_density_where_kernels_do_not_reach(spark):
    """A narrow bandwidth leaves places without any kernel: zero, not absent."""
    rows = [(0.0,)] * 100_000 + [(1.0,)]
    frame = spark.createDataFrame(rows, "x double")
    got = sorted(ops.density_curve(frame, value="x").collect(), key=lambda r: r.point)
    x = np.array([r[0] for r in rows])
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(0, 1, 200)
    kernel = 100_000 * np.exp(-0.5 * (grid / h) ** 2) + np.exp(-0.5 * ((grid - 1) / h) ** 2)
    expected = kernel / 50 / (h * math.sqrt(2 * math.pi))
    assert (expected == 0).any()
    assert [r.density for r in got] == pytest.approx(expected.tolist(), rel=1e-9, abs=1e-300)
