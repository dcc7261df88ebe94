"""Street measurements and plane fits against scenes whose figures are known."""

import numpy as np
import pytest

from sluice.operators import grid, measure


def street(angle, kerb, pole=None, width=3.0, length=20.0, n=25_000):
    """Random points of a road, a kerb and a footpath of some width along a heading, with a pole at (u, v) if given."""
    rng = np.random.default_rng(angle)
    u, v = rng.uniform(0, length, n), rng.uniform(-3, width, n)
    z = np.where(v > 0, kerb, 0.0) + rng.normal(0, 0.003, n)
    if pole:
        u, v, z = np.append(u, pole[0] + rng.uniform(-0.3, 0.3, 900)), np.append(v, pole[1] + rng.uniform(-0.1, 0.1, 900)), np.append(z, kerb + rng.uniform(0.2, 2.0, 900))
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    return np.stack([u * c - v * s, u * s + v * c, z], axis=1).tolist()


@pytest.fixture(scope="module")
def results(spark):
    scenes = {1: street(30, 0.12, pole=(10.0, 1.0)), 2: street(96, 0.15), 3: street(0, 0.0), 4: street(45, 0.10, width=1.0)}
    rows = [(k, i, *p) for k, pts in scenes.items() for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "scan int, pid long, x double, y double, z double").repartition(4)
    return {r.scan: r for r in measure.measured(df).collect()}


def test_heading_and_kerb(results):
    assert results[1].angle == 30 and results[1].kerb_m == pytest.approx(0.12, abs=0.01)
    assert results[2].angle == 96 and results[2].kerb_m == pytest.approx(0.15, abs=0.01)
    assert results[1].length_m == pytest.approx(20, abs=0.3)


def test_clear_width_beside_a_pole(results):
    assert results[1].clear_m == pytest.approx(2.9, abs=0.25)
    assert results[1].min_clear_m == pytest.approx(1.9, abs=0.25)
    assert results[2].min_clear_m == pytest.approx(2.9, abs=0.25)
    assert results[1].refused is None and results[2].refused is None


def test_refused_scans(results):
    assert results[3].refused == "no kerb found" and results[3].angle is None
    assert results[4].refused == "implausible width"


def test_robust_plane_leaves_outliers_out(spark):
    rows = [(1, i, (i % 40) * 0.5, (i // 40) * 0.5, 0.02 * (i % 40) * 0.5 - 0.01 * (i // 40) * 0.5 + 1.0 + (6.0 if i % 10 == 3 else 0.0)) for i in range(1600)]
    r = grid.robust_plane(spark.createDataFrame(rows, "scan int, pid long, x double, y double, z double")).first()
    got = sorted([r.a, r.b, r.c], key=abs)
    assert got == pytest.approx([-0.01, 0.02, 1.0], abs=0.02)
