"""Hard negatives through zone maps against brute force."""

import math

import numpy as np
import pytest

from faultloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, block string, ident int, score string, at int, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "b", 1, "s", 2, "d") for i, v, l in rows], SCHEMA).repartition(5)


def mined(spark, rows, **options):
    got = hn.mine(frame(spark, rows), lambda ident: ident % 10 == 0, **options).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def brute(rows, positives=5, negatives=3, window=(50, 95)):
    points = {}
    for ident, v, label in rows:
        if ident is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(x * 256) for x in v]
        if sum(x * x for x in q) >= 1 << 62:
            continue
        # Of an id's rows the one with the least label is taken; the tests give such rows one vector each.
        points[ident] = min(points.get(ident, (label, q)), (label, q))
    out = []
    for a, (label, q) in points.items():
        if a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(q, r)), b, m) for b, (m, r) in points.items() if b != a and len(r) == len(q)]
        for s, b, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = [x for x in scored if x[2] != label and window[0] * -s <= 100 * -x[0] <= window[1] * -s]
            out += [(a, b, rank, n, -s, -t) for rank, (t, n, _) in enumerate(sorted(fits)[:negatives], 1)]
    return sorted(out)


def rows_of(seed, count=260, dims=5, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dims))
    return [(i, (centres[i % 9] + 0.2 * rng.standard_normal(dims)).round(1).tolist(), int(rng.integers(labels))) for i in range(count)]


def odd():
    nan = float("nan")
    return [
        (1000, None, 0), (1010, [], 0), (1020, [0.0] * 5, 0), (1030, [None] + [1.0] * 4, 0), (1040, [nan] * 5, 1), (1050, [float("-inf")] * 5, 1),
        (None, [1.0] * 5, 0), (1060, [1.0] * 5, None), (1070, [1.0] * 3, 0), (1071, [1.0] * 3, 0), (1072, [0.8] * 3, 1), (1080, [1.0] * 5, 2),
        (1080, [1.0] * 5, 1), (1080, [1.0] * 5, 1), (1090, [1e6] * 5, 0), (1091, [2e6] * 5, 0), (1092, [7e5] * 5, 1), (1100, [1e300] * 5, 0),
        (1110, [3e6, -3e6, 1.0, 0.0, 0.0], 3), (1111, [3e6, -2999999.0, 1.0, 0.0, 0.0], 3), (1112, [2e6, -1e6, 1.0, 0.0, 0.0], 2), (-10, [0.5] * 5, 2),
    ]


@pytest.mark.parametrize("sizes", [(hn.BLOCK_BYTES, hn.GROUP_BYTES), (80, 40)])
def test_negatives_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(hn, "ZONES", 7)
    monkeypatch.setattr(hn, "SLICE", 3)
    rows = rows_of(1) + odd()
    want = brute(rows)
    assert len(want) > 200
    assert mined(spark, rows, block_bytes=sizes[0], group_bytes=sizes[1]) == want


def test_ties_and_few_rows(spark):
    """Equal scores everywhere, fewer positives and negatives than asked for, a label on its own."""
    same = [(i, [1.0, 1.0], i % 2) for i in range(0, 60)] + [(100 + i, [0.75, 0.75], 5) for i in range(9)] + [(200, [1.0, 1.0], 7)]
    assert mined(spark, same, block_bytes=40, group_bytes=20) == brute(same)
    few = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.7, 0.2], 2), (3, [-1.0, 0.0], 2)]
    assert mined(spark, few, positives=4, negatives=9, window=(10, 100)) == brute(few, 4, 9, (10, 100)) != []


def test_empty_and_anchorless_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0), (3, [0.6], 1)]) == []


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_stepwise(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    place = hn.hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(1 << (bits * dims)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_and_needed_blocks_are_enough(seed):
    """A block that is left out could not have changed any window's best rows."""
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(-200, 200, 8) + rng.integers(-20, 20, (int(rng.integers(1, 9)), 8)) for _ in range(60)]
    anchors = rng.integers(-200, 200, (20, 8)).astype(float)
    low, high = (np.array([f(b, axis=0) for b in blocks], float) for f in (np.min, np.max))
    least, most = hn.bounds(anchors, low, high)
    lo = rng.integers(-40_000, 60_000, (20, 3))
    hi = lo + rng.integers(-100, 50_000, (20, 3))
    must = hn.needed(least, most, np.array([len(b) for b in blocks]), lo, hi, 2)
    for a in range(20):
        scores = [b @ anchors[a] for b in blocks]
        for s, l, m in zip(scores, least[a], most[a]):
            assert l <= s.min() and s.max() <= m
        for w in range(3):
            def best(which):
                return sorted((x for n in which for x in scores[n] if lo[a, w] <= x <= hi[a, w]), reverse=True)[:2]

            assert best(range(60)) == best(np.flatnonzero(must[a]))
    assert 0 < must.mean() < 0.9


def test_zone_maps_leave_most_blocks_unread(spark, monkeypatch):
    """On clustered vectors an anchor group's search for positives reads few of its label's blocks."""
    read = []
    real = hn.written
    monkeypatch.setattr(hn, "written", lambda df, name: read.append((name, real(df, name))) or read[-1][1])
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.01 * rng.standard_normal(16)).tolist(), 0) for i in range(4000)]
    hn.mine(frame(spark, rows), lambda ident: ident % 50 == 0, block_bytes=32 * 25, group_bytes=32 * 2).collect()
    tables = dict(reversed(read))
    all_pairs = tables["groups"].count() * tables["blocks"].count()
    assert tables["chosen"].count() < 0.25 * all_pairs
