"""Cover-tree near-duplicates and vector codes against brute force."""

import hashlib
import math

import numpy as np
import pytest

from faultloom.llm import cover_tree, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, key string, cell string, dim int, code string, weight double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "k", "c", 7, "x", 0.5) for i, v, l in rows], SCHEMA).repartition(4)


def clustered(seed, groups=12, dims=6, spread=0.05):
    rng = np.random.default_rng(seed)
    rows, ident = [], 0
    for g in range(groups):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 60))):
            rows.append((ident, (centre * rng.uniform(0.5, 2) + spread * rng.standard_normal(dims)).tolist(), g % 3))
            ident += 1
    return rows


def odd():
    nan, inf = float("nan"), float("inf")
    return [
        (5000, None, 0), (5001, [], 0), (5002, [0.0] * 6, 0), (5003, [None] + [1.0] * 5, 0), (5004, [nan] * 6, 0),
        (5005, [inf] + [0.0] * 5, 0), (None, [1.0] * 6, 0), (5006, [1.0] * 6, None), (5007, [1.0] * 6, 0), (5008, [2.0] * 6, 0),
        (5009, [1.0] * 6, 1), (5007, [1.0] * 6, 0), (5010, [1e200] * 6, 1), (5011, [1e-200] * 6, 1), (5012, [1.0] * 3, 0),
        (5013, [1.0, 1.0, 1.0], 0), (5010, [-1.0] * 6, 2),
    ]


def usable(row):
    ident, v, label = row
    return ident is not None and label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_links(rows, threshold):
    """{row: (n_links, component_id)} by all pairs and a flood fill."""
    ok = [r for r in rows if usable(r)]
    key = {id(r): (r[2], tuple(cover_tree.unit(np.array([r[1]]))[0] + 0.0)) for r in ok}
    classes = {}
    for r in ok:
        classes.setdefault(key[id(r)], set()).add(r[0])
    near = {k: [j for j in classes if j[0] == k[0] and len(j[1]) == len(k[1]) and (j == k or np.dot(j[1], k[1]) >= threshold)] for k in classes}
    component = {}
    for k in classes:
        if k in component:
            continue
        seen, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(i for j in seen for i in classes[j])
        component |= dict.fromkeys(seen, least)
    out = []
    for r in rows:
        k = key.get(id(r))
        out.append((r[0], 0, r[0]) if k is None else (r[0], sum(len(classes[j]) for j in near[k]) - 1, component[k]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [cover_tree.BLOCK_BYTES, 1])
@pytest.mark.parametrize("threshold", [0.98, 0.9])
def test_links_equal_brute_force(spark, monkeypatch, block_bytes, threshold):
    monkeypatch.setattr(cover_tree, "VISITORS", 2)
    rows = clustered(3) + odd()
    got = cover_tree.near_duplicates(frame(spark, rows), threshold=threshold, block_bytes=block_bytes).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=repr) == brute_links(rows, threshold)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_chains_over_blocks_are_one_component(spark):
    """A ring of vectors, each near the next one only, cut into many blocks."""
    turn = 2 * math.pi / 600
    rows = [((i * 7) % 600 + 1, [math.cos(i * turn), math.sin(i * turn), 0.0], 4) for i in range(600)]
    got = cover_tree.near_duplicates(frame(spark, rows), threshold=math.cos(1.5 * turn), block_bytes=1).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2, 1)}


def test_split_cells_without_end_stay_whole(spark, monkeypatch):
    """When splitting stops early, cells are cut into several blocks and lose no link."""
    monkeypatch.setattr(cover_tree, "ROUNDS", 0)
    rows = clustered(8, groups=6)
    got = cover_tree.near_duplicates(frame(spark, rows), block_bytes=1).collect()
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=repr) == brute_links(rows, 0.98)


@pytest.mark.parametrize("seed", range(4))
def test_tree_covers_its_points(seed):
    rng = np.random.default_rng(seed)
    points = cover_tree.unit(np.concatenate([rng.standard_normal((400, 8)), 1 + 0.02 * rng.standard_normal((400, 8))]))
    order, nodes, radii = cover_tree.build(points)
    assert sorted(order) == list(range(800))
    ordered = points[order]
    for (start, end, first, count), radius in zip(nodes, radii):
        assert cover_tree.gaps(ordered[start:end], ordered[start : start + 1]).max() <= radius + 1e-7
        if count:
            children = nodes[first : first + count]
            assert children[0][0] == start and children[-1][1] == end
            heads = ordered[children[:, 0]]
            scale = 2.0 ** (math.ceil(math.log2(radius)) - 1)
            assert radii[first : first + count].max() <= scale + 1e-7
            between = cover_tree.gaps(heads, heads) + 9 * np.eye(len(heads))
            assert between.min() > scale - 1e-7


def test_bounds_leave_out_most_pairs(monkeypatch):
    """Far clusters are pruned by their radii: few distances are computed."""
    rng = np.random.default_rng(1)
    centres = cover_tree.unit(rng.standard_normal((40, 32)))
    points = cover_tree.unit(np.repeat(centres, 50, axis=0) + 0.002 * rng.standard_normal((2000, 32)))
    order, nodes, radii = cover_tree.build(points)
    compared = []
    real = cover_tree.np.matmul
    weights = np.ones(2000, np.int64)
    tree = cover_tree.Tree(b"".join(int(i).to_bytes(16, "big") for i in order), weights.tobytes(), points[order].tobytes(), nodes.tobytes(), radii.tobytes())

    class Counted(np.ndarray):
        def __matmul__(self, other):
            compared.append(self.shape[0] * np.asarray(other).shape[1])
            return np.asarray(self) @ np.asarray(other)

    tree.points = tree.points.view(Counted)
    counts, _, forest = cover_tree.links(tree, tree, 0.98)
    near = (points @ points.T >= 0.98).sum(axis=1) - 1
    assert (counts == near[order]).all() and real is np.matmul
    assert sum(compared) < 0.05 * 2000 * 2000 / 2


def brute_codes(rows, parts, entries, rounds):
    """Complete scans with Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    q = [[max(-(1 << 53), min(1 << 53, math.floor(x * 256) if abs(x) < 1e300 else int(math.copysign(1 << 53, x)))) for x in r[1]] for r in kept]
    least = {}
    for r, v in zip(kept, q):
        if r[0] is not None:
            least[r[0]] = min(least.get(r[0], v), v)
    first = [least[i] for i in sorted(least)[:entries]]
    dim = len(first[0])
    own = vector_codes.cuts(dim, parts)
    books = [[v[c] for v in first if len(v) == dim] for c in own]

    def assign():
        out = []
        for v in q:
            out.append(None if len(v) != dim else [min((sum((a - b) ** 2 for a, b in zip(v[c], e)), k) for k, e in enumerate(book)) for c, book in zip(own, books)])
        return out

    for _ in range(rounds):
        found = assign()
        for p, c in enumerate(own):
            for k in range(len(books[p])):
                mine = [v[c] for v, f in zip(q, found) if f and f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    errors = [None if f is None else min(sum(d for d, _ in f), vector_codes.LONG) for f in found]
    by_label = {}
    for r, e in zip(kept, errors):
        if e is not None:
            by_label[r[2]] = min(by_label.get(r[2], 0) + e, 10**37)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        [(r[0], None if f is None else "".join(f"{k:02x}" for _, k in f), e, min(by_label[r[2]], vector_codes.LONG) if r[2] in by_label else None, sha)
         for r, f, e in zip(kept, found, errors)], key=repr)


@pytest.mark.parametrize("dims,parts,entries,rounds", [(8, 4, 8, 2), (7, 3, 16, 4), (6, 6, 300 - 44, 1), (16, 16, 64, 3)])
def test_codes_equal_complete_scans(spark, dims, parts, entries, rounds):
    rng = np.random.default_rng(dims)
    rows = [(i, (rng.integers(-3, 4, dims) / 256 * rng.integers(1, 30)).tolist(), int(i % 5) or None) for i in range(300)]
    rows += [(-5, [1.0] * dims, 1), (-5, [0.5] * dims, 1), (None, [0.25] * dims, None), (7, [1.0] * (dims + 1), 2), (900, [None] * dims, 1)]
    rows += [(901, None, 1), (902, [float("inf")] * dims, 1), (903, [3e6] * dims, 3), (904, [-1e308] * dims, 4), (905, rows[5][1], 1)]
    got = vector_codes.compress(frame(spark, rows), parts=parts, entries=entries, rounds=rounds).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_codes(rows, parts, entries, rounds)


def test_active_entries_equal_full_scans():
    """Random moves of entries with many equal distances: the short way gives what the complete scan gives."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        q = rng.integers(-4, 5, (60, 3)).astype(float)
        old = rng.integers(-4, 5, (9, 3)).astype(float)
        code, far = vector_codes.assign(q, old, None, None, None)
        new = old.copy()
        moved = rng.random(9) < 0.4
        new[moved] += rng.integers(-2, 3, (int(moved.sum()), 3))
        moved = (new != old).any(axis=1)
        fast = vector_codes.assign(q, new, code, far, moved)
        full = vector_codes.assign(q, new, None, None, None)
        assert (fast[0] == full[0]).all() and (fast[1] == full[1]).all()


def test_empty_embedding_tables(spark):
    none = frame(spark, [])
    assert cover_tree.near_duplicates(none).count() == 0
    assert vector_codes.compress(none).count() == 0
    lone = frame(spark, [(None, [1.0, 2.0], 1), (None, None, None)])
    assert [tuple(r)[:4] for r in vector_codes.compress(lone).collect()] == [(None, None, None, None)]
    assert {tuple(r) for r in cover_tree.near_duplicates(lone).collect()} == {(None, 0, None, True)}
