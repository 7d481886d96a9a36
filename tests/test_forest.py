from __future__ import annotations

import numpy as np

from fleetpulse.functions.forest import expected_path, fit_forest, pack_forest, score_forest, unpack_forest


def walk(forest, tree: int, x: np.ndarray) -> float:
    node, depth = 0, 0
    while forest.feature[tree, node] >= 0:
        f = forest.feature[tree, node]
        node = 2 * node + (1 if x[f] <= forest.threshold[tree, node] else 2)
        depth += 1
    return depth + float(expected_path(forest.size[tree, node]))


def test_expected_path_values():
    np.testing.assert_allclose(expected_path(np.array([0, 1, 2])), [0.0, 0.0, 1.0])
    assert abs(float(expected_path(256)) - 10.2447) < 1e-3


def test_leaves_hold_every_drawn_row_once():
    x = np.random.default_rng(0).normal(size=(700, 12))
    forest = fit_forest(x, 30, 256, 42)
    leaf = (forest.feature < 0) & (forest.size > 0)
    assert ((forest.size * leaf).sum(axis=1) == 256).all()
    inner = forest.feature >= 0
    trees, nodes = np.nonzero(inner)
    assert (
        forest.size[trees, nodes] == forest.size[trees, 2 * nodes + 1] + forest.size[trees, 2 * nodes + 2]
    ).all()
    assert (forest.size[trees, 2 * nodes + 1] > 0).all() and (forest.size[trees, 2 * nodes + 2] > 0).all()


def test_scores_equal_a_walk_down_each_tree():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)).astype(np.float32).astype(float)
    forest = fit_forest(x, 25, 256, 42)
    got = score_forest(forest, x[:20])
    for i in range(20):
        mean = np.mean([walk(forest, t, x[i]) for t in range(25)])
        assert abs(got[i] - 2 ** (-mean / float(expected_path(256)))) < 1e-12


def test_outlier_scores_above_the_rest():
    x = np.random.default_rng(1).normal(size=(500, 12))
    forest = fit_forest(x, 100, 256, 42)
    usual = score_forest(forest, x)
    far = score_forest(forest, np.full((1, 12), 40.0))[0]
    assert ((usual > 0) & (usual <= 1)).all()
    assert far > np.median(usual) and far > usual.max() - 0.05


def test_identical_rows_and_last_bits():
    same = score_forest(fit_forest(np.ones((120, 12)), 100, 256, 42), np.ones((5, 12)))
    assert np.ptp(same) == 0.0
    x = np.random.default_rng(2).normal(size=(400, 12))
    x[:, 3] = 0.25
    noisy = x * (1 + 1e-15)
    a, b = fit_forest(x, 50, 256, 42), fit_forest(noisy, 50, 256, 42)
    np.testing.assert_array_equal(score_forest(a, x), score_forest(b, noisy))


def test_seed_fixes_the_forest():
    x = np.random.default_rng(5).normal(size=(200, 12))
    first, second = fit_forest(x, 10, 256, 42), fit_forest(x, 10, 256, 42)
    np.testing.assert_array_equal(first.threshold, second.threshold)
    assert first.subsample == 200 and first.feature.shape == (10, 511)


def grow(x: np.ndarray, psi: int, depth: int, rng: np.random.Generator, trees: int) -> list[dict]:
    """Trees node by node, with the random numbers of a level drawn for all its nodes together."""
    x = x.astype(np.float32)
    drawn = np.argpartition(rng.random((trees, len(x))), psi - 1, axis=1)[:, :psi]
    level, found = [(t, 0, x[d]) for t, d in enumerate(drawn)], [{} for _ in range(trees)]
    for left in range(depth, -1, -1):
        for t, node, rows in level:
            found[t][node] = (-1, 0.0, len(rows))
        if not left:
            break
        draws, at, after = rng.random((len(level), x.shape[1])), rng.random(len(level)), []
        for (t, node, rows), draw, u in zip(level, draws, at):
            low, high = rows.min(axis=0).astype(float), rows.max(axis=0).astype(float)
            draw = np.where(high > low + 1e-7, draw, -1.0)
            f = int(draw.argmax())
            if draw[f] < 0:
                continue
            cut = low[f] + u * (high[f] - low[f])
            cut = low[f] if cut >= high[f] else cut
            found[t][node] = (f, cut, len(rows))
            parts = rows[~(rows[:, f] > cut)], rows[rows[:, f] > cut]
            after += [(t, 2 * node + 1 + i, part) for i, part in enumerate(parts) if len(part)]
        level = after
        if not level:
            break
    return found


def test_forest_equals_trees_grown_node_by_node():
    rng = np.random.default_rng(3)
    for kind in ("plain", "few values", "nan", "infinite", "repeated", "one row"):
        x = rng.normal(size=(150, 5)) * 10
        if kind == "few values":
            x = np.round(x / 10)
        if kind == "nan":
            x[rng.random(x.shape) < 0.05] = np.nan
        if kind == "infinite":
            x[rng.random(x.shape) < 0.05], x[rng.random(x.shape) < 0.05] = np.inf, -np.inf
        if kind == "repeated":
            x = np.repeat(x[:8], 15, axis=0)
        if kind == "one row":
            x = x[:1]
        psi = min(64, len(x))
        with np.errstate(invalid="ignore"):
            forest = fit_forest(x, 7, 64, 11)
            want = grow(x, psi, int(np.ceil(np.log2(max(psi, 2)))), np.random.default_rng(11), 7)
        for t, tree in enumerate(want):
            used = np.flatnonzero(forest.size[t])
            assert sorted(tree) == used.tolist(), kind
            got = {i: (forest.feature[t, i], forest.threshold[t, i], forest.size[t, i]) for i in used}
            for i in used:
                np.testing.assert_array_equal(got[i], tree[i], err_msg=kind)


def test_a_forest_draws_its_random_numbers_once_for_all_fits_of_a_shape(monkeypatch):
    x, drawn = np.random.default_rng(4).normal(size=(2, 90, 3)), []
    make = np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: drawn.append(seed) or make(seed))
    first = fit_forest(x[0], 5, 32, 77)
    fit_forest(x[1], 5, 32, 77)
    again = fit_forest(x[0], 5, 32, 77)
    assert drawn == [77] and all(np.array_equal(a, b) for a, b in zip(first[:3], again[:3]))


def test_packed_forests_come_back_bit_for_bit():
    rng = np.random.default_rng(8)
    usual = rng.gamma(2.0, 10.0, (900, 12))
    odd = rng.integers(0, 3, (400, 5)).astype(float)
    odd[rng.random(odd.shape) < 0.1], odd[rng.random(odd.shape) < 0.1] = np.nan, np.inf
    odd[rng.random(odd.shape) < 0.1] = -np.inf
    for x, trees, subsample in (
        (usual, 100, 256), (usual, 3, 700), (usual[:3], 4, 256), (usual[:1], 2, 256), (np.ones((700, 2)), 3, 600), (odd, 40, 300)
    ):
        forest = fit_forest(x, trees, subsample, 42)
        packed = pack_forest(forest)
        back = unpack_forest(packed, trees, forest.subsample)
        for was, now in zip(forest[:3], back[:3], strict=True):
            assert was.dtype == now.dtype and np.array_equal(was, now, equal_nan=was.dtype == np.float64)
        assert np.array_equal(score_forest(forest, x), score_forest(back, x), equal_nan=True)
    forest = fit_forest(usual, 100, 256, 42)
    assert sum(map(len, pack_forest(forest).values())) * 6 < sum(a.nbytes for a in forest[:3])
