"""Tile kernels against per-pixel loops."""

import itertools

import numpy as np
import pytest

from groundcover.operators import kernels as K
from groundcover.operators.assign import solve_assignment

RNG = np.random.default_rng(5)


def neighbours(a, y, x, mask):
    r, c = mask.shape[0] // 2, mask.shape[1] // 2
    return [a[y + i - r, x + j - c] for i, j in np.argwhere(mask)
            if 0 <= y + i - r < a.shape[0] and 0 <= x + j - c < a.shape[1]]


def flood(mask, conn):
    h, w = mask.shape
    out = -np.ones((h, w), int)
    for y, x in np.argwhere(mask):
        if out[y, x] >= 0:
            continue
        todo = [(y, x)]
        out[y, x] = root = y * w + x
        while todo:
            a, b = todo.pop()
            for dy, dx in itertools.product((-1, 0, 1), repeat=2):
                if conn == 4 and abs(dy) + abs(dx) != 1:
                    continue
                u, v = a + dy, b + dx
                if 0 <= u < h and 0 <= v < w and mask[u, v] and out[u, v] < 0:
                    out[u, v] = root
                    todo.append((u, v))
    return out


@pytest.mark.parametrize("conn,share", [(4, 0.6), (8, 0.4), (8, 0.0), (4, 1.0)])
def test_label(conn, share):
    m = RNG.random((31, 43)) < share
    assert (K.label(m, conn) == flood(m, conn)).all()


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_median_is_the_middle_of_the_clipped_disk(radius):
    a = RNG.integers(1, 6, (17, 19))
    want = [[sorted(neighbours(a, y, x, K.disk(radius)))[len(neighbours(a, y, x, K.disk(radius))) // 2]
             for x in range(19)] for y in range(17)]
    assert (K.rank_median(a, radius) == np.array(want)).all()


def test_entropy():
    a = RNG.integers(0, 4, (12, 15)).astype(np.uint8)
    got = K.disk_entropy(a, 2)
    for y, x in itertools.product(range(12), range(15)):
        _, n = np.unique(neighbours(a, y, x, K.disk(2)), return_counts=True)
        p = n / n.sum()
        assert got[y, x] == pytest.approx(-(p * np.log2(p)).sum())


@pytest.mark.parametrize("kernel", [K.ellipse(3), K.ellipse(5), K.ellipse(11), np.ones((9, 9), bool), K.ellipse(20)])
def test_dilate_and_erode(kernel):
    m = RNG.random((24, 26)) < 0.1
    want = np.array([[any(neighbours(m, y, x, kernel)) for x in range(26)] for y in range(24)])
    assert (K.dilate(m, kernel) == want).all()
    want = np.array([[all(neighbours(~m, y, x, kernel)) for x in range(26)] for y in range(24)])
    assert (K.erode(~m, kernel) == want).all()


def test_small_ellipses_have_the_known_shape():
    assert K.ellipse(3).tolist() == [[False, True, False], [True, True, True], [False, True, False]]
    assert K.ellipse(5).sum() == 17


def test_box_mean_reflects():
    a = RNG.random((6, 7))
    p = np.pad(a, 1, mode="symmetric")
    want = np.array([[p[y:y + 3, x:x + 3].mean() for x in range(7)] for y in range(6)])
    assert np.allclose(K.box_mean(a), want)


def test_fill_holes_and_hull():
    ring = np.ones((5, 6), bool)
    ring[1:4, 1:5] = False
    assert K.fill_holes(ring).all()
    open_ring = ring.copy()
    open_ring[0, 2] = False
    assert (K.fill_holes(open_ring) == open_ring).all()
    assert K.hull_area(np.array([0, 0, 4, 4, 2]), np.array([0, 4, 0, 4, 2])) == 16.0


@pytest.mark.parametrize("shape", [(3, 3), (3, 5), (5, 3), (6, 6), (1, 4), (4, 1)])
def test_assignment_is_optimal(shape):
    for _ in range(30):
        cost = RNG.integers(0, 50, shape).astype(float)
        n, m = shape
        got = solve_assignment(cost)
        used = [(i, j) for i, j in enumerate(got) if j >= 0]
        assert len(used) == min(n, m) and len({j for _, j in used}) == len(used)
        total = sum(cost[i, j] for i, j in used)
        if n <= m:
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert total == best
