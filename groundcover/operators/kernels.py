"""Small NumPy kernels that run on one padded tile inside a task."""

from __future__ import annotations

import numpy as np


def box_mean(a: np.ndarray, size: int = 3) -> np.ndarray:
    """Mean over a square window with reflected edges."""
    r = size // 2
    p = np.pad(a.astype(np.float64), r, mode="symmetric")
    c = np.cumsum(np.cumsum(np.pad(p, ((1, 0), (1, 0))), axis=0), axis=1)
    h, w = a.shape
    return (c[size:size + h, size:size + w] - c[:h, size:size + w]
            - c[size:size + h, :w] + c[:h, :w]) / float(size * size)


def texture_std(gray: np.ndarray, size: int = 3) -> np.ndarray:
    m = box_mean(gray, size)
    return np.sqrt(np.maximum(box_mean(gray.astype(np.float64) ** 2, size) - m * m, 0.0))


def disk(radius: int) -> np.ndarray:
    y, x = np.mgrid[-radius:radius + 1, -radius:radius + 1]
    return x * x + y * y <= radius * radius


def ellipse(size: int) -> np.ndarray:
    """Elliptic structuring element of a side length, built row by row."""
    r = size // 2
    out = np.zeros((size, size), dtype=bool)
    for i in range(size):
        dy = i - r
        if abs(dy) > r:
            continue
        dx = int(np.rint(r * np.sqrt((r * r - dy * dy) / (r * r)))) if r else 0
        out[i, max(r - dx, 0):min(r + dx + 1, size)] = True
    return out


def _shifted(a: np.ndarray, offsets, fill):
    """Views of ``a`` moved by each offset; cells from outside hold ``fill``."""
    h, w = a.shape
    for dy, dx in offsets:
        v = np.full_like(a, fill)
        ys, xs = slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))
        yt, xt = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
        if ys.stop > ys.start and xs.stop > xs.start:
            v[ys, xs] = a[yt, xt]
        yield v


def _row_runs(kernel: np.ndarray):
    anchor_y, anchor_x = kernel.shape[0] // 2, kernel.shape[1] // 2
    for i, line in enumerate(kernel):
        xs = np.flatnonzero(line)
        if len(xs):
            yield i - anchor_y, xs[0] - anchor_x, xs[-1] - anchor_x


def dilate(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Binary dilation: each kernel row is a run, counted with a running sum."""
    h, w = mask.shape
    total = np.concatenate([np.zeros((h, 1), np.int64), np.cumsum(mask, axis=1, dtype=np.int64)], axis=1)
    out = np.zeros((h, w), dtype=bool)
    cols = np.arange(w)
    for dy, x0, x1 in _row_runs(kernel):
        lo, hi = np.clip(cols + x0, 0, w), np.clip(cols + x1 + 1, 0, w)
        hit = (total[:, hi] - total[:, lo]) > 0
        y0, y1 = max(0, -dy), min(h, h - dy)
        if y1 > y0:
            out[y0:y1] |= hit[y0 + dy:y1 + dy]
    return out


def erode(mask: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Binary erosion; cells outside the raster do not erode."""
    return ~dilate(~mask.astype(bool), kernel)


def opening(mask, kernel):
    return dilate(erode(mask, kernel), kernel)


def closing(mask, kernel):
    return erode(dilate(mask, kernel), kernel)


def rank_median(labels: np.ndarray, radius: int) -> np.ndarray:
    """Median of small label ids over a disk clipped at the raster edge.

    Ids are counted per cell; the median is the first id whose running count
    passes half of the cells in the clipped disk.
    """
    foot = disk(radius)
    offsets = [(y - radius, x - radius) for y, x in np.argwhere(foot)]
    n = sum(v for v in _shifted(np.ones(labels.shape, np.int32), offsets, 0))
    half = n // 2
    out = np.zeros(labels.shape, dtype=labels.dtype)
    done = np.zeros(labels.shape, dtype=bool)
    run = np.zeros(labels.shape, dtype=np.int32)
    for v in np.unique(labels):
        run = run + sum(s for s in _shifted((labels == v).astype(np.int32), offsets, 0))
        hit = ~done & (run > half)
        out[hit] = v
        done |= hit
    return out


def disk_entropy(gray_u8: np.ndarray, radius: int = 2) -> np.ndarray:
    """Shannon entropy (bits) of the values in a disk clipped at the edge."""
    offsets = [(y - radius, x - radius) for y, x in np.argwhere(disk(radius))]
    stack = np.stack(list(_shifted(gray_u8.astype(np.int16), offsets, -1)))
    stack.sort(axis=0)
    n = (stack >= 0).sum(axis=0)
    out = np.zeros(gray_u8.shape)
    depth = stack.shape[0]
    same = np.zeros(gray_u8.shape, dtype=np.int32)
    for i in range(depth):
        same += 1
        last = np.ones(gray_u8.shape, bool) if i == depth - 1 else stack[i + 1] != stack[i]
        p = np.where(last & (stack[i] >= 0), same / n, 1.0)
        out -= np.where(last, p * np.log2(p), 0.0)
        same[last] = 0
    return out


def gaussian(a: np.ndarray, size: int = 11) -> np.ndarray:
    """Separable Gaussian; sigma follows the kernel size, edges mirror without repeating."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    k = np.exp(-(x * x) / (2 * sigma * sigma))
    k /= k.sum()
    r = size // 2
    h, w = a.shape
    p = np.pad(a.astype(np.float64), ((r, r), (r, r)), mode="reflect" if min(h, w) > r else "symmetric")
    v = sum(k[i] * p[i:i + h, :] for i in range(size))
    return sum(k[i] * v[:, i:i + w] for i in range(size))


def gaussian_std(gray: np.ndarray, size: int = 11) -> np.ndarray:
    g = gray.astype(np.float64)
    m = gaussian(g, size)
    return np.sqrt(np.maximum(gaussian(g * g, size) - m * m, 0.0))


def gradient_magnitude(a: np.ndarray) -> np.ndarray:
    """Central differences inside, one-sided at the edges."""
    gy = np.gradient(a, axis=0) if a.shape[0] > 1 else np.zeros_like(a)
    gx = np.gradient(a, axis=1) if a.shape[1] > 1 else np.zeros_like(a)
    return np.sqrt(gx * gx + gy * gy)


def label(mask: np.ndarray, connectivity: int = 8) -> np.ndarray:
    """Component labels: the lowest flat index of each component, -1 for background."""
    h, w = mask.shape
    idx = np.arange(h * w).reshape(h, w)
    pairs = []
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    for dy, dx in steps:
        a = np.s_[0:h - dy, max(0, -dx):w - max(0, dx)]
        b = np.s_[dy:h, max(0, dx):w - max(0, -dx)]
        both = mask[a] & mask[b]
        pairs.append((idx[a][both], idx[b][both]))
    u = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, int)
    v = np.concatenate([p[1] for p in pairs]) if pairs else np.empty(0, int)
    root = np.arange(h * w)
    while len(u):
        ru, rv = root[u], root[v]
        differ = ru != rv
        if not differ.any():
            break
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            nxt = root[root]
            if (nxt == root).all():
                break
            root = nxt
    return np.where(mask, root.reshape(h, w), -1)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Fill background components that do not reach the array edge."""
    back = label(~mask, connectivity=4)
    edge = np.concatenate([back[0], back[-1], back[:, 0], back[:, -1]])
    return ~np.isin(back, np.unique(edge[edge >= 0])) | mask


def hull_area(ys: np.ndarray, xs: np.ndarray) -> float:
    """Area of the convex hull of pixel centres."""
    pts = np.unique(np.stack([xs, ys], axis=1), axis=0)
    if len(pts) < 3:
        return 0.0

    def half(points):
        chain: list = []
        for p in points:
            while len(chain) >= 2 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                       - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    # only the extreme pixels of each row can lie on the hull
    order = np.lexsort((pts[:, 0], pts[:, 1]))
    rows = pts[order]
    first = np.r_[True, rows[1:, 1] != rows[:-1, 1]]
    last = np.r_[first[1:], True]
    ends = rows[first | last]
    ends = ends[np.lexsort((ends[:, 1], ends[:, 0]))].tolist()
    ring = half(ends) + half(ends[::-1])
    x = np.array([p[0] for p in ring], float)
    y = np.array([p[1] for p in ring], float)
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)
