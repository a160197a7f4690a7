"""Neighbourhood operations on one image array; Spark calls them once per image."""

from __future__ import annotations

import heapq

import numpy as np


def _padded(image: np.ndarray, k: int, mode: str = "reflect") -> np.ndarray:
    k = min(k, *(max(n - 1, 0) for n in image.shape)) if mode == "reflect" else k
    return np.pad(image, k, mode=mode)


def _windows(image: np.ndarray, size: int, mode: str = "edge") -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, size // 2, mode=mode), (size, size))


def gaussian_weights(size: int, sigma: float | None = None) -> np.ndarray:
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def smooth(image: np.ndarray, size: int) -> np.ndarray:
    """Separable Gaussian mean with mirrored edges."""
    w, out = gaussian_weights(size), image.astype(float)
    for axis in (0, 1):
        k = size // 2
        pad = [(k, k) if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > k else "edge")
        out = sum(w[j] * np.take(wide, np.arange(out.shape[axis]) + j, axis) for j in range(size))
    return out


def denoise(image: np.ndarray, method: str) -> np.ndarray:
    if method == "gaussian":
        return np.rint(smooth(image, 5)).astype(np.int64)
    if method == "median":
        return np.median(_windows(image, 5), (2, 3)).astype(np.int64)
    if method == "bilateral":
        near = _windows(image, 9).astype(float)
        y, x = np.mgrid[-4:5, -4:5]
        w = np.exp(-(y * y + x * x) / (2 * 75.0**2)) * np.exp(-((near - image[..., None, None]) ** 2) / (2 * 75.0**2))
        return np.rint((near * w).sum((2, 3)) / w.sum((2, 3))).astype(np.int64)
    if method == "nlm":  # non-local means: 7 x 7 patches, 21 x 21 search
        wide = np.pad(image.astype(float), 13, mode="edge")
        h, w = image.shape
        total, weight = np.zeros(image.shape), np.zeros(image.shape)
        own = wide[10 : h + 16, 10 : w + 16]
        for dy in range(-10, 11):
            for dx in range(-10, 11):
                other = wide[10 + dy : h + 16 + dy, 10 + dx : w + 16 + dx]
                apart = np.lib.stride_tricks.sliding_window_view((own - other) ** 2, (7, 7)).mean((2, 3))
                k = np.exp(-apart / 100.0)
                total += k * other[3 : h + 3, 3 : w + 3]
                weight += k
        return np.rint(total / weight).astype(np.int64)
    raise ValueError(f"no such method: {method}")


def clahe(image: np.ndarray, clip: float, tiles: int) -> np.ndarray:
    """Histogram equalisation by tiles with clipped counts, blended between tile centres."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = image[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(part.ravel(), minlength=256)[:256].astype(float) if part.size else np.ones(256)
            most = max(1.0, clip * counts.sum() / 256)
            counts = np.minimum(counts, most) + np.maximum(counts - most, 0).sum() / 256
            maps[i, j] = 255 * np.cumsum(counts) / counts.sum()
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    a, b = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda y, x: maps[y[:, None], x[None, :], image]
    return np.rint((1 - a) * ((1 - b) * at(y0, x0) + b * at(y0, x1)) + a * ((1 - b) * at(y1, x0) + b * at(y1, x1))).astype(np.int64)


def ellipse(size: int) -> np.ndarray:
    r = size // 2
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    return (y * y + x * x <= r * r + 0.5 * r) if r else np.ones((1, 1), bool)


def _extreme(image: np.ndarray, kernel: np.ndarray, largest: bool) -> np.ndarray:
    r = kernel.shape[0] // 2
    fill = image.min() if largest else image.max()
    wide = np.pad(image, r, constant_values=fill)
    out = None
    for dy, dx in zip(*np.nonzero(kernel)):
        part = wide[dy : dy + image.shape[0], dx : dx + image.shape[1]]
        out = part.copy() if out is None else (np.maximum if largest else np.minimum)(out, part)
    return out


def dilate(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _extreme(image, kernel, True)


def erode(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _extreme(image, kernel, False)


def opened(image: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    for f in [erode] * times + [dilate] * times:
        image = f(image, kernel)
    return image


def closed(image: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    for f in [dilate] * times + [erode] * times:
        image = f(image, kernel)
    return image


def normalize_background(image: np.ndarray, size: int) -> np.ndarray:
    """What rises above the opened image, stretched by at most 4; bright images are left as they are."""
    if image.mean() >= 120:
        return image
    hat = image - opened(image, ellipse(size))
    return np.minimum(255, np.rint(hat * min(255 / hat.max(), 4.0))).astype(np.int64) if hat.max() > 0 else hat


def cleanup(binary: np.ndarray) -> np.ndarray:
    scale = max(1.0, (binary.size / (1920 * 1080)) ** 0.5)
    odd = lambda n: int(n * scale) | 1
    return closed(opened(binary, ellipse(odd(3))), ellipse(odd(12)), 2)


def adaptive_threshold(image: np.ndarray, block: int, c: int) -> np.ndarray:
    block = max(3, block | 1)
    image = clahe(image, 2.0, 8)
    out = np.where(image > smooth(image, block) - c, 255, 0)
    return 255 - out if (out > 0).mean() > 0.5 else out


def components(image: np.ndarray) -> np.ndarray:
    """Eight-connected components by union of runs, numbered in reading order."""
    on = image > 0
    labels = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        wide = np.pad(np.where(on, labels, np.iinfo(np.int64).max), 1, constant_values=np.iinfo(np.int64).max)
        least = np.min([wide[1 + dy : wide.shape[0] - 1 + dy, 1 + dx : wide.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 0)
        least = np.where(on, least, 0)
        flat = np.concatenate([[0], least.ravel()])
        for _ in range(3):
            flat = np.minimum(flat, flat[flat])
        least = flat[1:].reshape(on.shape)
        if np.array_equal(least, labels):
            break
        labels = least
    roots = np.unique(labels[on])
    return np.where(on, np.searchsorted(roots, labels) + 1, 0)


def fill_holes(binary: np.ndarray) -> np.ndarray:
    """Background that corners do not reach becomes foreground; not where the border is mostly foreground."""
    edge = np.concatenate([binary[0], binary[-1], binary[:, 0], binary[:, -1]])
    if (edge > 0).mean() > 0.5:
        return binary
    outside = np.zeros(binary.shape, bool)
    for y, x in ((0, 0), (0, -1), (-1, 0), (-1, -1)):
        outside[y, x] = binary[y, x] == 0
    free = binary == 0
    while True:
        wide = np.pad(outside, 1)
        grown = free & (outside | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:])
        if np.array_equal(grown, outside):
            return np.where(outside, 0, 255)
        outside = grown


def hull_fill(binary: np.ndarray) -> np.ndarray:
    """Every component's convex hull."""
    from .geometry import hull

    labels, out = components(binary), np.where(binary > 0, 255, 0)
    for k in range(1, labels.max() + 1):
        y, x = np.nonzero(labels == k)
        corners = hull(np.stack([x, y], 1).astype(float))
        if len(corners) < 3:
            continue
        gy, gx = np.mgrid[y.min() : y.max() + 1, x.min() : x.max() + 1]
        inside = np.ones(gy.shape, bool)
        for (ax, ay), (bx, by) in zip(corners, np.roll(corners, -1, 0)):
            inside &= (bx - ax) * (gy - ay) - (by - ay) * (gx - ax) >= -1e-9
        out[gy[inside], gx[inside]] = 255
    return out


def distance(on: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the nearest one outside; the image's surroundings count as inside."""
    far = float(on.size + 1)
    rows = np.where(on, far, 0.0)
    for y in range(1, len(rows)):
        rows[y] = np.minimum(rows[y], rows[y - 1] + 1)
    for y in range(len(rows) - 2, -1, -1):
        rows[y] = np.minimum(rows[y], rows[y + 1] + 1)
    x = np.arange(on.shape[1])
    aside, out = (x[:, None] - x[None, :]) ** 2, np.zeros(on.shape)
    for y in np.flatnonzero(on.any(1)):  # a row at a time: memory stays at the square of the width
        out[y] = np.sqrt((rows[y] ** 2 + aside).min(1))
    return out


def watershed(on: np.ndarray, peak_share: float) -> np.ndarray:
    """Objects flooded from the peaks of the distance to the background; components if there is no peak."""
    depth = distance(on)
    if not on.any():
        return np.zeros(on.shape, np.int64)
    gap = max(10, int(10 * (on.size / (1920 * 1080)) ** 0.5))
    peak = on & (depth == _windows(depth, 2 * gap + 1).max((2, 3))) & (depth >= peak_share * depth.max())
    labels = components(np.where(peak, 255, 0))
    heap = [(-depth[y, x], y, x) for y, x in zip(*np.nonzero(labels))]
    heapq.heapify(heap)
    while heap:
        _, y, x = heapq.heappop(heap)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                a, b = y + dy, x + dx
                if 0 <= a < on.shape[0] and 0 <= b < on.shape[1] and on[a, b] and not labels[a, b]:
                    labels[a, b] = labels[y, x]
                    heapq.heappush(heap, (-depth[a, b], a, b))
    return labels


_TURNS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def outer_contour(on: np.ndarray) -> list[tuple[int, int]]:
    """(x, y) of the outer contour's corners, traced from the first pixel in reading order."""
    on = np.pad(on, 1)
    y, x = (int(v) for v in np.argwhere(on)[0])
    start, back, path = (y, x), 4, [(y, x)]
    first_step = None
    while True:
        for k in range(1, 9):
            turn = (back + k) % 8
            a, b = y + _TURNS[turn][0], x + _TURNS[turn][1]
            if on[a, b]:
                break
        else:
            return [(x - 1, y - 1)]
        if (y, x) == start and first_step == turn:
            break
        if first_step is None:
            first_step = turn
        y, x, back = a, b, (turn + 4) % 8
        path.append((y, x))
    path = path[:-1] if len(path) > 1 and path[-1] == path[0] else path
    n = len(path)
    step = lambda k: (path[(k + 1) % n][0] - path[k % n][0], path[(k + 1) % n][1] - path[k % n][1])
    return [(path[k][1] - 1, path[k][0] - 1) for k in range(n) if n < 3 or step(k) != step(k - 1)]
