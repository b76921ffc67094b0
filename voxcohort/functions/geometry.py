"""Small array helpers for one volume: distances, gradients, local deviation and components."""

from __future__ import annotations

import numpy as np

FAR = 1e30


#: Numbers of a table of all pairs of places along an axis that is worked out at once.
PAIRS = 1 << 18


def least_along(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Along the last axis, min over j of f[j] + (at[i] - at[j])^2; FAR where all are."""
    return np.minimum(np.moveaxis(_squared(np.moveaxis(f, -1, 0), at), 0, -1), FAR)


def _squared(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Along the first axis, min over j of f[j] + (at[i] - at[j])^2."""
    rest = (1,) * (f.ndim - 1)
    if f.size * len(f) <= PAIRS:
        return (f[None] + ((at[:, None] - at) ** 2).reshape(len(f), len(f), *rest)).min(axis=1)
    out = np.full(f.shape, FAR)
    for j, x in enumerate(at):
        if (f[j] < FAR).any():
            np.minimum(out, f[j] + ((at - x) ** 2).reshape(-1, *rest), out=out)
    return out


def _nearest(points: np.ndarray, step: float) -> np.ndarray:
    """Squared distance of each place to the nearest true one along the last axis."""
    n = points.shape[-1]
    at = np.append(np.arange(n) * step, np.inf)
    low = np.maximum.accumulate(np.where(points, np.arange(n), -1), axis=-1)  # -1: infinitely far
    high = np.minimum.accumulate(np.where(points, np.arange(n), n)[..., ::-1], axis=-1)[..., ::-1]
    return np.minimum(np.minimum((at[:-1] - at[low]) ** 2, (at[:-1] - at[high]) ** 2), FAR)


def distance_to(points: np.ndarray, spacing: tuple[float, float, float]) -> np.ndarray:
    """Distance in mm of each voxel to the nearest true voxel, exact, axis by axis."""
    d = _nearest(points, spacing[2])
    for axis in (1, 0):
        d = np.moveaxis(_squared(np.moveaxis(d, axis, 0), np.arange(d.shape[axis]) * spacing[axis]), 0, axis)
    return np.sqrt(np.minimum(d, FAR))


def _beside(padded: np.ndarray) -> np.ndarray:
    """Whether all six places across faces are true, for all but the border."""
    out = padded[:-2, 1:-1, 1:-1] & padded[2:, 1:-1, 1:-1]
    for a in (padded[1:-1, :-2, 1:-1], padded[1:-1, 2:, 1:-1], padded[1:-1, 1:-1, :-2], padded[1:-1, 1:-1, 2:]):
        out &= a
    return out


def contour(mask: np.ndarray) -> np.ndarray:
    """Foreground voxels that have a background voxel across a face; outside the grid counts as background."""
    return mask & ~_beside(np.pad(mask, 1))


def signed_distances(mask: np.ndarray, spacing: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Inside and outside distances in mm: to the contour of the mask, and to the contour of the background; 0 elsewhere.

    The outermost layer of the mask, and the first one outside, have distance 0.
    """
    if not mask.any():
        return np.zeros(mask.shape), np.full(mask.shape, np.nan)
    inside = np.where(mask, distance_to(contour(mask), spacing), 0.0)
    back = ~mask
    first = back & ~_eroded_open(back)
    outside = np.where(back, distance_to(first, spacing), 0.0) if first.any() else np.zeros(mask.shape)
    return inside, outside


def _eroded_open(back: np.ndarray) -> np.ndarray:
    """Background voxels without a mask voxel across a face; outside the grid is background."""
    return back & _beside(np.pad(back, 1, constant_values=True))


def _kernel(sigma: float, step: float, order: int) -> np.ndarray:
    """Samples of a Gaussian (order 0) or its derivative (order 1) at voxel steps, out to four sigmas."""
    r = max(1, int(np.ceil(4 * sigma / step)))
    x = np.arange(-r, r + 1) * step
    g = np.exp(-0.5 * (x / sigma) ** 2)
    g /= g.sum()
    if order:
        g = g * x
        g /= (g * x).sum()
    return g


def _along(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with k along an axis, edges repeated."""
    r = len(k) // 2
    a = np.moveaxis(a, axis, 0)
    p = np.concatenate([a[:1]] * r + [a] + [a[-1:]] * r)
    out, n = k[0] * p[: len(a)], len(a)
    for i, w in enumerate(k[1:], 1):
        out += w * p[i : i + n]
    return np.moveaxis(out, 0, axis)


def gradient_magnitude(a: np.ndarray, spacing: tuple[float, float, float], sigma: float = 0.5) -> np.ndarray:
    """Magnitude of the gradient per mm of the volume smoothed by a Gaussian of sigma mm."""
    total = np.zeros(a.shape)
    for d in range(3):
        g = a.astype(float)
        for axis, step in enumerate(spacing):
            g = _along(g, _kernel(sigma, step, int(axis == d)), axis)
        total += g * g
    return np.sqrt(total)


def local_deviation(a: np.ndarray, spacing: tuple[float, float, float], fwhm: float = 5.0) -> np.ndarray:
    """Standard deviation under a Gaussian window of fwhm mm."""
    sigma = fwhm / 2.355
    m, s = a.astype(float), a.astype(float) ** 2
    for axis, step in enumerate(spacing):
        k = _kernel(sigma, step, 0)
        m, s = _along(m, k, axis), _along(s, k, axis)
    return np.sqrt(np.maximum(s - m * m, 0))


def components(mask: np.ndarray) -> np.ndarray:
    """Labels 1, 2, ... of the mask's components across faces, edges and corners; 0 outside."""
    at = np.flatnonzero(mask)
    number = np.full(np.array(mask.shape) + 2, -1)
    number[1:-1, 1:-1, 1:-1][mask] = np.arange(len(at))
    label = np.arange(len(at))
    links = []
    for dz in (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if (dz, dy, dx) > (0, 0, 0):
                    z, y, x = (slice(1 + d, number.shape[i] - 1 + d) for i, d in enumerate((dz, dy, dx)))
                    there = number[z, y, x][mask]
                    ok = there >= 0
                    links.append((np.flatnonzero(ok), there[ok]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while (label[label] != label).any():
            label = label[label]
        more = label[i] != label[j]
        i, j = i[more], j[more]
    out = np.zeros(mask.shape, np.int32)
    out.ravel()[at] = np.unique(label, return_inverse=True)[1] + 1
    return out
