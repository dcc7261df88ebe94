"""Numeric kernels of scan registration, each one grouped map over scans, tiles or (pair, heading) tasks.

Kernels take and give arrays and know nothing of Spark; the functions at the end run them over DataFrames of points.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- kernels ----


def nearest(a: np.ndarray, b: np.ndarray, radius: float, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the k nearest rows of b within radius: distances (inf where none) and positions (-1), by hashing b into cells."""
    dim = a.shape[1]
    dist, at = np.full((len(a), k), np.inf), np.full((len(a), k), -1)
    if not len(a) or not len(b):
        return dist, at
    low = np.minimum(a.min(axis=0), b.min(axis=0)) - radius
    ca, cb = ((a - low) // radius).astype(np.int64), ((b - low) // radius).astype(np.int64)
    width = np.maximum(ca.max(axis=0), cb.max(axis=0)) + 3
    steps = np.concatenate([np.cumprod(width[::-1])[::-1][1:], [1]])
    key = (cb + 1) @ steps
    order = np.argsort(key, kind="stable")
    key = key[order]
    own = (ca + 1) @ steps
    for d in np.stack(np.meshgrid(*[[-1, 0, 1]] * dim, indexing="ij"), -1).reshape(-1, dim):
        want = own + d @ steps
        lo, hi = np.searchsorted(key, want), np.searchsorted(key, want, side="right")
        for step in range(int((hi - lo).max(initial=0))):
            some = np.flatnonzero(lo + step < hi)
            other = order[lo[some] + step]
            r = np.sqrt(((a[some] - b[other]) ** 2).sum(axis=1))
            good = (r <= radius) & (r < dist[some, -1])
            some, other, r = some[good], other[good], r[good]
            dist[some, -1], at[some, -1] = r, other
            rank = np.argsort(dist[some], axis=1, kind="stable")
            dist[some] = np.take_along_axis(dist[some], rank, axis=1)
            at[some] = np.take_along_axis(at[some], rank, axis=1)
    return dist, at


def normals(xyz: np.ndarray, k: int = 10, radius: float = 0.3) -> np.ndarray:
    """Upward normals: the least eigenvector of the covariance of a point and its neighbours; straight up with fewer than 5."""
    _, at = nearest(xyz, xyz, radius, k + 1)
    real = at >= 0
    n = real.sum(axis=1)
    p = np.where(real[:, :, None], xyz[at], 0.0)
    mean = p.sum(axis=1) / np.maximum(n, 1)[:, None]
    q = np.where(real[:, :, None], xyz[at] - mean[:, None], 0.0)
    _, vectors = np.linalg.eigh(np.einsum("nki,nkj->nij", q, q))
    out = vectors[:, :, 0]
    out = np.where(out[:, 2:3] < 0, -out, out)
    out[n < 5] = (0.0, 0.0, 1.0)
    return out


def raster(x: np.ndarray, y: np.ndarray, v: np.ndarray, cell: float, origin: tuple[float, float], shape: tuple[int, int], how: str = "max") -> np.ndarray:
    """Grid (rows by y) of the greatest, least or mean value; NaN in empty cells."""
    i, j = ((y - origin[1]) // cell).astype(int), ((x - origin[0]) // cell).astype(int)
    inside = (i >= 0) & (i < shape[0]) & (j >= 0) & (j < shape[1])
    flat = i[inside] * shape[1] + j[inside]
    n = shape[0] * shape[1]
    if how == "mean":
        count = np.bincount(flat, minlength=n)
        out = np.bincount(flat, v[inside], n) / np.where(count, count, 1)
        out[count == 0] = np.nan
    else:
        out = np.full(n, -np.inf if how == "max" else np.inf)
        (np.maximum if how == "max" else np.minimum).at(out, flat, v[inside])
        out[~np.isfinite(out)] = np.nan
    return out.reshape(shape)


def sobel(image: np.ndarray) -> np.ndarray:
    """Gradient magnitude with Sobel weights; edges repeat."""
    p = np.pad(image, 1, mode="edge")
    smooth_y = p[:-2] + 2 * p[1:-1] + p[2:]
    smooth_x = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return np.hypot(smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]) / 8


def shrink(mask: np.ndarray, by: int) -> np.ndarray:
    """Erosion by a square of 2 * by + 1 cells; outside counts as empty."""
    p = np.pad(mask, by)
    out = np.ones_like(mask)
    for i in range(2 * by + 1):
        for j in range(2 * by + 1):
            out &= p[i : i + mask.shape[0], j : j + mask.shape[1]]
    return out


def grow(mask: np.ndarray, by: int) -> np.ndarray:
    return ~shrink(np.pad(~mask, by, constant_values=True), by)[by : by + mask.shape[0], by : by + mask.shape[1]]


# Full marks of object height and ground step (m), weights of the channels, least overlap (square metres, share of the moving cells), least score.
TALL, STEP, CHANNELS, LEAST_OVERLAP, LEAST_SHARE, LEAST_SCORE = 2.5, 0.6, (1.0, 1.0, 0.4), 8.0, 0.12, 0.02
#: Heights and steps up to so many metres are noise: bare ground agrees with bare ground everywhere.
NOISE = 0.05


class Rasters(NamedTuple):
    """What a scan shows in each cell of a grid: where it has points, its channels, and their energy."""

    seen: np.ndarray
    channels: list[np.ndarray]
    energy: np.ndarray
    origin: tuple[float, float]


def rasters(xyz: np.ndarray, bright: np.ndarray | None, cell: float) -> Rasters:
    """Object height, ground edges (on the footprint eroded by two cells) and edges of the ground's brightness (0 to 1), weighted."""
    x, y, z = xyz.T
    origin = (float(x.min()), float(y.min()))
    shape = (int((y.max() - origin[1]) // cell) + 1, int((x.max() - origin[0]) // cell) + 1)
    low, high = (raster(x, y, z, cell, origin, shape, how) for how in ("min", "max"))
    seen = np.isfinite(low)
    height = np.where(seen, np.clip(np.nan_to_num(high - low) - NOISE, 0, TALL) / TALL, 0.0)
    edge = np.where(shrink(seen, 2), np.clip(8 * sobel(np.where(seen, low, np.nanmedian(low))) - NOISE, 0, STEP) / STEP, 0.0)
    paint = np.zeros(shape)
    if bright is not None and np.isfinite(bright).any():
        at = ((y - origin[1]) // cell).astype(int), ((x - origin[0]) // cell).astype(int)
        ground = np.isfinite(bright) & (z - low[at] < 0.25)
        mean = raster(x[ground], y[ground], bright[ground], cell, origin, shape, "mean")
        lit = np.isfinite(mean)
        if lit.any():
            paint = np.where(shrink(lit, 2), np.minimum(8 * sobel(np.where(lit, mean, np.nanmean(mean))), 1.0), 0.0)
    channels = [w * c for w, c in zip(CHANNELS, (height, edge, paint), strict=True)]
    return Rasters(seen.astype(float), channels, sum(c * c for c in channels), origin)


def agreement(fixed: Rasters, moving: Rasters, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of the channels over all whole-cell shifts, normalised by both sides' energy where they overlap, and the overlap in cells.

    By FFT, full size; shift (0, 0) is at (moving rows - 1, moving columns - 1). Shifts with less than `least` cells in common
    get -inf; a small overlap weighs less by its fourth root.
    """
    shape = tuple(a + b - 1 for a, b in zip(fixed.seen.shape, moving.seen.shape, strict=True))
    ahead = lambda m: np.fft.rfft2(m, shape)
    turned = lambda m: np.fft.rfft2(m[::-1, ::-1], shape)
    back = lambda f: np.fft.irfft2(f, shape)
    seen_f, seen_m = ahead(fixed.seen), turned(moving.seen)
    overlap = np.rint(back(seen_f * seen_m))
    cross = back(sum(ahead(a) * turned(b) for a, b in zip(fixed.channels, moving.channels, strict=True)))
    energy = np.maximum(back(ahead(fixed.energy) * seen_m), 1e-6) * np.maximum(back(seen_f * turned(moving.energy)), 1e-6)
    score = cross / np.sqrt(energy) * np.minimum(1.0, overlap / max(1.0, moving.seen.sum())) ** 0.25
    return np.where(overlap >= max(1.0, least), score, -np.inf), overlap


def finer(one: np.ndarray, two: np.ndarray, start: tuple[float, float, float], lights: tuple[np.ndarray | None, np.ndarray | None] = (None, None), reach: float = 2.5, window: float = 3.0, cell: float = 0.1, most: int = 512) -> tuple[float, float, float]:
    """The best pose (degrees, dx, dy) within a shift and a heading of the start, on 10 cm cells of the overlap; the start where that is too small."""
    degrees, dx, dy = start
    placed = turn(two, degrees) + [dx, dy, 0.0]
    low = np.maximum(one[:, :2].min(axis=0), placed[:, :2].min(axis=0)) - 3.0
    high = np.minimum(one[:, :2].max(axis=0), placed[:, :2].max(axis=0)) + 3.0
    inside = [((p[:, :2] >= low) & (p[:, :2] <= high)).all(axis=1) for p in (one, placed)]
    if (high - low).min() < 4 or min(m.sum() for m in inside) < 200:
        return start
    size = max(cell, float((high - low).max()) / most)
    own, theirs = one[inside[0]], placed[inside[1]]
    light = [None if v is None else v[m] for v, m in zip(lights, inside, strict=True)]
    fixed, centre = rasters(own, light[0], size), np.array([*theirs[:, :2].mean(axis=0), 0.0])
    best = (-np.inf, start)
    for more in np.arange(-window, window + 1e-9, 1.5):
        moved = turn(theirs - centre, more) + centre
        moving = rasters(moved, light[1], size)
        score, _ = agreement(fixed, moving, LEAST_OVERLAP / size**2)
        sx = fixed.origin[0] - moving.origin[0] + (np.arange(score.shape[1]) - moving.seen.shape[1] + 1) * size
        sy = fixed.origin[1] - moving.origin[1] + (np.arange(score.shape[0]) - moving.seen.shape[0] + 1) * size
        score = np.where((np.abs(sx)[None, :] <= reach) & (np.abs(sy)[:, None] <= reach), score, -np.inf)
        i, j = np.unravel_index(int(score.argmax()), score.shape)
        if score[i, j] > best[0]:
            shift = turn(np.array([[dx, dy, 0.0]]) - centre, more)[0] + centre
            best = (float(score[i, j]), (degrees + float(more), float(shift[0] + sx[j]), float(shift[1] + sy[i])))
    return best[1]


def peaks(image: np.ndarray, n: int, apart: int) -> list[tuple[int, int, float]]:
    """The n greatest values that are at least `apart` cells from greater ones."""
    work, out = image.copy(), []
    for _ in range(n):
        i, j = np.unravel_index(int(work.argmax()), work.shape)
        if not np.isfinite(work[i, j]):
            break
        out.append((int(i), int(j), float(image[i, j])))
        work[max(0, i - apart) : i + apart + 1, max(0, j - apart) : j + apart + 1] = -np.inf
    return out


def turn(xyz: np.ndarray, degrees: float) -> np.ndarray:
    a = np.radians(degrees)
    out = xyz.copy()
    out[:, 0], out[:, 1] = np.cos(a) * xyz[:, 0] - np.sin(a) * xyz[:, 1], np.sin(a) * xyz[:, 0] + np.cos(a) * xyz[:, 1]
    return out


def small_rotation(r: np.ndarray) -> np.ndarray:
    """Rotation by a rotation vector (Rodrigues)."""
    angle = np.linalg.norm(r)
    if angle < 1e-12:
        return np.eye(3)
    k = r / angle
    x = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
    return np.eye(3) + np.sin(angle) * x + (1 - np.cos(angle)) * x @ x


def icp(fixed: np.ndarray, moving: np.ndarray, start: np.ndarray | None = None, dof: int = 6, reach: tuple[float, float] = (1.0, 0.1), rounds: int = 30, trim: float = 0.9, tilt: float = 3.0) -> tuple[np.ndarray, float, float]:
    """Point-to-plane ICP: 4 x 4 transform of moving onto fixed, RMS of the matched residuals, share of points matched.

    The reach shrinks evenly from the first to the second; the worst residuals beyond the trim share are left out. dof
    4 turns about the vertical only; with 6, a tilt over the limit is refused and the last allowed pose kept.
    """
    pose = np.eye(4) if start is None else start.copy()
    up = normals(fixed, 10, max(0.3, reach[1] * 3))
    good = np.isfinite(up[:, 0])
    target, up = fixed[good], up[good]
    rms, share = np.inf, 0.0
    for k in range(rounds):
        radius = reach[0] + (reach[1] - reach[0]) * k / max(1, rounds - 1)
        p = moving @ pose[:3, :3].T + pose[:3, 3]
        d, at = nearest(p, target, radius)
        hit = np.flatnonzero(at[:, 0] >= 0)
        if len(hit) < 6:
            break
        q, n = target[at[hit, 0]], up[at[hit, 0]]
        off = ((q - p[hit]) * n).sum(axis=1)
        keep = np.abs(off) <= np.quantile(np.abs(off), trim) + 1e-12
        centre = p[hit][keep].mean(axis=0)
        jac = np.concatenate([np.cross(p[hit][keep] - centre, n[keep]), n[keep]], axis=1)
        if dof == 4:
            jac = jac[:, 2:]
        move = np.linalg.lstsq(jac, off[keep], rcond=None)[0]
        r, t = (move[:3], move[3:]) if dof == 6 else (np.array([0, 0, move[0]]), move[1:])
        rot = small_rotation(r)
        step = np.eye(4)
        step[:3, :3], step[:3, 3] = rot, centre + t - rot @ centre
        new = step @ pose
        if np.degrees(np.arccos(np.clip(new[2, 2], -1, 1))) > tilt:
            break
        pose = new
        rms, share = float(np.sqrt((off[keep] ** 2).mean())), len(hit) / len(moving)
        if np.linalg.norm(move) < 1e-7 and k > rounds // 2:
            break
    return pose, rms, share


def distance_transform(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance in cells to the nearest set cell, by lower envelopes along both axes (each as one minimum over offsets)."""
    far = float(sum(mask.shape)) ** 2 * 4
    squared = np.where(mask, 0.0, far)
    for axis in (0, 1):
        line = np.moveaxis(squared, axis, 0)
        n = len(line)
        gaps = (np.arange(n)[:, None] - np.arange(n)) ** 2
        squared = np.moveaxis(np.stack([(line + gaps[i][:, None]).min(axis=0) for i in range(n)]), 0, axis)
    return np.sqrt(squared)


def label(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Connected cells share a number (their least index + 1), 0 outside, by least-label passes until nothing changes."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    shifts = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while True:
        p = np.pad(np.where(mask, out, big), 1, constant_values=big)
        near = np.min([p[1 + a : 1 + a + mask.shape[0], 1 + b : 1 + b + mask.shape[1]] for a, b in shifts] + [p[1:-1, 1:-1]], axis=0)
        new = np.where(mask, near, 0)
        flat = np.append(0, new.ravel())
        jumped = np.where(mask, flat[new], 0)  # a number is the index of a cell, whose own number may be less
        jumped = np.where(mask, np.minimum(jumped, new), 0)
        if (jumped == out).all():
            return out
        out = jumped


def rigid_2d(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that bring a onto b with least weighted squares."""
    w = np.ones(len(a)) if w is None else w
    ca, cb = (w @ a) / w.sum(), (w @ b) / w.sum()
    u, _, v = np.linalg.svd((a - ca).T @ ((b - cb) * w[:, None]))
    d = np.diag([1.0, np.sign(np.linalg.det(v.T @ u.T))])
    r = v.T @ d @ u.T
    return r, cb - r @ ca


def ransac_2d(a: np.ndarray, b: np.ndarray, draws: int = 5000, reach: float = 0.2, most_yaw: float = 50.0, most_shift: float = 25.0, refits: int = 3, seed: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Rigid motion of matched points that most matches agree with, refitted on them; the same on every run."""
    rng = np.random.default_rng(seed)
    i = rng.integers(0, len(a), (draws, 2))
    da, db = a[i[:, 1]] - a[i[:, 0]], b[i[:, 1]] - b[i[:, 0]]
    yaw = np.arctan2(db[:, 1], db[:, 0]) - np.arctan2(da[:, 1], da[:, 0])
    yaw = (yaw + np.pi) % (2 * np.pi) - np.pi
    c, s = np.cos(yaw), np.sin(yaw)
    shift = b[i[:, 0]] - np.stack([c * a[i[:, 0], 0] - s * a[i[:, 0], 1], s * a[i[:, 0], 0] + c * a[i[:, 0], 1]], axis=1)
    fits = (np.abs(np.hypot(*da.T) - np.hypot(*db.T)) < reach) & (np.abs(np.degrees(yaw)) <= most_yaw) & (np.hypot(*shift.T) <= most_shift) & (np.hypot(*da.T) > reach)
    best, inside = -1, np.zeros(len(a), bool)
    for k in np.flatnonzero(fits):
        r = np.array([[c[k], -s[k]], [s[k], c[k]]])
        ok = np.hypot(*(a @ r.T + shift[k] - b).T) < reach
        if ok.sum() > best:
            best, inside = int(ok.sum()), ok
    r, t = np.eye(2), np.zeros(2)
    for _ in range(refits):
        if inside.sum() < 2:
            break
        r, t = rigid_2d(a[inside], b[inside])
        inside = np.hypot(*(a @ r.T + t - b).T) < reach
    return r, t, int(inside.sum())


def occupancy_conflict(fixed: np.ndarray, moving: np.ndarray, cell: float = 0.25) -> float:
    """Share of the moving scan's object cells (0.3 to 2 m over ground) that the fixed scan sees as plain ground three times or more."""
    origin = np.minimum(fixed[:, :2].min(axis=0), moving[:, :2].min(axis=0))
    shape = tuple((np.maximum(fixed[:, :2].max(axis=0), moving[:, :2].max(axis=0)) - origin)[::-1] // cell + 1)
    shape = (int(shape[0]), int(shape[1]))

    def count(p: np.ndarray, low: float, high: float) -> np.ndarray:
        g = raster(p[:, 0], p[:, 1], p[:, 2], 1.0, tuple(origin), (int(shape[0] * cell) + 1, int(shape[1] * cell) + 1), "min")
        i, j = ((p[:, 1] - origin[1]) // 1.0).astype(int), ((p[:, 0] - origin[0]) // 1.0).astype(int)
        h = p[:, 2] - g[i, j]
        q = p[(h >= low) & (h < high)]
        flat = ((q[:, 1] - origin[1]) // cell).astype(int) * shape[1] + ((q[:, 0] - origin[0]) // cell).astype(int)
        return np.bincount(flat, minlength=shape[0] * shape[1]).reshape(shape)

    ground, solid = count(fixed, -0.08, 0.08), count(moving, 0.3, 2.0) > 0
    own = grow(count(fixed, 0.3, 2.0) > 0, 1)
    return float(((ground >= 3) & solid & ~own).sum() / max(1, solid.sum()))


def map_starts(kinds: list[tuple[np.ndarray, np.ndarray, float, float]], most_shift: float = 25.0, most_yaw: float = 35.0, cell: float = 0.25, n: int = 6, most: int = 1024) -> list[tuple[float, float, float]]:
    """Up to n distinct poses (dx, dy, degrees about the points' centre) that lay points best on map points of their kind.

    kinds: points, map points, weight and kernel width. The cost of a pose is the weighted mean of 1 - exp(-(d / width)^2)
    over the points, d being the distance to the map, plus a penalty for far poses. Costs of all shifts come from one
    product of spectra for each heading, in steps of 2 degrees.
    """
    used = [(p, q, w, s) for p, q, w, s in kinds if len(p) and len(q) and w > 0]
    if not used:
        return []
    everything = np.concatenate([p for p, _, _, _ in used])
    centre = everything.mean(axis=0)
    half = float(np.hypot(*(everything - centre).T).max()) + most_shift + 5
    cell = max(cell, 2 * half / most)
    size, low = int(2 * half / cell) + 1, centre - half

    def counts(p: np.ndarray) -> np.ndarray:
        at = ((p - low) // cell).astype(int)
        at = at[((at >= 0) & (at < size)).all(axis=1)]
        return np.bincount(at[:, 1] * size + at[:, 0], minlength=size * size).reshape(size, size)

    spectra = [(p, w / len(p), np.fft.rfft2(1 - np.exp(-((distance_transform(counts(q) > 0) * cell / s) ** 2)))) for p, q, w, s in used]
    lim = int(most_shift / cell)
    steps = np.arange(-lim, lim + 1)
    far = np.hypot(*np.meshgrid(steps * cell, steps * cell))
    found = []
    for degrees in np.arange(-most_yaw, most_yaw + 1e-9, 2.0):
        a = np.radians(degrees)
        r = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        total = sum(w * f * np.conj(np.fft.rfft2(counts((p - centre) @ r.T + centre))) for p, w, f in spectra)
        cost = np.fft.irfft2(total, (size, size))[np.ix_(steps % size, steps % size)] / sum(w for _, _, w, _ in used)
        cost = cost + 0.3 * (far / 15) ** 2 + 0.15 * (degrees / 25) ** 2
        p = np.pad(cost, 1, constant_values=-np.inf)  # poses at the edge are no minima
        lowest = np.minimum.reduce([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        i, j = np.nonzero(cost <= lowest)
        found += [(float(cost[a, b]), float(degrees), float(steps[b] * cell), float(steps[a] * cell)) for a, b in zip(i, j, strict=True)]
    out: list[tuple[float, float, float]] = []
    for _, degrees, dx, dy in sorted(found):
        if len(out) < n and not any(abs(o[2] - degrees) < 5 and np.hypot(o[0] - dx, o[1] - dy) < 3 for o in out):
            out.append((dx, dy, degrees))
    return out


def icp_2d(features: list[tuple[np.ndarray, np.ndarray, float]], start: tuple[np.ndarray, np.ndarray], rounds: int = 40, reach: tuple[float, float] = (2.0, 0.3)) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that lay feature points on map points of their kind: (points, map points, weight) each, from a starting pose.

    The reach shrinks evenly over the first six tenths of the rounds.
    """
    r, t = start
    for k in range(rounds):
        radius = reach[0] + (reach[1] - reach[0]) * min(1.0, k / (rounds * 0.6))
        own, theirs, weights = [], [], []
        for p, q, w in features:
            if not len(p) or not len(q):
                continue
            y = p @ r.T + t
            at = nearest(y, q, radius)[1][:, 0]
            own.append(y[at >= 0])
            theirs.append(q[at[at >= 0]])
            weights.append(np.full((at >= 0).sum(), w))
        if not own or np.concatenate(weights).sum() < 5:
            break
        turned, shift = rigid_2d(np.concatenate(own), np.concatenate(theirs), np.concatenate(weights))
        r, t = turned @ r, turned @ t + shift
        if abs(np.arctan2(turned[1, 0], turned[0, 0])) < 1e-6 and np.hypot(*shift) < 1e-4:
            break
    return r, t


def map_fit(features: list[tuple[np.ndarray, np.ndarray, float]], r: np.ndarray, t: np.ndarray, rules: list[tuple[float, float, float]]) -> tuple[float | None, float | None, list[float | None]]:
    """Weighted mean of truncated distances, of kernel costs 1 - exp(-d^2 / sigma^2), and each kind's share nearer than its limit.

    rules: (truncation, sigma, limit) of each kind. A kind without points or map points counts nothing.
    """
    total = mean = cost = 0.0
    shares: list[float | None] = []
    for (p, q, w), (most, sigma, limit) in zip(features, rules, strict=True):
        if not len(p) or not len(q):
            shares.append(None)
            continue
        d = np.minimum(nearest(p @ r.T + t, q, most)[0][:, 0], most)
        mean, cost, total = mean + w * d.mean(), cost + w * (1 - np.exp(-((d / sigma) ** 2))).mean(), total + w
        shares.append(float((d < limit).mean()))
    return (mean / total if total else None), (cost / total if total else None), shares


# Weights, truncations, kernel widths and limits of walls, poles and kerbs; shares that accept a placement.
KINDS = ("wall", "pole", "kerb")
WEIGHTS, MAP_RULES = (1.0, 0.5, 0.0), [(1.5, 0.45, 0.3), (2.0, 1.2, 0.8), (1.0, 0.45, 0.3)]
POLES_OK, LEAST_POLES, WALLS_OK, RUNNER_UP = 0.4, 3, 0.6, 1.15


def on_map(own: dict[str, np.ndarray], mapped: dict[str, np.ndarray], most_shift: float = 25.0, most_yaw: float = 35.0, weights: tuple[float, ...] = WEIGHTS) -> dict:
    """The best placement of features on the map's (points by kind), and whether to apply it: shift of the features' centre (cx, cy) and heading.

    Starts come from map_starts. Applied when enough poles stand at mapped ones, or most walls lie on mapped ones and no
    pose elsewhere is nearly as good; within the limits of shift and heading; and better than where the features were.
    score: the mean distance and the penalty of a far pose; lower is better, null where there is too little to match.
    """
    features = [(own[k], mapped[k], w) for k, w in zip(KINDS, weights, strict=True)]
    empty = {"applied": False, "dx": 0.0, "dy": 0.0, "degrees": 0.0, "cx": 0.0, "cy": 0.0, "mean_m": None, "walls": None, "poles": None, "kerbs": None, "score": None, "runner_up_m": None}
    if (len(own["wall"]) < 40 and len(own["pole"]) < 6) or (len(mapped["wall"]) < 20 and len(mapped["pole"]) < 20 and len(mapped["kerb"]) < 20):
        return empty | {"why": "too little to match"}
    starts = map_starts([(p, q, w, rule[1]) for (p, q, w), rule in zip(features, MAP_RULES, strict=True)], most_shift, most_yaw)
    weighed = [p for p, q, w in features if w and len(q) and len(p)]
    if not starts:
        return empty | {"why": "no candidate"}
    centre = np.concatenate(weighed).mean(axis=0)
    fitted = [f for f in features if f[2]]
    tried = []
    for dx, dy, degrees in starts:
        a = np.radians(degrees)
        r = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        r, t = icp_2d(fitted, (r, centre - r @ centre + [dx, dy]))
        mean, cost, shares = map_fit(features, r, t, MAP_RULES)
        shift, yaw = r @ centre + t - centre, float(np.degrees(np.arctan2(r[1, 0], r[0, 0])))
        tried.append((9.0 if cost is None else cost, mean, shares, shift, yaw))
    far = lambda f: 0.3 * (np.hypot(*f[3]) / 15) ** 2 + 0.15 * (f[4] / 25) ** 2
    penalty = lambda f: f[0] + far(f)
    tried.sort(key=penalty)
    cost, mean, (on_walls, at_poles, on_kerbs), shift, yaw = best = tried[0]
    rivals = [f for f in tried[1:] if np.hypot(*(f[3] - shift)) > 2 and penalty(f) < penalty(best) * RUNNER_UP]
    good = (at_poles is not None and len(own["pole"]) >= LEAST_POLES and at_poles >= POLES_OK) or (on_walls is not None and on_walls >= WALLS_OK and not rivals)
    before = map_fit(features, np.eye(2), np.zeros(2), MAP_RULES)[1]
    why = "walls and poles do not line up" if not good else "too far" if np.hypot(*shift) > most_shift + 3 or abs(yaw) > most_yaw + 3 else "no better than before" if before is not None and cost >= before else ""
    found = {"dx": float(shift[0]), "dy": float(shift[1]), "degrees": yaw, "cx": float(centre[0]), "cy": float(centre[1]), "mean_m": mean, "walls": on_walls, "poles": at_poles, "kerbs": on_kerbs}
    return {"applied": not why, **found, "score": None if mean is None else float(mean + far(best)), "runner_up_m": float(np.hypot(*(rivals[0][3] - shift))) if rivals else None, "why": why}


# ---- over DataFrames ----


PLACED = "applied boolean, dx double, dy double, degrees double, cx double, cy double, mean_m double, walls double, poles double, kerbs double, score double, runner_up_m double, why string"


def placed_on_map(features: DataFrame, mapped: DataFrame, most_shift: float = 25.0, most_yaw: float = 35.0) -> DataFrame:
    """One row per site of features: its placement on the map (see on_map). features and mapped: site, kind (wall, pole or kerb), x, y.

    A site's feature cells and the map's points around it are one task; both are bounded by the site's extent.
    """
    kind = features.schema["site"].dataType.simpleString()
    both = features.select("site", "kind", "x", "y", F.lit(True).alias("own")).unionByName(mapped.select("site", "kind", "x", "y", F.lit(False).alias("own")).join(features.select("site").distinct(), "site", "left_semi"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["x", "y"])
        own, theirs = ({k: rows.loc[(rows["own"] == mine) & (rows["kind"] == k), ["x", "y"]].to_numpy(float) for k in KINDS} for mine in (True, False))
        return pd.DataFrame([{"site": key[0], **on_map(own, theirs, most_shift, most_yaw)}])

    return both.groupBy("site").applyInPandas(run, f"site {kind}, {PLACED}")


def with_normals(points: DataFrame, k: int = 10, radius: float = 0.3, tile: float = 10.0) -> DataFrame:
    """points with nx, ny, nz: tiles with a halo of the radius, so no task holds a scan."""
    c = lambda e: F.floor(e / tile)
    around = lambda e: F.array_distinct(F.array(c(e - radius), c(e), c(e + radius)))
    spread = points.select("scan", "pid", "x", "y", "z", F.explode(around(F.col("x"))).alias("tx"), "y").toDF("scan", "pid", "x", "y", "z", "tx", "_y").drop("_y")
    spread = spread.withColumn("ty", F.explode(around(F.col("y"))))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = normals(rows[["x", "y", "z"]].to_numpy(float), k, radius)
        out = rows[["scan", "pid", "x", "y", "z"]].assign(nx=n[:, 0], ny=n[:, 1], nz=n[:, 2])
        own = (np.floor(rows["x"] / tile) == key[1]) & (np.floor(rows["y"] / tile) == key[2])
        return out[own]

    kind = points.schema["scan"].dataType.simpleString()
    return spread.groupBy("scan", "tx", "ty").applyInPandas(run, f"scan {kind}, pid long, x double, y double, z double, nx double, ny double, nz double")


def _lit(points: DataFrame) -> DataFrame:
    """points with a brightness b, null where they have none."""
    return points.select("scan", "x", "y", "z", (F.col("b") if "b" in points.columns else F.lit(None)).cast("double").alias("b"))


def _sides(rows: pd.DataFrame) -> tuple[tuple[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray | None]]:
    """The points and the brightness of both sides; the brightness counts only where both have one."""
    xyz, bright, side = rows[["x", "y", "z"]].to_numpy(float), rows["b"].to_numpy(float), rows["side"].to_numpy()
    lit = all(np.isfinite(bright[side == k]).any() for k in (0, 1))
    return tuple((xyz[side == k], bright[side == k] if lit else None) for k in (0, 1))  # type: ignore[return-value]


def coarse_search(points: DataFrame, pairs: DataFrame, yaws: list[float], cell: float = 0.2, n: int = 4, most_shift: float | None = None, together: int = 8, least: float = LEAST_OVERLAP) -> DataFrame:
    """Candidate poses of pairs (fixed, moving) with their score and overlap (square metres): `n` of each heading, 2 m apart.

    A task correlates a pair at `together` headings. most_shift: poses that move the moving scan's centre farther are no
    candidates, nor are those that overlap by less than `least` square metres or an eighth of the moving scan. Scans are voxel samples of bounded size (grid.voxel_sample); points may have a brightness b.
    """
    kind = points.schema["scan"].dataType.simpleString()
    blocks = [sorted(map(float, yaws))[k : k + together] for k in range(0, len(yaws), together)]
    tasks = pairs.select("fixed", "moving", F.posexplode(F.array(*[F.array(*map(F.lit, b)) for b in blocks])).alias("block", "yaws"))
    lit = _lit(points)
    a, b = (tasks.join(lit.withColumnRenamed("scan", name), name).select("fixed", "moving", "block", "yaws", F.lit(k).alias("side"), "x", "y", "z", "b") for k, name in enumerate(("fixed", "moving")))
    names = ["fixed", "moving", "yaw", "dx", "dy", "score", "overlap_m2"]

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        (one, light), (two, other) = _sides(rows)
        out = []
        if len(one) > 10 and len(two) > 10:
            fixed = rasters(one, light, cell)
            for yaw in rows["yaws"].iloc[0]:
                turned = turn(two, yaw)
                moving = rasters(turned, other, cell)
                score, overlap = agreement(fixed, moving, max(least / cell**2, LEAST_SHARE * moving.seen.sum()))
                dx = fixed.origin[0] - moving.origin[0] + (np.arange(score.shape[1]) - moving.seen.shape[1] + 1) * cell
                dy = fixed.origin[1] - moving.origin[1] + (np.arange(score.shape[0]) - moving.seen.shape[0] + 1) * cell
                if most_shift is not None:
                    cx, cy = turned[:, :2].mean(axis=0) - two[:, :2].mean(axis=0)
                    score = np.where(np.hypot(dx[None, :] + cx, dy[:, None] + cy) <= most_shift, score, -np.inf)
                out += [(key[0], key[1], float(yaw), float(dx[j]), float(dy[i]), s, float(overlap[i, j] * cell**2)) for i, j, s in peaks(score, n, int(2 / cell)) if s > LEAST_SCORE]
        return pd.DataFrame(out, columns=names)

    return a.unionByName(b).groupBy("fixed", "moving", "block").applyInPandas(run, f"fixed {kind}, moving {kind}, yaw double, dx double, dy double, score double, overlap_m2 double")


def distinct_poses(candidates: DataFrame, most: int, degrees: float = 5.0, metres: float = 2.5) -> DataFrame:
    """The best `most` candidates of each pair (as of coarse_search) that differ from better ones in heading or place. A pair has a few of each heading."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in rows.sort_values(["score", "yaw", "dx", "dy"], ascending=[False, True, True, True]).itertuples(index=False):
            if len(kept) < most and not any(abs(k.yaw - r.yaw) <= degrees and np.hypot(k.px - r.px, k.py - r.py) <= metres for k in kept):
                kept.append(r)
        return pd.DataFrame(kept, columns=rows.columns)[names]

    names = candidates.columns
    where = {"px": F.col("dx"), "py": F.col("dy")}
    return candidates.withColumns(where).groupBy("fixed", "moving").applyInPandas(run, candidates.schema)


def refine(points: DataFrame, poses: DataFrame, dof: int = 6, settle: bool = False) -> DataFrame:
    """ICP of each pose (fixed, moving, yaw, dx, dy): transform, RMS, overlap and the share of conflicting cells.

    settle: the pose is first searched for on 10 cm cells around. Scans are voxel samples of bounded size.
    """
    kind = points.schema["scan"].dataType.simpleString()
    keys = ["fixed", "moving", "yaw", "dx", "dy"]
    p = poses.select(*keys)
    lit = _lit(points)
    a, b = (p.join(lit.withColumnRenamed("scan", name), name).select(*keys, F.lit(k).alias("side"), "x", "y", "z", "b") for k, name in enumerate(("fixed", "moving")))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        (one, light), (two, other) = _sides(rows)
        yaw, dx, dy = finer(one, two, key[2:5], (light, other)) if settle and len(one) and len(two) else key[2:5]
        start = np.eye(4)
        start[:2, :2] = turn(np.eye(3), yaw)[:2, :2].T
        start[:2, 3] = dx, dy
        pose, rms, share = icp(one, two, start, dof)
        conflict = occupancy_conflict(one, two @ pose[:3, :3].T + pose[:3, 3])
        return pd.DataFrame([(*key, pose.ravel().tolist(), rms, share, conflict)], columns=[*keys, "transform", "rms", "overlap", "conflict"])

    return a.unionByName(b).groupBy(*keys).applyInPandas(run, f"fixed {kind}, moving {kind}, yaw double, dx double, dy double, transform array<double>, rms double, overlap double, conflict double")
