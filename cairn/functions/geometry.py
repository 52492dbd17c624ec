"""Column expressions on coordinates: everything stays inside code generation.

Triples are plain tuples of Columns; squares are written as products in a fixed order, so results are the same doubles
on any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def triple(*names: str, of: str = "") -> Triple:
    return tuple(F.col(f"{of}{n}") for n in names or ("x", "y", "z"))


def minus(a: Triple, b: Triple) -> Triple:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Triple, b: Triple) -> Triple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def dist2(a: Triple, b: Triple) -> Column:
    d = minus(a, b)
    return dot(d, d)


def dist(a: Triple, b: Triple) -> Column:
    return F.sqrt(dist2(a, b))


def plane_distance(p: Triple, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Distance from the plane ax + by + cz + d = 0."""
    return F.abs(a * p[0] + b * p[1] + c * p[2] + d) / F.sqrt(a * a + b * b + c * c)


def normal_distance(p: Triple, normal: Triple, through: Triple) -> Column:
    """Distance from the plane through a point with a unit normal."""
    return F.abs(dot(minus(p, through), normal))


def sphere_iou(d: Column, r: float) -> Column:
    """Intersection over union of two balls of radius r whose centres lie d apart.

    With u = d / 2r each ball's shared fraction is f = (1-u)^2 (2+u) / 2, and the ratio is f / (2 - f).
    """
    u = d / (2.0 * r)
    f = (1.0 - u) * (1.0 - u) * (2.0 + u) / 2.0
    return F.when(d == 0, 1.0).when(d >= 2.0 * r, 0.0).otherwise(f / (2.0 - f))


def iou_radius(r: float, threshold: float) -> float:
    """The centre distance below which ``sphere_iou`` exceeds ``threshold``, by bisection (the ratio falls with distance)."""
    lo, hi = 0.0, 2.0 * r
    for _ in range(200):
        mid = (lo + hi) / 2
        u = mid / (2 * r)
        f = (1 - u) * (1 - u) * (2 + u) / 2
        lo, hi = (mid, hi) if f / (2 - f) > threshold else (lo, mid)
    return hi


# --- balls and boxes (a box: centre and half side) ------------------------


def _offsets(q: Triple, centre: Triple) -> Triple:
    return tuple(F.abs(p - c) for p, c in zip(q, centre, strict=True))


def ball_inside_box(q: Triple, r: Column, centre: Triple, half: Column) -> Column:
    dx, dy, dz = _offsets(q, centre)
    return (dx + r < half) & (dy + r < half) & (dz + r < half)


def ball_overlaps_box(q: Triple, r: Column, centre: Triple, half: Column) -> Column:
    """Face, edge and corner cases; a touching corner doesn't count."""
    d = _offsets(q, centre)
    apart = (d[0] > half + r) | (d[1] > half + r) | (d[2] > half + r)
    faces = sum(((x < half).cast("int") for x in d[1:]), (d[0] < half).cast("int"))
    over = [F.greatest(x - half, F.lit(0.0)) for x in d]
    return ~apart & ((faces >= 2) | (over[0] * over[0] + over[1] * over[1] + over[2] * over[2] < r * r))


def slab_overlaps_box(q: Triple, r: Column, centre: Triple, half: Column) -> Column:
    """A loose test: two axes on which [q, q + r] meets the box. It can miss overlaps, so nothing is pruned by it."""
    hits = [((c - half <= p + r) & (c + half >= p)).cast("int") for p, c in zip(q, centre, strict=True)]
    return hits[0] + hits[1] + hits[2] >= 2


def ball_contains_box(q: Triple, r: Column, centre: Triple, half: Column) -> Column:
    far = [x + half for x in _offsets(q, centre)]
    return F.sqrt(far[0] * far[0] + far[1] * far[1] + far[2] * far[2]) < r


def octant(p: Triple, centre: Triple) -> Column:
    """Child number 0 to 7: one bit an axis, set above the centre."""
    bits = [F.when(a > c, 1 << k).otherwise(0) for k, (a, c) in enumerate(zip(p, centre, strict=True))]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


# --- symmetric 3 x 3 matrices ---------------------------------------------


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Triple:
    """The eigenvalues of a symmetric matrix, largest first, by the trigonometric formula."""
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    a, b, c = xx - q, yy - q, zz - q
    p = F.sqrt((a * a + b * b + c * c + 2.0 * off) / 6.0)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, det / (2.0 * p * p * p)).otherwise(0.0)
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3.0
    first = q + 2.0 * p * F.cos(phi)
    third = q + 2.0 * p * F.cos(phi + 2.0 * math.pi / 3.0)
    return first, 3.0 * q - first - third, third


# --- other scalars --------------------------------------------------------


def log_gaussian(cols: list[Column], mean: list[float], variance: list[float]) -> Column:
    """Log density of a Gaussian with diagonal covariance."""
    out = F.lit(-0.5 * sum(math.log(2 * math.pi * v) for v in variance))
    for c, m, v in zip(cols, mean, variance, strict=True):
        out = out - (c - F.lit(m)) * (c - F.lit(m)) / F.lit(2.0 * v)
    return out


def bin_of(v: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based bin of a histogram over [lo, hi]: half-open bins, the last one closed; null outside."""
    at = F.floor((v - lo) * bins / (hi - lo))
    return F.when((v >= lo) & (v <= hi), F.least(at, F.lit(bins - 1)).cast("int"))


def palette(cluster: Column, colours: int = 9) -> Column:
    """Colour slot of a cluster; noise (-1) has one of its own after the others."""
    return F.when(cluster < 0, F.lit(colours)).otherwise(F.pmod(cluster, F.lit(colours))).cast("int")
