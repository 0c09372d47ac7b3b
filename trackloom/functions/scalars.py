"""Scalar functions as Column builders: everything stays in generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 99.9th percentile displacement envelope (seconds, metres) and the
# 95th percentile one in pixels (seconds, pixels).
ENVELOPE_M = ((0.15, 0.96), (0.27, 1.20), (0.41, 1.76), (0.62, 2.63), (0.88, 3.33), (1.25, 4.58), (1.75, 5.69), (2.50, 7.32), (3.50, 8.86), (5.00, 10.79))
ENVELOPE_PX = ((0.5, 149.0), (1.0, 267.0), (2.0, 426.0), (3.0, 518.0), (4.0, 562.0), (6.0, 596.0))
MAX_SPEED, MAX_ACCEL = 5.5, 8.0

_EDGE_WHITE = "^[\\s\\u00A0\\uFEFF]+|[\\s\\u00A0\\uFEFF]+$"


def c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# -- text to values -----------------------------------------------------------
def trimmed(x) -> Column:
    """Text without white space at either end (tabs, newlines and no-break spaces
    too); null becomes ''."""
    return F.regexp_replace(F.coalesce(c(x), F.lit("")), _EDGE_WHITE, "")


def leading_number(x) -> Column:
    """The number that a text starts with (leading white space skipped), else 0."""
    found = F.regexp_extract(trimmed(x), "^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?", 0)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def flag(x) -> Column:
    """Whether a text says yes: true, yes, 1 or x in any case."""
    return F.lower(trimmed(x)).isin("true", "yes", "1", "x")


def rational(x) -> Column:
    """'a/b' or a plain number as a double; null if it is neither or b is 0."""
    part = F.split(c(x), "/")
    top, bottom = F.get(part, F.lit(0)).try_cast("double"), F.get(part, F.lit(1)).try_cast("double")
    return F.when(F.size(part) == 1, top).when((F.size(part) == 2) & (bottom != 0), top / bottom)


def video_id(x) -> Column:
    """The 11-character id in a watch, share, embed or live address, or a bare id."""
    from_url = F.regexp_extract(c(x), "(?:[?&]v=|youtu\\.be/|/embed/|/live/|/shorts/)([A-Za-z0-9_-]{11})", 1)
    return F.when(c(x).rlike("^[A-Za-z0-9_-]{11}$"), c(x)).when(from_url != "", from_url)


def event_year(x) -> Column:
    """The four digits an event key starts with, else null."""
    y = F.regexp_extract(F.coalesce(c(x), F.lit("")), "^(\\d{4})", 1)
    return F.when(y != "", y)


def strip_team_prefix(x) -> Column:
    return F.regexp_replace(c(x), "^frc", "")


def iso_seconds(x) -> Column:
    return F.date_format(c(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def last_meaningful_line(x) -> Column:
    """The last line with text; '' without one."""
    lines = F.filter(F.transform(F.split(F.coalesce(c(x), F.lit("")), "\n"), lambda v: trimmed(v)), lambda v: v != "")
    return F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))


def canonical_hash(*named: tuple[str, Column]) -> Column:
    """sha256 of the JSON object with keys in order: independent of field order."""
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(named, key=lambda p: p[0])])), 256)


# -- rounding -----------------------------------------------------------------
def half_up(x) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(c(x) + 0.5)


def half_even(x, digits: int = 0) -> Column:
    return F.bround(c(x), digits)


def percent(part, whole) -> Column:
    """round(100 part / max(whole, 1))."""
    return half_up(c(part) / F.greatest(c(whole), F.lit(1)) * 100)


def bin_start(t, width: float) -> Column:
    return F.floor(c(t) / width) * width


# -- shares -------------------------------------------------------------------
def share_weighted(own, group, total) -> Column:
    """total x own / group, a third of it where the group has nothing; null total: null."""
    return F.when(c(total).isNotNull(), F.when(c(group) > 0, c(own) / c(group)).otherwise(F.lit(1.0) / 3) * c(total))


def split_by_ratio(total, first, second) -> tuple[Column, Column]:
    """A total split like first : second, in halves where both are 0."""
    ratio = F.when(c(first) + c(second) > 0, c(first) / (c(first) + c(second))).otherwise(0.5)
    return c(total) * ratio, c(total) * (1 - ratio)


def weighted_points(weights: dict[str, float], null_as_zero: bool = True) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + (F.coalesce(F.col(name), F.lit(0)) if null_as_zero else F.col(name)) * float(w)
    return out


def sum_if_all(*cols) -> Column:
    """The sum, null where a part is null."""
    out = c(cols[0])
    for x in cols[1:]:
        out = out + c(x)
    return out


def truthy_or(x, default) -> Column:
    """x, but the default where it is null or 0."""
    return F.when(c(x).isNull() | (c(x) == 0), F.lit(default)).otherwise(c(x))


def tier(x, steps: Sequence[tuple[float, str]] = ((0.95, "top"), (0.80, "high"), (0.60, "mid"), (0.35, "low")), rest: str = "bottom") -> Column:
    out = None
    for bound, name in steps:
        out = F.when(c(x) >= bound, name) if out is None else out.when(c(x) >= bound, name)
    return out.otherwise(rest)


def compatible(a, b) -> Column:
    """Equal, or one of them unknown."""
    return c(a).isNull() | c(b).isNull() | (c(a) == c(b))


# -- motion -------------------------------------------------------------------
def piecewise(x, knots: Sequence[tuple[float, float]], extend: bool) -> Column:
    """Linear between knots, flat below the first; past the last it goes on at the
    last slope (``extend``) or stays flat."""
    out = F.when(c(x) <= knots[0][0], F.lit(knots[0][1]))
    for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False):
        out = out.when(c(x) <= t1, F.lit(d0) + F.lit(d1 - d0) * (c(x) - t0) / (t1 - t0))
    (ta, da), (tb, db) = knots[-2:]
    return out.otherwise(F.lit(db) + F.lit((db - da) / (tb - ta)) * (c(x) - tb) if extend else F.lit(db))


def distance_budget(dt) -> Column:
    return piecewise(dt, ENVELOPE_M, extend=True)


def pixel_budget(gap) -> Column:
    return piecewise(gap, ENVELOPE_PX, extend=False)


def reachable(distance, dt, speed) -> Column:
    """Within reach from ``speed``: acceleration and top speed bound it, with slack."""
    limit = F.least(c(speed) * c(dt) + c(dt) * c(dt) * (MAX_ACCEL / 2), c(dt) * MAX_SPEED)
    return (c(dt) > 0) & (c(distance) <= limit * 1.25 + 0.35)


def hide_budget(diagonal, speed, cap: float = 20.0) -> Column:
    return F.least(F.lit(cap), c(diagonal) / c(speed) + 2)


def parked(gap, moved, longest: float = 180.0, most: float = 60.0) -> Column:
    return (c(gap) <= longest) & (c(moved) <= most)


# -- boxes and planes ---------------------------------------------------------
def _overlap(a0, a1, b0, b1) -> Column:
    return F.greatest(F.lit(0.0), F.least(c(a1), c(b1)) - F.greatest(c(a0), c(b0)))


def box(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{k}") for k in ("x1", "y1", "x2", "y2"))


def box_area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a, b) -> Column:
    return _overlap(a[0], a[2], b[0], b[2]) * _overlap(a[1], a[3], b[1], b[3])


def iou(a, b) -> Column:
    i = intersection(a, b)
    union = box_area(a) + box_area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def containment(a, b) -> Column:
    """Intersection over the smaller box."""
    least = F.least(box_area(a), box_area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def vertical_overlap(a, b) -> Column:
    """Shared height over the smaller height."""
    least = F.least(a[3] - a[1], b[3] - b[1])
    return F.when(least > 0, _overlap(a[1], a[3], b[1], b[3]) / least).otherwise(0.0)


def offset_in_widths(a, b) -> Column:
    width = ((a[2] - a[0]) + (b[2] - b[0])) / 2
    return F.when(width > 0, F.abs((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2) / width)


def foot(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, b[3]


def project(x, y, h: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """A point through a 3x3 homography."""
    w = c(x) * h[2][0] + c(y) * h[2][1] + h[2][2]
    return (c(x) * h[0][0] + c(y) * h[0][1] + h[0][2]) / w, (c(x) * h[1][0] + c(y) * h[1][1] + h[1][2]) / w


def pixels_to_metres(x, y, x0: float, y1: float, per_metre: float) -> tuple[Column, Column]:
    """Field-image pixels to metres, origin bottom left, y up."""
    return (c(x) - x0) / per_metre, (F.lit(y1) - c(y)) / per_metre


def metres_to_pixels(x, y, x0: float, y1: float, per_metre: float) -> tuple[Column, Column]:
    return c(x) * per_metre + x0, F.lit(y1) - c(y) * per_metre


def corrected(x, y, steps: Sequence[dict]) -> tuple[Column, Column]:
    """A position through ordered steps: ``radialShift`` moves it away from a point by
    so many metres, ``similarity`` scales about the origin and translates. Other
    steps are refused, so that nothing is half applied."""
    x, y = c(x), c(y)
    for step in steps:
        if step["op"] == "radialShift":
            cx, cy = map(float, step["fromXY"])
            n = F.hypot(x - cx, y - cy)
            far = F.when(n > 1e-9, float(step["meters"]) / n).otherwise(0.0)
            x, y = x + (x - cx) * far, y + (y - cy) * far
        elif step["op"] == "similarity" and step.get("about", "origin") == "origin":
            k, (tx, ty) = float(step["scale"]), map(float, step["translationM"])
            x, y = x * k + tx, y * k + ty
        else:
            raise ValueError(f"unknown step {step!r}")
    return x, y


def fold_radius(k1: float, k2: float) -> float:
    """The radius past which r (1 + k1 r^2 + k2 r^4) turns back; inf if nowhere.

    Its slope is 1 + b u + a u^2 in u = r^2. The roots' product is 1 / a and their sum
    -b / a, so with q = -(b + sign(b) sqrt(b^2 - 4 a)) / 2 they are q / a and 1 / q,
    neither of them a difference of near numbers, and a = 0 needs no case of its own.
    """
    a, b = 5 * k2, 3 * k1
    inner = b * b - 4 * a
    if inner < 0:
        return math.inf
    q = -(b + math.copysign(math.sqrt(inner), b)) / 2
    turns = ([1 / q] if q else []) + ([q / a] if a else [])
    return math.sqrt(min((u for u in turns if u > 0), default=math.inf))


def distort(x, y, f: float, k1: float, k2: float, cx: float, cy: float) -> tuple[Column, Column]:
    """Radial lens model, NaN past the fold."""
    u, v = (c(x) - cx) / f, (c(y) - cy) / f
    r2 = u * u + v * v
    g = F.lit(1.0) + r2 * k1 + r2 * r2 * k2
    limit = fold_radius(k1, k2)
    bad = F.lit(False) if math.isinf(limit) else F.sqrt(r2) >= limit
    nan = F.lit(float("nan"))
    return F.when(bad, nan).otherwise(u * g * f + cx), F.when(bad, nan).otherwise(v * g * f + cy)


def undistort(x, y, f: float, k1: float, k2: float, cx: float, cy: float, rounds: int = 20) -> tuple[Column, Column]:
    """The inverse, by fixed-point steps on the radius folded over a fixed sequence."""
    u, v = (c(x) - cx) / f, (c(y) - cy) / f
    r = F.sqrt(u * u + v * v)
    true = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), r, lambda a, _: r / (F.lit(1.0) + a * a * k1 + a * a * a * a * k2))
    scale = F.when(r > 0, true / r).otherwise(1.0)
    return u * scale * f + cx, v * scale * f + cy


def undistorted(df: DataFrame, x: str, y: str, names: tuple[str, str], f: float, k1: float, k2: float, cx: float, cy: float, rounds: int = 20) -> DataFrame:
    """:func:`undistort` for a whole table: each step is a column of its own, which Spark
    compiles; a fold's lambda is interpreted for every row and step."""
    u, v = (c(x) - cx) / f, (c(y) - cy) / f
    d = df.withColumn("_r", F.sqrt(u * u + v * v)).withColumn("_a", F.col("_r"))
    a, r = F.col("_a"), F.col("_r")
    for _ in range(rounds):
        d = d.withColumn("_a", r / (F.lit(1.0) + a * a * k1 + a * a * a * a * k2))
    d = d.withColumn("_a", F.when(r > 0, a / r).otherwise(1.0))
    return d.select(*df.columns, (u * a * f + cx).alias(names[0]), (v * a * f + cy).alias(names[1]))


def inside_polygon(x, y, polygon) -> Column:
    """Even-odd test against ``polygon``, an array of [x, y] arrays."""
    p, n = c(polygon), F.size(c(polygon))

    def step(acc, i):
        a, b = F.get(p, i), F.get(p, (i + 1) % n)
        ax, ay, bx, by = a[0], a[1], b[0], b[1]
        crosses = ((ay > c(y)) != (by > c(y))) & (c(x) < (bx - ax) * (c(y) - ay) / F.when(by != ay, by - ay) + ax)
        return acc != F.coalesce(crosses, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def distance_to_outline(x, y, polygon, closed: bool = True) -> Column:
    """Least distance to the segments of an outline (or of an open polyline)."""
    p, n = c(polygon), F.size(c(polygon))

    def one(i):
        a, b = F.get(p, i), F.get(p, (i + 1) % n)
        dx, dy = b[0] - a[0], b[1] - a[1]
        length = dx * dx + dy * dy
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((c(x) - a[0]) * dx + (c(y) - a[1]) * dy) / length))).otherwise(0.0)
        return F.hypot(c(x) - (a[0] + t * dx), c(y) - (a[1] + t * dy))

    return F.array_min(F.transform(F.sequence(F.lit(0), n - (1 if closed else 2)), one))


# -- vectors ------------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(a) -> Column:
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, F.transform(c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(c(a), lambda x: x.cast("double")))


def cosine(a, b) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fuse_views(upper, whole) -> Column:
    """Two views as one unit vector, each with half the squared weight."""
    w = math.sqrt(0.5)
    return F.concat(F.transform(unit(upper), lambda x: x * w), F.transform(unit(whole), lambda x: x * w))
