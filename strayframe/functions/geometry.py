"""Plane geometry as column expressions. +y is to the right of a vehicle that looks along +x."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(a: Column) -> Column:
    """Angle in (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def wrap_degrees(a: Column) -> Column:
    """Degrees in [-180, 180), with the modulo rounded down."""
    return F.pmod(a + 180, F.lit(360.0)) - 180


def turn_rate(yaw: Column, before: Column, dt: float) -> Column:
    return wrap(yaw - before) / dt


def rotated(dx: Column, dy: Column, yaw: Column) -> tuple[Column, Column]:
    """A world vector in the frame of a vehicle with this yaw."""
    return dx * F.cos(yaw) + dy * F.sin(yaw), -dx * F.sin(yaw) + dy * F.cos(yaw)


def along_speed(vx: Column, vy: Column, yaw: Column) -> Column:
    return vx * F.cos(yaw) + vy * F.sin(yaw)


def role(rel_x: Column, rel_y: Column, rel_yaw: Column, *, same: float = 0.7, lane: float = 2.0, beside: float = 5.5) -> Column:
    """lead, follower, left, right, oncoming, crossing, or null."""
    c = F.cos(rel_yaw)
    ahead = F.when(rel_x > 0, "lead").otherwise("follower")
    side = F.when(rel_y < 0, "left").otherwise("right")
    return F.when(c > same, F.when(F.abs(rel_y) <= lane, ahead).when(F.abs(rel_y) <= beside, side)).when(c < -same, "oncoming").otherwise("crossing")


ROLES = ("lead", "follower", "left", "right", "oncoming", "crossing")
#: How far a role is looked for, in metres.
ROLE_RANGE = {"lead": 40.0, "follower": 25.0, "left": 25.0, "right": 25.0, "oncoming": 30.0, "crossing": 25.0}


def role_range(r: Column) -> Column:
    """Looked up in a constant map, so that the role's expression is there once and not once a role."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in ROLE_RANGE.items() for x in pair)), r)


def time_to_collision(rel_x: Column, rel_vx: Column, cap: float = 10.0) -> Column:
    closing = -rel_vx
    return F.when(closing > 0.1, F.least(F.greatest(rel_x / closing, F.lit(0.0)), F.lit(cap))).otherwise(cap)


def depth(r: Column, g: Column, b: Column) -> Column:
    """Metres of a 24-bit depth pixel."""
    return (r + g * 256.0 + b * 65536.0) / (2.0**24 - 1) * 1000.0


def instance_key(tag: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(tag, 16).bitwiseOR(g + b * 256)


def back_projected(u: Column, v: Column, d: Column, cam: dict[str, Column], width: int, height: int, fov: float) -> tuple[Column, Column, Column]:
    """World position of a pixel at a depth, for a camera with x, y, z, pitch, yaw, roll (degrees)."""
    f = width / 2 / F.tan(F.lit(fov * pi / 360))
    right, down = (u - width / 2) * d / f, (v - height / 2) * d / f
    p, y, r = (F.radians(cam[k]) for k in ("pitch", "yaw", "roll"))
    cp, sp, cy, sy, cr, sr = F.cos(p), F.sin(p), F.cos(y), F.sin(y), F.cos(r), F.sin(r)
    up = -down
    x = cp * cy * d + (cy * sp * sr - sy * cr) * right + (-cy * sp * cr - sy * sr) * up
    yy = cp * sy * d + (sy * sp * sr + cy * cr) * right + (-sy * sp * cr + cy * sr) * up
    z = sp * d - cp * sr * right + cp * cr * up
    return cam["x"] + x, cam["y"] + yy, cam["z"] + z


def corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """A centre box as x0, y0, x1, y1."""
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment (which may be a point)."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether a ray to the right from the point meets the edge; inside a polygon if an odd number of edges do."""
    return ((ay > py) != (by > py)) & (px < F.try_divide((bx - ax) * (py - ay), by - ay) + ax)


def in_rotated_box(px: Column, py: Column, pz: Column, box: dict[str, Column], margin: float = 1.0) -> Column:
    """Inside a box with centre x, y, z, half sizes ex, ey, ez and yaw (degrees), widened by a margin."""
    along, across = rotated(px - box["x"], py - box["y"], F.radians(box["yaw"]))
    return (F.abs(along) <= box["ex"] + margin) & (F.abs(across) <= box["ey"] + margin) & (F.abs(pz - box["z"]) <= box["ez"] + margin)


def speed_cap(v_target: Column, gap: Column, decel: Column) -> Column:
    """The speed from which v_target can be reached within a gap."""
    return F.sqrt(v_target * v_target + 2 * decel * F.greatest(gap, F.lit(0.0)))


def bezier(a: Column, c: Column, b: Column, t: Column) -> Column:
    """A quadratic curve from a to b with control point c, one coordinate."""
    return (1 - t) * (1 - t) * a + 2 * (1 - t) * t * c + t * t * b


def lines_meet(px: Column, py: Column, dx: Column, dy: Column, qx: Column, qy: Column, ex: Column, ey: Column) -> tuple[Column, Column]:
    """Where the line from p along d meets the line from q along e; null if they are parallel."""
    t = F.try_divide((qx - px) * ey - (qy - py) * ex, dx * ey - dy * ex)
    return px + dx * t, py + dy * t


def fillet(px: Column, py: Column, dx: Column, dy: Column, qx: Column, qy: Column, ex: Column, ey: Column, radius: float, points: int = 25) -> Column:
    """An array of (x, y): the quadratic curve that turns from direction d (through p) to direction e (through q), both unit
    vectors, on a fillet of this radius about the place where their lines meet."""
    return F.transform(F.array(fillet_controls(px, py, dx, dy, qx, qy, ex, ey, radius)), lambda c: curve(c, points))[0]


def fillet_controls(px: Column, py: Column, dx: Column, dy: Column, qx: Column, qy: Column, ex: Column, ey: Column, radius: float) -> Column:
    """The three points (ax, ay), (bx, by), (cx, cy) that hold the curve of :func:`fillet`. Select them as a column before :func:`curve` is
    taken of it: then they are computed once a row and not once a point."""
    x, y = lines_meet(px, py, dx, dy, qx, qy, ex, ey)
    cosine = F.least(F.greatest(dx * ex + dy * ey, F.lit(-1.0)), F.lit(1.0))
    reach = F.lit(radius) * F.tan(F.acos(cosine) / 2)
    held = {"ax": x - reach * dx, "ay": y - reach * dy, "bx": x, "by": y, "cx": x + reach * ex, "cy": y + reach * ey}
    return F.struct(*(v.alias(k) for k, v in held.items()))


def curve(c: Column, points: int = 25) -> Column:
    """An array of (x, y) at even steps along the quadratic curve of three points."""
    steps = [F.lit(i / float(points - 1)) for i in range(points)]
    return F.array(*(F.struct(bezier(c["ax"], c["bx"], c["cx"], t).alias("x"), bezier(c["ay"], c["by"], c["cy"], t).alias("y")) for t in steps))
