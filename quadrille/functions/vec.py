"""Three-vectors as triples of columns; every helper is a plain column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class V3:
    x: Column
    y: Column
    z: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> V3:
        return V3(*(F.col(f"{prefix}{c}{suffix}") for c in "xyz"))

    @staticmethod
    def field(col: Column) -> V3:
        """From a struct of x, y and z."""
        return V3(col["x"], col["y"], col["z"])

    def __add__(self, o: V3) -> V3:
        return V3(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: V3) -> V3:
        return V3(self.x - o.x, self.y - o.y, self.z - o.z)

    def __mul__(self, s) -> V3:
        return V3(self.x * s, self.y * s, self.z * s)

    def __truediv__(self, s) -> V3:
        return V3(self.x / s, self.y / s, self.z / s)

    def dot(self, o: V3) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: V3) -> V3:
        return V3(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def squared(self) -> Column:
        return self.dot(self)

    def length(self) -> Column:
        return F.sqrt(self.squared())

    def unit(self) -> V3:
        """Unit vector; the zero vector stays zero."""
        n = self.length()
        return V3(*(F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in (self.x, self.y, self.z)))

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def angle(a: V3, b: V3) -> Column:
    """Degrees between two directions, the cosine held to [-1, 1]; zero vectors count as square."""
    return F.degrees(F.acos(F.least(F.greatest(a.unit().dot(b.unit()), F.lit(-1.0)), F.lit(1.0))))


def corner_angle(before: V3, at: V3, after: V3) -> Column:
    """Degrees at the middle of three points."""
    return angle(before - at, after - at)


def rotate(v: V3, axis: V3, degrees: Column) -> V3:
    """Rotation around an axis by Rodrigues' formula."""
    k, c, s = axis.unit(), F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return v * c + k.cross(v) * s + k * (k.dot(v) * (F.lit(1.0) - c))


def point_segment(p: V3, a: V3, b: V3) -> Column:
    """Distance of a point from a segment by clamped projection."""
    d = b - a
    t = F.when(d.squared() > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - a).dot(d) / d.squared()))).otherwise(F.lit(0.0))
    return (p - (a + d * t)).length()


def point_triangle(p: V3, a: V3, b: V3, c: V3) -> Column:
    """Distance of a point from a triangle: its plane where the foot lies inside, else the nearest side."""
    n = (b - a).cross(c - a)
    inside = (n.squared() > 0) & (n.dot((b - a).cross(p - a)) >= 0) & (n.dot((c - b).cross(p - b)) >= 0) & (n.dot((a - c).cross(p - c)) >= 0)
    return F.when(inside, F.abs((p - a).dot(n)) / n.length()).otherwise(F.least(point_segment(p, a, b), point_segment(p, b, c), point_segment(p, c, a)))


def point_box(p: V3, low: V3, high: V3) -> Column:
    """Distance of a point from an axis-aligned box; zero inside."""
    gap = lambda v, a, b: F.greatest(a - v, F.lit(0.0), v - b)
    return V3(gap(p.x, low.x, high.x), gap(p.y, low.y, high.y), gap(p.z, low.z, high.z)).length()
