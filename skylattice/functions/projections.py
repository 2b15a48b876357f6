"""Closed-form projections of WGS84 longitude and latitude and their inverses, as Column expressions on points.

Known systems: 4326 (as it is), 3857 (web Mercator), 326xx and 327xx (UTM), 6974 (the sinusoidal grid of tiled land products,
on its sphere), 3034 (European conformal conic) and 5070 (American equal-area conic).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let, point

A = 6378137.0
#: Squared eccentricities of WGS84 and GRS80, and the radius of the sinusoidal grid's sphere. Fixed values.
E2_WGS84, E2_GRS80, SPHERE = 0.00669437999014, 0.0066943800229, 6371007.181
#: Conic systems: kind, latitude and longitude of origin, standard parallels, false easting and northing. Fixed values.
CONICS = {3034: ("conformal", 52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0), 5070: ("equal_area", 23.0, -96.0, 29.5, 45.5, 0.0, 0.0)}


def is_known(srid: Column) -> Column:
    return F.coalesce(srid.isin(4326, 3857, 6974, *CONICS) | _is_utm(srid), F.lit(False))


def _branches(srid: Column, srids: Collection[int] | None, by_family: dict[str, Callable[[], Column]], by_conic: Callable[[tuple], Column]) -> Column:
    """The cases of the systems among ``srids``, or of all: each case makes the expression larger for the optimiser."""
    found = lambda test: srids is None or any(x is not None and test(x) for x in srids)
    cases = [(srid == code, by_family[str(code)]) for code in (4326, 3857, 6974) if found(lambda x, code=code: x == code)]
    if found(lambda x: 32600 < x <= 32660 or 32700 < x <= 32760):
        cases.append((_is_utm(srid), by_family["utm"]))
    cases += [(srid == code, lambda conic=conic: by_conic(conic)) for code, conic in CONICS.items() if found(lambda x, code=code: x == code)]
    out = F.when(F.lit(False), point(0.0, 0.0))
    for test, made in cases:
        out = out.when(test, made())
    return out


def forward(p: Column, srid: Column, srids: Collection[int] | None = None) -> Column:
    """A point of longitude and latitude in ``srid``; null for a system that is not known, or not among ``srids`` if given."""
    families = {"4326": lambda: point(p.x, p.y), "3857": lambda: _mercator(p), "6974": lambda: _sinusoidal(p), "utm": lambda: _utm(p, srid)}
    return _branches(srid, srids, families, lambda conic: _conic(p, *conic))


def inverse(p: Column, srid: Column, srids: Collection[int] | None = None) -> Column:
    """Longitude and latitude of a point in ``srid``; null as in ``forward``."""
    families = {"4326": lambda: point(p.x, p.y), "3857": lambda: _mercator_inverse(p), "6974": lambda: _sinusoidal_inverse(p), "utm": lambda: _utm_inverse(p, srid)}
    return _branches(srid, srids, families, lambda conic: _conic_inverse(p, *conic))


def densify(r: Column, pieces: int) -> Column:
    """A ring whose edges are cut into ``pieces`` equal ones, so that their images follow curves."""
    n = F.size(r)
    cut = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: point(a.x + (b.x - a.x) * i / pieces, a.y + (b.y - a.y) * i / pieces))
    return F.when(n < 2, r).otherwise(F.concat(F.flatten(F.zip_with(F.slice(r, 1, n - 1), F.slice(r, 2, n - 1), cut)), F.slice(r, -1, 1)))


def reproject(r: Column, srid: Column, pieces: int = 1, srids: Collection[int] | None = None) -> Column:
    """A ring of longitudes and latitudes in ``srid``; null for a system that is not known."""
    return F.when(is_known(srid), F.transform(densify(r, pieces), lambda p: forward(p, srid, srids)))


def unproject(r: Column, srid: Column, pieces: int = 1, srids: Collection[int] | None = None) -> Column:
    """The other way round."""
    return F.when(is_known(srid), F.transform(densify(r, pieces), lambda p: inverse(p, srid, srids)))


def _is_utm(srid: Column) -> Column:
    return ((srid > 32600) & (srid <= 32660)) | ((srid > 32700) & (srid <= 32760))


def _mercator(p: Column) -> Column:
    return point(F.radians(p.x) * A, F.log(F.tan(F.lit(math.pi / 4) + F.radians(p.y) / 2)) * A)


def _mercator_inverse(p: Column) -> Column:
    return point(F.degrees(p.x / A), F.degrees(2 * F.atan(F.exp(p.y / A)) - math.pi / 2))


def _sinusoidal(p: Column) -> Column:
    return point(F.radians(p.x) * F.cos(F.radians(p.y)) * SPHERE, F.radians(p.y) * SPHERE)


def _sinusoidal_inverse(p: Column) -> Column:
    """Points beyond the globe come to its rim."""
    within = lambda v, most: F.greatest(F.lit(-most), F.least(F.lit(most), v))
    lat = within(p.y / SPHERE, math.pi / 2)
    return point(within(F.degrees(p.x / SPHERE / F.greatest(F.cos(lat), F.lit(1e-12))), 180.0), F.degrees(lat))


def _power(x: Column, n: int) -> Column:
    return F.pow(x, F.lit(float(n)))


def _utm(p: Column, srid: Column) -> Column:
    """Transverse Mercator of the WGS84 ellipsoid by the usual series to the sixth order."""
    e2 = E2_WGS84
    ep2 = e2 / (1 - e2)

    def series(v: Column) -> Column:
        n, t, c, s, phi = v.n, v.t, v.c, v.s, v.phi
        m = A * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
        east = 0.9996 * n * (s + (1 - t + c) * _power(s, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * _power(s, 5) / 120) + 500000.0
        north = 0.9996 * (m + n * F.tan(phi) * (_power(s, 2) / 2 + (5 - t + 9 * c + 4 * c * c) * _power(s, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * _power(s, 6) / 720))
        return point(east, north + F.when(srid > 32700, 10000000.0).otherwise(0.0))

    phi, lam = F.radians(p.y), F.radians(p.x - ((srid % 100) * 6 - 183))
    return let(series, phi=phi, n=A / F.sqrt(1 - e2 * _power(F.sin(phi), 2)), t=_power(F.tan(phi), 2), c=ep2 * _power(F.cos(phi), 2), s=F.cos(phi) * lam)


def _utm_inverse(p: Column, srid: Column) -> Column:
    e2 = E2_WGS84
    ep2, root = e2 / (1 - e2), math.sqrt(1 - e2)
    e1 = (1 - root) / (1 + root)

    def series(v: Column) -> Column:
        foot, flat, c, t, d = v.foot, v.flat, v.c, v.t, v.d
        lat = foot - F.tan(foot) * flat / (1 - e2) * (_power(d, 2) / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * _power(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * _power(d, 6) / 720)
        lon = (d - (1 + 2 * t + c) * _power(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * _power(d, 5) / 120) / F.cos(foot)
        return point((srid % 100) * 6 - 183 + F.degrees(lon), F.degrees(lat))

    def at_foot(v: Column) -> Column:
        flat = 1 - e2 * _power(F.sin(v.foot), 2)
        return let(series, foot=v.foot, flat=flat, c=ep2 * _power(F.cos(v.foot), 2), t=_power(F.tan(v.foot), 2), d=(p.x - 500000.0) * F.sqrt(flat) / (A * 0.9996))

    mu = (p.y - F.when(srid > 32700, 10000000.0).otherwise(0.0)) / 0.9996 / (A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    foot = lambda v: v.mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * v.mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * v.mu) + 151 * e1**3 / 96 * F.sin(6 * v.mu) + 1097 * e1**4 / 512 * F.sin(8 * v.mu)
    return let(lambda v: let(at_foot, foot=foot(v)), mu=mu)


class _Conic:
    """Constants of a conic, by plain numbers."""

    def __init__(self, kind: str, lat0: float, lat1: float, lat2: float):
        e2 = E2_GRS80
        e = math.sqrt(e2)
        sines = [math.sin(math.radians(x)) for x in (lat0, lat1, lat2)]
        m = [math.sqrt((1 - s * s) / (1 - e2 * s * s)) for s in sines]
        if kind == "conformal":
            t = [math.tan(math.pi / 4 - math.radians(x) / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2) for x, s in zip((lat0, lat1, lat2), sines, strict=True)]
            self.n = (math.log(m[1]) - math.log(m[2])) / (math.log(t[1]) - math.log(t[2]))
            self.f = m[1] / (self.n * t[1] ** self.n)
            self.rho0 = A * self.f * t[0] ** self.n
        else:
            q = [_authalic(s, e, math.log) for s in sines]
            self.n = (m[1] ** 2 - m[2] ** 2) / (q[2] - q[1])
            self.f = m[1] ** 2 + self.n * q[1]
            self.rho0 = A * math.sqrt(self.f - self.n * q[0]) / self.n
            self.pole = _authalic(1.0, e, math.log)


def _authalic(s, e: float, log):
    return (1 - e * e) * (s / (1 - e * e * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def _conic(p: Column, kind: str, lat0: float, lon0: float, lat1: float, lat2: float, east: float, north: float) -> Column:
    k, e = _Conic(kind, lat0, lat1, lat2), math.sqrt(E2_GRS80)
    phi, s = F.radians(p.y), F.sin(F.radians(p.y))
    if kind == "conformal":
        rho = A * k.f * F.pow(F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2)), F.lit(k.n))
    else:
        rho = A * F.sqrt(F.greatest(F.lit(0.0), k.f - k.n * _authalic(s, e, F.log))) / k.n
    return let(lambda v: point(east + v.rho * F.sin(v.theta), north + k.rho0 - v.rho * F.cos(v.theta)), rho=rho, theta=k.n * F.radians(p.x - lon0))


def _conic_inverse(p: Column, kind: str, lat0: float, lon0: float, lat1: float, lat2: float, east: float, north: float) -> Column:
    """Latitude by a series from that of a sphere of equal angles or areas, for the latter with a step of Newton's behind it."""
    k, e2 = _Conic(kind, lat0, lat1, lat2), E2_GRS80
    e = math.sqrt(e2)
    if kind == "conformal":
        series = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
    else:
        series = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
    summed = lambda chi: sum((c * F.sin(2 * i * chi) for i, c in enumerate(series, 1)), chi)

    def placed(v: Column) -> Column:
        out = lambda lat: point(F.degrees(v.theta / k.n) + lon0, F.degrees(lat))
        if kind == "conformal":
            return let(lambda w: out(summed(w.chi)), chi=math.pi / 2 - 2 * F.atan(F.pow(v.rho / (A * k.f), F.lit(1 / k.n))))
        q = (k.f - _power(v.rho * k.n / A, 2)) / k.n

        def newton(w: Column) -> Column:
            s = F.sin(w.lat)
            return out(w.lat + _power(1 - e2 * s * s, 2) / (2 * F.cos(w.lat)) * (w.q - _authalic(s, e, F.log)) / (1 - e2))

        return let(lambda w: let(newton, lat=summed(w.chi), q=w.q), chi=F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / k.pole))), q=q)

    return let(lambda w: let(placed, rho=F.sqrt(w.x * w.x + w.y * w.y), theta=F.atan2(w.x, w.y)), x=p.x - east, y=k.rho0 - (p.y - north))
