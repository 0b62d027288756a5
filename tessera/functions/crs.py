"""Coordinate reference systems: definitions, their constants, and projections as native columns.

A system is a definition in the `+key=value` notation or an EPSG code that stands for one. From it follow, once and on the driver, the
constants of its projection; the formulas then are plain arithmetic on columns. In them a constant is a number, where a whole
table has one system, or a field of a joined row, where each row names its own.

All ellipsoidal formulas go through the isometric latitude psi(phi) = atanh(sin phi) - e atanh(e sin phi), whose way back is a series in
the third flattening n; series end after the fourth power, beyond which the rest is below a tenth of a millimetre.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from math import asin, atanh, cos, exp, log, pi, radians, sin, sqrt, tanh

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: semi-major axis and inverse flattening (0: a sphere) of the ellipsoids
ELLIPSOIDS = {
    "GRS80": (6378137.0, 298.257222101),
    "WGS84": (6378137.0, 298.257223563),
    "bessel": (6377397.155, 299.1528128),
    "airy": (6377563.396, 299.3249646),
    "mod_airy": (6377340.189, 299.3249646),
    "intl": (6378388.0, 297.0),
    "clrk66": (6378206.4, 294.9786982),
    "clrk80ign": (6378249.2, 293.4660212936269),
    "krass": (6378245.0, 298.3),
    "sphere": (6378137.0, 0.0),
}
# fixed values: prime meridians in degrees
MERIDIANS = {"greenwich": 0.0, "paris": 2.33722916667, "oslo": 10.7229166667, "ferro": -17.6666666667}

# fixed values: shifts to WGS 84 in metres, arc seconds (position vector) and parts per million
_RT90 = "+ellps=bessel +towgs84=414.1,41.3,603.1,-0.855,2.141,-7.023,0"
_OSGB = "+ellps=airy +towgs84=446.448,-125.157,542.06,0.15,0.247,0.842,-20.489"
_TM75 = "+ellps=mod_airy +towgs84=482.5,-130.6,564.6,-1.042,-0.214,-0.631,8.15"
_DHDN = "+ellps=bessel +towgs84=598.1,73.7,418.2,0.202,0.045,-2.455,6.7"
_MGI = "+ellps=bessel +towgs84=577.326,90.129,463.919,5.137,1.474,5.297,2.4232"
_RD = "+ellps=bessel +towgs84=565.4171,50.3319,465.5524,-0.398957388243134,0.343987817378283,-1.87740163998045,4.0725"
_BD72 = "+ellps=intl +towgs84=-106.8686,52.2978,-103.7239,0.3366,-0.457,1.8422,-1.2747"
_ED50 = "+ellps=intl +towgs84=-87,-98,-121"
_KKJ = "+ellps=intl +towgs84=-96.062,-82.428,-121.753,4.801,0.345,-1.376,1.496"
_MARIO = "+ellps=intl +towgs84=-104.1,-49.1,-9.9,0.971,-2.917,0.714,-11.68"
_PULKOVO = "+ellps=krass +towgs84=23.92,-141.27,-80.9,0,0.35,0.82,-0.12"
_NTF = "+ellps=clrk80ign +towgs84=-168,-60,320"
_CH = "+ellps=bessel +towgs84=674.374,15.056,405.346"

# fixed values: definitions of codes
DEFINITIONS = {
    4326: "+proj=longlat +ellps=WGS84",
    4258: "+proj=longlat +ellps=GRS80",
    4269: "+proj=longlat +ellps=GRS80",
    4619: "+proj=longlat +ellps=GRS80",
    4171: "+proj=longlat +ellps=GRS80",
    4283: "+proj=longlat +ellps=GRS80",
    4167: "+proj=longlat +ellps=GRS80",
    4124: f"+proj=longlat {_RT90}",
    4277: f"+proj=longlat {_OSGB}",
    4300: f"+proj=longlat {_TM75}",
    4314: f"+proj=longlat {_DHDN}",
    4312: f"+proj=longlat {_MGI}",
    4289: f"+proj=longlat {_RD}",
    4313: f"+proj=longlat {_BD72}",
    4230: f"+proj=longlat {_ED50}",
    4123: f"+proj=longlat {_KKJ}",
    4265: f"+proj=longlat {_MARIO}",
    4284: f"+proj=longlat {_PULKOVO}",
    4275: f"+proj=longlat {_NTF}",
    4149: f"+proj=longlat {_CH}",
    3857: "+proj=merc +ellps=sphere",
    3785: "+proj=merc +ellps=sphere",
    900913: "+proj=merc +ellps=sphere",
    3395: "+proj=merc +ellps=WGS84",
    3006: "+proj=tmerc +lon_0=15 +k=0.9996 +x_0=500000 +ellps=GRS80",
    3007: "+proj=tmerc +lon_0=12 +k=1 +x_0=150000 +ellps=GRS80",
    3008: "+proj=tmerc +lon_0=13.5 +k=1 +x_0=150000 +ellps=GRS80",
    3009: "+proj=tmerc +lon_0=15 +k=1 +x_0=150000 +ellps=GRS80",
    3010: "+proj=tmerc +lon_0=16.5 +k=1 +x_0=150000 +ellps=GRS80",
    3011: "+proj=tmerc +lon_0=18 +k=1 +x_0=150000 +ellps=GRS80",
    3012: "+proj=tmerc +lon_0=14.25 +k=1 +x_0=150000 +ellps=GRS80",
    3013: "+proj=tmerc +lon_0=15.75 +k=1 +x_0=150000 +ellps=GRS80",
    3014: "+proj=tmerc +lon_0=17.25 +k=1 +x_0=150000 +ellps=GRS80",
    3015: "+proj=tmerc +lon_0=18.75 +k=1 +x_0=150000 +ellps=GRS80",
    3016: "+proj=tmerc +lon_0=20.25 +k=1 +x_0=150000 +ellps=GRS80",
    3017: "+proj=tmerc +lon_0=21.75 +k=1 +x_0=150000 +ellps=GRS80",
    3018: "+proj=tmerc +lon_0=23.25 +k=1 +x_0=150000 +ellps=GRS80",
    3019: f"+proj=tmerc +lon_0=11.30827777777778 +k=1 +x_0=1500000 {_RT90}",
    3020: f"+proj=tmerc +lon_0=13.55827777777778 +k=1 +x_0=1500000 {_RT90}",
    3021: f"+proj=tmerc +lon_0=15.80827777777778 +k=1 +x_0=1500000 {_RT90}",
    3022: f"+proj=tmerc +lon_0=18.05827777777778 +k=1 +x_0=1500000 {_RT90}",
    3023: f"+proj=tmerc +lon_0=20.30827777777778 +k=1 +x_0=1500000 {_RT90}",
    3024: f"+proj=tmerc +lon_0=22.55827777777778 +k=1 +x_0=1500000 {_RT90}",
    3067: "+proj=tmerc +lon_0=27 +k=0.9996 +x_0=500000 +ellps=GRS80",
    2393: f"+proj=tmerc +lon_0=27 +k=1 +x_0=3500000 {_KKJ}",
    2154: "+proj=lcc +lat_0=46.5 +lon_0=3 +lat_1=49 +lat_2=44 +x_0=700000 +y_0=6600000 +ellps=GRS80",
    27571: f"+proj=lcc +lat_1=49.5 +lat_0=49.5 +lon_0=0 +k=0.999877341 +x_0=600000 +y_0=200000 +pm=paris {_NTF}",
    27572: f"+proj=lcc +lat_1=46.8 +lat_0=46.8 +lon_0=0 +k=0.99987742 +x_0=600000 +y_0=2200000 +pm=paris {_NTF}",
    27700: f"+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 {_OSGB}",
    29902: f"+proj=tmerc +lat_0=53.5 +lon_0=-8 +k=1.000035 +x_0=200000 +y_0=250000 {_TM75}",
    29903: f"+proj=tmerc +lat_0=53.5 +lon_0=-8 +k=1.000035 +x_0=200000 +y_0=250000 {_TM75}",
    2157: "+proj=tmerc +lat_0=53.5 +lon_0=-8 +k=0.99982 +x_0=600000 +y_0=750000 +ellps=GRS80",
    31466: f"+proj=tmerc +lon_0=6 +k=1 +x_0=2500000 {_DHDN}",
    31467: f"+proj=tmerc +lon_0=9 +k=1 +x_0=3500000 {_DHDN}",
    31468: f"+proj=tmerc +lon_0=12 +k=1 +x_0=4500000 {_DHDN}",
    31469: f"+proj=tmerc +lon_0=15 +k=1 +x_0=5500000 {_DHDN}",
    31254: f"+proj=tmerc +lon_0=10.33333333333333 +k=1 +y_0=-5000000 {_MGI}",
    31255: f"+proj=tmerc +lon_0=13.33333333333333 +k=1 +y_0=-5000000 {_MGI}",
    31256: f"+proj=tmerc +lon_0=16.33333333333333 +k=1 +y_0=-5000000 {_MGI}",
    31287: f"+proj=lcc +lat_1=49 +lat_2=46 +lat_0=47.5 +lon_0=13.33333333333333 +x_0=400000 +y_0=400000 {_MGI}",
    31370: f"+proj=lcc +lat_1=51.16666723333333 +lat_2=49.8333339 +lat_0=90 +lon_0=4.367486666666666 +x_0=150000.013 +y_0=5400088.438 {_BD72}",
    3812: "+proj=lcc +lat_1=49.83333333333334 +lat_2=51.16666666666666 +lat_0=50.797815 +lon_0=4.359215833333333 +x_0=649328 +y_0=665262 +ellps=GRS80",
    28992: f"+proj=sterea +lat_0=52.15616055555555 +lon_0=5.38763888888889 +k=0.9999079 +x_0=155000 +y_0=463000 {_RD}",
    2056: f"+proj=somerc +lat_0=46.95240555555556 +lon_0=7.439583333333333 +k=1 +x_0=2600000 +y_0=1200000 {_CH}",
    21781: f"+proj=somerc +lat_0=46.95240555555556 +lon_0=7.439583333333333 +k=1 +x_0=600000 +y_0=200000 {_CH}",
    3003: f"+proj=tmerc +lon_0=9 +k=0.9996 +x_0=1500000 {_MARIO}",
    3004: f"+proj=tmerc +lon_0=15 +k=0.9996 +x_0=2520000 {_MARIO}",
    2180: "+proj=tmerc +lon_0=19 +k=0.9993 +x_0=500000 +y_0=-5300000 +ellps=GRS80",
    2176: "+proj=tmerc +lon_0=15 +k=0.999923 +x_0=5500000 +ellps=GRS80",
    2177: "+proj=tmerc +lon_0=18 +k=0.999923 +x_0=6500000 +ellps=GRS80",
    2178: "+proj=tmerc +lon_0=21 +k=0.999923 +x_0=7500000 +ellps=GRS80",
    2179: "+proj=tmerc +lon_0=24 +k=0.999923 +x_0=8500000 +ellps=GRS80",
    3059: "+proj=tmerc +lon_0=24 +k=0.9996 +x_0=500000 +y_0=-6000000 +ellps=GRS80",
    3346: "+proj=tmerc +lon_0=24 +k=0.9998 +x_0=500000 +ellps=GRS80",
    3301: "+proj=lcc +lat_1=59.33333333333334 +lat_2=58 +lat_0=57.51755393055556 +lon_0=24 +x_0=500000 +y_0=6375000 +ellps=GRS80",
    3057: "+proj=lcc +lat_1=64.25 +lat_2=65.75 +lat_0=65 +lon_0=-19 +x_0=500000 +y_0=500000 +ellps=GRS80",
    3034: "+proj=lcc +lat_1=35 +lat_2=65 +lat_0=52 +lon_0=10 +x_0=4000000 +y_0=2800000 +ellps=GRS80",
    3035: "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80",
    3347: "+proj=lcc +lat_1=49 +lat_2=77 +lat_0=63.390675 +lon_0=-91.86666666666666 +x_0=6200000 +y_0=3000000 +ellps=GRS80",
    3978: "+proj=lcc +lat_1=49 +lat_2=77 +lat_0=49 +lon_0=-95 +ellps=GRS80",
    5070: "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=GRS80",
    3310: "+proj=aea +lat_1=34 +lat_2=40.5 +lat_0=0 +lon_0=-120 +y_0=-4000000 +ellps=GRS80",
    3413: "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +ellps=WGS84",
    3995: "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=0 +ellps=WGS84",
    3031: "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +ellps=WGS84",
    32661: "+proj=stere +lat_0=90 +k=0.994 +lon_0=0 +x_0=2000000 +y_0=2000000 +ellps=WGS84",
    32761: "+proj=stere +lat_0=-90 +k=0.994 +lon_0=0 +x_0=2000000 +y_0=2000000 +ellps=WGS84",
    2193: "+proj=tmerc +lon_0=173 +k=0.9996 +x_0=1600000 +y_0=10000000 +ellps=GRS80",
}


def _zone(zone: int, south: bool, datum: str) -> str:
    return f"+proj=tmerc +lon_0={6 * zone - 183} +k=0.9996 +x_0=500000 +y_0={10_000_000 if south else 0} {datum}"


def zoned() -> dict[int, str]:
    """Definitions of the codes that follow from a zone's number."""
    out = {}
    for z in range(1, 61):
        out[32600 + z], out[32700 + z] = _zone(z, False, "+ellps=WGS84"), _zone(z, True, "+ellps=WGS84")
        out[25800 + z] = _zone(z, False, "+ellps=GRS80")
    for z in range(1, 24):
        out[26900 + z] = _zone(z, False, "+ellps=GRS80")
    for z in range(28, 39):
        out[23000 + z] = _zone(z, False, _ED50)
    for z in range(48, 59):
        out[28300 + z] = _zone(z, True, "+ellps=GRS80")
    for z in range(2, 33):
        out[28400 + z] = f"+proj=tmerc +lon_0={6 * z - 3} +k=1 +x_0={1_000_000 * z + 500_000} {_PULKOVO}"
    for z in range(5, 31):
        out[5100 + z] = f"+proj=tmerc +lat_0=58 +lon_0={z + 0.5} +k=1 +x_0=100000 +y_0=1000000 +ellps=GRS80"
    for z in range(19, 32):
        out[3854 + z] = f"+proj=tmerc +lon_0={z} +k=1 +x_0={1_000_000 * z + 500_000} +ellps=GRS80"
    return out


class UnknownSystem(ValueError):
    """A code or definition without a closed form here."""


@dataclass(frozen=True)
class System:
    """A reference system: projection, its constants by name, and the datum (axis, eccentricity, shift to WGS 84)."""

    kind: str
    constants: tuple[tuple[str, float], ...]

    @property
    def datum(self) -> tuple:
        return tuple((k, v) for k, v in self.constants if k in _DATUM)

    @property
    def shifted(self) -> bool:
        return any(v for k, v in self.constants if k in _SHIFT)


_SHIFT = ("dx", "dy", "dz", "rx", "ry", "rz", "ds")
_DATUM = ("ga", "ge", *_SHIFT)
#: constants of every system, and those that only some projections have
NAMES = (*_DATUM, "e", "pm", "lon0", "x0", "y0", "unit", "size", *[f"f{j}" for j in range(1, 5)], *[f"b{j}" for j in range(1, 5)], *[f"d{j}" for j in range(1, 5)], "n", "rho0", "qp", "beta0", "stretch", "chi0", "add")
KINDS = ("longlat", "tmerc", "lcc", "merc", "laea", "aea", "sterea", "somerc")


def code_of(crs: int | str) -> int | None:
    text = str(crs).strip().upper().removeprefix("EPSG:")
    return int(text) if text.isdigit() else None


@cache
def system(crs: int | str) -> System:
    """A system by its code (3006, "EPSG:3006") or definition ("+proj=tmerc +lon_0=15 ...")."""
    code = code_of(crs)
    if code is not None:
        text = DEFINITIONS.get(code) or zoned().get(code)
        if text is None:
            raise UnknownSystem(f"no closed form for EPSG:{code}")
    else:
        text = str(crs)
    return _system(text)


def _options(text: str) -> dict[str, str]:
    out = {}
    for part in text.split():
        key, _, value = part.removeprefix("+").partition("=")
        out[key] = value
    return out


def _ellipsoid(said: dict[str, str]) -> tuple[float, float]:
    """Semi-major axis and flattening."""
    name = said.get("ellps") or {"WGS84": "WGS84", "NAD83": "GRS80"}.get(said.get("datum", "WGS84"))
    if "a" in said:
        a = float(said["a"])
        if "b" in said:
            return a, 1 - float(said["b"]) / a
        return a, 1 / float(said["rf"]) if "rf" in said else float(said.get("f", 0))
    if name not in ELLIPSOIDS:
        raise UnknownSystem(f"no ellipsoid {name or said.get('datum')}")
    a, inverse = ELLIPSOIDS[name]
    return a, 1 / inverse if inverse else 0.0


def _isometric(phi: float, e: float) -> float:
    s = min(max(sin(phi), -1 + 1e-16), 1 - 1e-16)
    return atanh(s) - e * atanh(e * s)


def _authalic(phi: float, e: float) -> float:
    s = sin(phi)
    return (1 - e * e) * (s / (1 - (e * s) ** 2) + atanh(e * s) / e) if e else 2 * s


def _width(phi: float, e: float) -> float:
    """Radius of a parallel over the semi-major axis."""
    return cos(phi) / sqrt(1 - (e * sin(phi)) ** 2)


def _system(text: str) -> System:
    said = _options(text)
    kind = {"latlong": "longlat", "latlon": "longlat", "lonlat": "longlat"}.get(said.get("proj", ""), said.get("proj", ""))
    if kind == "utm":
        zone = int(said["zone"])
        said |= {"lon_0": str(6 * zone - 183), "k": "0.9996", "x_0": "500000", "y_0": "10000000" if "south" in said else "0"}
        kind = "tmerc"
    a, f = _ellipsoid(said)
    e, n = sqrt(f * (2 - f)), f / (2 - f)
    number = lambda key, other=0.0: float(said[key]) if said.get(key) not in (None, "") else other
    lat0, k = radians(number("lat_0")), number("k", number("k_0", 1.0))
    pm = said.get("pm", "0")
    # a sphere projects places of WGS 84; equal-area formulas divide by the eccentricity
    world = _ellipsoid({"ellps": "WGS84"}) if f == 0 else (a, f)
    e = max(e, 1e-9) if kind in ("laea", "aea") else e
    c = {"ga": world[0], "ge": sqrt(world[1] * (2 - world[1])), "e": e, "pm": radians(MERIDIANS[pm] if pm in MERIDIANS else float(pm)), "x0": number("x_0"), "y0": number("y_0"), "unit": number("to_meter", 0.3048006096012192 if said.get("units") == "us-ft" else 0.3048 if said.get("units") == "ft" else 1.0)}
    c["lon0"] = radians(number("lon_0")) + c["pm"]
    shift = [float(x) for x in said.get("towgs84", "").split(",") if x] + [0.0] * 7
    second = pi / 648_000
    c |= dict(zip(_SHIFT, [*shift[:3], *(x * second for x in shift[3:6]), shift[6] * 1e-6], strict=True))
    c |= {"d1": 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, "d2": 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, "d3": 56 * n**3 / 15 - 136 * n**4 / 35, "d4": 4279 * n**4 / 630}
    if kind == "tmerc":
        forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        c |= {f"f{j}": v for j, v in enumerate(forward, 1)} | {f"b{j}": v for j, v in enumerate(back, 1)}
        c["size"] = k * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        xi = asin(tanh(_isometric(lat0, e)))
        c["y0"] -= c["size"] * (xi + sum(v * sin(2 * j * xi) for j, v in enumerate(forward, 1)))
    elif kind in ("lcc", "stere"):
        if kind == "stere":
            if abs(abs(lat0) - pi / 2) > 1e-9:
                raise UnknownSystem("stereographic systems are polar here")
            c["n"], ts = (1.0 if lat0 > 0 else -1.0), abs(radians(number("lat_ts", 90.0)))
            at_pole = 2 / sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
            c["size"] = c["n"] * k * a * (at_pole if ts > pi / 2 - 1e-9 else _width(ts, e) * exp(_isometric(ts, e)))
            c["rho0"], kind = 0.0, "lcc"  # a cone that has opened to a plane
        else:
            one = radians(number("lat_1", number("lat_0")))
            two = radians(number("lat_2")) if said.get("lat_2") else one
            c["n"] = sin(one) if abs(one - two) < 1e-12 else log(_width(one, e) / _width(two, e)) / (_isometric(two, e) - _isometric(one, e))
            c["size"] = k * a * _width(one, e) * exp(c["n"] * _isometric(one, e)) / c["n"]
            c["rho0"] = 0.0 if abs(abs(lat0) - pi / 2) < 1e-9 else c["size"] * exp(-c["n"] * _isometric(lat0, e))
    elif kind == "merc":
        ts = radians(number("lat_ts"))
        c["size"] = a * (_width(ts, e) if ts else k)
    elif kind in ("laea", "aea"):
        c["qp"] = _authalic(pi / 2, e)
        if kind == "laea":
            c["beta0"], c["size"] = asin(_authalic(lat0, e) / c["qp"]), a * sqrt(c["qp"] / 2)
            if abs(abs(lat0) - pi / 2) < 1e-9:
                raise UnknownSystem("equal-area azimuthal systems are not polar here")
            c["stretch"] = a * _width(lat0, e) / (c["size"] * cos(c["beta0"]))
        else:
            one, two = radians(number("lat_1")), radians(number("lat_2"))
            wide, q = _width(one, e) ** 2, _authalic(one, e)
            c["n"] = sin(one) if abs(one - two) < 1e-12 else (wide - _width(two, e) ** 2) / (_authalic(two, e) - q)
            c["add"] = wide + c["n"] * q
            c["size"] = a / c["n"]
            c["rho0"] = c["size"] * sqrt(c["add"] - c["n"] * _authalic(lat0, e))
    elif kind in ("sterea", "somerc"):
        s = sin(lat0)
        c["n"] = sqrt(1 + (e * cos(lat0) ** 2) ** 2 / (1 - e * e))
        c["size"] = k * a * sqrt(1 - e * e) / (1 - (e * s) ** 2)
        if kind == "somerc":
            c["chi0"] = asin(s / c["n"])
            c["add"] = atanh(sin(c["chi0"])) - c["n"] * _isometric(lat0, e)
        else:
            first = tanh(c["n"] * _isometric(lat0, e))
            c["add"] = log((c["n"] + s) * (1 - first) / ((c["n"] - s) * (1 + first))) / 2
            c["chi0"] = asin(tanh(c["n"] * _isometric(lat0, e) + c["add"]))
    elif kind != "longlat":
        raise UnknownSystem(f"no closed form for the projection {kind!r} of {text!r}")
    return System(kind, tuple((name, float(c.get(name, 0.0))) for name in NAMES))


def every_code() -> dict[int, System]:
    return {code: system(code) for code in sorted(DEFINITIONS | zoned())}


Constants = dict  # name -> number or Column
Steps = list  # of {name: Column}: each step uses the names of those before

_COS0 = 1e-9


def _isometric_of(phi: Column, e) -> Column:
    s = F.sin(phi)
    return F.atanh(s) - e * F.atanh(e * s)


def _latitude_of_conformal(chi: Column, c: Constants) -> Column:
    return chi + sum((c[f"d{j}"] * F.sin(2 * j * chi) for j in range(1, 5)), F.lit(0.0))


def forward(kind: str, c: Constants, lon: Column, lat: Column, t: str) -> Steps:
    """Steps from longitude and latitude in radians to {t}x and {t}y; t begins the names of what is in between."""
    v = lambda name: F.col(t + name)
    d = lon - c["lon0"]
    turn = F.pmod(d + pi, F.lit(2 * pi)) - pi  # within half a turn of the central meridian
    out = lambda x, y: {t + "x": (c["x0"] + x) / c["unit"], t + "y": (c["y0"] + y) / c["unit"]}
    if kind == "longlat":
        return [{t + "x": F.degrees(lon - c["pm"]), t + "y": F.degrees(lat)}]
    if kind == "tmerc":
        series = lambda f, g: sum((c[f"f{j}"] * f(2 * j * v("xi")) * g(2 * j * v("eta")) for j in range(1, 5)), F.lit(0.0))
        return [
            {t + "t": F.sinh(_isometric_of(lat, c["e"])), t + "d": turn},
            {t + "xi": F.atan2(v("t"), F.cos(v("d"))), t + "eta": F.asinh(F.sin(v("d")) / F.hypot(v("t"), F.cos(v("d"))))},
            out(c["size"] * (v("eta") + series(F.cos, F.sinh)), c["size"] * (v("xi") + series(F.sin, F.cosh))),
        ]
    if kind == "lcc":
        return [{t + "rho": c["size"] * F.exp(-c["n"] * _isometric_of(lat, c["e"])), t + "d": c["n"] * turn}, out(v("rho") * F.sin(v("d")), c["rho0"] - v("rho") * F.cos(v("d")))]
    if kind == "merc":
        return [out(c["size"] * turn, c["size"] * _isometric_of(lat, c["e"]))]
    if kind in ("laea", "aea"):
        s = F.sin(lat)
        q = {t + "q": (1 - c["e"] * c["e"]) * (s / (1 - (c["e"] * s) * (c["e"] * s)) + F.atanh(c["e"] * s) / c["e"]), t + "d": turn}
        if kind == "aea":
            rho = {t + "rho": c["size"] * F.sqrt(c["add"] - c["n"] * v("q")), t + "d": c["n"] * v("d")}
            return [q, rho, out(v("rho") * F.sin(v("d")), c["rho0"] - v("rho") * F.cos(v("d")))]
        beta = {t + "beta": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v("q") / c["qp"])))}
        s0, c0 = _sin(c["beta0"]), _cos(c["beta0"])
        along = F.cos(v("beta")) * F.cos(v("d"))
        b = {t + "b": c["size"] * F.sqrt(2 / (1 + s0 * F.sin(v("beta")) + c0 * along))}
        return [q, beta, b, out(v("b") * c["stretch"] * F.cos(v("beta")) * F.sin(v("d")), v("b") / c["stretch"] * (c0 * F.sin(v("beta")) - s0 * along))]
    chi = {t + "chi": F.asin(F.tanh(c["n"] * _isometric_of(lat, c["e"]) + c["add"])), t + "d": c["n"] * turn}
    s0, c0 = _sin(c["chi0"]), _cos(c["chi0"])
    across, along, up = F.cos(v("chi")) * F.sin(v("d")), F.cos(v("chi")) * F.cos(v("d")), F.sin(v("chi"))
    if kind == "sterea":
        b = {t + "b": 2 * c["size"] / (1 + s0 * up + c0 * along)}
        return [chi, b, out(v("b") * across, v("b") * (c0 * up - s0 * along))]
    return [chi, out(c["size"] * F.atan2(across, s0 * up + c0 * along), c["size"] * F.atanh(c0 * up - s0 * along))]


def inverse(kind: str, c: Constants, x: Column, y: Column, t: str) -> Steps:
    """Steps from coordinates to {t}lon and {t}lat in radians."""
    v = lambda name: F.col(t + name)
    if kind == "longlat":
        return [{t + "lon": F.radians(x) + c["pm"], t + "lat": F.radians(y)}]
    start = {t + "u": x * c["unit"] - c["x0"], t + "w": y * c["unit"] - c["y0"]}
    conformal = lambda psi: {t + "chi": F.asin(F.tanh(psi))}
    if kind == "tmerc":
        series = lambda f, g: sum((c[f"b{j}"] * f(2 * j * v("w")) * g(2 * j * v("u")) for j in range(1, 5)), F.lit(0.0))
        return [
            {t + "u": start[t + "u"] / c["size"], t + "w": start[t + "w"] / c["size"]},
            {t + "xi": v("w") - series(F.sin, F.cosh), t + "eta": v("u") - series(F.cos, F.sinh)},
            {t + "chi": F.asin(F.sin(v("xi")) / F.cosh(v("eta"))), t + "lon": c["lon0"] + F.atan2(F.sinh(v("eta")), F.cos(v("xi")))},
            {t + "lat": _latitude_of_conformal(v("chi"), c)},
        ]
    if kind in ("lcc", "aea"):
        side = F.signum(_column(c["n"]))
        polar = {t + "rho": side * F.hypot(v("u"), c["rho0"] - v("w")), t + "d": F.atan2(side * v("u"), side * (c["rho0"] - v("w"))) / c["n"]}
        if kind == "lcc":
            return [start, polar, conformal(-F.log(v("rho") / c["size"]) / c["n"]), {t + "lon": c["lon0"] + v("d"), t + "lat": _latitude_of_conformal(v("chi"), c)}]
        ratio = v("rho") / c["size"]
        return [start, polar, {t + "q": (c["add"] - ratio * ratio) / c["n"], t + "lon": c["lon0"] + v("d")}, *_from_authalic(c, t)]
    if kind == "merc":
        return [start, conformal(v("w") / c["size"]), {t + "lon": c["lon0"] + v("u") / c["size"], t + "lat": _latitude_of_conformal(v("chi"), c)}]
    if kind == "laea":
        s0, c0 = _sin(c["beta0"]), _cos(c["beta0"])
        scaled = {t + "u": v("u") / c["stretch"], t + "w": v("w") * c["stretch"]}
        angle = {t + "rho": F.hypot(v("u"), v("w"))}
        angle2 = {t + "z": 2 * F.asin(v("rho") / (2 * c["size"]))}
        share = F.when(v("rho") == 0, F.lit(0.0)).otherwise(v("w") * F.sin(v("z")) / v("rho"))
        lon = F.when(v("rho") == 0, F.lit(0.0)).otherwise(F.atan2(v("u") * F.sin(v("z")), v("rho") * c0 * F.cos(v("z")) - v("w") * s0 * F.sin(v("z"))))
        return [start, scaled, angle, angle2, {t + "q": c["qp"] * (F.cos(v("z")) * s0 + share * c0), t + "lon": c["lon0"] + lon}, *_from_authalic(c, t)]
    s0, c0 = _sin(c["chi0"]), _cos(c["chi0"])
    if kind == "sterea":
        rho = {t + "rho": F.hypot(v("u"), v("w"))}
        angle = {t + "z": 2 * F.atan(v("rho") / (2 * c["size"]))}
        share = F.when(v("rho") == 0, F.lit(0.0)).otherwise(v("w") * F.sin(v("z")) / v("rho"))
        lon = F.when(v("rho") == 0, F.lit(0.0)).otherwise(F.atan2(v("u") * F.sin(v("z")), v("rho") * c0 * F.cos(v("z")) - v("w") * s0 * F.sin(v("z"))))
        ball = [rho, angle, {t + "up": F.cos(v("z")) * s0 + share * c0, t + "lon": c["lon0"] + lon / c["n"]}]
    else:
        flat = {t + "b": F.asin(F.tanh(v("w") / c["size"])), t + "d": v("u") / c["size"]}
        lon = F.atan2(F.cos(v("b")) * F.sin(v("d")), c0 * F.cos(v("b")) * F.cos(v("d")) - s0 * F.sin(v("b")))
        ball = [flat, {t + "up": c0 * F.sin(v("b")) + s0 * F.cos(v("b")) * F.cos(v("d")), t + "lon": c["lon0"] + lon / c["n"]}]
    return [start, *ball, conformal((F.atanh(v("up")) - c["add"]) / c["n"]), {t + "lat": _latitude_of_conformal(v("chi"), c)}]


def _from_authalic(c: Constants, t: str) -> Steps:
    """Steps from {t}q to {t}lat: a series in the squared eccentricity, then a Newton step."""
    v = lambda name: F.col(t + name)
    m = c["e"] * c["e"]
    series = [m / 3 + 31 * m * m / 180 + 517 * m * m * m / 5040, 23 * m * m / 360 + 251 * m * m * m / 3780, 761 * m * m * m / 45360]
    s = F.sin(v("near"))
    off = v("q") / (1 - m) - s / (1 - m * s * s) - F.atanh(c["e"] * s) / c["e"]
    step = F.when(F.cos(v("near")) < _COS0, F.lit(0.0)).otherwise((1 - m * s * s) * (1 - m * s * s) / (2 * F.cos(v("near"))) * off)
    return [
        {t + "beta": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v("q") / c["qp"])))},
        {t + "near": v("beta") + sum((k * F.sin(2 * j * v("beta")) for j, k in enumerate(series, 1)), F.lit(0.0))},
        {t + "lat": v("near") + step},
    ]


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _sin(x):
    return F.sin(x) if isinstance(x, Column) else sin(x)


def _cos(x):
    return F.cos(x) if isinstance(x, Column) else cos(x)


def shift(source: Constants, target: Constants, lon: Column, lat: Column, t: str) -> Steps:
    """Steps from one datum to another, through geocentric coordinates at height zero: {t}lon, {t}lat in radians."""
    v = lambda name: F.col(t + name)
    e, a = source["ge"], source["ga"]
    ball = {t + "r": a / F.sqrt(1 - (e * F.sin(lat)) * (e * F.sin(lat)))}
    place = {t + "X": v("r") * F.cos(lat) * F.cos(lon), t + "Y": v("r") * F.cos(lat) * F.sin(lon), t + "Z": v("r") * (1 - e * e) * F.sin(lat)}
    c = source
    world = {
        t + "A": c["dx"] + (1 + c["ds"]) * (v("X") - c["rz"] * v("Y") + c["ry"] * v("Z")),
        t + "B": c["dy"] + (1 + c["ds"]) * (c["rz"] * v("X") + v("Y") - c["rx"] * v("Z")),
        t + "C": c["dz"] + (1 + c["ds"]) * (-c["ry"] * v("X") + c["rx"] * v("Y") + v("Z")),
    }
    g = target
    x, y, z = (v("A") - g["dx"]) / (1 + g["ds"]), (v("B") - g["dy"]) / (1 + g["ds"]), (v("C") - g["dz"]) / (1 + g["ds"])
    own = {t + "X": x + g["rz"] * y - g["ry"] * z, t + "Y": -g["rz"] * x + y + g["rx"] * z, t + "Z": g["ry"] * x - g["rx"] * y + z}
    b = g["ga"] * _root(1 - g["ge"] * g["ge"])
    second = g["ge"] * g["ge"] / (1 - g["ge"] * g["ge"])
    first = {t + "p": F.hypot(v("X"), v("Y")), t + "lon": F.atan2(v("Y"), v("X"))}
    guess = {t + "th": F.atan2(v("Z") * g["ga"], v("p") * b)}
    tangent = lambda th: F.atan2(v("Z") + second * b * F.pow(F.sin(th), F.lit(3.0)), v("p") - g["ge"] * g["ge"] * g["ga"] * F.pow(F.cos(th), F.lit(3.0)))
    again = {t + "near": tangent(v("th"))}
    reduced = {t + "th": F.atan2(b * F.sin(v("near")), g["ga"] * F.cos(v("near")))}
    return [ball, place, world, own, first, guess, again, reduced, {t + "lat": tangent(v("th"))}]


def _root(x):
    return F.sqrt(x) if isinstance(x, Column) else sqrt(x)
