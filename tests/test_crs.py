"""Reference systems against published points and constants."""

import random
from math import degrees, radians

import pytest

from tessera.functions import crs, geo


def converted(spark, points, source, target, **options):
    df = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(points)], "k int, x double, y double")
    return [(r.x, r.y) for r in geo.convert_crs(df, "x", "y", source, target, **options).orderBy("k").collect()]


def dms(d, m, s):
    return d + m / 60 + s / 3600


# published worked examples: definition of the projected system and of its geographic one, longitude, latitude, easting, northing, tolerance in metres
PUBLISHED = [
    # transverse Mercator with free parameters, national land survey's test point
    ("+proj=tmerc +lon_0=13.585470 +k=1.00000254 +x_0=84182.8790 +y_0=-6226307.8640 +ellps=GRS80", 4258, 24.0, 66.0, 555304.016555, 1135809.413803, 1e-3),
    # Airy transverse Mercator, national grid's guide
    ("27700", 4277, dms(1, 43, 4.5177), dms(52, 39, 27.2531), 651409.903, 313177.270, 1e-3),
    # conic with one parallel, in radians from Greenwich and given constants
    ("+proj=lcc +lat_1=49.5 +lat_0=49.5 +lon_0=0 +k=0.999877341 +x_0=600000 +y_0=200000 +pm=2.337229167 +ellps=clrk80ign", "+proj=longlat +ellps=clrk80ign", degrees(0.145512099), degrees(0.872664626), 1029705.083, 272723.849, 0.02),
    ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k=1 +x_0=250000 +y_0=150000 +ellps=clrk66", "+proj=longlat +ellps=clrk66", -dms(76, 56, 37.26), dms(17, 55, 55.80), 255966.58, 142493.51, 0.01),
    # equal-area azimuthal
    ("3035", 4258, 5.0, 50.0, 3962799.45, 2999718.85, 0.006),
    # polar stereographic with a standard parallel
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000 +ellps=WGS84", 4326, 120.0, -75.0, 7255380.79, 7053389.56, 0.006),
    # oblique stereographic
    ("28992", 4289, 6.0, 53.0, 196105.283, 557057.739, 1e-3),
    # equal-area conic
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", "+proj=longlat +ellps=clrk66", -75.0, 35.0, 1885472.7, 1535925.0, 0.06),
    # Mercator on a sphere
    ("3857", 4326, -dms(100, 20, 0), dms(24, 22, 54.433), -11169055.58, 2800000.00, 0.01),
]


@pytest.mark.parametrize("case", PUBLISHED, ids=lambda c: c[0][:40])
def test_published_points(spark, case):
    projected, geographic, lon, lat, east, north, within = case
    (x, y), *_ = converted(spark, [(lon, lat)], geographic, projected)
    assert abs(x - east) < within
    assert abs(y - north) < within
    (lon2, lat2), *_ = converted(spark, [(x, y)], projected, geographic)
    assert abs(lon2 - lon) < 1e-8
    assert abs(lat2 - lat) < 1e-8


def test_published_constants():
    """Exponent, constant and pole of the French conic as its institute gives them."""
    c = dict(crs.system(2154).constants)
    assert abs(c["n"] - 0.7256077650) < 1e-10
    assert abs(c["size"] - 11754255.426) < 1e-3
    assert abs(c["y0"] + c["rho0"] - 12655612.050) < 1e-3


def test_datum_shifts(spark):
    # a water tower in both datums
    (x, y), *_ = converted(spark, [(dms(1, 42, 57.8663), dms(52, 39, 28.8282))], 4326, 27700)
    assert abs(x - 651409.903) < 5
    assert abs(y - 313177.270) < 5
    # the direct projection that the land survey gives for the old national grid
    direct = "+proj=tmerc +lon_0=15.806284529 +k=1.00000561024 +x_0=1500064.274 +y_0=-667.711 +ellps=GRS80"
    places = [(11.97, 57.7), (18.06324, 59.334591), (20.26, 63.82), (13.0, 55.6)]
    for (a, b), (c, d) in zip(converted(spark, places, 4326, 3021), converted(spark, places, 4326, direct), strict=True):
        assert abs(a - c) < 1
        assert abs(b - d) < 1
    # an observatory and the origin of the Swiss grid
    (x, y), *_ = converted(spark, [(dms(8, 43, 49.79), dms(46, 2, 38.87))], 4326, 21781)
    assert abs(x - 700_000) < 5
    assert abs(y - 100_000) < 5


def places_of(system, rng):
    c = dict(crs.system(system).constants)
    kind = crs.system(system).kind
    if kind == "longlat":
        return [(rng.uniform(-9, 25), rng.uniform(-60, 70)) for _ in range(3)]
    mid = degrees(c["lon0"])
    far = 3 if kind in ("tmerc", "sterea", "somerc") else 15
    low, high = (-80, -60) if c["n"] < 0 else (20, 80)
    if kind in ("sterea", "somerc"):
        low, high = 45, 54
    return [(mid + rng.uniform(-far, far), rng.uniform(low, high)) for _ in range(3)]


def test_every_code_goes_there_and_back(spark):
    """From WGS 84 to every code and back, each row by its own code, within a millimetre or what a datum shift leaves."""
    rng = random.Random(3)
    rows = []
    for code in crs.every_code():
        for lon, lat in places_of(code, rng):
            rows.append((len(rows), code, (lon + 180) % 360 - 180, lat))
    by_code = {}
    for k, code, lon, lat in rows:
        by_code.setdefault(code, []).append((k, lon, lat))
    there = []
    for kind in crs.KINDS:  # one static plan for each kind of projection and shift is enough
        for shifted in (False, True):
            codes = [c for c, s in crs.every_code().items() if s.kind == kind and s.shifted == shifted][:2]
            for code in codes:
                points = by_code[code]
                there += [(k, f" epsg:{code} ", x, y, lon, lat) for (k, lon, lat), (x, y) in zip(points, converted(spark, [p[1:] for p in points], 4326, code), strict=True)]
    df = spark.createDataFrame(there, "k int, crs string, x double, y double, lon double, lat double")
    back = geo.convert_crs(df, "x", "y", "crs", 4326, source_column=True).collect()
    assert len(back) == len(there) >= 60
    for r in back:
        assert abs(r.x - r.lon) < 2e-8 + 2e-6 * (crs.system(r.crs).shifted), r
        assert abs(r.y - r.lat) < 1e-8 + 2e-6 * (crs.system(r.crs).shifted), r


def test_rows_by_their_own_code_agree_with_whole_tables(spark):
    codes = [3006, 3021, 2154, 27700, 3035, 2056, 28992, 5070, 3857, 4326, 32633]
    points = {4326: (15.0, 55.0), 4258: (15.0, 55.0), 3857: (1.6e6, 7.6e6), 2056: (2.65e6, 1.2e6), 5070: (1e5, 2e6), 2154: (7.1e5, 6.7e6), 27700: (4.5e5, 3e5), 28992: (1.6e5, 4.7e5), 3035: (4.4e6, 3.3e6)}
    rows = [(k, str(c), *points.get(c, (5.5e5, 6.3e6))) for k, c in enumerate(codes)]
    df = spark.createDataFrame([*rows, (98, "mine", 5.5e5, 6.3e6), (99, None, 1.0, 2.0)], "k int, __crs_label string, x double, y double")
    for target in (3006, 27700):
        got = geo.convert_crs(df, "x", "y", "__crs_label", target, source_column=True, names=("e", "n"), known={"mine": "+proj=utm +zone=33 +ellps=GRS80"})
        assert got.columns == ["k", "__crs_label", "x", "y", "e", "n"]
        by_row = {r.k: (r.e, r.n) for r in got.collect()}
        assert by_row[99] == (None, None)
        for k, code, x, y in rows:
            (a, b), *_ = converted(spark, [(x, y)], int(code), target)
            assert abs(by_row[k][0] - a) < 1e-6
            assert abs(by_row[k][1] - b) < 1e-6
            if int(code) == target:
                assert by_row[k] == (x, y)
        assert by_row[98] == pytest.approx(by_row[0] if target == 27700 else (5.5e5, 6.3e6), abs=1e-6)


def test_what_is_refused(spark):
    for bad in (99999, "+proj=robin", "+proj=tmerc +ellps=nobody", "+proj=stere +lat_0=50"):
        with pytest.raises(crs.UnknownSystem):
            crs.system(bad)
    with pytest.raises(Exception, match="no closed form for EPSG:99999"):
        geo.convert_crs(spark.createDataFrame([("EPSG:99999", 1.0, 2.0)], "crs string, x double, y double"), "x", "y", "crs", 4326, source_column=True).collect()


def test_the_plan_is_native(spark):
    df = spark.createDataFrame([("3006", 1.0, 2.0)], "crs string, x double, y double")
    plan = geo.convert_crs(df, "x", "y", "crs", 27700, source_column=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_meridians_and_units(spark):
    paris = "+proj=longlat +ellps=GRS80 +pm=paris"
    (x, y), *_ = converted(spark, [(2.33722916667, 48.0)], 4258, paris)
    assert abs(x) < 1e-9
    assert y == pytest.approx(48.0)
    feet = "+proj=tmerc +lon_0=15 +k=0.9996 +x_0=500000 +ellps=GRS80 +units=ft"
    (m, n), *_ = converted(spark, [(16.0, 60.0)], 4258, 3006)
    (f, g), *_ = converted(spark, [(16.0, 60.0)], 4258, feet)
    assert (f * 0.3048, g * 0.3048) == pytest.approx((m, n), abs=1e-6)
    assert radians(180) == pytest.approx(3.14159265)
