"""Formulas, interpolation, predicates, replacements, names."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import formula, geo, interpolate, patterns, replace, text
from tessera.functions.predicate import PredicateError, compile_predicate


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("Ann", "Lee", 1, 2.0, True), (None, "Ng", 2, 2.5, False), ("Bo", None, None, None, None)], "first string, last string, n long, x double, b boolean")


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("=concat(first, ' ', last)", ["Ann Lee", " Ng", "Bo "]),
        ("=concat(first)", ["Ann", None, "Bo"]),
        ("=upper(first)", ["ANN", None, "BO"]),
        ("=lower(last)", ["lee", "ng", None]),
        ("=trim(' \\t a b\\n')", ["a b"] * 3),
        ("=coalesce(first, last, 'x')", ["Ann", "Ng", "Bo"]),
        ("=coalesce(n, 7)", [1, 2, 7]),
        ("=concat(n, '|', x, '|', b)", ["1|2.0|True", "2|2.5|False", "||"]),
        ("=substr(concat(last, 'xyz'), 1, 2)", ["ee", "gx", "yz"]),
        ("=null", [None] * 3),
        ("=true", [True] * 3),
        ("='it\\'s'", ["it's"] * 3),
    ],
)
def test_formula(people, source, want):
    assert column(formula.with_formula(people, "r", source), "r") == want


@pytest.mark.parametrize("start", range(-7, 8))
def test_substr_slices_like_python(spark, start):
    df = spark.createDataFrame([("abcde",), ("",)], "s string")
    for n in range(7):
        got = column(formula.with_formula(df, "r", f"=substr(s, {start}, {n})"), "r")
        assert got == [s[start : start + n] for s in ("abcde", "")]


@pytest.mark.parametrize("source", ["=nope(a)", "=upper()", "=upper(a, b)", "=substr(a, b, 2)", "=a + b", "=upper(", "=a.b", "=" + "upper(" * 21 + "a" + ")" * 21, "=concat(" + "a," * 600 + "a)"])
def test_bad_formulas(source):
    assert formula.validate(source)


def test_formula_columns():
    assert formula.columns_of("=concat(a, upper(b), 'c', null)") == {"a", "b"}
    assert formula.validate("=upper(a)", columns=["b"]) == ["unknown column a"]


def test_own_functions(people):
    functions = {**formula.FUNCTIONS, "rev": formula.Function(1, 1, lambda a: F.reverse(a[0]))}
    assert column(formula.with_formula(people, "r", "=rev(last)", functions), "r") == ["eeL", "gN", None]


def test_interpolation(people):
    text_ = "{first}-{n}-{x}-{b} {{n}} ü"
    assert interpolate.is_interpolated(text_)
    assert not interpolate.is_interpolated("{{n}} {Ökogruppe} {1}")
    got = [r[0] for r in people.select(interpolate.interpolate(text_, people.schema)).collect()]
    assert got == ["Ann-1-2-True {n} ü", "-2-2.5-False {n} ü", "Bo--- {n} ü"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(1, 3, "apple", None), (2, 2, "Banana", 1.0), (3, 1, None, 2.0), (4, None, "cherry pie", None)], "a long, b long, s string, z double").withColumnRenamed("z", "odd name")


@pytest.mark.parametrize(
    ("test", "want"),
    [
        ("a > 2", [3, 4]),
        ("a >= b and b > 0", [2, 3]),
        ("a == 1 or s == 'Banana'", [1, 2]),
        ("not (b > 1)", [3, 4]),
        ("b != 2", [1, 3, 4]),
        ("a in [1, 4]", [1, 4]),
        ("a not in [1, 4]", [2, 3]),
        ("s in ['apple', None]", [1, 3]),
        ("`odd name` > 0.5", [2, 3]),
        ("1 < a <= 3", [2, 3]),
        ("a.isin([2])", [2]),
        ("s.isna()", [3]),
        ("b.notna() & ~(a == 1)", [2, 3]),
        ("s.str.contains('an')", [2]),
        ("s.str.contains('APP', case=False)", [1]),
        ("s.str.contains('.', regex=False)", []),
        ("s.str.startswith('ch') | s.str.endswith('a')", [2, 4]),
        ("s.str.lower() == 'banana'", [2]),
        ("s.str.len() > 6", [4]),
        ("a + 1 == b * 2 - 1", [2]),
        ("a.between(2, 3)", [2, 3]),
        ("a == [1, 2]", [1, 2]),
    ],
)
def test_predicates(rows, test, want):
    assert sorted(column(rows.where(compile_predicate(test, rows.columns)), "a")) == want


@pytest.mark.parametrize("test", ["nope > 1", "a >", "import os", "a.foo()", "s.str.foo('x')", "f(a)", "a in b"])
def test_bad_predicates(rows, test):
    with pytest.raises(PredicateError):
        compile_predicate(test, rows.columns)


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(1, "A"), (2, " a "), (3, None), (4, "b"), (5, "x"), (6, "2.0"), (7, "1.5")], "i long, v string")


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"A": "b", "b": "A"}, ["b", " a ", None, "A", "x", "2.0", "1.5"]),
        ("b", ["A", " a ", " a ", " a ", "x", "2.0", "1.5"]),
        ([{"blank_out": ["x"], "fill": "backward"}], ["A", " a ", "b", "b", "2.0", "2.0", "1.5"]),
        ([{"blank_out": ["x"], "fill": "none"}], ["A", " a ", None, "b", None, "2.0", "1.5"]),
        ([{"blank_out": ["x"], "fill": {"constant": "-"}}], ["A", " a ", "-", "b", "-", "2.0", "1.5"]),
        ([{"map": {"a": "one"}, "normalize": ["strip", "lower"]}], ["one", "one", None, "b", "x", "2.0", "1.5"]),
        ([{"normalize": ["strip", "upper"]}], ["A", "A", None, "B", "X", "2.0", "1.5"]),
        ([{"coerce": "int"}], [None, None, None, None, None, 2, None]),
        ([{"coerce": "float"}], [None, None, None, None, None, 2.0, 1.5]),
        ([{"from": "a", "to": "z", "normalize": ["strip"], "flags": ["i"]}], ["z", "z", None, "b", "x", "2.0", "1.5"]),
        ([{"match": "not_equals", "from": "b", "to": "z"}], ["z", "z", None, "b", "z", "z", "z"]),
        ([{"match": "equals", "from": 2, "to": "two", "coerce": "int"}], ["A", " a ", None, "b", "x", "two", "1.5"]),
        ([{"match": "contains", "from": ".", "to": None}], ["A", " a ", None, "b", "x", None, None]),
        ([{"match": "not_contains", "from": "A", "flags": ["ignorecase"], "to": "z"}], ["A", " a ", None, "z", "z", "z", "z"]),
        ([{"match": "startswith", "from": "1", "to": "z"}], ["A", " a ", None, "b", "x", "2.0", "z"]),
        ([{"match": "endswith", "from": "0", "to": "z"}], ["A", " a ", None, "b", "x", "z", "1.5"]),
        ([{"match": "in", "from": ["A", "b"], "to": "z"}], ["z", " a ", None, "z", "x", "2.0", "1.5"]),
        ([{"match": "not_in", "from": ["A", "b"], "to": "z"}], ["A", "z", None, "b", "z", "z", "z"]),
        ([{"match": "regex", "from": "[ab]", "to": "z"}], ["A", " a ", None, "z", "x", "2.0", "1.5"]),
        ([{"match": "not_regex", "from": r"\d", "to": "z"}], ["z", "z", None, "z", "z", "2.0", "1.5"]),
        ([{"match": "regex_sub", "from": r"(\d)\.(\d)", "to": r"\2,\1$"}], ["A", " a ", None, "b", "x", "0,2$", "5,1$"]),
        ([{"match": "regex_sub", "from": r"\d", "to": None}], ["A", " a ", None, "b", "x", None, None]),
        ([{"from": "A", "to": "b"}, {"from": "b", "to": "c"}], ["c", " a ", None, "c", "x", "2.0", "1.5"]),
    ],
)
def test_replacements(values, spec, want):
    got = replace.apply_replacements(values, {"v": spec, "missing": {"a": "b"}}, ("i",)).orderBy("i")
    assert column(got, "v") == want


def test_fill_crosses_ranges(spark):
    df = spark.range(1000).selectExpr("id i", "case when id % 97 = 0 then cast(id as string) else 'x' end v").repartition(7)
    for how, want in (("forward", lambda i: str(i // 97 * 97)), ("backward", lambda i: str(-(-i // 97) * 97) if -(-i // 97) * 97 < 1000 else None)):
        got = replace.apply_replacements(df, {"v": [{"blank_out": "x", "fill": how}]}, ("i",))
        assert {r.i: r.v for r in got.collect()} == {i: want(i) for i in range(1000)}


def test_unknown_rules(values):
    for spec in ([{"match": "sounds_like", "from": "a"}], [{"normalize": ["rot13"]}], [{"coerce": "date"}]):
        with pytest.raises(replace.ReplacementError):
            replace.apply_replacements(values, {"v": spec})


def test_unmatched(values):
    assert [tuple(r) for r in replace.unmatched(values, "v", {"A": 1}, 2).collect()] == [(" a ", 1), ("1.5", 1)]


def test_names():
    assert text.column_names(["Größe (cm)", "δ13C ±", "a.b", "A B", "a b", None, "=SUM(A1)", "1st", "%", "x" * 60, float("nan")]) == [
        "groe_cm", "delta_13c_plus_minus", "ab", "a_b", "a_b_1", "unnamed_5", "unnamed_6", "col_1st", "percent", "x" * 48, "unnamed_10",
    ]


def test_plain_text(spark):
    df = spark.createDataFrame([("ÅÄÖ é ñ é Ω",), (None,)], "t string")
    assert column(df.select(text.normalize_text(F.col("t")).alias("t")), "t") == ["aao e n e ω", None]


def test_patterns():
    assert patterns.java_pattern(r"(?P<ye_ar>\d+)(?P=ye_ar)\Z") == r"(?<year>\d+)\k<year>\z"
    assert patterns.java_replacement(r"\1-\g<2>$") == r"$1-$2\$"


_AXIS, _E = 6378137.0, (1 / 298.257223563 * (2 - 1 / 298.257223563)) ** 0.5


def arc(phi):
    """Length of the meridian from the equator, by numerical integration; also for complex latitudes."""
    import numpy as np

    x, w = np.polynomial.legendre.leggauss(60)
    return _AXIS * (1 - _E**2) * phi / 2 * np.sum(w / (1 - (_E * np.sin(phi * (x + 1) / 2)) ** 2) ** 1.5)


def transverse_mercator(lon, lat, meridian):
    """(easting, northing) without any series: the meridian's arc length continued to complex latitudes."""
    import numpy as np

    isometric = lambda phi: np.arctanh(np.sin(phi)) - _E * np.arctanh(_E * np.sin(phi))
    wanted = isometric(np.radians(lat)) + 1j * np.radians(lon - meridian)
    phi = complex(np.radians(lat))
    for _ in range(30):  # Newton
        phi -= (isometric(phi) - wanted) * (1 - (_E * np.sin(phi)) ** 2) * np.cos(phi) / (1 - _E**2)
    return 500_000 + 0.9996 * arc(phi).imag, 0.9996 * arc(phi).real


def test_utm_to_a_millimetre(spark):
    """Published: the meridian's quarter is 10,001,965.729 m long, and its arc up to 45 degrees 4,984,944.378 m."""
    assert abs(arc(math.pi / 2) - 10_001_965.729) < 0.001
    assert abs(arc(math.pi / 4) - 4_984_944.378) < 0.001
    places = [(12.5, 0.1), (15.0, 45.0), (17.9, 83.0), (16.25, 59.3), (13.0, 30.0)]
    there = geo.convert_crs(spark.createDataFrame(places, "x double, y double"), "x", "y", 4326, 25833, suffix="_m").collect()
    for r in there:
        east, north = transverse_mercator(r.x, r.y, 15)
        assert abs(r.x_m - east) < 0.001
        assert abs(r.y_m - north) < 0.001


def test_every_code_of_a_column_is_converted(spark):
    """All UTM zones of both halves and the two others in one column, more distinct spellings than any list would hold."""
    codes = [c for base in (32600, 32700) for c in range(base + 1, base + 61)]
    rows = [(k, f"{'EPSG:' if k % 2 else ''}{' ' * (k % 40)}{codes[k % len(codes)]}".strip() + " " * (k // 120), 500_000.0, 5_000_000.0) for k in range(2400)]
    df = spark.createDataFrame([(*r[:1], r[1].replace("EPSG: ", "EPSG:").replace(" ", "") + " " * (r[0] // 120), *r[2:]) for r in rows] + [(-1, None, 1.0, 2.0), (-2, "4326", 15.0, 50.0)], "k int, crs string, x double, y double")
    assert df.select("crs").distinct().count() > 1000
    got = {r.k: r for r in geo.convert_crs(df, "x", "y", "crs", 4326, source_column=True).collect()}
    assert (got[-1].x, got[-1].y, got[-2].x, got[-2].y) == (None, None, 15.0, 50.0)
    for k in range(2400):
        code = codes[k % len(codes)]
        assert abs(got[k].x - (6 * (code % 100) - 183)) < 1e-9
        assert (got[k].y > 0) == (code < 32700)
    with pytest.raises(Exception, match="no closed form for EPSG:99999"):
        geo.convert_crs(spark.createDataFrame([("EPSG:99999", 1.0, 2.0)], "crs string, x double, y double"), "x", "y", "crs", 4326, source_column=True).collect()


def test_fills_go_by_any_key_nulls_last(spark):
    rows = [(None, "z"), ("b", None), ("a", None), ("c", "x"), (None, None), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(3)
    forward = replace.apply_replacements(df, {"v": [{"blank_out": ["none"], "fill": "forward"}]}, ("k",))
    assert {r.v for r in forward.where("k in ('a', 'b')").collect()} == {None}
    assert {r.v for r in forward.where("k in ('c', 'd')").collect()} == {"x"}
    backward = replace.apply_replacements(df, {"v": [{"blank_out": ["none"], "fill": "backward"}]}, ("k",))
    assert {r.k: r.v for r in backward.where("k is not null").collect()} == {"a": "x", "b": "x", "c": "x", "d": "z"}


def test_backward_fills_read_each_row_once(spark):
    """Forward and backward together, over gaps longer than a range; no frame is left open to the last row, which costs the square of a range."""
    rows = [(i, f"v{i}" if i % 400 == 7 or i in (50, 51) else "x", f"w{i}" if i == 900 else "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, v string, w string").repartition(3)
    df = df.withColumn("f", F.col("v")).withColumn("k", F.when(F.col("k") < 995, F.col("k")))
    back, forward = [{"blank_out": ["x"], "fill": "backward"}], [{"blank_out": ["x"], "fill": "forward"}]
    got = replace.apply_replacements(df, {"v": back, "w": back, "f": forward}, ("k",))
    assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
    v, w, f = ([None if r[c] == "x" else r[c] for r in rows] for c in (1, 2, 1))
    at = {r.k: (r.v, r.w, r.f) for r in got.where("k is not null").collect()}
    assert at == {i: (next(filter(None, v[i:]), None), next(filter(None, w[i:]), None), next(filter(None, f[i::-1]), None)) for i in range(995)}


def test_fills_shuffle_rows_twice(spark, tmp_path):
    """Once into ranges, and once to fill; the last values of the ranges come from partial sums, and no row is sorted by its keys again."""
    n = 20_000
    df = spark.range(n).selectExpr("CASE WHEN id % 7 <> 0 THEN CAST(id AS STRING) END AS k", "id", "CASE WHEN id % 50 = 3 THEN CAST(id AS STRING) ELSE 'x' END AS v", "CAST(id % 11 AS STRING) AS w").repartition(5)

    def shuffled():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    df.write.parquet(f"{tmp_path}/t")
    before = shuffled()
    fills = {"v": [{"blank_out": ["x"], "fill": "backward"}], "w": [{"blank_out": ["3", "4"], "fill": "forward"}]}
    got = replace.apply_replacements(spark.read.parquet(f"{tmp_path}/t"), fills, ("k", "id"))
    got.write.parquet(f"{tmp_path}/out")
    assert 2 * n <= sum(count for stage, count in shuffled().items() if stage not in before) < 2.1 * n
    rows = sorted(df.collect(), key=lambda r: (r.k is None, r.k or "", r.id))
    want, v, w = {r.id: [r.k] for r in rows}, None, None
    for r in reversed(rows):
        want[r.id].append(v := r.v if r.v != "x" else v)
    for r in rows:
        want[r.id].append(w := r.w if r.w not in ("3", "4") else w)
    assert {r.id: [r.k, r.v, r.w] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_geo(spark):
    df = spark.createDataFrame([("59.3, 18.1",), (None,)], "p string")
    out = geo.geo_split(df, "p").collect()
    assert (out[0].p_lat, out[0].p_lon, out[1].p_lat) == (59.3, 18.1, None)
    with pytest.raises(Exception, match="not a coordinate pair"):
        geo.geo_split(spark.createDataFrame([("59",)], "p string"), "p").collect()
    xy = spark.createDataFrame([(18.06324, 59.334591)], "x double, y double")
    there = geo.convert_crs(xy, "x", "y", "EPSG:4326", 32633).first()
    east, north = transverse_mercator(18.06324, 59.334591, 15)
    assert abs(there.x - east) < 0.001
    assert abs(there.y - north) < 0.001
    back = geo.convert_crs(geo.convert_crs(xy, "x", "y", 4326, 32634), "x", "y", 32634, 4326).first()
    assert (round(back.x, 7), round(back.y, 7)) == (18.06324, 59.334591)
    mercator = geo.convert_crs(xy, "x", "y", 4326, 3857).first()
    assert abs(mercator.x - geo.web_mercator_of(18.06324, 59.334591)[0]) < 1e-6
