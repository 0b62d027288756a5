"""Coordinates: splitting "lat,lon" and converting between reference systems."""

from __future__ import annotations

from math import atan, log, pi, radians, sinh, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import quoted
from . import crs

WGS84 = 4326
_RADIUS = 6378137.0


def geo_split(df: DataFrame, column: str, sep: str = ",", lat: str = "_lat", lon: str = "_lon") -> DataFrame:
    """Two doubles from one text; a text that is no pair of numbers fails the query, null stays null."""
    parts = F.split(quoted(column), f"\\Q{sep}\\E", -1)
    checked = F.when(quoted(column).isNotNull() & (F.size(parts) != 2), F.raise_error(F.concat(F.lit("not a coordinate pair: "), quoted(column)))).otherwise(parts)
    return df.withColumns({column + lat: F.trim(F.get(checked, 0)).cast("double"), column + lon: F.trim(F.get(checked, 1)).cast("double")})


def _prefix(df: DataFrame) -> str:
    """What no column's name begins with."""
    prefix = "__crs_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def _staged(df: DataFrame, steps: list[dict[str, Column]]) -> DataFrame:
    for step in steps:
        df = df.withColumns(step)
    return df


def _by_kind(kind: Column, made: dict[str, list[dict[str, Column]]]) -> list[dict[str, Column]]:
    """Steps of several projections beside each other, each for its own rows."""
    out: list[dict[str, Column]] = [{} for _ in range(max(map(len, made.values())))]
    for name, steps in made.items():
        for at, step in enumerate(steps):
            out[at] |= {column: F.when(kind == name, value) for column, value in step.items()}
    return out


def _moves(source: crs.System, target: crs.System) -> bool:
    """Whether datums differ by a known shift."""
    return source.datum != target.datum and (source.shifted or target.shifted)


def convert_crs(
    df: DataFrame, x: str, y: str, source: int | str, target: int | str, source_column: bool = False, suffix: str = "", names: tuple[str, str] | None = None, known: dict[str, str] | None = None
) -> DataFrame:
    """x, y (easting or longitude first) in another system, as columns x + suffix and y + suffix, or `names`.

    Systems are EPSG codes (3006, "EPSG:3006") or definitions ("+proj=tmerc +lon_0=15 ..."). source_column: `source` names a column of
    codes, or of labels that `known` maps to codes or definitions; each row then goes by its own. A null label gives null coordinates; a
    system without a closed form fails the query. Datums are shifted where a definition says how (towgs84). Coordinates of rows that
    are in the target system already stay as they are."""
    goal, out, t = crs.system(target), names or (x + suffix, y + suffix), _prefix(df)
    a, b = quoted(x).cast("double"), quoted(y).cast("double")
    c = dict(goal.constants)
    place = lambda p: (F.col(t + p + "lon"), F.col(t + p + "lat"))
    if not source_column:
        own = crs.system(source)
        if own == goal:
            return df.withColumns(dict(zip(out, (a, b), strict=True)))
        s = dict(own.constants)
        made = _staged(df, crs.inverse(own.kind, s, a, b, t + "s"))
        at = place("s")
        if _moves(own, goal):
            made, at = _staged(made, crs.shift(s, c, *at, t + "m")), place("m")
        same = None
    else:
        text = F.upper(F.trim(quoted(str(source)).cast("string")))
        bare = F.regexp_replace(text, r"^EPSG:\s*", "")
        systems = {str(code): one for code, one in crs.every_code().items()} | {k.strip().upper(): crs.system(v) for k, v in (known or {}).items()}
        fields = ["key", "kind", "moves", "same", *crs.NAMES]
        rows = [(key, one.kind, _moves(one, goal), one == goal, *[v for _, v in one.constants]) for key, one in systems.items()]
        schema = T.StructType([T.StructField(t + f, {"key": T.StringType(), "kind": T.StringType(), "moves": T.BooleanType(), "same": T.BooleanType()}.get(f, T.DoubleType())) for f in fields])
        table = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row for each code that is known here
        made = df.withColumn(t + "label", F.coalesce(bare.try_cast("int").cast("string"), text if known is None else F.when(text.isin([k.strip().upper() for k in known]), text).otherwise(bare)))
        made = made.join(table, F.col(t + "label") == F.col(t + "key"), "left")
        refused = F.raise_error(F.concat(F.lit("no closed form for "), text)).cast("boolean")
        made = made.withColumn(t + "same", F.when(F.col(t + "label").isNotNull() & F.col(t + "key").isNull(), refused).otherwise(F.col(t + "same")))
        s = {name: F.col(t + name) for name in crs.NAMES}
        kinds = sorted({one.kind for one in systems.values()})
        made = _staged(made, _by_kind(F.col(t + "kind"), {k: crs.inverse(k, s, a, b, f"{t}{k}_") for k in kinds}))
        made = made.withColumns({t + "slon": F.coalesce(*[F.col(f"{t}{k}_lon") for k in kinds]), t + "slat": F.coalesce(*[F.col(f"{t}{k}_lat") for k in kinds])})
        moved = [{k: F.when(F.col(t + "moves"), v) for k, v in step.items()} for step in crs.shift(s, c, *place("s"), t + "m")]
        made = _staged(made, moved)
        at = tuple(F.when(F.col(t + "moves"), m).otherwise(p) for m, p in zip(place("m"), place("s"), strict=True))
        same = F.col(t + "same")
        made = made.withColumns({t + "lon": at[0], t + "lat": at[1]})
        at = place("")
    made = _staged(made, crs.forward(goal.kind, c, *at, t + "o"))
    new = F.col(t + "ox"), F.col(t + "oy")
    if same is not None:
        new = tuple(F.when(same, kept).otherwise(n) for kept, n in zip((a, b), new, strict=True))
    return made.withColumns(dict(zip(out, new, strict=True))).select(*[quoted(c) for c in dict.fromkeys([*df.columns, *out])])


def web_mercator_of(lon: float, lat: float) -> tuple[float, float]:
    """The same by plain numbers, for tests."""
    return radians(lon) * _RADIUS, log(tan(radians(lat) / 2 + pi / 4)) * _RADIUS


def lonlat_of(x: float, y: float) -> tuple[float, float]:
    return x / _RADIUS * 180 / pi, atan(sinh(y / _RADIUS)) * 180 / pi
