"""Foreign-key links: joins that bring in the remote entity's surrogate id, with null policies and constraints."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config.project import Constraints, ForeignKey
from .shared import fresh, quoted


class LinkError(ValueError):
    pass


class ConstraintViolation(LinkError):
    def __init__(self, code: str, message: str):
        self.code = code
        super().__init__(message)


class NullKeys(ConstraintViolation):
    pass


@dataclass(frozen=True)
class Remote:
    """What a link sees of the other entity."""

    name: str
    df: DataFrame
    system_id: str = "system_id"
    public_id: str | None = None

    @property
    def id_column(self) -> str:
        return self.public_id or f"{self.name}_id"


@dataclass
class LinkReport:
    """Counts of one link, from one aggregate; issues are the soft ones."""

    counts: dict[str, int] = field(default_factory=dict)
    violations: list[tuple[str, str]] = field(default_factory=list)
    issues: list[str] = field(default_factory=list)


def is_linked(df: DataFrame, fk: ForeignKey, remote_id: str) -> bool:
    return remote_id in df.columns or bool(fk.extra_columns) and all(c in df.columns for c in fk.extra_columns)


def is_lookup(fk: ForeignKey, remote: Remote) -> bool:
    """A left join on other than the remote id only enriches rows: its null keys are just unmatched."""
    return fk.how == "left" and not set(fk.remote_keys) <= {remote.system_id, remote.public_id}


def null_matches(fk: ForeignKey, remote: Remote) -> bool:
    """Whether null keys match null keys: said so, or else unless the link is a lookup."""
    if fk.constraints is not None and fk.constraints.allow_null_keys is True:
        return False
    return not is_lookup(fk, remote)


def missing_columns(df: DataFrame, fk: ForeignKey, remote: Remote) -> list[str]:
    there = {remote.system_id, *remote.df.columns}
    return [c for c in fk.local_keys if c not in df.columns] + [f"{remote.name}.{c}" for c in (*fk.remote_keys, *fk.extra_columns.values()) if c not in there]


def _remote_side(df: DataFrame, fk: ForeignKey, remote: Remote, inside: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """The remote projection: its keys, the id under the public name, extra columns under local names (suffixed on a clash)."""
    columns = [quoted(k).alias(inside[f"key{i}"]) for i, k in enumerate(fk.remote_keys)] if fk.how != "cross" else []
    out: list[tuple[str, Column]] = []
    if remote.id_column not in df.columns:
        out.append((remote.id_column, quoted(remote.system_id)))
    for local, theirs in fk.extra_columns.items():
        if local in df.columns:
            local = f"{local}_{remote.name}"
            if local in df.columns:
                continue
        out.append((local, quoted(theirs)))
    return remote.df.select(*columns, *[c.alias(n) for n, c in out], F.lit(True).alias(inside["right"])), [n for n, _ in out]


def link(
    df: DataFrame, fk: ForeignKey, remote: Remote, mode: str = "strict", merge_indicator: str | None = None, counts: dict[str, int] | None = None
) -> tuple[DataFrame, LinkReport | None]:
    """df with the remote id (and extra columns). mode: off, warn, or strict (violations raise). merge_indicator names a column that
    tells where a row comes from: both, left_only or right_only.

    The join is declared only; Spark chooses broadcast, hash or sort-merge from sizes it knows. Constraints are judged by `key_counts`,
    which reads keys alone and makes no join of rows; `counts` are those of this link where a caller took them with others'.
    """
    absent = missing_columns(df, fk, remote)
    if absent:
        raise LinkError(f"link to {remote.name}: no column {', '.join(absent)}")
    taken = [*df.columns, remote.id_column, *fk.extra_columns, *[f"{c}_{remote.name}" for c in fk.extra_columns]]
    inside = {name: fresh(f"__{name}", taken) for name in ("left", "right", *[f"key{i}" for i in range(len(fk.remote_keys))])}
    theirs, added = _remote_side(df, fk, remote, inside)
    if fk.how != "cross" and not fk.local_keys:
        raise LinkError(f"link to {remote.name}: no keys to link by; all pairs are made by `how: cross` only")
    local = df.withColumn(inside["left"], F.lit(True))
    if fk.how == "cross":
        return _finish(local.crossJoin(theirs), df, fk, remote, added, merge_indicator, inside), None
    test = _same_keys([quoted(k) for k in fk.local_keys], [F.col(inside[f"key{i}"]) for i in range(len(fk.remote_keys))], null_matches(fk, remote))
    joined = local.join(theirs, test, {"outer": "full"}.get(fk.how, fk.how))
    report = None
    if mode != "off" and fk.constraints is not None:
        report = check(fk, counts or key_counts([(df, fk, remote)])[0], is_lookup(fk, remote))
        grown = len(df.columns) + 1 + len(set(fk.extra_columns.values()) - set(df.columns))
        if len(df.columns) + len(added) != grown:
            report.issues.append(f"a link brought {len(added)} columns ({', '.join(added) or 'none'}) where {grown - len(df.columns)} were due")
        if report.violations and mode == "strict":
            code, message = report.violations[0]
            raise (NullKeys if code == "NULL_KEYS" else ConstraintViolation)(code, f"{message} (link to {remote.name})")
    if fk.how in ("right", "outer"):  # the key of rows that only the remote side has
        for i, k in enumerate(fk.local_keys):
            if k == fk.remote_keys[i]:
                joined = joined.withColumn(k, F.when(F.col(inside["left"]), quoted(k)).otherwise(F.col(inside[f"key{i}"])))
    return _finish(joined, df, fk, remote, added, merge_indicator, inside), report


def _same_keys(ours: list[Column], theirs: list[Column], nulls: bool) -> Column:
    test = None
    for a, b in zip(ours, theirs, strict=True):
        part = a.eqNullSafe(b) if nulls else a == b
        test = part if test is None else test & part
    return test


def _finish(joined: DataFrame, df: DataFrame, fk: ForeignKey, remote: Remote, added: list[str], merge_indicator: str | None, inside: dict[str, str]) -> DataFrame:
    drop = {remote.id_column} if fk.drop_remote_id and fk.extra_columns and remote.id_column in added else set()
    told = indicator(F.col(inside["left"]), F.col(inside["right"]))
    return joined.select(*[quoted(c) for c in [*df.columns, *added] if c not in drop], *([told.alias(merge_indicator)] if merge_indicator else []))


def indicator(left: Column, right: Column) -> Column:
    return F.when(left & right, "both").when(left, "left_only").otherwise("right_only")


_COUNTS = ("left_rows", "left_nulls", "left_repeats", "right_rows", "right_nulls", "right_repeats", "matched", "lost", "unused")


def _link_counts(df: DataFrame, fk: ForeignKey, remote: Remote, nulls: bool) -> DataFrame:
    """One row of _COUNTS. Rows are counted for each key on both sides, and the keys alone are joined: a key with m and n rows makes
    m * n rows of the link, so that the link's size is known without making it, however skewed its keys are."""

    def side(table: DataFrame, keys: tuple[str, ...], s: str) -> DataFrame:
        by_key = table.select(*[quoted(k).alias(f"{s}{i}") for i, k in enumerate(keys)]).groupBy(*[f"{s}{i}" for i in range(len(keys))])
        null = F.lit(False)
        for i in range(len(keys)):
            null = null | F.col(f"{s}{i}").isNull()
        return by_key.agg(F.count(F.lit(1)).alias(f"{s}n")).withColumn(f"{s}z", null)

    left, right = side(df, fk.local_keys, "l"), side(remote.df, fk.remote_keys, "r")
    both = left.join(right, _same_keys([F.col(f"l{i}") for i in range(len(fk.local_keys))], [F.col(f"r{i}") for i in range(len(fk.remote_keys))], nulls), "full")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    own = [c for s in "lr" for c in (total(f"{s}n"), total(F.when(F.col(f"{s}z"), F.col(f"{s}n"))), total(F.when(~F.col(f"{s}z"), F.col(f"{s}n") - 1)))]
    made = [total(F.col("ln") * F.col("rn")), total(F.when(F.col("rn").isNull(), F.col("ln"))), total(F.when(F.col("ln").isNull(), F.col("rn")))]
    return both.agg(*[c.alias(n) for c, n in zip([*own, *made], _COUNTS, strict=True)])


def key_counts(links: list[tuple[DataFrame, ForeignKey, Remote]], nulls: bool | None = None) -> list[dict[str, int]]:
    """Counts behind the constraints of links, all taken by one job: rows, null keys and repeats of both sides, the rows that
    the link makes, and those with a side missing."""
    parts = [_link_counts(df, fk, remote, null_matches(fk, remote) if nulls is None else nulls).withColumn("at", F.lit(i)) for i, (df, fk, remote) in enumerate(links)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    out: list[dict[str, int]] = [{}] * len(links)
    for row in whole.collect():  # a row for each link
        fk = links[row["at"]][1]
        n = {k: row[k] for k in _COUNTS}
        n["left_only"] = n["lost"] if fk.how in ("left", "outer") else 0
        n["right_only"] = n["unused"] if fk.how in ("right", "outer") else 0
        n["rows"] = n.pop("matched") + n["left_only"] + n["right_only"]
        out[row["at"]] = n
    return out


def keeps_rows(fk: ForeignKey, n: dict[str, int]) -> bool:
    """Whether a link with these counts gives each local row exactly once."""
    return n["rows"] == n["left_rows"] and (fk.how == "left" or fk.how == "inner" and n["lost"] == 0)


def check(fk: ForeignKey, counts: dict[str, int], lookup: bool) -> LinkReport:
    c: Constraints = fk.constraints
    report = LinkReport(counts)
    n = report.counts
    strict_nulls = c.allow_null_keys is False or (c.allow_null_keys is None and not lookup)
    tests = [
        ("NULL_KEYS", strict_nulls and n["left_nulls"] + n["right_nulls"] > 0, f"{n['left_nulls']} local and {n['right_nulls']} remote rows have null keys"),
        ("NOT_UNIQUE_LEFT", c.require_unique_left and n["left_repeats"] > 0, f"{n['left_repeats']} local rows repeat a key"),
        ("NOT_UNIQUE_RIGHT", (c.require_unique_right or c.cardinality in ("many_to_one", "one_to_one")) and n["right_repeats"] > 0, f"{n['right_repeats']} remote rows repeat a key"),
        ("NOT_ONE_TO_ONE", c.cardinality == "one_to_one" and n["rows"] != n["left_rows"], f"{n['left_rows']} rows became {n['rows']}"),
        ("NOT_MANY_TO_ONE", c.cardinality == "many_to_one" and n["rows"] > n["left_rows"], f"{n['left_rows']} rows became {n['rows']}"),
        ("NOT_ONE_TO_MANY", c.cardinality == "one_to_many" and n["rows"] < n["left_rows"], f"{n['left_rows']} rows became {n['rows']}"),
        ("ROWS_LOST", c.allow_row_decrease is False and n["rows"] < n["left_rows"], f"{n['left_rows']} rows became {n['rows']}"),
        ("UNMATCHED_LEFT", c.allow_unmatched_left is False and n["left_only"] > 0, f"{n['left_only']} local rows have no match"),
        ("UNMATCHED_RIGHT", c.allow_unmatched_right is False and n["right_only"] > 0, f"{n['right_only']} remote rows have no match"),
    ]
    report.violations = [(code, text) for code, broken, text in tests if broken]
    if n["rows"] != n["left_rows"]:
        report.issues.append(f"a {fk.how} link changed the number of rows from {n['left_rows']} to {n['rows']}")
    return report


def map_to_remote(df: DataFrame, local_key: str, remote_key: str, mapping: dict) -> DataFrame:
    """Adds remote_key from a dictionary of local values; unmapped rows get null. Large dictionaries become a join."""
    if local_key not in df.columns or not mapping:
        return df
    spark = df.sparkSession
    rows = spark.createDataFrame([(str(k), None if v is None else int(v)) for k, v in mapping.items()], "__k string, __v long")
    rest = [c for c in df.columns if c != remote_key]
    return df.join(rows, quoted(local_key).cast("string") == F.col("__k"), "left").select(*[quoted(c) for c in rest], F.col("__v").alias(remote_key))


def join_stats(df: DataFrame, fk: ForeignKey, remote: Remote, samples: int = 10) -> dict:
    """How a link would go: match counts, cardinality as found, and some unmatched rows."""
    n = key_counts([(df, fk, remote)], nulls=False)[0]
    test = None
    for a, b in zip(fk.local_keys, fk.remote_keys, strict=True):
        part = df[a] == remote.df[b]
        test = part if test is None else test & part
    unmatched = df.join(remote.df, test, "left_anti")
    cardinality = {(0, 0): "one_to_one", (0, 1): "one_to_many", (1, 0): "many_to_one", (1, 1): "many_to_many"}[n["left_repeats"] > 0, n["right_repeats"] > 0]
    total, missing = n["left_rows"], n["lost"]
    return {
        "total_rows": total, "matched_rows": total - missing, "unmatched_rows": missing, "match_percentage": round(100 * (total - missing) / total, 2) if total else 0.0,
        "null_key_rows": n["left_nulls"], "duplicate_local_keys": n["left_repeats"], "duplicate_remote_keys": n["right_repeats"], "cardinality": cardinality,
        "unmatched_sample": [r.asDict() for r in unmatched.orderBy(*[quoted(k) for k in fk.local_keys]).limit(samples).collect()],
    }
