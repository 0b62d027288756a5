"""From a project to lazy DataFrames: one plan for each entity, dependencies first.

Steps of an entity: parts (own source, appended, branches), each cut to its columns -> union -> derived columns ->
filters -> duplicates -> links -> waiting derived columns -> filters after links -> unnest, links, filters after it ->
late duplicates -> empty rows -> surrogate and public ids -> column order. Links that must wait for entities
later in the order (deferred, cyclic) are made once those are there.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.project import Entity, ForeignKey, Project, order_of
from ..functions.replace import apply_replacements, needs_order
from ..operators import reshape
from ..operators.extra_columns import add_extra_columns, sources_of
from ..operators.filters import apply_filters
from ..operators.identity import add_public_id, add_system_id, canonical_order
from ..operators.link import LinkReport, Remote, is_linked, keeps_rows, key_counts, link, map_to_remote, missing_columns
from ..operators.shared import fixed, quoted
from ..operators.subset import check_fd, drop_duplicates, drop_empty_rows, select_columns, translate_columns
from ..sources.registry import read_source

log = logging.getLogger(__name__)

#: place of a row among written values; dropped once ids are given
POSITION = "__position"


@dataclass
class Result:
    """Tables of a run and what was noticed on the way."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    reports: dict[tuple[str, str], LinkReport] = field(default_factory=dict)
    unresolved: dict[str, dict[str, object]] = field(default_factory=dict)
    unlinked: dict[str, list[str]] = field(default_factory=dict)

    def views(self, prefix: str = "") -> None:
        """Makes each table a temporary view of its name, for plain SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)


class Pipeline:
    """Builds the plans. given: tables that need no building (previews, tests). constraints: off, warn or strict."""

    def __init__(self, spark: SparkSession, project: Project, given: Mapping[str, DataFrame] | None = None, constraints: str = "strict", folder: str = "."):
        self.spark, self.project, self.given, self.mode, self.folder = spark, project, dict(given or {}), constraints, folder
        self.result = Result()
        self.waiting: dict[str, list[ForeignKey]] = {}

    # parts

    def source_of(self, entity: Entity) -> DataFrame:
        if entity.type == "entity" and entity.source is None and entity.name in self.given:
            return self.given[entity.name]
        df = read_source(self.spark, self.project, entity, {**self.given, **self.result.tables}, self.folder)
        if entity.type == "fixed" and not entity.data_source and not entity.order_by:  # values are in the order they are written in
            return df.coalesce(1).withColumn(POSITION, F.monotonically_increasing_id())
        return df

    def subset(self, entity: Entity, df: DataFrame) -> DataFrame:
        """The columns that the entity's steps need, replaced and made distinct."""
        later = set(entity.extra_columns)
        if entity.unnest:
            later |= {entity.unnest.var_name, entity.unnest.value_name}
        for fk in entity.foreign_keys:
            later |= set(fk.extra_columns)
        wanted = [*entity.keys, *entity.columns]
        if not wanted:
            wanted = [c for c in df.columns if c != POSITION]
        for fk in entity.foreign_keys:
            wanted += fk.local_keys
        for value in entity.extra_columns.values():
            wanted += sorted(sources_of(value, df.columns))
        if entity.unnest:
            wanted += [*entity.unnest.id_vars, *entity.unnest.value_vars]
        aliases = {}
        source = self.project.entities.get(entity.source or "")
        if source and source.public_id and source.public_id in wanted:
            aliases[source.public_id] = source.system_id
        wanted += [f["column"] for f in entity.filters if f.get("type") == "exists_in" and f.get("stage", "extract") == "extract" and f.get("column") in df.columns]
        wanted += [c for c in (*entity.order_by, POSITION) if c in df.columns]
        wanted = [c for c in wanted if c not in later or c in df.columns and c in (*entity.keys, *entity.columns)]
        out = select_columns(df, wanted, aliases=aliases)
        known = {k: v for k, v in entity.extra_columns.items() if k not in out.columns}
        out, _ = add_extra_columns(out, known, defer_missing=True)
        if entity.drop_duplicates and self._can_drop(entity, out):
            if entity.check_fd and entity.drop_duplicates is not True:
                bad = check_fd(out, entity.drop_duplicates, entity.strict_fd)
                if bad:
                    log.warning("%s: %s does not determine the other columns, e.g. %s", entity.name, entity.drop_duplicates, bad)
            out = self.distinct(entity, out)
        if entity.replacements:
            order = self.order(entity, out)
            if any(needs_order(s) for s in entity.replacements.values()) and not order:
                order = [c for c in (entity.system_id, *entity.keys) if c in out.columns]
            out = apply_replacements(out, entity.replacements, tuple(order))
        return out

    def order(self, entity: Entity, df: DataFrame) -> list[str]:
        """What "row order" means: declared, else the business keys."""
        return [c for c in (entity.order_by or (POSITION, *entity.keys)) if c in df.columns]

    def distinct(self, entity: Entity, df: DataFrame) -> DataFrame:
        by = entity.drop_duplicates
        if by is True and POSITION in df.columns:
            by = [c for c in df.columns if c != POSITION]
        return drop_duplicates(df, by, self.order(entity, df))

    def _can_drop(self, entity: Entity, df: DataFrame) -> bool:
        return entity.drop_duplicates is True or set(entity.drop_duplicates) <= set(df.columns)

    def _late(self, entity: Entity) -> bool:
        """Duplicates by columns that only unnesting makes."""
        return bool(entity.unnest and entity.drop_duplicates and (entity.drop_duplicates is True or {entity.unnest.var_name, entity.unnest.value_name} & set(entity.drop_duplicates)))

    def _lost(self, entity: Entity, fk: ForeignKey) -> bool:
        """A left link whose columns unnesting would drop again: it is made afterwards only."""
        if not entity.unnest or fk.how != "left" or any(f.get("stage") == "after_link" for f in entity.filters):
            return False
        remote = self.remote(fk)
        brings = {*fk.extra_columns, remote.id_column if remote else ""}
        return not brings & {*entity.unnest.id_vars, *entity.unnest.value_vars}

    def parts(self, entity: Entity) -> DataFrame:
        if entity.type == "merged":
            known = {**self.given, **self.result.tables}
            return reshape.merged(entity, {b.source: known[b.source] for b in entity.branches}, self.project.entities)
        own = self.subset(entity, self.source_of(entity))
        identity = [entity.system_id, *([entity.public_id] if entity.public_id else [])]
        parts = [own]
        for part in entity.appended():
            df = reshape.aligned(self.source_of(part).drop(POSITION), part, list(entity.columns or own.columns), identity)
            if part.align_by_position or part.column_mapping:  # its own names are gone
                part = replace(part, columns=tuple(part.column_mapping.get(c, c) for c in part.columns) if part.column_mapping else entity.columns, keys=())
            parts.append(self.subset(part, df))
        out = reshape.union(parts)
        return out.drop(POSITION).distinct() if entity.append and entity.append_mode == "distinct" else out

    # one entity

    def remote(self, fk: ForeignKey) -> Remote | None:
        tables = {**self.given, **self.result.tables}
        if fk.entity not in tables:
            return None
        e = self.project.entities.get(fk.entity)
        return Remote(fk.entity, tables[fk.entity], e.system_id if e else "system_id", e.public_id if e else None)

    def counted(self, df: DataFrame, fks: Sequence[ForeignKey]) -> dict[int, dict[str, int]]:
        """Counts of the links up to the last constrained one, by one job, from the rows as they are before the first link."""
        places = [i for i, fk in enumerate(fks) if fk.constraints is not None]
        if self.mode == "off" or not places:
            return {}
        due = {}
        for i, fk in enumerate(fks[: places[-1] + 1]):
            remote = self.remote(fk)
            if remote is None or fk.how == "cross" or not fk.local_keys or missing_columns(df, fk, remote) or is_linked(df, fk, remote.id_column):
                continue
            due[i] = (df, fk, remote)
        return dict(zip(due, key_counts(list(due.values())), strict=True)) if due else {}

    def links(self, entity: Entity, df: DataFrame, fks: Sequence[ForeignKey]) -> tuple[DataFrame, list[ForeignKey]]:
        waiting, counts, same = [], self.counted(df, fks), True  # same: links so far gave each row once, so that the counts still hold
        for i, fk in enumerate(fks):
            remote = self.remote(fk)
            if remote is not None and is_linked(df, fk, remote.id_column):
                continue
            if remote is None or any(k not in df.columns for k in fk.local_keys):
                waiting.append(fk)  # not built yet, or its keys come with unnesting
                continue
            known = counts.get(i) if same else None
            df, report = link(df, fk, remote, self.mode, counts=known)
            known = report.counts if report else known
            same = same and known is not None and keeps_rows(fk, known)
            if report:
                self.result.reports[entity.name, fk.entity] = report
                for text in [*[m for _, m in report.violations], *report.issues]:
                    log.warning("%s -> %s: %s", entity.name, fk.entity, text)
        return df, waiting

    def derive(self, df: DataFrame, waiting: Mapping[str, object]) -> tuple[DataFrame, dict[str, object]]:
        return add_extra_columns(df, waiting, defer_missing=True) if waiting else (df, {})

    def build(self, entity: Entity) -> DataFrame:
        store = {**self.given, **self.result.tables}
        df, late = self.derive(self.parts(entity), entity.extra_columns)
        df = apply_filters(df, entity.filters, store, "extract")
        if entity.drop_duplicates and not self._late(entity) and self._can_drop(entity, df):
            df = self.distinct(entity, df)
        df, fks = self.links(entity, df, [fk for fk in entity.foreign_keys if not self._lost(entity, fk)])
        df, late = self.derive(df, late)
        df = apply_filters(df, entity.filters, store, "after_link")
        if entity.unnest:
            df = reshape.unnest(df, entity.unnest)
            df, fks = self.links(entity, df, entity.foreign_keys)
            df, late = self.derive(df, late)
            df = apply_filters(df, entity.filters, store, "after_unnest")
        if self._late(entity):
            df = self.distinct(entity, df)
        if entity.drop_empty_rows:
            whole = [c for c in df.columns if c != POSITION]
            df = drop_empty_rows(df, whole if entity.drop_empty_rows is True else entity.drop_empty_rows)
        given = entity.system_id in df.columns
        df = add_system_id(df, self.order(entity, df) or [c for c in df.columns if c != entity.system_id], entity.system_id).drop(POSITION)
        df = add_public_id(df, entity.public_id)
        df = fixed(df) if given else df  # numbering has written its rows already; ids must not change once others link to them
        self.waiting[entity.name] = fks
        self.result.unresolved[entity.name] = late
        return df

    def reorder(self, entity: Entity, df: DataFrame) -> DataFrame:
        fk_ids = [r.id_column for fk in entity.foreign_keys if (r := self.remote(fk))]
        return df.select(*[quoted(c) for c in canonical_order(df.columns, entity.system_id, entity.public_id, fk_ids, list(entity.extra_columns))])

    def run(self, targets: Sequence[str] | None = None) -> Result:
        for name in order_of(self.project, targets):
            if name in self.given:
                self.result.tables[name] = self.given[name]
                continue
            entity = self.project.entities[name]
            self.result.tables[name] = self.reorder(entity, self.build(entity))
            self.retry()
        while self.retry():  # links round a cycle may wait for each other's columns; each pass makes one at least
            pass
        self.result.unlinked = {n: [f.entity for f in fks] for n, fks in self.waiting.items() if fks}
        for n, names in self.result.unlinked.items():
            log.warning("%s is not linked to %s", n, ", ".join(names))
        self.result.unresolved = {n: late for n, late in self.result.unresolved.items() if late}
        return self.result

    def retry(self) -> bool:
        """Makes waiting links that can be made now."""
        moved = False
        for name, fks in list(self.waiting.items()):
            if not fks:
                continue
            entity, df = self.project.entities[name], self.result.tables.get(name)
            if df is None:
                continue
            new, left = self.links(entity, df, fks)
            if len(left) < len(fks):
                moved = True
                new, late = self.derive(new, self.result.unresolved.get(name, {}))
                self.result.unresolved[name], self.waiting[name] = late, left
                self.result.tables[name] = self.reorder(entity, new)
        return moved


def normalize(spark: SparkSession, project: Project, targets: Sequence[str] | None = None, given: Mapping[str, DataFrame] | None = None, constraints: str = "strict", folder: str = ".") -> Result:
    return Pipeline(spark, project, given, constraints, folder).run(targets)


def drop_foreign_keys(project: Project, result: Result) -> Result:
    """Drops local key columns that are not among the entity's own columns."""
    for name, df in result.tables.items():
        entity = project.entities.get(name)
        if entity:
            keys = {k for fk in entity.foreign_keys for k in fk.local_keys} - set(entity.columns) - set(entity.keys)
            result.tables[name] = df.drop(*keys)
    return result


def workflow(
    spark: SparkSession,
    project: Project,
    sink: Callable[[Mapping[str, DataFrame]], None] | None = None,
    targets: Sequence[str] | None = None,
    translations: Mapping[str, str] | None = None,
    drop_keys: bool = False,
    given: Mapping[str, DataFrame] | None = None,
    folder: str = ".",
) -> Result:
    """normalize, then drop keys, translate names, map to remote ids, drop what options.finally names, and write."""
    result = normalize(spark, project, targets, given, folder=folder)
    if drop_keys:
        drop_foreign_keys(project, result)
    for name, df in result.tables.items():
        spec = (project.options.get("mappings") or {}).get(name)
        if spec:
            df = map_to_remote(df, spec["local_key"], spec["remote_key"], spec.get("mapping") or {})
        result.tables[name] = translate_columns(df, translations) if translations else df
    for name in (project.options.get("finally") or {}).get("drop") or []:
        result.tables.pop(name, None)
    if sink:
        sink(result.tables)
    return result


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values of more than one row, with their number."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
