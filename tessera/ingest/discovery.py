"""Ingesters: ways to take a submission in, by name; folders of plug-ins can add theirs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import SparkSession

from ..config.registry import Registry
from ..quality.validators import Issue
from .runs import Run
from .submission import Schema, apply_policies, check_submission, submission_from_workbook


@dataclass(frozen=True)
class About:
    """What a list of ingesters shows."""

    key: str
    name: str
    description: str = ""
    version: str = "1"
    formats: tuple[str, ...] = ("xlsx",)


@dataclass
class Result:
    success: bool
    message: str
    submission_id: int | None = None
    tables: int = 0
    records: int = 0
    issues: list[Issue] = field(default_factory=list)


class Ingester(Protocol):
    """Made with a session, a schema and options."""

    about: About

    def validate(self, source: str) -> list[Issue]: ...

    def ingest(self, source: str) -> Result: ...


INGESTERS = Registry("ingester")


@INGESTERS.register("workbook")
class WorkbookIngester:
    """A workbook by the policies and checks of this package, put out as entity-attribute-value rows; a resumable run."""

    about = About("workbook", "Workbook", "sheets by table, policies, checks, export")

    def __init__(self, spark: SparkSession, schema: Schema, options: Mapping):
        self.spark, self.schema, self.options = spark, schema, options

    def validate(self, source: str) -> list[Issue]:
        return check_submission(apply_policies(submission_from_workbook(self.spark, self.schema, source), self.options.get("policies")))

    def ingest(self, source: str) -> Result:
        run = Run(self.spark, self.schema, self.options["folder"], self.options.get("policies"), self.options.get("strict", True), self.options.get("register"), self.options.get("name", "submission"))
        out = run.start(source)
        if out.eav is None:
            return Result(False, f"{len(out.issues)} faults", issues=out.issues)
        found = out.eav.records.groupBy("class_name").count().collect()  # a row for each table
        return Result(True, "done", out.submission_id, len(found), sum(r["count"] for r in found), out.issues)


def listed() -> list[About]:
    return [INGESTERS[k].about for k in INGESTERS]
