"""python -m tessera project.yml target --mode csv|xlsx|db|...: builds a project and writes its tables."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config.directives import load_project
from .plans.pipeline import workflow
from .quality.specifications import check_project
from .quality.validators import validate
from .sinks.writers import SINKS, write, write_table_shapes


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("project")
    p.add_argument("target")
    p.add_argument("--mode", choices=sorted(SINKS), default="csv")
    p.add_argument("--entity", action="append", help="build this entity and what it needs; may be repeated")
    p.add_argument("--drop-foreign-keys", action="store_true")
    p.add_argument("--validate", action="store_true", help="check the configuration first, and the tables afterwards")
    p.add_argument("--env-prefix")
    o = p.parse_args(args)
    project = load_project(o.project, strict=True, env_prefix=o.env_prefix)
    if o.validate and (found := check_project(project)):
        print(*(f"{i.severity}: {i.entity}: {i.message}" for i in found), sep="\n", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName(f"tessera {project.name}").getOrCreate()
    result = workflow(spark, project, lambda tables: write(o.mode, o.target, tables), o.entity, drop_keys=o.drop_foreign_keys, folder=str(Path(o.project).parent))
    if o.mode in ("csv", "parquet", "single_csv") and "://" not in o.target:
        write_table_shapes(o.target, result.tables)
    if o.validate:
        issues = validate(project, result.tables)
        print(*(f"{i.severity}: {i.entity}: {i.message}" for i in issues), sep="\n", file=sys.stderr)
        return int(any(i.severity == "error" for i in issues))
    return 0


if __name__ == "__main__":
    sys.exit(main())
