"""Configuration files: @include, @load, @value, environment variables and YAML tags, resolved before use."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Mapping
from pathlib import Path

import yaml

from .project import Project, ProjectError

_ENV = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


class _Loader(yaml.SafeLoader):
    pass


_Loader.add_constructor("!join", lambda l, n: "".join(str(x) for x in l.construct_sequence(n, deep=True)))
_Loader.add_constructor("!jj", lambda l, n: os.path.join(*[str(x) for x in l.construct_sequence(n, deep=True)]))
_Loader.add_constructor("!path_join", lambda l, n: os.path.join(*[str(x) for x in l.construct_sequence(n, deep=True)]))


def _ignored(loader, suffix, node):
    match node:
        case yaml.MappingNode():
            return loader.construct_mapping(node, deep=True)
        case yaml.SequenceNode():
            return loader.construct_sequence(node, deep=True)
    return loader.construct_scalar(node)


_Loader.add_multi_constructor("!", _ignored)


def read_yaml(path: str | Path) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.load(f, _Loader) or {}  # noqa: S506  a SafeLoader with three tags


def lookup(config: Mapping, path: str, default=None):
    """The value at a dotted path; `a.b,c.d` (or with `:`) names alternatives, the first found counts."""
    for alternative in re.split(r"[,:]", path):
        here = config
        for part in alternative.strip().split("."):
            if isinstance(here, Mapping) and part in here:
                here = here[part]
            elif isinstance(here, list) and part.isdigit() and int(part) < len(here):
                here = here[int(part)]
            else:
                break
        else:
            return here
    return default


def _walk(value, change, path=()):
    """The value rebuilt, with change(leaf, path) for each string."""
    if isinstance(value, Mapping):
        return {k: _walk(v, change, (*path, k)) for k, v in value.items()}
    if isinstance(value, list):
        out = []
        for i, v in enumerate(value):
            new = _walk(v, change, (*path, i))
            if isinstance(v, str) and v.startswith(("@value:", "@load:", "@include:")) and isinstance(new, list):
                out += new  # a reference to a list inside a list is spliced in
            else:
                out.append(new)
        return out
    return change(value, path) if isinstance(value, str) else value


def included(config, folder: Path, depth: int = 0):
    if depth > 20:
        raise ProjectError("@include nests too deeply")

    def change(text: str, _path):
        if not text.startswith("@include:"):
            return text
        file = folder / text.removeprefix("@include:").strip()
        return included(read_yaml(file), file.parent, depth + 1)

    return _walk(config, change)


def read_values(file: str | Path, sep: str | None = None) -> list[dict]:
    """Rows of a CSV, TSV (all strings) or Parquet file (types kept), for values inside a configuration."""
    file = Path(file)
    if file.suffix == ".parquet":
        import pyarrow.parquet as pq

        return pq.read_table(file).to_pylist()
    with open(file, encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f, delimiter=sep or ("\t" if file.suffix == ".tsv" else ",")))


def loaded(config, folder: Path):
    def change(text: str, _path):
        if not text.startswith("@load:"):
            return text
        name = text.removeprefix("@load:").strip()
        spec = lookup(config, name) if not (folder / name).exists() else None
        if isinstance(spec, Mapping):
            options = {**spec, **(spec.get("options") or {})}
            return read_values(folder / options["filename"], options.get("sep") or options.get("delimiter"))
        return read_values(folder / name)

    return _walk(config, change)


def with_environment(config, strict: bool = False, environment: Mapping[str, str] | None = None):
    environment = os.environ if environment is None else environment

    def value(m: re.Match) -> str:
        found = environment.get(m[1], m[2])
        if found is None and strict:
            raise ProjectError(f"environment variable {m[1]} is not set")
        return found if found is not None else m[0] if not strict else ""

    return _walk(config, lambda text, _: _ENV.sub(value, text))


def overlaid(config: Mapping, prefix: str | None, environment: Mapping[str, str] | None = None) -> dict:
    """PREFIX_A_B=x in the environment sets a.b; existing keys are matched without regard to case."""
    out = _walk(config, lambda t, _: t)
    for name, text in sorted((os.environ if environment is None else environment).items()):
        if not prefix or not name.upper().startswith(prefix.upper() + "_"):
            continue
        parts, here = name[len(prefix) + 1 :].lower().split("_"), out
        while parts:
            for n in range(len(parts), 0, -1):
                key = next((k for k in here if isinstance(k, str) and k.lower() == "_".join(parts[:n])), None)
                if key is not None:
                    break
            if key is None:
                here["_".join(parts)] = text
                break
            parts = parts[n:]
            if not parts:
                here[key] = text
            elif isinstance(here[key], dict):
                here = here[key]
            else:
                break
    return out


def referenced(config, strict: bool = False, rounds: int = 10):
    """@value: a.b, also in sums of lists (`@value: a + @value: b`)."""
    for _ in range(rounds):
        seen = False

        def one(text: str):
            path = text.strip().removeprefix("@value:").strip()
            found = lookup(config, path, _MISSING)  # noqa: B023
            if found is _MISSING:
                if strict:
                    raise ProjectError(f"@value: nothing at {path}")
                return text
            return found

        def change(text: str, _path):
            nonlocal seen
            if "@value:" not in text:
                return text
            parts = [p for p in re.split(r"\s\+\s", text) if p.strip()]
            if len(parts) == 1:
                if not text.strip().startswith("@value:"):
                    return text
                new = one(text)
                seen |= new is not text
                return new
            out: list = []
            for p in parts:
                v = one(p) if p.strip().startswith("@value:") else yaml.safe_load(p)
                if isinstance(v, str) and v.strip().startswith("@value:"):
                    return text
                out += v if isinstance(v, list) else [v]
            seen = True
            return out

        config = _walk(config, change)
        if not seen:
            return config
    raise ProjectError("@value references do not come to an end")


_MISSING = object()


def resolve(config: Mapping, folder: str | Path = ".", strict: bool = False, env_prefix: str | None = None, environment: Mapping[str, str] | None = None) -> dict:
    """include -> load -> environment overlay -> environment variables -> references."""
    folder = Path(folder)
    config = loaded(included(config, folder), folder)
    return referenced(with_environment(overlaid(config, env_prefix, environment), strict, environment), strict)


def directives(config) -> list[tuple[str, str]]:
    """(dotted place, directive) of everything still unresolved."""
    found: list = []
    _walk(config, lambda t, p: found.append((".".join(map(str, p)), t)) or t if t.startswith(("@include:", "@load:", "@value:")) else t)
    return found


def check_directives(config: Mapping, folder: str | Path = ".") -> list[str]:
    """What cannot be resolved, as messages."""
    out = []
    for place, text in directives(config):
        kind, _, rest = text.partition(":")
        rest = rest.strip()
        if kind == "@include" and not (Path(folder) / rest).exists():
            out.append(f"{place}: no file {rest}")
        elif kind == "@load" and not (Path(folder) / rest).exists() and lookup(config, rest) is None:
            out.append(f"{place}: neither a file nor an option {rest}")
        elif kind == "@value":
            paths = [p.strip().removeprefix("@value:").strip() for p in re.split(r"\s\+\s", text) if "@value:" in p]
            out += [f"{place}: nothing at {p}" for p in paths if lookup(config, p, _MISSING) is _MISSING]
    return out


def load_project(path: str | Path, strict: bool = False, env_prefix: str | None = None) -> Project:
    path = Path(path)
    return Project.of(resolve(read_yaml(path), path.parent, strict, env_prefix))


def managed_path(filename: str, location: str | None, project_folder: str | Path, global_folder: str | Path) -> str:
    """`location: local` is the project's folder, `global` the shared one; absolute paths and URLs stay."""
    if os.path.isabs(filename) or "://" in filename:
        return filename
    if location not in (None, "local", "global"):
        raise ProjectError(f"unknown location {location}")
    return str(Path(global_folder if location == "global" else project_folder) / filename)
