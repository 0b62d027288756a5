"""Named things that users can add to: a name leads to one thing, and taking a name twice is an error."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any


class Registry(Mapping):
    """kind: what is registered, for messages. The first name of a thing is its own, the others lead to it too."""

    def __init__(self, kind: str):
        self.kind, self._things, self._own = kind, {}, []

    def register(self, *names: str) -> Callable[[Any], Any]:
        """Decorates a function or class; without names its own name counts."""

        def add(thing):
            given = names or (thing.__name__,)
            taken = [n for n in given if n in self._things]
            if taken:
                raise KeyError(f"{self.kind} {taken[0]} is registered already")
            self._things.update(dict.fromkeys(given, thing))
            self._own.append(given[0])
            return thing

        return add

    def __getitem__(self, name: str):
        if name not in self._things:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self._own))}")
        return self._things[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._own)

    def __len__(self) -> int:
        return len(self._own)

    def discover(self, folder: str | Path, only: list[str] | None = None, file: str = "plugin.py") -> dict[str, str]:
        """Runs `file` of each folder below `folder`, which registers what it has. Returns what could not be loaded, and why.

        Folders whose names begin with _ or . are passed over, and those not in `only`. A folder must register its own name."""
        failed: dict[str, str] = {}
        for place in sorted(Path(folder).iterdir()) if Path(folder).is_dir() else ():
            name, source = place.name, place / file
            if not place.is_dir() or name[0] in "_." or only is not None and name not in only or name in self._things:
                continue
            if not source.is_file():
                failed[name] = f"no {file}"
                continue
            module = f"tessera_plugins_{self.kind}_{name}".replace(" ", "_").replace("-", "_")
            spec = importlib.util.spec_from_file_location(module, source)
            loaded = importlib.util.module_from_spec(spec)
            sys.modules[module] = loaded
            try:
                spec.loader.exec_module(loaded)
                if name not in self._things:
                    failed[name] = f"{file} registers no {self.kind} {name}"
            except Exception as e:  # noqa: BLE001  one bad plug-in is told of, the others are still loaded
                failed[name] = f"{type(e).__name__}: {e}"
        return failed
