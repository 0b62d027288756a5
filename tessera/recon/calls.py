"""Calls of a service by many tasks, each answered once.

A batch of queries is known by its content. Before a task asks, it looks into the ledger, a folder that all tasks share, for the answer of
an earlier attempt; if there is none it claims the batch, so that a second attempt that runs beside it waits for the first one's answer.
A claim, and a place among the calls in flight, is a file that only one task can make; one whose task died is taken over once its
lease has run out. Answers are written under another name and moved, so that none is read in part.

Calls that fail with a passing fault (no connection, 429, 5xx) are repeated after pauses that double; other faults fail the task at once.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from urllib import error, request

_POLL = 0.05


class ServiceError(RuntimeError):
    pass


def _passing(e: Exception) -> bool:
    if isinstance(e, error.HTTPError):
        return e.code == 429 or e.code >= 500
    return isinstance(e, error.URLError | ConnectionError | TimeoutError)


def post(url: str, data: bytes, timeout: float = 30, attempts: int = 6, pause: float = 0.5) -> object:
    """The JSON answer of a POST."""
    for n in range(attempts):
        try:
            with request.urlopen(request.Request(url, data), timeout=timeout) as answer:  # noqa: S310  the caller's own service
                return json.load(answer)
        except Exception as e:
            if not _passing(e) or n == attempts - 1:
                raise ServiceError(f"{url}: {e}") from e
            wait = e.headers.get("Retry-After", "") if isinstance(e, error.HTTPError) else ""
            time.sleep(max(pause * 2**n, float(wait) if wait.isdigit() else 0))
    raise ServiceError(f"{url}: no attempts are allowed")


@dataclass(frozen=True)
class Ledger:
    """Answers in a mounted folder. lease: seconds after which an untouched claim counts as its task's death."""

    folder: str
    lease: float = 120
    in_flight: int = 8

    def _path(self, name: str) -> Path:
        return Path(self.folder, name)

    def answer(self, key: str) -> object | None:
        try:
            return json.loads(self._path(f"{key}.json").read_text())["answer"]
        except FileNotFoundError:
            return None

    def _made(self, name: str) -> bool:
        """Makes a file that is not there, or takes over one whose lease has run out."""
        path = self._path(name)
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            try:
                if time.time() - path.stat().st_mtime > self.lease:
                    old = path.with_name(f"{name}.{uuid.uuid4().hex}")
                    os.rename(path, old)  # only one task can move it away
                    os.unlink(old)
            except FileNotFoundError:
                pass
            return False

    @contextmanager
    def place(self) -> Iterator[None]:
        """One of the places of calls in flight."""
        held = None
        while held is None:
            held = next((n for k in range(self.in_flight) if self._made(n := f"place-{k}")), None)
            if held is None:
                time.sleep(_POLL)
        try:
            yield
        finally:
            self._path(held).unlink(missing_ok=True)

    def once(self, content: object, ask: Callable[[], object]) -> object:
        """The answer to a batch, by asking if nobody has."""
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        key = hashlib.sha256(json.dumps(content, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()
        while True:
            found = self.answer(key)
            if found is not None:
                return found
            if not self._made(f"{key}.claim"):
                time.sleep(_POLL)
                continue
            try:
                found = self.answer(key)  # its first task may have finished in between
                if found is not None:
                    return found
                with self.place():
                    out = ask()
                draft = self._path(f"{key}.{uuid.uuid4().hex}")
                draft.write_text(json.dumps({"answer": out}))
                os.replace(draft, self._path(f"{key}.json"))
                return out
            finally:
                self._path(f"{key}.claim").unlink(missing_ok=True)
