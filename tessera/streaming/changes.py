"""A streaming source of file changes: a folder is listed again and again, and what differs is an event.

Rows are (repo, path, op, ts).  Every listing also gives one row with op 'tick', whose time moves the watermark on, so
that the last burst before a silence is closed, too; debounced() leaves ticks out behind the watermark.
"""

from __future__ import annotations

import datetime as dt
import os
import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessera.sources.staging import ship

SCHEMA = "repo string, path string, op string, ts timestamp"
TICK = "tick"


class _Reader(SimpleDataSourceStreamReader):
    """The state is the last listing.  After a restart it begins anew: what changed meanwhile is in the next snapshot anyway."""

    def __init__(self, repo: str, root: str) -> None:
        self.repo, self.root = repo, root
        self.seen = self._listed()

    def _listed(self) -> dict[str, tuple[int, int, int]]:
        out = {}
        for folder, folders, names in os.walk(self.root):
            folders[:] = [f for f in folders if f not in (".git", ".tessera", "node_modules", "__pycache__")]  # what no watch heeds isn't entered
            for name in names:
                whole = os.path.join(folder, name)
                try:
                    s = os.lstat(whole)
                except FileNotFoundError:
                    continue
                out[os.path.relpath(whole, self.root)] = (s.st_mtime_ns, s.st_size, s.st_mode)
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now, before = self._listed(), self.seen
        at = dt.datetime.now(dt.timezone.utc)
        rows = [(self.repo, p, "add" if p not in before else "change", at) for p, s in now.items() if before.get(p) != s]
        rows += [(self.repo, p, "unlink", at) for p in before.keys() - now.keys()]
        self.seen = now
        return iter([*rows, (self.repo, "", TICK, at)]), {"n": start["n"] + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([])

    def commit(self, end: dict) -> None:
        pass


class Changes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:  # noqa: N802
        return _Reader(self.options.get("repo", "repo"), self.options["path"])


def changes(spark: SparkSession, root: str, repo: str = "repo") -> DataFrame:
    """A stream of the changes below a folder of this machine."""
    ship(spark)
    spark.dataSource.register(Changes)
    return spark.readStream.format("tessera_changes").option("repo", repo).load(root)


class Mark:
    """A file that says which process watches; one of a process that has ended, or that was not renewed, is removed."""

    FRESH_S = 60

    def __init__(self, path: str) -> None:
        self.path = path

    def set(self) -> None:
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(self.path, "w", encoding="utf-8") as f:
            f.write(f"{os.getpid()} {socket.gethostname()}\n")

    def renew(self) -> None:
        if os.path.exists(self.path):
            os.utime(self.path)

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)

    def pid(self) -> int | None:
        """The process that watches, seen from any process."""
        try:
            with open(self.path, encoding="utf-8") as f:
                pid, _, host = f.read().strip().partition(" ")
            if host == socket.gethostname():
                os.kill(int(pid), 0)
            elif dt.datetime.now().timestamp() - os.path.getmtime(self.path) > self.FRESH_S:
                raise ProcessLookupError
            return int(pid)
        except FileNotFoundError:
            return None
        except PermissionError:  # it lives, and is another user's
            return int(pid)
        except (ProcessLookupError, ValueError):
            self.clear()
            return None
