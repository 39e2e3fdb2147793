"""The tool surface over one source tree: find, read and map code; record, compare, restore and bisect its history."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import render
from tessera.functions.display import parse_duration
from tessera.operators import bisect as B
from tessera.operators import cost, readers, repo_map, search, timeline
from tessera.sources import files as FS
from tessera.sources.code_index import Built, CodeIndex, NotIndexed, build_index, load_index, save_index
from tessera.sources.timeline_store import TimelineStore, put
from tessera.streaming.changes import Mark


class RestoreRefused(PermissionError):
    """An agent asked for a restore that the configuration doesn't allow."""


@dataclass
class Restored:
    applied: bool
    pre_restore: str
    plan: list[Row]
    noop: bool


class Workspace:
    """root: the source tree; state: the folder of its tables, both on storage that the executors share."""

    def __init__(self, spark: SparkSession, root: str, state: str | None = None) -> None:
        self.spark, self.root = spark, root
        self.state = state or os.path.join(root, FS.STATE_FOLDER)
        self.store = TimelineStore(spark, f"{self.state}/timeline", os.path.basename(root.rstrip("/")))

    # --- settings

    @property
    def config(self) -> FS.Config:
        return FS.load_config(os.path.join(self.state, "config.json"))

    def init(self) -> Built:
        FS.save_config(os.path.join(self.state, "config.json"), self.config)
        return self.index()

    def _ignore(self) -> list[str]:
        return [*FS.ignore_patterns(FS.read_text(self.root, ".gitignore")), *FS.ignore_patterns(FS.read_text(self.root, ".git/info/exclude")), *FS.ignore_patterns(FS.read_text(self.root, ".tesseraignore")), f"{FS.STATE_FOLDER}/"]

    # --- features

    @property
    def _features_path(self) -> str:
        return os.path.join(self.state, "features.yml")

    @property
    def features(self) -> dict[str, dict[str, list[str]]]:
        return FS.load_features(self._features_path)

    def feature_list(self) -> list[tuple[str, list[str], list[str]]]:
        return [(n, f["paths"], f["aliases"]) for n, f in sorted(self.features.items())]

    def feature_add(self, name: str, paths: list[str], aliases: list[str] | None = None) -> None:
        FS.save_features(self._features_path, FS.add_feature(self.features, name, paths, aliases))

    def feature_rm(self, name: str) -> None:
        FS.save_features(self._features_path, FS.remove_feature(self.features, name))

    def feature_suggest(self) -> DataFrame:
        index = self.ensure_index()
        return readers.suggest_features(index.files, index.symbols, [g for f in self.features.values() for g in f["paths"]])

    # --- code

    def _texts(self) -> DataFrame:
        return FS.scan_folder(self.spark, self.root, self._ignore())

    def _contents(self) -> DataFrame:
        return FS.scan_bytes(self.spark, self.root, self._ignore())

    def index(self, force: bool = False) -> Built:
        previous = None if force else load_index(self.spark, f"{self.state}/index")
        built = build_index(self._texts(), previous, FS.tsconfig_aliases(self.root))
        save_index(built.index, f"{self.state}/index")
        return built

    def index_stats(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        index = self.ensure_index()
        return readers.language_statistics(index.files), readers.kind_statistics(index.symbols), readers.top_files(index.files)

    def load_index(self) -> CodeIndex:
        found = load_index(self.spark, f"{self.state}/index")
        if found is None:
            raise NotIndexed(self.root)
        return found

    def ensure_index(self) -> CodeIndex:
        """The stored index, or a new one; a stored one is not checked for staleness."""
        return load_index(self.spark, f"{self.state}/index") or self.index().index

    def find_feature(self, query: str, limit: int = 10, kind: str | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("empty query")
        index = self.ensure_index()
        return search.search(index.docs, query, min(limit, 50), self.features, kind, index.terms)

    def get_symbol(self, file: str, name: str, include: str = "body") -> Row | None:
        return readers.symbol_body(self.ensure_index().symbols, self._texts(), file, name, include == "body").first()

    def outline(self, file: str) -> DataFrame | None:
        """None for an unknown file; no rows for one without symbols."""
        index = self.ensure_index()
        if index.files.where(F.col("path") == file).isEmpty():
            return None
        return readers.outline(index.symbols, file)

    def references(self, name: str, limit: int = readers.REFERENCE_LIMIT) -> DataFrame:
        index = self.ensure_index()
        texts = self._texts().join(index.files.select("path"), "path", "left_semi")
        return readers.references(index.symbols, texts, name, min(limit, 300))

    def repo_map(self, budget_tokens: int = 2000, private: bool = False) -> str:
        index = self.ensure_index()
        return repo_map.repo_map(index.files, index.symbols, min(budget_tokens, 20_000), private).render()

    def measure_tokens(self, queries: list[str]) -> list[cost.Cost]:
        """Estimated tokens of each query by whole files and by the index, and the total."""
        index, texts = self.ensure_index(), self._texts()
        each = [cost.measure(texts, index.docs, index.symbols, q, self.features, index=index.terms) for q in queries]
        return [*each, cost.total(each)]

    # --- the same as text

    def find_text(self, query: str, limit: int = 10, kind: str | None = None) -> str:
        return render.lines(self.find_feature(query, limit, kind), render.hit())

    def outline_text(self, file: str) -> str | None:
        rows = self.outline(file)
        return None if rows is None else render.lines(rows, render.outline_row())

    def references_text(self, name: str, limit: int = readers.REFERENCE_LIMIT) -> str:
        return render.lines(self.references(name, limit), render.reference())

    def log_text(self, limit: int = timeline.LOG_LIMIT) -> str:
        return render.lines(self.log(limit), render.log_row(F.lit(int(time.time()))))

    def list_text(self, limit: int = 20) -> str:
        return render.lines(timeline.log(self.store.snapshots, min(limit, 200)), render.summary())

    # --- history

    def git_state(self) -> tuple[str, str | None]:
        """Branch and commit that the tree has checked out: 'unknown' and None outside of a repository, 'HEAD' if detached."""
        head = FS.read_text(self.root, ".git/HEAD").strip()
        if not head.startswith("ref: "):
            return ("HEAD", head) if head else ("unknown", None)
        ref = head.removeprefix("ref: ")
        packed = {r: c for c, _, r in (line.partition(" ") for line in FS.read_text(self.root, ".git/packed-refs").splitlines())}
        return ref.removeprefix("refs/heads/"), FS.read_text(self.root, f".git/{ref}").strip() or packed.get(ref)

    def snap(self, label: str = "", source: str = "manual", agent: str | None = None, turn: str | None = None) -> Row | None:
        return self.store.create(self._contents(), label, source, agent, turn, *self.git_state())

    def checkpoint_begin(self, label: str, turn: str | None = None, agent: str | None = None) -> Row | None:
        return self.snap(f"begin: {label}", "agent", agent, turn)

    def checkpoint_end(self, label: str, turn: str | None = None, agent: str | None = None) -> tuple[Row | None, list[Row]]:
        made = self.snap(f"end: {label}", "agent", agent, turn)
        return made, self.changed(made.id).collect() if made else []

    def log(self, limit: int | None = timeline.LOG_LIMIT, since_ms: float | None = None, source: str | None = None, file: str | None = None) -> DataFrame:
        rows = timeline.log(self.store.snapshots, limit, since_ms, source, file, self.store.entries)
        return timeline.change_counts(rows, self.store.entries).orderBy(F.desc("seq"))

    def checkpoint_list(self, limit: int = 20, since_minutes: float | None = None, file: str | None = None) -> DataFrame:
        since = None if since_minutes is None else (time.time() - 60 * since_minutes) * 1000
        return self.log(min(limit, 200), since, None, file)

    def changed(self, ref: str) -> DataFrame:
        one = timeline.resolve(self.store.snapshots, ref)
        return timeline.changed_files(self.store.snapshots.where(F.col("id") == one.id), self.store.entries).orderBy("path")

    def diff(self, start: str, end: str | None = None, paths: list[str] | None = None, stat: bool = False) -> DataFrame:
        """Changed files between two snapshots, or a snapshot and the files as they are; without stat, with line diffs."""
        snapshots = self.store.snapshots
        a = timeline.resolve(snapshots, start).tree
        b = timeline.resolve(snapshots, end).tree if end else self.store.write_tree(self._contents())
        changes = timeline.diff(self.store.entries, a, b, paths)
        return (changes if stat else timeline.patch(changes, self.store.blobs)).orderBy("path")

    def restore(self, ref: str, files: list[str] | None = None, dry_run: bool = False) -> Restored:
        """Bring the tree (or some files) back to a snapshot; what is there now is recorded first, so this can be undone."""
        target = timeline.resolve(self.store.snapshots, ref)
        self.snap("before restore", "pre-restore")
        base = self.store.tip()
        plan = timeline.restore_plan(self.store.entries, base.tree, target.tree, files)
        todo = plan.orderBy("path").collect()
        before = self.store.snapshots.where(F.col("seq") == base.seq).first().id
        if todo and not dry_run:
            self.store.apply(plan, self.root)
        return Restored(bool(todo) and not dry_run, before, todo, not todo)

    def checkpoint_restore(self, ref: str, files: list[str] | None = None) -> Restored:
        """The same for agents: refused unless the configuration allows it."""
        if not self.config.allow_agent_restore:
            raise RestoreRefused("set allowAgentRestore, or run restore yourself")
        return self.restore(ref, files)

    def bisect(self, command: Sequence[str] | Callable[[str], bool], limit: int = B.LIMIT, timeout_s: float = 300, on_step: Callable[..., None] | None = None) -> B.Found:
        """The first snapshot for which the command fails in a fresh copy of its tree, with the first files that it changed.

        A function instead of a command gets the copy's folder.
        """
        chain = timeline.log(self.store.snapshots, min(limit, 500)).collect()[::-1]

        def probe(snapshot: Row) -> bool:
            with tempfile.TemporaryDirectory(prefix="tessera-probe-") as folder:
                for r in self.store.contents(snapshot.tree).toLocalIterator():
                    put(os.path.join(folder, r.path), r.content, r.mode)
                for name in self.config.bisect_link:
                    source = os.path.join(self.root, name)
                    if os.path.exists(source) and not os.path.lexists(os.path.join(folder, name)):
                        os.symlink(source, os.path.join(folder, name))
                return command(folder) if callable(command) else B.command_probe(command, folder, timeout_s)

        found = B.bisect(chain, probe, on_step)
        if found.first_bad is not None:
            found.changed = self.changed(found.first_bad.id).limit(B.CHANGED).collect()
        return found

    def prune(self, older_than: str, keep_labeled: bool = False) -> tuple[int, int]:
        return self.store.prune(time.time() - parse_duration(older_than) / 1000, keep_labeled)

    @property
    def _mark(self) -> Mark:
        return Mark(os.path.join(self.state, "watch.pid"))

    def status(self) -> dict[str, Any]:
        tip = self.store.tip()
        return {"snapshots": self.store.snapshots.count(), "size_kib": self.store.size_kib(), "latest": tip.seq if tip else None, "watching": self._mark.pid()}

    def watch(self, events: DataFrame | None = None, quiet: str | None = None, on_error: Callable[[Exception], None] | None = None) -> Watching:
        """Snapshot after every burst of changes below the root, or of a stream of events (repo, path, op, ts); the index follows if configured."""
        from tessera.streaming import watch as W
        from tessera.streaming.changes import changes

        if (pid := self._mark.pid()) is not None:
            raise RuntimeError(f"already watched by process {pid}")
        config, mark = self.config, self._mark
        delay = "10 seconds" if events is not None else "0 seconds"  # a listing gives its events in order
        heeded = W.watched(changes(self.spark, self.root, self.store.repo) if events is None else events, config.watch_ignore)
        bursts = W.debounced(heeded, quiet or f"{config.debounce_ms} milliseconds", delay)
        refresh = (lambda _: self.index()) if config.index_on_watch else None
        mark.set()
        try:
            query = W.watch(bursts, lambda batch, _: self.snap("", "watch") is not None, os.path.join(self.state, "watch", uuid.uuid4().hex), refresh, on_error, each=mark.renew)
        except Exception:
            mark.clear()
            raise
        return Watching(self, query)


@dataclass
class Watching:
    """A running watch."""

    workspace: Workspace
    query: StreamingQuery

    def flush(self) -> Row | None:
        """Snapshot now, without waiting for a quiet time."""
        return self.workspace.snap("", "watch")

    def close(self) -> None:
        self.query.stop()
        self.workspace._mark.clear()
