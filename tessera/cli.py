"""The command line over Workspace: python -m tessera.cli [--root FOLDER] COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.api import Workspace
from tessera.functions import render
from tessera.functions.display import parse_duration
from tessera.operators import bisect as B


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    top.add_argument("--root", default=os.getcwd(), help="the source tree, on storage that the executors share")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, says: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=says, description=says)

    add("init", "write the configuration and build the index")
    p = add("watch", "snapshot whenever writing ends")
    p.add_argument("-d", "--debounce", help="milliseconds of quiet that end a burst")
    add("snap", "snapshot now").add_argument("-m", "--message", default="")
    p = add("log", "list snapshots, newest first")
    p.add_argument("-s", "--since", help="for instance 30m, 2h, 7d")
    p.add_argument("--source", help="watch, agent, manual or pre-restore")
    p.add_argument("-f", "--file", help="only those that touch this file")
    p.add_argument("-n", "--limit", type=int, default=30)
    p = add("diff", "compare two snapshots, or one with the files as they are")
    p.add_argument("start")
    p.add_argument("end", nargs="?")
    p.add_argument("--stat", action="store_true", help="the summary only")
    p.add_argument("-p", "--paths", nargs="+")
    p = add("restore", "bring files back to a snapshot; what is there now is recorded first")
    p.add_argument("ref")
    p.add_argument("-f", "--files", nargs="+")
    p.add_argument("-n", "--dry-run", action="store_true")
    p = add("bisect", "find the first snapshot for which a command fails")
    p.add_argument("-n", "--limit", type=int, default=B.LIMIT)
    p.add_argument("-t", "--timeout", type=float, default=300)
    p.add_argument("probe", nargs=argparse.REMAINDER, help="-- and the command")
    add("status", "the watch, the number of snapshots and their size")
    p = add("prune", "remove old snapshots")
    p.add_argument("--older-than", required=True)
    p.add_argument("--keep-labeled", action="store_true", help="keep those taken by hand")
    p = add("index", "build or refresh the index")
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("-s", "--stats", action="store_true")
    p = add("find", "find where a feature is")
    p.add_argument("query", nargs="+")
    p.add_argument("-n", "--limit", type=int, default=10)
    p.add_argument("-k", "--kind")
    add("outline", "the signatures of a file").add_argument("file")
    p = add("map", "a map of the tree in a budget of tokens")
    p.add_argument("-b", "--budget", type=int, default=2000)
    p.add_argument("-p", "--private", action="store_true")
    p = add("feature", "list, add, rm or suggest features")
    p.add_argument("action", choices=["list", "add", "rm", "suggest"])
    p.add_argument("name", nargs="?")
    p.add_argument("paths", nargs="*")
    p.add_argument("-a", "--alias", nargs="+")
    return top


def run(w: Workspace, a: argparse.Namespace) -> str:
    """What a command prints."""
    if a.command == "init" or a.command == "index":
        built = w.init() if a.command == "init" else w.index(a.force)
        said = f"{built.parsed} parsed, {built.reused} reused, {built.removed} removed, {built.symbols} symbols, {built.elapsed_ms} ms"
        if a.command == "index" and a.stats:
            for rows in w.index_stats():
                said += "\n\n" + "\n".join(f"{r[1]:>8}  {r[0]}" if isinstance(r[1], int) else f"{r[1]:>8.4f}  {r[0]}" for r in rows.collect())
        return said
    if a.command == "watch":
        watching = w.watch(quiet=f"{a.debounce} milliseconds" if a.debounce else None)
        try:
            watching.query.awaitTermination()
        except KeyboardInterrupt:
            watching.flush()
        finally:
            watching.close()
        return ""
    if a.command == "snap":
        made = w.snap(a.message)
        return f"{made.short} {made.label}".rstrip() if made else "nothing has changed"
    if a.command == "log":
        since = (time.time() * 1000 - parse_duration(a.since)) if a.since else None
        return render.lines(w.log(a.limit, since, a.source, a.file), render.log_row(F.lit(int(time.time()))))
    if a.command == "diff":
        rows = w.diff(a.start, a.end, a.paths, a.stat)
        return render.lines(rows, render.change()) if a.stat else render.lines(rows, F.col("patch"))
    if a.command == "restore":
        done = w.restore(a.ref, a.files, a.dry_run)
        listed = "\n".join(f"{r.action:6} {r.path}" for r in done.plan)
        return "nothing to do" if done.noop else listed if a.dry_run else f"{listed}\nundo: restore {done.pre_restore[:8]}"
    if a.command == "bisect":
        command = a.probe[1:] if a.probe[:1] == ["--"] else a.probe
        return render.bisected(w.bisect(command, a.limit, a.timeout, lambda s, good, k, n: print(f"  {k}: {s.short} {'passes' if good else 'fails'}", file=sys.stderr)))
    if a.command == "status":
        return render.status(w.status())
    if a.command == "prune":
        return "{} removed, {} kept".format(*w.prune(a.older_than, a.keep_labeled))
    if a.command == "find":
        return w.find_text(" ".join(a.query), a.limit, a.kind) or "nothing found"
    if a.command == "outline":
        found = w.outline_text(a.file)
        return "no such file in the index" if found is None else found
    if a.command == "map":
        return w.repo_map(a.budget, a.private)
    if a.action == "add":
        w.feature_add(a.name, a.paths, a.alias)
    elif a.action == "rm":
        w.feature_rm(a.name)
    elif a.action == "suggest":
        return "\n".join(f"{r.name}: {r.glob}" for r in w.feature_suggest().collect())
    return "\n".join(f"{n}: {', '.join(p)}" + (f" (also {', '.join(also)})" if also else "") for n, p, also in w.feature_list())


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        print(run(Workspace(spark, os.path.abspath(a.root)), a))
        return 0
    except (LookupError, ValueError, RuntimeError) as e:
        print(f"tessera: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
