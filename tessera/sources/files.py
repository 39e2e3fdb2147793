"""Source files and the small text files beside them: ignore rules, configuration, feature names, path aliases.

A corpus that is already a table needs only (path, text); scan_folder is for trees of files on storage that driver
and executors share.  Spark's own file readers leave out names that begin with an underscore (so __init__.py), so
paths are listed on the driver (through the Hadoop file system where storage isn't local) and contents are read in the
tasks, as bytes.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources.staging import ship

STATE_FOLDER = ".tessera"
# fixed values: folders that a watcher ignores unless told otherwise
WATCH_IGNORE = ["**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.next/**", "**/target/**", "**/__pycache__/**", "**/.venv/**", "**/venv/**", "**/coverage/**", f"**/{STATE_FOLDER}/**"]


@dataclass
class Config:
    version: int = 1
    allow_agent_restore: bool = False
    debounce_ms: int = 500
    watch_ignore: list[str] = field(default_factory=lambda: list(WATCH_IGNORE))
    bisect_link: list[str] = field(default_factory=lambda: ["node_modules", ".venv", "venv"])
    index_on_watch: bool = True


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.title() for p in rest)


def load_config(path: str) -> Config:
    """Defaults overlaid by the file's keys (camelCase); a missing or malformed file is the defaults."""
    try:
        with open(path, encoding="utf-8") as f:
            got = json.load(f)
        return Config(**{f.name: got[_camel(f.name)] for f in fields(Config) if _camel(f.name) in got})
    except (OSError, ValueError, TypeError):
        return Config()


def save_config(path: str, config: Config) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({_camel(k): v for k, v in asdict(config).items()}, f, indent=2, ensure_ascii=False)
        f.write("\n")


def load_features(path: str) -> dict[str, dict[str, list[str]]]:
    """name -> paths and aliases; a bare list is paths; what can't be read is no features."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            got = yaml.safe_load(f)
    except (OSError, yaml.YAMLError):
        return {}
    strings = lambda v: [str(x) for x in v] if isinstance(v, list) else []
    out = {}
    for name, value in got.items() if isinstance(got, dict) else ():
        if isinstance(value, list):
            out[str(name)] = {"paths": strings(value), "aliases": []}
        elif isinstance(value, dict):
            out[str(name)] = {"paths": strings(value.get("paths")), "aliases": strings(value.get("aliases"))}
    return out


def save_features(path: str, features: dict[str, dict[str, list[str]]]) -> None:
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("# feature name -> the globs it lives in, and other words for it (aliases)\n")
        yaml.safe_dump(features, f, allow_unicode=True, sort_keys=False)


def add_feature(features: dict, name: str, paths: list[str], aliases: list[str] | None = None) -> dict:
    """A copy with the feature's paths and aliases extended, without repeats, in order."""
    old = features.get(name, {})
    join = lambda a, b: list(dict.fromkeys([*(a or []), *(b or [])]))
    return features | {name: {"paths": join(old.get("paths"), paths), "aliases": join(old.get("aliases"), aliases)}}


def remove_feature(features: dict, name: str) -> dict:
    if name not in features:
        raise KeyError(name)
    return {k: v for k, v in features.items() if k != name}


def ignore_patterns(text: str) -> list[str]:
    """The lines of an ignore file without blanks and comments."""
    return [s for line in text.splitlines() if (s := line.strip()) and s[0] != "#"]


def ignored(path, patterns: list[str]):
    """Whether a root-relative path (a Column) falls under ignore-file patterns; the last that applies decides."""
    out = F.lit(False)
    for p in patterns:
        negated, p = p.startswith("!"), p.removeprefix("!")
        anchored = "/" in p.rstrip("/")
        body = T.glob_pattern(p.strip("/"))[1:-1]
        below = "/.*" if p.endswith("/") else "(?:/.*)?"
        out = F.when(path.rlike(f"^{'' if anchored else '(?:.*/)?'}{body}{below}$"), not negated).otherwise(out)
    return out


def source_files(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """files(path, ...) that hold code to index, with lang; no declaration files, nothing that a glob ignores."""
    lang = T.language(F.col("path"))
    out = files.withColumn("lang", lang).where(F.col("lang").isNotNull() & ~T.is_declaration_file(F.col("path")))
    return out.where(~T.matches_any(F.col("path"), ignore)) if ignore else out


# modes of files as a version keeps them
PLAIN, EXECUTABLE, LINK = "100644", "100755", "120000"


def _listed(spark: SparkSession, root: str) -> Iterator[tuple[str, str, int, str]]:
    """Path below the root, whole path, size and mode of every file; links are listed as such and not followed."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri()
    if base.getScheme() == "file":
        yield from _listed_here(base.getPath().rstrip("/"))
        return
    below = len(base.getPath().rstrip("/")) + 1
    walk = fs.listFiles(top, True)
    while walk.hasNext():
        status = walk.next()
        whole = status.getPath().toUri()
        yield whole.getPath()[below:], whole.toString(), status.getLen(), EXECUTABLE if status.getPermission().toShort() & 0o100 else PLAIN


def _listed_here(base: str) -> Iterator[tuple[str, str, int, str]]:
    for folder, folders, names in os.walk(base):
        for name in [*names, *(f for f in folders if os.path.islink(os.path.join(folder, f)))]:
            whole = os.path.join(folder, name)
            try:
                found = os.lstat(whole)
            except FileNotFoundError:
                continue
            if stat.S_ISLNK(found.st_mode) or stat.S_ISREG(found.st_mode):
                mode = LINK if stat.S_ISLNK(found.st_mode) else EXECUTABLE if found.st_mode & 0o100 else PLAIN
                yield os.path.relpath(whole, base), whole, found.st_size, mode


def _content(where: str, mode: str) -> bytes | None:
    """The bytes of a file, or the target of a link; None if it is gone since the listing."""
    from pyarrow import fs

    try:
        if mode == LINK:
            return os.fsencode(os.readlink(where))
        if where.startswith("/"):
            with open(where, "rb") as f:
                return f.read()
        system, name = fs.FileSystem.from_uri(where)
        with system.open_input_stream(name) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, where, mode in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (content := _content(where, mode)) is not None:
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "content": pa.array([content], pa.binary()), "mode": pa.array([mode])})


def _as_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [c.decode("utf-8", "replace") for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "text"])


def scan_bytes(spark: SparkSession, root: str, ignore: list[str] | None = None, code_only: bool = False, bytes_each: int = 64 << 20) -> DataFrame:
    """(path, content, mode) of a tree of files, byte for byte; paths are filtered before any file is opened."""
    ship(spark)
    found = sorted(_listed(spark, root))
    paths = spark.createDataFrame([(p, u, m) for p, u, _, m in found], "path string, uri string, mode string")
    paths = paths.where(~F.col("path").rlike(r"^\.git(/|$)"))
    if code_only:
        paths = source_files(paths).drop("lang").where(F.col("mode") != LINK)
    if ignore:
        paths = paths.where(~ignored(F.col("path"), ignore))
    parts = max(1, min(len(found), sum(n for _, _, n, _ in found) // bytes_each + 1))
    return paths.repartition(parts, "path").mapInArrow(_read_all, "path string, content binary, mode string")


def scan_folder(spark: SparkSession, root: str, ignore: list[str] | None = None, code_only: bool = True) -> DataFrame:
    """(path, text) of a tree of files, for reading and parsing: bytes that aren't UTF-8 are replaced."""
    return scan_bytes(spark, root, ignore, code_only).mapInArrow(_as_text, "path string, text string")


def read_text(root: str, name: str) -> str:
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return f.read()
    except OSError:
        return ""


def tsconfig_aliases(root: str):
    from tessera.operators.resolve import parse_aliases

    return parse_aliases(read_text(root, "tsconfig.json"))


def safe_name(text: str) -> str:
    return re.sub(r"\W+", "-", text)
