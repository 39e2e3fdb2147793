"""Scanners of source text: pure Python per file, applied by mapInArrow to the rows that changed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.staging import ship

SYMBOL = "ord int, name string, kind string, start_line int, end_line int, exported boolean, signature string, doc string, parent string, strings array<string>"


@dataclass
class Symbol:
    name: str
    kind: str
    start_line: int
    end_line: int
    exported: bool
    signature: str
    doc: str | None = None
    parent: str | None = None
    strings: list[str] | None = None


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    specifiers: list[str] = field(default_factory=list)


def parse(path: str, text: str, lang: str) -> Parsed:
    from tessera.parsers import python_source, script_source

    return python_source.parse(text) if lang == "py" else script_source.parse(path, text)


def parse_files(files: DataFrame) -> DataFrame:
    """files(path, lang, hash, text) to (path, lang, hash, symbols, specifiers), in batches, without a shuffle."""
    row = pa.struct([("ord", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("exported", pa.bool_()), ("signature", pa.string()), ("doc", pa.string()), ("parent", pa.string()), ("strings", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                paths, langs, texts = (part.column(k).to_pylist() for k in (0, 1, 3))
                got = [parse(p, t or "", g) for p, g, t in zip(paths, langs, texts)]
                symbols = [[{"ord": k, **asdict(s)} for k, s in enumerate(g.symbols)] for g in got]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(symbols, pa.list_(row)), pa.array([g.specifiers for g in got], pa.list_(pa.string()))], ["path", "lang", "hash", "symbols", "specifiers"])

    ship(files.sparkSession)
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in SYMBOL.split(","))
    return files.select("path", "lang", "hash", F.col("text")).mapInArrow(run, f"path string, lang string, hash string, symbols array<struct<{fields}>>, specifiers array<string>")


# --- what both scanners share; lengths are in UTF-16 units

SPACES = "\\s\ufeff"


def units(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def one_line(text: str, limit: int = 200) -> str:
    flat = " ".join(text.replace("\ufeff", " ").split())
    return flat if units(flat) <= limit else flat[: limit - 1] + "…"


def useful(text: str) -> bool:
    return 3 <= units(text) <= 80 and any(c.isascii() and c.isalpha() for c in text) and bool(text.strip("./"))
