"""Filing documents as tables.

``binaryFile`` finds and prunes the files on any storage Spark knows; decoding runs on
Arrow batches, a whole file at a time, and a file that can't be read gives a row in
``error`` (``mode="permissive"``) or ends the job (``"failfast"``). The same decoders
are Python data sources, for folders that all executors see under one path:
``register(spark)``, then ``spark.read.format("ledgerloom_xlsx").load(path)``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ledgerloom.functions.exprs import filename_meta, or_fallback
from ledgerloom.sources import pdf, xbrl, xlsx

CELLS = "sheet_idx int, sheet_name string, row_idx int, col_idx int, text string"
FACTS = "entry string, seq int, concept string, value double, unit string, period string, decimals string, raw_text string, is_numeric boolean"
ELEMENTS = "page int, width double, height double, seq int, text string, font_name string, font_size double, x1 double, y1 double, x2 double, y2 double"
META = "title string, author string, creator string, producer string, pages int"


def _cells(content: bytes) -> Iterator[tuple]:
    yield from xlsx.read_cells(content)


def _facts(content: bytes) -> Iterator[tuple]:
    for seq, (entry, f, error) in enumerate(xbrl.read_facts(content)):
        if f is not None:
            yield entry, seq, f["concept"], f["value"], f["unit"], f["period"], f["decimals"], f["raw_text"], f["is_numeric"]
        else:
            yield (entry, seq, None, None, None, None, None, None, None, error)


def _elements(content: bytes) -> Iterator[tuple]:
    for page, width, height, elements in pdf.read_pages(content):
        for seq, e in enumerate(elements):
            yield page, width, height, seq, e["text"], e["font_name"], e["font_size"], e["x1"], e["y1"], e["x2"], e["y2"]


def _meta(content: bytes) -> Iterator[tuple]:
    m = pdf.read_meta(content)
    yield m["title"], m["author"], m["creator"], m["producer"], m["pages"]


DECODERS: dict[str, tuple[Callable[[bytes], Iterator[tuple]], str]] = {"xlsx": (_cells, CELLS), "xbrl": (_facts, FACTS), "pdf": (_elements, ELEMENTS), "pdf_meta": (_meta, META)}
_ARROW = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def decode(files: DataFrame, kind: str, mode: str = "permissive", path: str = "path", content: str = "content") -> DataFrame:
    """Rows of the decoder ``kind`` for every (path, content), with ``path`` and ``error``."""
    decoder, schema = DECODERS[kind]
    fields = [f.split(" ") for f in schema.split(", ")]
    types = [pa.string(), *(_ARROW[t] for _, t in fields), pa.string()]
    names = ["path", *(n for n, _ in fields), "error"]
    width = len(fields)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                done: list[tuple] = []
                try:
                    for r in decoder(x or b""):
                        done.append((p, *r, None) if len(r) == width else (p, *r))
                except Exception as e:
                    if mode == "failfast":
                        raise ValueError(f"{p}: {e}") from e
                    # a sheet or page that fails fails its file
                    done = [(p, *[None] * width, str(e) or type(e).__name__)]
                rows = done
                for at in range(0, len(rows), 10_000):
                    yield batch(rows[at : at + 10_000])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, f"path string, {schema}, error string")


def scan(spark: SparkSession, paths: str | list[str], kind: str, mode: str = "permissive") -> DataFrame:
    """Decoded rows of the files under ``paths`` with the kind's extension."""
    ext = {"xlsx": "*.[xX][lL][sS][xX]", "xbrl": "*.[zZ][iI][pP]"}.get(kind, "*.[pP][dD][fF]")
    files = spark.read.format("binaryFile").option("pathGlobFilter", ext).option("recursiveFileLookup", "true").load(paths)
    return decode(files, kind, mode)


def with_meta(rows: DataFrame, xlsx_names: bool = True, ticker: str = "", year: int = 0, period: str = "") -> DataFrame:
    """``ticker``, ``year`` and ``period`` from the file's name, else the given ones."""
    m = filename_meta(F.col("path"), xlsx_names)
    return rows.withColumns({f"meta_{k}": or_fallback(m[k], F.lit(v), unset) for k, v, unset in (("ticker", ticker, ""), ("year", year, 0), ("period", period, ""))})


#: Bytes of files that a partition of a data source reads together.
PARTITION_BYTES = 64_000_000


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.path, self.mode = kind, options.get("path", ""), options.get("mode", "permissive")

    def partitions(self) -> list[InputPartition]:
        """Files in order, small ones packed together."""
        found = sorted(p for g in glob.glob(self.path) for p in ([os.path.join(d, f) for d, _, fs in os.walk(g) for f in fs] if os.path.isdir(g) else [g]))
        out: list[list[str]] = []
        room = 0
        for p in found:
            size = os.path.getsize(p)
            if not out or size > room:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append(p)
            room -= size
        return [_Files(p) for p in out]

    def read(self, partition: _Files) -> Iterator[tuple]:
        decoder, schema = DECODERS[self.kind]
        width = schema.count(",") + 1
        for path in getattr(partition, "paths", ()):
            try:
                with open(path, "rb") as f:
                    rows = [(path, *r, None) if len(r) == width else (path, *r) for r in decoder(f.read())]
            except Exception as e:
                if self.mode == "failfast":
                    raise
                rows = [(path, *[None] * width, str(e) or type(e).__name__)]
            yield from rows


def _source(kind: str) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"ledgerloom_{kind}"

        def schema(self) -> str:
            return f"path string, {DECODERS[kind][1]}, error string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader(kind, dict(self.options))

    return Source


def register(spark: SparkSession) -> None:
    """Make every decoder a data source of the session."""
    for kind in DECODERS:
        spark.dataSource.register(_source(kind))
