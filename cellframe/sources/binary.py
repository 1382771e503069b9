"""Headerless row-major binaries as a data source: partitions are byte ranges of whole raster rows.

Conditions on row and col reach the source: rows outside aren't opened, and of a narrow window only
its columns' bytes are read. Files are opened where the partition runs, by any file system that
Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "file string, row int, col int, v double"
#: Bytes of a partition and of one read.
SPLIT, READ = 32 << 20, 4 << 20
#: A window narrower than this part of a row is read row by row.
NARROW = 1 / 4


@dataclass
class Rows(InputPartition):
    """Rows first to last (not included) of a file."""

    path: str
    first: int
    last: int


class FixedWidth(DataSource):
    """spark.read.format("fixed_width"); options rows, cols and dtype (a NumPy type with byte order).
    The path is a file, or a folder of files of one shape."""

    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FixedWidthReader:
        return FixedWidthReader(dict(self.options))


class FixedWidthReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.dtype = options["path"], options.get("dtype", "<f4")
        self.rows, self.cols = int(options["rows"]), int(options["cols"])
        self.bounds = {"row": [0, self.rows], "col": [0, self.cols]}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of row and col with numbers; what it can't use goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            value = getattr(f, "value", None)
            if name not in self.bounds or not isinstance(value, int):
                yield f
                continue
            low, high = self.bounds[name]
            match f:
                case EqualTo():
                    low, high = max(low, value), min(high, value + 1)
                case GreaterThan():
                    low = max(low, value + 1)
                case GreaterThanOrEqual():
                    low = max(low, value)
                case LessThan():
                    high = min(high, value)
                case LessThanOrEqual():
                    high = min(high, value + 1)
                case _:
                    yield f
            self.bounds[name] = [low, high]

    def partitions(self) -> list[Rows]:
        import numpy as np
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(self.path)
        top = place.get_file_info(root)
        files = [top] if top.is_file else [x for x in place.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(("_", "."))]
        width = self.cols * np.dtype(self.dtype).itemsize
        prefix = self.path[: len(self.path) - len(root.rstrip("/"))] if self.path.rstrip("/").endswith(root.rstrip("/")) else ""
        out, (low, high) = [], self.bounds["row"]
        step = max(1, SPLIT // width)
        for f in sorted(files, key=lambda x: x.path):
            if f.size != self.rows * width:
                raise ValueError(f"{f.path} does not hold {self.rows} rows of {self.cols} cells")
            out += [Rows(prefix + f.path, r, min(r + step, high)) for r in range(low, high, step)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        (c0, c1), kind = self.bounds["col"], np.dtype(self.dtype)
        if partition.first >= partition.last or c0 >= c1:
            return
        place, path = fs.FileSystem.from_uri(partition.path)
        name, width, n = path.rpartition("/")[2], self.cols * kind.itemsize, c1 - c0
        narrow = n < self.cols * NARROW
        step = max(1, READ // (n * kind.itemsize if narrow else width))
        with place.open_input_file(path) as f:
            for r in range(partition.first, partition.last, step):
                many = min(step, partition.last - r)
                if narrow:
                    raw = b"".join(f.read_at(n * kind.itemsize, (r + k) * width + c0 * kind.itemsize) for k in range(many))
                    v = np.frombuffer(raw, kind).reshape(many, n)
                else:
                    v = np.frombuffer(f.read_at(many * width, r * width), kind).reshape(many, self.cols)[:, c0:c1]
                v = v.astype(np.float64).ravel()
                there = np.isfinite(v)
                rows, cols = np.repeat(np.arange(r, r + many, dtype=np.int32), n), np.tile(np.arange(c0, c1, dtype=np.int32), many)
                files = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(v), np.int32)), pa.array([name])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([files, pa.array(rows), pa.array(cols), pa.array(v, mask=~there)], names=["file", "row", "col", "v"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FixedWidth)
