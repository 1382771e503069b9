"""Layers from Parquet and from headerless binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.sources import binary

TILE = 128
#: Bytes of lines that a task packs at once.
PACKED = 4 << 20


def scan_layer(spark: SparkSession, path: str, site: str | None = None, products: list[str] | None = None, leaves: list[str] | None = None) -> DataFrame:
    """Cells of some layers: site and product prune folders, leaves reach the scan's filters."""
    out = spark.read.parquet(path)
    for column, wanted in (("site", [site] if site else None), ("product", products), ("leaf", leaves)):
        if wanted:
            out = out.filter(F.col(column).isin(*wanted))
    return out


def scan_fixed_width(spark: SparkSession, path: str, rows: int, cols: int, dtype: str = "<f4", r0: int = 0, c0: int = 0, nr: int | None = None, nc: int | None = None, with_file: bool = False) -> DataFrame:
    """Cells of a window of a row-major binary without header, or of each in a folder; only the
    window's bytes are read. A length that is not rows x cols is an error. NaN and infinities are missing."""
    binary.register(spark)
    r1, c1 = rows if nr is None else r0 + nr, cols if nc is None else c0 + nc
    out = spark.read.format("fixed_width").options(rows=rows, cols=cols, dtype=dtype).load(path)
    out = out.filter((F.col("row") >= r0) & (F.col("row") < r1) & (F.col("col") >= c0) & (F.col("col") < c1))
    return out if with_file else out.drop("file")


def write_fixed_width(cells: DataFrame, path: str, name: Column, rows: int, cols: int, dtype: str = "<f4") -> None:
    """Dense binaries of (row, col, v), a file for each ``name``; cells that are absent or missing are
    NaN. Lines of a file are packed a few at a time and meet sorted in one task, which writes them as they come."""
    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    step = max(1, PACKED // (8 * cols))  # lines

    def pack(batches):
        for b in batches:
            for first in range(0, b.num_rows, step):
                some = b.slice(first, step)
                line, cell = some.column(2), some.column(2).flatten()
                r = np.repeat(np.arange(some.num_rows), np.diff(np.asarray(line.offsets)))
                c, v = (cell.field(k).to_numpy(zero_copy_only=False) for k in ("col", "v"))
                there = np.asarray(cell.field("v").is_valid())
                x = np.full((some.num_rows, cols), np.nan)
                x[r[there], c[there]] = v[there]
                made = [y.tobytes() for y in x.astype(dtype)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(made, pa.binary())], names=["file", "row", "line"])

    def store(batches):
        place, root = fs.FileSystem.from_uri(path)
        place.create_dir(root, recursive=True)
        out, now, at, done = None, None, 0, []
        empty = np.full(cols, np.nan).astype(dtype).tobytes()

        def close():
            nonlocal out
            if out is not None:
                out.write(empty * (rows - at))
                out.close()
                done.append(now)
            out = None

        for b in batches:
            for file, row, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != now:
                    close()
                    out, now, at = place.open_output_stream(f"{root}/{file}"), file, 0
                out.write(empty * (row - at) + line)
                at = row + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    lines = cells.groupBy(name.alias("file"), F.col("row").cast("int").alias("row")).agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.col("v").cast("double").alias("v"))).alias("line"))
    packed = lines.mapInArrow(pack, "file string, row int, line binary").repartition("file").sortWithinPartitions("file", "row")
    packed.mapInArrow(store, "file string").write.format("noop").mode("overwrite").save()


def reconcile_shape(catalogue: DataFrame) -> DataFrame:
    """Nearest shape, within 4 rows and 8 columns of the declared one, that divides a file's
    length: fixed_rows, fixed_cols and a note; null where none does. (bytes, rows, cols, itemsize)."""
    spec = ["bytes", "rows", "cols", "itemsize"]
    files = catalogue.select(*spec).distinct()
    samples = F.floor(F.col("bytes") / F.col("itemsize")).cast("long")
    tried = files.withColumn("_s", samples).withColumn("_r", F.explode(F.expr("sequence(greatest(1, rows - 4), rows + 4)")))
    c = F.floor(F.col("_s") / F.col("_r")).cast("int")
    fits = tried.filter((F.col("bytes") % F.col("itemsize") == 0) & (F.col("_s") % F.col("_r") == 0)).withColumn("_c", c).filter(F.abs(F.col("_c") - F.col("cols")) <= 8)
    drift = F.abs(F.col("_r") - F.col("rows")) + F.abs(F.col("_c") - F.col("cols"))
    best = fits.groupBy(*spec).agg(F.min_by(F.struct("_r", "_c"), F.struct(drift, F.col("_r"))).alias("_b"))
    note = F.when(F.col("_b").isNull(), "no shape divides the file").when((F.col("_b._r") == F.col("rows")) & (F.col("_b._c") == F.col("cols")), "as declared").otherwise("corrected")
    return catalogue.join(best, spec, "left").withColumns({"fixed_rows": F.col("_b._r"), "fixed_cols": F.col("_b._c"), "note": note}).drop("_b")


def tile(row: Column, col: Column) -> Column:
    return F.struct(F.floor(row / TILE).cast("int").alias("row"), F.floor(col / TILE).cast("int").alias("col"))


def write_layer(cells: DataFrame, path: str, mode: str = "append") -> None:
    """Cells in files by site and product, sorted by layer and tile so that windows prune row groups."""
    tiles = {"tile_row": F.floor(F.col("row") / TILE).cast("int"), "tile_col": F.floor(F.col("col") / TILE).cast("int")}
    dealt = cells.withColumns(tiles).repartition("site", "product", "layer", "tile_row")
    dealt.sortWithinPartitions("site", "product", "layer", "tile_row", "tile_col", "row", "col").write.mode(mode).partitionBy("site", "product").parquet(path)


def content_key(grid: DataFrame) -> DataFrame:
    """Grids with the hash of their reference system, transform, shape and resolution."""
    return grid.withColumn("content_key", F.sha2(F.concat_ws("~", "epsg", "a", "b", "c", "d", "e", "f", "height", "width", "res"), 256))


def resume(plan: DataFrame, done: DataFrame) -> DataFrame:
    """The part of a plan whose (layer, content_key) isn't done."""
    return plan.join(done.select("layer", "content_key").distinct(), ["layer", "content_key"], "left_anti")
