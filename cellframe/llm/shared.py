"""Plumbing that the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes per Arrow batch: a batch of long texts holds few of them, one of numbers many.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of this session by their bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only where nothing is set (a local session, as in tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        named = current.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    if not current.isDefined():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


class Scratch:
    """Tables of one operator in the shared folder: written once, read as often as needed, and
    deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read from there; what follows starts at its files."""
        path = self.paths[name] = shared_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written to the table ``name`` beside what was added before; all of it read from there."""
        path = self.paths.setdefault(name, shared_path(self.spark, name))
        df.write.option("compression", "zstd").mode("append").parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Has the shuffles of finished jobs deleted, as soon as the driver's JVM finds them unused.

        The scheduler holds on to its last job until another one ends, hence the job of one row.
        """
        gc.collect()
        self.spark.range(1).write.format("noop").mode("overwrite").save()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Deletes tables."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there: smaller than a
    checkpoint where columns repeat."""
    return Scratch(df.sparkSession).write(df, name)


def free_name(wanted: str, df: DataFrame) -> str:
    """A column name like ``wanted`` that ``df`` doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` whose columns that have one of ``names`` (in any case) are renamed out of an operator's
    way, and a function that gives them back and leaves all other columns out."""
    names = {x.lower() for x in names}
    renamed: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in names:
            docs_now = docs.withColumnsRenamed(renamed)
            renamed[c] = free_name(f"own_{c}", docs_now)
    return docs.withColumnsRenamed(renamed), lambda out: out.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in docs.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[], Callable[[pa.RecordBatch], list]],
) -> DataFrame:
    """``df`` with columns computed in Python from Arrow batches.

    ``compute()`` runs once per task and returns a function from a batch to one list or Arrow
    array for each of ``fields``. A column of ``df`` that has the name of a new one (in any
    case) is replaced, as withColumn does.
    """
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in keep]
    schema = T.StructType(keep + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = compute()
        for b in batches:
            made = f(b)
            cols = [b.column(b.schema.get_field_index(n)) for n in names]
            for value, field in zip(made, list(arrow)[len(names) :], strict=True):
                cols.append(value if isinstance(value, pa.Array) else pa.array(value, type=field.type))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *(x.name for x in fields)])

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def whole_text(name: str = "text"):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string, which that engine has no function for."""
    steps = "list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {codes}), lambda c, b: {steps}), 4294967295::UBIGINT)"
