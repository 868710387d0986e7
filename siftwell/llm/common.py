"""Shared folders, lineage cuts and small helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell import prepare

_made: list[tuple[SparkSession, str]] = []
#: Environment of the Python workers.  Workers are used again from stage to stage; what Arrow and numpy free goes back to the system,
#: so that a worker doesn't hold the largest size it ever had.  Pieces up to 16 MB stay for the next array: numpy's temporaries
#: would else be mapped, cleared and unmapped each time.
RECORDS, RECORDS_CONF = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of a row group of files that workers write.
GROUP_BYTES = 8 << 20
BYTES, BYTES_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
LEAN = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def lean(spark: SparkSession) -> SparkSession:
    """Workers find this package and give memory back, and get whole texts in batches of ``RECORDS`` rows and about ``BYTES`` bytes unless the session asks for fewer."""
    env = prepare(spark).sparkContext.environment
    for name, value in LEAN.items():
        env.setdefault(name, value)
    if not 0 < int(spark.conf.get(RECORDS_CONF)) <= RECORDS:
        spark.conf.set(RECORDS_CONF, str(RECORDS))
    spark.conf.set(BYTES_CONF, str(min(BYTES, int(spark.conf.get(BYTES_CONF).rstrip("bB")))))
    return spark


_kept: dict = {}  # in a worker: the one table that outlives a task


def kept(key: tuple, make):
    """The worker's table of that key, made at need; it depends on the key only.  A worker keeps one table."""
    if key not in _kept:
        forget(key)
        _kept[key] = make()
    return _kept[key]


def forget(but: tuple | None = None) -> None:
    """Drop the worker's table, unless it is that one, and let freed memory go back to the system."""
    if _kept and but not in _kept:
        _kept.clear()
        gc.collect()
        trim()


def trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such function
        pass


def tidied(keeps: tuple | None = None):
    """For a function on Arrow batches: a table of other operators goes first, and memory that it frees doesn't stay with the worker.

    With ``keeps``, the key of a table, Python's collector rests meanwhile: walking the table costs more than all else, and it holds no cycles.
    """

    def wrap(run):
        def inner(batches, **more):
            forget(keeps)
            if keeps:
                gc.disable()
            try:
                yield from run(batches, **more)
            finally:
                gc.enable()
                trim()

        return inner

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return lean(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the driver ends.

    Without ``spark.checkpoint.dir`` a temporary folder does in local mode; elsewhere executors would not see it, and that is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:" + tempfile.mkdtemp(prefix="siftwell-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/siftwell/{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended, or the folder went with it
            return


def within_reach(uri: str) -> bool:
    """Whether workers can open a folder's file system themselves, or only Spark can."""
    try:
        filesystem(uri)
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def write_parts(df: DataFrame, path: str, run=None, ddl: str | None = None) -> set[str] | None:
    """Write rows as Parquet below ``path``; with ``run``, a function on Arrow batches, what it makes of them, by the schema ``ddl``.

    The Python workers write the files themselves, in the task that has the rows: one worker a task also with ``run``, and the JVM starts no
    process for a file's mode.  Result: the names of the files of the tasks that count, one a task.  Where only Spark reaches the
    folder, it appends the files, and there is no result.
    """
    if not within_reach(path):
        (df.mapInArrow(run, ddl) if run else df).write.mode("append").option("compression", "zstd").parquet(path)
        return None
    arrow = to_arrow_schema(T._parse_datatype_string(ddl) if ddl else df.schema)

    def write(batches):
        name, held, size = f"part-{uuid.uuid4().hex}.parquet", [], 0
        out = None
        for b in run(batches) if run else batches:
            if b.num_rows:
                held.append(b.cast(arrow) if b.schema != arrow else b)
                size += b.nbytes
            if size >= GROUP_BYTES:
                out = out or Parts(f"{path}/{name}", arrow)
                out.add(held)
                held, size = [], 0
        if held:
            out = out or Parts(f"{path}/{name}", arrow)
            out.add(held)
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"name": [name] if out else []}, pa.schema([("name", pa.string())]))

    return {r[0] for r in df.mapInArrow(write, "name string").collect()}


def materialise(df: DataFrame, label: str, run=None, ddl: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, as ``write_parts``, and read back.

    A file that no finished task returned, as a lost executor leaves it, goes before the folder is read.
    """
    spark, path = lean(df.sparkSession), work_dir(df.sparkSession, label)
    schema = T._parse_datatype_string(ddl) if ddl else df.schema
    names = write_parts(df, path, run, ddl)
    if names is None:
        return spark.read.schema(schema).parquet(path)
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    while True:
        for f in fs.get_file_info(pafs.FileSelector(folder)):
            if f.base_name not in names:
                fs.delete_file(f.path)
        back = spark.read.schema(schema).parquet(path)
        if {f.rsplit("/", 1)[-1] for f in back.inputFiles()} == names:
            return back


class Parts:
    """A Parquet file in the making, seen under its name when it is whole."""

    def __init__(self, uri: str, schema: pa.Schema):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        # Spark takes files that begin with an underscore for no data.
        self.part = f"{os.path.dirname(self.path)}/_{os.path.basename(self.path)}"
        self.writer = pq.ParquetWriter(self.part, schema, filesystem=self.fs, compression="zstd")

    def add(self, batches: list[pa.RecordBatch]) -> None:
        self.writer.write_table(pa.Table.from_batches(batches))

    def close(self) -> None:
        self.writer.close()
        self.fs.move(self.part, self.path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path for a Spark-style uri (``file:/x`` included)."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def put(uri: str, data: bytes) -> None:
    """Write one whole file; a half-written file is never seen under its name."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema for a flat DDL of long, int, double, boolean, string, binary."""
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def rows_batch(ddl_schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, ddl_schema, strict=True)], schema=ddl_schema)


def slices(batches, column: str = "text", most_bytes: int = 16 << 20):
    """Cut Arrow batches so that no piece holds much more than ``most_bytes`` of one column."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = max(1, batch.column(batch.schema.get_field_index(column)).nbytes // n)
        step = max(1, most_bytes // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch, null as empty."""
    return [x if x is not None else "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def strings_of(batch: pa.RecordBatch, column: str = "text") -> pa.StringArray:
    """The same as an Arrow array."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.string())


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id long, text string); other columns, whatever their names, stay out."""
    lean(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def default_parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


__all__ = ["F", "T", "arrow_schema", "default_parallelism", "filesystem", "free_name", "get", "id_text", "materialise", "put", "rows_batch", "slices", "strings_of", "table", "texts_of", "work_dir"]


#: Bytes of a file that is worth one of its own.
FILE_BYTES = 128 << 20


def few_files(result: DataFrame, source: DataFrame) -> DataFrame:
    """The result in partitions of ``FILE_BYTES`` of its source or two a core, whichever are more, for writing without small files.

    Every file costs the one who writes it a handful of calls and, on a local disk, processes.  Large tables are read in partitions of that
    size, and stay as they are.
    """
    cores = source.sparkSession.sparkContext.defaultParallelism
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return result.coalesce(max(2 * cores, min(1 << 20, -(-size // FILE_BYTES))))


def filter_rows(docs: DataFrame, keep, text_col: str = "text") -> DataFrame:
    """Rows for whose texts ``keep()(strings)`` gives true, with all their columns.

    ``keep`` is called once a task and returns the function to use on batches.
    """
    lean(docs.sparkSession)

    @tidied()
    def run(batches):
        judge = keep()
        for b in slices(batches, text_col, 8 << 20):
            yield b.filter(pa.array(judge(strings_of(b, text_col)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
