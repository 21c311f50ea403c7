"""What the training-data operators share: tables, executors' code, durable cuts.

Nothing here or in the operators writes to a machine-local folder on a
cluster: what must outlive a task goes to ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import ctypes
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space that separates words: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
T = TypeVar("T")
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch: the JVM's writer may hold three times as much for each task, the worker again as much and its results.
BATCH_SIZE = 8 << 20
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"
#: Where stages of many kinds share executors: bytes of a batch, and rows that the reader decodes at a time (4096 texts are an array of 16 to 32 MB a task).
LEAN = {BATCH_BYTES: 4 << 20, READ_ROWS: 512}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of one test table; only Spark's reader touches the path."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on the executors, once a session.

    Python functions travel to the workers by reference. A worker that can't
    import the package finds it in a zip file that Spark hands out.
    """
    sc = spark.sparkContext
    mark = f"_lodestone_{sc.applicationId}"
    if getattr(sc, mark, False):
        return spark
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(top):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for here, _, files in os.walk(top):
                for f in sorted(files):
                    if f.endswith(".py"):
                        p = os.path.join(here, f)
                        z.write(p, os.path.join("lodestone", os.path.relpath(p, top)))
        # In the shared folder, from which every executor fetches it.
        name = f"{shared_folder(spark)}/lodestone-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        sc.addPyFile(name)
    # Very long texts come a few at a time; a bound that the user has set stays.
    if not sc.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(BATCH_SIZE))
    setattr(sc, mark, True)
    return spark


def lean(spark: SparkSession) -> None:
    """From now on texts are read and handed to Python a few at a time; a bound that the user has set stays, and so does a smaller one."""
    ship(spark)
    for key, most in LEAN.items():
        if not spark.sparkContext.getConf().contains(key):
            now = spark.conf.get(key, None) or ""
            # A size that is no plain number is the default, which has no bound.
            spark.conf.set(key, str(min(most, int(now)) if now.isdigit() and int(now) else most))


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: the session's ``spark.checkpoint.dir``. Only a local session, as in tests, may name none and gets one of its own."""
    sc = spark.sparkContext
    own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if own:
        return own.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    mark = f"_lodestone_cp_{sc.applicationId}"
    if not hasattr(sc, mark):
        setattr(sc, mark, tempfile.mkdtemp(prefix="lodestone-cp-"))
    return getattr(sc, mark)


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Folders of ``written`` that nobody has deleted yet.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, for wide rows of which later readers want few columns; ``sweep`` deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder on any file system."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Deletes what ``written`` has written, once nothing reads it any more."""
    while _WRITTEN:
        delete(spark, _WRITTEN.pop())


#: What a Python worker holds over tasks: one model, whichever operator it belongs to.
_MODEL: dict[tuple, object] = {}


def only_model(kind: str, data: bytes, make: Callable[[], T]) -> T:
    """The model that ``make`` gives for ``data``; a worker lets go of any other, so that stages don't add up in memory."""
    key = kind, hashlib.sha256(data).digest()
    if key not in _MODEL:
        _MODEL.clear()
        _MODEL[key] = make()
    return _MODEL[key]


def no_model() -> None:
    """Lets go of any model: the task needs none, and a worker may have one of an earlier stage."""
    _MODEL.clear()


def give_back() -> None:
    """Returns memory that a task's batches have left free to the machine, as a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tokenizer_bytes(name: str, path: str | None = None) -> bytes:
    """A vocabulary file as bytes, read on the driver; ``path`` overrides the installed place."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, "rb") as f:
        return f.read()
