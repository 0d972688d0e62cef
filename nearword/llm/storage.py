"""Where operators keep what must outlive an executor.

Everything written here goes to the folder that ``spark.checkpoint.dir`` names (a shared store on a
cluster). When it is unset, as in tests, a folder of this process is made and set once, for a local session
only. Folders are removed when the process ends.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from nearword.plans import scratch


_shipped: set[str] = set()


#: Bytes of rows that Python workers get at once.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make the session ready for the operators: the executors' Python has this package, wherever the driver has it from, and Arrow batches are small."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    handle, name = tempfile.mkstemp(prefix="nearword-", suffix=".zip")
    with os.fdopen(handle, "wb") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


class Scratch:
    """A new folder below the shared one for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = scratch.scratch_path(spark, name)
        self._n = 0

    def child(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: later plans start from those files."""
        path = self.child(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def open_output(uri: str):
    """A writable binary stream for a URI of any store that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable binary file for such a URI."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
