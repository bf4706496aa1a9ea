"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII word characters and everything beyond ASCII, after A-Z is lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs without ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our
    own where that is unset on a single machine, as in tests; a cluster must set it."""
    global _own_dir
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if _own_dir is None:
            folder = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_dir = "file://" + folder
        found = _own_dir
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives the
    optimizer the true size, so that only small tables are broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a Bloom filter at most (8 MB), and bits per key below which it lets too much through.
_FILTER_BITS, _FILTER_LEAST = 1 << 26, 4


@contextmanager
def prefiltered(keys: DataFrame):
    """Joins planned inside drop rows whose key is not in ``keys``, a written table,
    before they shuffle the other side, by Spark's Bloom filters.

    ``keys`` must be read with a comparison, or Spark does not take it for selective.
    Keys too many for a filter of bounded size are joined without one.  Results are the
    same with and without it.
    """
    spark, n = keys.sparkSession, keys.count()
    if n * _FILTER_LEAST > _FILTER_BITS:
        yield
        return
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "4g",
              "expectedNumItems": str(max(n, 1)), "numBits": str(min(max(8 * n, 1 << 20), _FILTER_BITS))}
    before = {k: spark.conf.get(prefix + k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(prefix + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(prefix + k, v)


def written() -> int:
    """How many tables ``materialize`` has written so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``materialize`` wrote, once their results are used up: those since a
    count of ``written``, without the last ``keep``."""
    until = len(_written) - keep
    for name in _written[since:until]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _written[since:until]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(module: str) -> None:
    """Send a module's functions to the executors with the task, so that they
    need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def boxed(df: DataFrame, **needed: Column) -> DataFrame:
    """All columns of ``df`` as one struct, beside the columns an operator works
    on, so that names of its own cannot meet those of ``df``."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.select(whole.alias("_row"), *(c.alias(name) for name, c in needed.items()))


def unboxed(df: DataFrame, names: list[str], **added: Column) -> DataFrame:
    """The columns ``names`` of a boxed row; ``added`` takes the place of a column
    of the same name, or follows at the end."""
    kept = [added[c].alias(c) if c in added else F.col("_row").getField(c).alias(c) for c in names]
    return df.select(*kept, *(c.alias(name) for name, c in added.items() if name not in names))
