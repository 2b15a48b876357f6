"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from skylattice.sources import readers

#: Pattern of a word, as code points: anything but a space and the controls 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session: their Python workers import it by name."""
    context = spark.sparkContext
    if not getattr(context, "_skylattice_shipped", False):
        root = Path(__file__).resolve().parents[2]
        packed = Path(tempfile.mkdtemp(prefix="spark-")) / "skylattice.zip"
        with zipfile.ZipFile(packed, "w") as out:
            for source in sorted((root / "skylattice").rglob("*.py")):
                out.write(source, source.relative_to(root))
        context.addPyFile(str(packed))
        context._skylattice_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of scratch tables that were made and not dropped yet, in order.
_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder of our own under the shared one."""
    _made.append(readers.scratch(spark, label))
    return _made[-1]


def drop_scratch(spark: SparkSession, since: int = 0, keep: Iterable[str] = ()) -> None:
    """Delete the scratch tables made ``since`` so many were there, but those whose paths ``keep`` holds, through Hadoop's
    file system interface, so that any store works. Results that were not written or read yet may depend on them."""
    kept = set(keep)
    jvm = spark.sparkContext._jvm
    for path in [x for x in _made[since:] if x not in kept]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _made.remove(path)


def last_made() -> str:
    """Where the newest scratch table is."""
    return _made[-1]


def made() -> int:
    """How many scratch tables there are, to be told to ``drop_scratch``."""
    return len(_made)


def materialise(df: DataFrame, label: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back."""
    path = scratch(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
