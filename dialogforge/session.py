"""Session helpers: reading the tables, the shared folder and cutting lineage."""

from __future__ import annotations

import tempfile
import zipfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows that an operator broadcasts after counting them.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """A table; ``schema`` names the columns and nested fields to read, where pruning can't see them through arrays and maps."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where the setting is missing on a local master (tests) a temporary folder is made; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("dialogforge.shared.dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="dialogforge-")
        spark.conf.set("dialogforge.shared.dir", own)
    return own


def _cuts_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/dialogforge-{spark.sparkContext.applicationId}"


def clear_cuts(spark: SparkSession) -> None:
    """Delete what ``cut`` has written for this application; call it when its results have been written or read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_cuts_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str = "step", partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a table instead of its lineage.

    The files survive the loss of any executor; later steps read columns of them only once computed.
    """
    spark = df.sparkSession
    path = f"{_cuts_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_dialogforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="dialogforge-")) / "dialogforge.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._dialogforge_shipped = True
