"""Sessions, and this package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def session(name: str = "corpusloom", cores: str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster the one given by spark-submit is used as it is."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable in Python workers, once per Spark context, whether or not it is installed on the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return spark
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._corpusloom_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may do without it, and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}{uuid.uuid4().hex}"


def discarded(spark: SparkSession, path: str) -> str:
    """Has what was written to a path deleted when the driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: compressed, for what is large. It is deleted when the driver ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(discarded(df.sparkSession, path))


class Tally:
    """Aggregates of rows that are taken while the rows pass by, in the job that uses them, instead of in a scan of their own."""

    def __init__(self, **figures: Column):
        self.figures, self.seen = figures, Observation()

    def watched(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen, *[c.alias(k) for k, c in self.figures.items()])

    def get(self) -> dict[str, int]:
        """The figures, once a job has taken the watched rows to their end; it waits for the first."""
        return self.seen.get
