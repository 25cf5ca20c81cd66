"""Session construction and durable intermediate tables.

Iterative operators cut their lineage by writing a table into the shared
folder named by ``spark.checkpoint.dir`` and reading it back.  Parquet in a
shared folder survives the loss of any executor and is written once (an RDD
checkpoint computes its input twice).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_DIR: str | None = None


def build_session(app: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if (master or "").startswith("local["):  # one machine: a folder of its own is shared by all there is
        defaults["spark.checkpoint.dir"] = f"file://{_local_dir()}"
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _local_dir() -> str:
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="quillgraph-")
    return _LOCAL_DIR


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` where set.

    A session of one machine (``local[n]``) that lacks the setting gets a folder of
    its own; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_dir()}"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


class Scratch:
    """Tables written for one operator run; ``drop`` removes a superseded one early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.tables: list[tuple[DataFrame, str]] = []
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the table read back (lineage ends here)."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def keep_counted(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
        """``keep`` with aggregates of the rows, counted while they are written."""
        seen = Observation()
        out = self.keep(df.observe(seen, *[c.alias(n) for n, c in counts.items()]))
        return out, seen.get

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of this scratch that no later step reads."""
        for k, (kept, path) in enumerate(self.tables):
            if kept is df:
                del self.tables[k]
                _delete(self.spark, path)
                return
