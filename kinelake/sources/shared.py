"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to Python at a time, unless the session asks for another number than Spark's own.
BATCH_ROWS, SPARKS_OWN = 1000, "10000"

_roots: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application inside ``spark.checkpoint.dir``.

    A folder of this machine stands in only where the session names none and all
    tasks run on this machine, as in tests; a cluster's session must name one.
    What is written there goes when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and (spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = base or tempfile.mkdtemp(prefix="kinelake-")
        _roots[app] = root = f"{base.rstrip('/')}/kinelake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, root)
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the session has ended already; the folder's owner clears it
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python may not find it otherwise."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="kinelake-")), "kinelake_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)


def small_batches(spark: SparkSession) -> None:
    """Keeps batches of whole texts that go to Python small: some are very long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == SPARKS_OWN:
        spark.conf.set(name, str(BATCH_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    This cuts the lineage, survives the loss of executors, and gives the
    planner the table's true size.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
