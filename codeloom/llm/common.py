"""Tables kept in the shared folder, and joins to groups of which one may hold a third of all rows."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Code points of the contracts' white space, U+0020 and U+0009 to U+000D, as a class of Java and RE2 expressions.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group counts as hot from this share of all rows on, so there are at most 1000 hot groups at any size.
HOT_SHARE = 1000


#: Rows of a batch between the JVM and a Python task, where rows are whole texts.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """Texts go to Python tasks at most BATCH_ROWS at a time, which bounds the copies that both sides hold; a smaller
    setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="codeloom-"), "codeloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; in local mode only, a scratch folder where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="codeloom-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; the file system removes it when the application ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder: cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def attach(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """Left (or inner) join of facts (one row for each key; weight: rows it stands for) to rows.

    Keys with more than a thousandth of all rows, at most HOT_SHARE of them, are named in the plan: their facts are
    broadcast, so that their rows stay where they are. The other rows meet their facts by a shuffle. Facts must be cheap
    to read again.
    """
    hot = [r[0] for r in facts.filter(F.col(weight) * HOT_SHARE > F.lit(total)).select(key).collect()]  # HOT_SHARE at most
    if not hot:
        return rows.join(facts, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(is_hot).join(F.broadcast(facts.filter(is_hot)), key).unionByName(rows.filter(~is_hot).join(facts.filter(~is_hot), key, how))
