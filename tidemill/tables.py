"""Reading base tables and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; one of our own only where none is set and all runs in one process.

    On a cluster without the setting this raises: a folder of one machine would hold parts of each table.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster's own cleaning has the folder
        pass


class Scratch:
    """Tables written to the shared folder. They outlive lost executors and cut lineage.

    `drop()` removes what is no longer read; the rest goes when the interpreter ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_remove, spark, self.root)

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_scratch_path", None):
            _remove(self.spark, path)


MOST_BYTES = 64 << 20


def is_small(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> bool:
    """Whether `df` has at most so many rows and bytes; the bytes are those of its rows written as JSON."""
    got = df.limit(most_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return got["n"] <= most_rows and (got["b"] or 0) <= most_bytes


def size_checked(df: DataFrame, most_rows: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it is small, else as it is (Spark then joins by shuffling).

    The check runs the plan of `df` once more, so what is dear is cut before.
    """
    return F.broadcast(df) if is_small(df, most_rows, most_bytes) else df


def latest_rows(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per `key`: the greatest by `order`, nulls lowest. Partial aggregation, so a hot key costs no sort.

    Rows whose key is null are dropped. Further ties are decided by all orderable columns, so the result is
    the same whatever the row order.
    """
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if c != key and "map<" not in t and "variant" not in t]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order, *rest))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_r")).select("_r.*")


MOST_REPEATED = 2_000_000


def latest_of_wide(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """`latest_rows` for rows with long texts: those whose key stands once are not shuffled.

    The keys that stand more than once are found on the key alone. While they are small enough to be broadcast only their
    rows are aggregated; beyond that all are, with the same result. Further ties go by a hash of the row.
    """
    rows = df.filter(F.col(key).isNotNull())
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if c != key and "map<" not in t and "variant" not in t]
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order, F.xxhash64(*rest)))
    newest = lambda some: some.groupBy(key).agg(best.alias("_r")).select("_r.*")
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    if not is_small(again, MOST_REPEATED):
        return newest(rows)
    again = F.broadcast(again)
    return rows.join(again, key, "left_anti").select(*df.columns).unionByName(newest(rows.join(again, key, "left_semi")))
