"""Session helpers: building a session, loading tables, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session in UTC with AQE; further settings may be given as keyword arguments with ``__`` for dots."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. The session's ``spark.checkpoint.dir`` is used where it is set;
    only without it (local tests) a temporary folder of this machine is made and removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = "file://" + root
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


class Folder:
    """A folder of any file system that Spark can reach, through Hadoop's interface."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """What stands directly in it; nothing where there is no such folder."""
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._path(name), True)

    def delete_at_exit(self) -> None:
        self.fs.deleteOnExit(self._path(""))

    def put(self, name: str, value: dict) -> None:
        """Writes the next version of a small document. It is there after one rename or not at all, and a second writer of the same
        version fails; the two versions before are kept, for readers that have just begun."""
        old = self._versions(name)
        n = old[-1] + 1 if old else 0
        part = self._path(f".{name.replace('/', '-')}-{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        to = self._path(f"{name}-{n:09d}.json")
        self.fs.mkdirs(to.getParent())
        if self.fs.exists(to) or not self.fs.rename(part, to):
            self.fs.delete(part, False)
            raise RuntimeError(f"{name} was written by somebody else")
        for k in old[:-2]:
            self.delete(f"{name}-{k:09d}.json")

    def _versions(self, name: str) -> list[int]:
        head, _, tail = name.rpartition("/")
        return sorted(int(m[1]) for x in self.names(head) if (m := re.fullmatch(re.escape(tail) + r"-(\d{9})\.json", x)))

    def newest(self, name: str) -> dict | None:
        old = self._versions(name)
        if not old:
            return None
        stream = self.fs.open(self._path(f"{name}-{old[-1]:09d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name for one operator's tables below the shared folder; what is left of it goes when the driver ends."""
    path = f"{shared_root(spark)}/siltstone/{label}-{uuid.uuid4().hex}"
    Folder(spark, path).delete_at_exit()
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes materialized tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            Folder(t.sparkSession, path).delete()


def spread(df: DataFrame, key: str, bytes_per_task: int = 128 << 20) -> DataFrame:
    """For work in Python that outweighs a shuffle, on a table as it is scanned: where its files are cut into fewer tasks than the cluster
    has cores for, the rows are spread over four per core. The optimizer's size of the scan tells; nothing is run for it. Rows that
    come out of joins or aggregates are not to be given to this: their size is only guessed there."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df if size >= 2 * cores * bytes_per_task else df.repartition(4 * cores, key)


def respread(df: DataFrame, key: str) -> DataFrame:
    """The same for rows of joins and aggregates, whose partitions may be few: always a shuffle, into as many as a shuffle has or more."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), key)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Others may have the same names in another case, or the same name again: the first column of
    exactly that name is taken."""
    low = [c.lower() for c in df.columns]
    if len(set(low)) == len(low):
        return df.select(*names)
    at = {n: df.columns.index(n) for n in names}
    return df.toDF(*[c if at.get(c) == i else f"__{i}" for i, c in enumerate(df.columns)]).select(*names)


def salted_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "left", salts: int = 8) -> DataFrame:
    """Join where one key may hold a large part of ``left``: its rows are spread over ``salts`` tasks by a hash of ``by``, and
    ``right``, which has a key once, is repeated for each of them."""
    l = left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [on, "__salt"], how).drop("__salt")
