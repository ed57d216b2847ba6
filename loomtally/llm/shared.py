"""Tables in the shared folder, checked broadcasts and the driver's small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of other characters than the ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one of this machine only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomtally-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = "file://" + found
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Scratch folders that have not been removed yet, in the order in which they were made.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder of the shared one, removed when the driver ends if not before."""
    path = f"{shared_folder(spark)}/loomtally/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    atexit.register(remove, spark, [path])
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes those of the scratch folders that are still there. Nothing that is yet to be computed may read them."""
    for path in [p for p in paths if p in _scratch]:
        _scratch.remove(path)
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may have gone first
            pass


def scratch_since(known: list[str]) -> list[str]:
    """The scratch folders made since `known`, an earlier answer to scratch_since([])."""
    return [p for p in _scratch if p not in known]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table of the shared folder, which survives the loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pack(df: DataFrame, added: tuple[str, ...] = ()) -> tuple[list[str], list[Column]]:
    """The columns of df whose names, in any case of letters, are not among added, and one column _row that holds them: within it they can't clash
    with the names that an operator uses. No column where there are none."""
    taken = {a.lower() for a in added}
    own = [c for c in df.columns if c.lower() not in taken]
    return own, [F.struct(*[F.col(quoted(c)) for c in own]).alias("_row")] if own else []


def unpack(own: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in own]


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that are no longer referenced."""
    import gc
    import time

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)  # the cleaner works on its own


def join_small(large: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """Null-safe join on key with a table of one row a key. It is broadcast only when its counted rows are within BROADCAST_ROWS;
    beyond that the join is shuffled, with the rows of the large side salted and the small side repeated for each salt, so that
    a key that holds a third of all rows is dealt over many tasks."""
    count = small.count() if rows is None else rows
    renamed = small.withColumnRenamed(key, "_key")
    if count <= BROADCAST_ROWS:
        return large.join(F.broadcast(renamed), large[key].eqNullSafe(renamed["_key"]), how).drop("_key")
    salts = 16
    many = renamed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = large.withColumn("_own", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    return dealt.join(many, dealt[key].eqNullSafe(many["_key"]) & (dealt["_own"] == many["_salt"]), how).drop("_key", "_salt", "_own")


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32(doc_id as text) mod modulus is 2; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
