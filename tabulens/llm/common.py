"""What the corpus operators share: patterns, scratch tables, joins on skewed keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space only, so that words are the same in Java, Python bytes and RE2.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A group is hot when it holds more than 1/HOT of all rows; so there are fewer than HOT hot groups.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; in local mode a folder of our own if none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        shared = spark.sparkContext.getCheckpointDir()
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tabulens/{name}-{uuid.uuid4().hex}"


def cleanup(spark: SparkSession) -> None:
    """Delete what the operators have stored in the shared folder. Only for when no result that still
    reads from there is used any more: results of operators are lazy."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/tabulens")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start from files that
    outlive any executor, and values such as row numbers no longer change when recomputed."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(*columns: Column) -> Column:
    """One key that is never null for columns that may be: equal keys for equal values, null equal to null."""
    return F.struct(*[x for c in columns for x in (c.isNull(), F.coalesce(c.cast("string"), F.lit("")))])


def hot_parts(sizes: DataFrame, size: str) -> Column:
    """In how many parts a row of ``sizes``, a stored table with one row per key, has its key's rows split, so
    that none is over 1/HOT of all rows; 1 for keys that are not hot."""
    total = sizes.agg(F.sum(size).alias("n")).first().n or 0
    return F.greatest(F.ceil(F.col(size) * F.lit(HOT) / F.lit(max(total, 1))), F.lit(1)).cast("int")


#: What a broadcast may hold: rows, and bytes as the caller reckons them.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner", weight: Column | None = None) -> DataFrame:
    """Give each row the columns of its group, where one group may hold most rows.

    ``groups`` has one row per ``key`` with its number of rows in ``size``. Groups over 1/HOT of
    all rows number fewer than HOT, so they are broadcast; the rest meet in a shuffled join. Where groups
    have values of any length, ``weight`` reckons the bytes of one: if the hot ones are over BROADCAST_BYTES
    together, only their keys are broadcast and their rows are dealt out to copies of the group's row.
    Both arguments should be stored tables: each is read twice. Keys must not be null. With ``how``
    'left' rows without a group stay, with nulls.
    """
    parts = hot_parts(groups, size)
    hot = parts > 1
    if weight is not None and (groups.where(hot).agg(F.sum(weight)).first()[0] or 0) > BROADCAST_BYTES:
        return _salted(rows, groups, key, parts, how)
    values = [c for c in groups.columns if c != key]
    large = groups.where(hot).select(F.col(key).alias("__key"), *values, F.lit(True).alias("__hot"))
    tagged = rows.join(F.broadcast(large), rows[key] == F.col("__key"), "left").drop("__key")
    done = tagged.where("__hot").drop("__hot")
    rest = tagged.where("__hot is null").drop("__hot", *values)
    small = groups.where(~hot).withColumnRenamed(key, "__key")
    return done.unionByName(rest.join(small, rest[key] == F.col("__key"), how).drop("__key"))


def _salted(rows: DataFrame, groups: DataFrame, key: str, parts: Column, how: str) -> DataFrame:
    """One shuffled join by key and salt. Fewer than HOT groups have over one part, and at most 2 HOT copies
    come of them. Rows are stored with the number that salts them, so a task run again deals them out alike."""
    split = groups.where(parts > 1).select(F.col(key).alias("__key"), parts.alias("__parts"))
    numbered = store(rows.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    tagged = numbered.join(F.broadcast(split), numbered[key] == F.col("__key"), "left").drop("__key")
    tagged = tagged.withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("__place"), "__parts"), F.lit(0)).cast("int")).drop("__place", "__parts")
    copies = groups.withColumn("__copy", F.explode(F.sequence(F.lit(0), parts - 1))).withColumnRenamed(key, "__key")
    return tagged.join(copies, (tagged[key] == F.col("__key")) & (F.col("__salt") == F.col("__copy")), how).drop("__key", "__salt", "__copy")


def bounded_join(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left", most: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``join_groups`` for groups that are few as a rule: with at most ``most`` of them, of at most
    BROADCAST_BYTES together (``weight``: bytes of one, 256 if not given), all are broadcast. Their
    number and weight are those of the stored table, so this is no guess."""
    n, held = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(256) if weight is None else weight), F.lit(0))).first()
    if n > most or held > BROADCAST_BYTES:
        return join_groups(rows, groups, key, size, how, weight)
    few = groups.withColumnRenamed(key, "__key")
    return rows.join(F.broadcast(few), rows[key] == F.col("__key"), how).drop("__key")


def packed(docs: DataFrame, *read: str) -> DataFrame:
    """``docs`` as one struct __doc with fields c0, c1, ..., beside the columns in ``read`` under their
    names: no column of ``docs``, whatever its name, can then meet one that an operator adds."""
    return docs.select(F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("__doc"), *[named(c).alias(c) for c in read])


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``packed`` again, those in ``changed`` with new values."""
    return df.select(*[changed.get(c, F.col(f"__doc.c{i}")).alias(c) for i, c in enumerate(columns)])


def named(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(named(name).cast("string"), F.lit(""))
