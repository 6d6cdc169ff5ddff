"""What the corpus operators share: reading, reliable checkpoints, column handling."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white space characters every contract here names: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()
WHITE_CLASS = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names. Where none is named, a local one serves a local master; on a cluster
    that is an error, since executors would not see each other's files."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and goes on from there: cut lineage that survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones with clashing names don't matter."""
    return df.select(*[F.col(c) for c in columns])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def tag_of(column: str = "text") -> Column:
    """Beside an id, tells apart rows that repeat it with another text."""
    return F.xxhash64(text_or_empty(column))


#: Stands for a null id in joins; beside a tag, it can only meet rows of the same text.
NO_ID = -(1 << 63)


def id_of(column: Column | str = "doc_id") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NO_ID)).cast("long")


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs that kept names by (kept_id, kept_tag), and, where it has it, kept_host; nulls are equal."""
    kept = kept.withColumn("kept_id", id_of("kept_id"))
    same = (id_of(docs["doc_id"]) == kept["kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == kept["kept_tag"])
    if "kept_host" in kept.columns:
        same = same & docs["source"].eqNullSafe(kept["kept_host"])
    return docs.join(kept, same, "left_semi")


def let(value: Column, body) -> Column:
    """Binds value once for body: inlined projections would evaluate it for each element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), for tables of many rows: a Parquet table in the shared checkpoint folder, which is compressed
    and tells the planner its size."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
