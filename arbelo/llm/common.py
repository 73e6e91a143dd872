"""What the corpus operators share: the shared folder, folds, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbelo.operators.tables import shared_folder

#: bytes.translate tables: A-Z to a-z; and, for WORD_ASCII, all that separates words to a space.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SEPARATES = [c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122)]
LOWER_WORDS = bytes(32 if c in _SEPARATES else LOWER[c] for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_WORDS).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/arbelo/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: its lineage is cut, and executors can be lost."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more: what was made of them is written too."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(key: str, n: int) -> Column:
    """crc32(key as text) mod n; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of df has it (in either case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: int, n_folds: int, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, y) of at most about `bound` labelled rows outside the fold `held_out`, chosen by a hash of the key.

    A key labelled more than once counts once, with its largest label; rows
    without a key, text or label are left out; of rows that repeat a key the one
    with the least text counts.  The chosen keys number `bound` at most, so they
    can be broadcast; texts stay in Spark.
    """
    keys = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isNotNull() & (fold("k", n_folds) != held_out))
        .groupBy("k").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(bound)
    )
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    return rows.join(F.broadcast(keys), "k").groupBy("k", "y").agg(F.min("t").alias("t")).select(F.col("k").alias("doc_id"), F.col("t").alias("text"), "y")
