"""What the operators share: the shared work folder, written intermediate tables, and word splitting on Arrow arrays."""

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
BATCH_ROWS = 1024


def prepare(spark: SparkSession) -> None:
    """Python workers find this package wherever the driver found it, and get their rows in small batches."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    # rows hold whole texts: with few rows a batch, what the JVM and Python hold at a time stays small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Only where the session has no such setting and runs on this machine alone (tests), a folder of this machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/attestor-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and a lost executor costs nothing twice."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(col: str) -> Column:
    """The id as text; null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def release() -> None:
    """Give freed memory back: workers live as long as their executor and would keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batches_by_bytes(batches, column: str, limit: int = 16 << 20):
    """Arrow batches joined, or cut by rows, to about `limit` bytes of texts: memory stays bounded, work stays vectorised."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows // max(1, -(-batch.column(column).nbytes // limit))) if batch.num_rows else 1
        for at in range(0, batch.num_rows, step):
            b = batch.slice(at, step)
            own = b.column(column).nbytes
            if held and size + own > limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
                release()
            held.append(b)
            size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
        del held
        release()  # idle workers keep nothing of their last task


def array_of(table_: pa.Table, column: str) -> pa.Array:
    col = table_.column(column)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) and col.num_chunks != 1 else col.chunk(0)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ([^\\x20\\x09-\\x0D]+) of whole texts: (code of each word, first word of each text and the end, distinct words)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets -= offsets[0]
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes = np.asarray(coded.indices).astype(np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # what leading and trailing white space leaves
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
        codes -= codes > empty
        keep = np.ones(len(coded.dictionary), bool)
        keep[empty] = False
        return codes, offsets, coded.dictionary.filter(pa.array(keep))
    return codes, offsets, coded.dictionary


def bounded_sample(rows: DataFrame, *, of: Column, key: Column, rows_: int, size: int, classes: int = 256, text: str = "text") -> DataFrame:
    """At most rows_ rows and `size` bytes of texts of each class: those with the smallest keys; ties are cut by rank.

    Only the `classes` most frequent classes are drawn from, and no text above a sixteenth of `size`, so that the driver may
    collect the result whatever the input. A first pass over the classes' counts lets few rows through to the ranking.
    """
    kept = rows.withColumns({"of": of, "key": key}).filter(F.octet_length(text) <= size // 16)
    counts = kept.groupBy("of").agg(F.count(F.lit(1)).alias("class_rows")).orderBy(F.desc("class_rows"), "of").limit(classes)
    share = F.pmod(F.col("key"), F.lit(1 << 30)) * (F.col("class_rows") / float(1 << 30))  # twice the rows wanted, so that enough come
    near = kept.join(F.broadcast(counts), "of").filter(share < 2 * rows_ + 64).drop("class_rows")
    order = Window.partitionBy("of").orderBy("key", text)
    ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rows_)
    total = F.sum(F.octet_length(text)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("total", total).filter(F.col("total") <= size).drop("rank", "total")
