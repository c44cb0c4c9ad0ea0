"""Token ids in Parquet list columns, laid out for selective reads [operator 6]."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices
from .encoders import END_ID, TextEncoder

#: Writer settings: ids by dictionary (vocabularies fit one dictionary page), ids of documents and
#: counts as deltas, small pages with their index so that single documents can be read
LAYOUT = {
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}

#: bytes of texts that are encoded at once
BATCH_BYTES = 4 << 20


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids of each whole text (null: empty) with the end id appended; keeps the order of rows."""

    def encode(batches):
        encoder = TextEncoder(tokenizer, word_ends=True)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for a, b in slices([len(t) for t in texts], BATCH_BYTES):
                part, (ids, counts) = batch.slice(a, b - a), encoder.encode_words(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int32)), lists], ["doc_id", "n_tokens", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(encode, "doc_id long, n_tokens int, ids array<int>")


def write_token_files(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write ``doc_id, n_tokens, ids``, each file a range of document ids in ascending order.

    Null ids come first; repeated ids stay together in one file, in the order of their texts.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = plain.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    encode_documents(ordered, tokenizer).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with ids in a range; row-group and page indexes let other pages be skipped."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start among all ids, count, and crc32 of the ids.

    The starts come from a manifest with a row for each file, and a running sum over the rows of each file in
    their order.
    """

    def checksums(batches):
        for batch in batches:
            lists = batch.column(2)
            values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            counts = np.diff(offsets).astype(np.int64)
            arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array(counts), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "doc_id", "row", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    rows = files.select(F.col("_metadata.file_name").alias("file"), "doc_id", "ids", F.col("_metadata.row_index").alias("row")).mapInArrow(
        checksums, "file string, doc_id long, row long, n_tokens long, ids_crc32 long"
    )
    manifest = (
        files.select(F.col("_metadata.file_name").alias("file"), "doc_id", "n_tokens")
        .groupBy("file")
        .agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.sum("n_tokens").alias("total"))
    )
    order = Window.orderBy(F.col("nulls").desc(), F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    begins = manifest.select("file", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(begins), "file")  # a row for each file
        .select("doc_id", (F.col("begin") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokens_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files into the shared folder, read them back and return the index.

    Null texts are empty, an empty table gives no rows, extra columns are left behind.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer)
    return token_index(spark, path)
