"""Two-pass external shuffle into shards of equal row counts.

First pass: every record goes to one of many buckets by a seeded hash of its
place in the input, so that neither equal keys nor equal texts meet more often
than others; buckets are small enough for a task's memory and lie on disk as
the shuffle's files. Second pass: a task takes one bucket at a time, puts its
records into their own order, shuffles them by Fisher and Yates with a
generator seeded by the bucket, and writes them. Buckets follow one another in
one long order that is cut into shards whose counts are at most one apart.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from outletlens.llm import common

#: Bytes of text in a bucket, as an average; a task holds a bucket twice.
BUCKET_BYTES = 32 << 20
#: Bytes of a record besides its text.
RECORD_BYTES = 64


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def located(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with each row's place in its Parquet files; what has no such place is written first."""

    def placed(df):
        at = df.metadataColumn("_metadata")
        return df.select("*", at["file_name"].alias(file), at["row_index"].alias(row))

    try:
        return placed(docs)
    except AnalysisException:
        return placed(common.save(docs, "shuffle-input"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of 0 to n - 1: from the end, each place is swapped with one not above it."""
    rng = np.random.Generator(np.random.PCG64([seed, bucket]))
    out = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
        out[i], out[j] = out[j], out[i]
    return np.array(out, np.int64)


def shuffled(docs: DataFrame, shards: int = 8, seed: int = 12, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``, in shuffled order; the order depends on ``seed`` and the rows' places in their files.

    Nulls in any column, repeated rows and repeated ids are records like all
    others; an empty table gives no rows; fewer rows than shards leave the
    last shards empty. Columns of ``docs`` named shard or slot go.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    file, row, bucket, before, order = common.own_names(docs, "shuffle_file", "shuffle_row", "shuffle_bucket", "shuffle_before", "shuffle_order")
    keyed = located(docs, file, row)
    n, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    tasks = max(common.parts(spark), math.ceil((total + n * RECORD_BYTES) / bucket_bytes))
    buckets = 4 * tasks
    mark = F.xxhash64(F.lit(seed), F.col(file), F.col(row))
    keyed = keyed.withColumn(bucket, F.pmod(mark, F.lit(buckets))).withColumn(order, F.xxhash64(mark))
    counts = keyed.groupBy(bucket).count()
    offsets = common.save(counts.select(bucket, F.coalesce(F.sum("count").over(W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before)), "buckets")  # a row for each bucket
    rows = keyed.repartition(tasks, bucket).join(offsets.repartition(tasks, bucket).hint("shuffle_hash"), bucket).sortWithinPartitions(bucket, order, file, row)
    names = docs.columns

    def permuted(batches):
        import pyarrow as pa

        def done(pieces):
            held = pa.Table.from_batches(pieces)
            number, base = held.column(bucket)[0].as_py(), held.column(before)[0].as_py()
            by = fisher_yates(held.num_rows, seed, number)
            step = max(1, math.ceil(held.num_rows * (1 << 20) / max(held.nbytes, 1)))  # about 1 MB a batch
            held = held.select(names)
            for at in range(0, held.num_rows, step):
                mine = by[at : at + step]
                place = base + at + np.arange(len(mine), dtype=np.int64)
                shard = place * shards // n
                columns = [pa.array(shard.astype(np.int32)), pa.array(place - -(-shard * n // shards))]
                taken = held.take(pa.array(mine)).combine_chunks()
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns), *columns], [*names, "shard", "slot"])

        pieces, now = [], None
        for batch in batches:
            ids = batch.column(bucket).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if pieces and ids[a] != now:
                    yield from done(pieces)
                    pieces = []
                now = ids[a]
                pieces.append(batch.slice(a, b - a))
        if pieces:
            yield from done(pieces)

    schema = StructType([*docs.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())])
    return rows.mapInArrow(permuted, schema)


def write(docs: DataFrame, root: str, shards: int = 8, seed: int = 12, bucket_bytes: int = BUCKET_BYTES) -> StructType:
    """Write the shuffled records as Parquet, a folder ``shard=K`` for each shard, rows of a file in the order of their slots; the schema to read them by."""
    out = shuffled(docs, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot")
    out.write.partitionBy("shard").parquet(root)
    return out.schema


def read(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The records of ``write`` with their shard and slot."""
    return spark.read.schema(schema).parquet(root)


def digest(records: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of records that were read back."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return records.select("doc_id", byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
