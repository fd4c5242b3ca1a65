"""What the operators of this package share: reading, re-slicing, words, hashes, shared tables.

Words are maximal runs of `[^\\x20\\x09-\\x0D]+`; a null text counts as empty. All hashes of words and
word runs are 64-bit: two different runs fall together with probability 2^-64 per pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.plans.scaling import shared_dir

U = np.uint64
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, purpose: str, sorted_numbers: bool = False) -> DataFrame:
    """Write a table that is read more than once below spark.checkpoint.dir and read it back.

    Runs of `sorted_numbers` are stored as their differences.

    Lost executors then cost a re-read, not a recomputation. Where the session names no folder, the warehouse
    folder takes its place if the master itself is local, as in tests; on a cluster that is an error. The cluster
    clears the folder as it clears checkpoints.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{purpose}")
    writer = df.write.option("compression", "zstd")
    (writer.option("parquet.writer.version", "v2") if sorted_numbers else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, purpose: str, key: str) -> DataFrame:
    """As `keep`, in buckets of `key`: joins on it then move the other side alone.

    The table's data lie below spark.checkpoint.dir as well; its name in the catalog is given back at once.
    """
    spark = df.sparkSession
    name = f"{purpose}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, f"llm/{name}"))
     .bucketBy(buckets, key).saveAsTable(name))
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept


def held_out(doc_id: str | Column, folds: int, fold: int = 2) -> Column:
    """Whether a document belongs to the fold that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(folds)) == fold,
                      F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` bytes of text (one row, if that row alone has more)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker lives on


def kept_rows(docs: DataFrame, wanted) -> DataFrame:
    """The rows of `docs`, all columns as they are, for whose texts `wanted` is true: decided row by row, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(wanted(filled(batch.column("text")))))

    return docs.mapInArrow(run, docs.schema)


def filled(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts.cast(pa.large_string()), "")


def words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in one array, and where each text's words start (one entry more than texts)."""
    lists = pc.ascii_split_whitespace(filled(texts))
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    flat = flat.filter(full)
    # Lower-cased here, as the kernel is wrong for arrays that are slices of others.
    return pc.ascii_lower(flat) if lower else flat, upto[ends]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def word_hashes(flat: pa.Array) -> np.ndarray:
    coded = flat.dictionary_encode()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), U, len(coded.dictionary))
    return hashes[coded.indices.to_numpy()] if len(hashes) else hashes


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash for each run of `length` consecutive words; entry i is the run that starts at word i."""
    n = len(hashes) - length + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for i in range(1, length):
        out = mix(out * U(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U, copy=False).view(np.int64)


class Lists:
    """Collects arrays of unequal length for one list column."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.parts, self.ends = kind, [], [0]

    def add(self, values: np.ndarray) -> None:
        self.parts.append(values)
        self.ends.append(self.ends[-1] + len(values))

    def array(self) -> pa.Array:
        values = np.concatenate(self.parts) if self.parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.array(values, self.kind))


def keys_with_documents(keys: np.ndarray, rows: np.ndarray, doc_ids: np.ndarray) -> pa.RecordBatch:
    """One row per distinct key of a batch with the sorted ids of its documents.

    This is the aggregation before the shuffle: a key that many documents share costs one row per batch.
    `keys` and `rows` (row numbers of the batch) run in parallel, without repetition within a document.
    """
    ids = doc_ids[rows]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.concatenate([first, [len(keys)]])
    more = np.diff(ends) - 1  # documents beyond the first; mostly none
    rest = np.ones(len(ids), bool)
    rest[first] = False
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(more)]), pa.int32()), pa.array(ids[rest], pa.int64()),
                                     mask=pa.array(more == 0))
    return pa.RecordBatch.from_arrays([pa.array(signed(keys[first]), pa.int64()), pa.array(ids[first], pa.int64()), lists],
                                      names=["key", "doc", "others"])


KEYS = "key long, doc long, others array<long>"


def shared_keys(keyed: DataFrame) -> DataFrame:
    """`key, owner, docs` of the rows of KEYS whose key two documents have at least; the owner is the smallest of all.

    One shuffle of the keys; a hot key has one row per batch there, and the sorted window spills.
    """
    over = Window.partitionBy("key")
    last = F.coalesce(F.element_at("others", -1), "doc")
    return (keyed.withColumn("owner", F.min("doc").over(over)).withColumn("_last", F.max(last).over(over))
            .where("owner < _last").select("key", "owner", F.concat(F.array("doc"), F.coalesce("others", F.expr("array()").cast("array<bigint>"))).alias("docs")))
