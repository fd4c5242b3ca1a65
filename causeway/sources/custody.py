"""Fingerprints of files of any size, as trees of hashes over their lines.

A line, without its line feed, has its SHA-256. Lines are numbered through the file; `LEAF_LINES` digests in a
row make a leaf, `BRANCH_LEAVES` leaves a branch, and the branches with the size and number of lines make the
fingerprint, each as the SHA-256 of the hexadecimal digests one after another. So it depends on every byte
and on the order of lines, and not on how the file is split among tasks: only leaves that a split's end cuts
travel as digests of lines, all others as one digest. A single line must fit in a row (2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.sources.segments import before

LEAF_LINES = 4096
BRANCH_LEAVES = 4096
PIECES = "file string, leaf long, at long, whole boolean, text string"


def _pieces(leaf_lines: int):
    """Digests of lines, in reading order within a split, as pieces of leaves; a leaf that is there as a whole as its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, held = None, 0, []  # the split; the number of its next line; digests of the leaf that is open

        def piece() -> tuple:
            at = number - len(held)
            whole = len(held) == leaf_lines
            text = "".join(held)
            return place[0], at // leaf_lines, at, whole, hashlib.sha256(text.encode()).hexdigest() if whole else text

        for batch in batches:
            out = []
            for file, block, lines, digest in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "lines", "digest")), strict=True):
                if (file, block) != place:
                    if held:
                        out.append(piece())
                    place, number, held = (file, block), lines, []
                held.append(digest)
                number += 1
                if number % leaf_lines == 0:
                    out.append(piece())
                    held = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["file", "leaf", "at", "whole", "text"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in piece()], ["file", "leaf", "at", "whole", "text"])

    return run


def _joined(order: str, text: str):
    """The texts of a group in order; a group is bounded by the number of pieces that the level above allows."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def tree_fingerprints(spark: SparkSession, path, leaf_lines: int = LEAF_LINES, branch_leaves: int = BRANCH_LEAVES) -> DataFrame:
    """`file, n_bytes, n_lines, tree_sha256` of each file that has any bytes."""
    raw = spark.read.option("lineSep", "\n").text(path if isinstance(path, list) else [path])
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes"),
                       F.col("_metadata.file_block_start").alias("block"), F.sha2(F.col("value").cast("binary"), 256).alias("digest"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("_lines"), F.max("n_bytes").alias("_bytes"))
    # One row per split, of all of which the driver keeps a list itself.
    placed = lines.join(F.broadcast(before(splits, {"_lines": "lines"})), ["file", "block"]).select("file", "block", "lines", "digest")
    pieces = placed.mapInArrow(_pieces(leaf_lines), PIECES)
    leaves = pieces.groupBy("file", "leaf").agg(F.max(F.when(F.col("whole"), F.col("text"))).alias("_whole"), _joined("at", "text").alias("_parts"))
    leaves = leaves.select("file", "leaf", F.expr(f"leaf div {branch_leaves}").alias("branch"), F.coalesce("_whole", F.sha2("_parts", 256)).alias("text"))
    branches = leaves.groupBy("file", "branch").agg(F.sha2(_joined("leaf", "text"), 256).alias("text"))
    roots = branches.groupBy("file").agg(_joined("branch", "text").alias("_text"))
    sizes = splits.groupBy("file").agg(F.max("_bytes").alias("n_bytes"), F.sum("_lines").alias("n_lines"))
    head = F.concat_ws(":", F.col("n_bytes").cast("string"), F.col("n_lines").cast("string"), "_text")
    return roots.join(sizes, "file").select("file", "n_bytes", "n_lines", F.sha2(head, 256).alias("tree_sha256"))
