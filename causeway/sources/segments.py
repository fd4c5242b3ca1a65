"""Records of several lines, cut out of split files without moving their text.

A segmented scan: every task walks through its splits in order and joins the lines of each record that begins
and ends inside a split. Only what crosses a split's end travels: the lines before a split's first record and its
last record, two pieces per split, are put together by record afterwards. What a task has to know about the
splits before its own (how many records or lines they hold, whether they end inside quotes) comes from a first
pass, as running sums over one row per split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOSE_LINES = 1 << 16  # lines before the first record of a file make pieces of so many lines
HEADER = -1  # the part of the first record of a quoted file
PIECES = "file string, block long, record_no long, part long, inner boolean, text string"


def before(splits: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Per (file, block) the sums of the earlier blocks of the file; `sums` names the columns and their results."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(name) for c, name in sums.items()])


class _Split:
    """What a task knows while it walks through one split."""

    def __init__(self, file: str, block: int, records: int, lines: int, odd: bool):
        self.file, self.block, self.records, self.lines, self.odd = file, block, records, lines, odd
        self.open: list[str] = []  # pieces of the record that is not closed yet
        self.number: int | None = None  # its number; none before the first record of the split
        self.part = 0


def _joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines), "\n")


def _cut(quoted: bool):
    """Pieces of records. Unquoted: `mark` says that a line begins a record, records are numbered. Quoted: `mark`
    counts quotes, a line after an even number of them that is not blank begins a record, its line number names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: _Split | None = None

        def pieces(numbers, parts, inner, texts) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([split.file] * n, pa.string()), pa.array([split.block] * n, pa.int64()), pa.array(numbers, pa.int64()),
                 pa.array(parts, pa.int64()), pa.array([inner] * n, pa.bool_()), pa.array(texts, pa.string())],
                ["file", "block", "record_no", "part", "inner", "text"])

        def close() -> Iterator[pa.RecordBatch]:
            """The open piece ends at the end of the split, or before the split's first record."""
            if split.open:
                number = split.number if split.number is not None or quoted else split.records
                yield pieces([number], [split.part], False, ["\n".join(split.open)])
            split.open = []

        def lead(lines: pa.Array) -> Iterator[pa.RecordBatch]:
            """Lines that belong to the open record; before a file's first record they are cut into parts."""
            at = 0
            while at < len(lines):
                stop = len(lines)
                if not quoted and split.number is None and split.records == 0:
                    part = (split.lines + at) // LOOSE_LINES
                    if part != split.part:
                        yield from close()
                        split.part = part
                    stop = min(stop, (part + 1) * LOOSE_LINES - split.lines)
                split.open += _joined(lines[at:stop], np.array([0, stop - at])).to_pylist()
                at = stop

        for batch in batches:
            files, blocks = batch.column("file"), batch.column("block").to_numpy()
            ids = files.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(ids) != 0)) + 1
            for start, stop in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if stop == start:
                    continue
                row = batch.slice(start, stop - start)
                file, block = files[start].as_py(), int(blocks[start])
                if split is None or (file, block) != (split.file, split.block):
                    if split is not None:
                        yield from close()
                    split = _Split(file, block, row.column("records")[0].as_py(), row.column("lines")[0].as_py(), bool(row.column("odd")[0].as_py()))
                lines, marks = row.column("line"), row.column("mark").to_numpy()
                at = np.arange(len(marks))
                if quoted:
                    quotes = split.odd + np.cumsum(marks)
                    begins = (quotes - marks) % 2 == 0
                    split.odd = bool(quotes[-1] % 2)
                    blank = pc.equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False) & begins
                    at, begins, lines = at[~blank], begins[~blank], lines.filter(pa.array(~blank))
                else:
                    begins = marks != 0
                starts = np.flatnonzero(begins)
                yield from lead(lines[: starts[0]] if len(starts) else lines)
                if len(starts):
                    yield from close()
                    numbers = split.lines + 1 + at[starts] if quoted else split.records + 1 + np.arange(len(starts))
                    parts = np.zeros(len(starts), np.int64)
                    if quoted and split.number is None and split.records == 0:
                        parts[0] = HEADER
                    if len(starts) > 1:
                        yield pieces(numbers[:-1], parts[:-1], True, _joined(lines[starts[0] : starts[-1]], starts - starts[0]))
                    split.number, split.part = int(numbers[-1]), int(parts[-1])
                    split.open += _joined(lines[starts[-1] :], np.array([0, len(lines) - starts[-1]])).to_pylist()
                    split.records = split.records if quoted else int(numbers[-1])
                split.lines += len(marks)
        if split is not None:
            yield from close()

    return run


def records(lines: DataFrame, quoted: bool) -> DataFrame:
    """`file, record_no, part, text` of each record.

    `lines` has `file, block, line, mark, records, lines, odd`, in reading order within each task, and every block
    in one task: what a scan gives as it is. `lines` counts those before the block. Unquoted, `records` counts the
    records before it. Quoted, it counts the lines that are not blank; `odd` says that the block begins inside
    quotes, and the part of a file's first record is HEADER.
    """
    cut = lines.select("file", "block", "line", "mark", "records", "lines", "odd").mapInArrow(_cut(quoted), PIECES)
    inner = cut.where("inner").select("file", "record_no", "part", "text")
    ends = cut.where("not inner")
    if quoted:  # the lines before a split's first record belong to the record before
        upto = Window.partitionBy("file").orderBy("block", F.col("record_no").asc_nulls_first())
        ends = ends.withColumn("record_no", F.coalesce("record_no", F.last("record_no", ignorenulls=True).over(upto)))
    # One group is one record, so what is collected is no more than the record itself.
    pieces = F.array_sort(F.collect_list(F.struct("block", "text"))).alias("pieces")
    if quoted:
        whole = ends.groupBy("file", "record_no").agg(F.min("part").alias("part"), pieces)
    else:
        whole = ends.groupBy("file", "record_no", "part").agg(pieces)
    return inner.unionByName(whole.select("file", "record_no", "part", F.array_join("pieces.text", "\n").alias("text")))
