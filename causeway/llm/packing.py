"""Hierarchical multi-length packing of documents into training sequences.

A document's ids are cut into full windows and a tail. Every tail is routed to the shortest tier (a
window size, a power of two) that holds it. Tiers are packed from the longest down: a window opens with
the longest tail left, its gap is filled with the longest tails of the shorter tiers that fit, and what
is left open takes the head of one more tail, whose rest goes back to its own tier. Tails left in the
shortest tier open windows of that tier, so short sequences go to short steps. Windows of one tier are
then dealt to step groups of equally many windows.

Each task packs its own documents in blocks of at most `BLOCK_TOKENS` tokens (or one document, if it
alone is longer): no shuffle, no state across tasks, and a lost task is redone alike. A sequence id is
made of the task's number, the block's and the sequence's. Padding is left only in windows whose gap no
tail could fill: at most one window of each tier and block.

Null texts count as empty: such a document still has its end id and thus one piece. Repeated rows are
packed as often as they occur.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import filled, slices

TIERS = (128, 256, 512, 1024, 2048)
BLOCK_TOKENS = 8 << 20
STEP_TOKENS = 32 * 2048
SPECIAL = "<|endoftext|>"

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")


@cache
def encoder(ranks_path: str, pattern: str):
    """The byte-level vocabulary as ranks: the ids are those of its form for the tokenizers library.

    Special tokens written out in a text become their id, as that library has it by default.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def ids_of(encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, allowed_special={SPECIAL}).astype("<u4", copy=False)


def layout(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows for documents of the given lengths: (tier, [(document, start, length), ...])."""
    longest = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    queues: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (length, -document, start), ascending

    def route(length: int) -> int:
        return next(t for t in tiers if length <= t)

    for doc, n in enumerate(lengths):
        windows += [(longest, [(doc, s, longest)]) for s in range(0, n - longest + 1, longest)]
        if n % longest:
            queues[route(n % longest)].append((n % longest, -doc, n - n % longest))
    for q in queues.values():
        q.sort()

    def longest_fit(gap: int):
        for t in reversed(tiers):
            q = queues[t]
            if q and q[0][0] <= gap:
                return q.pop(bisect_right(q, (gap, 1, 0)) - 1)
        return None

    def shortest(above: int):
        return next((queues[t] for t in tiers if queues[t] and queues[t][-1][0] > above), None)

    for tier in reversed(tiers):
        queue = queues[tier]
        while queue:
            length, doc, start = queue.pop()
            pieces, gap = [(-doc, start, length)], tier - length
            while gap:
                if found := longest_fit(gap):
                    length, doc, start = found
                    pieces.append((-doc, start, length))
                    gap -= length
                elif (q := shortest(gap)) is not None:
                    length, doc, start = q.pop(bisect_right(q, (gap, 1, 0)))
                    pieces.append((-doc, start, gap))
                    rest = length - gap
                    insort(queues[route(rest)], (rest, doc, start + gap))
                    gap = 0
                else:
                    break
            windows.append((tier, pieces))
    return windows


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece: where it comes from, its checksum, its sequence, its tier and step group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_path, pattern)
        task = TaskContext.get().partitionId()
        block, ids, doc_ids, tokens = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            rows = []
            used: dict[int, int] = {}
            for number, (tier, pieces) in enumerate(layout([len(x) for x in ids], tiers)):
                sequence = task << 40 | block << 24 | number
                nth = used[tier] = used.get(tier, -1) + 1
                group = task << 40 | block << 24 | tiers.index(tier) << 20 | nth // (STEP_TOKENS // tier)
                offset = 0
                for doc, start, length in pieces:
                    rows.append((doc_ids[doc], start, length, zlib.crc32(ids[doc][start : start + length]),
                                 len(ids[doc]), sequence, offset, tier, group))
                    offset += length
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), filled(batch.column("text")).to_pylist(), strict=True):
                found = np.append(ids_of(encoding, text), np.uint32(end_id)).astype("<u4", copy=False)
                if ids and tokens + len(found) > BLOCK_TOKENS:
                    yield flush()
                    block, ids, doc_ids, tokens = block + 1, [], [], 0
                ids.append(found)
                doc_ids.append(doc_id)
                tokens += len(found)
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)
