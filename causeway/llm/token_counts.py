"""Token counts that follow edits: a segment tree of pre-token runs per document.

A text is cut into chunks, each a run of white space with the run of other characters after it. The
pre-tokenizer never joins characters across a chunk's start, so chunks are encoded on their own. The
leaves of a document's tree hold its chunks; every node holds the characters and tokens below it. An edit
(place, characters deleted, text inserted) finds its leaves by the character sums, takes the touched chunks
and the one on either side as context, cuts and re-encodes that region alone and updates the sums on the
paths above. Counts are those of encoding the edited text as a whole.

Null texts count as empty; null edits as none. Edits apply one after another, each to the text that the
earlier ones left; a place beyond the end means the end, a deletion stops at the end, null fields are
0 or "". Repeated rows are counted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import filled, slices
from causeway.llm.packing import SPECIAL, encoder

# White space as the pre-tokenizer has it.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
CACHE_CHUNKS = 500_000


class ChunkCounter:
    """Tokens of single chunks, each worked out once."""

    def __init__(self, encoding):
        self.encoding, self.known = encoding, {}

    def counts(self, chunks: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE_CHUNKS:
            self.known = known = {}
        for c in {c for c in chunks if c not in known}:
            known[c] = len(self.encoding.encode(c, allowed_special={SPECIAL}))
        return [known[c] for c in chunks]


class CountTree:
    def __init__(self, text: str, counter: ChunkCounter):
        self.counter = counter
        chunks = CHUNK.findall(text)
        self.leaves: list[list[str]] = [[c] for c in chunks] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = self.sums([len(c) for c in chunks])
        self.tokens = self.sums(counter.counts(chunks))
        self.encoded = 0  # chunks encoded for edits

    def sums(self, values: list[int]) -> list[int]:
        levels = [np.zeros(self.size, np.int64)]
        levels[0][: len(values)] = values
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        return [0, *np.concatenate(levels[::-1]).tolist()]  # node k has the children 2k and 2k + 1

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at this place, and the characters before the leaf."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place - before >= self.chars[node]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chunks: list[str], tokens: int) -> None:
        self.leaves[leaf] = chunks
        node = leaf + self.size
        dc, dt = sum(map(len, chunks)) - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += dc
            self.tokens[node] += dt
            node //= 2

    def edit(self, place: int, deleted: int, inserted: str) -> None:
        n = self.chars[1]
        place = min(max(place, 0), n)
        end = min(place + max(deleted, 0), n)
        first, before = self.leaf_at(max(place - 1, 0)) if n else (0, 0)
        last = self.leaf_at(min(end, n - 1))[0] if n else 0
        region = "".join(c for leaf in range(first, last + 1) for c in self.leaves[leaf])
        chunks = CHUNK.findall(region[: place - before] + inserted + region[end - before :])
        self.encoded += len(chunks)
        self.put(first, chunks, sum(self.counter.counts(chunks)))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.put(leaf, [], 0)

    def count(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(c for leaf in self.leaves for c in leaf)


COUNTS = "doc_id long, n_tokens long, edited_n_tokens long, n_chunks long, n_encoded long"


def count_with_edits(docs: DataFrame, edits: Column, ranks_path: str, pattern: str) -> DataFrame:
    """Token counts of each text before and after its edits, its chunks, and how many the edits encoded anew.

    `edits` is an array of structs (place, deleted, inserted). A map over the rows, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ChunkCounter(encoder(ranks_path, pattern))
        for batch in slices(batches):
            rows = []
            for doc_id, text, todo in zip(batch.column("doc_id").to_pylist(), filled(batch.column("text")).to_pylist(),
                                          batch.column("edits").to_pylist(), strict=True):
                tree = CountTree(text, counter)
                chunks, before = sum(map(len, tree.leaves)), tree.count()
                for e in todo or []:
                    if e is not None:
                        tree.edit(e["place"] or 0, e["deleted"] or 0, e["inserted"] or "")
                rows.append((doc_id, before, tree.count(), chunks, tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                             ["doc_id", "n_tokens", "edited_n_tokens", "n_chunks", "n_encoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    return rows.mapInArrow(run, COUNTS)
