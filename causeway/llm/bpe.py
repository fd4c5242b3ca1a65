"""BPE encoding and decoding with a pair occurrence index.

The distinct pieces of a slice are laid out side by side as one list of symbols. An index maps every
mergeable pair to all its positions; ranks that occur are applied in ascending order, each to all its
positions, and a merge updates only the lists of the pairs that it makes. A merge that makes a pair of
lower rank (possible where a token has two derivations) interrupts the rank at hand, so that the order
within each piece is the one of the reference algorithm. Normalisation and pre-tokenisation are those
of the tokenizer file; a text splits at ASCII white space without changing them, so each distinct
chunk is worked out once.

Null texts count as empty; an empty text has no ids and decodes to "". Special tokens written out in
a text become their ids, as the tokenizers library has it by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import filled, slices, words

CACHE_CHUNKS = 400_000
SLICE = 8 << 20
NO_RANK = 1 << 30
# White space beyond ASCII, and what some versions of Unicode count as such.
WIDE_SPACE = regex.compile(r"[\s\x1C-\x1F\u180E\u200B\uFEFF]")


class PairIndexBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        sides = np.array([(vocab[a], vocab[b]) for a, b in model["merges"]], np.int64)
        self.left, self.right = sides[:, 0], sides[:, 1]
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        keys = self.left << 20 | self.right
        self.by_key = np.argsort(keys)
        self.keys = keys[self.by_key]
        # A merge whose token takes part in an earlier rank may make a pair that must go first.
        uses = np.full(max(vocab.values()) + 1, NO_RANK)
        np.minimum.at(uses, self.left, np.arange(len(sides)))
        np.minimum.at(uses, self.right, np.arange(len(sides)))
        self.careful = uses[self.made] < np.arange(len(sides))
        letters = [t for t in vocab if len(t) == 1]
        self.inner = np.full(max(map(ord, letters)) + 1, -1)
        self.last = self.inner.copy()
        for c in letters:
            self.inner[ord(c)], self.last[ord(c)] = vocab[c], vocab[c + suffix]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.by_key[at], NO_RANK)

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids, as little-endian 32-bit numbers, of pieces written in the vocabulary's characters."""
        if not pieces:
            return []
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate([[0], ends[:-1]])
        sym = self.inner[codes]
        sym[ends - 1] = self.last[codes[ends - 1]]
        nxt, prv = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        nxt[ends - 1] = prv[starts] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(ranks: np.ndarray, positions: np.ndarray) -> None:
            hit = ranks < NO_RANK
            ranks, positions = ranks[hit], positions[hit]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, positions = ranks[order], positions[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=True):
                rank = int(ranks[a])
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(positions[a:b])

        pairs = np.flatnonzero(nxt >= 0)
        add(self.ranks(sym[pairs], sym[pairs + 1]), pairs)
        while active:
            rank = heapq.heappop(active)
            left, right, new = self.left[rank], self.right[rank], self.made[rank]
            at = np.unique(np.concatenate(index.pop(rank)))
            then = nxt[at]
            fits = (sym[at] == left) & (then >= 0)
            fits &= sym[then] == right
            at, then = at[fits], then[fits]
            if left == right and len(at):  # of a run of equal symbols every second pair
                run = np.concatenate([[True], then[:-1] != at[1:]])
                number = np.arange(len(at))
                even = (number - np.maximum.accumulate(np.where(run, number, 0))) % 2 == 0
                at, then = at[even], then[even]
            if self.careful[rank] and len(at) > 1:
                index[rank] = [at[1:]]
                heapq.heappush(active, rank)
                at, then = at[:1], then[:1]
            if not len(at):
                continue
            after = nxt[then]
            sym[at], sym[then], nxt[at] = new, -1, after
            more = after >= 0
            prv[after[more]] = at[more]
            before = prv[at]
            less = before >= 0
            positions = np.concatenate([at[more], before[less]])
            if len(positions):
                add(self.ranks(sym[positions], sym[nxt[positions]]), positions)
        alive = sym >= 0
        raw = sym[alive].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(alive)])[ends] * 4
        return [raw[a:b] for a, b in zip([0, *upto[:-1].tolist()], upto.tolist(), strict=True)]

    def pieces_of(self, chunk: str) -> list[str]:
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def split(self, chunks: list[str]) -> list[list[str]]:
        """The pieces of each chunk without white space and special tokens, by the file's own rules."""
        out: list = [None] * len(chunks)
        rest = []
        for i, c in enumerate(chunks):
            if c.isascii() and c.isalpha():
                out[i] = [c.lower()]
            elif not c.isascii() and WIDE_SPACE.search(c):  # becomes a space, so that parts could not be told from chunks
                out[i] = self.pieces_of(c)
            else:
                rest.append(i)
        if rest:
            # One call for all: normal forms and pieces do not reach over a line break, which becomes a space.
            norm = self.library.normalizer.normalize_str("\n".join([chunks[i] for i in rest]))
            parts = norm.split(" ")
            if len(parts) != len(rest):  # a file whose normaliser makes spaces of its own
                for i in rest:
                    out[i] = self.pieces_of(chunks[i])
            else:
                ends = np.cumsum([len(p) + 1 for p in parts]).tolist()
                k, found = 0, []
                for piece, (_, end) in self.library.pre_tokenizer.pre_tokenize_str(norm):
                    while end > ends[k]:
                        out[rest[k]] = found
                        k, found = k + 1, []
                    found.append(piece)
                for k in range(k, len(rest)):
                    out[rest[k]], found = found, []
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        plain: list[str] = []
        parts: list[list[str]] = []  # of the chunks that hold a special token
        for c in chunks:
            found = [x for x in self.at_special.split(c) if x] if "<|" in c else [c]
            parts.append(found)
            plain += [x for x in found if x not in self.special]
        split = self.split(plain)
        unknown = list({p for s in split for p in s if p not in self.pieces})
        if len(self.pieces) + len(unknown) > CACHE_CHUNKS:
            self.pieces = {}
            unknown = list({p for s in split for p in s})
        self.pieces.update(zip(unknown, self.merged(unknown), strict=True))
        known, each = self.pieces, iter(split)
        return [b"".join([self.special[x].to_bytes(4, "little") if x in self.special else b"".join([known[p] for p in next(each)])
                          for x in found]) for found in parts]

    def decode(self, ids) -> str:
        """What decode(ids, skip_special_tokens=False) gives without a decoder: the tokens with spaces between."""
        return " ".join([self.tokens[i] for i in ids])

    def known(self, chunks: list[str]) -> dict[str, tuple[bytes, str | None]]:
        """Ids and decoded text of all these chunks (None where there is no id)."""
        missing = list({c for c in chunks if c not in self.chunks})
        if len(self.chunks) + len(missing) > CACHE_CHUNKS:
            self.chunks = {}
            missing = list(set(chunks))
        for chunk, raw in zip(missing, self.encode_chunks(missing), strict=True):
            self.chunks[chunk] = (raw, self.decode(np.frombuffer(raw, "<u4").tolist()))
        return self.chunks


@cache
def tokenizer(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encode_texts(bpe: PairIndexBpe, texts: pa.Array) -> Iterator[tuple[bytes, str]]:
    """For each text its ids as little-endian 32-bit numbers and the decoded text."""
    flat, ends = words(filled(texts))
    coded = flat.dictionary_encode()
    chunks = coded.dictionary.to_pylist()
    known = bpe.known(chunks)
    found = [known[c] for c in chunks]  # once per distinct chunk; a word is then a number
    at, ends = coded.indices.to_pylist(), ends.tolist()
    for a, b in zip(ends, ends[1:], strict=False):
        each = [found[i] for i in at[a:b]]
        yield b"".join([x[0] for x in each]), " ".join([x[1] for x in each if x[0]])


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `ids` (array of int) and `decoded` text. A map over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            found = list(encode_texts(tokenizer(path), batch.column("text")))
            lists = pa.array([np.frombuffer(ids, "<i4") for ids, _ in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array([t for _, t in found], pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """`doc_id, n_tokens, ids_sha256, decoded_sha256` of every row: the digests of `encode`, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=SLICE):
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    for ids, text in encode_texts(tokenizer(path), batch.column("text"))]
            n, ids, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                              pa.array(texts, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
