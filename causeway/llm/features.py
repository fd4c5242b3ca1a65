"""Statistics of texts as matrices, worked out on whole record batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from causeway.llm.common import filled, word_hashes, words

CLASSES = ("lower", "upper", "digit", "space", "newline", "mark", "other")

STATISTICS = ("log_bytes", "log_words", "bytes_per_word", "upper", "digit", "newline", "mark", "other", "upper_words",
              "pipe", "bang", "distinct_words", "same_as_next", "long_words")


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, CLASSES.index("other"))
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"),
                        ("space", " \t\x0b\x0c\r"), ("newline", "\n"), ("mark", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")):
        kinds[np.frombuffer(chars.encode(), np.uint8)] = CLASSES.index(name)
    return kinds


BYTE_CLASS = _byte_classes()


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (nulls empty) and where each text starts."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return upto[ends[1:]] - upto[ends[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS per text, each already on a scale on which the classes are close to normal.

    Shares go through the arc sine of the square root, sizes through log(1 + x). An empty text has zeros.
    """
    data, ends = raw_bytes(texts)
    kinds = BYTE_CLASS[data]
    n = np.maximum(np.diff(ends), 1)
    share = {c: sums(kinds == k, ends) / n for k, c in enumerate(CLASSES)}
    pipe, bang = sums(data == ord("|"), ends) / n, sums(data == ord("!"), ends) / n
    flat, at = words(texts)
    hashes = word_hashes(flat)
    n_words = np.diff(at)
    some = np.maximum(n_words, 1)
    shouted = pc.and_(pc.equal(flat, pc.utf8_upper(flat)), pc.not_equal(flat, pc.utf8_lower(flat))).to_numpy(zero_copy_only=False)
    long = (pc.binary_length(flat).to_numpy(zero_copy_only=False) >= 12) if len(flat) else np.zeros(0, bool)
    same = np.zeros(len(hashes), bool)
    same[:-1] = hashes[:-1] == hashes[1:]
    inside = at[1:][n_words > 0] - 1
    same[inside] = False
    owner = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((hashes, owner))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][new], minlength=len(n_words)) if len(hashes) else np.zeros(len(n_words))
    angle = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    return np.column_stack([
        np.log1p(np.diff(ends)), np.log1p(n_words), np.log1p(np.diff(ends) / some), angle(share["upper"]), angle(share["digit"]),
        angle(share["newline"]), angle(share["mark"]), angle(share["other"]), angle(sums(shouted, at) / some), angle(pipe), angle(bang),
        angle(distinct / some), angle(sums(same, at) / some), angle(sums(long, at) / some)]).astype(np.float64)
