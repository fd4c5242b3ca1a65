"""Removal of passages that repeat across documents, with repeated-phrase automata.

A window is 13 consecutive words of one document. A word goes if it lies in a window whose words also
start in a document of smaller id; windows are judged on the input.

1. Anchors. The anchor of a window is the 4-word run in it with the smallest hash, so equal windows have
   equal anchors. Anchors (about one word in five, one row per anchor and batch) are shuffled to find
   those that two documents share. A window without a shared anchor cannot repeat.
2. Confirmation. Each document gets back its shared anchors; the windows that have one are shuffled by
   hash with their documents, which confirms those that recur and names their owner, the smallest id.
   Documents whose whole word sequence is that of a smaller one are settled here: they lose everything.
3. Automata. Documents with confirmed windows are worked off in slices; the windows of a slice are
   compiled into one Aho-Corasick automaton over numbered words, which finds every
   occurrence in the slice's documents. An occurrence in a document above its owner removes its words.

An automaton is bounded by its slice, so memory does not grow with the corpus; a hot passage is one row
per batch when anchors and windows are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import (KEYS, U, Lists, keep, keys_with_documents, run_hashes, shared_keys, signed, slices,
                                 word_hashes, words)
from causeway.llm.ppm import symbols

WINDOW = 13
ANCHOR = 4
BASE = 48
AUTOMATON_BYTES = 4 << 20  # text that shares an automaton


def windows_and_anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the hash of the window that starts there and its anchor; windows may reach over texts."""
    whole = run_hashes(hashes, WINDOW)
    runs = run_hashes(hashes, ANCHOR)
    anchors = runs[: len(whole)].copy()
    for k in range(1, WINDOW - ANCHOR + 1):
        np.minimum(anchors, runs[k : k + len(whole)], out=anchors)
    return whole, anchors


def inside(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The text of each of the first n places, and whether a window that starts there ends in that text."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:n]
    return row, np.arange(n) + WINDOW <= ends[1:][row] if n else np.zeros(0, bool)


def _distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], rows[new]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flat, ends = words(batch.column("text"))
        _, anchors = windows_and_anchors(word_hashes(flat))
        row, whole = inside(ends, len(anchors))
        new = whole.copy()
        new[1:] &= (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
        keys, rows = _distinct(anchors[new], row[new])
        if len(keys):
            yield keys_with_documents(keys, rows, batch.column("doc_id").to_numpy())


FOUND = "doc_id long, n_words long, whole_sha256 string, sequence long, text string, windows array<long>"


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flat, ends = words(batch.column("text"))
        hashes = word_hashes(flat)
        whole, anchors = windows_and_anchors(hashes)
        row, fits = inside(ends, len(whole))
        shared = batch.column("anchors").flatten()
        # The anchors of all texts of the slice together: at worst a window too many is looked at.
        fits &= np.isin(anchors, shared.to_numpy(zero_copy_only=False).view(U)) if len(shared) else False
        keys, rows = _distinct(whole[fits], row[fits])
        cut = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        found = Lists(pa.int64())
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            found.add(signed(keys[a:b]))
        data, at = symbols(batch.column("text"), fold=False)
        raw, at = data.tobytes(), at.tolist()
        some = np.diff(cut) > 0
        texts = batch.column("text").to_pylist()
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()),
            pa.array([hashlib.sha256(raw[a : b - 1]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
            pa.array(signed(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes()) for a, b in spans], U)), pa.int64()),
            pa.array([t if s else None for t, s in zip(texts, some, strict=True)], pa.string()), found.array()],
            ["doc_id", "n_words", "whole_sha256", "sequence", "text", "windows"])


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("windows")
        sizes = np.diff(column.offsets.to_numpy())
        keys = column.flatten().to_numpy().view(U)
        if len(keys):
            yield keys_with_documents(keys, np.repeat(np.arange(batch.num_rows), sizes), batch.column("doc_id").to_numpy())


def spelled(numbers: np.ndarray, digits: int) -> str:
    """Each number as so many characters, one for each digit to the base BASE, of an alphabet of the digit's own.

    Nodes of the automaton then have few children, and matches cannot begin inside a word.
    """
    places = np.arange(digits)
    return (numbers[:, None] // BASE**places % BASE + places * BASE + 1).astype("<u4").tobytes().decode("utf-32-le")


def covered(numbers: np.ndarray, ends: np.ndarray, doc_ids: list[int], starts: np.ndarray, owners: np.ndarray) -> list[np.ndarray]:
    """For each document which words lie in a phrase of an owner below it.

    `numbers` are the words of all documents, which begin at `ends[:-1]`; a phrase is the window at one of `starts`.
    One automaton serves all documents.
    """
    top, digits = int(numbers.max(initial=0)), 1
    while BASE**digits <= top:
        digits += 1
    text = spelled(numbers, digits)
    automaton = ahocorasick.Automaton()
    for start, owner in zip(starts.tolist(), owners.tolist(), strict=True):
        automaton.add_word(text[start * digits : (start + WINDOW) * digits], owner)
    automaton.make_automaton()
    out = []
    for doc_id, a, b in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        found = [end for end, owner in automaton.iter(text[a * digits : b * digits]) if owner < doc_id]
        last = (np.array(found, np.int64) + 1) // digits
        change = np.bincount(last - WINDOW, minlength=b - a + 1) - np.bincount(last, minlength=b - a + 1)
        out.append(np.cumsum(change[: b - a]) > 0)
    return out


CUT = "doc_id long, sequence long, n_removed long, kept_sha256 string, kept string"


def _cut_rows(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=AUTOMATON_BYTES):
            flat, ends = words(batch.column("text"))
            coded = flat.dictionary_encode()
            index = coded.indices.to_numpy().astype(np.int64)
            hashes = word_hashes(flat)
            whole = run_hashes(hashes, WINDOW)
            row, fits = inside(ends, len(whole))
            listed = batch.column("windows").flatten()
            keys, owners = listed.field("window").to_numpy().view(U), listed.field("owner").to_numpy()
            keys, first = np.unique(keys, return_index=True)
            owners = owners[first]
            fits &= np.isin(whole, keys)
            places, first = np.unique(whole[fits], return_index=True)
            starts = np.flatnonzero(fits)[first]
            owner = owners[np.searchsorted(keys, places)]
            # Numbers for the words of phrases; all others share the number 0.
            used = np.zeros(len(coded.dictionary), bool)
            for k in range(WINDOW):
                used[index[starts + k]] = True
            number = np.where(used, np.cumsum(used), 0)[index]
            hit = covered(number, ends, batch.column("doc_id").to_pylist(), starts, owner) if len(starts) else []
            gone = np.concatenate(hit) if hit else np.zeros(len(index), bool)
            kept_words = flat.filter(pa.array(~gone)).to_pylist()
            upto = np.concatenate([[0], np.cumsum(~gone)])[ends].tolist()
            kept = [" ".join(kept_words[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
            removed = np.diff(ends) - np.diff(upto)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("sequence"), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in kept], pa.string()),
                pa.array(kept if with_text else [None] * len(kept), pa.string())],
                ["doc_id", "sequence", "n_removed", "kept_sha256", "kept"])

    return run


def words_sha256(text: str) -> Column:
    """`whole_sha256` of a text: the digest of its words with one space between."""
    return F.expr(f"sha2(array_join(filter(split(coalesce({text}, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != ''), ' '), 256)")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """`doc_id, n_words, n_removed, kept_sha256` of every row; with `with_text` also `kept`, the words left, where any were removed,
    and `whole_sha256`, the digest of all words, which tells texts of one id apart.

    Null and empty texts have no words. Rows that repeat an id never remove each other's words; repeated
    rows give repeated results. A row without an id keeps everything and removes nothing.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchors = shared_keys(rows.where("doc_id is not null").mapInArrow(_anchor_rows, KEYS))
    lists = anchors.select("key", F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("key").alias("anchors"))
    looked = rows.join(lists, "doc_id", "left").withColumn("anchors", F.coalesce("anchors", F.expr("array()").cast("array<bigint>")))
    every = keep(looked.mapInArrow(_candidate_rows, FOUND), "candidates")

    whole = every.where(f"n_words >= {WINDOW} and doc_id is not null")
    firsts = whole.groupBy("sequence", "n_words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last")) \
        .where("first < _last").drop("_last")
    copies = keep(whole.select("doc_id", "sequence", "n_words").join(firsts, ["sequence", "n_words"]).where("doc_id > first")
                  .select("doc_id", "sequence").distinct(), "copies")
    single = every.where("text is not null and doc_id is not null").join(copies, ["doc_id", "sequence"], "left_anti")
    confirmed = shared_keys(single.select("doc_id", "windows").mapInArrow(_window_rows, KEYS))
    owned = confirmed.select(F.struct(F.col("key").alias("window"), "owner").alias("w"), "owner", F.explode("docs").alias("doc_id"))
    per_doc = owned.where("doc_id > owner").groupBy("doc_id").agg(F.collect_list("w").alias("windows"))
    cut = single.select("doc_id", "sequence", "text").join(per_doc, "doc_id").mapInArrow(_cut_rows(with_text), CUT)
    empty = hashlib.sha256(b"").hexdigest()
    gone = copies.select("doc_id", "sequence", F.lit(None).cast("long").alias("n_removed"), F.lit(empty).alias("kept_sha256"),
                         F.lit("" if with_text else None).cast("string").alias("kept"))
    changed = cut.dropDuplicates(["doc_id", "sequence"]).unionByName(gone).withColumn("changed", F.lit(True))
    out = every.select("doc_id", "n_words", "whole_sha256", "sequence").join(changed, ["doc_id", "sequence"], "left")
    removed = F.when(F.col("changed").isNull(), F.lit(0)).otherwise(F.coalesce("n_removed", "n_words")).cast("long")
    result = out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"), "kept", "whole_sha256")
    return result if with_text else result.drop("kept", "whole_sha256")
