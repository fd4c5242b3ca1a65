"""Scores of texts under a byte model: prediction by partial matching with symbol exclusion.

The model is all byte contexts of the training documents up to `ORDER` bytes, with the counts of the bytes
that follow. A text is scored as its words, A-Z lower-cased, with one space between, and one end byte. A
byte is looked up in its longest known context; if it is not among the bytes seen there, the escape is
paid and the next shorter context is asked, without the bytes that the longer one has already excluded;
last comes an even share of the bytes never seen. The escape estimate is method C: one count for each
distinct byte of a context.

Nothing is pruned, and the model stays in Spark. The probability of a byte depends on the gram of its
context and itself alone, so each bucket of documents sends each of its grams once, with how often its
training texts have it (0 where only others do), and gets back the logarithm. The summed grams are cut to
ever shorter ones, a table per order; from order 0 upwards each table takes from the shorter grams what
an escape leads to. A gram has at most 256 extensions by one byte, so no key of these joins and windows
is hot, however often its text occurs.

The unigram base of the same texts needs the count of every word of every document. Documents are
dealt to buckets of about `BUCKET_BYTES`; a bucket sends each of its words once, not once per document,
gets back the word's total and adds up its documents. Words are known by 64-bit hashes; grams are whole.

Null and empty texts are scored as the end alone. Repeated rows count as often as they occur, in
training too. Without training text every byte has the probability 1/256. The sum of one bucket and
that of the counts never depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import U, held_out, keep, signed, slices, word_hashes, words
from causeway.llm.features import raw_bytes

ORDER = 5
BUCKET_BYTES = 16 << 20
END, SPACE = 10, 32
WORD, GRAM, OWN_WORD = 0, 1, 2  # kinds of keys; an own word is counted by its first bucket
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = SPACE
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[9:14] = SPACE


def symbols(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text with one space between, closed by END, as bytes, and where each text starts."""
    raw, ends = raw_bytes(texts)
    # Room for the end of each text, as white space that follows everything.
    number = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    data = np.full(len(raw) + len(ends) - 1, SPACE, np.uint8)
    data[np.arange(len(raw)) + number] = (FOLD if fold else PLAIN)[raw]
    stops = ends[1:] + np.arange(len(ends) - 1)  # places of the ends
    starts = ends[:-1] + np.arange(len(ends) - 1)
    blank = data == SPACE
    seen = np.cumsum(~blank)
    before = np.concatenate([[0], seen])[starts]
    within = seen > np.repeat(before, stops - starts + 1)
    kept = ~blank
    kept[:-1] |= within[:-1] & ~blank[1:]
    kept[stops] = True
    data[stops] = END
    upto = np.concatenate([[0], np.cumsum(kept)])
    return data[kept], np.append(upto[starts], upto[-1])


def grams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte the bytes before it (the nearest lowest, END before the start) and itself in the lowest bits."""
    place = np.arange(len(data)) - np.repeat(ends[:-1], np.diff(ends))
    key = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        shifted = np.empty(len(data), np.int64)
        shifted[:k], shifted[k:] = END, data[:-k] if len(data) > k else data[:0]
        shifted[place < k] = END
        key |= shifted << (8 * k)
    return key


class Slots:
    """Values of distinct keys, grouped by a hash for quick look-up."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 1)
        slot = self.slot(keys)
        order = np.argsort(slot, kind="stable")
        self.keys, self.values = np.append(keys[order], -1), np.append(values[order], 0.0)
        self.starts = np.searchsorted(slot[order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max()) if len(keys) else 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), np.nan)
        slot = self.slot(wanted)
        at, stop = self.starts[slot], self.starts[slot + 1]
        left = np.arange(len(wanted))
        for _ in range(self.deepest):
            hit = (self.keys[at] == wanted[left]) & (at < stop)
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (at + 1 < stop)
            left, at, stop = left[on], at[on] + 1, stop[on]
        return out


def text_scores(texts: pa.Array, logs: Slots) -> np.ndarray:
    data, ends = symbols(texts)
    out = logs[grams(data, ends)]
    upto = np.concatenate([[0.0], np.cumsum(out)]) if len(out) < 1000 else None
    if upto is not None:
        return upto[ends[1:]] - upto[ends[:-1]]
    return np.add.reduceat(out, ends[:-1])  # no text is without bytes: each has its END


def gram_logs(counted: DataFrame) -> DataFrame:
    """`key, value`: the log10 probability of the last byte of each gram of `key, n`, where n may be 0.

    p is what a gram costs where its context is asked first, u what it costs once its context has escaped.
    """
    tables = [keep(counted.groupBy("key").agg(F.sum("n").alias("n")), "grams")]
    for order in range(ORDER - 1, -1, -1):
        short = F.expr(f"key & {(1 << (8 * (order + 1))) - 1}L")
        tables.insert(0, keep(tables[0].groupBy(short.alias("key")).agg(F.sum("n").alias("n")), "grams"))
    # Of order 0, at most 256 rows, all share the empty context.
    whole, d = tables[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    floor = -float(np.log10(max(256 - d, 1)))
    known = tables[0].withColumns({"whole": F.lit(whole).cast("long"), "d": F.lit(d).cast("long"), "u": F.lit(floor), "below": F.lit(floor)})
    first = F.expr("case when whole = 0 then below when n > 0 then log10(n) - log10(whole + d) else log10(d) - log10(whole + d) + u end")
    known = known.withColumn("p", first)
    for order in range(1, ORDER + 1):
        shorter = known.select(F.col("key").alias("short"), *[F.col(c).alias(f"{c}1") for c in ("n", "whole", "d", "p", "u")])
        joined = (tables[order].withColumn("short", F.expr(f"key & {(1 << (8 * order)) - 1}L")).join(shorter, "short")
                  .withColumn("context", F.shiftright("key", 8)))
        same = Window.partitionBy("context")
        seen = F.col("n") > 0
        facts = joined.withColumns({"whole": F.sum("n").over(same), "d": F.sum(F.when(seen, 1).otherwise(0)).over(same),
                                    "gone": F.sum(F.when(seen, F.col("n1")).otherwise(0)).over(same)})
        # Of the shorter context, the counts of the bytes left and how many there are; without any, all go further down.
        facts = facts.withColumn("others", F.expr("d1 - d")).withColumn("rest", F.expr("whole1 - gone + others"))
        facts = facts.withColumn("u", F.expr("case when others <= 0 then u1 when n1 > 0 then log10(n1) - log10(rest)"
                                             " else log10(others) - log10(rest) + u1 end")).withColumn("below", F.col("p1"))
        known = facts.select("key", "n", "whole", "d", "u", first.alias("p"))
    return keep(known.select("key", F.col("p").alias("value")), "gram_logs")


def score(docs: DataFrame, training: str = "training") -> DataFrame:
    """Model and base score of every row of `docs` (doc_id, text and the boolean `training`)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col(training).alias("training"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = n_bytes // BUCKET_BYTES + 1
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))

    def counts(key, group):
        learn = np.asarray(group["training"].combine_chunks().to_numpy(zero_copy_only=False), np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2

        def add(kind: int, keys: np.ndarray, n: np.ndarray) -> None:
            keys, at = np.unique(np.concatenate([found[kind][0], keys]), return_inverse=True)
            found[kind] = keys, np.bincount(at, np.concatenate([found[kind][1], n]), minlength=len(keys)).astype(np.int64)

        for batch in slices(group.append_column("_learn", pa.array(learn)).to_batches()):
            use = batch.column("_learn").to_numpy()
            flat, ends = words(batch.column("text"), lower=True)
            add(WORD, signed(word_hashes(flat)), np.repeat(use, np.diff(ends)))
            data, ends = symbols(batch.column("text"))
            each, learned = grams(data, ends), np.repeat(use, np.diff(ends)) > 0
            new, n = np.unique(each[learned], return_counts=True)
            others = np.unique(each[~learned])
            add(GRAM, np.concatenate([new, others]), np.concatenate([n, np.zeros(len(others), np.int64)]))
        keys, n = (np.concatenate(x) for x in zip(*found, strict=True))
        kind = np.repeat(np.array([WORD, GRAM], np.int8), [len(x) for x, _ in found])
        return pa.table({"bucket": pa.array(np.full(len(keys), key[0].as_py()), pa.int32()), "kind": kind, "key": keys, "n": n})

    per_bucket = keep(dealt.groupBy("bucket").applyInArrow(counts, "bucket int, kind byte, key long, n long"), "counts", sorted_numbers=True)
    same = Window.partitionBy("key")
    word_totals = per_bucket.where(F.col("kind") == WORD).select(
        "bucket", F.when(F.min("bucket").over(same) == F.col("bucket"), OWN_WORD).otherwise(WORD).cast("byte").alias("kind"), "key",
        F.sum("n").over(same).cast("double").alias("value"))
    bucket_grams = per_bucket.where(F.col("kind") == GRAM)
    totals = word_totals.unionByName(bucket_grams.select("bucket", "key").join(gram_logs(bucket_grams), "key")
                                    .select("bucket", F.lit(GRAM).cast("byte").alias("kind"), "key", "value"))

    def work(key, group, known):
        kind, keys, value = (known[c].to_numpy() for c in ("kind", "key", "value"))
        logs_of = Slots(keys[kind == GRAM], value[kind == GRAM])
        order = np.flatnonzero(kind != GRAM)
        order = order[np.argsort(keys[order], kind="stable")]
        vocabulary, total = keys[order], value[order]
        logs = np.log10(total + 1.0)
        kinds = ["doc_id", "training", "n_tokens", "n_known", "logs", "score", "own_tokens", "own_words"]
        out: list[list] = [[] for _ in kinds]
        learned = 0
        for batch in slices(group.to_batches()):
            flat, ends = words(batch.column("text"), lower=True)
            n = np.diff(ends)
            at = np.searchsorted(vocabulary, signed(word_hashes(flat)))
            values = np.concatenate([[0.0], np.cumsum(logs[at])]) if len(at) else np.zeros(1)
            seen = np.concatenate([[0], np.cumsum(total[at] > 0)]) if len(at) else np.zeros(1, np.int64)
            use = batch.column("training").to_numpy(zero_copy_only=False)
            learned += int((n + 1)[use].sum())
            for c, v in zip(out, (batch.column("doc_id").to_pylist(), use.tolist(), (n + 1).tolist(), (seen[ends[1:]] - seen[ends[:-1]]).tolist(),
                                  (values[ends[1:]] - values[ends[:-1]]).tolist(), text_scores(batch.column("text"), logs_of).tolist()),
                            strict=False):
                c += v
        rows = len(out[0])
        own = (kind[order] == OWN_WORD) & (total > 0)
        out[6], out[7] = [0] * rows, [0] * rows
        for c, v in zip(out, (None, None, 0, 0, 0.0, 0.0, learned, int(own.sum())), strict=True):
            c.append(v)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(kinds, out, types, strict=True)})

    schema = "doc_id long, training boolean, n_tokens long, n_known long, logs double, score double, own_tokens long, own_words long"
    found = keep(dealt.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInArrow(work, schema), "scores")
    # The end is a token of every text: as often in training as there are training texts.
    whole = found.agg(F.sum("own_tokens"), F.sum("own_words"), F.sum(F.col("training").cast("long"))).first()
    tokens, distinct, texts = (int(x or 0) for x in whole)
    distinct += texts > 0
    return found.where("training is not null").select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("n_known") + int(texts > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(texts + 1)) - F.col("n_tokens") * float(np.log10(tokens + distinct + 1))).alias("base_score"), "score")


def score_documents(docs: DataFrame, folds: int = 7) -> DataFrame:
    return score(docs.withColumn("training", ~held_out("doc_id", folds)))
