"""The training-data operators beside brute force, on odd and on ordinary rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from causeway.llm import bpe, fingerprints, jaccard, mtree, packing, ppm, quality, substrings, token_counts, toxicity
from causeway.llm.common import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(f"w{i}" for i in range(20_000))
ROWS = [
    (1, " ".join(BASE), "a"), (2, " ".join(BASE), "b"), (3, " ".join([*BASE, "extra"]), "a"), (4, None, "a"), (5, "", None),
    (6, " \t\n ", "a"), (7, "two words", "a"), (8, "Two  words", "a"), (9, "ÉTÉ İstanbul ΣΑΣ <|endoftext|> don't I'LL 12 \x1c\x85 é 日本 🎉", "b"),
    (10, LONG, "a"), (11, LONG + " tail", "a"), (12, "intro " + " ".join(BASE[:15]) + " outro", "c"), (12, "intro " + " ".join(BASE[:15]) + " outro", "c"),
    (None, "no id here", "a"), (14, "x" * 50_000, "a"), (15, "aaaa aaaaa aaaaaa lll", "a"),
]


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Also a column whose names clash with those of the operators."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    for name in ("key", "n", "score", "bucket", "ids", "k", "tie", "hits", "shingles"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_bpe_is_the_library(odd, none):
    library = Tokenizer.from_file(path := P.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
             hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(odd, path).collect()) == want
    assert bpe.encode(none, path).collect() == []


def test_bpe_asks_for_each_chunk_of_a_slice_once(monkeypatch):
    tokenizer, asked = bpe.tokenizer(P.path("word_bpe_49k.json")), []
    known = tokenizer.known
    monkeypatch.setattr(tokenizer, "known", lambda chunks: (asked.extend(chunks), known(chunks))[1])
    got = list(bpe.encode_texts(tokenizer, pa.array(["one two one", None, "", "two one"])))
    assert sorted(asked) == ["one", "two"]
    assert [t for _, t in got][1:3] == ["", ""] and len(got) == 4


def sets_of(rows):
    out = {}
    for i, text, _ in rows:
        w = WORD.findall(fold(text))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_jaccard_components(spark, odd, none, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", chunk)
    rng = np.random.default_rng(3)
    extra = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for c in range(12):
            own = list(base)
            for k in rng.integers(0, 60, size=c % 4):
                own[k] = f"edit{g}{c}{k}"
            extra.append((100 + 20 * g + c, " ".join(own), "a"))
    rows = ROWS + extra
    sets, root = sets_of(rows), {}
    sets.pop(None)
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if root[a] != root[b] and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
                    changed = True
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {(i, len(s), root[i]) for i, s in sets.items()}
    assert jaccard.jaccard_components(none).collect() == []


def test_jaccard_meets_a_large_group_once(spark, monkeypatch):
    """Of a cluster over many chunks copies meet by one member each, and a candidate pair is made once."""
    monkeypatch.setattr(jaccard, "CHUNK_TOKENS", 2000)
    base = [f"w{k}" for k in range(60)]
    copies = [(i, " ".join([*base[:-1], f"own{i}"]), "a") for i in range(80)]
    # Half of these is the group's passage: no copies, but in its cluster.
    halves = [(100 + i, " ".join([*base[:30], *[f"x{i}y{k}" for k in range(30)]]), "a") for i in range(40)]
    seen = {}
    across = jaccard._across

    def spy(sets, met, comps):
        seen["components"] = comps.where("doc_id < 80").select("component").distinct().count()
        seen["pairs"] = jaccard._candidates(met, comps).count() if hasattr(jaccard, "_candidates") else None
        return across(sets, met, comps)

    monkeypatch.setattr(jaccard, "_across", spy)
    got = jaccard.jaccard_components(spark.createDataFrame(copies + halves, "doc_id long, text string, source string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 80 else i for i, _, _ in copies + halves}
    assert seen["components"] == 1 and seen["pairs"] <= 120


def test_substrings(odd, none):
    owner, words_of = {}, [(i, WORD.findall(t or "")) for i, t, _ in ROWS]
    for i, w in words_of:
        for k in range(len(w) - 12):
            if i is not None:
                owner[tuple(w[k : k + 13])] = min(owner.get(tuple(w[k : k + 13]), i), i)
    want = Counter()
    for i, w in words_of:
        gone = {p for k in range(len(w) - 12) if i is not None and owner[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in substrings.remove_repeats(odd).collect()) == want
    assert substrings.remove_repeats(none).collect() == []


def test_packing(odd, none):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    rows = packing.pack(odd, *args).collect()
    ids = Counter()
    for i, text, _ in ROWS:
        ids[i, np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (i, raw), times in ids.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[i])
        assert sum(p[1] for p in pieces) * 4 == times * len(raw)
        assert all(zlib.crc32(raw[4 * s : 4 * (s + n)]) == c for s, n, c in pieces)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(r.length for r in pieces) <= 2048
    assert packing.pack(none, *args).collect() == []


def test_ppm_base_and_model(odd, none):
    rows = ppm.score_documents(odd).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, [*WORD.findall(fold(t)), "\n"]) for i, t, _ in ROWS]
    counts = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter((i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 4))
                   for i, t in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(r.score <= 0 for r in rows)
    assert ppm.score_documents(none).collect() == []


def test_ppm_probabilities_sum_to_one(spark):
    """Over all 256 bytes that may follow, seen or not, in contexts that occur and in one that does not."""
    texts = pa.array([r.text for r in table(spark, SF, "documents").limit(40).collect()])
    seen, n = np.unique(ppm.grams(*ppm.symbols(texts)), return_counts=True)
    contexts = [int.from_bytes(c[-ppm.ORDER :], "big") for c in (b"of the", b"zzzzzz", b"\n\n\n\n\nT")] + [int(seen[len(seen) // 2]) >> 8]
    asked = {c << 8 | b for c in contexts for b in range(256)} - set(seen.tolist())
    counted = spark.createDataFrame([*zip(seen.tolist(), n.tolist()), *((g, 0) for g in asked)], "key long, n long")
    logs = {r.key: r.value for r in ppm.gram_logs(counted).collect()}
    for c in contexts:
        assert sum(10 ** logs[c << 8 | b] for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_ppm_beats_the_base_where_it_learned(spark):
    rows = ppm.score_documents(table(spark, SF, "documents")).agg(F.sum(F.when(~F.col("held_out"), F.col("score"))).alias("s"),
                                                                  F.sum(F.when(~F.col("held_out"), F.col("base_score"))).alias("b")).first()
    assert rows.s > rows.b


@pytest.mark.parametrize("operator, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.95)])
def test_classifiers_on_held_out_rows(spark, operator, label, least):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    scored = operator.classify(table(spark, sf, "documents"), labels).where("held_out").join(labels, "doc_id")
    rows = scored.groupBy(label).agg(F.avg((F.col("predicted") == F.col(label)).cast("int")).alias("right")).collect()
    assert all(r.right >= least for r in rows)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, none, operator):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (4, 0, 1), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        rows = operator.classify(odd, known).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert operator.classify(none, labels).collect() == []


def test_token_counts(spark, odd, none):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    args = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    counter = token_counts.ChunkCounter(packing.encoder(*args))
    rng = np.random.default_rng(5)
    parts = ["a", " ", "\n", "don't", "é", " ", "  ", "123", "!?", "", "word more"]
    for _ in range(150):
        text = "".join(rng.choice(parts, size=rng.integers(0, 40)))
        tree = token_counts.CountTree(text, counter)
        for _ in range(6):
            place, cut, new = int(rng.integers(0, len(text) + 3)), int(rng.integers(0, 8)), "".join(rng.choice(parts, size=3))
            tree.edit(place, cut, new)
            text = text[: min(place, len(text))] + new + text[min(place, len(text)) + cut :]
            assert tree.text() == text
            assert tree.count() == len(library.encode(text, add_special_tokens=False).ids)
    edits = F.lit(None).cast("array<struct<place:bigint,deleted:bigint,inserted:string>>")
    assert all(r.n_tokens == r.edited_n_tokens for r in token_counts.count_with_edits(odd, edits, *args).collect())
    assert token_counts.count_with_edits(none, edits, *args).collect() == []


def test_fingerprints(spark, odd, none):
    rows = fingerprints.fingerprints_with_edits(odd).collect()
    order = sorted({(i, t or "") for i, t, _ in ROWS}, key=lambda x: -(1 << 63) if x[0] is None else x[0], reverse=True)
    got = {(r.doc_id, r.edited_sha256) for r in rows}
    want = set()
    for k, (i, t) in enumerate(order):
        m = len(t) // 2
        want.add((i, hashlib.sha256((t[: len(t) - m] + order[(k + 1) % len(order)][1][:m]).encode()).hexdigest()))
    assert got == want and len(rows) == len(order)
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[1] == prints[2] and prints[4] == prints[5] == ""
    assert fingerprints.fingerprints_with_edits(none).collect() == []


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(400)] + [
        (400, None), (401, []), (402, [float("nan")] * 8), (403, [None] * 8), (404, [1.0, 2.0]), (450, [1.0, 2.0]), (None, [0.0] * 8)]
    vectors += [(500, vectors[0][1]), (501, vectors[0][1])]
    df = mtree.whole_numbers(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))
    usable = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in vectors
              if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in usable if i % 50 == 0):
        best = sorted((-int(usable[q] @ v), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:5]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in mtree.top_k(df, df.where("vec_id % 50 = 0")).collect()} == want
    assert mtree.top_k(df.where("false"), df).collect() == []


def test_top_k_of_great_numbers(spark):
    """Products beyond 53 bits stay exact, those beyond 64 bits are refused instead of wrapped."""
    for scale in (10**3, 10**8, 2 * 10**9):
        vectors = [(i, [int(scale * np.cos(i * k + k)) for k in range(2)]) for i in range(60)]
        df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
        want = {(q, n, i, -s) for q in (0, 50) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(vectors[q][1], v)), i) for i, v in vectors if i != q)[:5], 1)}
        assert {tuple(r) for r in mtree.top_k(df, df.where("vec_id % 50 = 0")).collect()} == want
    wide = spark.createDataFrame([(i, [10**17 + i]) for i in range(9)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="64 bits"):
        mtree.top_k(wide, wide.where("vec_id = 0")).collect()


def test_pipeline_keeps_clean_rows_and_shapes(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()


def ppm_by_hand(learned, text):
    """The log10 probability of a text under all contexts of up to 5 bytes of (text, times), byte by byte."""
    bytes_of = lambda t: b"\n" * ppm.ORDER + " ".join(WORD.findall(fold(t))).encode() + b"\n"
    seen = {}
    for t, times in learned:
        b = bytes_of(t)
        for at in range(ppm.ORDER, len(b)):
            for k in range(ppm.ORDER + 1):
                after = seen.setdefault(b[at - k : at], Counter())
                after[b[at]] += times
    out, b = 0.0, bytes_of(text)
    for at in range(ppm.ORDER, len(b)):
        gone = set()
        for k in range(ppm.ORDER, -1, -1):
            left = {s: n for s, n in seen.get(b[at - k : at], {}).items() if s not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if b[at] in left:
                out += math.log10(left[b[at]] / whole)
                break
            out += math.log10(len(left) / whole)
            gone |= set(left)
        else:
            out -= math.log10(256 - len(gone))
    return out


def test_ppm_scores_by_hand(spark, odd):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learned = [(t, 1) for i, t, _ in ROWS if not held(i)]
    want = Counter((i, round(ppm_by_hand(learned, t), 4)) for i, t, _ in ROWS)
    assert any(held(i) for i, _, _ in ROWS)
    assert Counter((r.doc_id, round(r.score, 4)) for r in ppm.score_documents(odd).collect()) == want


def test_ppm_keeps_rare_contexts_of_a_large_corpus(spark):
    common, rare, asked = " ".join(f"{w} {k}" for k, w in enumerate(BASE * 200)), "quartz zephyr vexing jumps", "quartz zephyr jumping"
    times = (9 << 20) // len(common) + 1
    docs = spark.range(times).select(F.col("id").alias("doc_id"), F.lit(common).alias("text"), F.lit(True).alias("training"))
    docs = docs.union(spark.createDataFrame([(-1, rare, True), (-2, asked, False)], docs.schema))
    want = {i: ppm_by_hand([(common, times), (rare, 1)], t) for i, t in ((-1, rare), (-2, asked))}
    got = {r.doc_id: r.score for r in ppm.score(docs).where("doc_id < 0").collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_fingerprints_take_24_samples(odd):
    rows = [r for r in fingerprints.fingerprints_with_edits(odd).collect() if r.fingerprint]
    assert rows and all(len(r.fingerprint) == 24 * 8 for r in rows)


def test_bpe_white_space_beyond_ascii_stays_in_its_chunk():
    """A chunk that is such white space alone and one that holds it: as many parts as chunks."""
    library = Tokenizer.from_file(path := P.path("word_bpe_49k.json"))
    for space in "\u0085        　":
        chunks = ["1a", space, f"b2{space}c3", "d4"]
        got = [np.frombuffer(raw, "<u4").tolist() for raw in bpe.PairIndexBpe(path).encode_chunks(chunks)]
        assert got == [library.encode(c, add_special_tokens=False).ids for c in chunks]


def test_pipeline_cuts_each_text_of_an_id_for_itself(spark):
    import corpus_pipeline

    passage, other = " ".join(BASE), "quite another text of the same id"
    rows = [(1, passage), (2, f"intro  {passage}\toutro"), (2, other), (3, passage), (3, other), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect())
    # The short texts have no window of 13 words; the two of id 3 stay though its copy of the passage goes.
    assert got == Counter([(1, passage, len(passage)), (2, "intro outro", 11), (2, other, len(other)), (3, other, len(other)), (3, None, 0)])
