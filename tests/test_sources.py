import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.sources import files, rawlog
from causeway.sources.timestamps import choose_formats, parse_timestamps

LOG = """   orphan one

orphan two
2031-07-09 05:06:07,080 INFO  [depot] (worker lane-7) shelf: tray counted
2026-04-26 00:00:01.5 not a header
2026-04-26 00:00:02,123456 warn no logger
\tat a.b.C(D.java:1)

2026-04-26 00:00:03,001 ERR [x] boom"""


def records(df):
    return sorted((r.timestamp or "", r.log_level, r.logger, r.thread, r.message, r._raw) for r in df.collect())


WANT = sorted([
    ("", "UNKNOWN", "", "", "   orphan one\norphan two", "   orphan one\norphan two"),
    ("2031-07-09 05:06:07,080", "INFO", "depot", "worker lane-7",
     "shelf: tray counted\n2026-04-26 00:00:01.5 not a header",
     "2031-07-09 05:06:07,080 INFO  [depot] (worker lane-7) shelf: tray counted\n2026-04-26 00:00:01.5 not a header"),
    ("2026-04-26 00:00:02,123456", "WARNING", "", "", "no logger\n\tat a.b.C(D.java:1)",
     "2026-04-26 00:00:02,123456 warn no logger\n\tat a.b.C(D.java:1)"),
    ("2026-04-26 00:00:03,001", "ERROR", "x", "", "boom", "2026-04-26 00:00:03,001 ERR [x] boom")])


@pytest.mark.parametrize("width", [1, 2, 100])
def test_records_do_not_depend_on_blocks(spark, width):
    lines = [("f", i // width, i, t) for i, t in enumerate(LOG.split("\n"))]
    df = spark.createDataFrame(lines, "file string, block long, seq long, line string").repartition(5)
    assert records(rawlog.assemble_records(df, "file", "block", "seq", "line")) == WANT


def test_raw_file_read_in_many_splits(spark, tmp_path):
    (tmp_path / "app_log").write_text(LOG + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert files.read_lines(spark, str(tmp_path)).select("block").distinct().count() > 3
        assert records(files.read_raw(spark, str(tmp_path))) == WANT
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted_csv(rng, rows):
    """Rows of text with line breaks, quotes, commas, blank lines inside quotes and out, two kinds of line ends."""
    pieces = ["a", "bc", ",", "\n", "\r\n", '""', "\n\n", " ", "é", "longer words here"]
    out = ['\n\r\nid,"first\nname",text\n']
    for i in range(rows):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        out.append(f'{i},"{text}",plain{i}{rng.choice(["", "x" * 90])}' + rng.choice(["\n", "\r\n"]))
        out.append(rng.choice(["", "", "\n", "  \r\n"]))
    return "".join(out)


def test_quoted_line_breaks_are_read_in_many_splits(spark, tmp_path, small_splits):
    import random
    for i in range(3):
        (tmp_path / f"f{i}.csv").write_bytes(quoted_csv(random.Random(i), 40).encode())
    schema = "id long, name string, text string"
    assert files.read_lines(spark, str(tmp_path), "utf-8", "\n").select("file", "block").distinct().count() > 60
    got = files.read_csv(spark, str(tmp_path), schema=schema)
    want = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(str(tmp_path)).where("id is not null")
    want = want.withColumn("text", F.regexp_replace("text", "\r$", ""))  # one reader per file leaves it there
    assert sorted((tuple(r)[1:] for r in got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and want.count() == 120
    assert files.read_csv(spark, str(tmp_path), infer=False).columns == ["event_id", "id", "first\nname", "text"]


@pytest.mark.parametrize("multi_line", [True, False])
def test_ids_do_not_depend_on_splits_or_their_packing(spark, tmp_path, multi_line):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("host,message\n" + "".join(f"h{i},m{n}\n" for n in range(30 + 20 * i)))

    def ids(split, cost):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        try:
            rows = files.read_csv(spark, str(tmp_path), schema="host string, message string", multi_line=multi_line).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert len({r.event_id for r in rows}) == len(rows) == 150
        return sorted(map(tuple, rows))

    one = ids("128m", "1")
    assert one == ids("128m", "100m") == ids("64", "1") == ids("200", "1") == ids("1000", "1")
    assert [r[2] for r in one if r[1] == "h1"] == [f"m{n}" for n in range(50)]  # ids sort as the rows stand in the file


def test_raw_text_before_the_first_header_comes_in_parts(spark, tmp_path, small_splits, monkeypatch):
    from causeway.sources import segments
    (tmp_path / "app_log").write_text("".join(f"loose {i}\n\n" for i in range(50)) + LOG)
    whole = files.read_raw(spark, str(tmp_path)).where("record_no = 0").collect()
    assert [r._raw.count("\n") for r in whole] == [51]
    text, cut = whole[0]._raw, segments._cut(False)
    lines = text.split("\n")
    monkeypatch.setattr(segments, "LOOSE_LINES", 8)
    for width in (3, 8, 20, 100):
        batches = [pa.RecordBatch.from_pydict({
            "file": ["f"] * len(part), "block": [at] * len(part), "line": part, "mark": pa.array([0] * len(part), pa.int32()), "records": [0] * len(part),
            "lines": [at] * len(part), "odd": [False] * len(part)}) for at in range(0, len(lines), width) if (part := lines[at : at + width])]
        found: dict[int, list[str]] = {}
        for b in cut(iter(batches)):
            for row in b.to_pylist():
                assert (row["record_no"], row["inner"]) == (0, False)
                found.setdefault(row["part"], []).append(row["text"])
        assert ["\n".join(found[k]) for k in sorted(found)] == ["\n".join(lines[i : i + 8]) for i in range(0, len(lines), 8)]


def test_a_table_of_lines_is_dealt_out_once(spark):
    """One exchange carries the lines, whatever reads them; reading files takes none."""
    lines = [("f", i // 2, i, t) for i, t in enumerate(LOG.split("\n"))]
    df = spark.createDataFrame(lines, "file string, block long, seq long, line string")
    got = rawlog.assemble_records(df, "file", "block", "seq", "line")
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    wide = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "REPARTITION_BY_COL" in x and "Reused" not in x]
    assert len(wide) == 1 and "ReusedExchange" in plan


def test_files_are_routed_by_content(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("\n\n2026-04-26 00:00:00,030 INFO x\n")
    (tmp_path / "plain.csv").write_text("host,message\na,b\n")
    (tmp_path / "wide.csv").write_bytes('host,message\na,"é\nb"\n'.encode("latin-1"))
    found = {r.file.rsplit("/", 1)[1]: (r.format, r.encoding, r.multi_line) for r in files.route_files(spark, str(tmp_path)).collect()}
    assert found == {"raw.txt": ("raw", "utf-8", False), "plain.csv": ("csv", "utf-8", False), "wide.csv": ("csv", "latin-1", True)}
    tables = files.load_logs(spark, str(tmp_path))
    assert tables["raw", "utf-8", False, None].first().message == "x"
    assert tables["csv", "latin-1", True, "host,message"].first().message == "é\nb"


@pytest.mark.parametrize("requested, data, want", [
    ("utf-8", "é".encode(), "utf-8"), ("utf-8", b"\xe9", "latin-1"), ("ascii", "é".encode(), "utf-8-sig"),
    ("cp1252", b"\x81x", "latin-1"), ("cp1252", b"\x80x", "cp1252"), ("latin-1", b"\xff", "latin-1")])
def test_encoding_order(spark, tmp_path, requested, data, want):
    (tmp_path / "f").write_bytes(data + b"\n")
    assert files.detect_encoding(spark, str(tmp_path), requested).first().encoding == want


def test_encoding_of_a_source_of_many_files(spark, tmp_path):
    for folder, data in (("a", ["x".encode(), "é".encode("latin-1")]), ("b", ["x".encode(), "é".encode()])):
        (tmp_path / folder).mkdir()
        for i, d in enumerate(data):
            (tmp_path / folder / f"{i}").write_bytes(d + b"\n")
    folder = F.regexp_extract("_metadata.file_path", "/([^/]+)/[^/]+$", 1)
    found = files.detect_encoding(spark, f"{tmp_path}/*", source=folder).collect()
    assert {(r.file, r.encoding) for r in found} == {("a", "latin-1"), ("b", "utf-8")}


def test_no_language_is_written_by_one_task(spark, tmp_path, monkeypatch):
    from __spark_entry__ import queries

    spark.range(400).selectExpr("id AS doc_id", "IF(id = 7, 'é', 'plain') AS text", "'en' AS lang").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("causeway.catalog.sources.shared_dir", lambda spark, purpose: f"{tmp_path}/shared/{purpose}")
    rows = queries()["detect_encoding"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {("en", "written as utf-8", "utf-8"), ("en", "written as latin-1", "latin-1")} and len(rows) == 2
    for written in (tmp_path / "shared").iterdir():
        assert len(list((written / "lang=en").glob("part-*"))) == 4


def test_file_fingerprint_is_that_of_the_bytes(spark, tmp_path):
    import hashlib
    (tmp_path / "f").write_bytes(b"abc")
    row = files.file_fingerprints(spark, str(tmp_path)).first()
    assert row.incident_id == hashlib.md5(b"abc").hexdigest()[:8].upper()
    assert row.sha256 == hashlib.sha256(b"abc").hexdigest()


def test_table_fingerprint_counts_copies_but_not_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n long, t string")
    one = files.table_fingerprint(a).first()
    assert one == files.table_fingerprint(a.orderBy(F.desc("n")).repartition(3)).first()
    assert one != files.table_fingerprint(a.distinct()).first()


@pytest.mark.parametrize("texts, kind, want", [
    (["1705000000", "1705000001.5"], "seconds", "2024-01-11 19:06:40"),
    (["1705000000000", "1705000000001"], "millis", "2024-01-11 19:06:40"),
    (["2024-03-15T08:00:00+02:00", "bad", "2024-03-15T08:00:00Z"], "iso_zone", "2024-03-15 06:00:00"),
    (["2024-03-15T08:00:00.25Z"], "iso_fraction_zone", "2024-03-15 08:00:00.25"),
    (["2024-03-15 08:00:00,125"], "sql_comma_fraction", "2024-03-15 08:00:00.125"),
    (["15/Mar/2024:08:00:00 +0100"], "access_log", "2024-03-15 07:00:00"),
    (["Feb 29 08:00:00"], "syslog", "2024-02-29 08:00:00"), (["Mar  5 08:00:00"], "syslog", "2024-03-05 08:00:00"),
    (["03/15/2024 08:00:00"], "us", "2024-03-15 08:00:00"), (["15-03-2024 08:00:00"], "day_first", "2024-03-15 08:00:00")])
def test_formats(spark, texts, kind, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string")
    assert choose_formats(df, ["t"], 2024)["t"].kind == kind
    got = parse_timestamps(df, "t", 2024).orderBy("n").select(F.col("t").cast("string")).first()[0]
    assert got == want


def test_every_format_is_voted_for_in_tasks_of_bounded_rows(spark, tmp_path):
    from causeway.catalog.scalars import _RENDERED, timestamp_strings

    times = spark.range(600_001).selectExpr("id AS event_id", "timestamp_micros(1704067211172425 + id) AS ts")
    times.write.parquet(f"{tmp_path}/events.parquet")
    strings = timestamp_strings(spark, str(tmp_path))
    assert strings.rdd.getNumPartitions() == 7
    few = strings.where("event_id < 3")
    assert {c: f.kind for c, f in choose_formats(few, few.columns[1:], 2024).items()} == {
        **{n: n for n, _, _ in _RENDERED}, "epoch_seconds": "seconds", "epoch_millis": "millis"}
    assert choose_formats(strings.where("event_id < 0"), ["iso"], 2024)["iso"].kind == "inferred"


def test_other_formats_become_null_unless_read_per_row(spark):
    rows = [(0, "2024-03-15 08:00:00"), (1, "2024-03-15 08:00:01"), (2, "15-03-2024 08:00:00")]
    df = spark.createDataFrame(rows, "n long, t string")
    assert parse_timestamps(df, "t").where("t is null").count() == 1
    assert parse_timestamps(df, "t", per_row=True).where("t is null").count() == 0


@pytest.mark.parametrize("numbers, kind", [
    ([5.0, 5.0, 1.5e9, 1.6e9, 1.7e9], "seconds"),
    ([5.0, 1.5e9], "inferred"),  # the mean of the middle two is below the range
    ([0.9e9, 1.9e9], "seconds"),  # here it is inside
    ([1.5e9, 9e9], "inferred"),
    ([1.5e12, 1.6e12, 3e12], "millis"),
])
def test_epoch_unit_by_exact_median(spark, numbers, kind):
    df = spark.createDataFrame([(x,) for x in numbers], "t double")
    assert choose_formats(df, ["t"])["t"].kind == kind


def tree_by_hand(data, leaf, branch):
    import hashlib
    sha = lambda t: hashlib.sha256(t).hexdigest()
    lines = data.split(b"\n")
    level = [sha(x) for x in (lines[:-1] if data.endswith(b"\n") else lines)]
    n = len(level)
    for width in (leaf, branch):
        level = [sha("".join(level[i : i + width]).encode()) for i in range(0, len(level), width)]
    return sha(f"{len(data)}:{n}:{''.join(level)}".encode())


def test_tree_fingerprint_of_bytes_in_any_splits(spark, tmp_path):
    from causeway.sources import custody
    files_ = {"a": b"".join(b"line %d\r\n" % i for i in range(300)), "b": b"\xff\xfe\x00 no utf-8\n\n\nlast without end", "c": b"\n"}
    for name, data in files_.items():
        (tmp_path / name).write_bytes(data)
    found = []
    for split in ("64", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found.append({r.file[-1]: (r.n_bytes, r.tree_sha256) for r in custody.tree_fingerprints(spark, str(tmp_path), 7, 3).collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == found[2] == {k: (len(d), tree_by_hand(d, 7, 3)) for k, d in files_.items()}
    (tmp_path / "b").write_bytes(files_["b"] + b"\n")  # the same lines, one byte more
    assert custody.tree_fingerprints(spark, str(tmp_path / "b"), 7, 3).first().tree_sha256 != found[0]["b"][1]
