import gzip
import random

import psutil
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom import sources
from seqloom.operators import validate
from seqloom.session import scratch_path
from tests.helpers import rows

VALID = [(f"item{i}", f"user{i // 4}", str(i)) for i in range(200)]


def write(tmp_path, data, header="item_id,user_id,timestamp", bom=False):
    path = tmp_path / "log.csv"
    body = "\n".join([header, *[",".join(r) for r in data]]) + "\n"
    path.write_text(body, encoding="utf-8-sig" if bom else "utf-8")
    return str(path)


def violations(spark, path):
    raw = sources.readers.read_raw_interactions(spark, path)
    return {r["check"] for r in validate.check_interactions(sources.read_interactions(spark, path), raw).collect()}


def test_valid_file_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path, VALID, bom=True)
    assert validate.check_headers(spark, path).count() == 0
    assert violations(spark, path) == set()
    assert rows(validate.interaction_summary(sources.read_interactions(spark, path))) == [(50, 200, 200)]


def test_reordered_header_is_reported(spark, tmp_path):
    path = write(tmp_path, VALID, header="user_id,item_id,timestamp")
    found = validate.check_headers(spark, path).collect()
    assert [r["header"] for r in found] == ["user_id,item_id,timestamp"]
    assert found[0]["file"].endswith("log.csv")


def test_headers_need_the_first_bytes_only(spark, tmp_path):
    files = {"good.csv": b"item_id,user_id,timestamp\n", "mark.csv": b"\xef\xbb\xbfitem_id,user_id,timestamp\r\na,b,1\r\n", "bad one.csv": b"a,b\n",
             "empty.csv": b"", "cr.csv": b"item_id,user_id,timestamp\rx", "long.csv": b"x" * 200_000, "packed.csv.gz": gzip.compress(b"u,v\nw")}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    wanted = {"bad%20one.csv": "a,b", "long.csv": "x" * (1 << 16), "packed.csv.gz": "u,v"}
    found = lambda: {r["file"].rsplit("/")[-1]: r["header"] for r in validate.check_headers(spark, str(tmp_path)).collect()}
    got = found()
    assert got.pop("empty.csv", "") == "" and got == wanted
    # A large file costs no more than a small one.
    big = tmp_path / "big.csv"
    big.write_bytes(b"no,header\n" + b"row,row\n" * 2_000_000)
    batch = pa.RecordBatch.from_pydict({"file": [big.as_uri()]})
    before = psutil.Process().io_counters().read_chars
    assert next(validate._first_lines(iter([batch]))).column("header").to_pylist() == ["no,header"]
    assert psutil.Process().io_counters().read_chars - before < 1_000_000
    # In a store that only Spark opens, lines are read.
    read = {r["file"].rsplit("/")[-1]: r["header"][: 1 << 16] for r in validate._first_lines_read(spark.read.text(str(tmp_path))).collect()}
    assert {n: read[n] for n in wanted} == wanted


def test_empty_field_is_reported_with_its_row(spark, tmp_path):
    path = write(tmp_path, [("", "user0", "0"), *VALID[1:]])
    raw = sources.readers.with_row_numbers(sources.readers.read_raw_interactions(spark, path))
    assert [r["row_no"] for r in validate.invalid_rows(raw).collect()] == [2]
    assert "empty field" in violations(spark, path)


def test_missing_and_surplus_fields(spark, tmp_path):
    path = write(tmp_path, [("a", "b"), ("a", "b", "1", "x"), ("a", "b", "1")])
    raw = sources.readers.with_row_numbers(sources.readers.read_raw_interactions(spark, path))
    assert sorted(r["row_no"] for r in validate.invalid_rows(raw).collect()) == [2, 3]


def test_empty_surplus_fields_and_blank_lines_are_reported(spark, tmp_path):
    data = [("a", "u", "1"), ("b", "u", "2", ""), ("c", "u", "3", "", "x"), (), ("d", "u", "4"), ('"e,1"', "u", "5"), ("f",)]
    path = write(tmp_path, data)
    raw = sources.readers.with_row_numbers(sources.readers.read_raw_interactions(spark, path))
    assert sorted(r["row_no"] for r in raw.collect()) == list(range(2, 9))
    assert sorted(r["row_no"] for r in validate.invalid_rows(raw).collect()) == [3, 4, 5, 8]
    assert {r["item_id"] for r in raw.filter("row_no in (2, 7)").collect()} == {"a", "e,1"}


def test_bad_timestamp(spark, tmp_path):
    path = write(tmp_path, [("item0", "user0", "not a timestamp"), *VALID[1:]])
    assert "timestamp" in violations(spark, path)


@pytest.mark.parametrize("text,good", [
    ("12", True), (" 12 ", True), ("-3", True), ("+3", True), ("1_000", True),
    ("1__0", False), ("_1", False), ("1.0", False), ("", False), (None, False),
])
def test_integer_texts(spark, text, good):
    df = spark.createDataFrame([(text,)], "timestamp string")
    assert (validate.invalid_timestamps(df).count() == 0) is good


def test_short_user(spark, tmp_path):
    path = write(tmp_path, [*VALID, ("newitem", "newuser", "201")])
    assert rows(validate.short_history_users(sources.read_interactions(spark, path))) == [("newuser", 1)]


def test_small_catalogue_and_empty_log(spark, tmp_path):
    path = write(tmp_path, VALID[:196])
    assert violations(spark, path) == {"few items"}
    empty = write(tmp_path, [])
    assert "short history" in violations(spark, empty)


def test_columns_are_positional(spark, tmp_path):
    path = write(tmp_path, [("u", "i", "5")], header="user_id,item_id,timestamp")
    assert rows(sources.read_interactions(spark, path), "item_id", "user_id", "timestamp") == [("u", "i", 5)]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        sources.read_interactions(spark, str(tmp_path / "nothing.csv")).count()


def test_item_info_keeps_the_last_row_and_awkward_text(spark, tmp_path):
    path = tmp_path / "info.csv"
    path.write_text('item_id,title,other\n007,old,x\n8,"two\nlines, ""quoted"" ",y\n007,new,z\n')
    got = rows(sources.read_item_info(spark, str(path), ["title"]))
    assert got == [("007", "new"), ("8", 'two\nlines, "quoted" ')]


def test_item_info_of_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    draw = random.Random(3)
    odd = ['plain', 'two\nlines', 'a "quoted" word', '"', '""\n"', "\n\n", " blanks ", "ä,é\r\nx", "x" * 3000, "comma,", ""]
    data = [(f"i{k}", draw.choice(odd) + draw.choice(odd), draw.choice(odd), str(k)) for k in range(3000)]
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set('",\n\r') or draw.random() < 0.2 or v != v.strip() else v
    for name, end in (("a", "\n"), ("b", "\r\n")):
        at = tmp_path / name
        at.mkdir()
        for part in (0, 1):
            body = "".join(",".join(map(quoted, r)) + end for r in data[part::2])
            (at / f"{part}.csv").write_bytes(("item_id,title,tag,n" + end + body + end).encode())
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        try:
            assert spark.read.text(str(at)).rdd.getNumPartitions() > 50
            got = {r["item_id"]: (r["title"], r["tag"], r["n"]) for r in sources.read_item_info(spark, str(at), ["title", "tag", "n"]).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {i: tuple(v or None for v in rest) for i, *rest in data}


def test_relevance_jsonl_of_a_masked_score(spark):
    path = scratch_path(spark, "jsonl")
    schema = "interaction array<string>, target string, score double"
    df = spark.createDataFrame([(["0", "a"], "b", 0.5), (["0", "c"], "d", float("-inf"))], schema)
    sources.write_relevance_jsonl(df, path)
    back = spark.read.json(path)
    assert rows(back, "target", "score", "masked") == [("b", 0.5, False), ("d", None, True)]


def metric_rows(spark, *values):
    return spark.createDataFrame([("test", "ndcg", 200, v) for v in values], "split string, metric string, k int, value double")


def test_run_metrics_reject_nothing_and_not_finite(spark):
    path = scratch_path(spark, "metrics")
    run = {"run_id": "r"}
    for bad in ([], [float("nan")], [0.1, float("inf")], [None]):
        with pytest.raises(ValueError):
            sources.append_run_metrics(metric_rows(spark, *bad), run, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_run_metrics_replace_only_their_run(spark):
    path = scratch_path(spark, "metrics")
    sources.append_run_metrics(metric_rows(spark, 0.1, 0.2), {"run_id": "one"}, path)
    sources.append_run_metrics(metric_rows(spark, 0.3), {"run_id": "two"}, path)
    sources.append_run_metrics(metric_rows(spark, 0.1234567), {"run_id": "one"}, path)
    with pytest.raises(ValueError):
        sources.append_run_metrics(metric_rows(spark, float("nan")), {"run_id": "two"}, path)
    assert rows(spark.read.parquet(path), "run_id", "value") == [("one", 0.1234567), ("two", 0.3)]


def test_conform_and_constants(spark):
    df = spark.createDataFrame([(1, "u", "i")], "timestamp long, user string, item string")
    got = validate.conform_columns(df, {"user": "user_id", "item": "item_id"}, ["item_id", "user_id", "timestamp"])
    assert got.columns == ["item_id", "user_id", "timestamp"]
    with_text = validate.add_constant_columns(got, {"tag": "", "description": ""})
    assert rows(with_text, "tag", "description") == [("", "")]


def test_null_ids(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (None, 4)], "user_id long, item_id long")
    assert rows(validate.null_id_report(df), "null_items", "null_users", "rows") == [(True, True, 2)]
    none = df.filter(F.lit(False))
    assert rows(validate.null_id_report(none), "null_items", "null_users", "rows") == [(False, False, 0)]
