import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.sources import io
from tessella.streaming.growth import activity


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, " O'Neil,  Ann-B. ", T.clean_text) == "o neil ann b"
    assert one(spark, "ann b neil", T.initials) == "abn"
    assert one(spark, " a; ;nan;B ", T.split_list) == ["a", "B"]
    assert one(spark, "Okafor, N.U. (Corresponding Author), Lab One, Lagos; Lind, P (reprint author), Lab Two; okafor, nu (corresponding author), X", T.corresponding_authors) == ["OKAFOR, NU", "LIND, P"]
    assert one(spark, "no marker, here", T.corresponding_authors) == []
    assert [one(spark, v, T.year_of) for v in ("c. 1987-88", "n.d.", None)] == [1987, None, None]
    assert [one(spark, v, T.part_count) for v in ("a; b;; ", "", None)] == [2, 0, 0] and one(spark, " a \t b ", T.squeeze) == "A B"
    assert T.whole_log_bins(1, 9, 2) == [1, 3, 10]


def test_addresses(spark):
    got = one(spark, "[A, X; B, Y] Univ P, Dept, Spain; [C, Z] Inst Q, Peru", T.bracketed_addresses)
    assert [(r["name"], r["address"]) for r in got] == [("A, X", "Univ P, Spain"), ("B, Y", "Univ P, Spain"), ("C, Z", "Inst Q, Peru")]
    assert [one(spark, v, T.address_kind) for v in (None, "[A] x", "a; b", "a")] == ["no_address", "bracketed", "multiple_addresses", "single"]


def test_numbers(spark):
    assert [one(spark, v, T.safe_int) for v in ("3.0", "x", None)] == [3, None, None]
    assert one(spark, "0.004", lambda c: T.stars(c.cast("double"))) == "**"


def test_csv_facts(spark, tmp_path):
    (tmp_path / "f.csv").write_text("﻿Author_ID,paper_id,Publication_Year,times_cited\na,p,2001,3\n ,p,2001,1\nb,p,bad,\n", encoding="utf-8")
    got = {r["author_id"]: (r["year"], r["times_cited"]) for r in io.read_facts(spark, str(tmp_path / "f.csv")).collect()}
    assert got == {"a": (2001, 3), "b": (0, 0)}
    with pytest.raises(ValueError):
        io.read_any(spark, "x.unknown")


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id * 5) ts, id % 3 user_id, concat('t', id % 2) event_type from range(20)")
    events.write.parquet(str(tmp_path / "e"))
    batch = {tuple(r) for r in activity(events).collect()}
    q = activity(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("activity").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from activity").collect()} == batch
