import gzip
import io

import pytest

from caseweave.llm import warc
from caseweave.llm.shared import fresh_path


def test_sql(same_as_sql):
    same_as_sql(warc.op9_warc, warc.SQL)


def test_every_split_owns_its_records():
    import pyarrow as pa

    data = b"".join(warc.record(i, f"http://x/{i}", bytes([i % 7]) * (i * 37)) for i in range(25))
    starts = [at for at, _, _ in warc.records(pa.BufferReader(data), 0, len(data))]
    assert len(starts) == 25
    for size in (1, 50, 333, 10_000):
        got = [at for lo in range(0, len(data), size) for at, _, _ in warc.records(pa.BufferReader(data), lo, lo + size)]
        assert got == starts


def test_false_magic_is_no_record():
    import pyarrow as pa

    noise = gzip.compress(b"not a record") + warc.MAGIC + b"junk"
    data = noise + warc.record(1, None, b"x") + noise
    assert len(list(warc.records(pa.BufferReader(data), 0, len(data)))) == 1
    with pytest.raises(ValueError):
        list(warc.records(pa.BufferReader(data[: len(noise) + 150]), 0, len(data)))


def test_buffer_edges(monkeypatch):
    import pyarrow as pa

    data = b"".join(warc.record(i, "u", b"p" * i) for i in range(10))
    monkeypatch.setattr(warc, "BLOCK", 3)
    assert len(list(warc.records(pa.BufferReader(data), 0, len(data)))) == 10


def test_round_trip_with_revisits(spark):
    rows = [(1, "http://a", "é<p>"), (2, None, "é<p>"), (3, "u\r\nX: y", None), (4, "u", ""), (None, "u", "lone"), (None, "u", "lone"), (5, "u", "z" * 3_000_000), (1, "http://a", "é<p>")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, first int")
    base = fresh_path(spark, "warc")
    manifest = warc.write_warc(df, base)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read_warc(spark, base, split=1000).collect()
    assert len(got) == len(rows)
    by = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert by == sorted(
        [("1", "response", None, 5), ("1", "response", None, 5), ("2", "revisit", "1", 5), ("3", "response", None, 0), ("4", "revisit", "3", 0),
         ("None", "response", None, 4), ("None", "response", None, 4), ("5", "response", None, 3_000_000)]
    )
    assert {r.payload for r in got if r.page_id == "1"} == {"é<p>".encode()} and {r.payload_digest for r in got if r.page_id == "2"} == {warc.digest("é<p>".encode())}
    assert {r.uri for r in got if r.page_id == "3"} == {"u  X: y"}


def test_small_payloads_may_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    base = fresh_path(spark, "warc")
    warc.write_warc(df, base, revisit_from=3)
    assert {r.record_type for r in warc.read_warc(spark, base).collect()} == {"response"}


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op9_warc(spark, str(tmp_path)).count() == 0
    assert io  # the table has columns even so
