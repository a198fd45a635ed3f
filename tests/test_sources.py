import datetime as dt

from caseweave.operators.temporal import BURST_N
from caseweave.sources import files, sinks
from caseweave.streaming import contacts as live


def put(tmp_path, name, data):
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_ingest_and_lines(spark, tmp_path):
    put(tmp_path, "a.txt", " one \n\ntwo\n")
    put(tmp_path, "b.txt", " one \n\ntwo\n")
    put(tmp_path, "c.txt", b"\xff\xfe bad")
    put(tmp_path, "d.pdf", "%PDF-1.7")
    got = files.ingest(spark, str(tmp_path))
    rows = {r.name: r for r in got.collect()}
    assert rows["b.txt"].duplicate_of.endswith("a.txt") and rows["a.txt"].duplicate_of is None
    assert rows["d.pdf"].mime == "application/pdf"
    texts = files.lines(got.where("extension = 'txt'"))
    assert sorted((r.path[-5:], r.line, r.text) for r in texts.collect()) == [("a.txt", 1, "one"), ("a.txt", 3, "two"), ("b.txt", 1, "one"), ("b.txt", 3, "two")]
    small = files.ingest(spark, str(tmp_path), most_bytes=9)
    assert {r.status for r in small.collect() if r.name == "a.txt"} == {"rejected"}


def test_chat(spark, tmp_path):
    put(tmp_path, "c.txt", "1/2/2024, 9:05 pm - Ann: hello\nmore\n1/2/2024, 9:06 pm - Bo joined\n1/2/2024, 9:07 pm - Bo: <Media omitted>\n")
    rows = sorted(files.chat_messages(files.ingest(spark, str(tmp_path))).collect(), key=lambda r: r.line)
    assert [(r.line, r.sender, r.body, r.media) for r in rows] == [(1, "Ann", "hello\nmore", False), (3, None, "Bo joined", False), (4, "Bo", "<Media omitted>", True)]


def test_table_and_mail(spark, tmp_path):
    put(tmp_path, "a.csv", "Date;Amount;Beneficiary\n2024-01-01;5;Bo\n2024-01-02;;Al\n")
    put(tmp_path, "b.csv", "only\n1\n")
    put(tmp_path, "m.eml", "From: a@x.io\nTo: b@x.io\nSubject: Hi\n\nBody here\n")
    got = files.ingest(spark, str(tmp_path))
    rows = sorted(files.table_rows(got.where("extension = 'csv'")).collect(), key=lambda r: (r.path, r.row or 0))
    assert [(r.row, r.fields) for r in rows[:2]] == [(2, {"event_time": "2024-01-01", "amount": "5", "receiver": "Bo"}), (3, {"event_time": "2024-01-02", "receiver": "Al"})]
    assert rows[2].error
    mail = files.emails(got.where("extension = 'eml'")).first()
    assert mail.headers["From"] == "a@x.io" and mail.body.strip() == "Body here"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("met Ann", ["ann", "bo"])], "t string, xs array<string>")
    sinks.export(df, str(tmp_path / "out"), alias="Ann")
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).first().t == "met Protected person A"
    sinks.export(df, str(tmp_path / "js"), "json")
    assert spark.read.json(str(tmp_path / "js")).first().xs == ["ann", "bo"]


def test_live_bursts(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("a", i, t + dt.timedelta(minutes=30 * i)) for i in range(4)] + [("b", 9, t)]
    spark.createDataFrame(rows, "key string, id long, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id long, at timestamp").parquet(str(tmp_path / "in"))
    q = live.live_bursts(stream).writeStream.format("memory").queryName("bursts").trigger(availableNow=True)
    q = q.option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    got = spark.table("bursts").collect()
    assert BURST_N == 3 and [(r.key, r.first_id, r.third_id) for r in got] == [("a", 0, 2)]


def test_unreadable_files_and_white_space(spark, tmp_path):
    put(tmp_path, "a.txt", "\t\u2003one \x0b\n")
    put(tmp_path, "c.txt", b"\xff\xfe bad")
    got = files.ingest(spark, str(tmp_path))
    assert [r.text for r in files.lines(got).collect()] == ["one"]
    assert [r.path[-5:] for r in files.unreadable(got).collect()] == ["c.txt"]


def test_cells_have_references(spark, tmp_path):
    put(tmp_path, "a.csv", " Date ;Amount\n2024-01-01;5\n")
    got = files.ingest(spark, str(tmp_path))
    row = files.table_rows(got, keep_case=False).first()
    assert set(row.cells) == {"date", "amount"} and row.refs == {"event_time": "row:2 column:date", "amount": "row:2 column:amount"}


def test_headers_go_before_the_text(spark, tmp_path):
    put(tmp_path, "m.eml", "From: a@x.io\nMessage-ID: <1@host.example.com>\nDate: Tue, 12 Mar 2024 21:15:00 +0530\n\nFrom: Asha Rao.\nTo: Ravi Kumar.\nwrite to c@y.io on 1 Jan 2020\n")
    r = files.email_facts(files.emails(files.ingest(spark, str(tmp_path)))).first()
    assert (r.sender, r.receiver, r.email_addresses) == ("a@x.io", "Ravi Kumar", ["a@x.io", "c@y.io"]) and r.at == dt.datetime(2024, 3, 12, 15, 45)


def test_live_state_goes_and_late_rows_are_dropped(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "key string, id long, at timestamp"
    days = [[("a", 1, t), ("a", 2, t)], [("b", 3, t + dt.timedelta(days=30))], [("b", 4, t + dt.timedelta(days=31))], [("a", 5, t + dt.timedelta(minutes=1)), ("b", 6, t + dt.timedelta(days=32))]]
    q = None
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = live.live_bursts(stream, forget_s=86_400).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    kept = spark.read.format("statestore").load(str(tmp_path / "cp")).selectExpr("key.key AS k").collect()
    assert {r.k for r in kept} == {"b"}  # neither the old state of a nor its late third contact is there
