import re

import pytest
from pyspark.sql import functions as F

from caseweave.operators import upkeep
from caseweave.sources import evidence, files, store

TABLE = "Date,Amount,Payer,Payee,Reference\n"


def put(root, name, text):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)


def batches(root):
    put(root, "1/c1/a.csv", TABLE + "2024-01-01 10:00,60000,Ann Rao,Bo Lal,R1\n2024-01-01 10:30,100,Ann Rao,Cy Das,R2\n")
    put(root, "1/c2/b.txt", "12-03-2024, 21:16 - Ann: hello\n12-03-2024, 21:17 - Bo: hello\n")
    put(root, "2/c1/d.csv", TABLE + "2024-01-02 10:00,700,Ann Rao,Bo Lal,R3\n")
    put(root, "2/c3/e.csv", "A-Party,B-Party,Call date,IMEI\n" + "".join(f"9876500001,9876500002,2024-03-12 21:1{i},D1\n" for i in range(3)))
    put(root, "3/c1/f.csv", TABLE + "2024-01-03 10:00,800,Dee Roy,Cy Das,R4\n")
    put(root, "3/c3/g.csv", "A-Party,B-Party,Call date,IMEI\n9876500009,9876500002,2024-03-12 21:30,D1\n")
    return [str(root / str(i)) for i in (1, 2, 3)]


def state(u, *without):
    """The tables' rows; paths differ between folders, so records go by case and unit."""
    out = {}
    for name in upkeep.TABLES:
        rows = u.table(name).drop("evidence_id", "record_id", "batch", "first_batch", *without).collect()
        out[name] = sorted(repr(sorted(r.asDict().items())) if name != "alerts" else repr((r.case_id, r.rule, re.sub(r"^[0-9a-f]{16}:|:[0-9a-f]{16}(?=:row)", ":", r.key))) for r in rows)
    return out


@pytest.fixture
def units(spark):
    return lambda path: evidence.of_files(files.ingest(spark, path))


def test_batches_in_any_cut_leave_the_same_tables(spark, tmp_path, units):
    parts = batches(tmp_path / "in")
    one, three = (upkeep.Upkeep(spark, str(tmp_path / n), buckets=2) for n in ("one", "three"))
    assert one.apply(units(str(tmp_path / "in")), "all")
    for i, p in enumerate(parts):
        assert three.apply(units(p), f"b{i}")
    before = state(three)
    assert not three.apply(units(parts[1]), "b1")  # a replay does nothing
    assert three.apply(units(parts[1]), "again")  # nor does a batch of files that are there
    assert state(three) == before == state(one)
    rules = {(r.case_id, r.rule) for r in three.table("alerts").collect()}
    assert rules == {("c1", "HIGH_VALUE_TRANSFER"), ("c1", "REPEATED_RECIPIENT"), ("c1", "RAPID_TRANSACTION_SEQUENCE"), ("c3", "COMMUNICATION_BURST"), ("c3", "SHARED_DEVICE")}
    first = {(r.case_id, r.rule): r.first_batch for r in three.table("alerts").collect()}
    assert first["c1", "HIGH_VALUE_TRANSFER"] == "b0" and first["c3", "COMMUNICATION_BURST"] == "b1" and first["c3", "SHARED_DEVICE"] == "b2"


def test_only_changed_cases_are_written(spark, tmp_path, units):
    parts = batches(tmp_path / "in")
    u = upkeep.Upkeep(spark, str(tmp_path / "t"), buckets=2)
    u.apply(units(parts[0]), "b0")
    files_of = lambda case: sorted(str(p) for t in ("relations", "alerts") for p in (tmp_path / "t" / t).glob(f"case_id={case}/*.parquet"))
    c1, c2 = files_of("c1"), files_of("c2")
    u.apply(units(parts[1]), "b1")
    assert files_of("c2") == c2 and files_of("c1") != c1 and files_of("c3")


def test_a_batch_that_broke_off_and_a_new_session_of_the_tables(spark, tmp_path, units, monkeypatch):
    parts = batches(tmp_path / "in")
    u = upkeep.Upkeep(spark, str(tmp_path / "t"), buckets=2)
    u.apply(units(parts[0]), "b0")
    monkeypatch.setattr(upkeep, "alerts_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        u.apply(units(parts[1]), "b1")
    monkeypatch.undo()
    again = upkeep.Upkeep(spark, str(tmp_path / "t"), buckets=2)  # finds the files that are there
    for i, p in enumerate(parts):
        again.apply(units(p), f"b{i}")
    whole = upkeep.Upkeep(spark, str(tmp_path / "w"), buckets=2)
    whole.apply(units(str(tmp_path / "in")), "all")
    assert state(again) == state(whole)


def test_reviews_stay(spark, tmp_path, units):
    parts = batches(tmp_path / "in")
    u = upkeep.Upkeep(spark, str(tmp_path / "t"), buckets=2)
    u.apply(units(parts[0]), "b0")
    r = u.table("alerts").where("rule = 'HIGH_VALUE_TRANSFER'").first()
    u.review(r.case_id, r.rule, r.key, "dismissed")
    u.apply(units(parts[1]), "b1")
    assert {(x.rule, x.review) for x in u.table("alerts").where("case_id = 'c1'").collect()} >= {("HIGH_VALUE_TRANSFER", "dismissed"), ("REPEATED_RECIPIENT", None)}


def test_a_stream_of_files(spark, tmp_path, units):
    import shutil

    parts = batches(tmp_path / "in")
    u = upkeep.Upkeep(spark, str(tmp_path / "t"), buckets=2)
    (tmp_path / "drop").mkdir()
    for p in parts:
        for case in (tmp_path / "in" / p[-1]).iterdir():
            for f in case.iterdir():
                (tmp_path / "drop" / case.name).mkdir(exist_ok=True)
                shutil.copy(f, tmp_path / "drop" / case.name / f.name)
        u.take_new_files(str(tmp_path / "drop"), str(tmp_path / "cp"))
    whole = upkeep.Upkeep(spark, str(tmp_path / "w"), buckets=2)
    whole.apply(units(str(tmp_path / "drop")), "all")
    assert state(u) == state(whole)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_by_case_and_joins_without_exchange(spark, tmp_path):
    rel = spark.range(4000).select(
        (F.col("id") % 20).cast("string").alias("case_id"), F.concat(F.lit("n"), (F.col("id") % 97).cast("string")).alias("subject"), F.col("id").alias("record_id")
    )
    rel = rel.withColumn("subject_node", store.node(F.col("case_id"), F.col("subject")))
    ent = rel.select("case_id", F.col("subject_node").alias("node"), F.upper("subject").alias("display")).distinct()
    for name, df, key in (("lay_rel", rel, "subject_node"), ("lay_ent", ent, "node")):
        store.create(spark, name, df, str(tmp_path / name), key, buckets=4)
        store.replace(name, df, key, buckets=4)
    one = spark.table("lay_rel").where("case_id = '7'")
    names = {r[0] for r in one.select(F.input_file_name()).distinct().collect()}
    assert one.count() == 200 and names and all("case_id=7/" in n for n in names) and len(names) <= 4
    assert len(list((tmp_path / "lay_rel" / "case_id=7").glob("*.parquet"))) <= 4
    joined = store.relation_ends(spark.table("lay_rel"), spark.table("lay_ent"))
    p = plan(joined)
    assert "SortMergeJoin" in p and "Exchange" not in p
    assert joined.where("subject_name = upper(subject)").count() == 4000
    few = spark.createDataFrame([("3", "open"), ("4", "shut")], "case_id string, state string").where("state = 'open'")
    pruned = store.of_cases(spark.table("lay_rel"), few)
    assert "dynamicpruning" in plan(pruned) and pruned.count() == 200
