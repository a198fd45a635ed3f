import io
import random

import pytest

from caseweave.sources import splits, units


@pytest.fixture(params=[61, 1 << 20])
def split(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


CHAT = (
    "before any\n1/2/2024, 9:05 pm - Ann: hello\nmore  \n\n  and more\n12-03-24 21:16 - Bo joined\nafter a notice\n[1/2/24, 21:17] Cy Lee: one\x0btwo\r\n"
    "1/2/2024, 9:07 pm - Bo: < video omitted >\n" + "1/2/2024, 9:08 pm - " + "x" * 70 + ": long\n" + "tail " * 20 + "\n" + "\n".join(f"9/9/24, 10:{i:02} - P{i}: n{i}\nc{i}" for i in range(15))
)


def test_chats_of_any_split(spark, tmp_path, split):
    for name, text in (("a.txt", CHAT), ("b.txt", CHAT[:90]), ("c.txt", ""), ("d.txt", "no message\nat all")):
        (tmp_path / name).write_bytes(text.encode())
    got = splits.chat_messages(spark, str(tmp_path)).collect()
    for name, text in (("a.txt", CHAT), ("b.txt", CHAT[:90])):
        want = [(x["message"], x["line"], x["kind"], x["fields"]["event_time"], x["fields"].get("sender"), x["text"]) for x in units.chat_units(units.lines_of(io.BytesIO(text.encode())))]
        mine = sorted((r.message, r.line, r.kind, r.stamp, r.sender, r.body) for r in got if r.path.endswith(name))
        assert mine == want
    assert {r.message for r in got if r.media and r.path.endswith("a.txt")} == {3}
    assert not [r for r in got if r.path.endswith(("c.txt", "d.txt"))]


def test_lines_of_any_split(spark, tmp_path, split):
    (tmp_path / "a.txt").write_bytes(CHAT.encode() + b"\n\xff bad")
    want = [(x["line"], x["text"]) for x in units.line_units(units.lines_of(io.BytesIO(CHAT.encode() + b"\n\xff bad")))]
    assert sorted((r.line, r.text) for r in splits.lines(spark, str(tmp_path), 3).collect()) == want


def quoted_table(rng, n, separator=",", end="\n"):
    cell = lambda: rng.choice(["plain", "", '"a ""quoted"" one"', f'"two{end}lines"', f'"{end}{end}"', 'in"side', f'"x{separator}y"', '"', "  spaced ", "é漢"])
    rows = [separator.join(["Txn Date", "Txn Amount", "Remitter", "Payee", "UPI ID", "Particulars"])]
    for i in range(n):
        row = [str(i), *(cell() for _ in range(5))]
        if rng.random() < 0.98:
            row = [c if c != '"' else "q" for c in row]
        rows.append(separator.join(row))
        if rng.random() < 0.1:
            rows.append("")
    return end.join(rows) + end


@pytest.mark.parametrize("seed, separator, end", [(1, ",", "\n"), (2, ";", "\r\n"), (3, "\t", "\n"), ])
def test_tables_of_any_split(spark, tmp_path, split, seed, separator, end):
    rng = random.Random(seed)
    texts = {f"t{k}.csv": quoted_table(rng, rng.randrange(1, 40), separator, end) for k in range(2)}
    texts["bom.csv"] = '﻿"Date","Amount"' + end + '1,"5' + end + '6"'
    texts["open.csv"] = f"Date,Amount{end}1,5{end}2,\"never closed{end}3,4{end}"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = splits.table_rows(spark, str(tmp_path)).collect()
    for name, text in texts.items():
        kind = units.detect(name, text.encode())[0]
        want = [(kind, x["row"], x["cells"], x["fields"]) for x in units.table_units(units.csv_rows(io.BytesIO(text.encode())), kind)]
        assert sorted(((r.source_type, r.row, r.cells, r.fields) for r in got if r.path.endswith("/" + name)), key=lambda r: r[1]) == want


def test_ranges_meet_inside_quotes(spark, tmp_path, split):
    """One cell over many ranges, in a file that ends with rows again."""
    text = "Date,Amount\n1,2\n" + '3,"' + "line\n" * 100 + '"\n4,5\n'
    (tmp_path / "a.csv").write_bytes(text.encode())
    assert [(r.row, r.fields["amount"][:4]) for r in sorted(splits.table_rows(spark, str(tmp_path)).collect(), key=lambda r: r.row)] == [(2, "2"), (3, "line"), (4, "5")]
    if split < 1000:
        assert splits._raw(spark, str(tmp_path)).rdd.getNumPartitions() > 4
