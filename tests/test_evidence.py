import io
import zipfile

import pytest

from caseweave.plans import source_queries
from caseweave.sources import evidence, files, units


def put(tmp_path, name, data):
    (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
    (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def workbook(rows, **parts):
    import pandas as pd

    return next(source_queries._workbooks(iter([pd.DataFrame({"path": ["x"], "rows": [rows]})])))["content"][0]


def fill(tmp_path):
    put(tmp_path, "a/bank.csv", 'Date,Amount,Reference\n2024-01-01,5,"R,1"\n\n2024-01-02,6,R2\n')
    put(tmp_path, "a/twin.xlsx", workbook([["Date", "Amount", "Reference"], ["2024-01-01", "5", "R,1"], ["2024-01-02", "6", "R2"]]))
    put(tmp_path, "a/calls.csv", "Originating number,Terminating number,IMEI\n1,2,3\n")
    put(tmp_path, "b/chat.txt", "12-03-2024, 21:16 - Ann: hello\nmore\n12-03-2024, 21:17 - Bo: <sticker omitted>\n")
    put(tmp_path, "b/note.txt", "one\nno\nthree words here\n")
    put(tmp_path, "b/m.eml", "From: a@x.io\nSubject: Hi\nContent-Type: text/plain; charset=unheard\n\nBody\n")
    put(tmp_path, "c/bad.csv", b"Date,Amount\n1,\xff\n")
    put(tmp_path, "c/bad.xlsx", b"PK\x03\x04 not a book")
    put(tmp_path, "c/p.pdf", "%PDF-1.7")
    put(tmp_path, "c/empty.txt", "")
    put(tmp_path, "c/.hidden.txt", "not read at all\n")


def rows_of(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.source_type, r.unit_key, r.text, tuple(sorted((r.fields or {}).items())), r.error is not None) for r in df.collect())


@pytest.mark.parametrize("part_bytes", ["1", "100000000"])
def test_one_read_gives_the_units_of_mixed_files(spark, tmp_path, part_bytes):
    fill(tmp_path)
    evidence.register(spark)
    df = spark.read.format("evidence").option("partBytes", part_bytes).option("openBytes", "0").load(str(tmp_path))
    assert df.rdd.getNumPartitions() == (10 if part_bytes == "1" else 1)
    got = rows_of(df)
    by = {}
    for name, kind, *rest in got:
        by.setdefault(name, (kind, []))[1].append(tuple(rest))
    assert {n: k for n, (k, _) in by.items()} == {
        "bank.csv": "bank_record", "twin.xlsx": "spreadsheet", "calls.csv": "cdr", "chat.txt": "chat_export", "note.txt": "document",
        "m.eml": "email", "bad.csv": "bank_record", "bad.xlsx": "spreadsheet", "p.pdf": "pdf", "empty.txt": "document",
    }
    assert by["bank.csv"][1] == by["twin.xlsx"][1] and len(by["bank.csv"][1]) == 2  # a spreadsheet gives its twin's rows
    assert by["calls.csv"][1][0][2] == (("device_identifier", "3"), ("receiver", "2"), ("sender", "1"))
    assert [u[1] for u in by["chat.txt"][1]] == ["hello\nmore", "<sticker omitted>"]
    assert [u[0] for u in by["note.txt"][1]] == ["line:1", "line:3"]
    assert "Body" in by["m.eml"][1][0][1]
    assert {n for n, (_, us) in by.items() if any(u[3] for u in us)} == {"bad.csv", "bad.xlsx", "p.pdf", "empty.txt"}
    whole = evidence.of_files(files.ingest(spark, str(tmp_path)).where("name <> '.hidden.txt'"))
    assert rows_of(whole) == [r for r in got if r[0] != "empty.txt"]  # Spark's own reader passes over empty files


def test_one_file_and_a_declared_category(spark, tmp_path):
    put(tmp_path, "n.txt", "plain line\n")
    evidence.register(spark)
    r = spark.read.format("evidence").option("category", "complaint_fir").load(f"file:{tmp_path}/n.txt").first()
    assert (r.source_type, r.basis, r.text) == ("fir", "category", "plain line")
    assert spark.read.format("evidence").load(str(tmp_path)).where("source_type = 'cdr'").count() == 0


@pytest.mark.parametrize(
    "header, kind",
    [
        ("Date,Amount,Reference", "bank_record"), ("Particulars,Transaction", "bank_record"), ("Caller,Callee,Time", "call_log"),
        ("Originating number,Terminating number", "cdr"), ("IMEI,Location", "csv"), ("Duration,Amount", "bank_record"), ("a_number,Amount", "cdr"), ("x,y", "csv"), ("", "csv"),
    ],
)
def test_table_types(header, kind):
    assert units.detect("x.csv", header.encode()) == (kind, "content+headers")


def test_detect_by_extension_and_category():
    d = lambda *a: units.detect(*a)
    assert d("x.png", b"", "whatsapp_screenshot") == ("screenshot", "content+category") and d("x.JPG", b"") == ("image", "content")
    assert d("x.pdf", b"", "fir") == ("fir", "content+category") and d("x.pdf", b"", "email") == ("pdf", "content")
    assert d("x.csv", b"a,b", "call_log") == ("call_log", "content+headers") and d("x.xlsx", b"", "bank_statement") == ("bank_record", "content+category")
    assert d("x.txt", b"From: a", None) == ("email", "content") and d("x.txt", b"", "surveillance_report") == ("surveillance", "category")
    assert d("x", b"", "cdr") == ("cdr", "fallback") and d("x.bin", b"") == ("unknown", "fallback")


def test_map_columns_by_type():
    header = ["Txn Date", "Txn Amount", "Remitter", "Payee", "UPI ID", "Particulars"]
    assert files.map_columns(header, "bank_record") == dict(zip(["event_time", "amount", "sender", "receiver", "account_identifiers", "narration"], header))
    assert files.map_columns(["a_party", "B PARTY", "Call_Type", "lac", "number"], "cdr") == {
        "sender": "a_party", "receiver": "B PARTY", "message_direction": "Call_Type", "cell_site": "lac", "phone_numbers": "number"
    }


def test_spreadsheet_values():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" sheetId="7" r:id="rId9"/><sheet name="A" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/no.xml"/><Relationship Id="rId9" Target="/xl/worksheets/yes.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><r><t>Da</t></r><r><t>te</t></r><rPh><t>no</t></rPh></si><si><t>Amount</t></si></sst>')
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="s"><v>1</v></c></row>'
        cells += '<row r="3"><c r="A3" s="1"><v>45363.5</v></c><c r="B3"><v>9876543210</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#N/A</v></c></row>'
        cells += '<row><c s="2"><v>7</v></c><c><v>1.50</v></c><c t="str"><v>f</v></c></row>'
        z.writestr("xl/worksheets/yes.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    raw.seek(0)
    assert list(units.sheet_rows(raw)) == [["Date", "Amount", "", "Amount"], [], ["2024-03-12 12:00:00", "9876543210", "True", ""], ["7", "1.5", "f"]]
    raw.seek(0)
    got = [(u["row"], u["cells"]) for u in units.table_units(units.sheet_rows(raw), "spreadsheet", True)]
    assert got == [(3, {"Date": "2024-03-12 12:00:00", "Amount": "9876543210", "Unnamed: 2": "True"}), (4, {"Date": "7", "Amount": "1.5", "Unnamed: 2": "f"})]


def test_one_bad_mail_spares_the_others(spark, tmp_path):
    put(tmp_path, "a.eml", "From: a@x.io\nContent-Type: text/plain; charset=no-such-set\n\nBé\n")
    put(tmp_path, "b.eml", "From: b@x.io\n\nBody\n")
    got = {r.path[-5:]: r for r in files.emails(files.ingest(spark, str(tmp_path))).collect()}
    assert got["a.eml"].body.strip() == "Bé" and got["b.eml"].headers["From"] == "b@x.io" and not got["b.eml"].error


def test_files_of_a_small_table_are_read_by_all_cores(spark, sf_dir):
    from caseweave.plans import catalogue

    assert catalogue.queries()["map_columns"](spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
