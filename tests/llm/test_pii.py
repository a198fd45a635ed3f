import random
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from caseweave.llm import pii

KEY = b"k"


def hinted(texts):
    return pc.match_substring_regex(pa.array(texts, pa.large_string()), pii.HINT).to_pylist()


def test_detection():
    text = "Mail A.b@x.example.com, +1 (555) 010-9999, 10.0.0.1, 4111 1111 1111 1111, 123-45-6789, deadbeef" + "0" * 32 + ". Mrs. Anna Schmidt saw Herr Müller; Schmidt left."
    got = [(k, text[s:e], g) for s, e, k, _, g in pii.entities(text)]
    assert got == [
        ("email", "A.b@x.example.com", None), ("phone", "+1 (555) 010-9999", None), ("ip", "10.0.0.1", None), ("card", "4111 1111 1111 1111", None),
        ("ssn", "123-45-6789", None), ("hex", "deadbeef" + "0" * 32, None), ("name", "Anna", "f"), ("name", "Schmidt", "f"), ("name", "Müller", "m"), ("name", "Schmidt", "f"),
    ]
    for quiet in ("version 1.2.3, 2024, 50% of 1,000", "order 4111111111111112 of 9807915762804490"):
        assert pii.entities(quiet) == []
    assert hinted(["no private data here"]) == [False]
    assert [g for *_, g in pii.entities("Prof. Dr. Mrs. Ada Byron; Dr Curie")] == ["f", "f", "u"]


def test_every_entity_has_a_hint(spark, sf_dir):
    rng = random.Random(3)
    parts = ["a@b.example.com", "+44 20 7946 0958", "(555) 010-9999", "٥٥٥-٠١٠-٩٩٩٩", "1.2.3.4", "DE89 3704 0044 0532 0130 00", "4111-1111-1111-1111", "a1" * 16,
             "AKIA" + "B" * 16, "sk-" + "a" * 20, "ghp_" + "a" * 30, "Mr. Bo", "ΚΎΡΙΟΣ Ωμ", "Г-Н Ив", "x", "1", " ", "."]
    texts = ["".join(rng.choice(parts) for _ in range(3)) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    found = [bool(pii.entities(t)) for t in texts]
    assert sum(found) > 1000 and not any(f and not h for f, h in zip(found, hinted(texts)))


def test_successor_is_a_permutation_without_fixed_points():
    values = [f"{i:03d}" for i in range(1000)]
    seen = [pii.successor("ssn", v, KEY) for v in values]
    assert sorted(seen) == values and all(a != b for a, b in zip(values, seen))
    card = pii.successor("card", "4111111111111111", KEY)
    assert card[:4] == "4111" and pii.is_card(card)
    iban = pii.successor("iban", "DE89370400440532013000", KEY)
    assert iban[:2] == "DE" and int(iban[2:4]) == pii._iban_check("DE", iban[4:])
    assert pii.successor("email", "ab.1@mail.example.com", KEY).endswith(".com")
    assert pii.successor("key", "sk-" + "a" * 20, KEY).startswith("sk-")


def test_names_keep_script_and_gender():
    for value, gender in (("anna", "f"), ("ivan", "m"), ("иванова", "f"), ("μαρία", "f"), ("王小明", "m"), ("محمد", "m"), ("משה", "m"), ("김", "u"), ("ひろ", "u"), ("रमा", "f"), ("o'brien", "u")):
        for turn in range(6):
            made = pii.name_for(value, gender, KEY, turn)
            assert pii._script(made[0]) == pii._script(value[0]) and (turn > 2 or len(made) == len(value))
    assert pii.name_for("maria", "f", KEY).endswith(pii.SYLLABLES["LATIN"][2]["f"])
    assert pii.name_for("пётр", "m", KEY).endswith(pii.SYLLABLES["CYRILLIC"][2]["m"])


def test_replacement(spark):
    a = "Write to ann.b@mail.example.com or 10.0.0.1."
    rows = [
        (1, a), (2, "ANN.B@MAIL.EXAMPLE.COM and bob@mail.example.com"), (3, "Call +1 (555) 010-9999 or 555-010-9999 or +44 5550109999"),
        (4, "Mr. Ivan Petrov. Petrov and Dr Petrov."), (5, "nothing here"), (6, "Dr Maria Weber"), (7, "Mrs Maria Weber"), (8, "Mr J Smith"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out, table = pii.replace(df, "k")
    got = {r.doc_id: r for r in out.collect()}
    assert got[5].text == "nothing here" and got[5]._cw_entities == 0
    for i, text in rows:
        for s, e, *_ in pii.entities(text):
            assert not re.search(rf"(?<!\w){re.escape(text[s:e])}(?!\w)", got[i].text)
    first = got[1].text.split()[2]
    assert got[2].text.split()[0] == first.upper() and got[2].text.split()[0].lower() != got[2].text.split()[2].lower()
    x, y, z = re.fullmatch(r"Call \+1 \((\d{3}\) \d{3}-\d{4}) or (\d{3}-\d{3}-\d{4}) or \+44 (\d{10})", got[3].text).groups()
    assert re.sub(r"\D", "", x) == re.sub(r"\D", "", y) != z  # one number in two formats, and another country's
    names = re.fullmatch(r"Mr\. (\w+) (\w+)\. (\w+) and Dr (\w+)\.", got[4].text).groups()
    assert names[1] == names[2] == names[3] and names[0] != names[1] and names[0].endswith(pii.SYLLABLES["LATIN"][2]["m"])
    assert got[6].text.split()[1:] == got[7].text.split()[1:] and got[6].text.split()[1].endswith(pii.SYLLABLES["LATIN"][2]["f"])
    t = table.collect()
    assert len({(r.kind, r.surrogate) for r in t}) == len(t)
    assert not {(r.kind, r.surrogate) for r in t} & {(r.kind, r.value) for r in t}
    again = {r.doc_id: r.text for r in pii.replace(df, "k")[0].collect()}
    assert again == {i: r.text for i, r in got.items()} != {r.doc_id: r.text for r in pii.replace(df, "other")[0].collect()}


def test_no_value_stands_for_itself(spark):
    """Random names of many scripts, digits and titles; initials of a whole alphabet; a full space of numbers."""
    rng = random.Random(8)
    scripts = ["abcxyzéüł", "абвяю", "αβγω", "王李张明", "אבגש", "محمد", "김이박", "かきく", "रमकल"]
    names = [t + " " + "".join(rng.choice(s) for _ in range(rng.randint(1, 6))).capitalize() for s in scripts for t in ("Mr.", "Mrs", "Dr") for _ in range(8)]
    names += [f"Mr {c}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + ["_@-.com", "+999 12 345", "call ٥٥٥-٠١٠-٩٩٩٩"]
    names += [f"+999 {i // 100:02d} {i % 100:02d}" for i in range(0, 10_000, 7)]
    out, table = pii.replace(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string"), "k")
    got = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(names):
        found = pii.entities(text)
        assert found and got[i]._cw_entities == len(found) and got[i].text != text, text
    t = table.collect()
    assert all(r.surrogate != r.value for r in t) and len({(r.kind, r.surrogate) for r in t}) == len(t)


def test_surrogates_avoid_detected_values(spark):
    """A third of a small space is real; surrogates are distinct and fall into the rest. A full space gets distinct ones too."""
    space = lambda values: spark.createDataFrame([("ssn", f"{i:02d}", "u") for i in values], "kind string, value string, gender string")
    rows = pii.surrogates(space(range(0, 60, 2)), "k").collect()
    real = {r.value for r in rows}
    assert len(rows) == 30 == len({r.surrogate for r in rows}) and not real & {r.surrogate for r in rows}
    rows = pii.surrogates(space(range(100)), "k").collect()
    assert len({r.surrogate for r in rows}) == 100 and all(r.value != r.surrogate for r in rows)


def test_corpus_keeps_nothing_private(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    n = 0
    for r in pii.op4_pii_surrogates(spark, sf_dir).collect():
        found = pii.entities(before[r.doc_id])
        n += len(found)
        assert r.n_entities == len(found)
        assert not any(before[r.doc_id][s:e] in r.text for s, e, *_ in found)
        if not found:
            assert r.text == before[r.doc_id]
    assert n > 0


def test_odd_rows(spark, odd_docs, no_docs):
    mail = odd_docs.withColumn("text", F.when(F.col("doc_id") == 6, F.concat("text", F.lit(" a@b.example.com"))).otherwise(F.col("text")))
    out, _ = pii.replace(mail, "k")
    assert out.columns == [*odd_docs.columns, "_cw_entities_"] and out.count() == odd_docs.count()
    rows = {r.size: r for r in out.collect()}
    assert rows[3].text is None and rows[4].text == "" and "a@b.example.com" not in rows[8].text and rows[8]._cw_entities_ == 1
    assert pii.replace(no_docs, "k")[0].count() == 0


def test_keys_without_digits_and_other_scripts_are_replaced(spark):
    texts = [
        "token AKIA" + "ABCDEFGHIJKLMNOP", "use sk-" + "abcdefghijklmnopqrst", "ghp_" + "a" * 30, "Dr. 王小明 came", "Dr. 王 came", "Dr. משה came", "Mr. محمد came",
        "call ٥٥٥-٠١٠-٩٩٩٩ now", "王小明@mail.example.com", "Mr. A Łęcki", "_@-.com", "Mrs. Ōno",
    ]
    out, table = pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")
    got = {r.doc_id: r for r in out.collect()}
    for i, text in enumerate(texts):
        found = pii.entities(text)
        assert found and got[i]._cw_entities == len(found)
        assert got[i].text != text
        assert len(found) > 1 or got[i].text[found[0][0] :] != text[found[0][0] :]
    assert "王" not in got[3].text and "小明" not in got[8].text
    assert all(r.surrogate != r.value for r in table.collect())


def test_tokens_labelled_secrets_and_passports():
    jwt, slack = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTYifQ.abcDEF_ghi-jklMNO12", "xoxb-1234567890-abcdefghij"
    text = f"password: hunter2x and api_key='A1b2C3d4E5' jwt {jwt} slack {slack} Passport No: K1234567, the secret: nobody knows. token 5"
    found = pii.entities(text)
    assert [(text[s:e], k) for s, e, k, *_ in found] == [(x, "key") for x in ("hunter2x", "A1b2C3d4E5", jwt, slack, "K1234567")]
    for _, _, kind, value, _ in found:
        other = pii.successor(kind, value, b"k" * 32)
        assert other != value and len(other) == len(value) and [c.isdigit() for c in other] == [c.isdigit() for c in value]
        assert [c for c in other if not c.isalnum()] == [c for c in value if not c.isalnum()]
    assert pii.successor("key", jwt, b"k" * 32).startswith("eyJ") and hinted([text, "plain words"]) == [True, False]


def test_later_mentions_take_linear_time():
    import time

    text = "Mr Ann Bo " + "Ann met Bo on 10.1.2.3. " * 20_000
    began = time.process_time()
    found = pii.entities(text)
    assert len(found) == 2 + 60_000 and time.process_time() - began < 20
