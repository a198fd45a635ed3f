from pyspark.sql import functions as F

from caseweave.functions import canonical, identifiers as ids, scores


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_phones(spark):
    assert one(spark, "call 98765 43210 or +91-9876543210, 09876543211; not 1234567890", ids.find_phone_numbers) == ["+919876543210", "+919876543211"]
    assert one(spark, None, ids.find_phone_numbers) == []


def test_emails_and_accounts(spark):
    text = "Ann@Mail.Example.com a/c: 123456789012 HDFC0012345 ann.b@okbank"
    assert one(spark, text, ids.find_email_addresses) == ["ann@mail.example.com"]
    assert one(spark, text, ids.find_account_identifiers) == ["123456789012", "HDFC0012345", "ann.b@okbank"]


def test_vehicles(spark):
    assert one(spark, "MH 12 DE 1433, dl-8c-ab-1234, XX 12 DE 1433, 22 BH 1234 AB", ids.find_vehicle_identifiers) == ["22BH1234AB", "DL8CAB1234", "MH12DE1433"]


def test_organisations_keep_descriptors_apart(spark):
    assert one(spark, "Acme Motors and State Bank of India", ids.find_organisations) == ["Acme Motors", "State Bank of India"]
    keys = spark.createDataFrame([("Shreeji Traders Pvt. Ltd.",), ("shreeji traders",), ("Acme Motors",), ("Acme Traders",), ("Ltd.",)], "t string")
    got = [r.x for r in keys.select(canonical.normalize_organisation(F.col("t")).alias("x")).collect()]
    assert got == ["shreeji traders", "shreeji traders", "acme motors", "acme traders", "ltd"]


def test_references_fold_lookalikes(spark):
    f = lambda c: canonical.canonicalize("transaction_reference", c)["key"]
    assert one(spark, "UTR-OIL123", f) == one(spark, "utr0111 23", lambda c: canonical.canonicalize("transaction_reference", F.lit("utr-0il123"))["key"])
    assert one(spark, "ab1", f) is None


def test_party(spark):
    got = [
        one(spark, t, lambda c: F.concat_ws("|", canonical.canonicalize("sender", c)["entity_type"], canonical.canonicalize("sender", c)["key"]))
        for t in ("98765 43210", "ann@okbank", "Asha Rao", "synthetic account 8233", "x")
    ]
    assert got == ["phone|9876543210", "upi|ann@okbank", "person|asha rao", "party|synthetic account 8233", ""]


def test_indicators_last_value_first_place(spark):
    got = one(spark, "ab@x.io AB@X.IO 10.0.0.1", ids.indicators)
    assert [(r.entity_type, r.value) for r in got] == [("upi_id", "AB@X.IO"), ("email", "AB@X.IO"), ("ip_address", "10.0.0.1")]


def test_sentences(spark):
    assert one(spark, "One. Two!\n\nThree? 4", ids.sentences) == ["One.", "Two!", "Three?", "4"]


def test_scores(spark):
    row = spark.range(1).select(
        scores.band_for(F.lit(None).cast("double")).alias("a"), scores.band_for(F.lit(0.85)).alias("b"), scores.band_for(F.lit(0.6)).alias("c"),
        scores.bridge_strength(F.lit("email"), F.lit(2), F.lit(0.93)).alias("d"), scores.redact(F.lit("met ANN, ann."), "ann").alias("e"),
        scores.classify_amount_role(F.lit("closing balance 500")).alias("f"), scores.combined_confidence(F.lit(0.8), F.lit(None).cast("double")).alias("g"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == ("unknown", "high", "medium", 0.6547, "met Protected person A, Protected person A.", "balance", 0.6)
