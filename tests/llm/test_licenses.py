import pytest

from caseweave.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    return licenses.fit(spark)


def found(spark, model, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.id, r.paragraph, r.family): r.confirmed for r in licenses.scan(df, model).collect()}


def test_families(spark, model):
    texts = [
        "Intro.\nReleased under the MIT License.\nMore.",
        "Copyright 2020 X. Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "All rights reserved.",
    ]
    want = ["MIT", "Apache-2.0", "GPL", "LGPL", "CC-BY-NC", "CC-BY", "Proprietary"]
    got = found(spark, model, texts)
    assert got == {(i, 0, f): True for i, f in enumerate(want)}


def test_wrapped_notices_and_several_families(spark, model):
    bsd = (
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\n"
        "conditions are met:\n\n"
    )
    apache = "# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with\n# the License."
    got = found(spark, model, [f"Intro here.\n \t\n{bsd}The end.", f"A tool.\n\n{apache}", "Released under the MIT License. Parts licensed under CC BY-NC 4.0."])
    assert {k for k, ok in got.items() if ok} == {(0, 1, "BSD"), (1, 1, "Apache-2.0"), (2, 0, "MIT"), (2, 0, "CC-BY-NC")}


def test_other_licences_are_unknown(spark, model):
    """Also those that training never saw."""
    assert not any(found(spark, model, licenses.OTHERS).values())


def test_ordinary_text_is_unknown(spark, model):
    texts = ["The driver showed a license.", "An apache helicopter over the general store.", "All was said by the public.", "MIT won the game under the lights."]
    assert not any(found(spark, model, texts).values())


def test_probabilities_are_calibrated(model):
    assert model.temperature > 0 and model.weights.count() > 0


def test_corpus_like_literal_search(spark, sf_dir):
    marks = {"MIT": "Released under the MIT License", "Apache-2.0": "Apache License, Version 2", "GPL": "GNU General Public", "CC-BY-NC": "CC BY-NC", "Proprietary": "All rights reserved"}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = licenses.op5_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.families == ",".join(sorted(f for f, m in marks.items() if m in docs[r.doc_id]))


def test_odd_rows(spark, model, odd_docs, no_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.withColumn("text", F.when(F.col("doc_id").isin(1, 6), F.concat("text", F.lit("\nReleased under the MIT License."))).otherwise(F.col("text")))
    rows = licenses.scan(docs, model).where("confirmed").collect()
    assert sorted(r.id for r in rows) == [1, 6]  # the repeated row gives its finding once
    assert licenses.scan(no_docs, model).count() == 0
