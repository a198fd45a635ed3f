import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeats, ties, and other columns with the operators' own names."""
    rng, parts = random.Random(4), [" ".join(WORDS)]
    parts += [" ".join(rng.sample(WORDS, 20)) for _ in range(5)]
    prose = ". ".join(parts) + "."
    rows = [
        (1, prose, "src0", 10),
        (1, prose, "src0", 10),
        (2, prose, "src1", 10),
        (3, None, None, None),
        (4, "", "src1", 0),
        (5, " \t\n ", "src1", 3),
        (None, prose + " extra", "src0", 5),
        (None, None, None, None),
        (6, "word " * 60_000, "src0", 300_000),
        (7, "x" * 200_000, "src2", 200_000),
        (8, "one", "src2", 3),
        (9, "Ünïcode ß 漢字 \U0001f600 text.", "src2", 20),
    ]
    wide = [(*r, i, "x", 0.5, "p", "h", "w", *"abcdefghijkl") for i, r in enumerate(rows)]
    names = "doc_id long, text string, source string, n_chars long, size int, id string, fp double, pattern string, row string, label string"
    # the operators' own names, and those of older forms of them
    names += "".join(f", {c} string" for c in ("hash", "_id", "_label", "_few", "_cw_words", "_cw_kept", "_cw_entities", "_cw_bit", "m", "t", "digest", "_p"))
    return spark.createDataFrame(wide, names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
