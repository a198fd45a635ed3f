import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from caseweave.llm import alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_letters():
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


def spans(both, text):
    """[(id, from, to)] of both sides, from the tokenizers' own libraries; none for texts that don't come back."""
    if not text:
        return [], []
    a, b = both
    letters, out = byte_letters(), []
    whole = (" " + text).encode()
    first = a.encode(" " + text, add_special_tokens=False)
    raw_a = [(i, bytes(letters[c] for c in t)) for i, t in zip(first.ids, first.tokens)]
    raw_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        raw_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    for raw in (raw_a, raw_b):
        at, side = 0, []
        for i, x in raw:
            side.append((i, at, at + len(x)))
            at += len(x)
        if b"".join(x for _, x in raw) != whole:
            return [], []
        out.append(side)
    return out[0], out[1]


def slow(both, texts):
    done, count = [], Counter()
    for t in texts:
        a, b = spans(both, t)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        parts, lo = [], 0
        for c in cuts:
            side = lambda s: ",".join(str(i) for i, f, t in s if lo <= f and t <= c)  # noqa: B023, E731
            parts.append(f"{side(a)}|{side(b)}")
            lo = c
        done.append((len(a), len(b), len(cuts), links, ";".join(parts)))
        count.update(set(links))
    top = Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [
        (na, nb, ng, len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), hashlib.sha256(s.encode()).hexdigest() if s else "")
        for na, nb, ng, ls, s in done
    ]


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "the quick brown fox", "the quick brown fox", "<|endoftext|> and <s> </s> <unk> <0x41>", "naïve Ünïcode ß 漢字 \U0001f600\U0001f600",
    "tabs\tand\nlines\r\n\n", "▁ lower block", "don't I'LL we've", "x" * 300, "0123456789" * 9, "é ﬁ ½", "\u0000\u0001 control", "한국어 텍스트 और हिन्दी", " nbsp 　wide",
]


def test_against_the_definition(spark, both):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "beta,", "Γάμμα", "42", "\n", "long-winded", "日本"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    rows = [(i if i % 7 else None, t, i, "x", i, i, b"p", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int, id string, pair int, a int, places binary, n_a int").repartition(3)
    cols = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = alignment.link_statistics(docs)
    got = sorted(map(repr, ((r.id, *(r[c] for c in cols)) for r in found.collect())))
    assert got == sorted(repr((rows[i][0], *x)) for i, x in enumerate(slow(both, texts)))
    assert alignment.link_statistics(docs.limit(0)).count() == 0


def test_small_chunks_and_blocks_change_nothing(spark, both, monkeypatch):
    v = alignment.Vocabulary(*(open(p, "rb").read() for p in alignment.PATHS))
    texts = TEXTS * 2
    whole = alignment.chunk_of(texts, v)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    cut = alignment.chunk_of(texts, v)
    assert np.array_equal(whole.links.ptr, cut.links.ptr) and np.array_equal(whole.links.cols, cut.links.cols) and np.array_equal(whole.links.vals, cut.links.vals)
    digits = alignment._decimals(60_000)
    assert alignment.group_texts(cut, digits) == [slow_text(both, t).encode() for t in texts]
    monkeypatch.setattr(alignment, "CHUNK", 20)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = {i: x for i, x in enumerate(slow(both, texts))}
    for r in alignment.link_statistics(docs).collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want[r.id]


def slow_text(both, t):
    a, b = spans(both, t)
    out, lo = [], 0
    for c in sorted({x[2] for x in a} & {y[2] for y in b}):
        out.append("|".join(",".join(str(i) for i, f, to in s if lo <= f and to <= c) for s in (a, b)))
        lo = c
    return ";".join(out)


def test_products_of_random_matrices():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n, k, m = rng.integers(1, 9, 3)
        dense_a, dense_b = rng.integers(0, 2, (n, k)), rng.integers(0, 2, (m, k))
        csr = lambda d: alignment.Csr(np.r_[0, np.cumsum(d.sum(axis=1))], np.nonzero(d)[1].astype(np.int32), d.shape[1])
        p = alignment.product(csr(dense_a), alignment.transposed(csr(dense_b)))
        dense = np.zeros((n, m), int)
        dense[np.repeat(np.arange(n), np.diff(p.ptr)), p.cols] = p.vals
        assert np.array_equal(dense, dense_a @ dense_b.T)


def test_runs_of_links(spark, both):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in alignment.align(docs).collect():
        a, b = spans(both, TEXTS[r.id])
        assert (r.a, r.b) == ([x[0] for x in a], [x[0] for x in b])
        cuts = sorted({x[2] for x in a} & {y[2] for y in b})
        group = lambda to: sum(c < to for c in cuts)  # noqa: B023, E731
        for x, o, s in zip(a, r.overlap, r.shared):
            assert [j for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]] == list(range(o["from"], o["to"]))
            assert [j for j, y in enumerate(b) if group(y[2]) == group(x[2])] == list(range(s["from"], s["to"]))


def test_one_very_long_word_and_text(spark, both):
    texts = ["x" * 60_000, "漢" * 20_000, "word " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.link_statistics(docs).collect():
        a, b = spans(both, texts[r.id])
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.groups_sha256 == hashlib.sha256(slow_text_fast(a, b).encode()).hexdigest()


def slow_text_fast(a, b):
    cuts = {x[2] for x in a} & {y[2] for y in b}
    out, i, j = [], 0, 0
    for c in sorted(cuts):
        left, right = [], []
        while i < len(a) and a[i][2] <= c:
            left.append(str(a[i][0]))
            i += 1
        while j < len(b) and b[j][2] <= c:
            right.append(str(b[j][0]))
            j += 1
        out.append(",".join(left) + "|" + ",".join(right))
    return ";".join(out)
