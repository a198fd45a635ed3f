"""Line-first quality rules, in SQL functions alone.

Each line is judged by itself (punctuation, navigation, boilerplate); failing lines go, and a document that
loses too many of its words to that, or fails the document's base rules, is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACE, free_names, table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?…。、，！？"
DIVIDERS = "|»›·•"
BOILERPLATE = (
    "all rights reserved|cookie|privacy policy|terms of (use|service)|subscribe|sign (in|up)|log ?in\\b"
    "|click here|javascript|lorem ipsum|share (on|this)|back to top|read more|newsletter"
    "|tous droits réservés|politique de confidentialité|conditions d'utilisation|s'abonner|se connecter|lire la suite"
    "|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|abonnieren|anmelden|weiterlesen|nach oben"
    "|todos los derechos reservados|política de privacidad|términos de uso|suscríbete|iniciar sesión|leer más"
)


@dataclass(frozen=True)
class LineRules:
    """A line fails with over `symbols` symbols or over `shouts` exclamation and question marks a word, with
    no punctuation over `bare_words` words or more, with at least two dividers and one for each `menu_words`
    words or fewer, or as a short line (`notice_words` or fewer) of boilerplate. A document goes if its
    remaining lines hold less than `left` of its words."""

    symbols: float = 0.5
    shouts: float = 1.0
    bare_words: int = 8
    menu_words: int = 4
    notice_words: int = 12
    left: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


def _without(col: Column, chars: str) -> Column:
    """The text without these characters: a byte search for each, which costs little where there are none."""
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def _hits(col: Column, chars: str) -> Column:
    return F.length(col) - F.length(_without(col, chars))


def _line(line: Column) -> Column:
    """A line and its words."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.struct(line.alias("line"), F.when(bare != "", F.split(bare, SPACE)).otherwise(F.array().cast("array<string>")).alias("words"))


def _fails(x: Column, r: LineRules) -> Column:
    line, n = x["line"], F.size(x["words"])
    dividers = _hits(line, DIVIDERS)
    punctuation = (_hits(line, SYMBOLS) > r.symbols * n) | (_hits(line, "!?") > r.shouts * n) | ((n >= r.bare_words) & ~line.rlike(f"[{MARKS}]"))
    navigation = (dividers >= 2) & (dividers * r.menu_words >= n)
    boilerplate = (n <= r.notice_words) & F.lower(line).rlike(BOILERPLATE)
    return (n > 0) & (punctuation | navigation | boilerplate)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _windows(n: Column, of) -> Column:
    """of(i) for the first word i, from 0, of every window of three among n words."""
    return F.transform(F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")), of)


def _repeated(w: Column) -> Column:
    """How many of the words w lie in windows of three that occur twice or more.

    Hashes of the windows tell texts without repeats, most of them, which end here; in the others the windows themselves are
    sorted and compared."""
    n = F.size(w)
    hashes = _windows(n, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    text = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    s = F.sort_array(_windows(n, lambda i: F.struct(text(i).alias("t"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, i: F.coalesce(x["t"] == F.get(s, i)["t"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return _sum(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))).cast("long")))

    # a lambda names an array, so that it is made once
    named = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    some = named(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(some, named(s, lambda s: named(places(s), covered))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules(), prefix: str = "_cw_") -> DataFrame:
    """docs with, under `prefix`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_left (words of the lines that stay) and clean (the text without its failing lines).

    A null text counts as an empty one and is rejected by the word count; its clean text stays null. Long
    texts are judged whole. Ties and repeated rows are judged each by itself. docs must have no column under those names.
    """
    p = prefix
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left", "clean")
    taken = {x.lower() for x in docs.columns}
    if clash := [p + n for n in names if (p + n).lower() in taken]:
        raise ValueError(f"columns {clash} are there already; choose another prefix")
    lines_, words_, seen_, good_, judged_ = free_names([*docs.columns, *(p + n for n in names)], *(p + x for x in ("lines", "words", "seen", "good", "judged")))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines, words, seen, good = F.col(lines_), F.col(words_), F.col(seen_), F.col(good_)
    out = docs.withColumn(lines_, F.transform(F.split(text, "\n"), _line)).withColumns(
        {
            words_: F.flatten(F.transform(lines, lambda x: x["words"])),
            seen_: F.transform(F.filter(lines, lambda x: F.size(x["words"]) > 0), lambda x: x["line"]),
            good_: F.filter(lines, lambda x: ~_fails(x, rules)),
        }
    )
    judged = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        _hits(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(seen) - F.size(F.array_distinct(seen))).cast("long").alias("n_dup_lines"),
        _repeated(words).alias("n_repeat_words"),
        _sum(F.transform(good, lambda x: F.size(x["words"]).cast("long"))).alias("n_left"),
        F.when(F.col(text_col).isNotNull(), F.array_join(F.transform(good, lambda x: x["line"]), "\n")).alias("clean"),
    )
    # explode keeps filters on the results above it: pushed below, they would work all of it out once more
    out = out.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array(judged)).alias(judged_))
    c = lambda name: F.col(judged_)[name]
    failed = (c("n_words") < rules.min_words) | (100 * c("n_repeat_words") > rules.repeat_percent * c("n_words"))
    made = {n: c(n) for n in names if n not in ("base_failed", "kept")}
    made |= {"base_failed": failed, "kept": ~failed & (c("n_left") >= rules.left * c("n_words"))}
    return out.select(*(F.col(f"`{x}`") for x in docs.columns), *(made[n].alias(p + n) for n in names))


def clean_documents(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that stay, with their failing lines removed; all columns keep their names and order."""
    (p,) = free_names([c[: len("_cw_")] for c in docs.columns], "_cw_")
    out = measure(docs, text_col, rules, p).where(F.col(p + "kept"))
    made = {text_col: F.col(p + "clean")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length(p + "clean").cast(docs.schema["n_chars"].dataType)
    return out.select(*(made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", *(F.col("_cw_" + m).alias(m) for m in MEASURES))


def _sql_hits(col: str, chars: str) -> str:
    return f"(length({col}) - length(translate({col}, '{chars}', '')))"


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, x, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
), lines AS (
  SELECT doc_id, count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS dup,
    coalesce(sum(n) FILTER (NOT (n > 0 AND (
      {_sql_hits('x', SYMBOLS)} > 0.5 * n OR {_sql_hits('x', '!?')} > n OR (n >= 8 AND {_sql_hits('x', MARKS)} = 0)
      OR ({_sql_hits('x', DIVIDERS)} >= 2 AND {_sql_hits('x', DIVIDERS)} * 4 >= n)
      OR (n <= 12 AND regexp_matches(lower(x), '{BOILERPLATE.replace("'", "''")}'))))), 0)::BIGINT AS n_left
  FROM l GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    {_sql_hits('t', SYMBOLS)}::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, n_left
  FROM w JOIN lines USING (doc_id) LEFT JOIN r USING (doc_id)
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_left >= 0.5 * n_words AS kept
FROM f
"""
