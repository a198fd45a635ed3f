"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. A flow on that small graph routes every
source's quota of words into patterns; a pattern's r-th pass over its documents costs r a word, so
repetition is convex and a second pass starts only where first passes are used up. The flow says how many
words each pattern gives; its documents then supply them, whole passes first and the rest from documents in
the order of a seeded hash.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import free_names, materialize, table, words

MOST_PASSES = 3
PART_DIGITS = 3  # hexadecimal digits of the draw that part a pattern: 4,096 parts
#: Patterns and sources are metadata; the flow graph is solved on the driver up to this many patterns.
MOST_PATTERNS = 50_000


def targets(sizes: dict[str | None, int], weights: dict | None = None, passes: int = MOST_PASSES) -> dict:
    """Words that each source should give: shares of the total by weight, none above `passes` times its size.

    Without weights, sources weigh 1, 2, 3 in turn by code point, null last. What a source can't take is
    shared again by weight among the others.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: Fraction(str(weights[s])) if weights else Fraction(1 + i % 3) for i, s in enumerate(names)}
    out, open_ = {}, [s for s in names if sizes[s] and weight[s]]
    left = Fraction(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= passes * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            out[s] = Fraction(passes * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in full]
    return {s: out.get(s, Fraction(0)) for s in names}


def route(patterns: dict[str, int], quotas: dict[str | None, int], passes: int = MOST_PASSES) -> dict[tuple, int]:
    """Minimum-cost flow: words routed for each (pattern, source).

    patterns: JSON list of sources -> words. Cheapest paths end in first passes, then second ones and so on,
    so successive shortest paths are maximum flows with one more pass of every pattern opened at a time.
    """
    members = {p: json.loads(p) for p in patterns}
    holders = defaultdict(list)
    for p, names in members.items():
        for s in names:
            holders[s].append(p)
    flow: dict[tuple, int] = defaultdict(int)
    supply, room = dict(quotas), dict.fromkeys(patterns, 0)
    for _ in range(passes):
        for p, size in patterns.items():
            room[p] += size
        dry: set = set()  # sources from which no room can be reached
        for s in quotas:
            while supply[s] and s not in dry:
                came, queue, end = {("s", s): None}, deque([("s", s)]), None
                while queue and end is None:
                    kind, x = queue.popleft()
                    for y in holders[x] if kind == "s" else members[x]:
                        node = ("p" if kind == "s" else "s", y)
                        if node in came or (kind == "p" and not flow[x, y]):
                            continue
                        came[node] = (kind, x)
                        if kind == "s" and room[y]:
                            end = node
                            break
                        queue.append(node)
                if end is None:
                    dry |= {x for k, x in came if k == "s"}
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                steps = list(zip(path, path[1:], strict=False))
                back = [flow[a[1], b[1]] for a, b in steps if a[0] == "p"]
                amount = min([supply[s], room[end[1]], *back])
                for a, b in steps:
                    if a[0] == "s":
                        flow[b[1], a[1]] += amount
                    else:
                        flow[a[1], b[1]] -= amount
                supply[s] -= amount
                room[end[1]] -= amount
    return {k: v for k, v in flow.items() if v}


def _keyed(docs: DataFrame, id_col: str, text_col: str, sources_col: str, seed: str, keep: list[str]) -> DataFrame:
    """docs' columns `keep` with id, pattern, size, draw, part and a checksum of the text in one column `m`."""
    source = F.col(sources_col)
    if docs.schema[sources_col].dataType.typeName() == "array":
        empty = source.isNull() | (F.size(source) == 0)
        listed = F.when(empty, F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(source)))
    else:
        listed = F.array(source.cast("string"))
    text = F.col(text_col).cast("string")
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("\\N"))))
    (m,) = free_names(docs.columns, "m")
    row = F.struct(
        F.col(id_col).alias("id"),
        F.to_json(listed, {"ignoreNullFields": "false"}).alias("pattern"),
        F.size(words(text)).cast("long").alias("size"),
        draw.alias("draw"),
        F.substring(draw, 1, PART_DIGITS).alias("part"),
        F.xxhash64(text).alias("checksum"),
    )
    # explode keeps filters on the measures above the counting of words
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.explode(F.array(row)).alias(m))


def _plan(spark: SparkSession, parts: DataFrame, weights: dict | None) -> tuple[DataFrame, dict]:
    """For each pattern: passes, the rest, target, size, and where among the parts the rest ends; and the flow.

    parts: pattern, part, size. Plan and edges have one row a pattern at most: MOST_PATTERNS bounds them."""
    found = parts.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} membership patterns; group rare sources before mixing")
    patterns = {r.pattern: r.size for r in found}
    sizes: dict = defaultdict(int)
    for p, size in patterns.items():
        for i, s in enumerate(names := json.loads(p)):  # a shared document counts in parts for its sources
            sizes[s] += size // len(names) + (i < size % len(names))
    wanted = targets(sizes, weights)
    # round() of running sums, so that quotas add up to the rounded total
    quotas, run = {}, Fraction(0)
    for s, t in wanted.items():
        quotas[s] = round(run + t) - round(run)
        run += t
    flow = route(patterns, quotas)
    given: dict = defaultdict(int)
    for (p, _), n in flow.items():
        given[p] += n
    plan = spark.createDataFrame(
        [
            (p, *(divmod(given[p], size) if size else (0, 0)), float(sum(wanted[s] for s in json.loads(p))), size)
            for p, size in patterns.items()
        ],
        "_p string, passes long, rest long, target double, pattern_size long",
    )
    ahead = parts.selectExpr(
        "pattern", "part", "size", "sum(size) OVER (PARTITION BY pattern ORDER BY part) - size AS ahead"
    ).join(plan, F.col("pattern") == F.col("_p"))
    edge = ahead.where("ahead < rest AND ahead + size > rest").select(
        F.col("pattern").alias("_e"), F.col("part").alias("edge"), "ahead"
    )
    # with no part astride the rest, parts that start below it are taken whole
    last = ahead.where("ahead < rest").groupBy(F.col("pattern").alias("_w")).agg(F.max("part").alias("last"))
    full = plan.join(edge, F.col("_p") == F.col("_e"), "left").join(last, F.col("_p") == F.col("_w"), "left")
    return full.select("_p", "passes", "rest", "target", "pattern_size", "edge", "ahead", "last"), flow


def _take(keyed: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and `t`: the measures with copies, taken, target and pattern_size. Only the rows of one part of each pattern,
    a 4,096th of it, are moved and ordered."""
    m = keyed.columns[-1]
    (t,) = free_names([*keyed.columns, *plan.columns], "t")
    plan = plan.select(F.col("_p").alias(t + "p"), F.struct("*").alias(t))
    at, of = lambda name: F.col(m)[name], lambda name: F.col(t)[name]
    joined = keyed.join(F.broadcast(plan), at("pattern") == F.col(t + "p"))
    astride = F.coalesce(at("part") == of("edge"), F.lit(False))
    rows = [F.col(f"`{c}`") for c in keep]

    def done(frame: DataFrame, extra) -> DataFrame:
        copies = F.when(at("size") > 0, of("passes") + extra).otherwise(0).cast("int")
        return frame.select(
            *rows,
            F.struct(
                f"{m}.id", f"{m}.pattern", f"{m}.size", copies.alias("copies"), (copies * at("size")).cast("long").alias("taken"),
                of("target").alias("target"), of("pattern_size").alias("pattern_size"),
            ).alias(t),
        )

    whole = F.when(F.coalesce(at("part") <= of("last"), F.lit(False)), 1).otherwise(0)
    by = Window.partitionBy(at("pattern")).orderBy(at("draw"), at("id"), at("size"), at("checksum")).rowsBetween(Window.unboundedPreceding, 0)
    upto = of("ahead") + F.sum(at("size")).over(by)
    exact = joined.where(astride).withColumn(t + "upto", upto)
    exact = done(exact, F.when(2 * F.col(t + "upto") - at("size") <= 2 * of("rest"), 1).otherwise(0))
    return done(joined.where(~astride), whole).unionByName(exact)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources_col: str = "source",
    weights: dict | None = None,
    seed: str = "caseweave",
) -> tuple[DataFrame, DataFrame]:
    """(documents, flow). documents: id, pattern, size, copies, taken, target (of the pattern's sources), pattern_size.
    flow: pattern, source, words.

    `sources_col` holds one source or an array of them; null is a source of its own, and an empty array
    counts as null. Sizes are word counts; null and blank texts have none and are never taken. A document is
    taken `copies` (0 to 3) whole times; a source misses its target by half its boundary document at most,
    where its own documents can reach it. Ties of the draw go by id, size and a checksum of the text; rows that repeat an id
    are drawn together and each counts. A source in several patterns gets its words from any of them. An empty
    table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = materialize(_keyed(docs, id_col, text_col, sources_col, seed, []), "sizes")
    m = rows.columns[-1]
    parts = materialize(rows.groupBy(f"{m}.pattern", f"{m}.part").agg(F.sum(f"{m}.size").alias("size")), "parts")
    plan, flow = _plan(spark, parts, weights)
    out = _take(rows, materialize(plan, "plan"), [])
    routed = spark.createDataFrame([(p, s, n) for (p, s), n in flow.items()], "pattern string, source string, words long")
    return out.select(f"{out.columns[-1]}.*"), routed


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources_col: str = "source",
    weights: dict | None = None,
    seed: str = "caseweave",
) -> DataFrame:
    """The documents of the mix, each row as often as it is taken; columns as they were. See mix.

    Texts stay where they are read, but for the few rows that `_take` orders: words are counted twice instead."""
    keyed = _keyed(docs, id_col, text_col, sources_col, seed, docs.columns)
    m = keyed.columns[-1]
    parts = materialize(keyed.groupBy(f"{m}.pattern", f"{m}.part").agg(F.sum(f"{m}.size").alias("size")), "parts")
    plan, _ = _plan(docs.sparkSession, parts, weights)
    out = _take(keyed, materialize(plan, "plan"), docs.columns)
    t = out.columns[-1]
    out = out.where(F.col(t)["copies"] > 0).withColumn(t, F.explode(F.sequence(F.lit(1), F.col(t)["copies"])))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mix(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("pattern_size").alias("source_size"),
        F.round("target", 6).alias("target"),
        "taken",
    )


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    md5('caseweave|' || coalesce(doc_id::VARCHAR, '\\N')) AS draw
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), o AS (  -- in the order in which sources fill up
  SELECT *, coalesce(sum(3 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
    sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, sum(n) OVER () AS total
  FROM s
), level AS (
  SELECT arg_min((total - full_before) / w_left, n / w) AS x FROM o WHERE (total - full_before) / w_left < 3 * n / w
), t AS (
  SELECT source, n, w, CASE WHEN x IS NULL OR x * w > 3 * n THEN 3 * n ELSE x * w END AS target FROM s LEFT JOIN level ON true
), q AS (
  SELECT *, round_even(sum(target) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING), 0)
    - round_even(coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS quota FROM t
), c AS (
  SELECT d.*, q.n, q.target, q.quota::BIGINT // greatest(q.n, 1) AS passes, q.quota::BIGINT % greatest(q.n, 1) AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, n AS source_size, round(target::DOUBLE, 6) AS target,
  (size * (passes + CASE WHEN size > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
