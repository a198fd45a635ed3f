"""Temporal patterns over contacts: bursts, relays, silences, pre-incident contact, chronology.

A contact is (case_id, id, subject, object, at). Patterns bounded in time are found inside time buckets of
that width: a row also goes to the next bucket, where it can only be somebody's past, so that a busy pair or
case spreads over as many tasks as its time range has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTACT_TYPES = ("CALLED", "MESSAGED", "COMMUNICATED_WITH")
# Windows in seconds, least counts.
BURST_S, BURST_N = 7_200, 3
RELAY_S = 7_200
PRE_INCIDENT_S, PRE_INCIDENT_N = 48 * 3_600, 2
SILENCE_N, SILENCE_TIMES = 3, 4.0
GAP_S = 6 * 3_600
RAPID_S = 90 * 60


def seconds(at: Column) -> Column:
    """Microsecond-exact seconds since 1970 of a timestamp without time zone, independent of the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at) / F.lit(1e6)


def elapsed(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def contacts(relations: DataFrame) -> DataFrame:
    """Dated, unrejected relations of a contact type."""
    return relations.where(
        F.col("relation_type").isin(*CONTACT_TYPES) & F.col("at").isNotNull() & (F.coalesce("status", F.lit("")) != "rejected")
    )


def pair(a: str = "subject", b: str = "object") -> list[Column]:
    return [F.least(a, b).alias("left"), F.greatest(a, b).alias("right")]


def in_buckets(df: DataFrame, width: int, at: str = "at") -> DataFrame:
    """df with `bucket` and `own`: each row in its bucket and, as somebody's past, in the next."""
    here = F.floor(seconds(F.col(at)) / width)
    places = F.array(F.struct(here.alias("bucket"), F.lit(True).alias("own")), F.struct((here + 1).alias("bucket"), F.lit(False).alias("own")))
    return df.withColumn("_b", F.explode(places)).select("*", "_b.bucket", "_b.own").drop("_b")


def previous(df: DataFrame, keys: list[str], columns: list[str], width: int = 30 * 86_400) -> DataFrame:
    """df with `prev`: a struct of `columns` of the row before in its key, by (at, id); null for the first. Rows without a time come
    first. A key is worked through in spans of `width` seconds (of units, where `at` is a number), each handing its last row on, so that a busy key spreads over tasks."""
    timed = df.schema["at"].dataType.typeName().startswith("timestamp")
    span = F.coalesce(F.floor((seconds(F.col("at")) if timed else F.col("at").cast("double")) / width), F.lit(-(1 << 40)))
    rows = df.withColumn("_span", span)
    own = F.struct(*columns)
    last = rows.groupBy(*keys, "_span").agg(F.max(F.struct("at", "id", own.alias("row"))).alias("l"))
    before = F.lag(F.col("l.row")).over(Window.partitionBy(*keys).orderBy("_span"))
    handed = last.select(*(F.col(k).alias(f"_h_{k}") for k in keys), F.col("_span").alias("_h"), before.alias("_handed"))
    within = rows.withColumns({"prev": F.lag(own).over(Window.partitionBy(*keys, "_span").orderBy("at", "id")), "_first": F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("at", "id")) == 1})
    on = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys] + [F.col("_span") == F.col("_h")]
    out = within.join(handed, on).withColumn("prev", F.when(F.col("_first"), F.col("_handed")).otherwise(F.col("prev")))
    return out.select(*df.columns, "prev")


def bursts(df: DataFrame, keys: list[str], id_col: str = "id", at: str = "at", width: int = BURST_S) -> DataFrame:
    """Per key the first contact that ends three within `width` seconds (inclusive): keys, contacts (3), start, end,
    minutes, first_id, second_id, third_id. Ties of time go by id."""
    w = Window.partitionBy(*keys, "bucket").orderBy(at, id_col)
    before = in_buckets(df, width, at)
    cols = {f"{n}{k}": F.lag(c, k).over(w) for k in (1, 2) for n, c in (("_id", id_col), ("_at", at))}
    hits = before.withColumns(cols).where(F.col("own") & (elapsed(F.col("_at2"), F.col(at)) <= width))
    first = hits.groupBy(*keys).agg(
        F.min(F.struct(F.col(at).alias("at"), F.col(id_col).alias("id"), F.col("_at2").alias("s"), "_id1", "_id2")).alias("f")
    )
    return first.select(
        *keys,
        F.lit(BURST_N).alias("contacts"),
        F.col("f.s").alias("start"),
        F.col("f.at").alias("end"),
        F.bround((seconds(F.col("f.at")) - seconds(F.col("f.s"))) / 60, 0).cast("long").alias("minutes"),
        F.col("f._id2").alias("first_id"),
        F.col("f._id1").alias("second_id"),
        F.col("f.id").alias("third_id"),
    )


def pre_incident(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Pairs with two or more contacts in the 48 hours before their case's incident: case_id, left, right, contacts,
    last_at, hours_before. Cases: (case_id, incident_start)."""
    joined = df.join(cases.select(F.col("case_id").alias("_c"), "incident_start"), F.col("case_id") == F.col("_c"))
    before = seconds(F.col("incident_start")) - seconds(F.col("at"))
    return (
        joined.where((before > 0) & (before <= PRE_INCIDENT_S))
        .groupBy("case_id", *pair(), "incident_start")
        .agg(F.count("*").alias("contacts"), F.max("at").alias("last_at"))
        .where(F.col("contacts") >= PRE_INCIDENT_N)
        .select("case_id", "left", "right", "contacts", "last_at",
                F.bround((seconds(F.col("incident_start")) - seconds(F.col("last_at"))) / 3600, 1).alias("hours_before"))
    )


def chronology(relations: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: counts of contacts before, during and after the incident, of those without a window, and whether any
    contact, rejected ones included, has no time."""
    types = relations.where(F.col("relation_type").isin(*CONTACT_TYPES))
    joined = types.join(cases.select(F.col("case_id").alias("_c"), "incident_start", "incident_end"), F.col("case_id") == F.col("_c"))
    live = F.col("at").isNotNull() & (F.coalesce("status", F.lit("")) != "rejected")
    none = F.col("incident_start").isNull() & F.col("incident_end").isNull()
    before, after = F.coalesce(F.col("at") < F.col("incident_start"), F.lit(False)), F.coalesce(F.col("at") > F.col("incident_end"), F.lit(False))
    return joined.groupBy("case_id").agg(
        F.count_if(live & ~none & before).alias("before_incident"),
        F.count_if(live & ~none & ~before & ~after).alias("during_incident"),
        F.count_if(live & ~none & ~before & after).alias("after_incident"),
        F.count_if(live & none).alias("no_window"),
        F.bool_or(F.col("at").isNull()).alias("has_undated"),
    )


#: Rows of a block of a middle's contacts, and hits that a task holds at once.
RELAY_ROWS, RELAY_HITS = 65_536, 2_000_000


def relays(df: DataFrame, width: int = RELAY_S, most: int = RELAY_ROWS) -> DataFrame:
    """Paths a - middle - b of two contacts within `width` seconds (inclusive), three different ends; the first pair of
    contacts of each path: case_id, a, middle, b, first_id, second_id, minutes. Direction of contact is ignored.

    A busy middle's contacts are dealt to blocks of about `most` rows by their other end, and each pair of blocks meets in a group
    of its own; middles of fewer rows share groups. All hits of a path fall into one group, so contacts are shuffled and hits never are."""
    ends = df.where("case_id IS NOT NULL AND at IS NOT NULL").select(
        "case_id", "id", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("at")).alias("t"),
        F.explode(F.array(F.struct(F.col("subject").alias("mid"), F.col("object").alias("other")),
                          F.struct(F.col("object").alias("mid"), F.col("subject").alias("other")))).alias("e"),
    ).select("case_id", "id", "t", "e.mid", "e.other").where("mid <> other")
    per = ends.groupBy("case_id", "mid").agg(F.count("*").alias("_n"))
    bins = per.agg(F.ceil(F.sum("_n") / most).cast("int").alias("_bins"))
    dealt = per.crossJoin(bins).select(
        "case_id", "mid", F.ceil(F.col("_n") / most).cast("int").alias("_g"), F.pmod(F.xxhash64("case_id", "mid"), F.col("_bins")).alias("_bin"))
    rows = ends.join(dealt, ["case_id", "mid"]).withColumn("_k", F.pmod(F.xxhash64("other"), F.col("_g")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_g") - 1), lambda j: F.array_compact(F.array(
        F.struct(F.col("_k").alias("i"), j.alias("j"), F.lit(True).alias("first"), (j == F.col("_k")).alias("second")),
        F.when(j != F.col("_k"), F.struct(j.alias("i"), F.col("_k").alias("j"), F.lit(False).alias("first"), F.lit(True).alias("second"))),
    )))
    split = F.col("_g") > 1
    cell = [F.when(split, F.col(c)).alias(f"_{c}") for c in ("case_id", "mid")] + [F.when(~split, F.col("_bin")).alias("bin"), F.col("_c.i").alias("i"), F.col("_c.j").alias("j")]
    placed = rows.withColumn("_c", F.explode(F.flatten(cells))).select("case_id", "mid", "id", "t", "other", "_c.first", "_c.second", *cell)
    kind = {f.name: f.dataType.simpleString() for f in ends.schema.fields}
    schema = f"case_id {kind['case_id']}, a {kind['other']}, middle {kind['mid']}, b {kind['other']}, first_id {kind['id']}, second_id {kind['id']}, minutes long"
    return placed.groupBy("_case_id", "_mid", "bin", "i", "j").applyInArrow(_relay_kernel(width), schema)


def _relay_kernel(width: int):
    """The relays among the contacts of a group, in slices of RELAY_HITS hits."""
    from collections.abc import Iterator

    import pyarrow as pa

    def kernel(batches):
        import numpy as np
        import pyarrow.compute as pc

        def codes(*names):
            """Dense numbers of the columns' values, in no order."""
            out = np.zeros(len(table), dtype="int64")
            for n in names:
                c = pc.dictionary_encode(table[n].combine_chunks())
                out = out * (len(c.dictionary) + 1) + pc.fill_null(c.indices, len(c.dictionary)).to_numpy()
            return np.unique(out, return_inverse=True)[1].astype("int64")

        reach = width * 1_000_000
        table = pa.Table.from_batches(list(batches))
        order = pc.sort_indices(table.select(["t", "id"]), sort_keys=[("t", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        table = table.take(pa.array(order))
        t, known = table["t"].to_numpy(), table["id"].is_valid().to_numpy(zero_copy_only=False)
        one = codes("t", "id")
        rank = np.concatenate(([0], np.cumsum(one[1:] != one[:-1])))  # equal for equal (t, id)
        mid, other = codes("case_id", "mid"), codes("other")
        first, second = (table[c].to_numpy(zero_copy_only=False) for c in ("first", "second"))
        span, others = len(table) + 1, int(other.max()) + 1
        ia, ib = np.flatnonzero(first), np.flatnonzero(second)
        ia, ib = ia[np.lexsort((ia, other[ia], mid[ia]))], ib[np.lexsort((ib, mid[ib]))]
        at_b = mid[ib] * span + rank[ib]
        after = np.where(known[ia], rank[ia], _last(np, rank, t, t[ia]))  # a contact without id is before no other of its time
        upto = _last(np, rank, t, t[ia] + reach)
        lo = np.searchsorted(at_b, mid[ia] * span + after, "right")
        hi = np.maximum(lo, np.searchsorted(at_b, mid[ia] * span + upto, "right"))
        count = hi - lo
        ends_at, begin, last, done = np.cumsum(count), 0, -1, np.empty(0, dtype="int64")
        while begin < len(ia):
            before = ends_at[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends_at, before + RELAY_HITS, "right")))
            c = count[begin:stop]
            i = np.repeat(np.arange(begin, stop), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(lo[begin:stop], c)
            x, y = ia[i], ib[j]
            keep = other[x] != other[y]
            x, y = x[keep], y[keep]
            pair = mid[x] * others + other[x]  # slices are in order of it: only the last goes on in the next
            near = (np.cumsum(np.diff(pair, prepend=pair[:1]) != 0)) * others + other[y]
            at = np.sort(np.unique(near, return_index=True)[1])
            x, y, pair = x[at], y[at], pair[at]
            here = mid[ia[begin]] * others + other[ia[begin]]
            if here != last:  # the slice before ended with a pair of its own
                done = done[:0]
            if len(done):
                fresh = (pair != here) | ~np.isin(other[y], done)
                x, y, pair = x[fresh], y[fresh], pair[fresh]
            last = mid[ia[stop - 1]] * others + other[ia[stop - 1]]
            own = other[y[pair == last]]
            done = np.concatenate((done, own)) if last == here else own
            begin = stop
            px, py = pa.array(x), pa.array(y)
            minutes = pa.array(np.rint((t[y] - t[x]) / 6e7).astype("int64"))
            columns = {"case_id": ("case_id", px), "a": ("other", px), "middle": ("mid", px), "b": ("other", py), "first_id": ("id", px), "second_id": ("id", py)}
            found = pa.table({k: table[c].take(at) for k, (c, at) in columns.items()} | {"minutes": minutes})
            yield from found.combine_chunks().to_batches()

    kernel.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return kernel


def _last(np, rank, t, upto):
    """The rank of the last of the times t (in order) up to each of `upto`."""
    at = np.searchsorted(t, upto, "right") - 1
    return np.where(at < 0, -1, rank[np.maximum(at, 0)])


DIGIT, DIGITS = 18, 3  # bits of a digit and digits of a gap in microseconds, up to 142 years


def order_statistic(values: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """keys, value: of each key the value (not negative, below 2^52) that stands at `rank` (from 1) in order. values: keys, value;
    ranks: keys, rank.

    Selection by digits: equal values are counted, counts add up to counts of their leading digits, and from the leading digit on
    the one in which the rank falls is followed. What meets in a task are the children of one digit, 2^18 at most; no key's values
    are sorted."""
    levels = [values.groupBy(*keys, F.col("value").alias("prefix")).agg(F.count("*").alias("n"))]
    for _ in range(DIGITS - 1):
        levels.append(levels[-1].groupBy(*keys, F.shiftright("prefix", DIGIT).alias("prefix")).agg(F.sum("n").alias("n")))
    at = ranks.select(*keys, F.lit(0).cast("long").alias("above"), F.col("rank").cast("long").alias("rank"))
    running = Window.partitionBy(*keys).orderBy("prefix")
    for level in reversed(levels):
        children = level.withColumn("above", F.shiftright("prefix", DIGIT)).join(at, [*keys, "above"])
        children = children.withColumn("upto", F.sum("n").over(running)).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        at = children.select(*keys, F.col("prefix").alias("above"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    return at.select(*keys, F.col("above").alias("value"))


def silences(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys (with case_id first) whose last contact lies four usual gaps or more before the case's last: keys, contacts,
    last_at, usual_s, silent_s. The usual gap is the upper median of the gaps between consecutive contacts."""
    gaps = previous(df, keys, ["at"]).where("prev IS NOT NULL").select(*keys, F.timestamp_diff("MICROSECOND", F.col("prev.at"), F.col("at")).alias("value"))
    counted = df.groupBy(*keys).agg(F.count("*").alias("contacts"), F.max("at").alias("last_at")).where(F.col("contacts") >= SILENCE_N)
    case_last = df.groupBy(F.col(keys[0]).alias("_c")).agg(F.max("at").alias("case_last"))
    usual = order_statistic(gaps, keys, counted.select(*keys, (F.floor((F.col("contacts") - 1) / 2) + 1).alias("rank")))
    out = counted.join(usual, keys).join(case_last, F.col(keys[0]) == F.col("_c")).withColumn("gap", F.col("value") / F.lit(1e6))
    silent = elapsed(F.col("last_at"), F.col("case_last"))
    return out.where((F.col("gap") > 0) & (silent >= SILENCE_TIMES * F.col("gap"))).select(
        *keys, "contacts", "last_at", F.col("gap").alias("usual_s"), silent.alias("silent_s")
    )


def rapid_sequence(df: DataFrame, keys: list[str], width: int = RAPID_S) -> DataFrame:
    """The first two adjacent dated rows of each key at most `width` seconds apart: keys, first_id, second_id, gap_s."""
    w = Window.partitionBy(*keys, "bucket").orderBy("at", "id")
    rows = in_buckets(df.where("at IS NOT NULL"), width)
    rows = rows.withColumns({"_id": F.lag("id").over(w), "_at": F.lag("at").over(w)}).where("own")
    gap = elapsed(F.col("_at"), F.col("at"))
    first = rows.where(gap <= width).groupBy(*keys).agg(
        F.min(F.struct(F.col("_at").alias("at1"), F.col("_id").alias("id1"), "at", "id")).alias("f")
    )
    return first.select(
        *keys, F.col("f.id1").alias("first_id"), F.col("f.id").alias("second_id"),
        F.round(elapsed(F.col("f.at1"), F.col("f.at")), 3).alias("gap_s"),
    )


def gap_steps(df: DataFrame, keys: list[str], width: int = GAP_S) -> DataFrame:
    """Timed steps with a gap row before each that comes `width` seconds or more after its predecessor."""
    steps = previous(df, keys, ["at"]).withColumn("gap_s", elapsed(F.col("prev.at"), F.col("at")))
    rows = F.array_compact(
        F.array(
            F.when(F.col("gap_s") >= width, F.struct(F.lit("gap").alias("kind"), F.col("gap_s").alias("s"))),
            F.struct(F.lit("step").alias("kind"), F.lit(None).cast("double").alias("s")),
        )
    )
    return steps.withColumn("_x", F.explode(rows)).select(*keys, "id", "at", F.col("_x.kind").alias("kind"), F.col("_x.s").alias("gap_s"))


def convergences(df: DataFrame, width: int = 6 * 3_600, least: int = 3) -> DataFrame:
    """Per (case_id, place) the first row from which `least` different parties appear within `width` seconds:
    case_id, place, at, id, n_parties. df: case_id, place, id, at, party.

    A row is its party's first in the windows that begin after the party's row before it, and no earlier than `width` before
    itself: one more party from there on, one less behind the row. The parties of a window are the sum of these differences up to
    its beginning, so no row gathers its window. Windows that begin in a bucket of time end in it or the next."""
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    micro = width * 1_000_000
    rows = previous(df, ["case_id", "place", "party"], ["at"], width).withColumn("t", us(F.col("at")))
    here = F.floor(F.col("t") / micro)
    rows = rows.withColumn("_b", F.explode(F.array(F.struct(here.alias("bucket"), F.lit(True).alias("own")), F.struct((here - 1).alias("bucket"), F.lit(False).alias("own")))))
    begins = F.greatest(us(F.col("prev.at")) + 1, F.col("t") - micro)
    one = lambda t, d, ask: F.struct(t.alias("t"), F.lit(d).cast("long").alias("d"), ask.alias("ask"))
    no = F.lit(False)
    known = F.col("party").isNotNull()
    steps = F.array_compact(F.array(F.when(known, one(begins, 1, no)), F.when(known, one(F.col("t") + 1, -1, no)), F.when(F.col("_b.own"), one(F.col("t"), 0, F.lit(True)))))
    events = rows.select("case_id", "place", "_b.bucket", "id", "at", F.explode(steps).alias("x")).select("case_id", "place", "bucket", "id", "at", "x.*")
    w = Window.partitionBy("case_id", "place", "bucket").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("n", F.sum("d").over(w)).where(F.col("ask") & (F.col("n") >= least))
    best = seen.groupBy("case_id", "place").agg(F.min(F.struct("at", "id", "n")).alias("f"))
    return best.select("case_id", "place", F.col("f.at").alias("at"), F.col("f.id").alias("id"), F.col("f.n").cast("long").alias("n_parties"))


def corridors(df: DataFrame, least: int = 3) -> DataFrame:
    """Per (case_id, vehicle) its distinct places by first appearance, where there are `least` or more:
    case_id, vehicle, n_places, route. One row per place is gathered, not one per sighting."""
    firsts = df.where("at IS NOT NULL").groupBy("case_id", "vehicle", "place").agg(F.min(F.struct("at", "id")).alias("f"))
    routes = firsts.groupBy("case_id", "vehicle").agg(F.array_sort(F.collect_list(F.struct("f.at", "f.id", "place"))).alias("r"))
    return routes.where(F.size("r") >= least).select(
        "case_id", "vehicle", F.size("r").cast("long").alias("n_places"), F.array_join(F.transform("r", lambda x: x["place"].cast("string")), ">").alias("route")
    )


def first_occurrence(df: DataFrame, keys: list[str], at: str = "at", id_col: str = "id") -> DataFrame:
    best = df.groupBy(*keys).agg(F.min(F.struct(F.col(at).alias("at"), F.col(id_col).alias("id"))).alias("f"))
    return best.select(*keys, F.col("f.at").alias("first_at"), F.col("f.id").alias("first_id"))
