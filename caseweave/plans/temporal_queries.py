"""Temporal patterns over contacts and transactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import temporal as t
from ..functions.scores import incident_position
from . import standins as s
from .standins import CASES_SQL, CONTACTS_SQL, RELATIONS_SQL, TRANSACTIONS_SQL, query

BURST_SQL = """
SELECT {keys}, 3 AS contacts, s AS start, at AS "end", round_even(epoch_us(at)/6e7 - epoch_us(s)/6e7, 0)::BIGINT AS minutes, id2 AS first_id, id1 AS second_id, id AS third_id
FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY at, id) AS n FROM (
    SELECT *, lag(at, 2) OVER w AS s, lag(id, 2) OVER w AS id2, lag(id) OVER w AS id1 FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY at, id)
  ) WHERE epoch_us(at) - epoch_us(s) <= 7200000000
) WHERE n = 1
"""


def _live(spark, sf):
    return s.contacts(spark, sf).where("status <> 'rejected' AND at IS NOT NULL")


@query("communication_bursts", "WITH u AS (SELECT user_id, event_id AS id, ts AS at FROM events)" + BURST_SQL.format(keys="user_id", rows="u"))
def communication_bursts(spark, sf):
    e = s.read(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return t.bursts(e, ["user_id"])


@query(
    "communication_bursts_pairs",
    f"WITH {CONTACTS_SQL}, p AS (SELECT case_id, subject % 10 AS a, object % 5 AS b, id, at FROM contacts WHERE status <> 'rejected')"
    + BURST_SQL.format(keys="case_id, a, b", rows="p"),
)
def communication_bursts_pairs(spark, sf):
    return t.bursts(_live(spark, sf).withColumns({"a": F.col("subject") % 10, "b": F.col("object") % 5}), ["case_id", "a", "b"])


@query("pre_incident_contacts", f"""
WITH {RELATIONS_SQL}, {CASES_SQL}, j AS (
  SELECT r.case_id, left(subject, 2) AS "left", left(object, 2) AS "right", at, incident_start FROM rels r JOIN cases c USING (case_id)
  WHERE relation_type IN ('CALLED', 'MESSAGED') AND status <> 'rejected' AND at < incident_start AND at >= incident_start - INTERVAL 48 HOUR
)
SELECT case_id, "left", "right", count(*) AS contacts, max(at) AS last_at,
  round_even((epoch_us(incident_start) - epoch_us(max(at))) / 3.6e9, 1) AS hours_before
FROM j GROUP BY case_id, "left", "right", incident_start HAVING count(*) >= 2
""")  # fmt: skip
def pre_incident_contacts(spark, sf):
    return t.pre_incident(t.contacts(s.relations(spark, sf).withColumns({"subject": F.substring("subject", 1, 2), "object": F.substring("object", 1, 2)})), s.cases(spark, sf))


@query("pre_incident_contacts_events", f"""
WITH {CONTACTS_SQL}, j AS (
  SELECT case_id, least(subject, object) AS "left", greatest(subject, object) AS "right", at, TIMESTAMP '2024-01-20' AS incident_start FROM contacts
  WHERE status <> 'rejected' AND at < TIMESTAMP '2024-01-20' AND at >= TIMESTAMP '2024-01-18'
)
SELECT case_id, "left", "right", count(*) AS contacts, max(at) AS last_at, round_even((epoch_us(incident_start) - epoch_us(max(at))) / 3.6e9, 1) AS hours_before
FROM j GROUP BY case_id, "left", "right", incident_start HAVING count(*) >= 2
""")  # fmt: skip
def pre_incident_contacts_events(spark, sf):
    # the one case of the contacts, with a window declared in January
    cases = s.cases(spark, sf).where("case_id = 0").withColumn("incident_start", F.lit("2024-01-20").cast("timestamp_ntz"))
    return t.pre_incident(_live(spark, sf), cases)


@query("case_chronology", f"""
WITH {RELATIONS_SQL}, {CASES_SQL}
SELECT case_id, count(*) FILTER (ok AND incident_start IS NOT NULL AND at < incident_start) AS before_incident,
  count(*) FILTER (ok AND incident_start IS NOT NULL AND at >= incident_start AND at <= incident_end) AS during_incident,
  count(*) FILTER (ok AND incident_start IS NOT NULL AND at > incident_end) AS after_incident,
  count(*) FILTER (ok AND incident_start IS NULL) AS no_window, bool_or(at IS NULL) AS has_undated
FROM (SELECT *, at IS NOT NULL AND status <> 'rejected' AS ok FROM rels JOIN cases USING (case_id) WHERE relation_type IN ('CALLED', 'MESSAGED'))
GROUP BY case_id
""")  # fmt: skip
def case_chronology(spark, sf):
    return t.chronology(s.relations(spark, sf), s.cases(spark, sf))


@query("incident_position", f"""
WITH {TRANSACTIONS_SQL}, {CASES_SQL}
SELECT id, CASE WHEN at IS NULL THEN 'time_not_established' WHEN incident_start IS NULL THEN 'no_window_declared'
  WHEN at < incident_start THEN 'before_incident' WHEN at > incident_end THEN 'after_incident' ELSE 'during_incident' END AS position
FROM txns JOIN cases USING (case_id)
""")  # fmt: skip
def incident_position_query(spark, sf):
    j = s.transactions(spark, sf).join(s.cases(spark, sf), "case_id")
    return j.select("id", incident_position(F.col("at"), F.col("incident_start"), F.col("incident_end")).alias("position"))


@query("relay_contact", f"""
WITH {CONTACTS_SQL}, e AS (
  SELECT case_id, id, at, subject AS mid, object AS other FROM contacts WHERE status <> 'rejected'
  UNION ALL SELECT case_id, id, at, object, subject FROM contacts WHERE status <> 'rejected'
), h AS (
  SELECT x.case_id, x.other AS a, x.mid AS middle, y.other AS b, x.at AS at1, x.id AS id1, y.at AS at2, y.id AS id2
  FROM e x JOIN e y ON x.case_id = y.case_id AND x.mid = y.mid AND (y.at > x.at OR (y.at = x.at AND y.id > x.id))
    AND epoch_us(y.at) - epoch_us(x.at) <= 7200000000 AND x.other <> y.other
)
SELECT case_id, a, middle, b, id1 AS first_id, id2 AS second_id, round_even((epoch_us(at2) - epoch_us(at1)) / 6e7, 0)::BIGINT AS minutes
FROM (SELECT *, row_number() OVER (PARTITION BY case_id, a, middle, b ORDER BY at1, id1, at2, id2) AS n FROM h) WHERE n = 1
""")  # fmt: skip
def relay_contact(spark, sf):
    return t.relays(_live(spark, sf))


@query("sudden_silence", f"""
WITH {CONTACTS_SQL}, c AS (SELECT case_id, subject, object % 5 AS object, id, at FROM contacts WHERE status <> 'rejected'),
g AS (SELECT *, (epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY subject, object ORDER BY at, id))) / 1e6 AS gap FROM c),
p AS (SELECT case_id, subject, object, count(*) AS contacts, max(at) AS last_at, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 3),
m AS (SELECT case_id, max(at) AS case_last FROM c GROUP BY 1),
f AS (SELECT *, gaps[((contacts - 1) // 2) + 1] AS usual_s, (epoch_us(case_last) - epoch_us(last_at)) / 1e6 AS silent_s FROM p JOIN m USING (case_id))
SELECT case_id, subject, object, contacts, last_at, usual_s, silent_s FROM f WHERE usual_s > 0 AND silent_s >= 4.0 * usual_s
""")  # fmt: skip
def sudden_silence(spark, sf):
    return t.silences(_live(spark, sf).withColumn("object", F.col("object") % 5), ["case_id", "subject", "object"])


@query("rapid_transactions", f"""
WITH {TRANSACTIONS_SQL}, n AS (
  SELECT case_id, id AS second_id, at, lag(id) OVER w AS first_id, (epoch_us(at) - epoch_us(lag(at) OVER w)) / 1e6 AS gap_s, lag(at) OVER w AS at1
  FROM txns WINDOW w AS (PARTITION BY case_id ORDER BY at, id)
)
SELECT case_id, first_id, second_id, round(gap_s, 3) AS gap_s FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY at1, first_id) AS k FROM n WHERE gap_s <= 5400
) WHERE k = 1
""")  # fmt: skip
def rapid_transactions(spark, sf):
    return t.rapid_sequence(s.transactions(spark, sf), ["case_id"])


@query("gap_steps", """
WITH g AS (SELECT user_id, event_id AS id, ts AS at, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap_s FROM events)
SELECT user_id, id, at, 'step' AS kind, NULL::DOUBLE AS gap_s FROM g UNION ALL SELECT user_id, id, at, 'gap', gap_s FROM g WHERE gap_s >= 21600
""")  # fmt: skip
def gap_steps(spark, sf):
    return t.gap_steps(s.read(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at")), ["user_id"])


@query("converging_location", """
WITH r AS (SELECT 0 AS case_id, user_id % 50 AS place, event_id AS id, ts AS at, event_type AS party FROM events),
w AS (
  SELECT x.case_id, x.place, x.id, x.at, count(DISTINCT y.party) AS n FROM r x
  JOIN r y ON x.place = y.place AND y.at >= x.at AND y.at <= x.at + INTERVAL 6 HOUR GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT y.party) >= 3
)
SELECT case_id, place, at, id, n AS n_parties FROM (SELECT *, row_number() OVER (PARTITION BY case_id, place ORDER BY at, id) AS k FROM w) WHERE k = 1
""")  # fmt: skip
def converging_location(spark, sf):
    e = s.read(spark, sf, "events").select(
        F.lit(0).alias("case_id"), (F.col("user_id") % 50).alias("place"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("party")
    )
    return t.convergences(e)


@query("vehicle_corridor", """
WITH f AS (SELECT 0 AS case_id, user_id AS vehicle, event_type AS place, min({'at': ts, 'id': event_id}) AS f FROM events GROUP BY 1, 2, 3)
SELECT case_id, vehicle, count(*) AS n_places, string_agg(place, '>' ORDER BY f.at, f.id) AS route FROM f GROUP BY 1, 2 HAVING count(*) >= 3
""")  # fmt: skip
def vehicle_corridor(spark, sf):
    e = s.read(spark, sf, "events").select(
        F.lit(0).alias("case_id"), F.col("user_id").alias("vehicle"), F.col("event_type").alias("place"), F.col("event_id").alias("id"), F.col("ts").alias("at")
    )
    return t.corridors(e)


@query("first_occurrence", "SELECT user_id, event_type, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1, 2")
def first_occurrence(spark, sf):
    return t.first_occurrence(s.read(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id")


@query("late_arriving_identity", """
SELECT user_id, min(ts) AS first_at, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-01' + INTERVAL 24 HOUR
""")  # fmt: skip
def late_arriving_identity(spark, sf):
    first = t.first_occurrence(s.read(spark, sf, "events"), ["user_id"], "ts", "event_id")
    return first.where(F.col("first_at") >= F.lit("2024-01-02").cast("timestamp_ntz"))
