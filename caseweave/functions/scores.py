"""Bands, phrases and positions: small decisions as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds, weights and confidences by which evidence is graded.
BRIDGE_WEIGHT = {
    "reference": 1.0, "device": 0.95, "account": 0.92, "vehicle": 0.90, "ifsc": 0.90, "upi": 0.90, "email": 0.88, "phone": 0.85,
    "organisation": 0.50, "party": 0.45, "person": 0.40, "location": 0.25,
}
BRIDGE_DEFAULT = 0.60
RELATION_CONFIDENCE = {
    "CALLED": 0.92, "TRANSFERRED_TO": 0.90, "MESSAGED": 0.88, "REQUESTED_PAYMENT_FROM": 0.85, "USED_VEHICLE": 0.82,
    "COMMUNICATED_WITH": 0.75, "LOCATED_AT": 0.72, "ASSOCIATED_WITH": 0.60, "MENTIONED_WITH": 0.35,
}
RELATION_DEFAULT = 0.3
ROLE_PATTERNS = [
    ("balance", r"(?i)\b(?:closing|available|avl|current|opening)?\s*(?:balance|bal|wallet|holdings?|corpus)\b"),
    ("payment", r"(?i)\b(?:paid|sent|debited|credited|transferred|remitted|withdrawn|deposited|received)\b"),
    ("fee", r"(?i)\b(?:fees?|charges?|commission|penalty|fine|tax|gst)\b"),
    ("request", r"(?i)\b(?:pay|send|transfer|remit|deposit|requires?|required|needs?|due|payable)\b"),
]


def lookup(table: dict, key: Column, default: float) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(default)


def band_for(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 0.85, "high").when(score >= 0.60, "medium").otherwise("low")


def strength_band(score: Column) -> Column:
    return F.when(score >= 0.85, "strong").when(score >= 0.60, "moderate").otherwise("weak")


def bridge_strength(kind: Column, n_evidence: Column, best: Column) -> Column:
    """weight * (0.6 + 0.4 * min(n, 4) / 4) * max(confidence, 0.5), to four places, half to even."""
    raw = lookup(BRIDGE_WEIGHT, kind, BRIDGE_DEFAULT) * (0.6 + 0.4 * F.least(n_evidence, F.lit(4)) / 4) * F.greatest(best, F.lit(0.5))
    return F.bround(raw, 4)


def incident_position(moment: Column, start: Column, end: Column) -> Column:
    return (
        F.when(moment.isNull(), "time_not_established")
        .when(start.isNull() & end.isNull(), "no_window_declared")
        .when(moment < start, "before_incident")
        .when(moment > end, "after_incident")
        .otherwise("during_incident")
    )


def classify_amount_role(line: Column) -> Column:
    out = None
    for role, pattern in ROLE_PATTERNS:
        out = F.when(line.rlike(pattern), role) if out is None else out.when(line.rlike(pattern), role)
    return out.otherwise("unknown")


def is_transactional(role: Column) -> Column:
    return F.coalesce(role, F.lit("unknown")) != "balance"


def combined_confidence(model: Column, validation: Column) -> Column:
    return F.when(validation.isNull(), F.bround(model * 0.75, 4)).otherwise(F.bround(0.4 * model + 0.6 * validation, 4))


def redact(text: Column, alias: str, stand_in: str = "Protected person A") -> Column:
    """Every occurrence of the protected alias, in any capitals, gives way to the stand-in."""
    return F.regexp_replace(text, "(?i)\\Q" + alias.replace("\\E", "") + "\\E", stand_in) if alias else text


def money(amount: Column) -> Column:
    return F.format_number(amount, 2)


def confidence_phrase(score: Column, basis: Column) -> Column:
    """How a reading is put to a reader: by its basis where one is recorded, else by its score."""
    by_score = (
        F.when(score.isNull(), "basis not recorded").when(score >= 0.85, "stated directly").when(score >= 0.70, "stated, with some reading")
        .when(score >= 0.50, "inferred from context").otherwise("weakly supported")
    )
    return F.when(basis == "direct", "stated directly").when(basis == "direct_visual", "read from an image").when(basis == "inferred", "inferred from context").otherwise(by_score)


def source_category(name: Column) -> Column:
    """A declared category as lower-case words joined by underscores, 64 characters at most."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")), 1, 64)


def clock_time(text: Column) -> Column:
    """HH:mm in 24 hours of the first clock time in a text (7:05 pm, 19.05, 7 pm), or null."""
    form = r"(?i)\b(\d{1,2})(?:[:.](\d{2}))?\s*([ap])\.?m\b|\b(\d{1,2})[:.](\d{2})\b"
    part = lambda i: F.nullif(F.regexp_extract(text, form, i), F.lit(""))
    hour, half = F.coalesce(part(1), part(4)).try_cast("int"), F.lower(part(3))
    minute = F.coalesce(part(2), part(5), F.lit("00"))
    at = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    return F.when((at < 24) & (minute.try_cast("int") < 60), F.format_string("%02d:%s", at, minute))


def written_forms(clock: Column) -> Column:
    """The ways in which a clock time HH:mm may be written: 19:05, 7:05 pm, 7:05pm, 7.05 pm, 19.05 and, on the hour, 7 pm."""
    hour, minute = F.substring(clock, 1, 2).try_cast("int"), F.substring(clock, 4, 2)
    twelve, half = F.when(hour % 12 == 0, 12).otherwise(hour % 12).cast("string"), F.when(hour < 12, "am").otherwise("pm")
    forms = [clock, F.concat(hour.cast("string"), F.lit(":"), minute), F.concat(F.substring(clock, 1, 2), F.lit("."), minute)]
    forms += [F.concat(twelve, F.lit(sep), minute, F.lit(gap), half) for sep in ":." for gap in (" ", "")]
    return F.array_distinct(F.array_compact(F.array(*forms, F.when(minute == "00", F.concat(twelve, F.lit(" "), half)))))
