"""Identifiers found in a text, as arrays of normal forms (sorted, distinct), in SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns by which identifiers are recognised.
PHONE = r"(?<!\d)(?:\+?91[\s-]?|0)?[6-9]\d{9}(?!\d)"
PHONE_GROUPED = r"(?<!\d)(?:\+?91[\s-]?)?(?:[6-9]\d{4}[\s-]\d{5}|[6-9]\d{2}[\s-]\d{3}[\s-]\d{4})(?!\d)"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
UPI = r"\b[a-zA-Z0-9._-]{2,120}@[a-zA-Z][a-zA-Z0-9.-]{1,80}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
ACCOUNT = r"(?i)(?:A/C|ACCOUNT(?:\s+NO\.?)?)\s*[:#-]?\s*(\d{9,18})"
REFERENCE = r"(?i)(?:UTR|RRN|REFERENCE(?:\s+ID)?|TXN(?:\s+ID)?|TRANSACTION\s+ID)\s*[:#-]?\s*([A-Z0-9-]{8,32})"
DEVICE = r"(?i)(?:IMEI|DEVICE(?:\s+ID)?)\s*[:#-]?\s*([A-Z0-9-]{8,32})"
URL = r"(?i)https?://[^\s<>'\"]+"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
NAMED_PERSON = r"(?:Name|Beneficiary|Sender|Receiver|From|To)\s*[:#-]\s*([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){0,3})"
PLATE = r"(?<![A-Za-z0-9])[A-Za-z]{2}[\s-]?\d{1,2}[A-Za-z]?[\s-]?[A-Za-z]{1,3}[\s-]?\d{4}(?![A-Za-z0-9])"
PLATE_BHARAT = r"(?i)(?<![A-Za-z0-9])\d{2}[\s-]?BH[\s-]?\d{4}[\s-]?[A-Za-z]{1,2}(?![A-Za-z0-9])"
STATE_CODES = (
    "AN AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD OR PB PY RJ SK TN TR TS UA UK UP WB"
).split()
LEGAL_FORM = r"(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|Public\s+Limited|Ltd\.?|Limited|LLP|Corporation|Corp\.?|Inc\.?)"
DESCRIPTOR = (
    r"(?:Bank|Enterprises?|Traders?|Trading\s+Co\.?|Industries|Technologies|Techno|Solutions|Services|Associates"
    r"|Agency|Agencies|Motors|Logistics|Transports?|Builders|Constructions?|Infra|Finance|Capital|Foundation|Trust"
    r"|Society|&\s*Sons|and\s+Sons)"
)
ORGANISATION = (
    r"\b((?:[A-Z][A-Za-z&.\-]{1,20}\s+){0,3}[A-Z][A-Za-z&.\-]{1,20}\s+(?:"
    + DESCRIPTOR + "|" + LEGAL_FORM
    + r")(?:\s+of\s+[A-Z][A-Za-z]{1,20}(?:\s+[A-Z][A-Za-z]{1,20}){0,2})?(?:\s+" + LEGAL_FORM + r")?)(?![A-Za-z])"
)
FIR = r"(?i)\bFIR\s*(?:No\.?|Number)?\s*[:#-]?\s*(\d{1,6}\s*/\s*\d{2,4})"
#: The older vocabulary's.
INDICATOR_PHONE = r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)"
INDICATOR_REFERENCE = r"(?i)(?:UTR|REFERENCE(?:\s+ID)?|TXN(?:\s+ID)?)\s*[:#-]?\s*([A-Z0-9-]{8,32})"


# What every match of a costly pattern holds; texts without it are not searched for it.
HINTS = {
    PHONE: r"[6-9]\d{9}", PHONE_GROUPED: r"\d[\s-]\d{3}", UPI: "@", EMAIL: "@", IFSC: "[A-Z]{4}0", ACCOUNT: r"(?i)A/C|ACCOUNT", URL: "(?i)https?://",
    INDICATOR_PHONE: r"[6-9]\d{9}", INDICATOR_REFERENCE: "(?i)UTR|REFERENCE|TXN", NAMED_PERSON: r"(?=[NBSRFT])(?:Name|Beneficiary|Sender|Receiver|From|To)\s*[:#-]",
    PLATE: r"[A-Za-z][\s-]?\d{4}", PLATE_BHARAT: r"(?i)BH[\s-]?\d{4}", IP: r"\d\.\d",
    ORGANISATION: r"(?=[PLCIBETSAMF])(?:Pvt|Private|Public|Ltd|Limited|LLP|Corp|Inc|Bank|Enterprise|Trader|Trading|Industries|Techno|Solutions|Services|Associates|Agenc|Motors"
    r"|Logistics|Transport|Builders|Construction|Infra|Finance|Capital|Foundation|Trust|Society|Sons)",
}


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))
    return F.when(text.rlike(HINTS[pattern]), found).otherwise(F.array().cast("array<string>")) if pattern in HINTS else found


def _set(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts) if len(parts) > 1 else parts[0]))


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))


def normalize_phone(value: Column) -> Column:
    """+91 and the last ten digits; a value with fewer digits as it stands, trimmed."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) >= 10, F.concat(F.lit("+91"), F.right(digits, F.lit(10)))).otherwise(F.trim(value))


def normalize_vehicle(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))


def find_phone_numbers(text: Column) -> Column:
    return _set(F.transform(F.concat(_all(text, PHONE), _all(text, PHONE_GROUPED)), normalize_phone))


def find_email_addresses(text: Column) -> Column:
    return _set(F.transform(_all(text, EMAIL), F.lower))


def find_account_identifiers(text: Column) -> Column:
    handles = F.filter(_all(text, UPI), lambda x: ~x.rlike("^(?:" + EMAIL.replace(r"\b", "") + ")$"))
    return _set(_all(text, ACCOUNT, 1), F.transform(_all(text, IFSC), F.upper), F.transform(handles, F.lower))


def find_transaction_reference(text: Column) -> Column:
    """The first labelled reference, or null."""
    return _first(text, REFERENCE)


def find_device_identifier(text: Column) -> Column:
    return _first(text, DEVICE)


def find_vehicle_identifiers(text: Column) -> Column:
    """Plates with a real state code, and the all-India series."""
    codes = F.array(*map(F.lit, STATE_CODES))
    plates = F.filter(_all(text, PLATE), lambda p: F.array_contains(codes, F.upper(F.substring(p, 1, 2))))
    return _set(F.transform(F.concat(plates, _all(text, PLATE_BHARAT)), normalize_vehicle))


def find_organisations(text: Column) -> Column:
    return _set(F.transform(_all(text, ORGANISATION, 1), lambda x: F.regexp_replace(x, r"\s+", " ")))


def find_urls(text: Column) -> Column:
    return _set(_all(text, URL))


def find_ip_addresses(text: Column) -> Column:
    return _set(_all(text, IP))


def find_fir_number(text: Column) -> Column:
    return F.regexp_replace(_first(text, FIR), r"\s", "")


def sentences(text: Column) -> Column:
    """Pieces after a full stop, question or exclamation mark, or a line end; blank ones left out."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, F.trim), lambda s: s != "")


def indicators(text: Column) -> Column:
    """The older vocabulary: array of (entity_type, value, normalized, confidence), one for each type and normal form."""
    sure = ("upi_id", "email", "ifsc", "utr", "account_number")
    rules = [
        ("phone", INDICATOR_PHONE, 0), ("upi_id", UPI, 0), ("email", EMAIL, 0), ("url", URL, 0),
        ("ifsc", IFSC, 0), ("account_number", ACCOUNT, 1),
        ("utr", INDICATOR_REFERENCE, 1), ("ip_address", IP, 0),
        ("person", NAMED_PERSON, 1),
    ]

    def normal(kind: str, v: Column) -> Column:
        if kind == "phone":
            return F.concat(F.lit("+91"), F.right(F.regexp_replace(v, r"\D", ""), F.lit(10)))
        if kind in ("upi_id", "email", "url", "ifsc", "utr"):
            return F.regexp_replace(F.lower(v), r"[.,;:)]+$", "")
        if kind == "account_number":
            return F.replace(v, F.lit(" "), F.lit(""))
        return F.initcap(F.regexp_replace(v, r"\s+", " ")) if kind == "person" else v

    def found(kind: str, pattern: str, group: int) -> Column:
        return F.transform(
            _all(text, pattern, group),
            lambda v: F.struct(
                F.lit(kind).alias("entity_type"),
                F.trim(v).alias("value"),
                normal(kind, F.trim(v)).alias("normalized"),
                F.lit(0.93 if kind in sure else 0.86).alias("confidence"),
            ),
        )

    every = F.concat(*(found(*r) for r in rules))
    # of equal keys the last match gives the value
    def last(xs: Column) -> Column:
        keys = F.array_distinct(F.transform(xs, lambda x: F.struct(x["entity_type"].alias("t"), x["normalized"].alias("n"))))
        return F.transform(keys, lambda k: F.element_at(F.filter(xs, lambda x: (x["entity_type"] == k["t"]) & (x["normalized"] == k["n"])), -1))

    # the matches are found once, not anew for every key
    return F.get(F.transform(F.array(every), last), F.lit(0))
