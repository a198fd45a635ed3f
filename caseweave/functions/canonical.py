"""Normal forms and canonical keys of identifiers: equality of keys is identity, names are never matched loosely."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import EMAIL, LEGAL_FORM, normalize_phone, normalize_vehicle

KINDS = {
    "sender": "party", "receiver": "party", "phone_numbers": "phone", "email_addresses": "email", "account_identifiers": "account",
    "transaction_reference": "reference", "device_identifier": "device", "vehicle_identifiers": "vehicle",
    "organisation_names": "organisation", "person_names": "person", "location_names": "location",
}
_EMAIL = "^(?:" + EMAIL.replace(r"\b", "") + ")$"


def _alnum(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def _words(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def normalize_identifier(kind: str, value: Column) -> Column:
    v = F.trim(value)
    if kind == "phone":
        return normalize_phone(v)
    if kind in ("email", "upi_id", "url", "ifsc", "utr", "transaction_reference"):
        return F.regexp_replace(F.lower(v), "[.,;:)]+$", "")
    return F.regexp_replace(v, r"[\s-]", "") if kind in ("account_number", "device_identifier") else v


def normalize_organisation(value: Column) -> Column:
    """Without trailing legal forms, however many; the whole name where nothing else is left."""
    bare = F.regexp_replace(F.trim(value), r"(?i)(?:[\s,.]+" + LEGAL_FORM + r")+\s*$", "")
    return F.coalesce(F.nullif(_words(bare), F.lit("")), _words(value))


def normalize_person(value: Column) -> Column:
    return _words(value)


normalize_location = normalize_person


def classify_account(value: Column) -> Column:
    return (
        F.when(value.rlike(_EMAIL), "email")
        .when(value.contains("@"), "upi")
        .when(F.upper(value).rlike("^[A-Z]{4}0[A-Z0-9]{6}$"), "ifsc")
        .otherwise("account")
    )


def reads_as_a_name(folded: Column) -> Column:
    """One to four words of letters, each longer than one."""
    return folded.rlike("^[a-z]{2,}( [a-z]{2,}){0,3}$")


def canonicalize(field: str, raw: Column) -> Column:
    """struct(entity_type, display, key) of an observed value, or null where it identifies nothing."""
    v = F.trim(raw)
    usable = F.length(v).between(1, 320)
    digits = F.regexp_replace(v, r"\D", "")
    node = lambda t, display, key: F.struct(t.alias("entity_type"), display.alias("display"), key.alias("key"))
    account = classify_account(v)
    account_key = F.when(account.isin("account", "ifsc"), _alnum(v)).otherwise(F.lower(v))
    kind = KINDS[field]
    if kind == "phone":
        out = F.when(F.length(digits) >= 10, node(F.lit("phone"), normalize_phone(v), F.right(digits, F.lit(10))))
    elif kind in ("email", "account"):
        out = node(account, v, account_key)
    elif kind == "reference":
        folded = F.translate(_alnum(v), "oil", "011")
        out = F.when(F.length(folded) >= 6, node(F.lit("reference"), v, folded))
    elif kind == "device":
        out = node(F.lit("device"), v, _alnum(v))
    elif kind == "vehicle":
        out = F.when(F.length(normalize_vehicle(v)) >= 8, node(F.lit("vehicle"), F.upper(v), normalize_vehicle(v)))
    elif kind == "party":
        name = normalize_person(v)
        out = (
            F.when(F.length(digits) >= 10, node(F.lit("phone"), normalize_phone(v), F.right(digits, F.lit(10))))
            .when(v.contains("@"), node(account, v, F.lower(v)))
            .when(F.length(name) >= 3, node(F.when(reads_as_a_name(name), "person").otherwise("party"), v, name))
        )
    else:
        folded = normalize_organisation(v) if kind == "organisation" else normalize_person(v)
        out = F.when(F.length(folded) >= 3, node(F.lit(kind), v, folded))
    return F.when(usable, out)
