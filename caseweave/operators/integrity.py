"""Hash chains, Merkle trees and keyed digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """A JSON string in ASCII, with lower-case escapes; null where the text is null."""
    named = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(c: Column) -> Column:
        out = F.when(c.rlike(r'^[ !#-\[\]-~]$'), c)
        for char, form in named.items():
            out = out.when(c == char, F.lit(form))
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        return out.otherwise(F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise("")))

    chars = F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0))
    plain = F.when(text.rlike(r"\A[ !#-\[\]-~]*\z"), F.concat(F.lit('"'), text, F.lit('"')))  # nothing to escape
    return F.when(text.isNull(), F.lit("null")).otherwise(F.coalesce(plain, F.concat(F.lit('"'), F.array_join(F.transform(chars, escaped), ""), F.lit('"'))))


def canonical_json(fields: dict[str, Column]) -> Column:
    """One object with its keys in order and no spacing. Values: string columns; any others have to be JSON text already, in a
    one-element tuple."""
    parts = []
    for name in sorted(fields):
        value = fields[name]
        parts += [F.lit(("," if parts else "") + f'"{name}":'), F.coalesce(value[0], F.lit("null")) if isinstance(value, tuple) else json_text(value)]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def entry_hash(payload: Column, previous: Column) -> Column:
    """The plain format: SHA-256 of payload, bar and the hash before it."""
    return F.sha2(F.concat(payload, F.lit("|"), F.coalesce(previous, F.lit(""))), 256)


def chain_hash(payload: Column, previous: Column) -> Column:
    """The format that append_chain seals by: SHA-256 of the entry's canonical JSON, its payload and the hash before it."""
    return F.sha2(canonical_json({"payload": payload, "previous_hash": previous}), 256)


def verify_chain(entries: DataFrame, keys: list[str], strict: bool = False, hashing=entry_hash) -> DataFrame:
    """Per key: entries, hashed, status (empty is absent, broken, unchained or intact), first_break, reason and broken_at.

    entries: keys, id, at, payload, previous_hash, event_hash, sealed by `hashing`. Each row is recomputed by itself and compared with its
    predecessor's hash; altered content comes before a broken link, and a row without a hash starts a new stretch.
    The first hashed entry's predecessor is checked only with `strict`, so a cut-off beginning passes otherwise."""
    from .temporal import previous

    rows = previous(entries, keys, ["event_hash"])
    altered = F.col("event_hash").isNotNull() & (F.col("event_hash") != hashing(F.col("payload"), F.col("previous_hash")))
    before = F.col("prev.event_hash")
    known = before.isNotNull() | (F.lit(strict) & F.col("prev").isNull())
    link = F.col("event_hash").isNotNull() & known & ~before.eqNullSafe(F.col("previous_hash"))
    rows = rows.withColumn("_bad", F.when(altered, "content_altered").when(link, "link_broken"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("entries"), F.count("event_hash").alias("hashed"),
        F.min(F.when(F.col("_bad").isNotNull(), F.struct("at", "id", "_bad"))).alias("_f"),
    )
    status = F.when(F.col("_f").isNotNull(), "broken").when(F.col("hashed") == 0, "unchained").otherwise("intact")
    return out.select(
        *keys, "entries", "hashed", status.alias("status"), F.col("_f.id").alias("first_break"), F.col("_f._bad").alias("reason"), F.col("_f.at").alias("broken_at")
    )


def append_chain(entries: DataFrame, key: str) -> DataFrame:
    """Seal the entries of each key (id, at, payload) in order: key, id, at, payload, previous_hash, event_hash.

    A chain is sequential by nature: each hash needs the one before. Rows come sorted and are sealed as they stream by, so a task
    holds one hash and not a chain, however long."""
    import hashlib
    import json

    import pandas as pd

    rows = entries.select(key, "id", "at", "payload")
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def seal(batches):
        last_key, last = object(), None
        for pdf in batches:
            previous, hashes = [], []
            for k, payload in zip(pdf[key], pdf["payload"]):
                if k != last_key:
                    last_key, last = k, None
                previous.append(last)
                text = json.dumps({"payload": payload, "previous_hash": last}, sort_keys=True, separators=(",", ":"))
                last = hashlib.sha256(text.encode()).hexdigest()
                hashes.append(last)
            yield pdf.assign(previous_hash=pd.Series(previous, index=pdf.index, dtype=object), event_hash=hashes)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", previous_hash string, event_hash string"
    return rows.repartition(n, key).sortWithinPartitions(key, "at", "id").mapInPandas(seal, schema)


def publish(ledger: DataFrame, identities: DataFrame, key: str, contact: str, at) -> DataFrame:
    """Ledger rows to add: digest, case_reference, contact, published_at for identities (case_reference, entity_type, key) that the
    case has not published; append_chain seals them with the rows that stand there."""
    rows = identities.select(
        hmac_sha256(key, F.concat_ws(":", "entity_type", "key")).alias("digest"), "case_reference", F.lit(contact).alias("contact"), F.lit(at).cast("timestamp_ntz").alias("published_at")
    ).dropDuplicates(["digest", "case_reference"])
    return rows.join(ledger.select("digest", "case_reference"), ["digest", "case_reference"], "left_anti")


def withdraw(ledger: DataFrame, case_reference) -> DataFrame:
    """The ledger without a case's rows; the chain breaks there, and verification says so."""
    return ledger.where(~F.col("case_reference").eqNullSafe(F.lit(case_reference)))


def ledger_matches(ledger: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """Rows that other cases published for a case's identities: case_reference, entity_type, key, other, contact, published_at.
    identities: case_reference, entity_type, key."""
    own = identities.distinct().withColumn("_d", hmac_sha256(key, F.concat_ws(":", "entity_type", "key")))
    other = ledger.select("digest", F.col("case_reference").alias("other"), "contact", "published_at")
    return own.join(other, (F.col("_d") == F.col("digest")) & (F.col("case_reference") != F.col("other"))).select(
        "case_reference", "entity_type", "key", "other", "contact", "published_at"
    )


def ledger_verify(entries: DataFrame, keys: list[str], hashing=entry_hash) -> DataFrame:
    """Per key the entries verified before the first failure; the first entry must have no predecessor."""
    found = verify_chain(entries, keys, strict=True, hashing=hashing)
    at = found.select(*(F.col(k).alias(f"_{k}") for k in keys), "broken_at", "first_break", "entries", "status")
    j = entries.join(at, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    before = F.col("first_break").isNull() | (F.struct(F.col("at").alias("a"), F.col("id").alias("i")) < F.struct(F.col("broken_at").alias("a"), F.col("first_break").alias("i")))
    return j.groupBy(*keys, "entries", "status").agg(F.count_if(before).alias("verified")).select(*keys, "entries", "verified", "status")


def merkle_roots(leaves: DataFrame, keys: list[str], levels: int = 40) -> DataFrame:
    """Per key the root over its leaves (keys, place from 0 without gaps, hash): sha256 of two hexadecimal hashes put
    together; an odd node moves up as it is. One grouping a level, so no task holds a tree."""
    rows = leaves.select(*keys, F.col("place").cast("long").alias("place"), "hash")
    depth = leaves.agg(F.max("place")).first()[0]
    for _ in range(0 if depth is None else int(depth).bit_length()):
        pair = rows.groupBy(*keys, F.shiftright("place", 1).alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("place") % 2 == 1, F.col("hash"))).alias("r")
        )
        rows = pair.select(*keys, "place", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("hash"))
    return rows.select(*keys, F.col("hash").alias("root"))


def merkle_proof(leaves: DataFrame, keys: list[str], place: int) -> DataFrame:
    """Per key the sibling path of the leaf at `place`: level, hash, left (whether the sibling stands left)."""
    rows, at, out = leaves.select(*keys, F.col("place").cast("long").alias("place"), "hash"), place, None
    depth = leaves.agg(F.max("place")).first()[0]
    for level in range(0 if depth is None else int(depth).bit_length()):
        step = rows.where(F.col("place") == (at ^ 1)).select(*keys, F.lit(level).alias("level"), "hash", F.lit(bool(at & 1)).alias("left"))
        out = step if out is None else out.unionByName(step)
        pair = rows.groupBy(*keys, F.shiftright("place", 1).alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("place") % 2 == 1, F.col("hash"))).alias("r")
        )
        rows = pair.select(*keys, "place", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("hash"))
        at >>= 1
    return out


def inclusion_proofs(leaves: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Of each wanted leaf (keys, hash): keys, hash, place, set_size, root and verified, whether its path of siblings leads to the
    root; place is null where the set does not hold it. leaves: keys, place from 0, hash. The path is walked by one join a level."""
    first = leaves.groupBy(*keys, "hash").agg(F.min("place").alias("place"))
    sizes = leaves.groupBy(*keys).agg(F.count("*").alias("set_size"))
    at = wanted.join(first, [*keys, "hash"], "left").withColumns({"_at": F.col("place"), "_now": F.col("hash")})
    rows = leaves.select(*keys, F.col("place").cast("long").alias("place"), "hash")
    depth = leaves.agg(F.max("place")).first()[0]
    for _ in range(0 if depth is None else int(depth).bit_length()):
        beside = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("place").alias("_p"), F.col("hash").alias("_h"))
        on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_p") == F.col("_at").bitwiseXOR(F.lit(1))]
        joined = at.join(beside, on, "left")
        now = F.when(F.col("_h").isNull(), F.col("_now")).when(F.col("_at") % 2 == 1, F.sha2(F.concat("_h", "_now"), 256)).otherwise(F.sha2(F.concat("_now", "_h"), 256))
        at = joined.withColumns({"_now": now, "_at": F.shiftright("_at", 1)}).drop(*(f"_{k}" for k in keys), "_p", "_h")
        pair = rows.groupBy(*keys, F.shiftright("place", 1).alias("place")).agg(
            F.max(F.when(F.col("place") % 2 == 0, F.col("hash"))).alias("l"), F.max(F.when(F.col("place") % 2 == 1, F.col("hash"))).alias("r")
        )
        rows = pair.select(*keys, "place", F.when(F.col("r").isNull(), F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("hash"))
    out = at.join(rows.select(*keys, F.col("hash").alias("root")), keys).join(sizes, keys)
    return out.select(*keys, "hash", "place", "set_size", "root", (F.col("place").isNotNull() & (F.col("_now") == F.col("root"))).alias("verified"))


def placed(rows: DataFrame, keys: list[str], order: str, width: int = 1_000) -> DataFrame:
    """rows with `place`, from 0 in each key by the whole number `order`, numbered in spans of `width` with counts handed on, so that
    no task orders a whole key."""
    spans = rows.withColumn("_s", F.floor(F.col(order) / width))
    n = spans.groupBy(*keys, "_s").agg(F.count("*").alias("n"))
    ahead = n.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_s").alias("_t"), (F.sum("n").over(Window.partitionBy(*keys).orderBy("_s")) - F.col("n")).alias("_ahead"))
    inner = spans.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(order)) - 1)
    out = inner.join(ahead, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_s") == F.col("_t")])
    return out.select(*rows.columns, (F.col("_ahead") + F.col("_i")).alias("place"))


def snapshot_hash(rows: DataFrame, keys: list[str], order: list[str], digest: Column) -> DataFrame:
    """Per key a hash over all its rows in order, by levels (a Merkle root), so that no task holds a key's rows. Places come from
    counts by hash prefix, not from a sort of the whole key."""
    named = rows.select(*keys, F.sha2(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in order), digest), 256).alias("hash"))
    named = named.withColumn("part", F.substring("hash", 1, 3))
    counts = named.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("hash")) - 1
    return merkle_roots(named.withColumn("i", within).join(before, [*keys, "part"]).select(*keys, (F.col("ahead") + F.col("i")).alias("place"), "hash"), keys)


def verify_proof(leaf: str, path: list[tuple[str, bool]], root: str) -> bool:
    """Whether a leaf and its path (hash, stands left) lead to the root."""
    import hashlib

    for sibling, left in path:
        leaf = hashlib.sha256(((sibling + leaf) if left else (leaf + sibling)).encode()).hexdigest()
    return leaf == root


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from two built-in hashes: H((k ^ opad) + H((k ^ ipad) + m))."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)
