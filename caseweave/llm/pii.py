"""Surrogates for personal data: keyed, consistent over the corpus, of the same type and format.

Detected values are listed once each, by what makes two mentions one entity: digits with the country for phones, the
lower-cased token for names whatever their title, and so on. Numbers, addresses and keys get the successor of their value on
a keyed cycle through all strings of the same shape (script, separators, country, issuer and check digits kept), so that
different values of a shape never share one. Names get drawn syllables of their script, with an ending of the gender that
titles over the whole corpus state. Surrogates are checked against all detected values and each other, and drawn again where
they collide: names grow longer, shapes without a free string are dealt anew as a whole. No value ever stands for itself.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import free_names, materialize, table

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Titles before personal names, with the gender they state.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "don": "m", "signor": "m", "г-н": "m",
    "господин": "m", "κύριος": "m", "mrs": "f", "ms": "f", "miss": "f", "lady": "f", "frau": "f", "madame": "f", "mme": "f",
    "señora": "f", "sra": "f", "doña": "f", "signora": "f", "г-жа": "f", "госпожа": "f", "κυρία": "f", "dr": "u", "prof": "u", "professor": "u",
}
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
PATTERN = re.compile(
    rf"""(?P<email>(?<![\w.%+-])[\w][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}})
    |(?P<hex>(?<![A-Za-z0-9])(?=[0-9A-Fa-f]*\d)(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{{32,}}(?![A-Za-z0-9]))
    |(?P<key>(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|sk-[A-Za-z0-9]{{20,}}|gh[pousr]_[A-Za-z0-9]{{30,}}|AIza[A-Za-z0-9_-]{{35}}
        |xox[abprs]-[A-Za-z0-9-]{{10,}}|eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}})(?![A-Za-z0-9]))
    |(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|(?:api|access|secret)[_-]?key|(?:auth|access)[_-]?token)[ \t]*[:=][ \t]*["']?(?P<secret>(?=[^\s"'<>,;]*\d)[^\s"'<>,;]{{6,}})
    |(?<![A-Za-z0-9])(?i:passport)(?i:[ \t]+(?:no|number))?\.?[ \t]*[:\#]?[ \t]*(?P<passport>[A-Z]{{1,2}}\d{{6,8}})(?![A-Za-z0-9])
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d))
    |(?P<phone>(?<![\d+])(?:\+?\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{4}}(?!\d)
        |(?<![\d+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}(?!\d)|(?<![\d.-])\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?![\d.-]))
    |(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
    |(?P<card>(?<!\d)\d(?:[ -]?\d){{12,18}}(?!\d))
    |(?P<titles>\b(?i:(?:{_TITLE})\.?[ \t]+)+)(?P<name>[^\W\d_a-zа-яα-ω][\w'’-]*(?:[ \t]+[^\W\d_a-zа-яα-ω][\w'’-]*){{0,2}})""",
    re.VERBOSE,
)
#: What every match holds, for Arrow's linear-time matcher; texts without it are passed on unread.
HINT = (
    r"@|\+\p{Nd}|\(\p{Nd}{2,4}\)|\p{Nd}{3}[.-]\p{Nd}{2,3}[.-]\p{Nd}{4}|\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}|[A-Z]{2}\p{Nd}{2} ?[A-Z0-9]{4}"
    r"|\p{Nd}(?:[ -]?\p{Nd}){12}|[0-9A-Fa-f]{32}|AKIA|sk-|gh[pousr]_|AIza|xox[abprs]-|eyJ"
    r"|(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|token|passport)|(?:^|[^\p{L}])(?i:" + _TITLE.replace(r"\-", "-") + r")(?:\.|[ \t])"
)

DIGITS, LOWER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
#: By script: consonants, vowels, and endings that mark a male, a female or no gender.
SYLLABLES = {
    "LATIN": ("bcdfghjklmnprstvz", "aeiou", {"m": ("o", "us", "er", "an"), "f": ("a", "ia", "ina", "ette"), "u": ("en", "is", "on", "el")}),
    "CYRILLIC": ("бвгджзклмнпрст", "аеиоу", {"m": ("ов", "ин", "ий", "ан"), "f": ("а", "ия", "ина", "ова"), "u": ("ко", "их", "ей")}),
    "GREEK": ("βγδζθκλμνπρστφχ", "αεηιου", {"m": ("ος", "ης", "ας"), "f": ("α", "ια", "η"), "u": ("ου", "ις")}),
    "HEBREW": ("בגדזחטכלמנספצקרשת", "אוי", {"m": ("אל", "ון"), "f": ("ה", "ית"), "u": ("י",)}),
    "ARABIC": ("بتجحدرزسشصطعفقكلمن", "اوي", {"m": ("د", "م"), "f": ("ة", "اء"), "u": ("ي",)}),
    "CJK": ("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗", "文国建华金玉天清海云", {"m": tuple("伟强军磊勇杰涛超刚辉"), "f": tuple("芳娜敏静丽艳娟霞秀玲"), "u": tuple("明晨宁佳安平和新")}),
    "HANGUL": ("김이박최정강조윤장임", "지민서현수영은성", {"m": tuple("호준훈철석"), "f": tuple("희미숙순경"), "u": tuple("진우원")}),
    "HIRAGANA": ("かきくけさしたちなに", "あいうえおみゆら", {"m": ("た", "すけ"), "f": ("こ", "みか"), "u": ("る",)}),
    "KATAKANA": ("カキクケサシタチナニ", "アイウエオミユラ", {"m": ("タ", "スケ"), "f": ("コ", "ミカ"), "u": ("ル",)}),
}
#: Endings by which a name without a gendered title passes for a woman's.
FEMALE = ("a", "а", "я", "α", "η", "ה", "ة")
#: Country calling codes of one and of two digits; all others have three.
SHORT_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
PREFIX = re.compile(r"AKIA|sk-|gh[pousr]_|AIza|xox[abprs]-|eyJ|")
_FOUND = "array<struct<s:int,e:int,kind:string,value:string,gender:string>>"


def _neighbours(c: str) -> str:
    """The letters or digits of the script of `c`: its ten decimal digits, or those of its category in its run of 128 code points
    (256 from the CJK ideographs on)."""
    if not c.isalnum():
        return c
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    width = 256 if ord(c) >= 0x3400 else 128
    first, sort = ord(c) // width * width, unicodedata.category(c)
    run = [d for d in map(chr, range(first, first + width)) if d.isalnum() and unicodedata.category(d) == sort]
    if sort == "Ll":
        run = [d for d in run if len(d.upper()) == 1 and d.upper().lower() == d]
    return "".join(run) if c in run and len(run) > 1 else c + LOWER


def _ascii(text: str) -> str:
    """The decimal digits of a text, of whatever script, in ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97


def _code(digits: str) -> int:
    """How many leading digits of an international number are the country's."""
    return next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3)


def canonical(kind: str, found: str, country: str = "1") -> str:
    """What makes two mentions one entity. A phone is `country code|rest`; one without a code has that of `country`."""
    if kind in ("card", "ssn"):
        return _ascii(found)
    if kind == "phone":
        digits = _ascii(found)
        if found.startswith("+"):
            return f"{digits[: (n := _code(digits))]}|{digits[n:]}"
        return f"{digits[:-10]}|{digits[-10:]}" if len(digits) > 10 else f"{country}|{digits}"
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "iban":
        return found.replace(" ", "")
    return found if kind == "key" else found.lower()


def _body(kind: str, value: str) -> tuple[str, str, str]:
    """What stays, what changes, and what follows of a canonical value."""
    if kind == "card":
        return value[:4], value[4:-1], value[-1]
    if kind == "phone":
        at = value.index("|") + 1
        return value[:at], value[at:], ""
    if kind == "iban":
        return value[:4], value[4:], ""
    if kind == "key":
        at = PREFIX.match(value).end()
        return value[:at], value[at:], ""
    if kind == "email":
        at = value.rindex(".")
        return "", value[:at], value[at:]
    return "", value, ""


def _sets(kind: str, body: str) -> list[str]:
    """For each character those that may stand in its place; separators stay."""
    if kind == "ip":
        return []
    if kind == "hex":
        return [HEX] * len(body)
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else LOWER.upper() if c in LOWER.upper() else _neighbours(c) for c in body]


def shape(kind: str, value: str) -> str:
    """Values of one shape have their surrogates among the same strings."""
    head, body, tail = _body(kind, value)
    head, tail = (head[:2], "") if kind == "iban" else (head, "" if kind == "card" else tail)
    return f"{kind}|{head}|{'|'.join(_sets(kind, body))}|{tail}"


def _prf(key: bytes, label: str, n: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{label}|{n}".encode("utf-8", "replace"), key=key[:64], digest_size=32).digest(), "big")


def _walk(key: bytes, label: str, x: int, n: int, forward: bool) -> int:
    """A keyed permutation of range(n), or its inverse: an unbalanced Feistel network, walked until inside."""
    a = int(n**0.5) + 1 if n < 1 << 100 else 1 << (n.bit_length() // 2 + 1)
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(8) if forward else range(7, -1, -1):
            sign = 1 if forward else -1
            if r % 2 == 0:
                left = (left + sign * _prf(key, f"{label}|{n}|{r}", right)) % a
            else:
                right = (right + sign * _prf(key, f"{label}|{n}|{r}", left)) % b
        x = left * b + right
        if x < n:
            return x


def successor(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """The next value of the same shape on the cycle of the key and turn; never the value itself."""
    head, body, tail = _body(kind, value)
    sets, x, n = _sets(kind, body), 0, 1
    if kind == "ip":
        n = 1 << 32
        for part in value.split("."):
            x = x * 256 + int(part)
    for c, s in zip(body, sets):
        x, n = x * len(s) + s.index(c), n * len(s)
    if n == 1:  # nothing but separators: letters drawn by the key stand in
        draw = _prf(key, f"bare|{kind}|{value}", turn)
        return head + "".join(LOWER[draw >> 8 * i & 15] for i in range(4 + turn)) + ("@mail" if kind == "email" else "") + tail
    label = f"{turn}|{shape(kind, value)}"
    x = _walk(key, label, (_walk(key, label, x, n, False) + 1) % n, n, True)
    if kind == "ip":
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    out = []
    for s in reversed(sets):
        x, d = divmod(x, len(s))
        out.append(s[d])
    made = "".join(reversed(out))
    if kind == "card":  # the last digit keeps its relation to the check digit
        tail = str((_luhn(head + made) + int(value[-1]) - _luhn(value[:-1])) % 10)
    if kind == "iban":
        off = int(value[2:4]) - _iban_check(value[:2], body)
        head = f"{value[:2]}{(_iban_check(value[:2], made) + off - 2) % 97 + 2:02d}"
    return head + made + tail


def _script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0]


def name_for(value: str, gender: str, key: bytes, turn: int = 0) -> str:
    """A drawn name in the script of a lower-cased token, with an ending of its gender, as long as the token; from turn 3 on
    longer, and from turn 2 on of any letters of the script."""
    pieces = re.findall(r"[^\W\d_]+|[\W\d_]+", value)
    last = max((i for i, p in enumerate(pieces) if p[0].isalpha()), default=-1)
    out, n_drawn = [], 0

    def pick(options):
        nonlocal n_drawn
        n_drawn += 1
        return options[_prf(key, f"name|{value}|{turn}", n_drawn) % len(options)]

    for i, piece in enumerate(pieces):
        if not piece[0].isalpha():
            out.append("".join(pick(_neighbours(c)) for c in piece))
            continue
        first, second, endings = SYLLABLES.get(_script(piece[0]), (_neighbours(piece[0]),) * 2 + ({},))
        if turn >= 2:
            first = second = "".join(dict.fromkeys(first + second + _neighbours(piece[0])))
        size = len(piece) + (max(0, turn - 2) if i == last else 0)
        fit = [e for e in endings.get(gender, ()) if len(e) < size] if i == last else []
        end = pick(fit) if fit else ""
        if size == 1:
            out.append(pick(first + second))
            continue
        leads = _script(piece[0]) in ("CJK", "HANGUL")  # a family name's sign comes first
        body = [first if (j == 0 if leads else j % 2 == 0) else second for j in range(size - len(end))]
        if end and not leads and end[0] in second and turn < 2:
            body = [first if (size - len(end) - j) % 2 else second for j in range(size - len(end))]
        out.append("".join(map(pick, body)) + end)
    return "".join(out)


def render(kind: str, found: str, surrogate: str) -> str:
    """The surrogate in the format of this mention: its separators, its country code and its capitals."""
    if kind in ("card", "ssn", "phone", "iban"):
        fill, out = list(surrogate.partition("|")[2] if kind == "phone" else surrogate), []
        for c in reversed(found):
            if fill and c.isdecimal():
                c = fill.pop() if kind == "iban" else chr(ord(c) - unicodedata.decimal(c) + int(fill.pop()))
            elif fill and kind == "iban" and c.isalpha():
                c = fill.pop()
            out.append(c)
        return "".join(reversed(out))
    if kind == "name":
        if len(found) > 1 and found == found.upper() and found != found.lower():
            return surrogate.upper()
        return re.sub(r"[^\W\d_]+", lambda m: m.group()[0].upper() + m.group()[1:], surrogate) if found[0] != found[0].lower() else surrogate
    if kind in ("email", "hex"):
        if found == found.upper() and found != found.lower():
            return surrogate.upper()
        return "".join(s.upper() if c.isupper() else s for c, s in zip(found, surrogate)) if len(found) == len(surrogate) else surrogate
    return surrogate


def is_card(digits: str) -> bool:
    """13 to 19 digits of a payment card's range with a right check digit."""
    return digits[0] in "23456" and _luhn(digits[:-1]) == int(digits[-1])


def entities(text: str, country: str = "1") -> list[tuple[int, int, str, str, str | None]]:
    """(start, end, kind, canonical value, gender that a title states) of the personal data of a text, in order, without
    overlaps."""
    out, names = [], {}
    for m in PATTERN.finditer(text):
        if m.group("name"):
            stated = {TITLES[t] for t in re.findall(r"[^\s.]+", m.group("titles").lower())} - {"u"}
            gender = stated.pop() if len(stated) == 1 else "u"
            for t in re.finditer(r"\S+", m.group("name")):
                names.setdefault(t.group(), gender)
                out.append((m.start("name") + t.start(), m.start("name") + t.end(), "name", t.group().lower(), gender))
        elif m.lastgroup in ("secret", "passport"):  # what a label says; the label stays
            out.append((*m.span(m.lastgroup), "key", canonical("key", m.group(m.lastgroup)), None))
        elif m.lastgroup != "card" or is_card(_ascii(m.group())):
            out.append((m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m.group(), country), None))
    if names:  # later mentions without a title
        taken = sorted((s, e) for s, e, *_ in out)
        begins = [s for s, _ in taken]
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)", text):
            at = bisect_left(begins, m.end())  # spans don't overlap, so the one before the end decides
            if not at or taken[at - 1][1] <= m.start():
                out.append((m.start(), m.end(), "name", m.group().lower(), names[m.group()]))
    return sorted(out)


def _detected(column: pa.Array, country: str) -> list[list]:
    """The entities of each text of a batch; only texts with a hint are searched."""
    hinted = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), HINT), False).to_pylist()
    return [entities(column[i].as_py(), country) if h else [] for i, h in enumerate(hinted)]


def _split(place: int, country: str, marked: bool, name: str):
    """Batches to their rows with personal data and its spans, or to their rows without any and a zero."""
    fields = [("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("gender", pa.string())]

    def run(batches):
        for b in batches:
            found = _detected(b.column(place), country)
            keep = pa.array([bool(x) == marked for x in found], pa.bool_())
            if marked:
                rows = [[dict(zip("s e kind value gender".split(), x)) for x in xs] for xs in found if xs]
                last = pa.array(rows, pa.list_(pa.struct(fields)))
            else:
                last = pa.array([0] * (len(found) - sum(map(bool, found))), pa.int64())
            left = b.filter(keep)
            yield pa.RecordBatch.from_arrays([*left.columns, last], [*b.schema.names, name])

    return run


def _shapes(batches):
    for b in batches:
        shapes = [None if k == "name" else shape(k, v) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shapes, pa.string())], ["kind", "value", "gender", "shape"])


def _step(key: bytes, turn: int):
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(3)))
            made = [name_for(v, g, key, turn) if k == "name" else successor(k, v, key, turn) for k, v, g in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, "surrogate"])

    return run


def surrogates(values: DataFrame, key: str, strict_turns: int = 5, most_turns: int = 24) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value, gender: m, f or u), no surrogate twice within a kind and none its own
    value's.

    Each turn draws anew for the values left. A draw that is itself a detected value, or that another value holds or draws too
    (then the smallest value keeps it), is void. Names grow with the turns, so they soon find a free string; if `most_turns` don't
    suffice, an error is raised. Other values whose shape has no free string left after `strict_turns` are dealt anew together
    with all values of that shape, each to its successor, which may be a detected one: two rounds at most after the strict ones.
    """
    secret = hashlib.sha256(key.encode()).digest()
    values = materialize(
        values.select("kind", "value", "gender").mapInArrow(_shapes, "kind string, value string, gender string, shape string"), "values"
    )
    real = values.select("kind", F.col("value").alias("surrogate"))
    schema = "kind string, value string, gender string, shape string, surrogate string"
    names = F.col("kind") == "name"
    open_, done = values, None
    for turn in range(most_turns):
        if turn == strict_turns and (tight := materialize(open_.where(~names).select(F.col("shape").alias("_s")).distinct(), "tight")).take(1):
            again = values.join(tight, F.col("shape") == F.col("_s"), "left_semi").mapInArrow(_step(secret, turn), schema)
            done = done.join(tight, F.col("shape") == F.col("_s"), "left_anti").unionByName(materialize(again.drop("gender"), "surrogates"))
            open_ = open_.where(names)
        drawn = open_.mapInArrow(_step(secret, turn), schema).where("surrogate <> value").join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            drawn = drawn.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("value", "shape")).alias("x")).select("kind", "x.*", "surrogate")
        won = materialize(won, "surrogates")
        done = won if done is None else done.unionByName(won)
        open_ = materialize(open_.join(won.select("kind", "value"), ["kind", "value"], "left_anti"), "open")
        if not open_.take(1):
            return done.select("kind", "value", "surrogate")
    raise ValueError("a name found no free surrogate")


def replace(docs: DataFrame, key: str, text_col: str = "text", country: str = "1") -> tuple[DataFrame, DataFrame]:
    """(docs with replaced texts and, last, `_cw_entities`: how many values were replaced; the surrogate table).

    Equal keys give equal surrogates for an equal corpus; without the key they can't be told from others. Phones without a country
    code belong to `country`. Names are the capitalised words after a title, and their later mentions in the same text; all other
    kinds go by their form, cards by their check digit too. A name has the gender that its titles over all texts agree on, else
    that of its ending, else none. Rows without personal data pass unshuffled. Null and empty texts stay as they are, texts are
    read whole. Rows and other columns stay, repeated ones too; where docs has a column `_cw_entities` the new one gets an
    underscore more. An empty table gives no rows.
    """
    n_col, found_col, row_col = free_names(docs.columns, "_cw_entities", "_cw_found", "_cw_row")
    place = docs.columns.index(text_col)
    fields = docs.schema.fields
    clean = docs.mapInArrow(_split(place, country, False, n_col), StructType([*fields, StructField(n_col, LongType())]))
    with_found = StructType([*fields, StructField(found_col, docs.sparkSession.createDataFrame([], f"x {_FOUND}").schema["x"].dataType)])
    marked = docs.mapInArrow(_split(place, country, True, found_col), with_found).withColumn(row_col, F.monotonically_increasing_id())
    marked = materialize(marked, "marked")
    spans = marked.select(F.col(row_col).alias("row"), F.explode(found_col).alias("x")).select("row", "x.*")
    said = lambda g: F.max(F.coalesce(F.col("gender") == g, F.lit(False)))
    ends = F.col("value").rlike("(?:" + "|".join(FEMALE) + ")$")
    values = spans.groupBy("kind", "value").agg(said("m").alias("m"), said("f").alias("f")).select(
        "kind", "value", F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").when(~F.col("m") & ends, "f").otherwise("u").alias("gender")
    )
    mapped = materialize(surrogates(values, key), "mapped")
    named = mapped.select(F.col("kind").alias("_k"), F.col("value").alias("_v"), "surrogate")
    edits = (
        spans.join(named, (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v")))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind", "surrogate"))).alias("edits"))
    )

    def rewrite(batches):
        for b in batches:
            texts, counts = [], []
            for t, edits in zip(b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                out, at = [], 0
                for x in edits:
                    out += [t[at : x["s"]], render(x["kind"], t[x["s"] : x["e"]], x["surrogate"])]
                    at = x["e"]
                texts.append("".join([*out, t[at:]]))
                counts.append(len(edits))
            columns = list(b.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], [*b.schema.names[:-1], n_col])

    same = marked[row_col] == edits["row"]
    touched = marked.join(edits, same).select(*(marked[f"`{c}`"] for c in docs.columns), edits["edits"])
    return clean.unionByName(touched.mapInArrow(rewrite, clean.schema)), mapped


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the setting spark.caseweave.pii.key; without one, a key of this run alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = replace(docs, spark.conf.get("spark.caseweave.pii.key", None) or secrets.token_hex(32))
    return out.withColumnRenamed("_cw_entities", "n_entities")
