"""Scalar functions as Column expressions."""

from __future__ import annotations

import json
import unicodedata
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringdata.functions.unicode import casefold, let, nfkc

# Spellings of a missing value, of labels, and the words that mark a phone field.
MISSING = ["", "nan", "none", "null", "nat", "<na>"]
POSITIVE_LABELS = ["1", "1.0", "true", "yes", "y", "friend", "friends", "interacting", "interaction", "friend_or_interacting", "connected", "positive"]
NEGATIVE_LABELS = [
    "0", "0.0", "false", "no", "n", "stranger", "strangers", "not_friend", "not friend", "not_interacting", "not interacting", "not_friend_or_interacting", "unconnected", "negative", "none",
]
PHONE_WORDS = ["phone", "mobile", "msisdn", "contact", "party", "landline", "caller", "callee", "calling", "called", "receiver", "sender"]
COUNTRY_CODE, ZONE = "91", "Asia/Kolkata"


_BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: The same characters one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85" + "".join(chr(c) for c in range(0x3001) if unicodedata.category(chr(c))[0] == "Z")


def _trim(t: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(t, F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """null to '', Unicode NFKC, no U+200B, Excel's =\"...\" unwrapped up to twice, trimmed."""
    wrapped = r'(?s)^="((?:""|[^"])*+)"$'

    def unwrap(t: Column) -> Column:
        return F.when(t.startswith('="') & t.rlike(wrapped), _trim(F.replace(F.regexp_extract(t, wrapped, 1), F.lit('""'), F.lit('"')))).otherwise(t)

    t = F.coalesce(c.cast("string"), F.lit(""))
    return let(_trim(F.replace(nfkc(t), F.lit("\u200b"), F.lit(""))), lambda t: unwrap(unwrap(t)))


def is_missing_text(c: Column) -> Column:
    """F2."""
    return F.lower(_trim(F.coalesce(c, F.lit("")))).isin(MISSING)


def is_phone_field(name: str) -> bool:
    """Whether a field name contains one of PHONE_WORDS."""
    return any(w in name.lower() for w in PHONE_WORDS)


def _general(t: Column) -> Column:
    return let(_trim(F.regexp_replace(t, _BLANK, " ")), casefold)


def _plain_number(c: Column) -> Column:
    """The cleaned text, without the fraction of a whole number."""
    return F.regexp_replace(clean_text(c), r"^([0-9]+)\.0+$", "$1")


def _spelling(t: Column, phone: bool, country_code: str = COUNTRY_CODE) -> Column:
    """F3 of a text that _plain_number gave."""
    out = _general(t)
    if phone:
        d = F.regexp_replace(t, "[^0-9]", "")
        d = F.when(d.startswith("00"), F.substr(d, F.lit(3))).otherwise(d)
        full = F.when(F.length(d) == 10, F.concat(F.lit(country_code), d)).when((F.length(d) == 11) & d.startswith("0"), F.concat(F.lit(country_code), F.substr(d, F.lit(2)))).otherwise(d)
        shaped = t.rlike(r"^[+()\-\s.0-9]+$") & (F.length(F.regexp_replace(t, "[^0-9]", "")) >= 7)
        out = F.when(shaped, full).otherwise(out)
    return F.when(is_missing_text(t), "").otherwise(out)


def normalize_identifier(c: Column, phone: bool = False, country_code: str = COUNTRY_CODE) -> Column:
    """one spelling of an identifier ('' if missing). phone: apply the rules of phone fields to phone-shaped text."""
    return let(_plain_number(c), lambda t: _spelling(t, phone, country_code))


def identifier_variants(c: Column, phone: bool) -> Column:
    """the distinct spellings to try, best first; the text is cleaned once for all of them."""
    order = (True, False) if phone else (False, True)
    return let(_plain_number(c), lambda t: F.array_distinct(F.filter(F.array(*[_spelling(t, p) for p in order]), lambda x: x != "")))


def valid_zone(c: Column) -> Column:
    """a zone that Spark knows, '' for the default one; null if invalid."""
    return let(F.upper(clean_text(c)), _known_zone)


def _known_zone(t: Column) -> Column:
    sign, hours, minutes = (F.regexp_extract(t, r"^(?:UTC|GMT)?\s*([+-])([0-9]{1,2})(?::?([0-9]{2}))?$", k) for k in (1, 2, 3))
    offset = F.concat(sign, F.lpad(hours, 2, "0"), F.lit(":"), F.when(minutes == "", "00").otherwise(minutes))
    ok = (hours != "") & (F.try_to_number(hours, F.lit("99")) <= 18) & (F.coalesce(F.try_to_number(minutes, F.lit("99")), F.lit(0)) <= 59)
    names = F.from_json(F.lit(json.dumps({n.upper(): n for n in sorted(zoneinfo.available_timezones())})), "map<string,string>")
    return F.when(t == "", "").when(t.isin("Z", "UTC", "GMT"), "UTC").when(ok, offset).otherwise(F.try_element_at(names, t))


def year_first(text: Column) -> Column:
    """Whether a text starts with year, month and day, null for a blank one: a vote on the order of its source's dates."""
    return let(clean_text(text), lambda t: F.when(t != "", t.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}")))


#: What texts must look like for a form of date to be tried at all (a failed try costs far more).
YEAR_FORM, DAY_FORM = r"^[+-]?[0-9]{4,}-", r"^[+-]?[0-9]+-[+-]?[0-9]+-[+-]?[0-9]{4,}(?![0-9])"


def local_time(text: Column, day_first: bool | Column) -> Column:
    """The wall-clock time in a text, read at UTC; null if none of the known forms fits."""
    clock = "[ H:m[:s[.SSSSSS][.SSS]]]"

    def read(t: Column) -> Column:
        year, day, month = (F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form + clock))) for form, shape in (("yyyy-M-d", YEAR_FORM), ("d-M-yyyy", DAY_FORM), ("M-d-yyyy", DAY_FORM)))
        if isinstance(day_first, bool):
            return F.coalesce(year, *((day, month) if day_first else (month, day)))
        return F.coalesce(year, F.when(day_first, F.coalesce(day, month)).otherwise(F.coalesce(month, day)))

    return let(F.regexp_replace(F.translate(text, "/T", "- "), r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})", "$1-$2-$3"), read)


EXPLICIT = r"(?i)(?<=:[0-9]{2}|:[0-9]{2}\.[0-9]{1,6})\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def parse_event_time(text: Column, zone: Column | None = None, default_zone: str = ZONE, day_first: bool | Column = True) -> Column:
    """a struct of `instant` (UTC) and `status`; times.parse_event_times finds day_first by a vote of each source.

    Status: explicit (the text has an offset), zone (the row's zone), assumed (the
    default zone), invalid_zone, invalid (no such time, or one that the zone skips or
    has twice) or missing.
    """
    hour = F.expr("INTERVAL 1 HOUR")

    def read(a: Column) -> Column:
        offset = F.regexp_extract(a["t"], EXPLICIT, 1)
        wall = local_time(F.trim(F.regexp_replace(a["t"], EXPLICIT, "")), day_first if isinstance(day_first, bool) else a["day_first"])
        return F.struct(a["t"].alias("t"), a["zone"].alias("zone"), offset.alias("offset"), wall.alias("wall"), F.when(a["zone"] == "", F.lit(default_zone)).otherwise(a["zone"]).alias("used"))

    def place(b: Column) -> Column:
        return F.struct(*[b[c].alias(c) for c in ("t", "zone", "offset", "wall", "used")], F.to_utc_timestamp(b["wall"], b["used"]).alias("utc"))

    def judge(c: Column) -> Column:
        offset = c["offset"]
        sign, hours, minutes = F.substr(offset, F.lit(1), F.lit(1)), F.substr(offset, F.lit(2), F.lit(2)), F.substr(offset, F.lit(-2))
        seconds = F.when(F.upper(offset) == "Z", 0).otherwise(F.when(sign == "-", -1).otherwise(1) * (hours.try_cast("int") * 3600 + minutes.try_cast("int") * 60))
        back = lambda x: F.from_utc_timestamp(x, c["used"])
        clear = (back(c["utc"]) == c["wall"]) & (back(c["utc"] + hour) != c["wall"]) & (back(c["utc"] - hour) != c["wall"])
        instant = F.when(offset != "", F.timestamp_micros(F.unix_micros(c["wall"]) - seconds.cast("long") * 1_000_000)).when(c["zone"].isNotNull() & clear, c["utc"])
        status = (
            F.when(is_missing_text(c["t"]), "missing")
            .when((offset == "") & c["zone"].isNull(), "invalid_zone")
            .when(instant.isNull(), "invalid")
            .when(offset != "", "explicit")
            .when(c["zone"] == "", "assumed")
            .otherwise("zone")
        )
        return F.struct(instant.alias("instant"), status.alias("status"))

    start = F.struct(clean_text(text).alias("t"), (valid_zone(zone) if zone is not None else F.lit("")).alias("zone"), (F.lit(day_first) if isinstance(day_first, bool) else day_first).alias("day_first"))
    return let(start, lambda a: let(read(a), lambda b: let(place(b), judge)))


def iso_utc(ts: Column) -> Column:
    """F7 (the session's zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def is_night(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) >= 22)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def event_day(ts: Column) -> Column:
    return F.to_date(ts)


def hour_bucket(ts: Column) -> Column:
    """F9."""
    return F.date_trunc("hour", ts)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """F10."""
    return F.least(a, b), F.greatest(a, b)


def parse_label(c: Column) -> Column:
    """1, 0, or null for a spelling that is neither."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(POSITIVE_LABELS), 1).when(t.isin(NEGATIVE_LABELS), 0)


def jaccard(a: Column, b: Column) -> Column:
    """of two sets held as arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """of two arrays of one length; 0 when either is all zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def ratio_similarity(a: Column, b: Column) -> Column:
    """F14."""
    return F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


#: Decimal digits of all scripts but ASCII's, and what they stand for.
DIGITS = {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"}
_DIGITS = "[0-9](?:_?[0-9])*+"
#: A decimal number as Python's float reads it: digits, with single underscores between them, a point, an exponent; no hexadecimal, no type suffix.
DECIMAL = f"^[+-]?(?:{_DIGITS}(?:[.](?:{_DIGITS})?)?|[.]{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"


def number(c: Column) -> Column:
    """A finite number that a text holds as Python's float reads it (any white space around, digits of any script), else null; columns of numbers stay as they are."""
    t = c.cast("string")
    t = F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, "".join(DIGITS), "".join(DIGITS.values()))).otherwise(t)
    t = F.regexp_replace(t, r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", "")
    text = F.when(t.rlike(DECIMAL), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
    x = F.when(F.typeof(c) == "string", text).otherwise(c.try_cast("double"))  # the planner folds typeof
    return F.when(F.abs(x) < float("inf"), x)


def safe_number(c: Column, default: float = 0.0) -> Column:
    """a finite number (see `number`), else the default."""
    return F.coalesce(number(c), F.lit(default))


def megabytes(mb: Column, up_kb: Column, down_kb: Column) -> Column:
    """F16."""
    volume = F.coalesce(mb, (up_kb + down_kb) / 1024, up_kb / 1024, down_kb / 1024, F.lit(0.0))
    return F.greatest(volume, F.lit(0.0))


def is_voice(kind: Column) -> Column:
    """F17."""
    return F.lower(kind).contains("voice") | F.lower(kind).contains("call")


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """F18."""
    return lat.between(6.0, 38.5) & lng.between(67.0, 98.5)


def stable_numeric_id(c: Column, digits: int = 15) -> Column:
    """digits of the first 16 hex digits of SHA-256."""
    n = F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.lpad((n % F.lit(10**digits).cast("decimal(20,0)")).cast("string"), digits, "0")


def valid_port(c: Column) -> Column:
    """F20."""
    p = number(c)
    return F.when(p.between(1, 65535), p.cast("int"))


def log1p_clip(c: Column) -> Column:
    """F21."""
    return F.log1p(F.greatest(c, F.lit(0.0)))


def prediction_text(p: Column, threshold: Column | float) -> Column:
    """F22."""
    return F.when(p >= threshold, "Friend / interacting").otherwise("Not friend / not interacting")


def hour_from_text(c: Column) -> Column:
    """hour in characters 12 and 13, else -1."""
    h = F.substring(c, 12, 2).try_cast("int")
    return F.when(h.between(0, 23), h).otherwise(-1)
