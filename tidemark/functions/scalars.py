"""Column helpers: times in nanoseconds, identifiers, keys, and fields of JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NS = 1_000_000_000
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d([.]\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"


def epoch_us(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def epoch_ns(ts: str | Column) -> Column:
    return epoch_us(ts) * 1000


def known_offset_ns(raw: Column) -> Column:
    """Nanoseconds since 1970 of an RFC 3339 text with a known offset; null for anything else.

    Refused: an offset of -00:00 or none, untrimmed or longer than 128 bytes, dates that do not exist.
    Digits after the ninth are cut.
    """
    ok = (F.octet_length(raw) <= 128) & raw.rlike(_RFC3339) & ~raw.endswith("-00:00")
    seconds = F.try_to_timestamp(F.concat(F.substring(raw, 1, 19), F.lit("Z")))
    # a cast that fails costs an exception, and a search for what is not there a pass, so a plain Z without digits is told first
    part = lambda at: F.coalesce(F.substring(raw, at, 2).try_cast("long"), F.lit(0))
    offset = F.when(raw.endswith("Z"), 0).otherwise((part(-5) * 3600 + part(-2) * 60) * F.when(F.substring(raw, -6, 1) == "-", -1).otherwise(1))
    digits = F.when(F.substring(raw, 20, 1) == ".", F.substring(F.rpad(F.regexp_extract(raw, r"[.](\d+)", 1), 9, "0"), 1, 9).try_cast("long")).otherwise(0)
    return F.when(ok, (F.unix_seconds(seconds) - offset) * NS + digits)


def fixed_utc(ns: Column) -> Column:
    """A fixed-width text with nine digits that sorts as the number does."""
    seconds = F.floor(ns / F.lit(NS).cast("decimal(20,0)")).cast("long")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    second = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(second / 3600), F.floor(second % 3600 / 60), second % 60)
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("."), F.lpad(F.pmod(ns, F.lit(NS)).cast("string"), 9, "0"), F.lit("Z"))


def corrected_ns(ns: Column, offset_ms: Column) -> Column:
    """Device time plus the offset, which is server minus device."""
    return ns + offset_ms * 1_000_000


def clock_uncertain(error_ms: Column, after_ns: int = NS) -> Column:
    """Strictly over the limit."""
    return error_ms * 1_000_000 > after_ns


def duration_end_ns(start_ns: Column, seconds: Column) -> Column:
    """start plus seconds, cut to whole nanoseconds."""
    return start_ns + (seconds * float(NS)).cast("long")


def valid_identifier(value: Column, most: int) -> Column:
    """Not empty, not over ``most`` bytes, no white space at its ends, no control character."""
    fits = F.octet_length(value) <= most
    ok = (F.octet_length(value) > 0) & fits & ~value.rlike(r"(?U)^\s|\s$") & ~value.rlike(r"\p{Cc}") & F.is_valid_utf8(value)
    return F.coalesce(F.when(value.rlike(r"^[!-~]+\z"), fits).otherwise(ok), F.lit(False))  # most are plain: one look instead of three


def valid_source_identifier(value: Column, most: int) -> Column:
    """As valid_identifier, and no white space at all."""
    return valid_identifier(value, most) & ~value.rlike(r"(?U)\s")


def nul_key(*parts: Column) -> Column:
    """SHA-256 of the parts (none of them null) with NUL between them."""
    return F.sha2(F.concat_ws("\0", *(p.cast("string") for p in parts)), 256)


def duration_ms(text: Column) -> Column:
    """Milliseconds, rounded up, of a number of seconds as text; null if that is no positive number."""
    seconds = text.try_cast("double")
    return F.when((seconds > 0) & ~F.isnan(seconds) & (seconds < 9e15), F.ceil(seconds * 1000).cast("long"))


def activity_base_key(bucket: Column, source_id: Column) -> Column:
    return F.concat(F.lit("activitywatch:"), F.substring(F.sha2(bucket, 256), 1, 16), F.lit(":"), source_id.cast("string"))


def minute_of_day(text: Column) -> Column:
    """Minutes of HH:MM, up to 24:00; null for anything else."""
    ok = text.rlike(r"^(([01]\d|2[0-3]):[0-5]\d|24:00)$")
    return F.when(ok, F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))


def weekday_name(day: Column) -> Column:
    """Lower-case English name of a date's weekday, whatever the locale."""
    names = F.array(*(F.lit(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")))
    return F.get(names, F.weekday(day))


def detail_text(text: Column, most: int = 1024) -> Column:
    return F.substring(text, 1, most)


def json_number(variant: Column, path: str) -> Column:
    """A number field as double; null where the field is absent or of another type (a text stays a text)."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    whole = F.try_variant_get(variant, path, "long").cast("double")  # a variant's own cast to another type is made anew for each row
    return F.when(kind == "BIGINT", whole).when(kind.rlike("^(DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.try_variant_get(variant, path, "double"))


def json_text(variant: Column, path: str) -> Column:
    """A text field; null where it is absent or of another type."""
    kind = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(variant, path, "string"))


def merged_flags(*flags: Column) -> Column:
    """Sorted distinct union of arrays of flags."""
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(f, F.array().cast("array<string>")) for f in flags))))


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that does not hold (null does not hold); null if all hold."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), code) for ok, code in rules))
