"""Column functions: masking, time formats, keys, hex and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHONE = "^1[3-9][0-9]{9}$"
#: One @ without blanks on either side, and a dot inside the host.
EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


def mask_name(name: Column) -> Column:
    """First character and an asterisk."""
    return F.concat(F.substring(name, 1, 1), F.lit("*"))


def mask_phone(phone: Column) -> Column:
    """First three digits and asterisks; an invalid number gives null."""
    return F.when(phone.rlike(PHONE), F.concat(F.substring(phone, 1, 3), F.lit("********")))


def mask_email(email: Column) -> Column:
    """The domain behind an asterisk; an invalid address gives null."""
    return F.when(email.rlike(EMAIL), F.concat(F.lit("*@"), F.split(email, "@").getItem(1)))


def hash_if(value: Column, pattern: str) -> Column:
    """MD5 of values that match, null for others."""
    return F.md5(F.when(value.rlike(pattern), value))


def surrogate_key(*parts: Column) -> Column:
    """MD5 of the parts, each with its length before it, so that no two lists of parts fall together; null is a part of its own."""
    marked = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat(*marked))


def hash_bucket(value: Column, buckets: int, overrides: dict[str, str] | None = None) -> Column:
    """The last three hex digits of the MD5 modulo buckets, as four digits; a value among the overrides gets its own bucket."""
    found = F.lpad((F.conv(F.right(F.md5(value), F.lit(3)), 16, 10).cast("int") % buckets).cast("string"), 4, "0")
    for name, bucket in (overrides or {}).items():
        found = F.when(value == name, bucket).otherwise(found)
    return found


def safe_number(raw: Column, kind: str = "decimal(18,2)") -> tuple[Column, Column]:
    """The number, and whether the text was there but wasn't one."""
    value = raw.try_cast(kind)
    return value, raw.isNotNull() & value.isNull()


def iso_to_local(raw: Column) -> Column:
    """ISO-8601 text as local text; what can't be read stays."""
    return F.coalesce(F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd HH:mm:ss"), raw)


def epoch_day(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def millis_date(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def compact_date(text: Column) -> Column:
    """yyyyMMdd text to a date, null where it isn't one."""
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def days_between(first: Column, last: Column) -> Column:
    """Every day from first to last as yyyyMMdd text."""
    return F.transform(F.sequence(first, last), lambda d: F.date_format(d, "yyyyMMdd"))


def week_key(day: Column) -> Column:
    """ISO year times 100 plus ISO week."""
    return (F.extract(F.lit("YEAROFWEEK"), day) * 100 + F.weekofyear(day)).cast("int")


def hex_number(text: Column) -> Column:
    """Hex text of up to 16 digits, with or without 0x, as a decimal; longer text gives null."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(F.length(digits) <= 16, F.conv(digits, 16, 10).cast("decimal(20,0)"))


def hex_words(text: Column) -> Column:
    """A hex payload in words of 64 characters."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    count = F.floor(F.length(digits) / 64).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(digits, i * 64 + 1, F.lit(64)))).otherwise(F.array().cast("array<string>"))


def text_list_append(text: Column, value: Column) -> Column:
    """A JSON list of strings held as text, with one more element."""
    return F.to_json(F.array_append(F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>")), value))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def camel(name: str) -> str:
    """snake_case to camelCase, for column renames."""
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def joined(parts: Column, separator: str = ",") -> Column:
    """A list as one text; nulls in it are passed over."""
    return F.array_join(parts, separator)


def repeated(text: Column, times: int) -> Column:
    return F.repeat(text, F.lit(max(0, times)))


def only_allowed(text: Column, allowed: str = r"\p{L}\p{N} _.-") -> Column:
    """Has the text characters of this class only, and at least one? Null is not valid."""
    return F.coalesce(text.rlike(f"^[{allowed}]+$"), F.lit(False))


def number_text(text: Column, scale: int = 0) -> Column:
    """Hex text (with 0x) or decimal text as a number, divided by 10^scale; what is neither gives null."""
    plain = F.when(text.rlike("^0[xX][0-9a-fA-F]+$"), hex_number(text)).otherwise(text.try_cast("decimal(20,0)"))
    return F.try_divide(plain.cast("double"), F.lit(10.0**scale)) if scale else plain


def json_get(text: Column, path: str) -> Column:
    """The value at a path such as a.b; null where there is none."""
    return F.get_json_object(text, f"$.{path}")


def _members(text: Column) -> Column:
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_put(text: Column, name: str, value: Column) -> Column:
    """The object with one more member, or another value of it; top-level values become texts."""
    others = F.map_filter(_members(text), lambda k, _: k != name)
    return F.to_json(F.map_concat(others, F.create_map(F.lit(name), value.cast("string"))))


def json_remove(text: Column, name: str) -> Column:
    return F.to_json(F.map_filter(_members(text), lambda k, _: k != name))


def json_merge(text: Column, other: Column, prefix: str = "info_") -> Column:
    """The object with the other's members under prefixed names; they stand in for members of that name."""
    added = F.transform_keys(_members(other), lambda k, _: F.concat(F.lit(prefix), k))
    own = F.map_filter(_members(text), lambda k, _: ~F.array_contains(F.map_keys(added), k))
    return F.to_json(F.map_concat(own, added))


def local_timestamp(day: Column, time: Column) -> Column:
    """Date text with the signs for year, month and day, and a time, as yyyy-MM-dd HH:mm:ss text; null if it isn't one."""
    parts = F.regexp_replace(F.regexp_replace(F.trim(day), "\u65e5", ""), "[\u5e74\u6708]", "-")
    return F.date_format(F.try_to_timestamp(F.concat_ws(" ", parts, F.trim(time)), F.lit("y-M-d H:m[:s]")), "yyyy-MM-dd HH:mm:ss")


def second_word(label: Column) -> Column:
    """The second of the words between blanks, null if there is none."""
    return F.try_element_at(F.split(F.trim(label), r"\s+"), F.lit(2))


def calendar_parts(day: Column) -> dict[str, Column]:
    return {"year": F.year(day), "quarter": F.quarter(day), "month": F.month(day), "day": F.dayofmonth(day), "week": F.weekofyear(day), "weekday": F.weekday(day) + 1, "is_weekend": (F.weekday(day) >= 5).cast("int")}


def map_value(pairs: Column, key: Column) -> Column:
    """The value of a key of a map, null where there is none."""
    return F.try_element_at(pairs, key)
