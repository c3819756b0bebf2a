"""Scalar expressions over log columns; each is built from Spark's own functions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from behaviorlens import config as C


def after_hours(ts: Column) -> Column:
    return (F.hour(ts) < C.OPENS) | (F.hour(ts) >= C.CLOSES)


def weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def day(ts: Column) -> Column:
    return F.to_date(ts)


def activity_is(activity: Column, name: str) -> Column:
    return F.coalesce(F.lower(activity) == name, F.lit(False))


def removable(flag: Column, accepted: tuple[str, ...] = ("true",)) -> Column:
    """A flag that may be text; null is False."""
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin(*accepted), F.lit(False))


def has_external(to: Column, domain: str = C.INTERNAL_DOMAIN) -> Column:
    """Some recipient, even an empty one, is outside the domain; null is False."""
    return F.coalesce(F.exists(F.split(to, ";"), lambda x: ~F.contains(x, F.lit(domain))), F.lit(False))


def external_thread(*fields: Column, domain: str = C.INTERNAL_DOMAIN) -> Column:
    """Some address with an @ in any of the fields is outside the domain."""
    return F.exists(F.split(F.concat_ws(";", *fields), ";"), lambda x: F.contains(x, F.lit("@")) & ~F.contains(x, F.lit(domain)))


def large_attachment(size: Column) -> Column:
    return F.coalesce(size > C.LARGE_ATTACHMENT, F.lit(False))


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Some word is part of the lower-cased text; null is False."""
    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, words))), F.lit(False))


def domain_of(url: Column) -> Column:
    """The lower-cased authority of a URL, or the whole of what isn't one."""
    found = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.coalesce(F.nullif(found, F.lit("")), url))


def file_type(name: Column) -> Column:
    ext = F.regexp_extract(F.lower(name), r"(\.[^./\\]+)$", 1)
    return F.coalesce(*[F.when(ext.isin(*exts), code) for code, exts in C.FILE_TYPES.items()], F.lit(0))


def content_words(text: Column) -> Column:
    """How many of the watched words a text has; null has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in C.CONTENT_WORDS])


def number(x: Column) -> Column:
    """A number from text; anything else is 0."""
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def internal_recipients(*fields: Column, domain: str = C.INTERNAL_DOMAIN) -> Column:
    """Local parts of the internal addresses in the fields, trimmed and lower-cased; repeats stay."""
    addresses = F.transform(F.split(F.concat_ws(";", *fields), ";"), lambda x: F.lower(F.trim(x)))
    return F.transform(F.filter(addresses, lambda x: F.endswith(x, F.lit(f"@{domain}"))), lambda x: F.substring_index(x, "@", 1))


def risk_band(score: Column) -> Column:
    return F.when(score < 0.4, "low").when(score < 0.7, "medium").otherwise("high")


def ratio_colour(x: Column) -> Column:
    return F.when(x < 0.34, "green").when(x < 0.67, "amber").otherwise("red")


def z_band(z: Column) -> Column:
    return F.when(F.abs(z) < 2, "normal").when(F.abs(z) < 3, "elevated").otherwise("extreme")


def any_of(*conditions: Column) -> Column:
    return reduce(or_, conditions)


def describe_event(kind: Column, row: dict[str, Column]) -> Column:
    """One line of text for an event of any log."""
    base = F.regexp_extract(row["filename"], r"([^/\\]*)$", 1)
    return (
        F.when(kind == "logon", F.concat(F.when(activity_is(row["activity"], "logon"), "Logged on at ").otherwise("Logged off at "), row["pc"]))
        .when(kind == "usb", F.concat(F.lit("USB "), F.lower(row["activity"]), F.lit(" at "), row["pc"]))
        .when(kind == "file", F.concat(F.lit("File access: "), base, F.when(removable(row["to_removable_media"]), " → removable drive").otherwise("")))
        .when(kind == "email", F.concat(F.lit("Email to "), F.substring(F.coalesce(row["to"], F.lit("")), 1, 60), F.lit(" ("), F.floor(number(row["size"]) / 1024).cast("string"), F.lit(" KB)")))
        .when(kind == "http", F.concat(F.lit("Visited "), F.substring(row["url"], 1, 80)))
        .otherwise(kind)
    )
