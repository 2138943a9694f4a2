"""Recognise, parse and normalise date and date-time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparcel.functions.text import WS, trimmed

# The text forms that count as a date.
# Year, month and day, each followed by a mark beyond U+007F (as 年 月 日).
DATE_MARKED = r"^(\d{4})\s*[^\x00-\x7F]\s*(\d{1,2})\s*[^\x00-\x7F]\s*(\d{1,2})\s*[^\x00-\x7F]$"
DATE_YMD = r"^\d{4}([/\-.])\d{1,2}(\1)\d{1,2}$"
DATE_MDY = r"^(\d{1,2})([/\-.])(\d{1,2})(\2)\d{4}$"
DATE_WORDS = r"^(\w{3}) (\w{3}) (\d{2}) (\d{4})$"

# The text forms that count as a date-time, each at the start of a line.
DATE_TIME_FORMS = (
    r"\w{3}, \d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2} GMT",
    r"\w{3} \w{3} \d{2} \d{4} \d{2}:\d{2}:\d{2} GMT[-+]\d{4}",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3,6}Z",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} UTC",
    r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2})?[-+]\d{4}",
    r"\d{1,2}[\\/-]\d{1,2}[\\/-]\d{4} \d{1,2}:\d{1,2}",
    r"\d{4}[\\/-]\d{1,2}[\\/-]\d{1,2} \d{1,2}:\d{1,2}",
)
DATE_TIME = "(?m)^(?:" + "|".join(DATE_TIME_FORMS) + ")"
DATE_TIME_TRIMMED = f"(?m)(?:\\A{WS}*|^)(?:" + "|".join(DATE_TIME_FORMS) + ")"

# Parse patterns by the start of the text, tried in this order (month before day).
TIMESTAMP_FORMATS = {
    r"^\d{1,2}/": ("M/d/yyyy H:m[:s]", "M/d/yyyy h:m[:s] a", "M/d/yyyy h:m[:s]a", "M/d/yyyy"),
    r"^\d{1,2}-": ("M-d-yyyy H:m[:s]", "M-d-yyyy h:m[:s] a", "M-d-yyyy h:m[:s]a", "M-d-yyyy"),
    r"^\d{1,2}\.": ("M.d.yyyy",),
    r"^\d{4}/": ("yyyy/M/d H:m[:s]", "yyyy/M/d h:m[:s] a", "yyyy/M/d h:m[:s]a", "yyyy/M/d"),
    r"^\d{4}\.": ("yyyy.M.d",),
    r"^\w{3},? ": ("dd MMM yyyy HH:mm:ss 'GMT'", "MMM dd yyyy HH:mm:ss 'GMT'XX", "MMM dd yyyy"),
}
# A date-time at the start of a text, with what may belong to it.
LEADING = (
    r"^(?:\w{3}, \d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2} GMT|\w{3} \w{3} \d{2} \d{4} \d{2}:\d{2}:\d{2} GMT[-+]\d{4}"
    r"|\d{4}[/-]\d{1,2}[/-]\d{1,2}[T ]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?(?: ?[APap][Mm]\b)?(?:Z| ?UTC|[-+]\d{2}:?\d{2})?"
    r"|\d{1,2}[/-]\d{1,2}[/-]\d{4} \d{1,2}:\d{1,2}(?::\d{1,2})?(?: ?[APap][Mm]\b)?)"
)
ISO_FORMATS = ("yyyy-MM-dd'T'HH:mm[:ss]XX", "yyyy-M-d h:m[:s] a", "yyyy-M-d h:m[:s]a")


def is_date(text: Column) -> Column:
    """True for date-only text; month-day-year needs a possible month and day."""
    t = trimmed(text)
    month = F.regexp_extract(t, DATE_MDY, 1).try_cast("int")
    day = F.regexp_extract(t, DATE_MDY, 3).try_cast("int")
    shaped = (
        F.when(t.rlike(DATE_MARKED) | t.rlike(DATE_YMD) | t.rlike(DATE_WORDS), True)
        .when(t.rlike(DATE_MDY), month.between(1, 12) & day.between(1, 31))
        .otherwise(False)
    )
    # Long text is settled by its first characters, before it is trimmed.
    return F.when(text.rlike(rf"^{WS}*(?:\d|\w{{3}} )"), shaped).otherwise(False)


def is_date_time(text: Column) -> Column:
    # Every form has a colon, which is found faster than the forms themselves.
    return F.coalesce(text.contains(":") & text.rlike(DATE_TIME_TRIMMED), F.lit(False))


def parse_utc_timestamp(text: Column) -> Column:
    """Instant in UTC, or NULL when the text is no known form. Of a text that goes on after a date-time, the date-time counts."""
    whole = trimmed(text)
    # only a date-time has a colon; a text of any length is cut down to it before it is parsed
    lead = F.when(whole.contains(":"), F.regexp_extract(whole, LEADING, 0))
    t = F.coalesce(F.nullif(lead, F.lit("")), whole)
    marked = F.concat_ws("-", *[F.regexp_extract(t, DATE_MARKED, i) for i in (1, 2, 3)])
    # Weekdays are not parsed, and half days only in capitals after what comes before them.
    bare = F.regexp_replace(t, r"^\w{3},? (?=\w{3} \d{2} \d{4}|\d{2} \w{3} \d{4})", "")
    clock = F.concat(F.regexp_replace(t, r"(?i)[ ]?[ap]m$", ""), F.upper(F.regexp_extract(t, r"(?i)[ ]?[ap]m$", 0)))

    def tried(formats: tuple[str, ...]) -> list[Column]:
        return [F.try_to_timestamp(clock if f.endswith("a") else bare, F.lit(f)) for f in formats]

    iso = F.coalesce(t.try_cast("timestamp"), *tried(ISO_FORMATS), F.when(t.rlike(DATE_MARKED), marked.try_cast("timestamp")))
    found = F.when(t.rlike(r"^\d{4}-\d{1,2}"), iso)
    for start, formats in TIMESTAMP_FORMATS.items():
        found = found.when(t.rlike(start), F.coalesce(*tried(formats), F.when(t.rlike(DATE_MARKED), marked.try_cast("timestamp"))))
    return found.when(t.rlike(DATE_MARKED), marked.try_cast("timestamp"))


def normalize_date(text: Column) -> Column:
    return F.date_format(parse_utc_timestamp(text), "yyyy-MM-dd")


def normalize_time(text: Column) -> Column:
    """Pad every part to two digits and add seconds when they are missing."""
    padded = F.transform(
        F.split(text, ":"),
        lambda part: F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part),
    )
    joined = F.array_join(padded, ":")
    return F.when(F.length(joined) == 5, F.concat(joined, F.lit(":00"))).otherwise(joined)


def normalize_date_time(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` for recognised date-time text, else the empty string."""
    stamp = parse_utc_timestamp(text)
    return F.when(
        is_date_time(text), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss")
    ).otherwise(F.lit(""))


def iso_millis(stamp: Column) -> Column:
    """ISO-8601 text with milliseconds and ``Z``."""
    return F.date_format(stamp.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_duration(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    text = seconds.cast("string")
    minutes = F.floor(s / 60) % 60
    hours = F.floor(s / 3600) % 24
    return (
        F.when(seconds < 60, F.concat(text, F.lit(" seconds")))
        .when(seconds < 3600, F.format_string("%d minutes %d seconds", minutes, s % 60))
        .otherwise(F.format_string("%d hours %d minutes %d seconds", hours, minutes, s % 60))
    )
