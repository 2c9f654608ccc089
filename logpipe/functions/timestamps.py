"""Timestamp parsing and rendering.

Every parser appends an explicit zone before converting, so results do not
depend on the session time zone.  Unparseable text gives NULL (the
reference's "zero time").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted timestamp layouts, tried in this order.
#   RFC 3339 with fraction, RFC 3339, RFC 1123 with numeric zone, RFC 1123,
#   RFC 822 with numeric zone, RFC 822, yyyy-MM-ddTHH:mm:ss.SSS with zone,
#   yyyy-MM-ddTHH:mm:ss.SSSZ, yyyy-MM-dd HH:mm:ss.SSS, yyyy-MM-dd HH:mm:ss,
#   MMM _d HH:mm:ss (no year), yyyy/MM/dd HH:mm:ss
# The two RFC 3339 forms and the two zoned ISO forms share one guard below.
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
WEEKDAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"

_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d{1,9})?"
_MON, _DAY = f"(?i:{MONTHS})", f"(?i:{WEEKDAYS})"
_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}T{_CLOCK}(?:Z|[+-]\d{{2}}:\d{{2}})\z"
_SPACE = rf"^\d{{4}}-\d{{2}}-\d{{2}} +{_CLOCK}\z"
_SLASH = rf"^\d{{4}}/\d{{2}}/\d{{2}} +{_CLOCK}\z"
_RFC1123 = rf"^{_DAY}, +\d{{2}} +{_MON} +\d{{4}} +{_CLOCK} +(?:[+-]\d{{4}}|[A-Z]{{3,5}})\z"
_RFC822 = rf"^\d{{2}} +{_MON} +\d{{2}} +\d{{1,2}}:\d{{2}} +(?:[+-]\d{{4}}|[A-Z]{{3,5}})\z"
_STAMP = rf"^{_MON} +\d{{1,2}} +{_CLOCK}\z"
_ACCESS = rf"^\d{{2}}/{_MON}/\d{{4}}:{_CLOCK}(?: +[+-]\d{{4}})?\z"
_RFC3164_MONTH = rf"^({MONTHS})\s"
# how a clock with an optional fraction is read
_READ = "H:mm:ss[.SSSSSSSSS] Z"


def _one_blank(s: Column) -> Column:
    return F.regexp_replace(s, " +", " ")


def _zoned(s: Column) -> Column:
    """A zone abbreviation at the end as +0000."""
    return F.regexp_replace(s, r" [A-Za-z]+\z", " +0000")


def _fmt(s: Column, pattern: str) -> Column:
    return F.try_to_timestamp(s, F.lit(pattern))


def _iso_cast(s: Column) -> Column:
    # ISO-8601 text carrying its own zone converts independently of the session zone.
    return F.try_to_timestamp(s)


def _year_col(year) -> Column:
    if year is None:
        return F.year(F.current_date())
    return year if isinstance(year, Column) else F.lit(int(year))


def parse_timestamp(s: Column, implied_year=None) -> Column:
    """First matching layout of the reference's list, else NULL.

    Layouts: RFC 3339 (with or without fraction), RFC 1123 / RFC 1123Z,
    RFC 822 / RFC 822Z, ``yyyy-MM-dd HH:mm:ss[.fff]``, ``MMM _d HH:mm:ss``
    (year implied, NULL when ``implied_year`` is None) and
    ``yyyy/MM/dd HH:mm:ss``.  Any seconds may have a fraction after ``.`` or
    ``,``, hours may have one digit, names any letter case, and a blank may be
    a run of them.  Zone abbreviations count as UTC; text without a zone is
    UTC.  Each layout is guarded by a regex because bare ``try_to_timestamp``
    also accepts fragments like ``2026``.
    """
    dated = _zoned(F.translate(F.initcap(F.substring(_one_blank(s), 6, 64)), ",", "."))  # without "Mon, "
    short = F.initcap(_one_blank(s))
    century = F.when(F.substring(short, 8, 2) >= F.lit("69"), F.lit("19")).otherwise(F.lit("20"))
    stamp = (
        F.lit(None).cast("timestamp") if implied_year is None else
        _fmt(F.concat(_year_col(implied_year).cast("string"), F.lit(" "), F.translate(short, ",", "."),
                      F.lit(" +0000")), f"yyyy MMM d {_READ}")
    )
    return (
        F.when(s.rlike(_ISO), _iso_cast(F.translate(s, ",", ".")))
        .when(s.rlike(_RFC1123), _fmt(dated, f"dd MMM yyyy {_READ}"))
        .when(s.rlike(_RFC822), _fmt(_zoned(F.concat(F.substring(short, 1, 7), century, F.substring(short, 8, 64))),
                                     "dd MMM yyyy H:mm Z"))
        .when(s.rlike(_SPACE), _iso_cast(F.concat(F.translate(_one_blank(s), " ,", "T."), F.lit("Z"))))
        .when(s.rlike(_STAMP), stamp)
        .when(s.rlike(_SLASH), _iso_cast(F.concat(F.translate(_one_blank(s), "/ ,", "-T."), F.lit("Z"))))
    )


def rfc3164_time(s: Column, year=None, tz: str = "UTC") -> Column:
    """``MMM d HH:mm:ss`` with an implied year and zone.

    Month names are case-sensitive; invalid calendar dates (Feb 30) give
    NULL instead of rolling over.  ``year`` defaults to the current year.
    """
    text = F.concat(_year_col(year).cast("string"), F.lit(" "),
                    F.regexp_replace(s, r"\s+", " "), F.lit(" " + tz))
    return F.when(s.rlike(_RFC3164_MONTH), _fmt(text, "yyyy MMM d HH:mm:ss VV"))


def access_log_time(s: Column) -> Column:
    """``dd/MMM/yyyy:HH:mm:ss Z``; without an offset the time is UTC.  RFC 3339 is accepted, too."""
    text = F.initcap(F.translate(_one_blank(s), "/,", " ."))
    text = F.when(s.rlike(r"[+-]\d{4}\z"), text).otherwise(F.concat(text, F.lit(" +0000")))
    return F.coalesce(_fmt(s, "dd/MMM/yyyy:HH:mm:ss Z"),
                      F.when(s.rlike(_ACCESS), _fmt(text, f"dd MMM yyyy:{_READ}"))
                      .when(s.rlike(_ISO), _iso_cast(F.translate(s, ",", "."))))


def error_log_time(s: Column) -> Column:
    """``yyyy/MM/dd HH:mm:ss`` in UTC; the blank may be a run of blanks."""
    return F.when(s.rlike(_SLASH), _iso_cast(F.concat(F.translate(_one_blank(s), "/ ,", "-T."), F.lit("Z"))))


def format_rfc3339(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.ffffffZ`` (fixed width, session zone UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
