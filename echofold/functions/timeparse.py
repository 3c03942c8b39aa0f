"""Times: epochs without a session's zone, times in file names, flexible time texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns: a time at the beginning of a file's name, as date, hour, minute, second and fraction, before an
#: underscore or the extension.
STAMP = r"^(?<date>\d{4}-\d{2}-\d{2})[-_T](?<hh>\d{2})[-:](?<mm>\d{2})[-:](?<ss>\d{2})(?:[.,](?<frac>\d{1,9}))?"
NAME_PATTERNS = (STAMP + r"_.*$", STAMP + r"\.[A-Za-z0-9]+$")
#: Fixed layouts of a time text, in the order in which they are tried.
LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][.S]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd-HH-mm-ss",
)


def epoch_us(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def name_time(name: Column, pattern: str = NAME_PATTERNS[0], zone: str = "UTC") -> Column:
    """The timestamp that a file's base name begins with, read in a zone; null if it has none.

    pattern names the groups date, hh, mm, ss and frac. Fractions finer than a microsecond are cut off.
    """
    import re

    groups = re.findall(r"\(\?P?<(\w+)>", pattern)
    plain = re.sub(r"\(\?P?<\w+>", "(", pattern)
    part = lambda g: F.regexp_extract(name, plain, groups.index(g) + 1) if g in groups else F.lit("")
    text = F.concat(part("date"), F.lit(" "), part("hh"), F.lit(":"), part("mm"), F.lit(":"), part("ss"), F.lit("."), F.substring(F.rpad(part("frac"), 9, "0"), 1, 6))
    stamp = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    return F.when(part("date") != "", F.to_utc_timestamp(stamp.cast("timestamp"), zone))


def text_time(text: Column, zone: str = "UTC") -> Column:
    """A time text by the first layout that fits; texts without an offset are read in the zone. Null if none fits."""
    t = F.trim(text)
    with_offset = F.try_to_timestamp(t, F.lit(LAYOUTS[0]))
    local = F.coalesce(*[F.try_to_timestamp(t, F.lit(x)) for x in LAYOUTS[1:]])
    return F.coalesce(with_offset, F.to_utc_timestamp(local, zone))
