"""Spreadsheet dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_SERIAL = 2_958_465


def excel_date(serial: Column, from_1904: bool = False) -> Column:
    """ISO text of a spreadsheet serial; a time is kept unless it is midnight; serial 60 is the day that never was.

    Null outside 0..2,958,465.
    """
    day = F.floor(serial).cast("int")
    seconds = F.round((serial - F.floor(serial)) * 86_400).cast("long")
    day, seconds = F.when(seconds == 86_400, day + 1).otherwise(day), F.when(seconds == 86_400, F.lit(0)).otherwise(seconds)
    if from_1904:
        date = F.date_add(F.to_date(F.lit("1904-01-01")), day).cast("string")
    else:
        date = F.when(day == 60, F.lit("1900-02-29")).otherwise(F.date_add(F.to_date(F.lit("1899-12-31")), F.when(day > 60, day - 1).otherwise(day)).cast("string"))
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60), F.pmod(seconds, F.lit(60)))
    return F.when((serial >= 0) & (serial <= LAST_SERIAL), F.when(seconds == 0, date).otherwise(F.concat(date, F.lit("T"), clock)))
