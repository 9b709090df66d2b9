"""Column types of every stage's input and output."""

from __future__ import annotations

TICKS = "Symbol STRING, Date DATE, Time BIGINT, Price DOUBLE, Volume DOUBLE, LR TINYINT"
QUOTES = TICKS + ", MidPoint DOUBLE, QSpread DOUBLE"
DAILY = "Symbol STRING, Date DATE, B BIGINT, S BIGINT"
DENSE = "Symbol STRING, Date DATE, B INT, S INT"
BARS = "Symbol STRING, Datetime TIMESTAMP_NTZ, Open DOUBLE, Close DOUBLE, Volume DOUBLE"
PIN = "Symbol STRING, Date DATE, valid_days INT, a DOUBLE, d DOUBLE, u DOUBLE, eb DOUBLE, es DOUBLE, PIN DOUBLE, skip_reason STRING"
APIN = "Symbol STRING, Date DATE, valid_days INT, a DOUBLE, d DOUBLE, t1 DOUBLE, t2 DOUBLE, ub DOUBLE, us DOUBLE, eb DOUBLE, es DOUBLE, pb DOUBLE, ps DOUBLE, APIN DOUBLE, PSOS DOUBLE, skip_reason STRING"
GUESS = "Symbol STRING, Date DATE, guess ARRAY<DOUBLE>, reached DOUBLE, fate INT, spent DOUBLE"
# What ends a symbol, or a part of it: which of how many parts, its windows, the seconds they took, and the last estimate.
MARKS = "done BOOLEAN, part INT, parts INT, windows INT, seconds DOUBLE, last ARRAY<DOUBLE>"
# What an appended day needs of the days before: the last ones, and the last estimate.
STATE = "Symbol STRING, Dates ARRAY<DATE>, B ARRAY<INT>, S ARRAY<INT>, last ARRAY<DOUBLE>"
VPIN = "Symbol STRING, BucketNo INT, Date DATE, Starttime TIMESTAMP_NTZ, Endtime TIMESTAMP_NTZ, AggBuyVol DOUBLE, AggSellVol DOUBLE, AOI DOUBLE, VPIN DOUBLE"

# The country codes of the tick folders, and the reasons that a window's row can carry.
COUNTRIES = ("KOR", "US", "JP", "CA", "FR", "GR", "HK", "IT", "UK")
SUCCESS, LOW_VALID_DAYS, EST_ERROR, TIMEOUT = "Success", "Low_Valid_Days", "Est_Error", "Timeout"


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
