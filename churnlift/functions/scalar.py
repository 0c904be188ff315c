
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .nulls import col

# ---- fixed values (must equal the reference) --------------------------------
# Payment-method recoding; keys not listed map to NULL.
PAYMENT_MAPPING = {
    "CREDIT_CARD_ONLINE": "ONLINE_PAYMENTS",
    "SAFE_PAYMENT_ONLINE": "ONLINE_PAYMENTS",
    "ONLINE_PAYMENTS": "ONLINE_PAYMENTS",
    "CARD ON DELIVERY": "CARD",
    "CARD": "CARD",
    "CASH": "CASH",
    "E WALLET CASHASPP": "E WALLET",
    "E WALLET REVOLUT": "E WALLET",
    "QR CODE": "E WALLET",
}
# Discount tiers: (uplift strictly above, discount); otherwise 0.00.
DISCOUNT_TIERS = [(0.5, 0.25), (0.3, 0.15), (0.15, 0.05)]
DEFAULT_DISCOUNT = 0.0
# Treatment threshold on USED_EXTRA_DISCOUNT_RATIO.
TREATMENT_THRESHOLD = 0.05
# -----------------------------------------------------------------------------


def recode(c, mapping: dict) -> Column:
    """Dictionary lookup; an unmapped value becomes NULL (never passes
    through).  A literal map is a constant folded into the generated code."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(m, col(c))


def to_ts(c, fmt: str | None = None, strict: bool = False) -> Column:
    """parse text to timestamp.  ``strict`` raises on bad text (pandas
    without ``errors='coerce'``); otherwise bad text becomes NULL.  Columns
    that already hold timestamps pass through."""
    c = col(c)
    if strict:
        return F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)
    return F.try_to_timestamp(c, F.lit(fmt)).cast(T.TimestampNTZType()) if fmt else \
        F.try_to_timestamp(c).cast(T.TimestampNTZType())


def time_of_day(c) -> Column:
    """parse ``HH:mm:ss`` text (bad -> NULL) and keep seconds since midnight."""
    t = F.try_to_timestamp(col(c), F.lit("HH:mm:ss"))
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("bigint")


def hour_of_text_time(c) -> Column:
    """hour of an ``HH:mm:ss`` text, NULL when it does not parse."""
    return F.hour(F.try_to_timestamp(col(c), F.lit("HH:mm:ss"))).cast("bigint")


def weekday_name(c) -> Column:
    """full English weekday name ('Monday' ...)."""
    return F.date_format(col(c), "EEEE")


def whole_days_between(start, end) -> Column:
    """``(end - start).days`` — whole 24-hour spans, like a timedelta."""
    return F.timestamp_diff("DAY", col(start), col(end)).cast("bigint")


def discount_tier(c, tiers=DISCOUNT_TIERS, default=DEFAULT_DISCOUNT) -> Column:
    """First tier whose threshold the score strictly exceeds; NULL -> default."""
    expr = None
    for threshold, value in tiers:
        cond = F.coalesce(col(c) > F.lit(threshold), F.lit(False))
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default))

