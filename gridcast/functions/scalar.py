"""Scalar column expressions.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it stays inside
whole-stage codegen; nothing runs row-at-a-time in Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- coercion

def to_day(x: ColumnOrName) -> Column:
    """Timestamp / ISO text -> DATE (F1, F15). Text keeps only its first 10 characters."""
    c = _c(x)
    return F.to_date(c)


def iso_text_day(x: ColumnOrName) -> Column:
    """``yyyy-MM-dd...`` text -> DATE via the first ten characters."""
    return F.try_to_date(F.substring(_c(x), 1, 10), "yyyy-MM-dd")


def epoch_day(x: ColumnOrName) -> Column:
    """Epoch seconds -> UTC DATE (F1)."""
    return F.to_date(F.timestamp_seconds(_c(x)))


def num(x: ColumnOrName) -> Column:
    """Text or number -> finite DOUBLE; anything uncastable, NaN and infinities become NULL."""
    return finite(_c(x).try_cast("double"))


def trunc_int(x: ColumnOrName) -> Column:
    """int(float(text)) semantics: castable text -> truncated BIGINT, else NULL (F2)."""
    d = num(x)
    return F.when(d.isNotNull() & ~F.isnan(d), d.cast("bigint"))


def finite(x: ColumnOrName) -> Column:
    """NaN / +-inf -> NULL."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def blank_to_null(x: ColumnOrName) -> Column:
    """Python-falsy text (NULL or empty) -> NULL."""
    c = _c(x)
    return F.when(c.isNotNull() & (c != F.lit("")), c)


def falsy_num_to_null(x: ColumnOrName) -> Column:
    """A text field that is NULL, empty or numerically zero counts as absent."""
    c = blank_to_null(x)
    return F.when(c.isNull(), None).when(F.coalesce(num(c), F.lit(1.0)) == 0.0, None).otherwise(c)


# --------------------------------------------------------------------------- prices

def price_prob(yes_ask: ColumnOrName, yes_ask_dollars: ColumnOrName,
               last_price_dollars: ColumnOrName, yes_bid_dollars: ColumnOrName) -> Column:
    """Quote -> probability in [0, 1].

    Order: ask in cents, ask in dollars, last price in dollars, mid of bid/ask in dollars.
    Missing or empty fields and text that does not parse fall through to the next source;
    a zero price is a valid price.
    """
    ask_c = num(blank_to_null(yes_ask))
    ask_d = num(blank_to_null(yes_ask_dollars))
    last_d = num(blank_to_null(last_price_dollars))
    bid_d = num(blank_to_null(yes_bid_dollars))
    return F.coalesce(ask_c / 100.0, ask_d, last_d, (bid_d + ask_d) / 2.0)


def quote_volume(volume: ColumnOrName, volume_fp: ColumnOrName) -> Column:
    """First non-empty of volume, volume_fp, else 0; the chosen text must parse or it counts 0."""
    v = blank_to_null(volume)
    vfp = blank_to_null(volume_fp)
    return (F.when(v.isNotNull(), F.coalesce(trunc_int(v), F.lit(0)))
            .when(vfp.isNotNull(), F.coalesce(trunc_int(vfp), F.lit(0)))
            .otherwise(F.lit(0)).cast("bigint"))


def implied_prob(cents: ColumnOrName) -> Column:
    """Ask in cents -> probability; NULL stays NULL."""
    return _c(cents) / 100.0


# --------------------------------------------------------------------------- calendar

def day_of_week(d: ColumnOrName) -> Column:
    """0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(d))


def calendar_columns(d: ColumnOrName) -> list[Column]:
    """Calendar block (F7, F8): weekday, weekend, Thursday, month, quarter, season flags,
    cyclic encodings. Holiday flag is a join (see operators.timeseries.holiday_flag)."""
    c = _c(d)
    wd = F.weekday(c)
    m = F.month(c)
    two_pi = 2.0 * math.pi
    return [
        wd.alias("day_of_week"),
        (wd >= 5).cast("int").alias("is_weekend"),
        (wd == 3).cast("int").alias("is_thursday"),
        m.alias("month"),
        F.quarter(c).alias("quarter"),
        m.isin(12, 1, 2).cast("int").alias("is_winter"),
        m.isin(6, 7, 8).cast("int").alias("is_summer"),
        m.isin(3, 4, 5, 9, 10, 11).cast("int").alias("is_shoulder"),
        F.sin(F.lit(two_pi) * wd / 7.0).alias("dow_sin"),
        F.cos(F.lit(two_pi) * wd / 7.0).alias("dow_cos"),
        F.sin(F.lit(two_pi) * m / 12.0).alias("month_sin"),
        F.cos(F.lit(two_pi) * m / 12.0).alias("month_cos"),
    ]


# --------------------------------------------------------------------------- math

def safe_ln(x: ColumnOrName) -> Column:
    """ln(x) for x > 0, NULL otherwise (zero price -> NULL as in the reference)."""
    c = _c(x)
    return F.when(c > 0, F.ln(c))


def clip(x: ColumnOrName, lo: float, hi: float) -> Column:
    """Clip to [lo, hi] keeping NULL (F10). Bare greatest/least would turn NULL into a bound."""
    c = _c(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def snap(x: ColumnOrName, step: float) -> Column:
    """Snap to a step with half-even rounding."""
    return F.bround(_c(x) / step, 0) * step


def _erf_approx(z: Column) -> Column:
    """erf for z >= 0, Abramowitz-Stegun 7.1.26 (|error| <= 1.5e-7)."""
    # fixed values: Abramowitz & Stegun 7.1.26 coefficients
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    return F.lit(1.0) - poly * F.exp(-z * z)


def normal_cdf(x: ColumnOrName) -> Column:
    """Standard normal CDF as a column expression (no UDF)."""
    c = _c(x)
    z = F.abs(c) / F.lit(math.sqrt(2.0))
    e = _erf_approx(z)
    return F.when(c >= 0, 0.5 * (1.0 + e)).otherwise(0.5 * (1.0 - e))


def gaussian_tail(strike: ColumnOrName, forecast: ColumnOrName, sigma: ColumnOrName,
                  sigma_floor: float = 1e-6) -> Column:
    """P(X >= k) for X ~ N(forecast, sigma), sigma floored."""
    s = F.greatest(_c(sigma), F.lit(sigma_floor))
    return F.lit(1.0) - normal_cdf((_c(strike) - _c(forecast)) / s)


def strike_mills(x: ColumnOrName) -> Column:
    """Float strike -> integer thousandths so float equality never decides a join."""
    return F.round(_c(x) * 1000.0, 0).cast("bigint")


# --------------------------------------------------------------------------- ledger

def pnl_cents(exit_cents: ColumnOrName, entry_cents: ColumnOrName,
              contracts: ColumnOrName) -> Column:
    return ((_c(exit_cents) - _c(entry_cents)) * _c(contracts)).cast("int")


def side_exit_cents(side: ColumnOrName, settle_cents: ColumnOrName) -> Column:
    """YES exits at the settle price, NO at 100 - settle (F16)."""
    return F.when(_c(side) == "YES", _c(settle_cents)).otherwise(100 - _c(settle_cents)).cast("int")
