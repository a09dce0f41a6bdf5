"""Column expressions: everything here stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
Z_95 = 1.959963984540054
MIN_TRIALS = 20

# Authentication methods by resistance to remote compromise.
AUTH_STRENGTH = {
    "passkey": 5, "biometric": 4, "3ds2": 4, "upi_pin": 3,
    "voice_print": 2, "otp_sms": 2, "cvv_only": 1, "none": 0,
}
WEAK_AUTH = ["cvv_only", "none", "otp_sms"]

# Units of base currency per unit, reporting thresholds.
CURRENCY_DIVISOR = {"INR": 1.0, "USD": 88.0, "EUR": 96.0}
REPORTING_LIMITS = [50_000.0, 100_000.0, 200_000.0]


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition is 0."""
    return F.coalesce(condition.cast("long"), F.lit(0).cast("long"))


def rounded(value: Column | str, digits: int) -> Column:
    """Half-even rounding on the scaled double."""
    value = F.col(value) if isinstance(value, str) else value
    scale = float(10 ** digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def log_amount(amount: Column) -> Column:
    return F.log10(F.greatest(amount, F.lit(1.0)))


def is_multiple(amount: Column, step: float) -> Column:
    return flag(F.abs(F.pmod(amount, F.lit(float(step)))) <= 1e-8)


def near_limit(amount: Column) -> Column:
    """Just under a reporting limit, both ends open."""
    return flag(reduce(
        lambda a, b: a | b, [(amount > 0.85 * t) & (amount < t) for t in REPORTING_LIMITS]
    ))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.greatest(chord, F.lit(0.0)), F.lit(1.0))))


def lookup(key: Column, values: dict, default) -> Column:
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, key), F.lit(default))


def convert_currency(amount: Column, currency: Column) -> Column:
    return rounded(amount / lookup(currency, CURRENCY_DIVISOR, 1.0), 2)


def calendar(ts: Column) -> dict[str, Column]:
    hour, dom = F.hour(ts), F.dayofmonth(ts)
    return {
        "hour": hour.cast("long"),
        "day_of_week": F.weekday(ts).cast("long"),
        "is_night": flag((hour < 6) | (hour >= 23)),
        "is_salary_window": flag((dom <= 3) | (dom >= 29)),
    }


def leading_digit(amount: Column) -> Column:
    """First significant digit of amounts of at least 1."""
    return F.when(amount >= 1, F.floor(amount / F.pow(F.lit(10.0), F.floor(F.log10(amount)))))


def id_prefix(value: Column) -> Column:
    return F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), "^([A-Za-z]+)", 1)


def payload_span(text: Column, start: Column, end: Column) -> Column:
    """Text between two offsets; NULL when either is negative."""
    return F.when((start >= 0) & (end >= 0), F.substring(text, start + 1, end - start))


def reason_list(codes: dict[str, Column]) -> Column:
    """The codes whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in codes.items()]))


def join_reasons(reasons: Column) -> Column:
    return F.array_join(reasons, "|")


def split_reasons(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda r: r != "")


def wilson(rate: Column, trials: Column) -> tuple[Column, Column]:
    """95% Wilson bounds from a rate and its trials; NULL without trials."""
    n = trials.cast("double")
    k = F.rint(F.coalesce(rate.cast("double"), F.lit(0.0)) * n)
    z2 = Z_95 * Z_95
    centre = (k + 0.5 * z2) / (n + z2)
    spread = (Z_95 / (n + z2)) * F.sqrt(k * (n - k) / n + 0.25 * z2)
    return (
        F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)),
        F.when(n > 0, F.least(F.lit(1.0), centre + spread)),
    )


def with_wilson(df, rate: str, trials: str, prefix: str | None = None, flag_name: str = "n_sufficient"):
    lo, hi = wilson(F.col(rate), F.col(trials))
    name = prefix or rate
    return df.select(
        "*", rounded(lo, 4).alias(f"{name}_lo95"), rounded(hi, 4).alias(f"{name}_hi95"),
        flag(F.col(trials) >= MIN_TRIALS).alias(flag_name),
    )


def completeness(columns: list[str]) -> Column:
    """Share of the named columns that hold a value."""
    return sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0)) / len(columns)
