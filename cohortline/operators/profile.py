"""Activity profile of each patient: hours per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortline.functions.columns import named, with_prefix

PREFIX = "mins_"
NOT_CATEGORIES = ("mins_prev",)


def profile_dims(patients: DataFrame) -> list[str]:
    """Category names found by prefix among the patient columns."""
    found = [c for c in with_prefix(patients, PREFIX) if c not in NOT_CATEGORIES]
    return [c.removeprefix(PREFIX) for c in found]


def profile_matrix(patients: DataFrame) -> DataFrame:
    """client_id and one column of hours per category."""
    hours = [(named(PREFIX + d) / 60).alias(d) for d in profile_dims(patients)]
    return patients.select("client_id", *hours)


def dims_of(profile: DataFrame) -> list[str]:
    return [c for c in profile.columns if c != "client_id"]


def to_long(profile: DataFrame, value: str = "hours") -> DataFrame:
    """Wide profile to (client_id, dim, value)."""
    pairs = [
        F.struct(F.lit(d).alias("dim"), named(d).alias(value)) for d in dims_of(profile)
    ]
    return profile.select("client_id", F.inline(F.array(*pairs)))


def drop_constant(profile: DataFrame) -> DataFrame:
    """Keep the columns that vary: sample standard deviation above zero."""
    dims = dims_of(profile)
    if not dims:
        return profile
    spread = profile.agg(*[F.stddev_samp(named(d)) for d in dims]).first()
    kept = [d for d, s in zip(dims, spread) if s is not None and s > 0]
    return profile.select("client_id", *[named(d) for d in kept])


# Upper limits of the bins used by ``rescale(mode="bins")``.
BIN_LIMITS = tuple(i * 0.1 for i in range(11))


def _bin(x: Column) -> Column:
    """1 for (-1, 0], 2 for (0, 0.1], … 11 for (0.9, 1]; missing outside."""
    above = sum((x > F.lit(limit)).cast("double") for limit in BIN_LIMITS)
    return F.when((x > -1) & (x <= BIN_LIMITS[-1]), above + 1)


def rescale(profile: DataFrame, mode: str = "identity") -> DataFrame:
    """Apply one scale to every profile column.

    ``identity`` (default), ``log_minmax`` (log10(x+1) to 0–1 per column),
    ``bins`` (tenths of 0–1 to 1…11), ``max`` (share of the largest value of the
    whole table), ``over_one`` (1 if above 1, else 0), ``minus_one``. Modes are
    chained by calling the function again.
    """
    dims = dims_of(profile)
    if mode == "identity":
        return profile
    if mode == "log_minmax":
        logs = {d: F.log10(named(d) + 1) for d in dims}
        stats = profile.agg(
            *[F.min(logs[d]) for d in dims], *[F.max(logs[d]) for d in dims]
        ).first()
        scaled = {
            d: (logs[d] - F.lit(low)) / F.lit(high - low) if high > low else F.lit(0.5)
            for d, low, high in zip(dims, stats[: len(dims)], stats[len(dims) :])
        }
    elif mode == "bins":
        scaled = {d: _bin(named(d)) for d in dims}
    elif mode == "max":
        top = max(profile.agg(*[F.max(named(d)) for d in dims]).first())
        scaled = {d: F.try_divide(named(d), F.lit(top)) for d in dims}
    elif mode == "over_one":
        scaled = {d: (named(d) > 1).cast("double") for d in dims}
    elif mode == "minus_one":
        scaled = {d: named(d) - 1 for d in dims}
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return profile.select("client_id", *[scaled[d].alias(d) for d in dims])


def as_vector(profile: DataFrame) -> DataFrame:
    """(client_id, x): the profile as one array of doubles."""
    values = F.array(*[named(d) for d in dims_of(profile)]).cast("array<double>")
    return profile.select("client_id", values.alias("x"))
