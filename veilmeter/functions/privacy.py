"""Differential-privacy accounting as column expressions: four accountants that disagree by design."""

from __future__ import annotations

import warnings
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmeter.functions import risk

#: The orders of the first accountant in the order in which ties are settled.
ORDERS = [*map(float, range(2, 513)), 1.5, 1.25, 1.1]
SIMPLE_ORDERS = [1 + x / 10 for x in range(1, 100)] + [float(x) for x in range(12, 64)]


def gaussian_rdp(alpha: Column, sigma: Column, sensitivity: float = 1.0) -> Column:
    return alpha * sensitivity**2 / (2 * sigma * sigma)


def sampled_rdp(alpha: Column, sigma: Column, q: Column) -> Column:
    """Per step. Beyond the range of exp the logarithm is taken term by term."""
    x = alpha / (2 * sigma * sigma)
    safe = F.log1p(q * q * (F.exp(F.least(x, F.lit(700.0))) - 1))
    return F.when(alpha < 2, q * q * alpha / (sigma * sigma)).otherwise(F.when(x > 700, x + 2 * F.log(q)).otherwise(safe) * alpha / (alpha - 1))


def rdp_to_dp(rdp: Column, alpha: Column, delta: Column) -> Column:
    value = rdp + (F.log(1 / delta) + F.log(alpha / (alpha - 1)) - 1 / alpha) / (alpha - 1)
    return F.when(alpha <= 1, F.lit(float("inf"))).otherwise(value)


def rdp_curve(configs: DataFrame, orders: list[float] | None = None) -> DataFrame:
    """configs with place, alpha, epsilon: a row for each order."""
    each = configs.select("*", F.posexplode(F.array(*map(F.lit, orders or ORDERS))).alias("place", "alpha"))
    valid = each.filter("sigma > 0 AND sample_rate > 0 AND sample_rate <= 1 AND steps >= 0 AND delta > 0 AND delta < 1")
    a, s, q = F.col("alpha"), F.col("sigma"), F.col("sample_rate")
    return valid.withColumn("epsilon", rdp_to_dp(sampled_rdp(a, s, q) * F.col("steps"), a, F.col("delta")))


def compute_epsilon(configs: DataFrame, orders: list[float] | None = None) -> DataFrame:
    """run_id, epsilon, alpha: the least epsilon; of equal ones the first order."""
    best = F.min(F.struct("epsilon", "place", "alpha")).alias("b")
    return rdp_curve(configs, orders).groupBy("run_id").agg(best).select("run_id", F.col("b.epsilon").alias("epsilon"), F.col("b.alpha").alias("alpha"))


def simple_epsilon(configs: DataFrame) -> DataFrame:
    """The simplified accountant, whose result doesn't depend on steps. It may be too low: not for guarantees."""
    warnings.warn("the simplified accountant ignores the number of steps and may give too low an epsilon", stacklevel=2)
    a, s, q = F.col("alpha"), F.col("sigma"), F.col("sample_rate")
    half = (a - 1) / (2 * s * s)
    rdp = half + F.log(1 + q * (F.exp(half) - 1))
    each = configs.select("*", F.explode(F.array(*map(F.lit, SIMPLE_ORDERS))).alias("alpha"))
    return each.groupBy("run_id").agg(F.min(rdp - F.log(F.col("delta")) / (a - 1)).alias("epsilon"))


def gdp_epsilon(configs: DataFrame, delta: float) -> DataFrame:
    """The central-limit accountant, of which the same holds."""
    warnings.warn("the central-limit accountant is an approximation and may give too low an epsilon", stacklevel=2)
    mu = F.sqrt(F.col("steps").cast("double")) * F.col("sample_rate") / F.col("sigma")
    return configs.select("run_id", (mu * NormalDist().inv_cdf(1 - delta) + mu * mu / 2).alias("epsilon"))


def steps_epsilon(steps: Column, q: float, sigma: float, delta: float, accountant: str = "gdp") -> Column:
    """What is spent after a number of steps, by the accountant `gdp`, or `rdp`, which doesn't depend on the number."""
    if accountant == "gdp":
        mu = F.sqrt(steps.cast("double")) * q / sigma
        return mu * NormalDist().inv_cdf(1 - delta) + mu * mu / 2
    if accountant == "rdp":
        a = F.array(*map(F.lit, SIMPLE_ORDERS))
        half = lambda x: (x - 1) / (2 * sigma * sigma)
        return F.array_min(F.transform(a, lambda x: half(x) + F.log(1 + q * (F.exp(half(x)) - 1)) - F.log(F.lit(delta)) / (x - 1)))
    raise ValueError(f"unknown accountant: {accountant}")


def accountant_epsilon(configs: DataFrame, accountant: str, delta: float = 1e-5) -> DataFrame:
    if accountant not in ("rdp", "gdp"):
        raise ValueError(f"unknown accountant: {accountant}")
    return simple_epsilon(configs) if accountant == "rdp" else gdp_epsilon(configs, delta)


def strong_epsilon(q: Column, steps: Column, delta: Column, sigma: Column) -> Column:
    return F.greatest(F.lit(0.0), q * F.sqrt(2 * steps * F.log(1 / delta)) / sigma)


def budget(configs: DataFrame) -> DataFrame:
    """n, epochs, batch, sigma, delta -> steps, q, epsilon, risk, sigma that gives epsilon 1, advice. Invalid rows raise."""
    ok = (F.col("n") > 0) & (F.col("epochs") > 0) & (F.col("batch") > 0) & (F.col("batch") <= F.col("n")) & (F.col("sigma") > 0) & (F.col("delta") > 0) & (F.col("delta") < 1)
    checked = configs.filter(F.when(ok, True).otherwise(F.raise_error(F.lit("invalid budget configuration")).cast("boolean")))
    q, steps = F.col("batch") / F.col("n"), F.ceil(F.col("epochs") * F.col("n") / F.col("batch")).cast("long")
    out = checked.withColumns({"q": q, "steps": steps})
    out = out.withColumn("epsilon", strong_epsilon(F.col("q"), F.col("steps"), F.col("delta"), F.col("sigma")))
    out = out.withColumns({"risk": risk.by_budget(F.col("epsilon")), "required_sigma": F.col("q") * F.sqrt(2 * F.col("steps") * F.log(1 / F.col("delta")))})
    return out.withColumn("advice", advice())


def fixed(x: Column, digits: int) -> Column:
    """A number with so many digits, as C and SQL print it: by its exact binary value, ties to even. format_string would round its shortest
    decimal form, half up, so that 1.005, which is below that, became 1.01."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def advice() -> Column:
    """What to do about a budget, with its figures. The texts are fixed values."""
    e, need = fixed(F.col("epsilon"), 2), fixed(F.col("required_sigma"), 1)
    fewer = F.greatest(F.lit(1), F.floor(F.col("epochs") / 2)).cast("string")
    low = F.concat(F.lit("Epsilon = "), e, F.lit(" meets the recommended threshold of <= 1.0. Current sigma = "), fixed(F.col("sigma"), 1), F.lit(" provides strong differential privacy guarantees."))
    medium = F.concat(F.lit("Epsilon = "), e, F.lit(" is acceptable for non-sensitive data. To reach epsilon <= 1.0 (LOW risk), increase sigma to >= "), need, F.lit(". Note: higher sigma reduces model utility."))
    high = F.concat(
        F.lit("Epsilon = "), e, F.lit(" provides weak privacy guarantees. To reach epsilon <= 1.0, increase sigma to >= "), need, F.lit(" or reduce epochs (current: "), F.col("epochs").cast("string"),
        F.lit("). Consider reducing epochs to "), fewer, F.lit(" and re-evaluating."),
    )
    return F.when(F.col("risk") == "LOW", low).when(F.col("risk") == "MEDIUM", medium).otherwise(high)


def interpretation(epsilon: Column, shown: Column | None = None) -> Column:
    """What an epsilon means for an adversary's odds; e counts as 2.718; shown: how epsilon is printed. The text is a fixed value."""
    return F.concat(F.lit("an adversary gains at most e^"), epsilon.cast("string") if shown is None else shown, F.lit(" = "), fixed(F.pow(F.lit(2.718), epsilon), 2), F.lit("x odds advantage"))


def log_floor(p: Column, floor: float = 1e-12) -> Column:
    return F.log(F.greatest(F.lit(floor), F.least(F.lit(1.0), p)))
