"""Normal distribution and F tail as column expressions and as plain SQL text.

The text form runs unchanged in Spark and in other SQL engines, and stays in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Rational approximations of the normal quantile (Wichura 1988, AS 241, PPND16),
# lowest power first, numerator then denominator.
QUANTILE_CENTRE = (
    [3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727],
    [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610],
)
QUANTILE_MIDDLE = (
    [1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4],
    [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9],
)
QUANTILE_TAIL = (
    [6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
    [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15],
)
# Upper tail of the normal (Hart 1968), lowest power first, numerator then denominator.
TAIL_RATIO = (
    [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
     6.37396220353165, 0.700383064443688, 0.0352624965998911],
    [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
     86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184],
)


def _horner(coefficients: list[float], x: str) -> str:
    text = f"{coefficients[-1]!r}e0" if "e" not in repr(coefficients[-1]) else repr(coefficients[-1])
    for value in reversed(coefficients[:-1]):
        literal = repr(value) if "e" in repr(value) else f"{value!r}e0"
        text = f"({text}*{x}+{literal})"
    return text


def _ratio(pair: tuple[list[float], list[float]], x: str) -> str:
    return f"({_horner(pair[0], x)}/{_horner(pair[1], x)})"


def quantile_sql(p: str) -> str:
    """SQL text for the standard normal quantile of the probability ``p`` (an SQL expression)."""
    q = f"(({p})-0.5e0)"
    r = f"sqrt(-ln(least(({p}),1e0-({p}))))"
    return (
        f"CASE WHEN abs{q}<=0.425e0 THEN {q}*{_ratio(QUANTILE_CENTRE, f'(0.180625e0-{q}*{q})')}"
        f" WHEN {r}<=5e0 THEN sign{q}*{_ratio(QUANTILE_MIDDLE, f'({r}-1.6e0)')}"
        f" ELSE sign{q}*{_ratio(QUANTILE_TAIL, f'({r}-5e0)')} END"
    )


def log_upper_tail_sql(z: str) -> str:
    """SQL text for ``ln(1 - Phi(z))`` without underflow."""
    x = f"abs({z})"
    far = f"({x}+1e0/({x}+2e0/({x}+3e0/({x}+4e0/({x}+0.65e0)))))"
    tail = (
        f"(-{x}*{x}/2e0 + CASE WHEN {x}<7.07106781186547e0 THEN ln{_ratio(TAIL_RATIO, x)}"
        f" ELSE -ln({far}*2.506628274631e0) END)"
    )
    return f"CASE WHEN ({z})>=0e0 THEN {tail} ELSE ln(1e0-exp({tail})) END"


def normal_quantile(p: Column | str) -> Column:
    """Quantile of a column given by name."""
    return F.expr(quantile_sql(p))


def log_upper_tail(z: str) -> Column:
    return F.expr(log_upper_tail_sql(z))


def upper_tail(z: str) -> Column:
    return F.exp(log_upper_tail(z))


def f_upper_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f): the regularised incomplete beta function by its continued fraction."""
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    if x <= 0:
        return 0.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + (b * math.log1p(-x) if x < 1 else 0)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return value
