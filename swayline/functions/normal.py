"""Normal distribution as SQL text, so it stays inside generated code.

Every function takes and returns SQL text; arguments should be plain column names, as they are repeated.
"""

import math

# Hart's rational approximation of the normal tail (West 2005, double precision).
UPPER = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
]
LOWER = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
]
SPLIT = 7.07106781186547


def _polynomial(z, coefficients):
    text = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        text = f"({text} * {z} + {c!r}D)"
    return text


def density(x):
    return f"(exp({x} * {x} * -0.5D) * {1 / math.sqrt(2 * math.pi)!r}D)"


def upper_tail(z):
    """P(Z > z) for z >= 0."""
    near = f"exp({z} * {z} * -0.5D) * {_polynomial(z, UPPER)} / {_polynomial(z, LOWER)}"
    tail = f"({z} + 0.65D)"
    for k in (4, 3, 2, 1):
        tail = f"({z} + {k}D / {tail})"
    return f"(CASE WHEN {z} < {SPLIT}D THEN {near} ELSE {density(z)} / {tail} END)"


def cumulative(x):
    """P(Z <= x)."""
    tail = upper_tail(f"abs({x})")
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def two_sided(statistic):
    """Two-sided p-value of a z statistic."""
    return f"(2 * {upper_tail(f'abs({statistic})')})"
