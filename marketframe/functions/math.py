"""Functions that Spark has no built-in for, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: W. J. Cody, Rational Chebyshev approximation for the error function, 1969;
#: coefficients for erf on |x| <= 0.46875 and for erfc on 0.46875..4 and beyond 4.
ERF_P = (3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1)
ERF_Q = (2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03)
ERFC_P = (5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8)
ERFC_Q = (1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03)
FAR_P = (3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2)
FAR_Q = (2.56852019228982242e00, 1.87295284992346047e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)


def _ratio(x: Column, top: tuple[float, ...], bottom: tuple[float, ...]) -> Column:
    """Cody's form: the last coefficient of ``top`` leads, the bottom leads with 1."""
    num, den = F.lit(top[-1]) * x, x
    for p, q in zip(top[:-2], bottom[:-1], strict=True):
        num, den = (num + p) * x, (den + q) * x
    return (num + top[-2]) / (den + bottom[-1])


def _erfc_of(a: Column, q: Column, r: Column) -> Column:
    """erfc for a >= 0, with q = a * a and r = 1 / q given."""
    near = 1 - a * _ratio(q, ERF_P, ERF_Q)
    middle = F.exp(-q) * _ratio(a, ERFC_P, ERFC_Q)
    far = F.exp(-q) / a * (1 / math.sqrt(math.pi) - r * _ratio(r, FAR_P, FAR_Q))
    return F.when(a <= 0.46875, near).when(a <= 4, middle).otherwise(far)


def with_norm_cdf(df: DataFrame, of: dict[str, str]) -> DataFrame:
    """``df`` with the normal distribution function of columns, new column -> column; about 1e-15 exact.

    The steps are columns of their own: as one expression the argument would be
    repeated at every power, and the generated code would outgrow a method.
    """
    tiny = 1e-300
    temporary = [f"__{k}_{o}" for o in of for k in "aqr"]
    df = df.withColumns({f"__a_{o}": F.greatest(F.abs(F.col(x)) / math.sqrt(2), F.lit(tiny)) for o, x in of.items()})
    df = df.withColumns({f"__q_{o}": F.col(x) * F.col(x) / 2 for o, x in of.items()})
    df = df.withColumns({f"__r_{o}": 1 / F.greatest(F.col(f"__q_{o}"), F.lit(tiny)) for o in of})
    for o, x in of.items():
        half = _erfc_of(F.col(f"__a_{o}"), F.col(f"__q_{o}"), F.col(f"__r_{o}")) / 2
        df = df.withColumn(o, half).withColumn(o, F.when(F.col(x) > 0, 1 - F.col(o)).otherwise(F.col(o)))
    return df.drop(*temporary)


def norm_cdf_array(x):
    """The same approximation on a numpy array."""
    import numpy as np

    def ratio(v, top, bottom):
        num, den = top[-1] * v, v
        for p, q in zip(top[:-2], bottom[:-1], strict=True):
            num, den = (num + p) * v, (den + q) * v
        return (num + top[-2]) / (den + bottom[-1])

    a = np.abs(x) / math.sqrt(2)
    q = np.minimum(a * a, 700.0)
    out = np.empty_like(a)
    near, far = a <= 0.46875, a > 4
    middle = ~near & ~far
    out[near] = 1 - a[near] * ratio(q[near], ERF_P, ERF_Q)
    out[middle] = np.exp(-q[middle]) * ratio(a[middle], ERFC_P, ERFC_Q)
    r = 1 / q[far]
    out[far] = np.exp(-q[far]) / a[far] * (1 / math.sqrt(math.pi) - r * ratio(r, FAR_P, FAR_Q))
    return np.where(x > 0, 1 - 0.5 * out, 0.5 * out)


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def log_factorial(n: Column) -> Column:
    """log n! of a whole number: a sum of logarithms up to 20, Stirling's series above."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)])
    x = F.greatest(n.cast("double"), F.lit(1.0)) + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.get(small, n.cast("int"))).otherwise(series)


def log_sum_exp(values: Column) -> Column:
    """log of the sum of exponentials of an array, shifted by its largest value."""
    top = F.array_max(values)
    return F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
