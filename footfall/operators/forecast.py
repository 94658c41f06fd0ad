"""Seasonal ARIMA models of many series: every order of a grid is fitted in a task of its own, and the least AIC wins.

The model of order (p, q, P, Q) with season s is
(1 - phi B)(1 - Phi B^s)(1 - B)(1 - B^s) x = (1 + theta B)(1 + Theta B^s) e, each part left out where its order is 0.
It is fitted by least conditional sum of squares: differences and errors before the start count as 0.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: p, q, P, Q of each model of the grid.
ORDERS = tuple(itertools.product((0, 1), repeat=4))
#: Coefficients stay this far inside the unit circle.
LIMIT = 0.995


def _lagged(x, lag: int):
    import numpy as np

    out = np.zeros_like(x)
    out[lag:] = x[: max(len(x) - lag, 0)]
    return out


def _divided(x, c: float, lag: int):
    """x / (1 - c B^lag): the product of 1 + (c B^lag)^(2^k), so as many passes as the length has doublings."""
    while lag < len(x) and c:
        x = x + c * _lagged(x, lag)
        c, lag = c * c, 2 * lag
    return x


def differenced(x, season: int):
    return (x[season:] - x[:-season])[1:] - (x[season:] - x[:-season])[:-1]


def errors(w, order, values, season: int):
    """The errors e of the differences w under a model."""
    phi, theta, phi_s, theta_s = _named(order, values)
    w = w - phi * _lagged(w, 1)
    w = w - phi_s * _lagged(w, season)
    return _divided(_divided(w, -theta, 1), -theta_s, season)


def _named(order, values):
    """phi, theta, Phi, Theta: the values of the parts that the order has, 0 for the others."""
    left = iter(values)
    return tuple(float(next(left)) if o else 0.0 for o in order)


def fit(w, order, season: int, rounds: int = 80):
    """(values, sum of squares, AIC) of the order's best model: damped Gauss-Newton steps from zero."""
    import numpy as np

    k = sum(order)
    best, damp = np.zeros(k), 1e-2
    e = errors(w, order, best, season)
    total = float(e @ e)
    for _ in range(rounds if k else 0):
        slopes = []
        for i in range(k):
            near = best.copy()
            near[i] += 1e-6
            slopes.append((errors(w, order, near, season) - e) / 1e-6)
        j = np.array(slopes)
        square = j @ j.T
        try:
            step = np.linalg.solve(square + damp * np.diag(np.diag(square) + 1e-12), -j @ e)
        except np.linalg.LinAlgError:
            break
        new = np.clip(best + step, -LIMIT, LIMIT)
        e_new = errors(w, order, new, season)
        total_new = float(e_new @ e_new)
        if total_new < total:
            done = total - total_new < 1e-12 * total
            best, e, total, damp = new, e_new, total_new, damp / 4
            if done:
                break
        else:
            damp *= 8
            if damp > 1e8:
                break
    n = len(w)
    return best, total, n * float(np.log(max(total, 1e-12) / n)) + 2 * (k + 1)


def ahead(x, order, values, season: int, steps: int):
    """The next values of x: errors to come are 0."""
    import numpy as np

    phi, theta, phi_s, theta_s = _named(order, values)
    w = differenced(x, season)
    n = len(w)
    e = np.concatenate([errors(w, order, values, season), np.zeros(steps)])
    w, x = np.concatenate([w, np.zeros(steps)]), np.concatenate([x, np.zeros(steps)])

    def back(a, i):
        return a[i] if i >= 0 else 0.0

    for i in range(n, n + steps):
        w[i] = (
            phi * back(w, i - 1) + phi_s * back(w, i - season) - phi * phi_s * back(w, i - season - 1)
            + theta * back(e, i - 1) + theta_s * back(e, i - season) + theta * theta_s * back(e, i - season - 1)
        )
        at = len(x) - (n + steps) + i
        x[at] = w[i] + x[at - 1] + x[at - season] - x[at - season - 1]
    return x[len(x) - steps :]


def fitted(series: DataFrame, key: str, season: int) -> DataFrame:
    """key, order, values, sse, aic, n of every order's model of every series (key, t, value).

    A series and an order are one row, dealt over the tasks; a series of up to season + 1 values has no model.
    """
    import numpy as np
    import pandas as pd

    def go(frames):
        for frame in frames:
            out = []
            for name, order, x in zip(frame[key], frame["order"], frame["x"], strict=True):
                w = differenced(np.array(x, float), season)
                values, sse, aic = fit(w, tuple(order), season)
                out.append((name, list(order), values.tolist(), sse, aic, len(w)))
            yield pd.DataFrame(out, columns=[key, "order", "values", "sse", "aic", "n"])

    rows = _rows(series, key).filter(F.size("x") > season + 1)
    orders = F.array(*(F.array(*map(F.lit, o)) for o in ORDERS))
    dealt = rows.withColumn("order", F.explode(orders)).repartition(key, "order")
    kind = dict(series.dtypes)[key]
    return dealt.select(key, "order", "x").mapInPandas(go, f"{key} {kind}, order array<int>, values array<double>, sse double, aic double, n bigint")


def _rows(series: DataFrame, key: str) -> DataFrame:
    held = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").cast("double").alias("v")))).alias("s"))
    return held.select(key, F.transform("s", lambda r: r["v"]).alias("x"))


def forecast(series: DataFrame, key: str, season: int, steps: int) -> DataFrame:
    """key, step, value, order: the next values of each series by its model of least AIC; of equals the lesser order."""
    import numpy as np
    import pandas as pd

    best = fitted(series, key, season).groupBy(key).agg(F.min(F.struct(F.round("aic", 6).alias("a"), "order", "values")).alias("b"))

    def go(frames):
        for frame in frames:
            out = []
            for name, x, order, values in zip(frame[key], frame["x"], frame["order"], frame["values"], strict=True):
                to = ahead(np.array(x, float), tuple(order), values, season, steps)
                out += [(name, i, float(v), ",".join(map(str, order))) for i, v in enumerate(to, 1)]
            yield pd.DataFrame(out, columns=[key, "step", "value", "order"])

    kind = dict(series.dtypes)[key]
    joined = _rows(series, key).join(best.select(key, "b.order", "b.values"), key)
    return joined.mapInPandas(go, f"{key} {kind}, step bigint, value double, order string")
