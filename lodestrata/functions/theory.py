"""Closed forms of chain recovery as Columns; every argument may be a column or a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def similarity_at(s0, rho, i) -> Column:
    return _c(s0) * F.pow(_c(rho), _c(i))


def similarity_recovery(s0, rho, d) -> Column:
    """Every hop of a similarity chain of depth d is found: s0**d * rho**(d (d + 1) / 2)."""
    d = _c(d)
    return F.exp(log_similarity_recovery(s0, rho, d))


def log_similarity_recovery(s0, rho, d) -> Column:
    d = _c(d)
    return d * F.log(_c(s0)) + d * (d + 1) / 2 * F.log(_c(rho))


def structured_recovery(q, d) -> Column:
    return F.pow(_c(q), _c(d))


def gap(s0, rho, q, d) -> Column:
    return structured_recovery(q, d) - similarity_recovery(s0, rho, d)


def crossover_depth(s0, rho, q) -> Column:
    """The depth at which both recoveries are equal."""
    return 2 * (F.log(_c(q)) - F.log(_c(s0))) / F.log(_c(rho)) - 1


def half_life(rho) -> Column:
    return F.log(F.lit(0.5)) / F.log(_c(rho))


def binary_entropy(p) -> Column:
    p = _c(p)
    term = lambda x: F.when(x <= 0, 0.0).otherwise(-x * F.log2(x))
    return term(p) + term(1 - p)


def channel_capacity(p) -> Column:
    return 1 - binary_entropy(p)


def scatter_factor(p, sigma) -> Column:
    return F.pow(_c(p), _c(sigma))


def supersession_structured(q, n) -> Column:
    """The head of a chain of n revisions found over n - 1 edges."""
    return F.pow(_c(q), _c(n) - 1)


def supersession_similarity(n) -> Column:
    return 1 / _c(n)


def break_even_quality(n) -> Column:
    n = _c(n)
    return F.when(n <= 1, 1.0).otherwise(F.pow(1 / n, 1 / (n - 1)))


def similarity_gradients(s0, rho, d) -> tuple[Column, Column]:
    """Derivatives of similarity_recovery by s0 and rho."""
    p, d = similarity_recovery(s0, rho, d), _c(d)
    return d * p / _c(s0), d * (d + 1) / 2 * p / _c(rho)


def structured_gradient(q, d) -> Column:
    return _c(d) * structured_recovery(q, d) / _c(q)


def return_on_tokens(s0, rho, d, per_item) -> Column:
    """Recovery for each thousand tokens, if hop i costs per_item / s_i tokens."""
    i = F.sequence(F.lit(1), _c(d).cast("int"))
    tokens = F.aggregate(i, F.lit(0.0), lambda s, k: s + _c(per_item) / similarity_at(s0, rho, k.cast("double")))
    return 1000 * similarity_recovery(s0, rho, d) / tokens


def net_value_gain(s0, rho, q, d, value, overhead) -> Column:
    return _c(value) * gap(s0, rho, q, d) - _c(overhead)


def overhead_ratio(overhead, value) -> Column:
    return _c(overhead) / _c(value)


def scattered_recovery(q, d, p, sigma) -> Column:
    """structured_recovery, each of sigma changes of place survived with chance p."""
    return structured_recovery(q, d) * scatter_factor(p, sigma)


def similarity_tokens(s0, rho, d, per_item) -> Column:
    """Tokens that a similarity chain of depth d takes, hop i costing per_item / s_i."""
    hops = F.sequence(F.lit(1), _c(d).cast("int"))
    return F.aggregate(hops, F.lit(0.0), lambda t, i: t + _c(per_item) / similarity_at(s0, rho, i.cast("double")))


def token_economics(s0, rho, q, d, per_item, dollars=None) -> dict[str, Column]:
    """What both ways cost and bring at depth d: tokens, precision, useful signal, tokens for each success, success for each
    token, and their ratios; with a price a token also dollars for each success."""
    ts, tx = similarity_tokens(s0, rho, d, per_item), _c(per_item) * _c(d)
    ps, px = similarity_recovery(s0, rho, d), structured_recovery(q, d)
    precision = _c(d) * _c(per_item) / ts
    out = {
        "similarity_tokens": ts, "structured_tokens": tx, "similarity_precision": precision, "structured_precision": _c(1.0), "similarity_signal": ts * precision, "structured_signal": tx,
        "similarity_cost": ts / ps, "structured_cost": tx / px, "cost_ratio": (ts / ps) / (tx / px), "token_ratio": ts / tx, "similarity_return": ps / ts, "structured_return": px / tx, "return_ratio": (px / tx) / (ps / ts),
    }
    if dollars is not None:
        out |= {"similarity_dollars": ts / ps * _c(dollars), "structured_dollars": tx / px * _c(dollars)}
    return out


def bisected(f, low: Column, high: Column, steps: int = 60) -> Column:
    """Where f, a function of a column that rises from below 0 to above 0, is 0 between low and high."""
    start = F.struct(low.cast("double").alias("a"), high.cast("double").alias("b"))

    def step(s, _):
        mid = (s["a"] + s["b"]) / 2
        under = f(mid) < 0
        return F.struct(F.when(under, mid).otherwise(s["a"]).alias("a"), F.when(under, s["b"]).otherwise(mid).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: (s["a"] + s["b"]) / 2)


def fano_error(entropy, k) -> Column:
    """The least chance of error among k choices that leaves so many bits of uncertainty."""
    h, k = _c(entropy), _c(k)
    most = F.log2(k)
    root = bisected(lambda p: binary_entropy(p) + p * F.log2(k - 1) - h, F.lit(0.0), (k - 1) / k)
    return F.when((k <= 1) | (h <= 0), 0.0).when(h >= most, (k - 1) / k).otherwise(root)


def central_difference(f, x, step: float = 1e-5) -> Column:
    return (f(_c(x) + step) - f(_c(x) - step)) / (2 * step)


def elasticity(gradient: Column, x, value: Column) -> Column:
    return gradient * _c(x) / value
