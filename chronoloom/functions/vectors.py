"""Vector expressions over ARRAY<DOUBLE> columns. Weights are small matrices given as lists of rows; sums are unrolled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Column, b: Column) -> Column:
    """Of two arrays of any equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, w: Matrix, bias: list[float] | None = None) -> Column:
    """x W + b for a weight matrix with one row for each input."""
    cols = lambda x: [total([F.get(x, F.lit(i)) * F.lit(row[j]) for i, row in enumerate(w)]) + F.lit(bias[j] if bias else 0.0) for j in range(len(w[0]))]
    return let(x, lambda x: F.array(*cols(x)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * slope)


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def softmax(x: Column) -> Column:
    powers = let(x, lambda x: let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top))))
    return let(powers, lambda e: let(_sum(e), lambda s: F.transform(e, lambda v: v / s)))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    centred = let(x, lambda x: let(_sum(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))
    return let(centred, lambda c: let(F.sqrt(_sum(F.transform(c, lambda v: v * v)) / F.size(c) + eps), lambda s: F.transform(c, lambda v: v / s)))


def time_encode(t: Column, d: int) -> Column:
    """cos(t w_i) with w_i = 10 ** (-9 i / (d - 1))."""
    return F.array(*[F.cos(t * F.lit(10.0 ** (-9 * i / max(1, d - 1)))) for i in range(d)])


def time_encode_frozen(t: Column, d: int, alpha: float = 10.0, beta: float = 1.0) -> Column:
    """Frozen variant: w_i = alpha ** -(i d / (beta (d - 1)))."""
    return F.array(*[F.cos(t * F.lit(alpha ** -(i * d / beta / max(1, d - 1)))) for i in range(d)])


def nan_to_num(x: Column) -> Column:
    return F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))


def gru_cell(x: Column, h: Column, gates: Matrix, candidate: Matrix) -> Column:
    """z, r = sigmoid([x h] gates); n = tanh([x, r h] candidate); (1 - z) n + z h."""
    d = len(candidate[0])

    def with_gates(x: Column, h: Column, g: Column) -> Column:
        z, r = F.slice(g, 1, d), F.slice(g, d + 1, d)
        n = F.transform(linear(F.concat(x, F.zip_with(r, h, lambda a, b: a * b)), candidate), F.tanh)
        return F.zip_with(F.zip_with(z, n, lambda a, b: (1 - a) * b), F.zip_with(z, h, lambda a, b: a * b), lambda a, b: a + b)

    return let(x, lambda x: let(h, lambda h: let(F.transform(linear(F.concat(x, h), gates), sigmoid), lambda g: with_gates(x, h, g))))


def lstm_state(x: Column, h: Column, c: Column, gates: Matrix) -> Column:
    """struct(h, c): i, f, o = sigmoid, g = tanh of [x h] gates; c' = f c + i g; h' = o tanh(c')."""
    d = len(gates[0]) // 4

    def next_state(g: Column) -> Column:
        part = lambda k, f: F.transform(F.slice(g, k * d + 1, d), f)
        kept = F.zip_with(part(1, sigmoid), c, lambda a, b: a * b)
        c2 = F.zip_with(kept, F.zip_with(part(0, sigmoid), part(3, F.tanh), lambda a, b: a * b), lambda a, b: a + b)
        return let(c2, lambda c2: F.struct(F.zip_with(part(2, sigmoid), c2, lambda a, b: a * F.tanh(b)).alias("h"), c2.alias("c")))

    return let(linear(F.concat(x, h), gates), next_state)


def lstm_cell(x: Column, h: Column, c: Column, gates: Matrix) -> tuple[Column, Column]:
    state = lstm_state(x, h, c, gates)
    return state["h"], state["c"]


def weights(rows: int, cols: int, seed: int = 0) -> Matrix:
    """A small fixed matrix for examples and queries."""
    return [[((i * 7 + j * 3 + seed) % 11 - 5) / 10 for j in range(cols)] for i in range(rows)]
