"""Scalar, array and map expressions. All are built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the activity model: Boltzmann's constant in eV and in J, Planck's in J s, temperature in K, optimal binding in eV.
BOLTZMANN_EV = 8.617e-5
BOLTZMANN_J = 1.38e-23
PLANCK_J = 6.626e-34
TEMPERATURE = 298.0
OPTIMUM = 0.895


def gaussian_2d(x: Column, y: Column, mux: Column, muy: Column, sigma: Column, normalised: bool = False) -> Column:
    """A round Gaussian bump at (mux, muy)."""
    bump = F.exp(-(F.pow(x - mux, 2) + F.pow(y - muy, 2)) / (F.lit(2.0) * F.pow(sigma, 2)))
    return bump / (F.lit(6.283185307179586) * F.pow(sigma, 2)) if normalised else bump


def radial_basis(d: Column, low: float = 0.0, high: float = 8.0, step: float = 0.2, width: float | None = None) -> Column:
    """Gaussian filters of a distance at low, low + step, ... high, as an array."""
    n, var = round((high - low) / step), width or step
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.exp(-F.pow(d - (F.lit(low) + i * F.lit(step)), 2) / F.lit(var * var)))


def dot(x: Column, y: Column) -> Column:
    """The inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def euclidean(x: Column, y: Column) -> Column:
    """The distance of two arrays of one length."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def log_rate(energy: Column, optimum: float = OPTIMUM, temperature: float = TEMPERATURE, prefactor: float | None = None) -> Column:
    """ln of kT/h exp(-|E - optimum| / kT)."""
    kt = BOLTZMANN_EV * temperature
    return F.log(F.lit(prefactor if prefactor is not None else BOLTZMANN_J * temperature / PLANCK_J)) - F.abs(energy - F.lit(optimum)) / F.lit(kt)


def acceptance(before: Column, after: Column, temperature: Column) -> Column:
    """The chance of accepting a proposed state, at most 1; the exponent is clamped first."""
    return F.exp(F.least((before - after) / (F.lit(BOLTZMANN_EV) * temperature), F.lit(0.0)))


def cooling(step: Column, steps: int, start: float = 4000.0, end: float = 298.0) -> Column:
    """A linear schedule from start to end over the steps 0 to steps - 1."""
    return F.lit(start - end) * (F.lit(1.0) - (step + 1) / F.lit(float(steps))) + F.lit(end)


def apportion(shares: list[Column], parts: int = 512, rest: int = -1) -> list[Column]:
    """Whole parts of each share, rounded toward zero; what is left goes to the category
    `rest`, unless no part was given at all."""
    counts = [(F.lit(float(parts)) * s).cast("int") for s in shares]
    total = reduce(lambda a, b: a + b, counts)
    at = rest % len(counts)
    return [F.when(total > 0, c + parts - total).otherwise(c) if i == at else c for i, c in enumerate(counts)]


def log_shift(value: Column, least: Column) -> Column:
    """ln(value - least + 1)."""
    return F.log(value - least + 1)


def lut_index(value: Column, entries: int = 256) -> Column:
    """The entry of a step table that a value of 0 to 1 falls into, after clipping."""
    return F.least(F.lit(entries - 1), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * entries)).cast("int")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, std)


def inverse_z_score(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def one_hot(value: Column, categories: list) -> Column:
    """1 at the category's place in the given order, else 0; all 0 for others and null."""
    return F.array(*[F.coalesce((value == F.lit(c)).cast("int"), F.lit(0)) for c in categories])


def edge_list(start: float, stop: float, parts: int) -> list[int]:
    """parts + 1 evenly spaced edges as integers, rounded half to even."""
    return [round(float(start) + i * (float(stop) - float(start)) / float(parts)) for i in range(parts + 1)]


def edges(start: float, stop: float, parts: int) -> Column:
    """edge_list() as an array."""
    return F.lit(edge_list(start, stop, parts))


def edges_below(value: Column, cuts: list, strict: bool = False, unit: Column | None = None) -> Column:
    """How many of the sorted edges (times a unit) lie at or below a value (strictly below
    with strict), by halving; null for null."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        edge = F.lit(cuts[mid]) if unit is None else F.lit(cuts[mid]) * unit
        right = value > edge if strict else value >= edge
        return F.when(right, half(mid + 1, hi)).otherwise(half(lo, mid))

    return F.when(value.isNotNull(), half(0, len(cuts)))


def bucket(value: Column, edges: list) -> Column:
    """The last edge's number at or below a value (0-based), null outside of all edges."""
    return F.when((value >= edges[0]) & (value < edges[-1]), edges_below(value, edges) - 1)


def label_of(code: Column, labels: dict) -> Column:
    """The label of a code, null for codes without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code)


def code_of(label: Column, labels: dict) -> Column:
    """The code of a label, null for labels without one."""
    return label_of(label, {v: k for k, v in labels.items()})


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def finite(*columns: Column) -> Column:
    """True where every column holds a finite number."""
    one = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return reduce(lambda a, b: a & b, [one(c) for c in columns])


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def error_gain(truth: Column, first: Column, second: Column) -> Column:
    """How much closer to the truth the second prediction is than the first."""
    return F.abs(first - truth) - F.abs(second - truth)
