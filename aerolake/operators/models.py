"""Least-squares identification by sums: the data are read once into Gram matrices, which are solved per series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerolake.operators import series

#: Beyond this condition number of the Gram matrix a fit is flagged; its square root is that of the regressors.
WORST_CONDITION = 1e12


def lagged(samples: DataFrame, keys: Sequence[str], y: str, u: str, na: int, nb: int, delay: int, order: str = "idx") -> tuple[DataFrame, list[str]]:
    """Rows with all regressors of y(k): -y(k-1..k-na), u(k-delay..k-delay-nb+1); and their names."""
    w = series.along(keys, order)
    names = {**{f"y{i}": -F.lag(y, i).over(w) for i in range(1, na + 1)}, **{f"u{j}": F.lag(u, delay + j).over(w) if delay + j else F.col(u) for j in range(nb)}}
    rows = samples.select(*keys, F.col(y).alias("y0"), *(c.alias(n) for n, c in names.items()))
    return rows.where(" and ".join(f"{n} is not null" for n in names)), list(names)


def gram(rows: DataFrame, keys: Sequence[str], names: Sequence[str], target: str, weight: Column | None = None) -> DataFrame:
    """keys, n, xx (upper triangle by rows), xy, yy: sums of products, in one aggregation that combines before the shuffle."""
    weight = F.lit(1.0) if weight is None else weight
    total = lambda a, b: F.sum(weight * F.col(a) * F.col(b))
    k = len(names)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.array(*(total(names[i], names[j]) for i in range(k) for j in range(i, k))).alias("xx"),
        F.array(*(total(x, target) for x in names)).alias("xy"),
        total(target, target).alias("yy"),
        F.sum(weight * F.col(target)).alias("y_sum"),
    )


def solve(grams: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """keys, n, theta, condition, reliable, fit_percent (share of the target's variance explained, 0..100)."""
    schema = ", ".join([*(f"{c} {grams.schema[c].dataType.simpleString()}" for c in keys), "n long, theta array<double>, condition double, reliable boolean, fit_percent double"])
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            thetas, conditions, fits = [], [], []
            for n, xx, xy, yy, y_sum in zip(*(batch[c].to_pylist() for c in ("n", "xx", "xy", "yy", "y_sum")), strict=True):
                a, b = np.zeros((k, k)), np.array(xy)
                a[upper] = xx
                a = a + np.triu(a, 1).T
                theta = np.linalg.lstsq(a, b, rcond=None)[0]
                spread = yy - y_sum**2 / max(1, n)
                left = yy - 2 * theta @ b + theta @ a @ theta
                thetas.append(theta.tolist())
                conditions.append(float(np.linalg.cond(a)))
                fits.append(float(np.clip(100 * (1 - left / spread), 0, 100)) if spread >= 1e-10 else 0.0)
            reliable = [n > k and c <= WORST_CONDITION for n, c in zip(batch["n"].to_pylist(), conditions, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), batch["n"], pa.array(thetas, pa.list_(pa.float64())), pa.array(conditions, pa.float64()), pa.array(reliable, pa.bool_()), pa.array(fits, pa.float64())], [*keys, "n", "theta", "condition", "reliable", "fit_percent"])

    return grams.select(*keys, "n", "xx", "xy", "yy", "y_sum").mapInArrow(run, schema)


def delay_by_correlation(samples: DataFrame, keys: Sequence[str], y: str, u: str, longest: int = 20, order: str = "idx", block: int = 1 << 15) -> DataFrame:
    """keys, lag, correlation: the lag of 0..longest at which y follows u best, both less their means; the smallest of equals. A task holds a block of samples and
    the ``longest`` before it; its sums of products, one row a lag, are added up by series.
    """
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    at = F.row_number().over(series.along(keys, order)).cast("long") - 1
    rows = samples.select(*keys, at.alias("_at"), F.col(y).cast("double").alias("_y"), F.col(u).cast("double").alias("_u"))
    parts = rows.withColumn("_block", F.explode(F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + longest) / block))))

    def run(table: pa.Table) -> pa.Table:
        first = table["_block"][0].as_py() * block
        place = table["_at"].to_numpy() - first + longest
        size = max(int(place.max()), longest) + 1  # short series do not fill a block
        ys, us = np.full(size, np.nan), np.full(size, np.nan)
        for name, dense in (("_y", ys), ("_u", us)):
            dense[place] = table[name].to_numpy(zero_copy_only=False).astype(float)
        own, found = ys[longest:], []
        for k in range(longest + 1):
            late = us[longest - k : len(us) - k]
            both = np.isfinite(own) & np.isfinite(late)
            found.append((float(own[both] @ late[both]), float(own[both].sum()), float(late[both].sum()), int(both.sum())))
        for dense in (own, us[longest:]):  # the sums of all, for the means
            known = np.isfinite(dense)
            found.append((float(dense[known].sum()), 0.0, 0.0, int(known.sum())))
        columns = dict(zip(("_yu", "_ys", "_us", "_n"), map(pa.array, zip(*found, strict=True)), strict=True))
        return pa.table({**{k: pa.array([table[k][0].as_py()] * len(found), table.schema.field(k).type) for k in keys}, "_lag": np.arange(len(found)), **columns})

    sums = parts.groupBy(*keys, "_block").applyInArrow(run, f"{kinds}, _lag long, _yu double, _ys double, _us double, _n long")
    sums = sums.groupBy(*keys, "_lag").agg(*(F.sum(c).alias(c) for c in ("_yu", "_ys", "_us", "_n")))
    mean = lambda row: F.max(F.when(F.col("_lag") == row, F.try_divide(F.col("_yu"), F.col("_n")))).over(Window.partitionBy(*keys))
    means = sums.withColumns({"_ym": mean(longest + 1), "_um": mean(longest + 2)}).where(F.col("_lag") <= longest)
    centred = F.coalesce(F.col("_yu") - F.col("_ym") * F.col("_us") - F.col("_um") * F.col("_ys") + F.col("_n") * F.col("_ym") * F.col("_um"), F.lit(0.0))
    best = means.groupBy(*keys).agg(F.max(F.struct(centred.alias("c"), (-F.col("_lag")).alias("k"))).alias("b"))
    return best.select(*keys, (-F.col("b.k")).alias("lag"), F.col("b.c").alias("correlation"))


def poles_to_dynamics(fits: DataFrame, keys: Sequence[str], na: int, nb: int, rate_hz: float | Column) -> DataFrame:
    """keys, omega, zeta, gain, bandwidth_hz, p_gain of ARX fits: the two dominant stable poles through Tustin's rule; ``rate_hz`` may be a column of ``fits``."""
    schema = ", ".join([*(f"{c} {fits.schema[c].dataType.simpleString()}" for c in keys), "_rate double, omega double, zeta double, gain double"])

    def dynamics(theta: list[float], rate_hz: float) -> tuple[float, float, float]:
        a, b = theta[:na], theta[na:]
        total = 1 + sum(a)
        gain = sum(b) / total if abs(total) > 1e-12 else 0.0
        z = np.roots([1.0, *a]) if np.isfinite(theta).all() else np.zeros(0)
        z = sorted(z[(np.abs(z) > 0.01) & (np.abs(z) < 1)], key=lambda p: -abs(p))[:2]
        s = [2 * rate_hz * (p - 1) / (p + 1) for p in z if abs(p + 1) > 1e-9]
        if not s:
            return float("nan"), float("nan"), gain
        if abs(s[0].imag) > 1e-9:
            omega = abs(s[0])
            zeta = -s[0].real / omega
        else:
            real = sorted(abs(p.real) for p in s)
            omega = float(np.sqrt(real[0] * real[-1])) if len(real) > 1 else real[0]
            zeta = (real[0] + real[-1]) / (2 * omega) if len(real) > 1 and omega else 1.0
        return float(np.clip(omega, 1, 500)), float(np.clip(zeta, 0.05, 2)), float(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := [dynamics(t, rate) for t, rate in zip(batch["theta"].to_pylist(), batch["_rate"].to_pylist(), strict=True)]:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), batch["_rate"], *(pa.array(x, pa.float64()) for x in zip(*found, strict=True))], [*keys, "_rate", "omega", "zeta", "gain"])

    zeta = F.col("zeta")
    share = F.when(zeta < 0.5, 0.3).when(zeta < 0.8, 0.5).otherwise(0.7)
    rate = rate_hz if isinstance(rate_hz, Column) else F.lit(float(rate_hz))
    rows = fits.select(*keys, "theta", rate.cast("double").alias("_rate")).mapInArrow(run, schema)
    rows = rows.withColumns({"omega": F.nanvl("omega", F.lit(None)), "zeta": F.nanvl("zeta", F.lit(None))})
    bandwidth = F.least(share * F.col("omega") / (2 * F.pi()), F.col("_rate") / 10)
    rows = rows.withColumn("bandwidth_hz", F.when(F.col("omega").isNotNull(), bandwidth)).drop("_rate")
    return rows.withColumn("p_gain", F.least(F.greatest(2 * F.pi() * F.col("bandwidth_hz") / 10, F.lit(0.01)), F.lit(0.5)))


def arx_response(theta: list[float], na: int, nb: int, delay: int, steps: int) -> np.ndarray:
    """Output of an ARX model for a unit step, by its recursion, scaled by its steady gain where that is finite."""
    a, b = theta[:na], theta[na : na + nb]
    y = np.zeros(steps)
    for k in range(steps):
        y[k] = sum(b[j] for j in range(nb) if k - delay - j >= 0) - sum(a[i - 1] * y[k - i] for i in range(1, na + 1) if k - i >= 0)
    total = 1 + sum(a)
    gain = sum(b) / total if abs(total) > 1e-9 else 0.0
    return np.clip(y / gain, -0.5, 2.0) if abs(gain) > 1e-9 and np.isfinite(y).all() else y


def step_responses(fits: DataFrame, keys: Sequence[str], na: int, nb: int, delay: int, steps: int | Column) -> DataFrame:
    """keys, response (array of ``steps`` values; a column: the model's own) of each fitted model."""
    schema = ", ".join([*(f"{c} {fits.schema[c].dataType.simpleString()}" for c in keys), "response array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [arx_response(t, na, nb, delay, n).tolist() for t, n in zip(batch["theta"].to_pylist(), batch["_steps"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), pa.array(found, pa.list_(pa.float64()))], [*keys, "response"])

    count = steps if isinstance(steps, Column) else F.lit(steps)
    return fits.select(*keys, "theta", count.cast("int").alias("_steps")).mapInArrow(run, schema)


def cubic_spline(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ``y``, values at 0, 1, 2, ..., interpolated at the places ``at`` by cubic splines without knots at the second and the last but one value. The systems
    of all rows are solved together: on an even grid their coefficients are the same.
    """
    n = y.shape[1]
    bend = np.zeros_like(y)  # second derivatives
    if n == 3:
        bend[:] = (y[:, 2] - 2 * y[:, 1] + y[:, 0])[:, None]
    elif n > 3:
        right = 6 * (y[:, 2:] - 2 * y[:, 1:-1] + y[:, :-2])
        bend[:, 1], bend[:, -2] = right[:, 0] / 6, right[:, -1] / 6
        over, held = np.zeros(n), np.zeros_like(y)
        held[:, 1] = bend[:, 1]
        for k in range(2, n - 2):
            over[k] = 1 / (4 - over[k - 1])
            held[:, k] = (right[:, k - 1] - held[:, k - 1]) * over[k]
        for k in range(n - 3, 1, -1):
            bend[:, k] = held[:, k] - over[k] * bend[:, k + 1]
        bend[:, 0], bend[:, -1] = 2 * bend[:, 1] - bend[:, 2], 2 * bend[:, -2] - bend[:, -3]
    if n == 1:
        return np.repeat(y, len(at), axis=1)
    i = np.clip(np.floor(at).astype(np.int64), 0, n - 2)
    t = at - i
    slope = y[:, i + 1] - y[:, i] - (2 * bend[:, i] + bend[:, i + 1]) / 6
    return y[:, i] + t * slope + t**2 * bend[:, i] / 2 + t**3 * (bend[:, i + 1] - bend[:, i]) / 6


def smoothed(responses: DataFrame, keys: Sequence[str], oversample: int, value: str = "response") -> DataFrame:
    """keys, response: each response (an array) with ``oversample`` values for one, by a cubic spline from its first to its last, within -0.5 and 2. Rows of a batch
    with as many values are solved together; empty arrays stay empty, and what is no number makes its whole response none.
    """
    schema = ", ".join([*(f"{c} {responses.schema[c].dataType.simpleString()}" for c in keys), f"{value} array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.array(x, float) if x is not None else None for x in batch[value].to_pylist()]
            found: list = [None if a is None else [] for a in arrays]
            for n in {len(a) for a in arrays if a is not None} - {0}:
                at = [k for k, a in enumerate(arrays) if a is not None and len(a) == n]
                fine = cubic_spline(np.stack([arrays[k] for k in at]), np.linspace(0, n - 1, n * oversample))
                for k, row in zip(at, np.clip(fine, -0.5, 2.0), strict=True):
                    found[k] = row.tolist()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), pa.array(found, pa.list_(pa.float64()))], [*keys, value])

    return responses.select(*keys, value).mapInArrow(run, schema)


def recursion(a: list[float], forced: np.ndarray, before: list[float], most: float) -> tuple[np.ndarray, list[float]]:
    """y[k] = forced[k] - a[0] y[k - 1] - ... after the values ``before`` (latest first), and the last of them; not a number from the first value beyond ``most`` on."""
    y, last = np.zeros(len(forced)), list(before)
    for k, f in enumerate(forced.tolist()):
        v = f - sum(c * x for c, x in zip(a, last, strict=True))
        if not -most < v < most:  # an unstable model
            y[k:] = np.nan
            return y, [np.nan] * len(a)
        y[k] = v
        last = [v, *last][: len(a)]
    return y, last


def transition(a: list[float], steps: int) -> np.ndarray:
    """What ``steps`` of the recursion without force make of its last values; bounded, so that zeros stay zeros."""
    base, out = np.eye(len(a), k=-1), np.eye(len(a))
    base[:1] = [-c for c in a]
    while steps:
        if steps & 1:
            out = np.clip(out @ base, -1e150, 1e150)
        base, steps = np.clip(base @ base, -1e150, 1e150), steps >> 1
    return out


def simulate(samples: DataFrame, fits: DataFrame, keys: Sequence[str], u: str, na: int, nb: int, delay: int, order: str = "idx", block: int = 1 << 13) -> DataFrame:
    """keys, order, simulated: a model's output for its input, each value from simulated ones before; not a number from the first value beyond 1e12 on.

    The recursion is affine, so blocks of ``block`` samples run apart from zeros, a scan of their last values and of the model's transition gives
    each its start, and they run again from there. A task holds a block, or ``na`` numbers for each block of a series.
    """
    along = series.along(keys, order)
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in keys)
    inputs = [F.lag(F.col(u).cast("double"), delay + j, 0.0).over(along) for j in range(nb)]
    placed = samples.select(*keys, F.col(order).cast("long").alias(order), (F.row_number().over(along) - 1).cast("long").alias("_at"), F.array(*inputs).alias("_x"))
    known = placed.join(fits.select(*keys, "theta"), list(keys))
    forced = reduce(lambda x, y: x + y, (F.col("theta")[na + j] * F.col("_x")[j] for j in range(nb)), F.lit(0.0))
    rows = known.select(*keys, order, "_at", F.floor(F.col("_at") / block).alias("_block"), F.slice("theta", 1, na).alias("_a"), forced.alias("_f"))

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        a = table["_a"][0].as_py()
        _, last = recursion(a, table["_f"].to_numpy().astype(float), [0.0] * na, 1e150)
        return pa.table({**{c: table[c][:1] for c in [*keys, "_block"]}, "_a": pa.array([a], pa.list_(pa.float64())), "_last": pa.array([last], pa.list_(pa.float64()))})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, numbers, starts = [], [], []
            for i, (a, parts) in enumerate(zip(batch["_a"].to_pylist(), batch["_parts"].to_pylist(), strict=True)):
                over, state = transition(a, block), np.zeros(na)
                for part in parts:
                    at.append(i)
                    numbers.append(part["_block"])
                    starts.append(state.tolist())
                    state = np.array(part["_last"], float) + over @ state
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(at, pa.int64())) for c in keys), pa.array(numbers, pa.int64()), pa.array(starts, pa.list_(pa.float64()))], [*keys, "_block", "_start"])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        y, _ = recursion(table["_a"][0].as_py(), table["_f"].to_numpy().astype(float), table["_start"][0].as_py(), 1e12)
        return pa.table({**{c: table[c] for c in keys}, order: table[order], "_at": table["_at"], "simulated": y})

    parts = rows.groupBy(*keys, "_block").applyInArrow(ends, f"{kinds}, _block long, _a array<double>, _last array<double>")
    scanned = parts.groupBy(*keys).agg(F.first("_a").alias("_a"), F.array_sort(F.collect_list(F.struct("_block", "_last"))).alias("_parts")).mapInArrow(scan, f"{kinds}, _block long, _start array<double>")
    found = series.join_keys(rows, scanned, [*keys, "_block"]).groupBy(*keys, "_block").applyInArrow(run, f"{kinds}, {order} long, _at long, simulated double")
    failed = F.max(F.isnan("simulated")).over(series.along(keys, "_at").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("simulated", F.when(failed, float("nan")).otherwise(F.col("simulated"))).drop("_at")


#: Unknowns of a magnetometer calibration: M11 M22 M33 M12 M13 M23 (soft iron), c = M * offset, then the motor terms.
FIELD_UNKNOWNS = ("m11", "m22", "m33", "m12", "m13", "m23", "cx", "cy", "cz", "tx", "ty", "tz")


def field_gram(rows: DataFrame, keys: Sequence[str], raw: Sequence[str], truth: Sequence[str], throttle: str, weight: Column | None = None) -> DataFrame:
    """Sums of the linear model truth = M * raw + c + motor * throttle over all three components of every row: a third of a row each."""
    x, y, z = (F.col(c) for c in raw)
    zero, one, t = F.lit(0.0), F.lit(1.0), F.col(throttle)
    lines = [
        [x, zero, zero, y, z, zero, one, zero, zero, t, zero, zero],
        [zero, y, zero, x, zero, z, zero, one, zero, zero, t, zero],
        [zero, zero, z, zero, x, y, zero, zero, one, zero, zero, t],
    ]
    each = F.explode(F.array(*(F.struct(*(c.cast("double").alias(n) for n, c in zip(FIELD_UNKNOWNS, line, strict=True)), F.col(truth[i]).cast("double").alias("b")) for i, line in enumerate(lines))))
    long = rows.select(*keys, (F.lit(1.0) if weight is None else weight).alias("w"), each.alias("e")).select(*keys, "w", "e.*")
    return gram(long, keys, FIELD_UNKNOWNS, "b", F.col("w"))


#: Bounds of a calibration: offset, diagonal, off-diagonal and motor terms; fixed values.
FIELD_BOUNDS = np.array([(-2000.0, 2000.0)] * 3 + [(0.3, 2.0)] * 3 + [(-1.0, 1.0)] * 3 + [(-200.0, 200.0)] * 3)


def field_theta(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The linear unknowns (M, c = M * offset, motor) of offset, diagonal, off-diagonal and motor terms, and their derivatives."""
    offset, d, o = p[:3], p[3:6], p[6:9]
    m = np.array([[d[0], o[0], o[1]], [o[0], d[1], o[2]], [o[1], o[2], d[2]]])
    slope = np.zeros((12, 12))
    slope[0:6, 3:9] = np.eye(6)
    slope[6:9, 0:3] = m
    for k, (i, j) in enumerate([(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]):
        slope[6 + i, 3 + k] += offset[j]
        if i != j:
            slope[6 + j, 3 + k] += offset[i]
    slope[9:12, 9:12] = np.eye(3)
    return np.concatenate([d, o, m @ offset, p[9:]]), slope


def bounded_field(a: np.ndarray, b: np.ndarray, start: np.ndarray, used: int, rounds: int = 60) -> np.ndarray:
    """Projected Gauss-Newton on the Gram matrix from ``start``, brought within FIELD_BOUNDS: terms at a bound that pull outwards are held there. No pass over the data."""
    low, high = FIELD_BOUNDS.T
    p = np.clip(start, low, high)
    cost = lambda q: (lambda t: t @ a @ t - 2 * t @ b)(field_theta(q)[0])
    for _ in range(rounds):
        theta, slope = field_theta(p)
        gradient = slope.T @ (a @ theta - b)
        free = ~((p <= low) & (gradient > 0) | (p >= high) & (gradient < 0))
        free[used:] = False
        if not free.any():
            break
        s = slope[:, free]
        move = np.zeros(12)
        move[free] = np.linalg.lstsq(s.T @ a @ s, -gradient[free], rcond=1e-14)[0]
        scale, before = 1.0, cost(p)
        while scale > 1e-6 and cost(np.clip(p + scale * move, low, high)) > before:
            scale /= 2
        after = np.clip(p + scale * move, low, high)
        if scale <= 1e-6 or np.abs(after - p).max() < 1e-10:
            break
        p = after
    return p


def calibrate(grams: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, offset, diagonal, off_diagonal, motor, rmse of ``field_gram``; without throttle the motor terms are zero.
    ``in_bounds`` says whether the unbounded solution keeps FIELD_BOUNDS; one that does not is replaced by the best that does.
    """
    schema = ", ".join([*(f"{c} {grams.schema[c].dataType.simpleString()}" for c in keys), "n long, offset array<double>, diagonal array<double>, off_diagonal array<double>, motor array<double>, rmse double, in_bounds boolean"])
    upper = np.triu_indices(12)

    def fit(n: int, xx: list[float], xy: list[float], yy: float) -> tuple:
        a, b = np.zeros((12, 12)), np.array(xy)
        a[upper] = xx
        a = a + np.triu(a, 1).T
        used = 12 if np.abs(np.diag(a)[9:]).max() > 1e-9 else 9
        theta = np.zeros(12)
        theta[:used] = np.linalg.lstsq(a[:used, :used], b[:used], rcond=1e-14)[0]
        m = np.array([[theta[0], theta[3], theta[4]], [theta[3], theta[1], theta[5]], [theta[4], theta[5], theta[2]]])
        offset = np.linalg.lstsq(m, theta[6:9], rcond=None)[0]
        p = np.concatenate([offset, theta[:6], theta[9:]])
        inside = bool(((p >= FIELD_BOUNDS[:, 0]) & (p <= FIELD_BOUNDS[:, 1])).all())
        if not inside:
            p = bounded_field(a, b, np.nan_to_num(p), used)
            theta = field_theta(p)[0]
        rmse = float(np.sqrt(max(0.0, yy - 2 * theta @ b + theta @ a @ theta) / max(1, n)))
        offset, diagonal, off, motor = p[:3], p[3:6], p[6:9], p[9:]
        return n // 3, offset.tolist(), diagonal.tolist(), off.tolist(), motor.tolist(), rmse, inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), *([pa.list_(pa.float64())] * 4), pa.float64(), pa.bool_())
        for batch in batches:
            if found := [fit(*r) for r in zip(*(batch[c].to_pylist() for c in ("n", "xx", "xy", "yy")), strict=True)]:
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in keys), *(pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True))], [*keys, "n", "offset", "diagonal", "off_diagonal", "motor", "rmse", "in_bounds"])

    return grams.select(*keys, "n", "xx", "xy", "yy").mapInArrow(run, schema)
