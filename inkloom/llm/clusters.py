"""Grouping records into similarity clusters.

The views of a record are brought to unit length and put side by side,
standardised and each reduced to its main axes; moments and axes cover all rows.  A
Gaussian mixture with regularised covariances is fitted by expectation
maximisation: started on a bounded sample with many components, of which those
are joined whose union lowers the Bayesian information criterion, then run over
all rows, each iteration adding up sufficient statistics in two levels.  The rows
that no component holds are cut into bounded blocks of rows near each other and
fitted in the same way, at last started at their densest rows, their components
added by their statistics, until the rows left over yield no more; so a group is
found however small its share of the table.  A component has density only where
most views of a record agree with its direction; a record belongs to the component
of greatest posterior, in which a view may also be a stray one, and to none where no
component has density.  Components
whose views agree are one group.  A group's members of highest density represent it.

Defined results: null, zero and wrongly long vectors are missing views; a record
without a view, or that resembles no group, has no group (null); a group that only
one record would form is none; repeated rows of an id count once; extra columns
are ignored; an empty table gives no row.
"""

from __future__ import annotations

import io
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, written

VIEWS = ("vs_emb", "sents_graph_emb", "summarized_emb", "event_emb")
#: Rows that the mixture is started on, those with the least hash of their id; rows of
#: a block of what it leaves over.
SAMPLE = 20000
#: Rounds without a new group, each with other blocks, after which rows of several
#: blocks are left over for good; rows of one block are after one.
QUIET = 3
#: Components that a fit begins with; twice as many while more than half of them are
#: left and the criterion falls.
START = 128
#: Rows of posterior shares held at a time.
ROWS = 2048
ITERATIONS = 6
#: Axes of a view, at most.
AXES = 12
#: Share of views that are not their record's own.
STRAY = 0.1
EXPLAINED = 0.95
#: Covariances are diagonal along the axes; added to them, as a share of the mean variance.
RIDGE = 0.05
#: Cosine with a component's direction from which on a view agrees.
AGREE = 0.6
LEAST_MEMBERS = 2
#: Length of the mean unit view of a group's rows, at least: two rows that have
#: nothing in common still reach 0.71.
COHESION = 0.8


def matrix(columns: list[pa.Array], sizes: list[int]) -> np.ndarray:
    """Unit views side by side; a missing view is zero."""
    n = len(columns[0])
    out = np.zeros((n, sum(sizes)), np.float32)
    at = 0
    for c, size in zip(columns, sizes):
        lengths = c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        good = np.flatnonzero(lengths == size)
        if len(good):
            flat = c.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            flat[~np.isfinite(flat).all(1)] = 0
            norm = np.linalg.norm(flat, axis=1, keepdims=True)
            out[good, at : at + size] = np.divide(flat, norm, out=np.zeros_like(flat), where=norm > 0)
        at += size
    return out


def _pack(arrays: list[np.ndarray]) -> bytes:
    f = io.BytesIO()
    np.savez(f, *arrays)
    return f.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return [z[k] for k in z.files]


def _add_up(df: DataFrame, function, levels: int = 2) -> list[np.ndarray] | None:
    """Sum over all partitions of the list of arrays that ``function`` makes of a
    batch; partitions are added pairwise in groups before the driver adds the rest."""

    def plus(total, arrays):
        return arrays if total is None else [a + b for a, b in zip(total, arrays)]

    def emit(total) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_pydict({"b": pa.array([_pack(total)], pa.binary())})

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            total = plus(total, function(b))
        yield from emit(total)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for data in b.column(0).to_pylist():
                total = plus(total, _unpack(data))
        yield from emit(total)

    parts = df.mapInArrow(first, "b binary")
    parts = parts.repartition(8).mapInArrow(again, "b binary")
    total = None
    for row in parts.collect():
        total = plus(total, _unpack(bytes(row.b)))
    return total


@dataclass
class Space:
    """Standardisation and main axes, each of one view; the axes of a view are a slice
    of ``cuts``, ``spread`` is the variance of all rows along each."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    cuts: list[slice]
    spread: np.ndarray

    @classmethod
    def of(cls, mean: np.ndarray, cov: np.ndarray, sizes: list[int], most: int, explained: float) -> Space:
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        axes, cuts, spread, at = [], [], [], 0
        for size in sizes:
            value, vector = np.linalg.eigh((cov / np.outer(scale, scale))[at : at + size, at : at + size])
            value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
            d = int(min(most, size, np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-12), explained) + 1))
            own = np.zeros((len(mean), d))
            own[at : at + size] = vector[:, :d]
            cuts.append(slice(sum(a.shape[1] for a in axes), sum(a.shape[1] for a in axes) + d))
            axes.append(own)
            spread.append(value[:d])
            at += size
        return cls(mean, scale, np.concatenate(axes, 1), cuts, np.maximum(np.concatenate(spread), 1e-6))

    def reduce(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.axes


@dataclass
class Mixture:
    """Weights, means and variances along the axes."""

    weight: np.ndarray
    mean: np.ndarray
    variance: np.ndarray

    def log_density(self, z: np.ndarray) -> np.ndarray:
        """Log of weight x density: rows by components."""
        return np.log(self.weight) + _log_normal(z, self.mean, self.variance)

    def own(self, z: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Log of weight x density of each row under its own component."""
        mean, variance = self.mean[which], self.variance[which]
        return np.log(self.weight)[which] - 0.5 * ((z - mean) ** 2 / variance + np.log(2 * np.pi * variance)).sum(1)

    def robust(self, z: np.ndarray, space: Space) -> np.ndarray:
        """The same with each view either the component's or, with probability STRAY,
        any: a view that is missing or belongs to another record outweighs no other."""
        log = np.log(self.weight) + np.zeros((len(z), 1))
        for c in space.cuts:
            own = _log_normal(z[:, c], self.mean[:, c], self.variance[:, c])
            other = _log_normal(z[:, c], np.zeros((1, c.stop - c.start)), space.spread[None, c])
            log = log + np.logaddexp(np.log(1 - STRAY) + own, np.log(STRAY) + other)
        return log


def _log_normal(z: np.ndarray, mean: np.ndarray, variance: np.ndarray) -> np.ndarray:
    p = 1 / variance
    square = (z * z) @ p.T - 2 * z @ (mean * p).T + (mean**2 * p).sum(1)
    return -0.5 * (square + np.log(variance).sum(1) + z.shape[1] * np.log(2 * np.pi))


def _posterior(log: np.ndarray) -> tuple[np.ndarray, float]:
    top = log.max(1, keepdims=True)
    e = np.exp(log - top)
    s = e.sum(1, keepdims=True)
    return e / s, float((top + np.log(s)).sum())


def _statistics(z: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    return [r.sum(0), r.T @ z, r.T @ (z * z)]


def _maximise(n: np.ndarray, s: np.ndarray, q: np.ndarray, ridge: float) -> Mixture:
    """Mixture of summed statistics; components of hardly a row are left out."""
    keep = n > 1.5
    n, s, q = n[keep], s[keep], q[keep]
    m = s / n[:, None]
    v = np.maximum(q / n[:, None] - m * m, 0)
    # few rows say little about single axes: shrink towards the round variance
    share = (1 / (1 + n))[:, None]
    v = (1 - share) * v + share * v.mean(1, keepdims=True) + ridge
    return Mixture(n / n.sum(), m, v)


def _expect(z: np.ndarray, mix: Mixture) -> tuple[list[np.ndarray], float]:
    """Statistics of the rows under the mixture, and their log likelihood."""
    total, likelihood = None, 0.0
    for at in range(0, len(z), ROWS):
        part = z[at : at + ROWS]
        r, l = _posterior(mix.log_density(part))
        likelihood += l
        one = _statistics(part, r)
        total = one if total is None else [a + b for a, b in zip(total, one)]
    return total, likelihood


def _start(z: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres with a few rounds of Lloyd; labels."""
    k = min(k, len(z))
    centres = [z[rng.integers(len(z))]]
    far = ((z - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = far / far.sum() if far.sum() > 0 else np.full(len(z), 1 / len(z))
        centres.append(z[rng.choice(len(z), p=p)])
        far = np.minimum(far, ((z - centres[-1]) ** 2).sum(1))
    c = np.stack(centres)
    for _ in range(8):
        near = (c * c).sum(1)
        label = np.concatenate([(near - 2 * z[i : i + ROWS] @ c.T).argmin(1) for i in range(0, len(z), ROWS)])
        n = np.bincount(label, minlength=k)
        held = n > 0
        order = np.argsort(label, kind="stable")
        c[held] = np.add.reduceat(z[order], (np.cumsum(n) - n)[held]) / n[held, None]
    return label


def _join_by_bic(stats: list[np.ndarray], ridge: float, allowed: np.ndarray | None = None) -> list[np.ndarray]:
    """Joins components, best gain first, while the criterion falls: the loss in
    likelihood of one Gaussian for two against the parameters saved.  Of ``stats``,
    sums by component, the first three are those of ``_statistics``; only pairs that
    ``allowed`` has are joined."""
    some = stats[0] > 0
    stats = [a[some].astype(float) for a in stats]
    n, s, q = stats[:3]
    allowed = np.ones((len(n), len(n)), bool) if allowed is None else allowed[np.ix_(some, some)]
    total, d = n.sum(), s.shape[1]
    saved = (1 + 2 * d) * np.log(total)
    means, there = s / n[:, None], np.ones(len(n), bool)

    def cost(a: float, b: np.ndarray, c: np.ndarray) -> float:
        mix = _maximise(np.array([max(a, 1.6)]), b[None], c[None], ridge)
        return a * np.log(mix.variance[0]).sum() - 2 * a * np.log(max(a, 1e-9) / total)

    costs = [cost(*p) for p in zip(n, s, q)]
    gains: dict[tuple[int, int], float] = {}

    def look(i: int) -> None:
        other = there & allowed[i]
        other[i] = False
        at = np.flatnonzero(other)
        for j in at[np.argsort(((means[at] - means[i]) ** 2).sum(1), kind="stable")[:6]].tolist():
            gains[min(i, j), max(i, j)] = costs[i] + costs[j] + saved - cost(n[i] + n[j], s[i] + s[j], q[i] + q[j])

    for i in range(len(n)):
        look(i)
    while gains and (best := max(gains, key=gains.get)) and gains[best] > 0:
        i, j = best
        for a in stats:
            a[i] += a[j]
        there[j] = False
        allowed[i] &= allowed[j]
        allowed[:, i] = allowed[i]
        means[i] = s[i] / n[i]
        costs[i] = cost(n[i], s[i], q[i])
        gains = {k: v for k, v in gains.items() if not {i, j} & set(k)}
        look(i)
    return [a[there] for a in stats]


def _fit(z: np.ndarray, ridge: float, start: int, iterations: int, seed: int) -> tuple[Mixture, float]:
    """Mixture of the rows from ``start`` components, and its criterion."""
    label = _start(z, start, np.random.default_rng(seed))
    n = np.bincount(label)
    order = np.argsort(label, kind="stable")
    first = (np.cumsum(n) - n)[n > 0]
    stats = [n[n > 0].astype(float), np.add.reduceat(z[order], first), np.add.reduceat(z[order] ** 2, first)]
    mix = _maximise(*stats, ridge) if (n > 1.5).any() else _maximise(np.array([float(len(z))]), z.sum(0)[None], (z * z).sum(0)[None], ridge)
    for _ in range(iterations):
        mix = _maximise(*_expect(z, mix)[0], ridge)
    mix = _maximise(*_join_by_bic(_expect(z, mix)[0], ridge), ridge)
    for _ in range(2):
        mix = _maximise(*_expect(z, mix)[0], ridge)
    return mix, len(mix.weight) * (1 + 2 * z.shape[1]) * np.log(len(z)) - 2 * _expect(z, mix)[1]


def fit_sample(z: np.ndarray, ridge: float, start: int = START, iterations: int = ITERATIONS, seed: int = 1) -> Mixture:
    """Mixture of the rows ``z``, its components chosen by the criterion; begun with
    twice as many while more than half are left and the criterion falls."""
    most = max(1, len(z) // 4)
    start = min(start, most)
    mix, bic = _fit(z, ridge, start, iterations, seed)
    while start < most and 2 * len(mix.weight) > start:
        start = min(2 * start, most)
        more, lower = _fit(z, ridge, start, iterations, seed)
        if lower >= bic:
            break
        mix, bic = more, lower
    return mix


def agreement(x: np.ndarray, directions: np.ndarray, sizes: list[int], agree: float = AGREE) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's views that agree with each direction, whether these are
    most: as many as do not, at least, and two where the row has two)."""
    good = np.zeros((len(x), len(directions)), np.int8)
    there = np.zeros((len(x), 1), np.int8)
    at = 0
    for size in sizes:
        a, b = x[:, at : at + size], directions[:, at : at + size]
        at += size
        there[:, 0] += np.abs(a).sum(1) > 0
        good += a @ b.T >= agree
    return good, (good >= np.minimum(2, there)) & (2 * good >= there) & (there > 0)


def shares(x: np.ndarray, z: np.ndarray, mix: Mixture, space: Space, directions: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Posterior of each row over the components; a component has density only where
    most views of a row agree with its direction, so rows of one such component need
    no density worked out."""
    ok = agreement(x, directions, sizes)[1]
    out = ok.astype(float)
    several = ok.sum(1) > 1
    if several.any():
        out[several] = _posterior(np.where(ok[several], mix.robust(z[several], space), -np.inf))[0]
    return out


def likeliest(posterior: np.ndarray) -> np.ndarray:
    """Component of greatest posterior of each row, or -1."""
    return np.where(posterior.any(1), posterior.argmax(1), -1)


def _unit_views(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    out, at = x.copy(), 0
    for size in sizes:
        n = np.linalg.norm(out[:, at : at + size], axis=1, keepdims=True)
        out[:, at : at + size] = np.divide(out[:, at : at + size], n, out=np.zeros_like(out[:, at : at + size]), where=n > 0)
        at += size
    return out


def cohesive(direct: np.ndarray, there: np.ndarray, sizes: list[int], least: float = COHESION) -> np.ndarray:
    """Whether most views of a component's rows point one way: the length of their
    mean.  ``direct`` has the sums of unit views, ``there`` how many rows had each."""
    good, at = np.zeros(len(direct), int), 0
    for v, size in enumerate(sizes):
        length = np.linalg.norm(direct[:, at : at + size], axis=1)
        good += length >= least * np.maximum(there[:, v], 1e-9)
        at += size
    return 2 * good > len(sizes)


def _near(x: np.ndarray, rows: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Which of ``x`` each of ``rows`` agrees with in all views but one, two at least."""
    good, _ = agreement(rows, x, sizes)
    return good >= np.maximum(2, np.minimum(len(sizes) - 1, _present(rows, sizes).sum(1)))[:, None]


def seeds(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Start labels at the densest rows: each row that others agree with, most of them
    first, takes those not taken yet; -1 for the rest.  Finds groups far too small for
    the criterion or a start by distance."""
    many = np.concatenate([_near(x, x[at : at + ROWS], sizes).sum(1) for at in range(0, len(x), ROWS)])
    label, k = np.full(len(x), -1), 0
    for i in np.argsort(-many, kind="stable"):
        if many[i] < LEAST_MEMBERS:
            break
        if label[i] < 0:
            own = np.flatnonzero(_near(x, x[i : i + 1], sizes)[0] & (label < 0))
            if len(own) >= LEAST_MEMBERS:
                label[own], k = k, k + 1
    return label


def fit_seeds(x: np.ndarray, z: np.ndarray, ridge: float, sizes: list[int]) -> Mixture | None:
    """Mixture of a component for each of ``seeds`` and one for all other rows."""
    label = seeds(x, sizes)
    if label.max(initial=-1) < 0:
        return None
    label = np.where(label < 0, label.max() + 1, label)
    n = np.bincount(label)
    order = np.argsort(label, kind="stable")
    first = np.cumsum(n) - n
    return _maximise(n.astype(float), np.add.reduceat(z[order], first), np.add.reduceat(z[order] ** 2, first), ridge)


def _present(x: np.ndarray, sizes: list[int]) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.stack([np.abs(x[:, e - n : e]).sum(1) > 0 for n, e in zip(sizes, ends)], 1).astype(float)


def _alike(directions: np.ndarray, sizes: list[int], agree: float = 0.8) -> np.ndarray:
    """Whether two components agree in all views but one."""
    return agreement(directions, directions, sizes, agree)[0] >= max(1, len(sizes) - 1)


def same_direction(directions: np.ndarray, sizes: list[int], agree: float = 0.8) -> np.ndarray:
    """Group of each component: those that agree in all views but one are one."""
    group = np.arange(len(directions))
    for i, j in zip(*np.nonzero(np.tril(_alike(directions, sizes, agree), -1))):
        group[group == group[i]] = group[j]
    return group


def components(x: np.ndarray, space: Space, ridge: float, sizes: list[int], start: int = START, iterations: int = ITERATIONS, seed: int = 1) -> list[np.ndarray]:
    """Statistics of the cohesive components of the rows ``x`` as sums over the rows
    that each holds: number, ``_statistics``, sums of unit views, number of each view."""
    parts, left, seeded = [], np.ones(len(x), bool), False
    for attempt in itertools.count():  # what a mixture leaves over may hold groups that it missed
        if left.sum() < LEAST_MEMBERS:
            break
        own, here = x[left], _present(x[left], sizes)
        z = space.reduce(own)
        mix = fit_seeds(own, z, ridge, sizes) if seeded else fit_sample(z, ridge, start, iterations, seed=seed + attempt)
        if mix is None:
            break
        cut = [slice(at, at + ROWS) for at in range(0, len(own), ROWS)]
        direct, there = 0, 0
        for c in cut:
            r, _ = _posterior(mix.log_density(z[c]))
            direct, there = direct + r.T @ own[c], there + r.T @ here[c]
        directions = _unit_views(direct, sizes)
        directions[~cohesive(direct, there, sizes)] = 0
        best = np.concatenate([likeliest(shares(own[c], z[c], mix, space, directions, sizes)) for c in cut])
        taken = np.flatnonzero(np.bincount(best[best >= 0], minlength=len(directions)) >= LEAST_MEMBERS)
        if not len(taken):
            if seeded:
                break
            seeded = True  # nothing more by distance and criterion: try the densest rows
            continue
        ok = np.isin(best, taken)
        sums = []
        for c in cut:
            r = (best[c][ok[c], None] == taken).astype(float)
            sums.append([*_statistics(z[c][ok[c]], r), r.T @ own[c][ok[c]], r.T @ here[c][ok[c]]])
        parts.append([sum(p) for p in zip(*sums)])
        left[np.flatnonzero(left)[ok]] = False
    width, views = x.shape[1], len(sizes)
    return _together(parts) if parts else [np.zeros(0), *[np.zeros((0, w)) for w in (space.axes.shape[1], space.axes.shape[1], width, views)]]


def _together(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(p) for p in zip(*parts)]


def groups(bank: DataFrame, views: tuple[str, ...] = VIEWS, key: str = "tuple_id", sample: int = SAMPLE, start: int = START, iterations: int = ITERATIONS) -> DataFrame:
    """(``key``, group_id, log_density) of each record; ``group_id`` is the least id
    of the group's members, null for records that belong to none."""
    kind = bank.schema[key].dataType.simpleString()
    bank = bank.where(F.col(key).isNotNull()).select(key, *views).dropDuplicates([key])
    lengths = [bank.where(F.size(v) > 0).groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect() for v in views]
    if not any(lengths):
        return bank.select(key, F.lit(None).cast(kind).alias("group_id"), F.lit(None).cast("double").alias("log_density"))
    held = [(v, n[0].n) for v, n in zip(views, lengths) if n]
    names, sizes = [v for v, _ in held], [n for _, n in held]

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix([b.column(v) for v in names], sizes)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(key), flat], [key, "x"])

    rows = written(bank.select(key, *names).mapInArrow(unit, f"{key} {kind}, x array<float>"), "views")
    width = sum(sizes)

    def plain(b: pa.RecordBatch) -> np.ndarray:
        return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)

    def moments(b: pa.RecordBatch) -> list[np.ndarray]:
        x = plain(b)
        return [np.array([len(x)], float), x.sum(0), x.T @ x]

    n, s, q = _add_up(rows.select("x"), moments)
    mean = s / n
    cov = q / n - np.outer(mean, mean)
    space = Space.of(mean, cov, sizes, AXES, EXPLAINED)
    ridge = RIDGE * float(space.spread.mean())

    picked = bounded_sample(rows, key, sample).select("x").toPandas()
    stats = components(np.stack(picked.x.to_list()).astype(np.float64), space, ridge, sizes, start, iterations)

    def model(stats: list[np.ndarray]) -> tuple[Mixture, np.ndarray]:
        return _maximise(*stats[:3], ridge), _unit_views(stats[3], sizes)

    def over_all(stats: list[np.ndarray]) -> list[np.ndarray]:
        """Two rounds over all rows; each row counts for the components its views agree with."""
        if len(stats[0]):
            stats = _join_by_bic(stats, ridge, _alike(_unit_views(stats[3], sizes), sizes))
        for _ in range(2):
            if not len(stats[0]):
                break
            mix, directions = model(stats)

            def expect(b: pa.RecordBatch) -> list[np.ndarray]:
                x = plain(b)
                z = space.reduce(x)
                r = shares(x, z, mix, space, directions, sizes)
                inside = r.any(1)
                r = r[inside]
                return [*_statistics(z[inside], r), r.T @ x[inside], r.T @ _present(x[inside], sizes)]

            stats = _add_up(rows.select("x"), expect)
            keep = (stats[0] > 1.5) & cohesive(stats[3], stats[4], sizes)
            stats = [a[keep] for a in stats]
        return stats

    def left_over(stats: list[np.ndarray]) -> DataFrame:
        """The rows with a view that no component holds."""
        directions = _unit_views(stats[3], sizes)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = plain(b)
                there = _present(x, sizes).any(1)
                yield b.filter(pa.array(there & ~agreement(x, directions, sizes)[1].any(1) if len(directions) else there))

        return written(rows.mapInArrow(cut, rows.schema), "left-over")

    def from_blocks(rest: DataFrame, n: int, turn: int) -> list[np.ndarray]:
        """Statistics of the components found in blocks of ``rest``: the rows nearest to
        one of some of them, salted where they are more than a block."""
        cells = -(-2 * n // sample) if n > sample else 1
        pivots = np.stack(bounded_sample(rest, key, cells, f"pivots {turn}").select("x").toPandas().x.to_list()).astype(np.float64)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.append_column("cell", pa.array((plain(b) @ pivots.T).argmax(1).astype(np.int32)))

        def fit(t: pa.Table) -> pa.Table:
            x = plain(t.combine_chunks().to_batches()[0])
            return pa.table({"b": pa.array([_pack(components(x, space, ridge, sizes, start, iterations, seed=2 * turn + 1))], pa.binary())})

        celled = written(rest.mapInArrow(near, f"{key} {kind}, x array<float>, cell int"), "cells")
        many = celled.groupBy("cell").agg(F.ceil(F.count("*") / sample).alias("salts"))
        salted = celled.join(F.broadcast(many), "cell").withColumn("salt", F.pmod(F.xxhash64(F.lit(turn), key), F.col("salts")))
        found = salted.select("x", "cell", "salt").groupBy("cell", "salt").applyInArrow(fit, "b binary")
        return _together([_unpack(bytes(r.b)) for r in found.collect()])

    stats = over_all(stats)
    rest = left_over(stats)
    least_left, quiet = rest.count(), 0
    for turn in itertools.count(1):
        if least_left < LEAST_MEMBERS:
            break
        new = from_blocks(rest, least_left, turn)
        if len(new[0]):
            grown = over_all(_together([stats, new]))
            less = left_over(grown)
            n_less = less.count()
        if len(new[0]) and n_less < least_left:
            stats, rest, least_left, quiet = grown, less, n_less, 0
            continue
        quiet += 1
        if least_left <= sample or quiet >= QUIET:
            break
    if not len(stats[0]):
        return rows.select(key, F.lit(None).cast(kind).alias("group_id"), F.lit(None).cast("double").alias("log_density"))
    mix, directions = model(stats)
    group = same_direction(directions, sizes)
    last = (mix, directions, group)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix, directions, group = last
        for b in batches:
            x = plain(b)
            z = space.reduce(x)
            best = likeliest(shares(x, z, mix, space, directions, sizes))
            g = pa.array(np.where(best >= 0, group[best], -1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(key), g, pa.array(mix.own(z, best))], [key, "g", "log_density"])

    assigned = written(rows.mapInArrow(assign, f"{key} {kind}, g int, log_density double"), "assigned")
    least = assigned.where("g >= 0").groupBy("g").agg(F.min(key).alias("group_id"), F.count("*").alias("n")).where(F.col("n") >= LEAST_MEMBERS).drop("n")
    return assigned.join(F.broadcast(least), "g", "left").select(key, "group_id", "log_density")


def described(members: DataFrame, key: str = "tuple_id", typical: int = 5) -> DataFrame:
    """(group_id, size, typical): each group's size and its members of highest density."""
    inside = members.where("group_id is not null")
    sizes = inside.groupBy("group_id").agg(F.count("*").alias("size"))
    # the best of each task first, so that no task holds a whole group
    spread = inside.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    from pyspark.sql import Window

    order = [F.desc("log_density"), F.asc(key)]
    near = spread.withColumn("_r", F.row_number().over(Window.partitionBy("group_id", "_s").orderBy(*order))).where(F.col("_r") <= typical)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("group_id").orderBy(*order))).where(F.col("_r") <= typical)
    lists = best.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda x: x[key]).alias("typical"))
    return sizes.join(lists, "group_id")
