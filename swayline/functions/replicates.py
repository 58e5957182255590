"""Drawn replicates of a mixed model, one entity at a time: outcomes, modes and Laplace values at every replicate's own parameters.

Nothing of the size of entities times replicates is kept: a pass draws an entity's outcomes anew from hashed
keys, finds its modes from the cells themselves, and adds what it finds to the sums of its task.
"""

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from swayline.functions.draws import drawn, hashed_on
from swayline.functions.jets import Jet, of_two
from swayline.functions.laplace import Batch, _sent

#: Columns of a cell that is ready for a pass: what an entity's draws start from stands in the entity's first cell.
COLUMNS = ("entity", "block", "blocks", "place", "m", "x", "n", "seeds", "slope_draws", "level_draws")


def whole_entities(batches):
    """Arrow tables of one (entity, block) each, from batches sorted by both; a group may cross batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        entity, block = batch.column("entity").to_pylist(), batch.column("block").to_pylist()
        keys = list(zip(entity, block))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and keys[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield pa.Table.from_batches(held)


def _rates(eta):
    """Chances of log odds, in their place."""
    np.negative(eta, out=eta)
    np.exp(eta, out=eta)
    eta += 1
    return np.reciprocal(eta, out=eta)


class Drawn:
    """One entity's drawn outcomes in some replicates (C, F), and their modes at the replicates' own parameters.

    The outcomes enter through their sums by place, with and without the predictor; the rest of the
    log-likelihood is summed over the cells by matrix products.
    """

    def __init__(self, table, numbers, truth, layout):
        def column(name):
            return table.column(name).to_numpy()

        blocks, block = table.column("blocks")[0].as_py(), table.column("block")[0].as_py()
        self.fits, self.layout = numbers[numbers % blocks == block], layout
        F = len(self.fits)
        order = np.argsort(column("place"), kind="stable")
        place, x, n = column("place")[order], column("x")[order], column("n")[order]
        self.places, self.first, self.which = np.unique(place, return_index=True, return_inverse=True)
        self.x, self.m = x[:, None], float(column("m")[0])
        self.weights = n * x ** np.arange(5)[:, None]  # (powers of the predictor, C)
        seeds, *draws = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("seeds", "level_draws", "slope_draws"))
        self.draws = [d if len(d) else np.zeros(F) for d in draws]
        keys = hashed_on(seeds.view(np.uint64), self.places.astype(np.int32)[:, None])
        keys = hashed_on(keys[self.which], self.x)
        # the truth: the parameters that are simulated, with the entity's drawn level and slope
        fixed_a, fixed_b, s0, s1 = self.at(truth[None])
        p = _rates((fixed_a + s0 * self.draws[0])[self.which] + (fixed_b + s1 * self.draws[1]) * self.x)
        wins = drawn(np.repeat(n, F), p.ravel(), keys.ravel()).reshape(p.shape)
        self.wins, self.moved = self._total(wins), self._total(wins * self.x)

    def at(self, points):
        """Fixed part of the level of each place (places, F), slope (F,) and spreads (F,) at parameters (F, P)."""
        def value(name):
            at = self.layout.at(name)
            return np.zeros(len(points)) if at is None else points[:, at]

        offsets = np.stack([value(f"group{g}") for g in self.places.tolist()])
        return value("intercept") + value("m") * self.m + offsets, value("x"), np.abs(value("sd_intercept")), np.abs(value("sd_slope"))

    def _total(self, values):
        return np.add.reduceat(values, self.first, axis=0)

    def solve(self, points):
        """``Modes`` at the points, and which replicates' modes are found."""
        fixed_a, fixed_b, s0, s1 = self.at(points)
        u0, u1 = (np.broadcast_to(d, fixed_b.shape) for d in self.draws)
        if self.layout.at("sd_intercept") is None:
            u0 = np.zeros_like(fixed_b)
        if self.layout.at("sd_slope") is None:
            u1 = np.zeros_like(fixed_b)
        wins, moved, weights = self.wins.sum(0), self.moved.sum(0), self.weights
        for _ in range(60):
            p = _rates((fixed_a + s0 * u0)[self.which] + (fixed_b + s1 * u1) * self.x)
            (n_p, nx_p), (w, wx, wxx) = weights[:2] @ p, weights[:3] @ (p * (1 - p))
            r0, r1 = s0 * (wins - n_p) - u0, s1 * (moved - nx_p) - u1
            h00, h01, h11 = 1 + s0 * s0 * w, s0 * s1 * wx, 1 + s1 * s1 * wxx
            det = h00 * h11 - h01 * h01
            d0, d1 = np.clip((h11 * r0 - h01 * r1) / det, -2, 2), np.clip((h00 * r1 - h01 * r0) / det, -2, 2)
            u0, u1 = u0 + d0, u1 + d1
            far = np.maximum(np.abs(d0), np.abs(d1))
            if far.max() < 1e-7:  # the next step would be of its square
                break
        return Modes(self, points, (u0, u1), (s0, s1), fixed_a + s0 * u0, fixed_b + s1 * u1), far < 1e-7

    def derivatives(self, a, b):
        """Derivatives of the log-likelihood of each place (F, places) at levels (places, F) and slopes (F,), by order in both."""
        eta = a[self.which] + b * self.x
        odds = np.exp(-np.abs(eta))
        p = np.where(eta > 0, 1, odds) / (1 + odds)
        w = p * (1 - p)
        by_order = [np.maximum(eta, 0) + np.log1p(odds), p, w, w * (1 - 2 * p), w * (1 - 6 * w)]
        ends = [*self.first[1:].tolist(), len(eta)]
        table = {}
        for order, values in enumerate(by_order):
            sums = np.stack([self.weights[: order + 1, lo:hi] @ values[lo:hi] for lo, hi in zip(self.first.tolist(), ends)], 2)
            for j, total in enumerate(sums):
                table[order - j, j] = -total
        table[0, 0] += (a * self.wins + b * self.moved).T
        table[1, 0] += self.wins.T
        table[0, 1] += self.moved.T
        return table


class Modes(Batch):
    """An entity's replicates at their modes, where its sums are exact: a ``Batch`` that needs no search."""

    def __init__(self, entity, points, modes, spreads, a, b):
        k, F = a.shape
        self.entity, self.layout, self.order, self.high, self.count = entity, entity.layout, 4, 1.0, F
        self.m, self.owner, self.group = np.full(F, entity.m), np.repeat(np.arange(F), k), np.tile(entity.places, F)
        self.points = points[:, None, :]
        self.u0, self.u1, self.s0, self.s1 = (v[:, None] for v in (*modes, *spreads))
        self.sn, self.w = np.zeros((F, 1)), np.zeros((F * k, 1))
        self.a, self.b = a.T.reshape(-1, 1), np.repeat(b, k)[:, None]
        self.a0, self.b0 = self.a, self.b
        self.table = entity.derivatives(a, b)

    def _table(self, at, A, B):
        return self.table

    def _only(self, at, name, order):
        """Value as a jet, as of ``_jets``, where the spread ``name`` alone is there: it moves the derivatives of ``order``."""
        (F, k), slopes = at.shape, name == "sd_slope"
        own = self.s1 * self.u1 if slopes else self.s0 * self.u0
        level, slope = Jet.constant(np.zeros((F, k)) - (0 if slopes else own), k + 2), Jet.variable(np.zeros((F, 1)) - (own if slopes else 0), k, k + 2)
        level.g[np.arange(k), :, np.arange(k)] = 1.0
        s, u = Jet.variable((self.s1 if slopes else self.s0)[:, 0], k + 1, k + 2), Jet.constant((self.u1 if slopes else self.u0)[:, 0], k + 2)
        i, j = order
        squared = s * s

        def at_mode():
            moved = (s * u).spread()
            a, b = (level, slope + moved) if slopes else (level + moved, slope)
            return a, b, 1 - squared * of_two(self.table, 2 * i, 2 * j, a, b).sum(1)

        for _ in range(2):
            a, b, curvature = at_mode()
            u = u + (s * of_two(self.table, i, j, a, b).sum(1) - u) * curvature.reciprocal()
        a, b, curvature = at_mode()
        return of_two(self.table, 0, 0, a, b).sum(1) - 0.5 * (u * u) - 0.5 * curvature.log()

    def derivatives(self):
        """As of a ``Batch``; the chain to the parameters is the same for all replicates."""
        mine, at = next(self._alike())
        spreads = self._spreads()
        if len(spreads) == 1:
            value = self._only(at, spreads[0], (0, 1) if spreads[0] == "sd_slope" else (1, 0))
        else:
            value, *_ = self._jets(mine, at)
        chain = self._chain(mine[:1], at[:1])[0, :, : self.points.shape[2]]
        return value.v, value.g.T @ chain, value.h.reshape(-1, self.count).T @ np.kron(chain, chain)


def replicate_deriver(theta, numbers, truth, layout):
    """mapInArrow function: per task and replicate, the value, gradient and Hessian at its own row of ``theta``."""
    fits, P = theta.shape

    def run(batches):
        sums, reach = np.full((fits, 1 + P + P * P), np.nan), np.zeros(fits)
        for table in whole_entities(batches):
            mine = Drawn(table, numbers, truth, layout)
            if not len(mine.fits):
                continue
            solved, found = mine.solve(theta[mine.fits])
            value, gradient, hessian = solved.derivatives()
            sums[mine.fits] = np.nan_to_num(sums[mine.fits]) + np.concatenate((value[:, None], gradient, hessian), axis=1)
            reach[mine.fits] = np.maximum(reach[mine.fits], np.where(found, 0.0, np.inf))
        yield _sent(np.arange(fits), sums, reach)

    return run


def replicate_slopes(theta, numbers, truth, layout, x_scale):
    """mapInArrow function: per entity and block the total slopes of the replicates, on the predictor's own scale."""
    schema = pa.schema([("entity", pa.string()), ("slopes", pa.list_(pa.float64()))])

    def run(batches):
        for table in whole_entities(batches):
            mine = Drawn(table, numbers, truth, layout)
            if not len(mine.fits):
                continue
            solved, _ = mine.solve(theta[mine.fits])
            total = solved.b.reshape(len(mine.fits), -1)[:, 0]
            yield pa.RecordBatch.from_arrays([table.column("entity").combine_chunks()[:1], pa.array([total / x_scale], pa.list_(pa.float64()))], schema=schema)

    return run


def summariser(levels):
    """applyInArrow function: mean, standard error, interval and number of one entity's slopes."""
    def run(table):
        slopes = table.column("slopes").combine_chunks().flatten().to_numpy()
        low, high = np.quantile(slopes, levels)
        n = len(slopes)
        return pa.table({
            "entity": table.column("entity").slice(0, 1), "mean_boot": [float(slopes.mean())],
            "se_boot": pa.array([float(slopes.std(ddof=1)) if n > 1 else None], pa.float64()),
            "ci_lower": [float(low)], "ci_upper": [float(high)], "n_boot": pa.array([n], pa.int64())})

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
