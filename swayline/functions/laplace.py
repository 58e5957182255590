"""Batch arithmetic of the mixed model: modes and Laplace values of many entities at once.

The rows of an (entity, group) pair enter only through eta = a + b * x, so Spark sums, per
pair, the log-likelihood and its derivatives in (a, b) up to fourth order around a centre.
Everything here works on those sums, one Arrow batch of entities at a time.

A parameter point is a vector laid out by ``Layout``; ``points`` has shape (fits, K, P).
"""

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from swayline.functions.jets import Jet, of_two

# order of the sums per pair; the digits are the powers of a and b
SUMS = ["00", "10", "01", "20", "11", "02", "30", "21", "12", "03", "40", "31", "22", "13", "04"]
WIDTH = len(SUMS) + 3  # n, a, b come first
BLOCK = 300_000
NEAR_A, NEAR_B = 0.7, 0.5
LONGEST = 1.5


@dataclass(frozen=True)
class Layout:
    """Where each parameter sits; absent parameters are None."""

    names: tuple
    groups: int

    def at(self, name):
        return self.names.index(name) if name in self.names else None

    def group_columns(self):
        return [self.at(f"group{g}") for g in range(self.groups)]

    def by_entity(self):
        """Whether entities share nothing but parameters, so that each one's derivatives stand alone."""
        return self.at("sd_group") is None and self.at("sd_nested") is None


def _unpack(batch):
    fit = batch.column("fit").to_numpy(zero_copy_only=False)
    centre = batch.column("m").to_numpy(zero_copy_only=False)
    places = batch.column("places")
    sizes = np.diff(places.offsets.to_numpy())
    group = places.flatten().to_numpy(zero_copy_only=False)
    sums = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
    owner = np.repeat(np.arange(len(fit)), sizes)
    return fit, centre, owner, group, sums


def _add(values, owner, count):
    """Sum rows of ``values`` (R, K) per owner."""
    starts = np.searchsorted(owner, np.arange(count))
    return np.add.reduceat(values, starts, axis=0)


class Batch:
    """One batch at K parameter points: solves for the modes on construction, from ``start`` (u0, u1) if given."""

    def __init__(self, unpacked, fit_points, group_modes, layout, order, start=None):
        self.fit, self.m, self.owner, self.group, self.sums = unpacked
        self.count = len(self.fit)
        self.layout = layout
        self.points = fit_points[self.fit]  # (E, K, P)
        self.order = order
        rows = self.owner
        zero = np.zeros(self.points.shape[:2])
        self.s0, self.s1, self.sn, self.sg = (
            np.abs(self._get(name, zero)) for name in ("sd_intercept", "sd_slope", "sd_nested", "sd_group")
        )
        fixed_a = self._get("intercept", zero) + self._get("m", zero) * self.m[:, None]
        self.fixed_a = fixed_a[rows]
        columns = layout.group_columns()
        if any(c is not None for c in columns):
            table = np.stack([self.points[:, :, c] if c is not None else zero for c in columns], axis=2)
            self.fixed_a = self.fixed_a + table[rows, :, self.group]
        if group_modes is not None:
            self.fixed_a = self.fixed_a + self.sg[rows] * group_modes[self.fit[rows], :, self.group]
        self.fixed_b = self._get("x", zero)
        self.c = [self.sums[:, 3 + i][:, None] for i in range(len(SUMS))]
        self.a0, self.b0 = self.sums[:, 1][:, None], self.sums[:, 2][:, None]
        shape = self.points.shape[:2]
        self.u0, self.u1 = (np.zeros(shape), np.zeros(shape)) if start is None else start
        self.w = np.zeros((len(rows), shape[1]))
        self.high = 0.0
        self.settled = self._solve()  # second order alone is concave: a safe start for the fourth-order solve
        if order > 2:
            start = self.u0, self.u1, self.w
            self.high = 1.0
            settled = self._solve()
            # far from the centre the fourth-order sums can bend upwards or throw the steps back and forth;
            # there the second-order ones are taken, which do neither
            firsts = np.searchsorted(rows, np.arange(self.count))
            far = (np.abs(self.a - self.a0) > NEAR_A) | (np.abs(self.b - self.b0) > NEAR_B)
            far = np.logical_or.reduceat(far, firsts, axis=0) | ~settled
            if far.any():
                self.u0, self.u1 = (np.where(far, s, u) for s, u in zip(start, (self.u0, self.u1)))
                self.w = np.where(far[rows], start[2], self.w)
                self.high = 1.0 - far[rows]
                self.settled = self._solve()
            else:
                self.settled = settled

    def _get(self, name, zero):
        at = self.layout.at(name)
        return zero if at is None else self.points[:, :, at]

    def _place(self):
        rows = self.owner
        a = self.fixed_a + (self.s0 * self.u0)[rows] + self.sn[rows] * self.w
        b = (self.fixed_b + self.s1 * self.u1)[rows]
        return a, b

    def _slopes(self, a, b):
        """Derivatives of the pair's log-likelihood at (a, b): first and second."""
        c, A, B = self.c, a - self.a0, b - self.b0
        up = self.high
        ga = c[1] + c[3] * A + c[4] * B
        gb = c[2] + c[4] * A + c[5] * B
        haa, hab, hbb = c[3] + 0 * A, c[4] + 0 * A, c[5] + 0 * A
        if self.order > 2:
            AA, AB, BB = A * A, A * B, B * B
            ga = ga + up * (c[6] * AA + 2 * c[7] * AB + c[8] * BB) / 2 + up * (
                c[10] * AA * A + 3 * c[11] * AA * B + 3 * c[12] * A * BB + c[13] * BB * B) / 6
            gb = gb + up * (c[7] * AA + 2 * c[8] * AB + c[9] * BB) / 2 + up * (
                c[11] * AA * A + 3 * c[12] * AA * B + 3 * c[13] * A * BB + c[14] * BB * B) / 6
            haa = haa + up * (c[6] * A + c[7] * B + (c[10] * AA + 2 * c[11] * AB + c[12] * BB) / 2)
            hab = hab + up * (c[7] * A + c[8] * B + (c[11] * AA + 2 * c[12] * AB + c[13] * BB) / 2)
            hbb = hbb + up * (c[8] * A + c[9] * B + (c[12] * AA + 2 * c[13] * AB + c[14] * BB) / 2)
            haa = np.minimum(haa, 0.1 * c[3])  # keep the curvature negative far from the centre
            hbb = np.minimum(hbb, 0.1 * c[5])
        return ga, gb, haa, hab, hbb

    def _value(self, a, b):
        c, A, B = self.c, a - self.a0, b - self.b0
        value = c[0] + c[1] * A + c[2] * B + (c[3] * A * A + 2 * c[4] * A * B + c[5] * B * B) / 2
        if self.order > 2:
            value = value + self.high * (c[6] * A**3 + 3 * c[7] * A * A * B + 3 * c[8] * A * B * B + c[9] * B**3) / 6
            value = value + self.high * (c[10] * A**4 + 4 * c[11] * A**3 * B + 6 * c[12] * A * A * B * B
                             + 4 * c[13] * A * B**3 + c[14] * B**4) / 24
        return value

    def _solve(self):
        for _ in range(60):
            a, b = self._place()
            self._curvature(a, b)
            r0 = self.s0 * _add(self.ga, self.owner, self.count) - self.u0
            r1 = self.s1 * _add(self.gb, self.owner, self.count) - self.u1
            rw = self.sn[self.owner] * self.ga - self.w
            r0 = r0 - _add(self.h0w * rw / self.hww, self.owner, self.count)
            r1 = r1 - _add(self.h1w * rw / self.hww, self.owner, self.count)
            d0 = np.clip((self.h11 * r0 - self.h01 * r1) / self.det, -2, 2)
            d1 = np.clip((self.h00 * r1 - self.h01 * r0) / self.det, -2, 2)
            dw = (rw - self.h0w * d0[self.owner] - self.h1w * d1[self.owner]) / self.hww
            self.u0, self.u1, self.w = self.u0 + d0, self.u1 + d1, self.w + np.clip(dw, -2, 2)
            if max(np.max(np.abs(d0)), np.max(np.abs(d1)), np.max(np.abs(dw))) < 1e-11:
                break
        self.a, self.b = self._place()
        self._curvature(self.a, self.b)
        last = np.maximum.reduceat(np.abs(dw), np.searchsorted(self.owner, np.arange(self.count)), axis=0)
        return np.maximum(np.maximum(np.abs(d0), np.abs(d1)), last) < 1e-7

    def _curvature(self, a, b):
        """Negative Hessian in (u0, u1) after the pair intercepts w are eliminated."""
        rows = self.owner
        self.ga, self.gb, self.haa, self.hab, hbb = self._slopes(a, b)
        s0, s1, sn = self.s0[rows], self.s1[rows], self.sn[rows]
        self.hww = 1 - sn * sn * self.haa
        self.h0w, self.h1w = -s0 * sn * self.haa, -s1 * sn * self.hab
        self.h00 = 1 + _add(-s0 * s0 * self.haa - self.h0w**2 / self.hww, rows, self.count)
        self.h01 = _add(-s0 * s1 * self.hab - self.h0w * self.h1w / self.hww, rows, self.count)
        self.h11 = 1 + _add(-s1 * s1 * hbb - self.h1w**2 / self.hww, rows, self.count)
        self.det = np.maximum(self.h00 * self.h11 - self.h01**2, 1e-12)

    def reach(self):
        """Per entity: how far the first point's modes lie from the centre of the sums; infinite where they are not found."""
        far = np.maximum(np.abs(self.a - self.a0), 2 * np.abs(self.b - self.b0))[:, 0]
        far = np.maximum.reduceat(far, np.searchsorted(self.owner, np.arange(self.count)))
        return np.where(self.settled[:, 0], far, np.inf)

    def value(self):
        """Laplace value per entity (E, K); the group block is added by the caller."""
        inner = self._value(self.a, self.b) - self.w**2 / 2 - np.log(self.hww) / 2
        per_entity = _add(inner, self.owner, self.count)
        return per_entity - (self.u0**2 + self.u1**2) / 2 - np.log(self.det) / 2

    def group_block(self, fit):
        """Gradient (K, G) and negative Hessian (K, G, G) in the group modes, entities eliminated."""
        mine = np.flatnonzero(self.fit[self.owner] == fit)
        rows, group, G = self.owner[mine], self.group[mine], self.layout.groups
        K = self.points.shape[1]
        sg, haa, hww = self.sg[rows], self.haa[mine], self.hww[mine]
        hvw = -sg * self.sn[rows] * haa
        direct = -sg * sg * haa - hvw**2 / hww
        c0 = -sg * self.s0[rows] * haa - hvw * self.h0w[mine] / hww
        c1 = -sg * self.s1[rows] * self.hab[mine] - hvw * self.h1w[mine] / hww
        gradient, hessian = np.zeros((K, G)), np.zeros((K, G, G))
        dense0, dense1 = np.zeros((self.count, K, G)), np.zeros((self.count, K, G))
        dense0[rows, :, group], dense1[rows, :, group] = c0, c1
        for g in np.unique(group):
            at = group == g
            gradient[:, g] = np.sum((sg * self.ga[mine])[at], axis=0)
            hessian[:, g, g] = np.sum(direct[at], axis=0)
        left0 = (self.h11 / self.det)[:, :, None] * dense0 - (self.h01 / self.det)[:, :, None] * dense1
        left1 = (self.h00 / self.det)[:, :, None] * dense1 - (self.h01 / self.det)[:, :, None] * dense0
        hessian -= np.einsum("ekg,ekh->kgh", left0, dense0) + np.einsum("ekg,ekh->kgh", left1, dense1)
        return gradient, hessian


    def derivatives(self):
        """Per entity, at the first point: value (E,), gradient (E, P) and Hessian (E, P, P) in the parameters.

        An entity's value depends on a few numbers only: the level of each of its pairs, the slope and the
        spreads. The modes are followed by two Newton steps on jets in these (one makes the modes' first
        derivatives exact, two their second ones); the chain rule brings the result to the parameters.
        """
        P = self.points.shape[2]
        out = np.zeros(self.count), np.zeros((self.count, P)), np.zeros((self.count, P, P))
        for mine, at in self._alike():
            value, *_ = self._jets(mine, at)
            chain = self._chain(mine, at)[:, :, :P]
            for part, made in zip(out, (value.v, np.einsum("edp,de->ep", chain, value.g), np.swapaxes(chain, 1, 2) @ np.moveaxis(value.h, -1, 0) @ chain)):
                part[mine] = made
        return out

    def group_jets(self, fit):
        """Sums over a fit's entities of their value, its gradient (G) and negative Hessian (pairs of groups) in the group levels.

        Entities' modes follow. Each is given with first and second derivatives in the parameters and the group
        levels (N of them), so rows are (1 + G + G(G + 1) / 2, 1 + N + N * N).
        """
        G, P = self.layout.groups, self.points.shape[2]
        N, slot = P + G, group_slots(G)
        out = np.zeros((1 + G + G * (G + 1) // 2, 1 + N + N * N))

        def add(to, jet, chain):
            each = np.concatenate((jet.v[:, None], np.einsum("edn,de->en", chain, jet.g),
                                   (np.swapaxes(chain, 1, 2) @ np.moveaxis(jet.h, -1, 0) @ chain).reshape(len(jet.v), -1)), 1)
            for k in np.unique(to):
                out[k] += each[to == k].sum(0)

        for mine, at in self._alike(self.fit == fit):
            value, up, down, cross = self._jets(mine, at)
            chain, group = self._chain(mine, at), self.group[at]
            add(np.zeros(len(mine), int), value, chain)
            h00, h01, h11, scale = cross["h00"], cross["h01"], cross["h11"], cross["scale"]
            c0, c1, direct = down
            for p in range(at.shape[1]):
                add(1 + group[:, p], up[:, p], chain)
                for q in range(p, at.shape[1]):
                    left0, left1 = (h11 * c0[:, p] - h01 * c1[:, p]) * scale, (h00 * c1[:, p] - h01 * c0[:, p]) * scale
                    both = -(left0 * c0[:, q] + left1 * c1[:, q])
                    add(slot[group[:, p], group[:, q]], direct[:, p] + both if p == q else both, chain)
        return out

    def _alike(self, which=None):
        """Entities with equally many pairs, and their pairs' rows (E, pairs)."""
        sizes = np.bincount(self.owner, minlength=self.count)
        starts = np.cumsum(sizes) - sizes
        for pairs in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == pairs if which is None else (sizes == pairs) & which)
            if len(mine):
                yield mine, starts[mine, None] + np.arange(pairs)

    def _spreads(self):
        return [name for name in ("sd_intercept", "sd_slope", "sd_nested") if self.layout.at(name) is not None]

    def _table(self, at, A, B):
        """Derivatives of the expansions of pairs at the distance (A, B) from their centres, by order in a and b."""
        high = np.broadcast_to(self.high, self.a.shape)[at, 0]
        table = {}
        for i in range(5):
            for j in range(5 - i):  # derivative (i, j) of the expansion at (A, B)
                total = 0 * A
                for k in range(5 - i - j):
                    for m in range(5 - i - j - k):
                        c = self.sums[at, 3 + SUMS.index(f"{i + k}{j + m}")]
                        if i + k + j + m > 2:
                            c = c * high if self.order > 2 else 0 * c
                        total = total + c * A**k * B**m / (math.factorial(k) * math.factorial(m))
                table[i, j] = total
        return table

    def _jets(self, mine, at):
        """Value of each entity as a jet in its numbers, and what the group levels need: gradient, coupling, curvature."""
        E, pairs = at.shape
        spreads, nested = self._spreads(), self.layout.at("sd_nested") is not None
        d = pairs + 1 + len(spreads)
        A, B = (self.a - self.a0)[at, 0], (self.b - self.b0)[at, 0]
        table = self._table(at, A, B)
        own = (self.s0 * self.u0)[mine] + self.sn[mine] * self.w[at, 0]
        level = Jet.constant(A - own, d)  # less the entity's own part: added as a jet below
        level.g[np.arange(pairs), :, np.arange(pairs)] = 1.0
        slope = Jet.variable(B - (self.s1 * self.u1)[mine], pairs, d)
        s0, s1, sn = (Jet.variable(s[mine, 0], pairs + 1 + spreads.index(n), d) if n in spreads else Jet.constant(np.zeros(E), d)
                      for n, s in (("sd_intercept", self.s0), ("sd_slope", self.s1), ("sd_nested", self.sn)))
        u0, u1 = (Jet.constant(x[mine, 0], d) for x in (self.u0, self.u1))
        w, sn = Jet.constant(self.w[at, 0], d), sn.spread()

        def placed():
            a, b = level + (s0 * u0).spread(), slope + (s1 * u1).spread()
            return (a + sn * w if nested else a), b

        def curvature(a, b):
            haa, hab, hbb = (of_two(table, i, 2 - i, a, b) for i in (2, 1, 0))
            h = {"haa": haa, "hab": hab}
            h00, h01, h11 = -(s0 * s0 * haa.sum(1)), -(s0 * s1 * hab.sum(1)), -(s1 * s1 * hbb.sum(1))
            if nested:
                hww = 1 - sn * sn * haa
                h |= {"hww": hww, "over": hww.reciprocal(), "h0w": -(s0.spread() * sn * haa), "h1w": -(s1.spread() * sn * hab)}
                h00 = h00 - (h["h0w"] * h["h0w"] * h["over"]).sum(1)
                h01 = h01 - (h["h0w"] * h["h1w"] * h["over"]).sum(1)
                h11 = h11 - (h["h1w"] * h["h1w"] * h["over"]).sum(1)
            h["h00"], h["h01"], h["h11"] = 1 + h00, h01, 1 + h11
            h["det"] = h["h00"] * h["h11"] - h01 * h01
            h["scale"] = h["det"].reciprocal()
            return h

        for _ in range(2):
            a, b = placed()
            ga, gb, h = of_two(table, 1, 0, a, b), of_two(table, 0, 1, a, b), curvature(a, b)
            r0, r1 = s0 * ga.sum(1) - u0, s1 * gb.sum(1) - u1
            if nested:
                rw = sn * ga - w
                r0, r1 = r0 - (h["h0w"] * rw * h["over"]).sum(1), r1 - (h["h1w"] * rw * h["over"]).sum(1)
            d0, d1 = (h["h11"] * r0 - h["h01"] * r1) * h["scale"], (h["h00"] * r1 - h["h01"] * r0) * h["scale"]
            if nested:
                w = w + (rw - h["h0w"] * d0.spread() - h["h1w"] * d1.spread()) * h["over"]
            u0, u1 = u0 + d0, u1 + d1
        a, b = placed()
        h = curvature(a, b)
        value = of_two(table, 0, 0, a, b).sum(1) - 0.5 * (u0 * u0 + u1 * u1) - 0.5 * h["det"].log()
        if nested:
            value = value - 0.5 * (w * w + h["hww"].log()).sum(1)
        if self.layout.at("sd_group") is None:
            return value, None, None, None
        c0, c1, direct = -(s0.spread() * h["haa"]), -(s1.spread() * h["hab"]), -h["haa"]
        if nested:
            hvw = -(sn * h["haa"])
            c0, c1, direct = c0 - hvw * h["h0w"] * h["over"], c1 - hvw * h["h1w"] * h["over"], direct - hvw * hvw * h["over"]
        return value, of_two(table, 1, 0, a, b), (c0, c1, direct), h

    def _chain(self, mine, at):
        """Derivatives of the entities' numbers (E, d, N) in the parameters and, behind them, the group levels."""
        E, pairs = at.shape
        P, spreads = self.points.shape[2], self._spreads()
        chain = np.zeros((E, pairs + 1 + len(spreads), P + self.layout.groups))
        chain[:, :pairs, self.layout.at("intercept")] = 1.0
        if self.layout.at("m") is not None:
            chain[:, :pairs, self.layout.at("m")] = self.m[mine, None]
        for g, column in enumerate(self.layout.group_columns()):
            of_group = self.group[at] == g
            chain[:, :pairs, P + g] = of_group
            if column is not None:
                chain[:, :pairs, column] = of_group
        chain[:, pairs, self.layout.at("x")] = 1.0
        for i, name in enumerate(spreads):
            chain[:, pairs + 1 + i, self.layout.at(name)] = 1.0
        return chain


def group_slots(G):
    """Rows (G, G) of ``Batch.group_jets`` that hold the curvature of two groups."""
    slot = np.zeros((G, G), int)
    upper = np.triu_indices(G)
    slot[upper] = 1 + G + np.arange(len(upper[0]))
    return np.maximum(slot, slot.T)


def _sent(fits, sums, reach):
    """One row per position of each fit's sums, and the reach at position -1."""
    used = np.flatnonzero(np.isfinite(sums[:, 0]))
    size = sums.shape[1]
    return pa.RecordBatch.from_pydict({
        "fit": pa.array(np.repeat(fits[used], size + 1), pa.int32()),
        "place": pa.array(np.tile(np.arange(-1, size), len(used)), pa.int32()),
        "value": pa.array(np.concatenate((reach[used, None], sums[used]), axis=1).ravel()),
    })


def deriver(theta, layout, order):
    """mapInArrow function: per task and fit, the value, gradient and Hessian at ``theta`` (fits, P)."""
    fits, P = theta.shape

    def run(batches):
        sums, reach = np.full((fits, 1 + P + P * P), np.nan), np.zeros(fits)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            solved = Batch(_unpack(batch), theta[:, None, :], None, layout, order)
            value, gradient, hessian = solved.derivatives()
            each = np.concatenate((value[:, None], gradient, hessian.reshape(len(value), -1)), axis=1)
            by_fit = np.argsort(solved.fit, kind="stable")
            used, first = np.unique(solved.fit[by_fit], return_index=True)
            sums[used] = np.nan_to_num(sums[used]) + np.add.reduceat(each[by_fit], first, axis=0)
            np.maximum.at(reach, solved.fit, solved.reach())
        yield _sent(np.arange(fits), sums, reach)

    return run


def group_deriver(theta, modes, layout, order):
    """mapInArrow function: per task and fit, ``Batch.group_jets`` at ``theta`` (fits, P) and the group modes (fits, 1, G)."""
    fits, P = theta.shape
    G = layout.groups
    N = P + G
    size = (1 + G + G * (G + 1) // 2) * (1 + N + N * N)

    def run(batches):
        sums, reach = np.full((fits, size), np.nan), np.zeros(fits)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            solved = Batch(_unpack(batch), theta[:, None, :], modes, layout, order)
            for fit in np.unique(solved.fit).tolist():
                sums[fit] = np.nan_to_num(sums[fit]) + solved.group_jets(fit).ravel()
            np.maximum.at(reach, solved.fit, solved.reach())
        yield _sent(np.arange(fits), sums, reach)

    return run


def evaluator(points, group_modes, layout, order):
    """mapInArrow function: per task and fit, the values at K points and, with group modes, their group blocks."""
    fits, K, _ = points.shape
    G = layout.groups
    size = K if group_modes is None else K * (1 + G + G * G)

    def run(batches):
        sums, reach = np.full((fits, size), np.nan), np.zeros(fits)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unpacked = _unpack(batch)
            used = np.unique(unpacked[0])
            sums[used] = np.nan_to_num(sums[used])
            block = max(1, BLOCK // max(1, len(unpacked[2]) * (1 if group_modes is None else G)))
            for start in range(0, K, block):
                part = slice(start, min(start + block, K))
                modes = None if group_modes is None else group_modes[:, part]
                solved = Batch(unpacked, points[:, part], modes, layout, order)
                per_entity = solved.value()
                if start == 0:
                    np.maximum.at(reach, solved.fit, solved.reach())
                for fit in used:
                    sums[fit, part] += per_entity[solved.fit == fit].sum(axis=0)
                    if group_modes is not None:
                        g, h = solved.group_block(fit)
                        sums[fit, K + start * G : K + part.stop * G] += g.ravel()
                        sums[fit, K + K * G + start * G * G : K + K * G + part.stop * G * G] += h.ravel()
        yield _sent(np.arange(fits), sums, reach)

    return run


def mode_emitter(points, group_modes, layout, order):
    """mapInArrow function: one row per (entity, group) with its new centre and modes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            unpacked = _unpack(batch)
            solved = Batch(unpacked, points, group_modes, layout, order)
            rows = solved.owner
            take = pa.array(rows)
            # a long way to the modes is gone in several expansions, as single long steps can overshoot
            way = np.maximum(np.abs(solved.a - solved.a0), 2 * np.abs(solved.b - solved.b0))[:, 0]
            way = np.maximum.reduceat(way, np.searchsorted(rows, np.arange(solved.count)))
            share = np.minimum(1, LONGEST / np.maximum(way, 1e-300))[rows]
            yield pa.RecordBatch.from_pydict({
                "fit": batch.column("fit").take(take),
                "entity": batch.column("entity").take(take),
                "place": pa.array(solved.group, pa.int32()),
                "m": batch.column("m").take(take),
                "a": pa.array(solved.a0[:, 0] + share * (solved.a - solved.a0)[:, 0]),
                "b": pa.array(solved.b0[:, 0] + share * (solved.b - solved.b0)[:, 0]),
                "n": pa.array(solved.sums[:, 0]),
                "intercept_mode": pa.array((solved.s0 * solved.u0)[rows, 0]),
                "slope_mode": pa.array((solved.s1 * solved.u1)[rows, 0]),
                "nested_mode": pa.array((solved.sn[rows] * solved.w)[:, 0]),
            })

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
