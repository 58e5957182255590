"""Values with first and second derivatives in a few variables, many at a time (forward differentiation)."""

import sys

import numpy as np
from pyspark import cloudpickle


def _outer(x, y):
    return x[:, None] * y[None]


class Jet:
    """``v`` (...), gradient ``g`` (d, ...) and Hessian ``h`` (d, d, ...): the many come last, so that numpy's loops are long."""

    __slots__ = ("v", "g", "h")

    def __init__(self, v, g, h):
        self.v, self.g, self.h = v, g, h

    @classmethod
    def constant(cls, v, d):
        v = np.asarray(v, float)
        return cls(v, np.zeros((d, *v.shape)), np.zeros((d, d, *v.shape)))

    @classmethod
    def variable(cls, v, at, d):
        out = cls.constant(v, d)
        out.g[at] = 1.0
        return out

    def __add__(self, other):
        if isinstance(other, Jet):
            return Jet(self.v + other.v, self.g + other.g, self.h + other.h)
        return Jet(self.v + other, self.g, self.h)

    __radd__ = __add__

    def __neg__(self):
        return Jet(-self.v, -self.g, -self.h)

    def __sub__(self, other):
        return self + (-other)

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, other):
        if isinstance(other, Jet):
            cross = _outer(self.g, other.g)
            return Jet(self.v * other.v, self.v * other.g + other.v * self.g, self.v * other.h + other.v * self.h + cross + np.swapaxes(cross, 0, 1))
        other = np.asarray(other, float)
        return Jet(self.v * other, self.g * other, self.h * other)

    __rmul__ = __mul__

    def of(self, value, first, second):
        """A function of this jet from its value and derivatives there."""
        return Jet(value, first * self.g, first * self.h + second * _outer(self.g, self.g))

    def reciprocal(self):
        return self.of(1 / self.v, -1 / self.v**2, 2 / self.v**3)

    def log(self):
        return self.of(np.log(self.v), 1 / self.v, -1 / self.v**2)

    def __getitem__(self, at):
        at = at if isinstance(at, tuple) else (at,)
        return Jet(self.v[at], self.g[(slice(None), *at)], self.h[(slice(None), slice(None), *at)])

    def sum(self, axis):
        return Jet(self.v.sum(axis), self.g.sum(axis + 1), self.h.sum(axis + 2))

    def spread(self):
        """With an axis of length one after the first, to meet several rows of an owner."""
        return Jet(self.v[:, None], self.g[:, :, None], self.h[:, :, :, None])


def of_two(table, i, j, a, b):
    """``table[i, j]`` as a function of the jets a and b; its partial derivatives are the entries behind it."""
    def at(k, m):
        return table.get((i + k, j + m), np.zeros(()))

    cross = _outer(a.g, b.g)
    return Jet(
        table[i, j] + 0 * a.v, at(1, 0) * a.g + at(0, 1) * b.g,
        at(1, 0) * a.h + at(0, 1) * b.h + at(2, 0) * _outer(a.g, a.g)
        + at(1, 1) * (cross + np.swapaxes(cross, 0, 1)) + at(0, 2) * _outer(b.g, b.g))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
