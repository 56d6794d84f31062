"""Values with gradients: as much reverse differentiation as the networks here need, on numpy arrays."""

from __future__ import annotations

import numpy as np


def _fit(grad: np.ndarray, shape: tuple) -> np.ndarray:
    """The gradient of a broadcast operand."""
    if grad.ndim > len(shape):
        grad = grad.sum(axis=tuple(range(grad.ndim - len(shape))))
    axes = tuple(i for i, n in enumerate(shape) if n == 1 and grad.shape[i] != 1)
    return grad.sum(axis=axes, keepdims=True) if axes else grad


class Value:
    """An array, and how a gradient goes back from it: pairs of an operand and a function of the gradient."""

    def __init__(self, x, back=()):
        self.x, self.back = np.asarray(x, np.float64), back

    def __add__(self, o):
        o = o if isinstance(o, Value) else Value(o)
        return Value(self.x + o.x, ((self, lambda g: _fit(g, self.x.shape)), (o, lambda g: _fit(g, o.x.shape))))

    def __sub__(self, o):
        return self + (o if isinstance(o, Value) else Value(o)) * -1.0

    def __mul__(self, o):
        o = o if isinstance(o, Value) else Value(o)
        return Value(self.x * o.x, ((self, lambda g: _fit(g * o.x, self.x.shape)), (o, lambda g: _fit(g * self.x, o.x.shape))))

    def __matmul__(self, o):
        return Value(self.x @ o.x, ((self, lambda g: _fit(g @ np.swapaxes(o.x, -1, -2), self.x.shape)), (o, lambda g: _fit(np.swapaxes(self.x, -1, -2) @ g, o.x.shape))))

    def leaky(self, slope: float = 0.0):
        slopes = np.where(self.x > 0, 1.0, slope)
        return Value(self.x * slopes, ((self, lambda g: g * slopes),))

    def tanh(self):
        y = np.tanh(self.x)
        return Value(y, ((self, lambda g: g * (1 - y * y)),))

    def sigmoid(self):
        y = 0.5 * (1 + np.tanh(0.5 * self.x))
        return Value(y, ((self, lambda g: g * y * (1 - y)),))

    def exp(self):
        y = np.exp(self.x)
        return Value(y, ((self, lambda g: g * y),))

    def log(self):
        return Value(np.log(self.x), ((self, lambda g: g / self.x),))

    def part(self, lo: int, hi: int):
        """Entries lo to hi of the last axis."""

        def back(g):
            out = np.zeros_like(self.x)
            out[..., lo:hi] = g
            return out

        return Value(self.x[..., lo:hi], ((self, back),))

    def softmax(self, among: np.ndarray | None = None):
        """Over the last axis; among: which entries take part."""
        x = self.x if among is None else np.where(among, self.x, -np.inf)
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        y = e / e.sum(axis=-1, keepdims=True)
        return Value(y, ((self, lambda g: y * (g - (g * y).sum(axis=-1, keepdims=True))),))

    def reshape(self, *shape: int):
        return Value(self.x.reshape(shape), ((self, lambda g: g.reshape(self.x.shape)),))

    def swap(self, *axes: int):
        return Value(self.x.transpose(axes), ((self, lambda g: g.transpose(np.argsort(axes))),))

    def sum(self, axis: int | None = None):
        if axis is None:
            return Value(self.x.sum(), ((self, lambda g: np.broadcast_to(g, self.x.shape)),))
        return Value(self.x.sum(axis=axis), ((self, lambda g: np.broadcast_to(np.expand_dims(g, axis), self.x.shape)),))

    def gradients(self, of: dict[str, Value]) -> dict[str, np.ndarray]:
        """Of this scalar, by the named values."""
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            v, done = todo.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                todo.append((v, True))
                todo += [(u, False) for u, _ in v.back]
        grads = {id(self): np.ones_like(self.x)}
        for v in reversed(order):
            g = grads.get(id(v))
            for u, f in v.back if g is not None else ():
                own = f(g)
                grads[id(u)] = own if id(u) not in grads else grads[id(u)] + own
        return {name: grads.get(id(v), np.zeros_like(v.x)) for name, v in of.items()}


def joined(a: Value, b: Value) -> Value:
    """Side by side along the last axis."""
    n = a.x.shape[-1]
    return Value(np.concatenate([a.x, b.x], axis=-1), ((a, lambda g: g[..., :n]), (b, lambda g: g[..., n:])))


def squares(a: Value, b) -> Value:
    """Sum over rows of the mean squared difference of a row."""
    d = a - b
    return (d * d).sum() * (1.0 / max(1, int(np.prod(d.x.shape[1:]))))
