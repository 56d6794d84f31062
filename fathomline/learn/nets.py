"""Networks by name. Each knows its layers, its objectives on a batch, and how it scores windows.

A batch holds windows x (rows, width, features) and, for forecasts, the point after each one, y (rows, features).
An objective is a loss (a sum over rows) with the layers that its optimiser moves.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

from .tape import Value, joined, squares


class Net:
    def __init__(self, width: int, features: int):
        self.width, self.features = width, features

    def layers(self) -> dict[str, tuple]:
        """Shapes by name, in order."""
        raise NotImplementedError

    def objectives(self, p: dict[str, Value], x: np.ndarray, y: np.ndarray, epoch: int) -> list[tuple[Value, list[str]]]:
        raise NotImplementedError

    def valid(self, p: dict[str, Value], x: np.ndarray, y: np.ndarray) -> float:
        """The loss by which versions are compared."""
        raise NotImplementedError

    def scores(self, p: dict[str, Value], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two errors of each row and feature at the window's last point (or the point after it)."""
        raise NotImplementedError

    #: Layers by the name of a group, to be frozen or made anew.
    groups: dict[str, list[str]] = {}
    #: Of packed series: training takes windows round the end of a series to its start too; a series' first window is scored at all its points (`every`).
    wrap, whole_first = False, False

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.layers().values())

    def initial(self, seed: int) -> np.ndarray:
        """Uniform within one over the root of the inputs; a bias has its layer's inputs."""
        parts = []
        for k, shape in enumerate(self.layers().values()):
            inputs = shape[-2] if len(shape) > 1 else self._inputs[k]
            bound = 1 / math.sqrt(max(1, inputs))
            parts.append(np.random.default_rng([seed, k]).uniform(-bound, bound, shape).ravel())
        return np.concatenate(parts)

    @property
    def _inputs(self) -> list[int]:
        out, last = [], 1
        for shape in self.layers().values():
            last = shape[-2] if len(shape) > 1 else last
            out.append(last)
        return out

    def split(self, w: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.layers().items():
            n = int(np.prod(shape))
            out[name] = w[at : at + n].reshape(shape)
            at += n
        return out

    def places(self, names) -> np.ndarray:
        """Which of the flat weights belong to some layers."""
        names = set(names)
        return np.concatenate([np.full(int(np.prod(s)), name in names) for name, s in self.layers().items()])

    def named(self, group: str) -> list[str]:
        return self.groups.get(group) or [n for n in self.layers() if n == group or n.startswith(group + ".")]

    def gradients(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, epoch: int) -> tuple[list[float], list[np.ndarray]]:
        p = {k: Value(v) for k, v in self.split(w).items()}
        losses, grads = [], []
        for loss, names in self.objectives(p, x, y, epoch):
            g = loss.gradients(p)
            grads.append(np.concatenate([(g[k] if k in names else np.zeros_like(g[k])).ravel() for k in p]))
            losses.append(float(loss.x))
        return losses, grads


def _dense(p: dict[str, Value], name: str, x: Value) -> Value:
    return x @ p[name + ".w"] + p[name + ".b"]


class TwoDecoders(Net):
    """DET-14e: an encoder shared by two decoders, which are trained against each other.

    With e the epoch: G lowers 1/e |G - x|^2 + (1 - 1/e) |D(G) - x|^2, D lowers 1/e |D - x|^2 - (1 - 1/e) |D(G) - x|^2, each
    with the encoder. (If both gradients are added up before either optimiser moves, the second terms cancel out; so each optimiser
    has its own gradient here.) Versions are compared by |D(G) - x|^2. Of packed series, training takes windows round the end of a series, and
    the first window gives the errors of all its points.
    """

    wrap, whole_first = True, True

    def __init__(self, width: int, features: int, latent: int = 4):
        super().__init__(width, features)
        self.latent = latent
        self.groups = {
            "outer": ["enc0.w", "enc0.b", "g2.w", "g2.b", "d2.w", "d2.b"], "encoder": [f"enc{k}.{c}" for k in range(3) for c in "wb"], "inner": ["enc2.w", "enc2.b", "g0.w", "g0.b", "d0.w", "d0.b"],
            "inner decoders": ["g0.w", "g0.b", "d0.w", "d0.b"], "outer two": [f"{n}.{c}" for n in ("enc0", "enc1", "g2", "g1", "d2", "d1") for c in "wb"], "inner two": [f"{n}.{c}" for n in ("enc1", "enc2", "g0", "g1", "d0", "d1") for c in "wb"],
        }

    def layers(self):
        d = self.width * self.features
        down, out = [d, max(1, d // 2), max(1, d // 4), self.latent], {}
        for name, sizes in (("enc", down), ("g", down[::-1]), ("d", down[::-1])):
            for k in range(3):
                out[f"{name}{k}.w"], out[f"{name}{k}.b"] = (sizes[k], sizes[k + 1]), (sizes[k + 1],)
        return out

    def _through(self, p, name, x):
        for k in range(3):
            x = _dense(p, f"{name}{k}", x)
            x = x.leaky(0.2) if k < 2 else x
        return x

    def _all(self, p, x):
        flat = Value(x.reshape(len(x), -1))
        z = self._through(p, "enc", flat)
        g = self._through(p, "g", z)
        return flat, g, self._through(p, "d", z), self._through(p, "d", self._through(p, "enc", g))

    def objectives(self, p, x, y, epoch):
        flat, g, d, dg = self._all(p, x)
        first, rest = 1.0 / epoch, 1.0 - 1.0 / epoch
        again = squares(dg, flat)
        of = lambda k: [n for n in p if n.startswith(("enc", k))]
        return [(squares(g, flat) * first + again * rest, of("g")), (squares(d, flat) * first - again * rest, of("d"))]

    def _again(self, p, x):
        flat = Value(x.reshape(len(x), -1))
        g = self._through(p, "g", self._through(p, "enc", flat))
        return flat, g, self._through(p, "d", self._through(p, "enc", g))

    def valid(self, p, x, y):
        flat, _, dg = self._again(p, x)
        return float(squares(dg, flat).x)

    def every(self, p, x):
        """Both errors of all points of the windows."""
        flat, g, dg = self._again(p, x)
        return tuple(((v.x - flat.x) ** 2).reshape(x.shape) for v in (g, dg))

    def scores(self, p, x, y):
        return tuple(v[:, -1] for v in self.every(p, x))


class NeighbourGraph(Net):
    """DET-14f: each feature has a vector; its nearest by cosine are its neighbours, whose history foretells its next value by attention.

    Attention of feature i to j (itself and its neighbours) is a softmax of leaky(a . Wx_i + b . v_i + c . Wx_j + d . v_j), as in a graph
    attention layer; the sum of Wx_j is gated by v_i, and a linear layer gives the forecast. No normalisation over the batch, so that
    rows may be dealt to tasks at will.
    """

    def __init__(self, width: int, features: int, vectors: int = 8, neighbours: int = 3):
        super().__init__(width, features)
        self.vectors, self.neighbours = vectors, min(neighbours, features)
        self.groups = {"attention": ["att.i", "att.j", "att.vi", "att.vj"], "vectors": ["vectors"], "ends": ["lin", "out.w", "out.b"]}

    def layers(self):
        k = self.vectors
        return {"vectors": (self.features, k), "lin": (self.width, k), "att.i": (k, 1), "att.j": (k, 1), "att.vi": (k, 1), "att.vj": (k, 1), "bias": (k,), "out.w": (k, 1), "out.b": (1,)}

    def graph(self, vectors: np.ndarray) -> np.ndarray:
        """Row i has True at the features most like i, itself among them."""
        unit = vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
        near = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, : self.neighbours]
        out = np.eye(len(vectors), dtype=bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def _forecast(self, p, x):
        v = p["vectors"]
        h = Value(x.transpose(0, 2, 1)) @ p["lin"]  # rows, features, k
        own = h @ p["att.i"] + v @ p["att.vi"]  # rows, features, 1
        other = (h @ p["att.j"] + v @ p["att.vj"]).swap(0, 2, 1)  # rows, 1, features
        weights = (own + other).leaky(0.2).softmax(self.graph(v.x))
        mixed = (weights @ h + p["bias"]).leaky(0.2) * v
        return (mixed @ p["out.w"] + p["out.b"]).reshape(len(x), self.features), weights

    def objectives(self, p, x, y, epoch):
        return [(squares(self._forecast(p, x)[0], Value(y)), list(p))]

    def valid(self, p, x, y):
        return float(squares(self._forecast(p, x)[0], Value(y)).x)

    def scores(self, p, x, y):
        error = np.abs(self._forecast(p, x)[0].x - y)
        return error, error


class SelfConditioned(Net):
    """DET-14a: a transformer encoder and two decoders; the second pass sees the first one's squared errors beside its input.

    With k = 1/epoch: the first objective lowers k |o1 - x|^2 + (1 - k) |o2' - x|^2, the second k |o2 - x|^2 - (1 - k) |o2' - x|^2, where o1 and o2
    are rebuilt without errors and o2' with those of o1. What is rebuilt is the window's last point. A head for each feature.
    """

    def __init__(self, width: int, features: int, hidden: int = 16):
        super().__init__(width, features)
        self.hidden = hidden
        blocks = ("enc", "one", "two")
        self.groups = {
            "encoder": [n for n in self.layers() if n.startswith(("enc", "fcn1"))], "attention": [f"{b}.{a}.{c}" for b in blocks for a in (("self",) if b == "enc" else ("self", "cross")) for c in ("q", "k", "v")],
            "ends": ["one.down.w", "one.down.b", "two.down.w", "two.down.b", "fcn3b.w", "fcn3b.b"],
        }

    def layers(self):
        m, out = 2 * self.features, {}
        for block, attentions in (("enc", ("self",)), ("one", ("self", "cross")), ("two", ("self", "cross"))):
            for a in attentions:
                for c in "qkvo":
                    out[f"{block}.{a}.{c}"] = (m, m)
            out |= {f"{block}.up.w": (m, self.hidden), f"{block}.up.b": (self.hidden,), f"{block}.down.w": (self.hidden, m), f"{block}.down.b": (m,)}
        for k in (1, 2, 3):
            out |= {f"fcn{k}a.w": (m, m), f"fcn{k}a.b": (m,), f"fcn{k}b.w": (m, self.features), f"fcn{k}b.b": (self.features,)}
        return out

    def _attend(self, p, name, of, to):
        """of: rows, n, 2F attends to: rows, m, 2F; heads of size 2. A single point has all the attention, whatever the queries and keys."""
        if to.x.shape[1] == 1:
            return (to @ p[f"{name}.v"]) @ p[f"{name}.o"]
        heads = lambda v, c: (v @ p[f"{name}.{c}"]).reshape(*v.x.shape[:2], self.features, 2).swap(0, 2, 1, 3)
        q, k, v = heads(of, "q"), heads(to, "k"), heads(to, "v")
        mixed = ((q @ k.swap(0, 1, 3, 2)) * (1 / math.sqrt(2))).softmax() @ v
        return mixed.swap(0, 2, 1, 3).reshape(*of.x.shape) @ p[f"{name}.o"]

    def _ahead(self, p, block, x):
        return x + _dense(p, f"{block}.down", _dense(p, f"{block}.up", x).leaky(0.01))

    def _memory(self, p, x, c):
        m = 2 * self.features
        at, rate = np.arange(self.width)[:, None], np.exp(-math.log(10000.0) * (np.arange(m) // 2 * 2) / m)
        places = np.where(np.arange(m) % 2 == 0, np.sin(at * rate), np.cos(at * rate))
        src = joined(Value(x), c) * math.sqrt(self.features) + places
        return self._ahead(p, "enc", src + self._attend(p, "enc.self", src, src))

    def _decode(self, p, block, fcn, target, memory):
        t = target + self._attend(p, f"{block}.self", target, target)
        t = self._ahead(p, block, t + self._attend(p, f"{block}.cross", t, memory))
        return _dense(p, fcn + "b", _dense(p, fcn + "a", t).leaky())

    def _all(self, p, x, both=True):
        last = Value(x[:, -1:, :])
        target = joined(last, last)
        memory = self._memory(p, x, Value(np.zeros_like(x)))
        o1, o2 = self._decode(p, "one", "fcn1", target, memory), self._decode(p, "two", "fcn2", target, memory) if both else None
        wrong = o1 - Value(x)
        again = self._decode(p, "two", "fcn3", target, self._memory(p, x, wrong * wrong))
        return last, o1, o2, again

    def objectives(self, p, x, y, epoch):
        last, o1, o2, again = self._all(p, x)
        k = 1.0 / epoch
        second = squares(again, last) * (1 - k)
        own = [n for n in p if not n.startswith(("two", "fcn2", "fcn3"))]
        return [(squares(o1, last) * k + second, own + [n for n in p if n.startswith("fcn3")]), (squares(o2, last) * k - second, [n for n in p if n.startswith(("enc", "two", "fcn2"))])]

    def valid(self, p, x, y):
        last, o1, _, again = self._all(p, x, False)
        return float(squares(o1, last).x + squares(again, last).x)

    def scores(self, p, x, y):
        last, o1, _, again = self._all(p, x, False)
        return ((o1.x - last.x) ** 2)[:, 0], ((again.x - last.x) ** 2)[:, 0]


def _gru_layers(name: str, inputs: int, hidden: int) -> dict[str, tuple]:
    return {f"{name}.x": (inputs, 3 * hidden), f"{name}.h": (hidden, 3 * hidden), f"{name}.b": (3 * hidden,)}


def _gru(p: dict[str, Value], name: str, x: Value, h: Value) -> Value:
    """One step of a gated recurrent unit; x: rows, inputs; h: rows, hidden."""
    n = h.x.shape[-1]
    own, old = x @ p[f"{name}.x"] + p[f"{name}.b"], h @ p[f"{name}.h"]
    reset = (own.part(0, n) + old.part(0, n)).sigmoid()
    keep = (own.part(n, 2 * n) + old.part(n, 2 * n)).sigmoid()
    new = (own.part(2 * n, 3 * n) + reset * old.part(2 * n, 3 * n)).tanh()
    return new + keep * (h - new)


class AttentiveForecast(Net):
    """DET-14g: attention among features and among times beside the input, a recurrent unit over all three, a forecast and a reconstruction.

    Both losses count alike. Scores are the squared error of the forecast of the point after the window, and that of the window's last point.
    """

    def __init__(self, width: int, features: int, hidden: int = 8):
        super().__init__(width, features)
        self.hidden = hidden
        self.groups = {"attention": [n for n in self.layers() if n.startswith(("feature", "time"))]}

    def layers(self):
        w, f, h = self.width, self.features, self.hidden
        out = {"feature.lin": (w, w), "feature.i": (w, 1), "feature.j": (w, 1), "time.lin": (f, f), "time.i": (f, 1), "time.j": (f, 1)} | _gru_layers("gru", 3 * f, h)
        out |= {"ahead0.w": (h, h), "ahead0.b": (h,), "ahead1.w": (h, f), "ahead1.b": (f,)}
        return out | _gru_layers("back", h, h) | {"again.w": (h, f), "again.b": (f,)}

    def _graph(self, p, name, v):
        h = v @ p[f"{name}.lin"]
        weights = (h @ p[f"{name}.i"] + (h @ p[f"{name}.j"]).swap(0, 2, 1)).leaky(0.2).softmax()
        return (weights @ h).sigmoid()

    def _all(self, p, x):
        v = Value(x)
        seen = joined(joined(v, self._graph(p, "feature", v.swap(0, 2, 1)).swap(0, 2, 1)), self._graph(p, "time", v))
        flat, n = seen.reshape(len(x), -1), 3 * self.features
        h = Value(np.zeros((len(x), self.hidden)))
        for t in range(self.width):
            h = _gru(p, "gru", flat.part(t * n, (t + 1) * n), h)
        ahead = _dense(p, "ahead1", _dense(p, "ahead0", h).leaky())
        back, again = Value(np.zeros((len(x), self.hidden))), []
        for _ in range(self.width):
            back = _gru(p, "back", h, back)
            again.append(_dense(p, "again", back))
        return ahead, again

    def _loss(self, p, x, y):
        ahead, again = self._all(p, x)
        out = squares(ahead, Value(y))
        for t, v in enumerate(again):
            out = out + squares(v, Value(x[:, t])) * (1.0 / self.width)
        return out

    def objectives(self, p, x, y, epoch):
        return [(self._loss(p, x, y), list(p))]

    def valid(self, p, x, y):
        return float(self._loss(p, x, y).x)

    def scores(self, p, x, y):
        ahead, again = self._all(p, x)
        return (ahead.x - y) ** 2, (again[-1].x - x[:, -1]) ** 2


def _noise(x: np.ndarray, shape: tuple) -> np.ndarray:
    """Normal noise that depends on the batch alone, so that a seed repeats."""
    return np.random.default_rng(zlib.crc32(np.ascontiguousarray(x).tobytes())).normal(size=shape)


class RecurrentVariational(Net):
    """DET-14b: a variational auto-encoder of sequences. The hidden z[t] follows from the recurrent state and z[t - 1], passes planar flows, and has a linear
    Gaussian prior around T z[t - 1]; a second recurrent unit gives mean and variance of x[t]. static > 0 adds hidden values of the whole window (DET-14d).

    The loss is the negative evidence bound of a drawn z; the score is the negative log density of the last point, at the mean of z.
    """

    def __init__(self, width: int, features: int, hidden: int = 8, latent: int = 3, flows: int = 2, static: int = 0):
        super().__init__(width, features)
        self.hidden, self.latent, self.flows, self.static = hidden, latent, flows, static
        names = self.layers()
        self.groups = {"encoder": [n for n in names if n.startswith(("q.", "mean", "spread", "flow", "whole"))], "decoder": [n for n in names if n.startswith(("p.", "xmean", "xspread", "prior"))]}

    def layers(self):
        f, h, z, s = self.features, self.hidden, self.latent, self.static
        out = _gru_layers("q", f, h) | {"mean.w": (h + z, z), "mean.b": (z,), "spread.w": (h + z, z), "spread.b": (z,), "prior": (z, z)}
        for k in range(self.flows):
            out |= {f"flow{k}.u": (1, z), f"flow{k}.w": (z, 1), f"flow{k}.b": (1,)}
        if s:
            out |= {"whole.w": (h, 2 * s), "whole.b": (2 * s,)}
        return out | _gru_layers("p", z + s, h) | {"xmean.w": (h, f), "xmean.b": (f,), "xspread.w": (h, f), "xspread.b": (f,)}

    def _flow(self, p, k, z):
        """z + u tanh(w z + b), with u moved so that w u > -1, and the log of its volume change."""
        u, w = p[f"flow{k}.u"], p[f"flow{k}.w"]
        along = u @ w
        least = (along.exp() + 1.0).log() - 1.0 - along
        unit = w.swap(1, 0) * (Value(1.0) * ((w * w).sum() + 1e-9).log() * -1.0).exp()
        u = u + least * unit
        t = (z @ w + p[f"flow{k}.b"]).tanh()
        return z + t * u, ((Value(1.0) - t * t) * (u @ w) + 1.0 + 1e-9).log()

    def _run(self, p, x, noise):
        """Negative log density of each point and feature, and what the hidden values add to the bound, summed over rows."""
        n, h, z = len(x), Value(np.zeros((len(x), self.hidden))), Value(np.zeros((len(x), self.latent)))
        states = []
        for t in range(self.width):
            h = _gru(p, "q", Value(x[:, t]), h)
            states.append(h)
        extra = Value(0.0)
        whole = None
        if self.static:
            both = _dense(p, "whole", h)
            mean, spread = both.part(0, self.static), both.part(self.static, 2 * self.static).tanh() * 3.0
            draw = noise[:, self.width * self.latent :]
            whole = mean + (spread * 0.5).exp() * draw
            extra = extra + ((whole * whole).sum() - spread.sum() - float((draw**2).sum())) * 0.5
        d, out = Value(np.zeros((n, self.hidden))), []
        for t in range(self.width):
            seen = joined(states[t], z)
            mean, spread = _dense(p, "mean", seen), _dense(p, "spread", seen).tanh() * 3.0
            draw = noise[:, t * self.latent : (t + 1) * self.latent]
            around = z @ p["prior"]
            z = mean + (spread * 0.5).exp() * draw
            extra = extra - (spread.sum() + float((draw**2).sum())) * 0.5
            for k in range(self.flows):
                z, volume = self._flow(p, k, z)
                extra = extra - volume.sum()
            off = z - around
            extra = extra + (off * off).sum() * 0.5
            d = _gru(p, "p", joined(z, whole) if whole is not None else z, d)
            mean, spread = _dense(p, "xmean", d), _dense(p, "xspread", d).tanh() * 3.0
            off = Value(x[:, t]) - mean
            out.append((off * off * (spread * -1.0).exp() + spread) * 0.5)
        return out, extra

    def _loss(self, p, x, noise):
        out, extra = self._run(p, x, noise)
        total = extra
        for v in out:
            total = total + v.sum()
        return total * (1.0 / (self.width * self.features))

    def _drawn(self, x):
        return _noise(x, (len(x), self.width * self.latent + self.static))

    def objectives(self, p, x, y, epoch):
        return [(self._loss(p, x, self._drawn(x)), list(p))]

    def valid(self, p, x, y):
        return float(self._loss(p, x, self._drawn(x) * 0).x)

    def scores(self, p, x, y):
        last = self._run(p, x, self._drawn(x) * 0)[0][-1].x
        return last, last


class StaticDynamic(RecurrentVariational):
    """DET-14d: hidden values of the whole window beside those of each time; no flows."""

    def __init__(self, width: int, features: int, hidden: int = 8, latent: int = 2, static: int = 2):
        super().__init__(width, features, hidden, latent, 0, static)


class Compressed(Net):
    """CLU-22: an auto-encoder whose middle layer stands for the window; convolved: its first layer is a convolution over time (width 3, step 2)."""

    def __init__(self, width: int, features: int, latent: int = 4, hidden: int = 16, convolved: bool = False, channels: int = 6):
        super().__init__(width, features)
        self.latent_size, self.hidden, self.convolved, self.channels = latent, hidden, convolved, channels
        starts = np.arange(0, max(1, width - 2), 2)
        self._places = np.minimum(starts[:, None] + np.arange(3)[None, :], width - 1)
        self.groups = {"encoder": [n for n in self.layers() if n.startswith(("conv", "in"))], "decoder": [n for n in self.layers() if n.startswith("out")]}

    def layers(self):
        d = self.width * self.features
        first = {"conv.w": (3 * self.features, self.channels), "conv.b": (self.channels,)} if self.convolved else {}
        into = len(self._places) * self.channels if self.convolved else d
        return first | {"in0.w": (into, self.hidden), "in0.b": (self.hidden,), "in1.w": (self.hidden, self.latent_size), "in1.b": (self.latent_size,), "out0.w": (self.latent_size, self.hidden), "out0.b": (self.hidden,), "out1.w": (self.hidden, d), "out1.b": (d,)}

    def latent(self, p: dict[str, Value], x: np.ndarray) -> Value:
        v = Value(x.reshape(len(x), -1))
        if self.convolved:
            v = _dense(p, "conv", Value(x[:, self._places].reshape(len(x), len(self._places), -1))).leaky(0.2).reshape(len(x), -1)
        return _dense(p, "in1", _dense(p, "in0", v).tanh())

    def _again(self, p, x):
        return _dense(p, "out1", _dense(p, "out0", self.latent(p, x)).tanh())

    def objectives(self, p, x, y, epoch):
        return [(squares(self._again(p, x), Value(x.reshape(len(x), -1))), list(p))]

    def valid(self, p, x, y):
        return float(squares(self._again(p, x), Value(x.reshape(len(x), -1))).x)

    def scores(self, p, x, y):
        error = ((self._again(p, x).x.reshape(x.shape) - x) ** 2)[:, -1]
        return error, error


NETS = {
    "two_decoders": TwoDecoders, "neighbour_graph": NeighbourGraph, "self_conditioned": SelfConditioned, "attentive_forecast": AttentiveForecast, "recurrent_variational": RecurrentVariational, "static_dynamic": StaticDynamic,
    "compressed": Compressed,
}


def register_net(name: str, make) -> None:
    """EXT-01: a further network by name."""
    NETS[name] = make
