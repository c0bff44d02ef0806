"""The array expression language: parsed once, then compiled to Columns or evaluated by numpy.

Values are vectors of doubles; a vector of width 1 is a scalar and broadcasts. Precedence from
loosest: ``||``, ``&&``, comparisons, ``+ -``, ``* / %``, unary ``- + !``, then calls and
indexing. Truth is any value but 0, and logic returns 0 or 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(\|\||&&|<=|>=|==|!=|[-+*/%<>!()\[\],]))")
_BINDING = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_UNARY = 6


@dataclass(frozen=True)
class Node:
    kind: str  # number, name, unary, binary, index, call
    value: object
    parts: tuple["Node", ...] = ()


class ExpressionError(ValueError):
    pass


def parse(text: str) -> Node:
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:].strip()[0]!r} in {text!r}")
        tokens.append(("number", float(m[1])) if m[1] else ("name", m[2]) if m[2] else ("op", m[3]))
        at = m.end()
    pos = 0

    def peek():
        return tokens[pos] if pos < len(tokens) else ("end", None)

    def take(op=None):
        nonlocal pos
        t = peek()
        if op is not None and t != ("op", op):
            raise ExpressionError(f"expected {op!r} in {text!r}")
        pos += 1
        return t

    def arguments(close):
        out = []
        while peek() != ("op", close):
            out.append(expression(0))
            if peek() != ("op", close):
                take(",")
        take(close)
        return tuple(out)

    def operand():
        kind, value = take()
        if kind == "number":
            node = Node("number", value)
        elif kind == "name":
            node = Node("name", value)
            if peek() == ("op", "("):
                take()
                node = Node("call", value, arguments(")"))
        elif (kind, value) == ("op", "("):
            node = expression(0)
            take(")")
        elif kind == "op" and value in "-+!":
            return Node("unary", value, (expression(_UNARY),))
        else:
            raise ExpressionError(f"unexpected {value!r} in {text!r}")
        while peek() == ("op", "["):
            take()
            node = Node("index", None, (node, expression(0)))
            take("]")
        return node

    def expression(least):
        left = operand()
        while (t := peek())[0] == "op" and _BINDING.get(t[1], 0) > least:
            take()
            left = Node("binary", t[1], (left, expression(_BINDING[t[1]])))
        return left

    tree = expression(0)
    if peek()[0] != "end":
        raise ExpressionError(f"unexpected {peek()[1]!r} in {text!r}")
    return tree


# --- numpy -------------------------------------------------------------------------------

_erf, _erfc = np.vectorize(math.erf, otypes=[float]), np.vectorize(math.erfc, otypes=[float])
_ONE = {
    "abs": np.abs, "floor": np.floor, "exp": np.exp, "log": np.log, "sqrt": np.sqrt, "sin": np.sin, "cos": np.cos, "tan": np.tan,
    "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan, "erf": _erf, "erfc": _erfc,
}
_TWO = {"min": np.minimum, "max": np.maximum, "pow": np.power, "atan2": np.arctan2}
_BINARY = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "%": np.fmod, "<": np.less, "<=": np.less_equal, ">": np.greater,
    ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal,
}
_DRAWS = {
    "normal": lambda g, a, b, n: g.normal(a, b, n), "uniform": lambda g, a, b, n: g.uniform(a, b, n), "gamma": lambda g, a, b, n: g.gamma(a, 1 / b, n),
    "beta": lambda g, a, b, n: g.beta(a, b, n), "binomial": lambda g, a, b, n: g.binomial(np.asarray(a).astype(int), b, n),
    "exponential": lambda g, a, b, n: g.exponential(1 / a, n), "poisson": lambda g, a, b, n: g.poisson(a, n),
}
_SINGLE_PARAMETER = ("exponential", "poisson")


def _pair(a: np.ndarray, b: np.ndarray) -> None:
    if len(a) != len(b) and 1 not in (len(a), len(b)):
        raise ExpressionError(f"widths {len(a)} and {len(b)} differ")


def _index(v: np.ndarray, i: np.ndarray) -> int:
    k = float(i[0])
    if math.isnan(k) or not 0 <= int(k) < len(v):
        raise ExpressionError(f"index {k} of width {len(v)}")
    return int(k)


class Numpy:
    """Evaluates a tree over named vectors. ``lag(name, n)`` reads ``history(name, n)``."""

    def __init__(self, names: Mapping[str, np.ndarray], rng: np.random.Generator | None = None, history: Callable[[str, int], np.ndarray] | None = None):
        self.names, self.rng, self.history, self.free = dict(names), rng, history, 0

    def __call__(self, node: Node) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.atleast_1d(np.asarray(getattr(self, "_" + node.kind)(node), float))

    def _number(self, node):
        return node.value

    def _name(self, node):
        if node.value not in self.names:
            raise ExpressionError(f"unknown name {node.value!r}")
        return self.names[node.value]

    def _unary(self, node):
        x = self(node.parts[0])
        return -x if node.value == "-" else x if node.value == "+" else (x == 0).astype(float)

    def _index(self, node):
        v, i = self(node.parts[0]), self(node.parts[1])
        return v[_index(v, i)]

    def _binary(self, node):
        a = self(node.parts[0])
        if node.value in ("&&", "||"):
            stop = node.value == "||"
            if len(a) == 1 and bool(a[0]) == stop:
                return float(stop)
            b = self(node.parts[1])
            _pair(a, b)
            return (((a != 0) | (b != 0)) if stop else ((a != 0) & (b != 0))).astype(float)
        b = self(node.parts[1])
        _pair(a, b)
        return _BINARY[node.value](a, b).astype(float)

    def _scoped(self, name, value, node):
        before = self.names.get(name)
        self.names[name] = np.atleast_1d(np.asarray(value, float))
        self.free += 1
        try:
            return self(node)
        finally:
            self.free -= 1
            if before is None:
                del self.names[name]
            else:
                self.names[name] = before

    def _call(self, node):
        f, p = node.value, node.parts
        if f == "where":
            c = self(p[0])
            if len(c) == 1:
                return self(p[1] if c[0] else p[2])
            a, b = self(p[1]), self(p[2])
            if len(a) not in (1, len(c)) or len(b) not in (1, len(c)):
                raise ExpressionError("branches must have the condition's width or 1")
            return np.where(c != 0, a, b)
        if f == "iid":
            self.free += 1
            try:
                return np.concatenate([self(p[1]) for _ in range(int(self(p[0])[0]))])
            finally:
                self.free -= 1
        if f == "shared":
            self.free += 1
            try:
                return self(p[0])
            finally:
                self.free -= 1
        if f == "each":
            lanes = [self._scoped(p[1].value, i, p[2]) for i in range(int(self(p[0])[0]))]
            if not lanes or any(len(x) != 1 for x in lanes):
                raise ExpressionError("each needs one scalar per lane")
            return np.concatenate(lanes)
        if f == "scan":
            acc = self(p[3])
            for i in range(int(self(p[0])[0])):
                before = self.names.get(p[2].value)
                self.names[p[2].value] = acc
                acc = self._scoped(p[1].value, i, p[4])
                if before is None:
                    del self.names[p[2].value]
                else:
                    self.names[p[2].value] = before
            return acc
        if f == "lag":
            if self.history is None:
                raise ExpressionError("no history here")
            return self.history(p[0].value, int(self(p[1])[0]))
        a = [self(x) for x in p]
        if f in _DRAWS:
            if not self.free and all(len(x) == 1 for x in a):
                raise ExpressionError(f"{f} with scalar parameters must stand in iid, shared, each or scan")
            b = a[1] if len(a) > 1 else np.zeros(1)
            _pair(a[0], b)
            return np.asarray(_DRAWS[f](self.rng, a[0], b, max(len(a[0]), len(b))), float)
        if f in _ONE:
            return _ONE[f](a[0])
        if f in _TWO:
            _pair(*a)
            return _TWO[f](*a)
        if f == "clamp":
            return np.minimum(np.maximum(a[0], a[1]), a[2])
        if f == "fill":
            return np.full(int(a[0][0]), a[1][0])
        if f == "slice":
            i, n = int(a[1][0]), int(a[2][0])
            if i < 0 or n < 0 or i + n > len(a[0]):
                raise ExpressionError("slice beyond the vector")
            return a[0][i : i + n]
        if f == "concat":
            return np.concatenate(a)
        if f == "width":
            return len(a[0])
        if f == "sum":
            return a[0].sum()
        if f == "dot":
            _pair(*a)
            return (a[0] * a[1]).sum()
        raise ExpressionError(f"unknown function {f!r}")


def evaluate(text: str, names: Mapping[str, object], rng: np.random.Generator | None = None, history=None) -> np.ndarray:
    return Numpy({k: np.atleast_1d(np.asarray(v, float)) for k, v in names.items()}, rng, history)(parse(text))


# --- Columns -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Value:
    """A Column and whether it is an array (of any width) or a scalar."""

    col: Column
    vector: bool = False


def _lift(f, *values: Value) -> Value:
    """A scalar function over lanes; scalars broadcast, and arrays must have one width."""
    arrays = [v for v in values if v.vector]
    if not arrays:
        return Value(f(*[v.col for v in values]))
    if len(arrays) == 1:
        return Value(F.transform(arrays[0].col, lambda x: f(*[x if v.vector else v.col for v in values])), True)
    first = arrays[0].col
    same = [F.size(first) == F.size(v.col) for v in arrays[1:]]
    ok = same[0]
    for s in same[1:]:
        ok = ok & s

    def lane(e, i):
        it = iter(arrays)
        return f(*[F.get(next(it).col, i) if v.vector else v.col for v in values])

    return Value(F.when(ok, F.transform(first, lane)).otherwise(F.raise_error(F.lit("vector widths differ"))), True)


def _num(b: Column) -> Column:
    return F.when(b, 1.0).otherwise(0.0)


_ERF = {}


def _erf_udf(name):
    if name not in _ERF:
        import pandas as pd

        g = {"erf": math.erf, "erfc": math.erfc}[name]
        _ERF[name] = F.pandas_udf(lambda x: pd.Series([g(v) for v in x]), "double")
    return _ERF[name]


_ONE_C = {
    "abs": F.abs, "floor": lambda x: F.floor(x).cast("double"), "exp": F.exp, "log": ieee.log, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan,
}
_TWO_C = {"min": ieee.least, "max": ieee.greatest, "pow": F.pow, "atan2": F.atan2}
_BINARY_C = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee.divide, "%": lambda a, b: F.when(b == 0, float("nan")).otherwise(a % b),
    "<": lambda a, b: _num(ieee.less(a, b)), ">": lambda a, b: _num(ieee.less(b, a)), "<=": lambda a, b: _num(ieee.less(a, b) | ieee.equal(a, b)),
    ">=": lambda a, b: _num(ieee.less(b, a) | ieee.equal(a, b)), "==": lambda a, b: _num(ieee.equal(a, b)), "!=": lambda a, b: _num(~ieee.equal(a, b)),
    "&&": lambda a, b: F.when(a == 0, 0.0).otherwise(_num(b != 0)), "||": lambda a, b: F.when(a != 0, 1.0).otherwise(_num(b != 0)),
}


class Columns:
    """Compiles a tree to a Column over named Values. ``lag(name, n)`` needs a window."""

    def __init__(self, names: Mapping[str, Value], window=None, draws: Callable[[str, list[Value], int], Column] | None = None):
        self.names, self.window, self.draws, self.drawn = dict(names), window, draws, 0

    def __call__(self, node: Node) -> Value:
        return getattr(self, "_" + node.kind)(node)

    def _number(self, node):
        return Value(F.lit(float(node.value)))

    def _name(self, node):
        if node.value not in self.names:
            raise ExpressionError(f"unknown name {node.value!r}")
        return self.names[node.value]

    def _unary(self, node):
        x = self(node.parts[0])
        return x if node.value == "+" else _lift((lambda c: -c) if node.value == "-" else (lambda c: _num(c == 0)), x)

    def _binary(self, node):
        return _lift(_BINARY_C[node.value], self(node.parts[0]), self(node.parts[1]))

    def _index(self, node):
        v, i = self(node.parts[0]), self(node.parts[1])
        return Value(F.element_at(self._array(v), F.when(i.col >= 0, i.col.cast("int") + 1).otherwise(F.raise_error(F.lit("index below zero")).cast("int"))))

    @staticmethod
    def _array(v: Value) -> Column:
        return v.col if v.vector else F.array(v.col)

    def _within(self, names: Mapping[str, Value], node: Node) -> Value:
        inner = Columns({**self.names, **names}, self.window, self.draws)
        inner.drawn = self.drawn
        out = inner(node)
        self.drawn = inner.drawn
        return out

    def _count(self, node):
        if node.kind != "number":
            raise ExpressionError("counts must be numbers")
        return int(node.value)

    def _call(self, node):
        f, p = node.value, node.parts
        if f == "where":
            return _lift(lambda c, a, b: F.when(c != 0, a).otherwise(b), *[self(x) for x in p])
        if f in ("iid", "each"):
            n = self._count(p[0])
            lanes = [self._within({p[1].value: Value(F.lit(float(i)))} if f == "each" else {}, p[-1]) for i in range(n)]
            return Value(F.concat(*[self._array(x) for x in lanes]) if any(x.vector for x in lanes) else F.array(*[x.col for x in lanes]), True)
        if f == "shared":
            return self(p[0])
        if f == "scan":
            steps, init = F.sequence(F.lit(0), F.lit(self._count(p[0]) - 1)) if self._count(p[0]) else F.array().cast("array<int>"), self(p[3])
            body = lambda acc, i: self._within({p[1].value: Value(i.cast("double")), p[2].value: Value(acc, init.vector)}, p[4])
            if not init.vector and body(init.col, F.lit(0)).vector:
                init = Value(F.array(init.col), True)
            return Value(F.aggregate(steps, init.col, lambda acc, i: body(acc, i).col), init.vector)
        if f == "lag":
            v = self(p[0])
            return Value(F.lag(v.col, self._count(p[1])).over(self.window), v.vector)
        a = [self(x) for x in p]
        if f in _DRAWS:
            if self.draws is None:
                raise ExpressionError("draws need keys")
            self.drawn += 1
            return Value(self.draws(f, a, self.drawn))
        if f in ("erf", "erfc"):
            if a[0].vector:
                raise ExpressionError(f"{f} of a vector: take it lane by lane with each")
            return Value(_erf_udf(f)(a[0].col))
        if f in _ONE_C:
            return _lift(_ONE_C[f], a[0])
        if f in _TWO_C:
            return _lift(_TWO_C[f], *a)
        if f == "clamp":
            return _lift(lambda x, lo, hi: ieee.least(ieee.greatest(x, lo), hi), *a)
        if f == "fill":
            return Value(F.array_repeat(a[1].col, a[0].col.cast("int")), True)
        if f == "slice":
            return Value(F.slice(self._array(a[0]), a[1].col.cast("int") + 1, a[2].col.cast("int")), True)
        if f == "concat":
            return Value(F.concat(*[self._array(x) for x in a]), True)
        if f == "width":
            return Value(F.size(self._array(a[0])).cast("double"))
        if f == "sum":
            return Value(F.aggregate(self._array(a[0]), F.lit(0.0), lambda s, x: s + x))
        if f == "dot":
            return Value(F.aggregate(F.zip_with(self._array(a[0]), self._array(a[1]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
        raise ExpressionError(f"unknown function {f!r}")


def to_column(text: str, scalars: Mapping[str, Column | str] | None = None, vectors: Mapping[str, Column | str] | None = None, window=None, draws=None) -> Column:
    """Compile a text over scalar and array columns."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    names = {k: Value(col(c)) for k, c in (scalars or {}).items()} | {k: Value(col(c), True) for k, c in (vectors or {}).items()}
    names.setdefault("pi", Value(F.lit(math.pi)))
    return Columns(names, window, draws)(parse(text)).col


def keyed_draws(seed: int, *keys: Column):
    """Draws for ``to_column`` by the counter-based columns."""
    from . import rng

    def draw(kind: str, args: list[Value], number: int) -> Column:
        a = [v.col for v in args]
        k = rng.key(seed, *keys, draw=number)
        if kind == "normal":
            return a[0] + a[1] * rng.normal(seed, *keys, draw=1000 + number)
        if kind == "uniform":
            return a[0] + (a[1] - a[0]) * rng.uniform(seed, *keys, draw=number)
        if kind == "exponential":
            return rng.exponential(a[0], seed, *keys, draw=number)
        return {"gamma": rng.gamma, "beta": rng.beta, "binomial": rng.binomial, "poisson": rng.poisson}[kind](*a, k)

    return draw
