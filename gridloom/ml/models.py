"""Kernels with weights, in numpy over Arrow batches: one crossing into Python for a whole stack of layers.

A kernel maps a matrix (rows x width) to another. ``apply`` turns any of them into a Column; its weights travel with
the function, once a task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


class Kernel:
    """A function of row vectors; ``cost`` is multiplications a row."""

    width: int | None = None  # of the result, if it doesn't depend on the input

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def cost(self, width: int) -> float:
        return float(width)

    def out_width(self, width: int) -> int:
        return self.width or width


@dataclass(frozen=True, eq=False)
class MatMul(Kernel):
    weights: np.ndarray

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    def __call__(self, x):
        return x @ self.weights

    def cost(self, width):
        return float(self.weights.size)


@dataclass(frozen=True, eq=False)
class SparseMatMul(Kernel):
    """MatMul over the weights that aren't 0."""

    weights: np.ndarray

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    def __call__(self, x):
        out = np.zeros((len(x), self.weights.shape[1]))
        for j in range(self.weights.shape[1]):
            some = np.flatnonzero(self.weights[:, j])
            out[:, j] = x[:, some] @ self.weights[some, j]
        return out

    def cost(self, width):
        return float(np.count_nonzero(self.weights)) * 1.5


@dataclass(frozen=True, eq=False)
class Bias(Kernel):
    bias: np.ndarray

    def __call__(self, x):
        return x + self.bias


class Relu(Kernel):
    def __call__(self, x):
        return np.maximum(x, 0)


class Sigmoid(Kernel):
    def __call__(self, x):
        return 1 / (1 + np.exp(-x))


class Softmax(Kernel):
    def __call__(self, x):
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class Argmax(Kernel):
    width = 1

    def __call__(self, x):
        return x.argmax(axis=1)[:, None].astype(float)


@dataclass(frozen=True, eq=False)
class BatchNorm(Kernel):
    """With statistics that were worked out before: inference."""

    mean: np.ndarray
    variance: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray
    epsilon: float = 1e-5

    def __call__(self, x):
        return (x - self.mean) / np.sqrt(self.variance + self.epsilon) * self.gamma + self.beta


@dataclass(frozen=True, eq=False)
class Conv2d(Kernel):
    """Valid convolution of channels-first images given as flat rows: filters (out, in, height, width)."""

    shape: tuple[int, int, int]
    filters: np.ndarray
    stride: int = 1

    def _out(self) -> tuple[int, int]:
        return (self.shape[1] - self.filters.shape[2]) // self.stride + 1, (self.shape[2] - self.filters.shape[3]) // self.stride + 1

    @property
    def width(self) -> int:
        return self.filters.shape[0] * self._out()[0] * self._out()[1]

    def __call__(self, x):
        images = x.reshape(-1, *self.shape)
        windows = np.lib.stride_tricks.sliding_window_view(images, self.filters.shape[2:], axis=(2, 3))[:, :, :: self.stride, :: self.stride]
        return np.einsum("ncyxhw,ochw->noyx", windows, self.filters).reshape(len(x), -1)

    def cost(self, width):
        return float(self.filters.size * self._out()[0] * self._out()[1])


@dataclass(frozen=True, eq=False)
class MaxPool(Kernel):
    shape: tuple[int, int, int]
    size: int

    @property
    def width(self) -> int:
        return self.shape[0] * (self.shape[1] // self.size) * (self.shape[2] // self.size)

    def __call__(self, x):
        c, h, w = self.shape
        n = self.size
        cut = x.reshape(-1, c, h, w)[:, :, : h // n * n, : w // n * n]
        return cut.reshape(-1, c, h // n, n, w // n, n).max(axis=(3, 5)).reshape(len(x), -1)


@dataclass(frozen=True, eq=False)
class Stack(Kernel):
    """Layers in one: the batch crosses into Python once."""

    layers: tuple[Kernel, ...]

    def __call__(self, x):
        for layer in self.layers:
            x = layer(x)
        return x

    def cost(self, width):
        spent = 0.0
        for layer in self.layers:
            spent += layer.cost(width)
            width = layer.out_width(width)
        return spent

    def out_width(self, width):
        for layer in self.layers:
            width = layer.out_width(width)
        return width


class NNBuilder:
    """``NNBuilder().dense(w, b).relu().dense(w2).softmax().build()`` is one Stack."""

    def __init__(self):
        self.layers: list[Kernel] = []

    def _add(self, *layers: Kernel) -> NNBuilder:
        self.layers += layers
        return self

    def dense(self, weights: np.ndarray, bias: np.ndarray | None = None) -> NNBuilder:
        return self._add(MatMul(np.asarray(weights, float)), *([] if bias is None else [Bias(np.asarray(bias, float))]))

    def conv(self, shape, filters, stride=1) -> NNBuilder:
        return self._add(Conv2d(tuple(shape), np.asarray(filters, float), stride))

    def pool(self, shape, size) -> NNBuilder:
        return self._add(MaxPool(tuple(shape), size))

    def batch_norm(self, mean, variance, gamma, beta) -> NNBuilder:
        return self._add(BatchNorm(*(np.asarray(v, float) for v in (mean, variance, gamma, beta))))

    def relu(self) -> NNBuilder:
        return self._add(Relu())

    def sigmoid(self) -> NNBuilder:
        return self._add(Sigmoid())

    def softmax(self) -> NNBuilder:
        return self._add(Softmax())

    def argmax(self) -> NNBuilder:
        return self._add(Argmax())

    def build(self) -> Stack:
        return Stack(tuple(self.layers))


@dataclass(frozen=True, eq=False)
class Tree(Kernel):
    """A binary decision tree in arrays; at a node, x[feature] < cut goes left, NaN goes to ``other``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    other: np.ndarray
    leaf: np.ndarray
    width: int = field(default=1)

    @classmethod
    def parse(cls, text: str) -> Tree:
        """From a dump of a boosted tree, as text or as a graph.

        Text has a line a node, ``0:[f2<1.5] yes=1,no=2,missing=1`` or ``1:leaf=0.3``. A graph has ``0 [ label="f2<1.5" ]``
        or ``1 [ label="leaf=0.3" ]`` for nodes and ``0 -> 1 [label="yes, missing"]`` for what follows them; where no
        edge says so, a missing value goes right.
        """
        nodes = cls._of_graph(text) if "->" in text or "graph" in text or re.search(r"\[\s*label", text) else cls._of_lines(text)
        rows = [nodes.get(i, (-1, 0.0, 0, 0, 0, 0.0)) for i in range(max(nodes) + 1)]
        return cls(*(np.array(c) for c in zip(*rows, strict=True)))

    @staticmethod
    def _of_lines(text: str) -> dict[int, tuple]:
        nodes = {}
        for line in filter(None, map(str.strip, text.splitlines())):
            if m := re.match(r"(\d+):leaf=([-+\d.eE]+)", line):
                nodes[int(m[1])] = (-1, 0.0, 0, 0, 0, float(m[2]))
            elif m := re.match(r"(\d+):\[f?(\d+)<([-+\d.eE]+)\]\s*yes=(\d+),no=(\d+)(?:,missing=(\d+))?", line):
                nodes[int(m[1])] = (int(m[2]), float(m[3]), int(m[4]), int(m[5]), int(m[6] or m[5]), 0.0)
            else:
                raise ValueError(f"not a node of a tree: {line}")
        return nodes

    @staticmethod
    def _of_graph(text: str) -> dict[int, tuple]:
        labels, edges = {}, {}
        for line in filter(None, map(str.strip, text.splitlines())):
            if m := re.match(r'(\d+)\s*->\s*(\d+)\s*\[\s*label="([^"]*)"', line):
                for word in filter(None, re.split(r"[,\s]+", m[3])):
                    edges[int(m[1]), word] = int(m[2])
            elif m := re.match(r'(\d+)\s*\[\s*label="([^"]*)"', line):
                labels[int(m[1])] = m[2]
            elif not re.match(r"digraph\b|graph\b|\}|//", line):
                raise ValueError(f"not a line of a tree's graph: {line}")
        nodes = {}
        for i, label in labels.items():
            if m := re.fullmatch(r"leaf=([-+\d.eE]+)", label):
                nodes[i] = (-1, 0.0, 0, 0, 0, float(m[1]))
            elif (m := re.fullmatch(r"f?(\d+)<([-+\d.eE]+)", label)) and (i, "yes") in edges and (i, "no") in edges:
                nodes[i] = (int(m[1]), float(m[2]), edges[i, "yes"], edges[i, "no"], edges.get((i, "missing"), edges[i, "no"]), 0.0)
            else:
                raise ValueError(f"not a whole node of a tree's graph: {i} {label}")
        return nodes

    def __call__(self, x):
        at = np.zeros(len(x), int)
        for _ in range(len(self.feature)):
            inner = self.feature[at] >= 0
            if not inner.any():
                break
            value = x[np.arange(len(x)), np.maximum(self.feature[at], 0)]
            down = np.where(np.isnan(value), self.other[at], np.where(value < self.cut[at], self.left[at], self.right[at]))
            at = np.where(inner, down, at)
        return self.leaf[at][:, None]

    def cost(self, width):
        return float(np.log2(len(self.feature) + 1)) * 4


@dataclass(frozen=True, eq=False)
class Forest(Kernel):
    """The mean of trees' leaves; for classification, 1 if it is above 0."""

    trees: tuple[Tree, ...]
    classification: bool = False
    width: int = field(default=1)

    def __call__(self, x):
        mean = sum(t(x) for t in self.trees) / len(self.trees)
        return (mean > 0).astype(float) if self.classification else mean

    def cost(self, width):
        return sum(t.cost(width) for t in self.trees)


@dataclass(frozen=True, eq=False)
class Boosted(Kernel):
    """The sum of trees' leaves and a base score, through a sigmoid for a binary objective."""

    trees: tuple[Tree, ...]
    base: float = 0.0
    binary: bool = False
    width: int = field(default=1)

    def __call__(self, x):
        score = sum(t(x) for t in self.trees) + self.base
        return 1 / (1 + np.exp(-score)) if self.binary else score

    def cost(self, width):
        return sum(t.cost(width) for t in self.trees)


def matrix(column: pa.Array) -> np.ndarray:
    """A list array without null lists as rows of a matrix; null elements are NaN."""
    column = column.cast(pa.list_(pa.float64()))
    return pc.fill_null(column.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def apply(kernel: Kernel, column: Column) -> Column:
    """The kernel over a vector column; null vectors give null."""

    def run(x: pa.Array) -> pa.Array:
        some = x.is_valid().to_numpy(zero_copy_only=False)
        made = np.asarray(kernel(matrix(x.drop_null())), float) if some.any() else np.zeros((0, 0))
        ends = np.concatenate([[0], np.cumsum(np.where(some, made.shape[1], 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(made.ravel()), mask=pa.array(~some))

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<double>")(column.cast("array<double>"))


def scalar(kernel: Kernel, column: Column) -> Column:
    """As ``apply``, for kernels with one output."""
    return F.element_at(apply(kernel, column), 1)


def blocks(weights: np.ndarray, size: int) -> Sequence[tuple[int, int, np.ndarray]]:
    """(row block, column block, part) of a matrix."""
    rows, columns = weights.shape
    return [(i // size, j // size, weights[i : i + size, j : j + size]) for i in range(0, rows, size) for j in range(0, columns, size)]
