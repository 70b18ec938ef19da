"""Small arrays of (population, population, block), and what is done to them row by row."""
from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import numpy as np


def pair_rows(a: np.ndarray, diag: bool = True) -> np.ndarray:
    """pops x pops x blocks -> lower-triangle pairs x blocks, pairs in the order of the first, then the second population."""
    i, j = np.triu_indices(a.shape[0], 0 if diag else 1)
    return a[i, j]


def from_pair_rows(rows: np.ndarray, pops: int, diag: bool = True) -> np.ndarray:
    """The inverse, symmetric; without diag it is 0."""
    out = np.zeros((pops, pops, rows.shape[1]))
    i, j = np.triu_indices(pops, 0 if diag else 1)
    out[i, j] = out[j, i] = rows
    return out


def as_matrix(a: np.ndarray) -> np.ndarray:
    """i x j x k -> (i j) x k, the first index fastest."""
    return a.transpose(1, 0, 2).reshape(-1, a.shape[2])


def as_array(m: np.ndarray, dim1: int) -> np.ndarray:
    return m.reshape(-1, dim1, m.shape[1]).transpose(1, 0, 2)


def outer_array(x: np.ndarray, y: np.ndarray, f: Callable = np.multiply) -> np.ndarray:
    """n x i and n x j -> i x j x n: f of each two columns, row by row (np.multiply, np.add, np.subtract, ...)."""
    return f(x.T[:, None, :], y.T[None, :, :])


def row_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """n x k, n x k -> n: sums of products, missing cells left out."""
    return np.nansum(x * y, axis=1)


def repeat_each(m: np.ndarray, times: int) -> np.ndarray:
    """Columns, each so many times."""
    return np.repeat(m, times, axis=1)


def repeat_all(m: np.ndarray, times: int) -> np.ndarray:
    """All columns, so many times."""
    return np.tile(m, (1, times))


def diagonal(a: np.ndarray) -> np.ndarray:
    """pops x pops x blocks -> pops x blocks."""
    return np.einsum("iik->ik", a)


def interleave(x: Iterable, y: Iterable) -> list:
    return [v for pair in itertools.zip_longest(x, y, fillvalue=...) for v in pair if v is not ...]


def finite(a: np.ndarray) -> np.ndarray:
    """Values that aren't finite as missing ones."""
    return np.where(np.isfinite(a), a, np.nan)


def chunks(n: int, rows: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most so many rows."""
    return [(s, min(n, s + rows)) for s in range(0, n, rows)]


def quad_means(p: np.ndarray, combs: np.ndarray, product: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Numerators of f4 or D, summed over variants: p is pops x variants with missing cells, combs rows of four populations; gives
    sums and numbers of complete variants. Missing cells count as nothing, so a combination is one sum of products and nothing of
    combinations x variants is held."""
    known = np.isfinite(p)
    x = np.where(known, p, 0.0)
    out, n = np.zeros(len(combs)), np.zeros(len(combs), np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (a, b, *_) in enumerate(combs):
        groups.setdefault((int(a), int(b)), []).append(k)
    for (a, b), rows in groups.items():
        both = known[a] & known[b]
        d = np.where(both, x[a] - x[b], 0.0)
        c, e = combs[rows, 2], combs[rows, 3]
        ok = known[c] & known[e] & both
        out[rows] = ((x[c] - x[e]) * ok) @ d if product else (ok * np.abs(x[c] - x[e])) @ np.abs(d)
        n[rows] = ok.sum(1)
    return out, n
