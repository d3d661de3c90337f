"""Similarity of texts and word lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlink.functions.normalize import words


def _sets(a: Column, b: Column) -> tuple[Column, Column, Column]:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def dice(a: Column, b: Column) -> Column:
    """Twice the common words by all words; 0 where either has none."""
    n, x, y = _sets(a, b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(2.0 * n / (x + y))


def containment(a: Column, b: Column) -> Column:
    """Share of the first's words that the second has."""
    n, x, y = _sets(a, b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(n / x)


def jaccard(a: Column, b: Column) -> Column:
    n, x, y = _sets(a, b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(n / (x + y - n))


def overlap(a: Column, b: Column) -> Column:
    """Common words by the longer list."""
    n, x, y = _sets(a, b)
    return F.when((x == 0) | (y == 0), 0.0).otherwise(n / F.greatest(x, y))


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Jaro-Winkler with prefixes up to 4 at 0.1, always applied; swapped letters count half each, unrounded."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, one a row, and their lengths."""
    size = np.array([len(t) for t in texts])
    width = max(1, int(size.max(initial=0)))
    padded = "".join(t.ljust(width, "\0") for t in texts)
    return np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), width), size


def jaro_winkler_block(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler_of for pairs of texts that aren't empty, all at once: one step for each letter of the longest."""
    (x, nx), (y, ny) = _codes(a), _codes(b)
    reach = np.maximum(0, np.maximum(nx, ny) // 2 - 1)[:, None]
    at, column = np.arange(len(a)), np.arange(y.shape[1])[None, :]
    hit, taken = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
    for i in range(x.shape[1]):
        fits = (y == x[:, i : i + 1]) & ~taken & (np.abs(column - i) <= reach) & (column < ny[:, None]) & (i < nx)[:, None]
        first = fits.argmax(axis=1)
        found = fits[at, first]
        hit[:, i] = found
        taken[at[found], first[found]] = True
    m = hit.sum(axis=1)
    order = lambda mask: np.argsort(~mask, axis=1, kind="stable")[:, : int(m.max(initial=0))]
    left, right = np.take_along_axis(x, order(hit), axis=1), np.take_along_axis(y, order(taken), axis=1)
    swaps = ((left != right) & (np.arange(left.shape[1])[None, :] < m[:, None])).sum(axis=1) / 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / nx + m / ny + (m - swaps) / some) / 3, 0.0)
    w = min(4, x.shape[1], y.shape[1])
    same = (x[:, :w] == y[:, :w]) & (np.arange(w)[None, :] < np.minimum(nx, ny)[:, None])
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(m > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)


#: Letters of a text beyond which its pairs are compared one by one, so that a block's table stays small.
WIDEST = 256


def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a))
    x, y = a.fillna("").to_list(), b.fillna("").to_list()
    usual = [i for i, (s, t) in enumerate(zip(x, y)) if s and t and max(len(s), len(t)) <= WIDEST]
    for k in range(0, len(usual), 4096):
        part = usual[k : k + 4096]
        out[part] = jaro_winkler_block([x[i] for i in part], [y[i] for i in part])
    for i, (s, t) in enumerate(zip(x, y)):
        if max(len(s), len(t)) > WIDEST:
            out[i] = jaro_winkler_of(s, t)
    return pd.Series(out)


def jaro_winkler(a: Column, b: Column) -> Column:
    """In Arrow batches; give it distinct pairs."""
    return F.pandas_udf(_jaro_winkler, "double")(a, b)


def _per_pair(a: pa.Array, b: pa.Array, rates) -> list[np.ndarray]:
    """What ``rates`` gives for the distinct pairs of an Arrow batch, laid out for all pairs again; a missing text is ''."""
    x, y = (pc.fill_null(t, "").dictionary_encode() for t in (a, b))
    wide = max(1, len(y.dictionary))
    once, back = np.unique(x.indices.to_numpy().astype(np.int64) * wide + y.indices.to_numpy(), return_inverse=True)
    left, right = x.dictionary.to_pylist(), y.dictionary.to_pylist()
    return [v[back] for v in rates([left[k] for k in once // wide], [right[k] for k in once % wide])]


def _rates(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Jaro-Winkler, dice and containment of each pair."""
    sets = {t: frozenset(w for w in t.split(" ") if w) for t in {*a, *b}}
    common = np.array([len(sets[s] & sets[t]) for s, t in zip(a, b)], dtype=float)
    x, y = (np.array([len(sets[t]) for t in side], dtype=float) for side in (a, b))
    some = (x > 0) & (y > 0)
    return _jaro_winkler(pd.Series(a, dtype=object), pd.Series(b, dtype=object)).to_numpy(), np.where(some, 2.0 * common / np.maximum(1, x + y), 0.0), np.where(some, common / np.maximum(1, x), 0.0)


def _candidate_rates(name: pa.Array, names: pa.Array, city: pa.Array, c_city: pa.Array, street: pa.Array, c_street: pa.Array) -> pa.Array:
    of, flat = pc.list_parent_indices(names).to_numpy(), pc.list_flatten(names)
    jw, dice_, within = _per_pair(name.take(pa.array(of)), flat, _rates)
    best = np.full(len(name), -1.0)
    np.maximum.at(best, of, np.clip(0.45 * jw + 0.45 * dice_ + 0.10 * within, 0.0, 1.0))
    jw, dice_, _ = _per_pair(city, c_city, _rates)
    town = np.maximum(jw, dice_)
    jw, dice_, _ = _per_pair(street, c_street, _rates)
    way = np.clip(0.5 * jw + 0.5 * dice_, 0.0, 1.0)
    none = lambda c: pc.equal(pc.fill_null(c, ""), "").to_numpy(zero_copy_only=False)
    return pa.StructArray.from_arrays([pa.array(best, mask=none(name) | (best < 0)), pa.array(town, mask=none(city) | none(c_city)), pa.array(way, mask=none(street) | none(c_street))], names=["name", "city", "street"])


def candidate_rates(name: Column, names: Column, city: Column, c_city: Column, street: Column, c_street: Column) -> Column:
    """How alike a row and a candidate are: ``name`` (the best of the candidate's), ``city``, ``street``, all in normal form.

    Null where one side has none. In Arrow batches, each distinct pair of texts of a batch once: no shuffle of texts.
    """
    return F.arrow_udf(_candidate_rates, "name double, city double, street double")(name, names, city, c_city, street, c_street)


def legal_family(c: Column) -> Column:
    """The family of legal forms that a text names, in this order of precedence."""
    from ledgerlink.functions.normalize import alnum

    t = alnum(c)
    return (
        F.when(t.rlike(r"\bSASU?\b"), "SAS_FAMILY").when(t.rlike(r"\b(SARL|EURL|SARLU)\b"), "SARL_FAMILY").when(t.rlike(r"\bSA\b|\bSOCIETE ANONYME\b"), "SA")
        .when(t.rlike(r"\bSCI\b"), "SCI").when(t.rlike(r"\b(EI|EIRL)\b|\bENTREPRENEUR INDIVIDUEL\b"), "EI").otherwise("")
    )
