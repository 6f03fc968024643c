"""Bayesian inference where any of the evidence may be missing.

A network is a directed graph with a small table for each variable. Rows are reduced to
the distinct combinations of their evidence; for each pattern of known variables the rest
is summed out one by one, in the order that links the fewest neighbours anew (min-fill),
each sum taken as early as its factors allow, without the variables that tell nothing
about the question. All combinations of a pattern are computed together as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventflow.sources.joins import skew_join

#: Cells of all tables together, which travel to each task: 8 MB.
MOST_CELLS = 1_000_000
#: Combinations computed together.
CHUNK = 4_096
_KEY = "__evidence"
_TYPES = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}


@dataclass(frozen=True)
class Variable:
    """P(name | parents): one axis for each parent, the last one for the variable itself."""

    name: str
    parents: tuple[str, ...]
    values: tuple
    table: np.ndarray


Network = dict[str, Variable]


def network(tables: dict[str, tuple[list[str], DataFrame]]) -> Network:
    """From ``{variable: (parents, table)}``, a table having a column per variable and ``p``, as in ``operators.bayes``.

    Combinations a table does not list have probability zero. Tables are bounded by the
    variables' domains, never by the data; too large ones are refused.
    """
    rows, cells = {}, 0
    for name, (parents, table) in tables.items():
        rows[name] = table.select(*parents, name, "p").limit(MOST_CELLS + 1).collect()
        cells += len(rows[name])
        if cells > MOST_CELLS:
            raise ValueError(f"the tables of a network hold at most {MOST_CELLS} cells together")
    values = {name: tuple(sorted({r[name] for r in found})) for name, found in rows.items()}
    out = {}
    for name, (parents, _) in tables.items():
        axes = [*parents, name]
        shape = [len(values[a]) for a in axes]
        if np.prod(shape, dtype=float) > MOST_CELLS:
            raise ValueError(f"the table of {name} holds more than {MOST_CELLS} cells")
        place = {a: {v: i for i, v in enumerate(values[a])} for a in axes}
        table = np.zeros(shape)
        for r in rows[name]:
            if all(r[a] in place[a] for a in axes):
                table[tuple(place[a][r[a]] for a in axes)] = r["p"]
        out[name] = Variable(name, tuple(parents), values[name], table)
    return out


def relevant(net: Network, question: str, known: frozenset[str]) -> set[str]:
    """The question, the evidence and their ancestors: anything else sums to one."""
    found, todo = set(), [question, *known]
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo.extend(net[name].parents)
    return found


def min_fill(scopes: list[set[str]], hidden: set[str]) -> list[str]:
    """The order of elimination: each time the variable whose neighbours lack the fewest links."""
    near: dict[str, set[str]] = {}
    for scope in scopes:
        for name in scope:
            near.setdefault(name, set()).update(scope - {name})
    order = []
    left = set(hidden)

    def missing(name: str) -> tuple[int, int, str]:
        fill = sum(b not in near[a] for a, b in combinations(sorted(near[name]), 2))
        return fill, len(near[name]), name

    while left:
        name = min(left, key=missing)
        for a in near[name]:
            near[a] |= near[name] - {a}
            near[a].discard(name)
        del near[name]
        left.remove(name)
        order.append(name)
    return order


@dataclass
class _Factor:
    """Over ``scope``; with ``rows`` the first axis runs over the combinations."""

    scope: tuple[str, ...]
    rows: bool
    values: np.ndarray


def _product(factors: list[_Factor], keep: tuple[str, ...]) -> _Factor:
    """The product of factors, summed over all variables but ``keep``."""
    letter = {name: i + 1 for i, name in enumerate(sorted({n for f in factors for n in f.scope}))}
    rows = any(f.rows for f in factors)
    args = []
    for f in factors:
        args += [f.values, [*([0] if f.rows else []), *[letter[n] for n in f.scope]]]
    return _Factor(keep, rows, np.einsum(*args, [*([0] if rows else []), *[letter[n] for n in keep]], optimize="greedy"))


def posterior(net: Network, question: str, evidence: dict[str, np.ndarray]) -> np.ndarray:
    """P(question | evidence) for each combination; ``evidence`` has the place of each known value.

    Shape: combinations, values of the question. Rows of impossible evidence are NaN.
    """
    known = frozenset(evidence)
    used = relevant(net, question, known)
    factors = []
    for name in sorted(used):
        axes = (*net[name].parents, name)
        scope = tuple(a for a in axes if a not in known)
        # Known axes to the front, so that the index arrays leave one axis over the combinations there.
        table = np.moveaxis(net[name].table, [i for i, a in enumerate(axes) if a in known], range(len(axes) - len(scope)))
        given = tuple(evidence[a] for a in axes if a in known)
        factors.append(_Factor(scope, bool(given), table[given] if given else table))
    for name in min_fill([set(f.scope) for f in factors], used - known - {question}):
        touching = [f for f in factors if name in f.scope]
        scope = tuple(sorted({n for f in touching for n in f.scope} - {name}))
        factors = [f for f in factors if name not in f.scope]
        factors.append(_product(touching, scope))
    joint = _product(factors, (question,))
    n = len(next(iter(evidence.values()))) if evidence else 1
    values = joint.values if joint.rows else np.broadcast_to(joint.values, (n, len(joint.values)))
    total = values.sum(axis=1, keepdims=True)
    return np.divide(values, total, out=np.full(values.shape, np.nan), where=total > 0)


def _posteriors(net: Network, question: str, columns: list[str], rows: pd.DataFrame) -> np.ndarray:
    """Row by row, grouped by which evidence is known."""
    out = np.full((len(rows), len(net[question].values)), np.nan)
    place = {c: {v: i for i, v in enumerate(net[c].values)} for c in columns}
    codes = np.array([[-2 if v is None else place[c].get(v, -1) for v in rows[c]] for c in columns]).reshape(len(columns), -1)
    # A value the network does not know has no posterior.
    possible = (codes != -1).all(axis=0)
    patterns, of_row = np.unique(codes != -2, axis=1, return_inverse=True)
    for number, pattern in enumerate(patterns.T):
        at = np.flatnonzero((of_row.reshape(-1) == number) & possible)
        if len(at):
            out[at] = posterior(net, question, {c: codes[i, at] for i, c in enumerate(columns) if pattern[i]})
    return out


def infer(df: DataFrame, net: Network, question: str, evidence: list[str], into: str = "value") -> DataFrame:
    """Rows of ``df`` with the posterior of ``question``: one row per value, in ``into``, and ``p``.

    NULL evidence is unknown evidence. Evidence that the network deems impossible, or
    values it does not know, give one row with NULL in both. Each distinct combination is computed
    once, in the task that holds it; a combination that many rows share is split when they are joined.
    """
    key = F.struct(F.lit(0).alias("_"), *evidence).alias(_KEY)
    kind = df.select(key).schema[0].dataType
    values = net[question].values
    value_type = next(t for kind_of, t in _TYPES.items() if isinstance(values[0], kind_of))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kind if f.name != "_"], T.StructField(into, value_type), T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), CHUNK):
                rows = batch.iloc[low : low + CHUNK].astype(object)
                rows = rows.where(rows.notna(), None).reset_index(drop=True)
                p = _posteriors(net, question, evidence, rows)
                found = rows.loc[np.repeat(np.arange(len(rows)), len(values))].reset_index(drop=True)
                found[into], found["p"] = list(values) * len(rows), p.reshape(-1)
                yield found[found["p"].notna()]

    table = df.select(*evidence).distinct().mapInPandas(run, schema).select(key, into, "p")
    return skew_join(df.withColumn(_KEY, key), table, [_KEY], "left").drop(_KEY)
