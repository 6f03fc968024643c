"""A workflow as plain Python: named sources, agents in order, named targets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventflow.functions.conditions import holds
from eventflow.operators.checks import IDENTIFIER


@dataclass(frozen=True)
class Agent:
    """``run`` gets the inputs in order and returns a DataFrame.

    An input is a source's name or an earlier agent's id. ``when`` lets only
    matching rows of the first input through.
    """

    id: str
    run: Callable[..., DataFrame]
    inputs: tuple[str, ...] = ("source",)
    when: str | None = None


@dataclass
class Workflow:
    """Builds one lazy DataFrame per agent; Spark plans and runs them."""

    name: str
    agents: list[Agent] = field(default_factory=list)
    preprocessors: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def agent(self, id: str, run: Callable[..., DataFrame], *inputs: str, when: str | None = None) -> Workflow:
        """Add an agent; without ``inputs`` it reads the agent before it."""
        before = self.agents[-1].id if self.agents else "source"
        self.agents.append(Agent(id, run, inputs or (before,), when))
        return self

    def problems(self, sources: list[str]) -> list[str]:
        """Everything wrong with the definition, as texts; empty if it can run."""
        found = [] if re.match(IDENTIFIER, self.name) else [f"'{self.name}' is not an identifier"]
        if not sources:
            found.append("a workflow needs a source")
        known = set(sources)
        for a in self.agents:
            if not a.id:
                found.append("every agent needs an id")
            elif a.id in known:
                found.append(f"duplicate agent id: {a.id}")
            found += [f"agent {a.id} reads unknown input {i}" for i in a.inputs if i not in known]
            known.add(a.id)
        return found

    def run(self, **sources: DataFrame) -> dict[str, DataFrame]:
        """Results of all agents by id."""
        found = self.problems(list(sources))
        if found:
            raise ValueError("; ".join(found))
        results = dict(sources)
        for step in self.preprocessors:
            results["source"] = results["source"].transform(step)
        for a in self.agents:
            first, *others = (results[i] for i in a.inputs)
            if a.when is not None:
                first = first.where(holds(a.when))
            results[a.id] = a.run(first, *others)
        return {a.id: results[a.id] for a in self.agents}


def to_targets(df: DataFrame, targets: list[str], topic: str = "topic") -> dict[str, DataFrame]:
    """One view per target over a result that carries a ``topic`` column."""
    return {name: df.where(F.col(topic) == name) for name in targets}
