"""Rewrite nodes: how a value becomes a target value, and where it can be lost.

A node is a function from a source Column to a target Column, with the sites at which it loses or
changes something. A site counts its offenders in a source Column, so the same node serves the
projection, the dry run and the refusal. Nodes nest: a container lifts the node of its elements into
``transform`` and adds up their counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from driftloom.plans.directives import DROP_RECORD, FAIL, policy_name

Fn = Callable[[Column], Column]
#: Written in reports between source and target types.
ARROW = "→"


class Refused(ValueError):
    """A migration that cannot be carried out as asked; ``problems`` has every reason found."""

    def __init__(self, problems: list[str] | str):
        self.problems = [problems] if isinstance(problems, str) else list(problems)
        super().__init__("\n".join(self.problems))


@dataclass(frozen=True)
class Site:
    """``count`` gives the number of offenders in a source value; ``acts`` is false where the site
    only reports (a value changes, but no policy decides on it)."""

    path: str
    op: str
    policy: Any
    count: Fn
    acts: bool = True
    after: Fn | None = None

    @property
    def drops(self) -> bool:
        return self.acts and self.policy == DROP_RECORD

    @property
    def fails(self) -> bool:
        return self.acts and self.policy in (None, FAIL)

    @property
    def policy_name(self) -> str:
        return policy_name(self.policy) if self.acts else "report"


@dataclass(frozen=True)
class Node:
    value: Fn
    sites: tuple[Site, ...] = ()
    identity: bool = False
    #: Python row function of a scalar node that Columns cannot express; see ``python_node``.
    python: Callable | None = None
    python_type: S.DataType | None = None
    extra: dict = field(default_factory=dict)

    def at(self, prefix: Fn) -> Node:
        """The node on a part of a value."""
        if self.identity:
            return Node(prefix, identity=False)
        return Node(lambda c: self.value(prefix(c)), tuple(replace(s, count=_compose(s.count, prefix), after=_compose(s.after, prefix)) for s in self.sites))


def _compose(f: Fn | None, prefix: Fn) -> Fn | None:
    return None if f is None else lambda c: f(prefix(c))


IDENTITY = Node(lambda c: c, identity=True)


def one(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def guarded(value: Fn, sites: tuple[Site, ...]) -> Node:
    """A node that leaves nil alone."""
    return Node(lambda c: F.when(c.isNotNull(), value(c)), tuple(
        replace(s, count=(lambda f: lambda c: F.when(c.isNotNull(), f(c)).otherwise(F.lit(0).cast("long")))(s.count)) for s in sites))


def summed(counts: Column) -> Column:
    return F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0).cast("long"))), F.lit(0).cast("long"))


def lifted(node: Node, values: Callable[[Column, Fn], Column], parts: Fn) -> Node:
    """A node over the elements of a container: ``values`` rebuilds it with a function applied to
    each element, ``parts`` gives the elements as an array."""
    if node.identity:
        return IDENTITY
    if node.python is not None:
        raise Refused("a Python conversion inside this container is not supported")
    sites = tuple(replace(s, count=(lambda f: lambda c: summed(F.transform(parts(c), f)))(s.count), after=None) for s in node.sites)
    return Node(lambda c: values(c, node.value), sites)


def over_array(node: Node) -> Node:
    if node.python is not None:
        return python_array(node)
    return lifted(node, lambda c, f: F.transform(c, f), lambda c: c)


def python_node(fn: Callable, target: S.DataType) -> Node:
    """A scalar conversion by an Arrow UDF, for what Columns cannot express exactly."""
    @F.pandas_udf(target)
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else fn(v))

    # SQL nulls reach the UDF as NaN and must not be printed.
    return Node(lambda c: F.when(c.isNotNull(), convert(c)), python=fn, python_type=target)


def python_array(node: Node) -> Node:
    """The same over whole arrays: Python cannot run inside a lambda."""
    fn = node.python

    @F.pandas_udf(S.ArrayType(node.python_type))
    def convert(x: pd.Series) -> pd.Series:
        return x.map(lambda a: None if a is None else [None if v is None else fn(v) for v in a])

    return Node(lambda c: F.when(c.isNotNull(), convert(c)))


def decided(path: str, op: str, policy: Any, offends: Fn, exact: Fn, target: S.DataType, saturated: Fn | None = None, more: tuple[Site, ...] = ()) -> Node:
    """A lossy conversion: ``exact`` for values that do not offend, the policy for those that do."""
    if isinstance(policy, tuple) and policy[0] == "default":
        value = lambda c: F.when(offends(c), F.lit(policy[1]).cast(target)).otherwise(exact(c))
    elif policy == "saturate":
        if saturated is None:
            raise Refused(f"[policy] {path}: saturate does not apply to {op}")
        value = lambda c: F.when(offends(c), saturated(c)).otherwise(exact(c))
    elif policy in (None, FAIL, DROP_RECORD):
        value = lambda c: F.when(~offends(c), exact(c))
    else:
        raise Refused(f"[policy] {path}: {policy_name(policy)} does not apply to {op}")
    return guarded(value, (*more, Site(path, op, policy, lambda c: one(offends(c)), after=value)))
