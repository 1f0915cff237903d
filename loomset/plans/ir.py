"""Plans of operator trees as data: JSON for other programs, indented text for people.  Making one computes nothing."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from ..functions.aggregates import AggregationFunction
from ..functions.predicates import Predicate
from ..model import AttributeFunction, Database, JoinPredicate, Relation
from ..operators.base import Operator

VERSION = 1


@dataclass(frozen=True)
class Opaque:
    """Something a plan cannot hold, such as a Python function; its text is only kept on request, as it may hold secrets."""

    reason: str
    text: str | None = None

    def to_dict(self) -> dict[str, Any]:
        return {"$": "opaque", "reason": self.reason} | ({"text": self.text} if self.text else {})

    def __str__(self) -> str:
        return f"<{self.reason}>"


@dataclass(frozen=True)
class Leaf:
    """An input of the plan."""

    kind: str
    name: str | None
    uuid: int | None = None
    key: tuple[str, ...] = ()

    def to_dict(self) -> dict[str, Any]:
        return {"$": "leaf", "kind": self.kind, "name": self.name, "uuid": self.uuid, "key": list(self.key)}


@dataclass(frozen=True)
class Node:
    op: str
    inputs: tuple[Any, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)

    def to_dict(self) -> dict[str, Any]:
        return {"$": "node", "op": self.op, "inputs": [i.to_dict() for i in self.inputs], "params": {k: _dump(v) for k, v in self.params.items()}}


@dataclass(frozen=True)
class LogicalPlan:
    root: Any

    def to_dict(self) -> dict[str, Any]:
        return {"version": VERSION, "root": self.root.to_dict()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)

    @staticmethod
    def from_dict(data: Mapping[str, Any]) -> LogicalPlan:
        if data.get("version", VERSION) != VERSION:
            raise ValueError(f"plan version {data['version']!r} is not {VERSION}")
        return LogicalPlan(_load(data["root"]))

    @staticmethod
    def from_json(text: str) -> LogicalPlan:
        return LogicalPlan.from_dict(json.loads(text))

    def explain(self) -> str:
        lines: list[str] = []

        def show(node: Any, depth: int) -> None:
            pad = "  " * depth + "- "
            if isinstance(node, Leaf):
                lines.append(f"{pad}leaf {node.kind} {node.name or '?'}")
                return
            lines.append(f"{pad}{node.op}({', '.join(f'{k}={v}' for k, v in node.params.items())})")
            for i in node.inputs:
                show(i, depth + 1)

        show(self.root, 0)
        return "\n".join(lines)


def _dump(value: Any) -> Any:
    if isinstance(value, (Opaque, Leaf, Node, Predicate, AggregationFunction)):
        found = value.to_dict()
        return found if "$" in found else {"$": found.pop("type"), **found}
    if isinstance(value, (list, tuple)):
        return [_dump(v) for v in value]
    if isinstance(value, Mapping):
        return {"$": "map", "entries": {str(k): _dump(v) for k, v in value.items()}}
    return value


def _load(data: Any) -> Any:
    if isinstance(data, list):
        return [_load(v) for v in data]
    if not isinstance(data, dict):
        return data
    kind, rest = data.get("$"), {k: v for k, v in data.items() if k != "$"}
    if kind == "node":
        return Node(rest["op"], tuple(map(_load, rest["inputs"])), {k: _load(v) for k, v in rest["params"].items()})
    if kind == "leaf":
        return Leaf(rest["kind"], rest["name"], rest["uuid"], tuple(rest["key"]))
    if kind == "opaque":
        return Opaque(rest["reason"], rest.get("text"))
    if kind == "predicate":
        return Predicate.from_dict({"type": "predicate", **rest})
    if kind == "map":
        return {k: _load(v) for k, v in rest["entries"].items()}
    if kind == "aggregate":
        from ..functions import aggregates

        made = getattr(aggregates, rest["op"], None)
        return made(rest["attribute"]) if made not in (None, AggregationFunction) else Opaque("aggregate")
    raise ValueError(f"unknown entry {kind!r} in a plan")


def _param(value: Any, keep_text: bool) -> Any:
    if value is None or isinstance(value, (bool, int, float, str, Predicate)):
        return value
    if isinstance(value, AggregationFunction):
        return value if value.function is None else Opaque("callable", repr(value.function) if keep_text else None)
    if isinstance(value, (list, tuple, set, frozenset)):
        return [_param(v, keep_text) for v in value]
    if isinstance(value, Mapping):
        return {str(k): _param(v, keep_text) for k, v in value.items()}
    if isinstance(value, (Operator, AttributeFunction)):
        return _node(value, keep_text)
    reason = "column" if isinstance(value, Column) else "join predicate" if isinstance(value, JoinPredicate) else "callable" if callable(value) else type(value).__name__
    return Opaque(reason, repr(value) if keep_text else None)


def _node(value: Any, keep_text: bool) -> Any:
    if isinstance(value, Operator):
        return Node(type(value).__name__, (_node(value.source, keep_text),), {k: _param(v, keep_text) for k, v in value.plan_params().items()})
    if isinstance(value, Relation):
        return Leaf("relation", value.name, value.uuid, value.key)
    if isinstance(value, Database):
        value = value.bound()
        return Node("bind", tuple(_node(r, keep_text) for r in value.values()), {"names": list(value)})
    if isinstance(value, Mapping):
        return Node("bind", tuple(_node(r, keep_text) for r in value.values()), {"names": list(value)})
    if isinstance(value, AttributeFunction):
        return Leaf(type(value).__name__.lower(), None)
    return Node("literal", (), {"value": _param(value, keep_text)})


def extract(value: Any, keep_text: bool = False) -> LogicalPlan:
    """Plan of an operator, a relation, a database or a dict of them."""
    return LogicalPlan(_node(value, keep_text))
