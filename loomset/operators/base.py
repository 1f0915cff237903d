"""What all operators share: one input, lazy results, a plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, ClassVar

_UNSET = object()


class _WithFactory(type):
    """Every operator takes ``output_factory``, which turns its result into another type."""

    def __call__(cls, *args: Any, output_factory: Callable[[Any], Any] | None = None, **options: Any) -> Any:
        made = super().__call__(*args, **options)
        made.output_factory = output_factory
        return made


class Operator(metaclass=_WithFactory):
    """Takes one function (a relation, a database, or another operator) and gives one.

    ``.result``, or calling the operator, builds the output once; nothing is computed before a Spark action on it.
    """

    output_factory: Callable[[Any], Any] | None = None

    #: Names of the attributes that describe the operator in a plan.
    params: ClassVar[tuple[str, ...]] = ()

    def __init__(self, source: Any):
        self.source = source
        self._result: Any = _UNSET

    @property
    def input(self) -> Any:
        return self.source.result if isinstance(self.source, Operator) else self.source

    @property
    def result(self) -> Any:
        if self._result is _UNSET:
            made = self.compute()
            self._result = self.output_factory(made) if self.output_factory else made
        return self._result

    def __call__(self) -> Any:
        return self.result

    def compute(self) -> Any:
        raise NotImplementedError

    def plan_params(self) -> dict[str, Any]:
        return {name: getattr(self, name) for name in self.params}

    def to_plan(self) -> Any:
        from ..plans.ir import extract

        return extract(self)

    def explain(self) -> str:
        return self.to_plan().explain()


def relation_of(value: Any) -> Any:
    from ..model import Relation

    if not isinstance(value, Relation):
        raise TypeError(f"a relation is needed, not {type(value).__name__}")
    return value


def database_of(value: Any) -> Any:
    from ..model import Database

    if not isinstance(value, Database):
        raise TypeError(f"a database is needed, not {type(value).__name__}")
    return value
