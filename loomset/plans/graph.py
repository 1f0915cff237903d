"""The graph of references between relations, and the order of reductions and joins over it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from ..model import Database, Reference


@dataclass(frozen=True)
class Semijoin:
    """Keep the tuples of ``reduce`` that match a tuple of ``by`` over the reference."""

    reduce: str
    by: str
    reference: Reference


class ReferenceGraph:
    """Relations are nodes, references edges from source to target; references that leave the database are left out."""

    def __init__(self, nodes: Iterable[str], edges: Iterable[Reference]):
        self.nodes = list(nodes)
        self.edges = [e for e in edges if e.source in self.nodes and e.target in self.nodes]

    @staticmethod
    def of(database: Database) -> ReferenceGraph:
        return ReferenceGraph(database.relations, database.references)

    def outgoing(self, node: str) -> list[Reference]:
        return [e for e in self.edges if e.source == node]

    def touching(self, node: str) -> list[Reference]:
        return [e for e in self.edges if node in (e.source, e.target)]

    @property
    def trivial(self) -> bool:
        return not self.edges

    def isolated(self) -> list[str]:
        return [n for n in self.nodes if not self.touching(n)]

    def pure_sources(self) -> list[str]:
        """Nodes that refer to others while none refers to them."""
        return [n for n in self.nodes if self.outgoing(n) and all(e.target != n for e in self.edges)]

    def components(self) -> list[list[str]]:
        """Connected components without regard to direction, in the order of nodes."""
        left, out = list(self.nodes), []
        while left:
            group, todo = [], [left[0]]
            while todo:
                node = todo.pop(0)
                if node not in group:
                    group.append(node)
                    todo += [e.target if e.source == node else e.source for e in self.touching(node)]
            out.append([n for n in self.nodes if n in group])
            left = [n for n in left if n not in group]
        return out

    def check_acyclic(self) -> None:
        """ValueError if references lead back to where they start."""
        nodes = set(self.nodes)
        while nodes:
            free = {n for n in nodes if not any(e.target == n and e.source in nodes for e in self.edges)}
            if not free:
                raise ValueError(f"the references among {sorted(nodes)} are cyclic")
            nodes -= free

    def is_tree(self, group: list[str]) -> bool:
        return len([e for e in self.edges if e.source in group]) == len(group) - 1

    def spanning(self, root: str) -> list[tuple[str, str, Reference]]:
        """(parent, child, edge) of a breadth-first tree from the root, each edge taken in either direction."""
        seen, todo, out = {root}, [root], []
        while todo:
            node = todo.pop(0)
            for edge in self.touching(node):
                other = edge.target if edge.source == node else edge.source
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
                    out.append((node, other, edge))
        return out

    def semijoins(self, root: str) -> list[Semijoin]:
        """Full reduction of a tree: parents by children from the leaves up, then children by parents from the root down."""
        tree = self.spanning(root)
        return [Semijoin(p, c, e) for p, c, e in reversed(tree)] + [Semijoin(c, p, e) for p, c, e in tree]

    def root(self, group: list[str]) -> str:
        """The first relation that refers to none, else the first."""
        return next((n for n in group if not self.outgoing(n)), group[0])
