"""The property graph: a vertex table and an edge table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgernet import vocabulary as V

#: The columns of numbered commitments, by key.
NUMBERED = {"orgao_id": "orgao_number", "fornecedor_id": "fornecedor_number"}


#: Node types whose vertices are made of the commitments, as all edges are, by the name that ``built_from`` has for them.
_MADE_OF_COMMITMENTS = {V.EMPENHO: "empenhos", V.CONTRATO: "contratos"}


def without_loops(edges: DataFrame) -> DataFrame:
    """The edges between two nodes or with an unknown end."""
    return edges.where(~F.coalesce(F.col("src") == F.col("dst"), F.lit(False)))


@dataclass(frozen=True)
class SpendGraph:
    """Two DataFrames and what is known about them.

    ``end_types`` maps an edge type to the node types of its two ends. Operators use
    it to read only the edge types that can touch a node type; it is None for edge
    tables from elsewhere. ``commitments`` is the de-duplicated table the edges were
    built from, when there is one: the two-hop projection then needs no self-join.
    ``built_from`` names the tables that gave the vertices of a graph that was built here.
    ``numbers(id, node_type, number)`` are places of agencies and suppliers in the order of their
    ids, which the commitments then carry as well (``NUMBERED``), null where there is no vertex.
    """

    vertices: DataFrame
    edges: DataFrame
    end_types: Mapping[str, tuple[str, str]] | None = None
    commitments: DataFrame | None = field(default=None, repr=False)
    built_from: frozenset[str] | None = field(default=None, repr=False)
    numbers: DataFrame | None = field(default=None, repr=False)

    def edges_touching(self, node_types: Collection[str]) -> DataFrame:
        """Edges that may have an end of one of the types."""
        return self._of_types(lambda ends: not set(ends).isdisjoint(node_types))

    def edges_between(self, node_types: Collection[str]) -> DataFrame:
        """Edges that may have both ends among the types."""
        return self._of_types(lambda ends: set(ends) <= set(node_types))

    def edges_from(self, source_type: str, target_type: str) -> DataFrame:
        """Edges that may run from one type to the other."""
        return self._of_types(lambda ends: tuple(ends) == (source_type, target_type))

    def edges_by_side(self, node_types: Collection[str]) -> tuple[DataFrame, DataFrame]:
        """Edges that may start at one of the types, and edges that may end at one, those without self-loops."""
        starting = self._of_types(lambda ends: ends[0] in node_types)
        ending = self._of_types(lambda ends: ends[1] in node_types)
        if self.end_types is None or any(a == b and a in node_types for a, b in self.end_types.values()):
            ending = without_loops(ending)
        return starting, ending

    def neighbor_types(self, node_types: Collection[str]) -> set[str] | None:
        """The types and those an edge away from them; None if any type may be."""
        if self.end_types is None:
            return None
        return set(node_types).union(*[e for e in self.end_types.values() if not set(e).isdisjoint(node_types)])

    def made_with_edges(self, node_type: str) -> bool:
        """Whether the vertices of a type and the ends of edges that name them were made of the same rows.

        No such end is then without a vertex.
        """
        return self.built_from is not None and _MADE_OF_COMMITMENTS.get(node_type) in self.built_from

    def _of_types(self, wanted: Callable[[tuple[str, str]], bool]) -> DataFrame:
        if self.end_types is None:
            return self.edges
        types = [t for t, ends in self.end_types.items() if wanted(ends)]
        return self.edges.where(F.col("edge_type").isin(types)) if types else self.edges.where(F.lit(False))

    def num_vertices(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def vertices_iter(self) -> Iterator[Row]:
        """Rows on the driver, one partition at a time: for small exports."""
        return self.vertices.toLocalIterator()

    def edges_iter(self) -> Iterator[Row]:
        return self.edges.toLocalIterator()
