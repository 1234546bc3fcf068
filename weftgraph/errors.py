"""Errors of graph construction and clustering."""

from __future__ import annotations

#: Node ids are long here; the limit of 32-bit node ids is kept as the documented one.
MAX_NODES = 2**32 - 1


class ClusteringError(ValueError):
    """Base of all errors of this package."""


class NodeIndexOutOfRange(ClusteringError):
    def __init__(self, node: int, n_nodes: int):
        super().__init__(f"no node {node}: the {n_nodes} nodes are numbered from 0")
        self.node, self.n_nodes = node, n_nodes


class NonFiniteWeight(ClusteringError):
    def __init__(self, edge: tuple[int, int]):
        super().__init__(f"the weight between {edge[0]} and {edge[1]} is infinite or not a number")
        self.edge = edge


class NegativeWeight(ClusteringError):
    def __init__(self, edge: tuple[int, int], weight: float):
        super().__init__(f"the weight between {edge[0]} and {edge[1]} is below zero: {weight}")
        self.edge, self.weight = edge, weight


class InvalidNodeWeight(ClusteringError):
    def __init__(self, node: int, weight: float):
        super().__init__(f"{weight} can't be the weight of node {node}: a number from zero up is wanted")
        self.node, self.weight = node, weight


class NodeWeightLengthMismatch(ClusteringError):
    def __init__(self, got: int, expected: int):
        super().__init__(f"{expected} node weights are wanted, {got} were given")
        self.got, self.expected = got, expected


class MembershipLengthMismatch(ClusteringError):
    def __init__(self, got: int, expected: int):
        super().__init__(f"{expected} labels are wanted, one a node; {got} were given")
        self.got, self.expected = got, expected


class InvalidConfig(ClusteringError):
    def __init__(self, message: str):
        super().__init__(f"these settings don't work: {message}")


class TooManyNodes(ClusteringError):
    def __init__(self, n_nodes: int):
        super().__init__(f"{n_nodes} nodes are more than the {MAX_NODES} a graph may have")
        self.n_nodes = n_nodes


class InvalidCsr(ClusteringError):
    def __init__(self, message: str):
        super().__init__(f"the rows, columns and values don't form a matrix: {message}")


class AsymmetricGraph(ClusteringError):
    def __init__(self, degree_sum: float, expected: float):
        super().__init__(f"strengths add to {degree_sum} where twice the edges' weight is {expected}: some edge has no equal reverse")
        self.degree_sum, self.expected = degree_sum, expected


class InvalidPoints(ClusteringError):
    """Points that are not vectors of one length, or shorter than the search's dimensions."""
