"""Names and enumerations that every module shares."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum, IntEnum


class NodeStatus(IntEnum):
    CORE = 0
    FIXED_VALUE = 1
    FIXED_GRADIENT = 2
    LOOPED = 3
    GHOST = 4


class RasterConnect(Enum):
    """Neighbour offsets (row, column); the place in the list is the slot."""

    QUEEN = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
    ROOK = ((-1, 0), (0, -1), (0, 1), (1, 0))
    BISHOP = ((-1, -1), (-1, 1), (1, -1), (1, 1))


class FlowDirection(Enum):
    UNDEFINED = 0
    SINGLE = 1
    MULTI = 2


class MSTMethod(Enum):
    KRUSKAL = "kruskal"
    BORUVKA = "boruvka"


class MSTRouteMethod(Enum):
    BASIC = "basic"
    CARVE = "carve"


class FlowGraphTraversalDir(Enum):
    ANY = "any"
    DEPTH_DOWNSTREAM = "depth_downstream"
    DEPTH_UPSTREAM = "depth_upstream"
    BREADTH_DOWNSTREAM = "breadth_downstream"
    BREADTH_UPSTREAM = "breadth_upstream"


@dataclass
class Node:
    idx: int
    status: NodeStatus


@dataclass
class Neighbor:
    idx: int
    distance: float
    status: NodeStatus


@dataclass
class RasterNode:
    row: int
    col: int
    status: NodeStatus


@dataclass
class RasterNeighbor:
    flatten_idx: int
    row: int
    col: int
    distance: float
    status: NodeStatus


EARTH_RADIUS = 6.371e6
NODE = ["grid_id", "idx"]
FLOW = "grid_id long, src long, slot int, rec long, distance double, weight double"
