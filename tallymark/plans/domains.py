"""Domain spaces: what distance means for points, graph nodes and vectors, and the similarity that falls
with it as exp(-d^2 / 2 sigma^2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import euclidean, gaussian, haversine_km
from .canonical import digest

RULES = {"geographic": "haversine_gaussian", "graph": "shortest_path_gaussian", "vector": "euclidean_gaussian"}


@dataclass(frozen=True)
class DomainSpace:
    space: str
    sigma: float
    dimensions: int | None = None
    directed: bool = False

    def __post_init__(self):
        if self.space not in RULES:
            raise ValueError(f"no rule for space {self.space}")
        if not self.sigma > 0:
            raise ValueError("sigma must be positive")
        if (self.space == "vector") != (self.dimensions is not None):
            raise ValueError("vectors, and only they, have dimensions")

    @property
    def identity(self) -> str:
        return digest({"space": self.space, "rule": RULES[self.space], "sigma": self.sigma, "dimensions": self.dimensions, "directed": self.directed})

    def distance(self, a: str, b: str) -> Column:
        """Between columns of structs (lat, lon) or arrays; graph distances come as a column of hops."""
        x, y = F.col(a), F.col(b)
        if self.space == "geographic":
            return haversine_km(x["lat"], x["lon"], y["lat"], y["lon"])
        if self.space == "vector":
            return F.when((F.size(x) == self.dimensions) & (F.size(y) == self.dimensions), euclidean(x, y))
        raise ValueError("graph distances are hops; see operators.graph")

    def similarity(self, distance: Column) -> Column:
        return gaussian(distance, self.sigma)


def pairwise(left: DataFrame, right: DataFrame, space: DomainSpace, on: Column) -> DataFrame:
    """Pairs that ``on`` allows, with distance and similarity. left and right: id, x. ``on`` must be an
    equality on some key: all pairs are never formed."""
    x = left.alias("l").join(right.alias("r"), on).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l.x").alias("_x"), F.col("r.x").alias("_y"))
    d = space.distance("_x", "_y")
    return x.select("a", "b", d.alias("distance"), space.similarity(d).alias("similarity"))
