"""The alignment graph: images as nodes, pairwise alignments as edges, paths of hops to a target.

The graph is small and lives on the driver; `tables` gives it as DataFrames for joins with pixels and shapes, and
`resolve` finds paths for any table of edges by joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    name: str
    image: str = ""
    image_res: float = 1.0
    channel_names: tuple[str, ...] = ()
    attached_to: str | None = None
    mask: str = ""
    channel_colors: tuple[str, ...] = ()
    output_res: float | None = None


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    params: tuple[str, ...] = ("rigid",)
    registered: bool = False
    transforms: tuple = ()
    #: Preprocessing of this edge's source and target that stands in for the images' own.
    source_prepro: object = None
    target_prepro: object = None


@dataclass
class Graph:
    """Insertion order is kept. Every change checks that the names it refers to exist and that a new name is new."""

    nodes: dict[str, Node] = field(default_factory=dict)
    paths: dict[str, tuple[str, ...]] = field(default_factory=dict)  # source -> (thru, target) or (target,)
    edges: list[Edge] = field(default_factory=list)
    shapes: dict[str, str] = field(default_factory=dict)  # shape set -> node
    merges: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def _new(self, name: str) -> None:
        if name in self.nodes or name in self.shapes:
            raise ValueError(f"{name} is there already")

    def _known(self, name: str) -> None:
        if name not in self.nodes:
            raise ValueError(f"no image named {name}")

    def add_image(self, name: str, image: str = "", image_res: float = 1.0, channel_names=(), mask: str = "", channel_colors=(), output_res: float | None = None) -> None:
        self._new(name)
        if image_res <= 0 or (output_res is not None and output_res <= 0):
            raise ValueError(f"{name}: a resolution is above 0")
        self.nodes[name] = Node(name, image, image_res, tuple(channel_names), None, mask, tuple(channel_colors), output_res)

    def attach_image(self, to: str, name: str, image: str = "", channel_names=(), channel_colors=()) -> None:
        self._known(to)
        self._new(name)
        self.nodes[name] = Node(name, image, self.nodes[to].image_res, tuple(channel_names), to, "", tuple(channel_colors), self.nodes[to].output_res)

    def attach_shapes(self, to: str, name: str) -> None:
        self._known(to)
        self._new(name)
        self.shapes[name] = to

    def add_path(self, source: str, target: str, thru: str | None = None, params=("rigid",), override: dict | None = None) -> None:
        """override: preprocessing under "source" and "target" for this edge alone."""
        for name in (source, target, *([thru] if thru else [])):
            self._known(name)
        self.paths[source] = (thru, target) if thru else (target,)
        override = override or {}
        self.edges.append(Edge(source, thru or target, (params,) if isinstance(params, str) else tuple(params), source_prepro=override.get("source"), target_prepro=override.get("target")))

    def add_merge(self, name: str, members) -> None:
        for m in members:
            self._known(m)
        if not members:
            raise ValueError(f"{name}: a merge has members")
        self.merges[name] = tuple(members)

    def remove_merge(self, name: str) -> None:
        """The merge goes; its members are written alone again."""
        if name not in self.merges:
            raise ValueError(f"no merge named {name}")
        del self.merges[name]

    def find_path(self, start: str, end: str, seen: tuple[str, ...] = ()) -> list[str] | None:
        """Depth first, the image in between before the target; a node is not visited twice."""
        seen = (*seen, start)
        if start == end:
            return list(seen)
        for step in self.paths.get(start, ()):
            if step not in seen and (found := self.find_path(step, end, seen)):
                return found
        return None

    def transform_paths(self) -> dict[str, list[Edge]]:
        """For each source the edges from it to its target, hop by hop."""
        out = {}
        for source, steps in self.paths.items():
            nodes = self.find_path(source, steps[-1]) or []
            hops = [next((e for e in self.edges if e.source == n), None) for n in nodes[:-1]]
            out[source] = [e for e in hops if e]
        return out

    def targets(self) -> list[str]:
        """Images that no edge moves and that aren't attached to another."""
        sources = {e.source for e in self.edges}
        return [n for n, node in self.nodes.items() if n not in sources and node.attached_to is None]

    def remove(self, name: str) -> None:
        """An image goes with its path, the paths through it or to it, the edges that these used, its attachments and the merges that hold it; a shape set alone."""
        if name in self.shapes:
            del self.shapes[name]
            return
        self._known(name)
        gone = {s for s, steps in self.paths.items() if s == name or name in steps}
        gone |= {s for s, hops in self.transform_paths().items() if any(name in (e.source, e.target) for e in hops)}
        self.paths = {s: p for s, p in self.paths.items() if s not in gone}
        self.edges = [e for e in self.edges if e.source not in gone and name not in (e.source, e.target)]
        self.nodes = {n: v for n, v in self.nodes.items() if n != name and v.attached_to != name}
        self.shapes = {s: n for s, n in self.shapes.items() if n in self.nodes}
        self.merges = {m: x for m, x in self.merges.items() if set(x) <= set(self.nodes)}

    def reset(self, sources) -> None:
        """The first edge of each source is to be aligned anew."""
        for s in sources:
            for k, e in enumerate(self.edges):
                if e.source == s:
                    self.edges[k] = replace(e, registered=False, transforms=())
                    break

    def outputs(self) -> list[str]:
        """In the order of writing: moved images, attachments, merges, targets; members of a merge are written with it alone."""
        merged = {m for x in self.merges.values() for m in x}
        moved = [s for s in self.paths if s not in merged]
        attached = [n for n, v in self.nodes.items() if v.attached_to and n not in merged]
        return [*moved, *attached, *self.merges, *(t for t in self.targets() if t not in merged)]

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        hops = [(s, k, e.source, e.target) for s, path in self.transform_paths().items() for k, e in enumerate(path)]
        return {
            "image": spark.createDataFrame([(n.name, n.image, n.image_res, n.attached_to) for n in self.nodes.values()], "name string, image string, image_res double, attached_to string"),
            "edge": spark.createDataFrame([(e.source, e.target, list(e.params), e.registered) for e in self.edges], "source string, target string, params array<string>, registered boolean"),
            "hop": spark.createDataFrame(hops, "modality string, hop int, source string, target string"),
            "shape_set": spark.createDataFrame(list(self.shapes.items()), "name string, image string"),
        }


# --- graphs as tables

#: Joins that a plan of resolve() may hold.
DEEPEST = 64


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint, where the session has a folder for them: then a long chain's plans don't grow with its hops."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def depth(edges: DataFrame) -> int:
    """Hops of the longest path along edges (source, target), or a bound on it where there are cycles. One count a hop; no name reaches the driver."""
    reached, before, hops = edges.select(F.col("target").alias("node")).distinct(), None, 1
    while True:
        reached = edges.join(reached, edges["source"] == reached["node"], "left_semi").select(F.col("target").alias("node")).distinct()
        reached = cut(reached) if hops % 4 == 0 else reached
        now = reached.count()
        if not now:
            return hops
        if now == before:
            # what is still reached may lie on cycles, and a path visits each node once
            if hops + now > DEEPEST:
                raise ValueError(f"paths of up to {hops + now} hops: resolve such chains in parts")
            if hops > now:
                return hops + now
        if hops >= DEEPEST:
            raise ValueError(f"paths of more than {DEEPEST} hops: resolve such chains in parts")
        before, hops = now, hops + 1


def resolve(edges: DataFrame) -> DataFrame:
    """(start, hop, source, target) of the paths from every source along edges (source, target). A path ends where no edge goes on, and doesn't visit a node twice.

    As many joins as the longest path has hops; each is by the path's end, so no join grows with the paths' length.
    """
    edges = edges.select("source", "target")
    step = edges.select(F.col("source").alias("start"), F.lit(0).alias("hop"), "source", "target", F.array("source").alias("seen"))
    out, on = step.drop("seen"), edges.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    for hop in range(1, depth(edges)):
        further = step.join(on, step["target"] == on["_from"]).filter(~F.array_contains("seen", F.col("_from")))
        step = further.select("start", F.lit(hop).alias("hop"), F.col("_from").alias("source"), F.col("_to").alias("target"), F.array_append("seen", F.col("_from")).alias("seen"))
        step = cut(step) if hop % 4 == 0 else step
        out = out.unionAll(step.drop("seen"))
    return out


def finals(edges: DataFrame) -> DataFrame:
    """(name): nodes that edges lead to and no edge moves."""
    return edges.select(F.col("target").alias("name")).distinct().join(edges.select(F.col("source").alias("name")), "name", "left_anti")


def strays(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The rows whose node, named by the column key of both tables, isn't there; a null names none."""
    return rows.join(nodes.select(key), key, "left_anti")


def without(walk: DataFrame, gone: DataFrame) -> DataFrame:
    """What resolve() found less the paths that a removed node (name) is on."""
    on = walk.select("start", F.explode(F.array("source", "target")).alias("name")).join(gone.select("name"), "name", "left_semi")
    return walk.join(on.select("start").distinct(), "start", "left_anti")
