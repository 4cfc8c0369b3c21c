"""Layered and clustered layout.

Layers, ghost nodes, coordinates, crossings and cluster figures are relational.  What is
sequential by nature (depth-first search, barycentre sweeps, eigenvectors, k-means) runs
as a kernel over one graph or one cluster at a time inside applyInPandas, so that many
clusters are laid out in parallel; a kernel's memory grows with its own cluster only.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..graph import CausalGraph
from ..plans.lineage import checkpoint
from ..plans.rank import rank, running_total

NODE_WIDTH, NODE_HEIGHT, BUFFER = 180.0, 60.0, 20.0
LAYER_SPACING, NODE_SPACING, SWEEPS = 250.0, 70.0, 24


# ---- kernels (plain Python over one graph)


def find_back_edges(nodes: list[str], edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Edges to an open node of a depth-first search that visits ids in order."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    state: dict[str, int] = {}
    back: set[tuple[str, str]] = set()
    for root in sorted(nodes):
        if root in state:
            continue
        state[root] = 1
        stack = [(root, iter(sorted(out[root])))]
        while stack:
            at, rest = stack[-1]
            for b in rest:
                if state.get(b) == 1:
                    back.add((at, b))
                elif b not in state:
                    state[b] = 1
                    stack.append((b, iter(sorted(out[b]))))
                    break
            else:
                state[at] = 2
                stack.pop()
    return back


def layers_of(nodes: dict[str, str], edges: list[tuple[str, str]], compat_boundary_pin: bool = False) -> dict[str, int]:
    """Longest-path layers of nodes {id: category}: back edges left out, sources drawn towards their successors.

    Boundary sources stay in layer 0 (with compat_boundary_pin every boundary node keeps
    its layer), boundary sinks go to the last layer.
    """
    back = find_back_edges(list(nodes), edges)
    out: dict[str, set[str]] = defaultdict(set)
    degree = dict.fromkeys(nodes, 0)
    for a, b in set(edges) - back:
        if a in nodes and b in nodes and a != b:
            out[a].add(b)
            degree[b] += 1
    sources = {n for n, d in degree.items() if d == 0}
    layer = dict.fromkeys(nodes, 0)
    queue = sorted(sources)
    for n in queue:
        for b in sorted(out[n]):
            layer[b] = max(layer[b], layer[n] + 1)
            degree[b] -= 1
            if degree[b] == 0:
                queue.append(b)
    pinned = {n for n, c in nodes.items() if c == "BOUNDARY" and (compat_boundary_pin or n in sources)}
    for n in sorted(nodes, key=lambda n: (-layer[n], n)):
        if n not in pinned and out[n]:
            layer[n] = max(layer[n], min(layer[b] for b in out[n]) - 1)
    last = max(layer.values(), default=0)
    for n, c in nodes.items():
        if c == "BOUNDARY" and not out[n]:
            layer[n] = last
    return layer


def crossings(order: list[list[str]], edges: list[tuple[str, str]], layer: dict[str, int]) -> int:
    place = {n: i for row in order for i, n in enumerate(row)}
    between = defaultdict(list)
    for a, b in edges:
        if abs(layer[a] - layer[b]) == 1:
            a, b = (a, b) if layer[a] < layer[b] else (b, a)
            between[layer[a]].append((place[a], place[b]))
    total = 0
    for pairs in between.values():
        x = np.array(sorted(pairs))
        for i in range(1, len(x)):
            total += int(((x[:i, 0] < x[i, 0]) & (x[:i, 1] > x[i, 1])).sum())
    return total


def order_layers(layer: dict[str, int], edges: list[tuple[str, str]], module: dict[str, str], sweeps: int = SWEEPS) -> list[list[str]]:
    """Barycentre sweeps down and up; the best order seen, the search ends without crossings."""
    rows: list[list[str]] = [[] for _ in range(max(layer.values(), default=0) + 1)]
    for n in sorted(layer, key=lambda n: (module.get(n, ""), n)):
        rows[layer[n]].append(n)
    up, down = defaultdict(list), defaultdict(list)
    for a, b in edges:
        if layer[a] + 1 == layer[b]:
            down[a].append(b), up[b].append(a)
        elif layer[b] + 1 == layer[a]:
            down[b].append(a), up[a].append(b)
    place = {n: i for row in rows for i, n in enumerate(row)}
    best, fewest = [list(r) for r in rows], crossings(rows, edges, layer)
    for _ in range(sweeps):
        for near, span in ((up, range(1, len(rows))), (down, range(len(rows) - 2, -1, -1))):
            for k in span:
                key = {n: sum(place[m] for m in near[n]) / len(near[n]) if near[n] else float(place[n]) for n in rows[k]}
                rows[k].sort(key=key.__getitem__)
                place.update((n, i) for i, n in enumerate(rows[k]))
        n = crossings(rows, edges, layer)
        if n < fewest:
            best, fewest = [list(r) for r in rows], n
        if fewest == 0:
            break
    return best


def reorder_by_strength(order: list[list[str]], edges: list[tuple[str, str, float]]) -> list[list[str]]:
    """Children of one parent swap places so that stronger ones come first; each child follows its first parent only."""
    children = defaultdict(list)
    for a, b, w in edges:
        children[a].append((b, w))
    rows = [list(r) for r in order]
    for k in range(len(rows) - 1):
        place, taken, new = {n: i for i, n in enumerate(rows[k + 1])}, set(), list(rows[k + 1])
        for parent in rows[k]:
            own = sorted(((b, w) for b, w in children[parent] if b in place), key=lambda x: -x[1])
            if len(own) < 2:
                continue
            free = list(dict.fromkeys(b for b, _ in own if b not in taken))
            if len(free) > 1:
                for i, b in zip(sorted(place[b] for b in free), free):
                    new[i] = b
            taken.update(free)
        rows[k + 1] = new
    return rows


FLAT = "graph string, id string, x double, y double, layer long, position long, is_ghost boolean, original_edge_id string, crossing_count long"


def flat_kernel(nodes: pd.DataFrame, edges: pd.DataFrame, graph: str, sweeps: int, layer_spacing: float, node_spacing: float, left_to_right: bool) -> pd.DataFrame:
    """Positions of one graph's nodes and ghosts; ghosts are named by edge and a running number."""
    known = dict(zip(nodes["id"], nodes["category"]))
    links = [(a, b) for a, b in zip(edges["source"], edges["target"]) if a in known and b in known]
    layer = layers_of(known, links)
    full, segments, ghosts = dict(layer), [], {}
    for e, a, b in zip(edges["id"], edges["source"], edges["target"]):
        if a not in known or b not in known:
            continue
        lo, hi = sorted((layer[a], layer[b]))
        chain = [a if layer[a] <= layer[b] else b]
        for k in range(lo + 1, hi):
            name = f"__ghost_{e}_{len(ghosts) + 1}"
            ghosts[name], full[name] = e, k
            chain.append(name)
        chain.append(b if layer[a] <= layer[b] else a)
        segments += list(zip(chain, chain[1:]))
    module = dict(zip(nodes["id"], nodes["module_id"]))
    order = order_layers(full, segments, module, sweeps)
    order = reorder_by_strength(order, list(zip(edges["source"], edges["target"], edges["strength"])))
    n = crossings(order, segments, full)
    widest, rows = max((len(r) for r in order), default=1), []
    for k, row in enumerate(order):
        shift = (widest - len(row)) / 2 * node_spacing
        for i, name in enumerate(row):
            across, along = shift + i * node_spacing, k * layer_spacing
            x, y = (along, across) if left_to_right else (across, along)
            rows.append((graph, name, x, y, k, i, name in ghosts, ghosts.get(name), n))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in FLAT.split(", ")])
    if len(out):
        out["x"] -= out["x"].min()
        out["y"] -= out["y"].min()
    return out


# ---- relational parts


def longest_path_layers(ids: DataFrame, pairs: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, layer) of an acyclic pairs(src, dst): the longest way from a source; one round a layer."""
    pairs = pairs.distinct()
    layer = checkpoint(ids.select("id", F.lit(0).alias("layer")))
    front = layer.join(pairs.select(F.col("dst").alias("id")), "id", "left_anti")
    for k in range(1, max_rounds):
        front = checkpoint(front.join(pairs, front["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct())
        if not front.head(1):
            return layer.groupBy("id").agg(F.max("layer").alias("layer"))
        layer = layer.unionByName(front.withColumn("layer", F.lit(k)))
        layer = checkpoint(layer) if k % 8 == 0 else layer
    raise ValueError("the graph has a cycle")


def ghost_nodes(edges: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ghosts(id, layer, original_edge_id), segments(original_edge_id, seq, from_id, to_id, is_first, is_last)).

    edges(id, source, target, ord); one ghost for each layer an edge passes; running
    numbers follow ord, then the layer.
    """
    a, b = layers.select(F.col("id").alias("source"), F.col("layer").alias("ls")), layers.select(F.col("id").alias("target"), F.col("layer").alias("lt"))
    spans = edges.select("id", "source", "target", "ord").join(a, "source").join(b, "target")
    spans = spans.withColumns({"lo": F.least("ls", "lt"), "hi": F.greatest("ls", "lt")})
    # Only edges that pass a layer are numbered.
    long = running_total(spans.where("hi - lo > 1"), ["ord"], (F.col("hi") - F.col("lo") - 1).cast("bigint"), "before")
    ghosts = long.select("id", "source", "target", "ls", "lt", "before", "lo", F.explode(F.sequence(F.col("lo") + 1, F.col("hi") - 1)).alias("layer"))
    name = F.concat(F.lit("__ghost_"), F.col("id"), F.lit("_"), (F.col("before") + F.col("layer") - F.col("lo")).cast("string"))
    ghosts = ghosts.select(name.alias("ghost"), "layer", F.col("id").alias("original_edge_id"), "source", "target", "ls", "lt")
    ends = spans.select(F.col("id").alias("e"), F.explode(F.array(F.struct(F.col("source").alias("n"), F.lit(0).alias("k")), F.struct(F.col("target").alias("n"), F.lit(1_000_000).alias("k")))).alias("p")).select("e", "p.n", "p.k")
    way = F.when(F.col("ls") <= F.col("lt"), F.col("layer") - F.col("ls")).otherwise(F.col("ls") - F.col("layer"))
    points = ends.unionByName(ghosts.select(F.col("original_edge_id").alias("e"), F.col("ghost").alias("n"), way.alias("k")))
    w = W.partitionBy("e").orderBy("k")
    steps = points.select("e", F.row_number().over(w).alias("seq"), F.col("n").alias("from_id"), F.lead("n").over(w).alias("to_id"), F.lead("k").over(w).alias("next")).where("to_id is not null")
    segments = steps.select(F.col("e").alias("original_edge_id"), "seq", "from_id", "to_id", (F.col("seq") == 1).alias("is_first"), (F.col("next") == 1_000_000).alias("is_last"))
    return ghosts.select(F.col("ghost").alias("id"), "layer", "original_edge_id"), segments


def crossing_count(segments: DataFrame, places: DataFrame) -> DataFrame:
    """(layer, crossings): inversions among segments(from_id, to_id) between neighbouring layers; places(id, layer, position)."""
    a, b = places.toDF("from_id", "l1", "p1"), places.toDF("to_id", "l2", "p2")
    rows = segments.select("from_id", "to_id").join(a, "from_id").join(b, "to_id").where("abs(l1 - l2) = 1")
    up = F.col("l1") < F.col("l2")
    rows = rows.select(F.least("l1", "l2").alias("layer"), F.when(up, F.col("p1")).otherwise(F.col("p2")).alias("u"), F.when(up, F.col("p2")).otherwise(F.col("p1")).alias("v"))
    x, y = rows.toDF("layer", "u1", "v1"), rows.toDF("layer", "u2", "v2")
    return x.join(y, "layer").where("u1 < u2 and v1 > v2").groupBy("layer").agg(F.count(F.lit(1)).alias("crossings"))


def coordinates(places: DataFrame, layer_spacing: float = LAYER_SPACING, node_spacing: float = NODE_SPACING, left_to_right: bool = False) -> DataFrame:
    """places(id, layer, position) with x and y: layers centred on the widest, the least coordinate 0."""
    width = places.groupBy("layer").agg(F.count(F.lit(1)).alias("w"))
    widest = F.broadcast(width.agg(F.max("w").alias("most")))
    rows = places.join(width, "layer").crossJoin(widest)
    across = (F.col("most") - F.col("w")) / 2 * node_spacing + F.col("position") * node_spacing
    along = F.col("layer") * F.lit(float(layer_spacing))
    rows = rows.select("id", "layer", "position", (along if left_to_right else across).alias("x"), (across if left_to_right else along).alias("y"))
    low = F.broadcast(rows.agg(F.min("x").alias("mx"), F.min("y").alias("my")))
    return rows.crossJoin(low).select("id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "layer", "position")


def bounds(positions: DataFrame) -> DataFrame:
    return positions.agg((F.max("x") - F.min("x") + NODE_WIDTH + BUFFER).alias("width"), (F.max("y") - F.min("y") + NODE_HEIGHT + BUFFER).alias("height"))


def flat_layout(g: CausalGraph, clusters: DataFrame | None = None, sweeps: int = SWEEPS, layer_spacing: float = LAYER_SPACING, node_spacing: float = NODE_SPACING, left_to_right: bool = False) -> DataFrame:
    """Positions of nodes and ghosts (see FLAT); with clusters(id, cluster) each cluster is a drawing of its own."""
    names = g.nodes.select("id", F.lit("all").alias("cluster")) if clusters is None else clusters.select("id", F.col("cluster").cast("string").alias("cluster"))
    nodes = g.nodes.select("id", "category", "module_id").join(names, "id").withColumnRenamed("cluster", "graph")
    a, b = names.toDF("source", "graph"), names.toDF("target", "gb")
    edges = g.edges.select("id", "source", "target", "strength", "ord").join(a, "source").join(b, "target").where("graph = gb").drop("gb")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return flat_kernel(left, right.sort_values("ord"), key[0], sweeps, layer_spacing, node_spacing, left_to_right)

    return nodes.groupBy("graph").cogroup(edges.groupBy("graph")).applyInPandas(run, FLAT)


def layout_subgraph(g: CausalGraph, ids: DataFrame, **options) -> DataFrame:
    return flat_layout(g.subgraph(ids), **options)


# ---- clustering


def eigengap(values: list[float], k_max: int) -> int:
    """The number of clusters where the next eigenvalue is farthest away, at least 2."""
    gaps = [(values[i + 1] - values[i], -(i + 1)) for i in range(1, min(k_max, len(values) - 1))]
    return max(2, -max(gaps)[1]) if gaps else min(2, len(values))


def kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Lloyd from evenly spaced rows; the first of equally near centres."""
    centres = x[[i * len(x) // k for i in range(k)]].copy()
    own = np.full(len(x), -1)
    for _ in range(rounds):
        new = np.argmin(((x[:, None, :] - centres[None]) ** 2).sum(axis=2), axis=1)
        if (new == own).all():
            break
        own = new
        for c in range(k):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return own


def spectral_kernel(ids: list[str], edges: list[tuple[str, str, float]], k: int | None, k_max: int) -> list[int]:
    """Clusters of one graph from the eigenvectors of its symmetrised Laplacian; one cluster if there are no edges."""
    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    a = np.zeros((n, n))
    for s, t, w in edges:
        if s != t:
            a[at[s], at[t]] += w
            a[at[t], at[s]] += w
    if n < 2 or not a.any():
        return [0] * n
    values, vectors = np.linalg.eigh(np.diag(a.sum(axis=1)) - a)
    chosen = min(n, max(2, k or eigengap(list(values), k_max)))
    # An eigenvector's sign is free: its largest entry counts as positive.
    v = vectors[:, 1:chosen]
    v = v * np.sign(v[np.argmax(np.abs(v), axis=0), np.arange(v.shape[1])])
    return list(kmeans(v, chosen))


def spectral_clusters(g: CausalGraph, k: int | None = None, k_max: int = 10, min_size: int = 3, pinned: list[str] | None = None) -> DataFrame:
    """(id, cluster): pinned modules are clusters of their own, the rest is split spectrally; small clusters join the largest."""
    pinned = pinned or []
    nodes = g.nodes.select("id", "module_id").withColumn("one", F.lit(1))
    edges = g.edges.select("source", "target", "strength").withColumn("one", F.lit(1))

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("id")
        groups = [sorted(left[left.module_id == m]["id"]) for m in pinned if (left.module_id == m).any()]
        rest = list(left[~left.module_id.isin(pinned)]["id"])
        inner = right[right.source.isin(rest) & right.target.isin(rest)]
        own = spectral_kernel(rest, list(zip(inner.source, inner.target, inner.strength)), k, k_max)
        free = [[x for x, c in zip(rest, own) if c == i] for i in sorted(set(own))]
        free = merge_small(free, min_size)
        rows = [(x, i) for i, c in enumerate(groups + free) for x in c]
        return pd.DataFrame(rows, columns=["id", "cluster"]).astype({"cluster": "int64"})

    return nodes.groupBy("one").cogroup(edges.groupBy("one")).applyInPandas(run, "id string, cluster long")


def merge_small(clusters: list[list[str]], min_size: int) -> list[list[str]]:
    """Clusters below the size join the largest, the smallest first, until none is left."""
    clusters = [c for c in clusters if c]
    while len(clusters) > 1 and min(map(len, clusters)) < min_size:
        i = min(range(len(clusters)), key=lambda i: (len(clusters[i]), i))
        small = clusters.pop(i)
        j = max(range(len(clusters)), key=lambda j: (len(clusters[j]), -j))
        clusters[j] = sorted(clusters[j] + small)
    return clusters


def module_clusters(g: CausalGraph) -> DataFrame:
    """(id, cluster): one cluster a module, numbered by the first node."""
    first = g.nodes.groupBy("module_id").agg(F.min("ord").alias("o"))
    number = first.select(F.col("module_id").alias("m"), (F.dense_rank().over(W.orderBy("o", "module_id")) - 1).cast("long").alias("cluster"))
    return g.nodes.join(number, F.col("module_id") == F.col("m")).select("id", "cluster")


def single_cluster(g: CausalGraph) -> DataFrame:
    return g.nodes.select("id", F.lit(0).cast("long").alias("cluster"))


def diagnostics(g: CausalGraph, clusters: DataFrame) -> DataFrame:
    """(k, module_agreement, cross_cluster_edge_ratio, modules_split, mixed_clusters): purity and edges across, to three digits."""
    c = g.nodes.select("id", "module_id").join(clusters, "id")
    counts = c.groupBy("cluster", "module_id").agg(F.count(F.lit(1)).alias("n"))
    pure = counts.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("mods"))
    p = pure.agg(F.count(F.lit(1)).alias("k"), F.round(F.sum("top") / F.sum("size"), 3).alias("module_agreement"), F.count_if(F.col("mods") > 1).alias("mixed_clusters"))
    split = counts.groupBy("module_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("modules_split"))
    ids = clusters.select("id", "cluster")
    e = g.edges.join(ids.toDF("source", "c1"), "source").join(ids.toDF("target", "c2"), "target").agg(F.round(F.coalesce(F.count_if(F.col("c1") != F.col("c2")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 3).alias("cross_cluster_edge_ratio"))
    return p.crossJoin(split).crossJoin(e)


def eigenvalue_view(values: DataFrame, k: int) -> DataFrame:
    """(i, value, gap, chosen) of values(i, value): the gap to the one before, and whether it is the one that chose k."""
    gap = F.col("value") - F.lag("value").over(W.orderBy("i"))
    return values.withColumns({"gap": gap, "chosen": F.col("i") == k})


def hierarchical_layout(g: CausalGraph, clusters: DataFrame, pad: float = 50.0, left_to_right: bool = False) -> tuple[DataFrame, DataFrame]:
    """(positions, clusters(id, x, y, width, height)): each cluster drawn alone, then packed by the layout of the graph of clusters.

    With one cluster the flat layout.
    """
    clusters = checkpoint(clusters)
    inner = checkpoint(flat_layout(g, clusters, left_to_right=left_to_right))
    boxes = inner.groupBy(F.col("graph").cast("long").alias("cluster")).agg((F.max("x") - F.min("x") + NODE_WIDTH + BUFFER).alias("width"), (F.max("y") - F.min("y") + NODE_HEIGHT + BUFFER).alias("height"))
    ids = clusters.select("id", "cluster")
    cross = g.edges.join(ids.toDF("source", "a"), "source").join(ids.toDF("target", "b"), "target").where("a <> b").select("a", "b").distinct()
    name = lambda c: F.concat(F.lit("__cluster_"), F.lpad(F.col(c).cast("string"), 6, "0"))
    meta_nodes = ids.select("cluster").distinct().select(name("cluster").alias("id"), F.lit("PROCESS").alias("category"), name("cluster").alias("module_id"), F.col("cluster").alias("ord"))
    meta_edges = cross.select(F.concat_ws("-", "a", "b").alias("id"), name("a").alias("source"), name("b").alias("target"), F.lit("association").alias("relation"), F.lit("L4").alias("causal_confidence"), (F.col("a") * 1_000_000 + F.col("b")).alias("ord"))
    meta = flat_layout(CausalGraph(meta_nodes, meta_edges)).where("not is_ghost").select(F.substring("id", 11, 6).cast("long").alias("cluster"), F.col("layer").alias("ml"), F.col("position").alias("mp"))
    rows = boxes.join(meta, "cluster")
    along, across = ("width", "height") if left_to_right else ("height", "width")
    # Layers are as deep as their largest box; boxes of a layer lie side by side around 0.
    deep = rows.groupBy("ml").agg(F.max(along).alias("deep"), F.sum(across).alias("total"), F.count(F.lit(1)).alias("n"))
    deep = deep.withColumn("start", F.coalesce(F.sum(F.col("deep") + pad).over(W.orderBy("ml").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.join(deep, "ml")
    side = F.coalesce(F.sum(F.col(across) + pad).over(W.partitionBy("ml").orderBy("mp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) - (F.col("total") + pad * (F.col("n") - 1)) / 2
    flow = F.col("start") + (F.col("deep") - F.col(along)) / 2
    packed = rows.select(F.col("cluster").alias("id"), (flow if left_to_right else side).alias("x"), (side if left_to_right else flow).alias("y"), "width", "height")
    off = packed.select(F.col("id").cast("string").alias("graph"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    moved = inner.join(off, "graph").select("graph", "id", (F.col("x") + F.col("ox")).alias("x"), (F.col("y") + F.col("oy")).alias("y"), "layer", "position", "is_ghost", "original_edge_id")
    return moved, packed


def split_columns(positions: DataFrame, most: int = 10, spacing: float = 70.0, gap: float = 200.0, layer_gap: float = 280.0) -> DataFrame:
    """(id, x, y): each layer's nodes by y in columns of at most `most`, each centred on 0."""
    rank = F.row_number().over(W.partitionBy("layer").orderBy("y", "id")) - 1
    rows = positions.select("id", "layer", "y").withColumn("r", rank).withColumn("c", F.floor(F.col("r") / most))
    size = positions.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    width = F.floor((F.col("n") - 1) / most) * gap + layer_gap
    size = size.withColumn("start", F.coalesce(F.sum(width).over(W.orderBy("layer").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.join(size, "layer")
    here = F.least(F.lit(most), F.col("n") - F.col("c") * most)
    return rows.select("id", (F.col("start") + F.col("c") * gap).cast("double").alias("x"), ((F.col("r") % most) * spacing - (here - 1) * spacing / 2).cast("double").alias("y"))


def kahn_levels(ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, level): rounds of taking what has no edge in from the rest; what a cycle holds comes last."""
    rest, left, done, k = checkpoint(ids.select("id")), checkpoint(pairs.where("src <> dst").distinct()), None, 0
    while True:
        free = checkpoint(rest.join(left.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(k)))
        if not free.head(1):
            tail = rest.withColumn("level", F.lit(k))
            return tail if done is None else done.unionByName(tail)
        done = free if done is None else done.unionByName(free)
        rest = checkpoint(rest.join(free.select("id"), "id", "left_anti"))
        left = checkpoint(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        k += 1


def back_edge_routes(edges: DataFrame, positions: DataFrame, stagger: float = 20.0, margin: float = 40.0) -> DataFrame:
    """(edge_id, seq, x1, y1, x2, y2): three segments by two waypoints above everything, staggered by rank."""
    a, b = positions.select(F.col("id").alias("source"), F.col("x").alias("xa"), F.col("y").alias("ya")), positions.select(F.col("id").alias("target"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    top = F.broadcast(positions.agg(F.min("y").alias("top")))
    rows = edges.select("id", "source", "target").join(a, "source").join(b, "target").where("xa >= xb")
    rows = rank(rows, ["id"], "n").crossJoin(top).withColumn("h", F.col("top") - margin - stagger * F.col("n"))
    pts = F.array(*[F.struct(F.lit(i).alias("seq"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")) for i, (x1, y1, x2, y2) in enumerate([(F.col("xa"), F.col("ya"), F.col("xa"), F.col("h")), (F.col("xa"), F.col("h"), F.col("xb"), F.col("h")), (F.col("xb"), F.col("h"), F.col("xb"), F.col("yb"))], 1)])
    return rows.select(F.col("id").alias("edge_id"), F.explode(pts).alias("p")).select("edge_id", "p.*")


def placed(g: CausalGraph, positions: DataFrame) -> DataFrame:
    """(id, label, x, y): the layout's place, else the node's own, else the origin."""
    own = [F.col(c) if c in g.nodes.columns else F.lit(None).cast("double") for c in ("x", "y")]
    nodes = g.nodes.select("id", "label", own[0].alias("nx"), own[1].alias("ny"))
    p = positions.select(F.col("id").alias("pid"), F.col("x").alias("px"), F.col("y").alias("py"))
    return nodes.join(p, F.col("id") == F.col("pid"), "left").select("id", "label", F.coalesce("px", "nx", F.lit(0.0)).alias("x"), F.coalesce("py", "ny", F.lit(0.0)).alias("y"))


def routed_edges(segments: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, from_id, to_id, label, has_arrow): the label on an edge's first segment, the arrow on its last."""
    e = edges.select(F.col("id").alias("e"), "relation")
    rows = segments.join(e, F.col("original_edge_id") == F.col("e"))
    return rows.select(F.concat_ws("__", "original_edge_id", "from_id", "to_id").alias("id"), "from_id", "to_id", F.when(F.col("is_first"), F.col("relation")).alias("label"), F.col("is_last").alias("has_arrow"))


# ---- spatial


def within(points: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Points of an inclusive box."""
    return points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def viewport(points: DataFrame, edges: DataFrame, box: tuple[float, float, float, float], threshold: int = 200, cell: float = 150.0, margin: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges to draw: all of up to `threshold`, else those of the box snapped to cells and widened; edges need both ends."""
    x0, y0, x1, y1 = box
    lo, hi = (lambda v: v // cell * cell - margin), (lambda v: -(-v // cell) * cell + margin)
    few = F.broadcast(points.agg((F.count(F.lit(1)) <= threshold).alias("few")))
    shown = points.crossJoin(few).where(F.col("few") | (F.col("x").between(lo(x0), hi(x1)) & F.col("y").between(lo(y0), hi(y1)))).drop("few")
    ids = shown.select(F.col("id").alias("__i"))
    return shown, edges.join(ids, F.col("source") == F.col("__i"), "left_semi").join(ids, F.col("target") == F.col("__i"), "left_semi")


def step_focus(edges: DataFrame, nodes: list[str], listed: list[str]) -> DataFrame:
    """(id, focused): an edge is in focus if it is listed or both its ends are; all are if nothing is given."""
    if not nodes and not listed:
        return edges.select("id", F.lit(True).alias("focused"))
    both = F.col("source").isin(*nodes) & F.col("target").isin(*nodes) if nodes else F.lit(False)
    return edges.select("id", ((F.col("id").isin(*listed) if listed else F.lit(False)) | both).alias("focused"))
