"""Weighted graphs: edges from flows, degrees, pairs, and dense kernels that run one task per scenario.

Edges are (src, dst, cond, cost) with src < dst. Kernels get a whole small graph in each task (its edges are broadcast as
arrays, and refused above MAX_EDGES rows) and are parallel over sources or removed nodes, not within the algebra; dense
algebra runs in one task. The driver only collects the edges.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_EDGES = 2_000_000
MAX_DENSE = 5_000
#: Fixed value: the resistance between nodes that nothing joins is so many times the median cost times the nodes.
PENALTY = 10.0


def undirected(flows: DataFrame, a: str, b: str, w: str, least: float = 0.0, eps: float = 1e-9) -> DataFrame:
    """Flows summed over both directions: small parts are dropped before summing, small sums after."""
    parts = flows.where(F.col(w) > least).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(w).alias("w")).where("src <> dst")
    edges = parts.groupBy("src", "dst").agg(F.sum("w").alias("cond")).where(F.col("cond") > least)
    return edges.withColumn("cost", 1 / (F.col("cond") + eps))


def symmetrized(arcs: DataFrame, how: str = "sum") -> DataFrame:
    fold = {"sum": F.sum, "avg": F.avg, "max": F.max}[how]
    return arcs.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(fold("cond").alias("cond"))


def completed(edges: DataFrame, eps: float = 1e-9) -> DataFrame:
    """cond and cost each from the other where one is missing; cost 1 where both are."""
    cost = F.coalesce("cost", 1 / (F.col("cond") + eps), F.lit(1.0))
    return edges.withColumns({"cost": cost, "cond": F.coalesce("cond", 1 / (cost + eps))})


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node"), "cond").unionAll(edges.select("dst", "cond"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("cond").alias("strength"))


def pair_fraction(sizes: list[int]) -> float:
    n = sum(sizes)
    return 1.0 if n <= 1 else sum(s * (s - 1) / 2 for s in sizes) / (n * (n - 1) / 2)


class Graph:
    """A graph in memory."""

    def __init__(self, edges, nodes=()):
        self.nodes = sorted({*nodes, *(e[0] for e in edges), *(e[1] for e in edges)})
        self.at = {v: i for i, v in enumerate(self.nodes)}
        self.near: dict[int, list[tuple[int, float, float]]] = defaultdict(list)
        for a, b, cond, cost in edges:
            self.near[self.at[a]].append((self.at[b], cond, cost))
            self.near[self.at[b]].append((self.at[a], cond, cost))

    def distances(self, source: int, gone: int = -1) -> dict[int, float]:
        done: dict[int, float] = {}
        heap = [(0.0, source)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in done:
                done[v] = d
                for u, _, cost in self.near[v]:
                    if u not in done and u != gone:
                        heapq.heappush(heap, (d + cost, u))
        return done

    def parts(self, gone: int = -1) -> list[list[int]]:
        """The nodes of each connected component."""
        seen, out = {gone}, []
        for v in range(len(self.nodes)):
            if v not in seen:
                stack, part = [v], []
                seen.add(v)
                while stack:
                    x = stack.pop()
                    part.append(x)
                    for u, *_ in self.near[x]:
                        if u not in seen:
                            seen.add(u)
                            stack.append(u)
                out.append(sorted(part))
        return out

    def components(self, gone: int = -1) -> list[int]:
        return [len(p) for p in self.parts(gone)]

    def lengths(self, source: int, gone: int = -1) -> tuple[float, float, int]:
        """Of a source: sum of inverse distances, sum of distances, nodes reached."""
        d = [x for v, x in self.distances(source, gone).items() if v != source]
        return sum(1 / x for x in d if x > 0), sum(d), len(d)

    def sampled(self, sources: list[int], gone: int = -1) -> tuple[float, float]:
        """Efficiency and mean path length from sources; the unreachable add nothing, or do not count."""
        own = [s for s in sources if s != gone]
        sums = [self.lengths(s, gone) for s in own]
        inverse, total, reached = (sum(x[i] for x in sums) for i in range(3))
        pairs = len(own) * (len(self.nodes) - (gone >= 0) - 1)
        return inverse / pairs if pairs else 0.0, total / reached if reached else float("nan")

    def dependencies(self, sources) -> np.ndarray:
        """What shortest paths from sources pass through each node."""
        out = np.zeros(len(self.nodes))
        for s in sources:
            dist, sigma, before, order = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
            done, heap = set(), [(0.0, s)]
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for u, _, cost in self.near[v]:
                    new = d + cost
                    if u not in dist or new < dist[u] - 1e-12:
                        dist[u], sigma[u], before[u] = new, sigma[v], [v]
                        heapq.heappush(heap, (new, u))
                    elif u not in done and abs(new - dist[u]) <= 1e-12:
                        sigma[u] += sigma[v]
                        before[u].append(v)
            delta = defaultdict(float)
            for v in reversed(order):
                for u in before[v]:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                if v != s:
                    out[v] += delta[v]
        return out

    def betweenness(self, sources=None) -> np.ndarray:
        """Share of shortest paths through each node; from a sample of sources, scaled up."""
        n = len(self.nodes)
        own = range(n) if sources is None else sources
        return self.dependencies(own) * (n / max(1, len(own))) / ((n - 1) * (n - 2)) if n > 2 else np.zeros(n)

    def adjacency(self) -> np.ndarray:
        if len(self.nodes) > MAX_DENSE:
            raise ValueError(f"dense kernels take at most {MAX_DENSE} nodes, not {len(self.nodes)}")
        a = np.zeros((len(self.nodes),) * 2)
        for v, near in self.near.items():
            for u, cond, _ in near:
                a[v, u] = cond
        return a

    def _laplacian_inverse(self, part: list[int]) -> np.ndarray:
        a = self.adjacency()[np.ix_(part, part)]
        return np.linalg.pinv(np.diag(a.sum(1)) - a, hermitian=True)

    def current_flow(self) -> tuple[np.ndarray, float]:
        """1 / (n L+_vv + tr L+) of each node of the largest component (0 elsewhere), and 2 tr L+ / (n - 1) of it; infinite
        without edges."""
        part = max(self.parts(), key=len, default=[])
        out, n = np.zeros(len(self.nodes)), len(part)
        if n < 2:
            return out, float("inf")
        diag = self._laplacian_inverse(part).diagonal()
        out[part] = 1 / (n * diag + diag.sum())
        return out, 2 * diag.sum() / (n - 1)

    def penalty(self, gone: int = -1) -> float:
        costs = [cost for v, near in self.near.items() for u, _, cost in near if v < u and gone not in (u, v) and np.isfinite(cost) and cost > 0]
        return PENALTY * (float(np.median(costs)) if costs else 1.0) * max(2, len(self.nodes) - (gone >= 0))

    def resistance(self, gone: int = -1, penalty: float | None = None) -> np.ndarray:
        """Effective resistance of all pairs, component by component; the penalty between components. A node that is gone
        has a row of zeros."""
        n = len(self.nodes)
        r = np.full((n, n), self.penalty(gone) if penalty is None else penalty, dtype=float)
        for part in self.parts(gone):
            inv = self._without(gone)._laplacian_inverse(part) if gone >= 0 else self._laplacian_inverse(part)
            r[np.ix_(part, part)] = np.add.outer(inv.diagonal(), inv.diagonal()) - 2 * inv
        np.fill_diagonal(r, 0.0)
        if gone >= 0:
            r[gone], r[:, gone] = 0.0, 0.0
        return r

    def _without(self, gone: int) -> Graph:
        g = Graph.__new__(Graph)
        g.nodes, g.at = self.nodes, self.at
        g.near = defaultdict(list, {v: [e for e in near if e[0] != gone] for v, near in self.near.items() if v != gone})
        return g

    def kbar(self, gone: int = -1, penalty: float | None = None) -> float:
        """Mean resistance over all pairs."""
        n = len(self.nodes) - (gone >= 0)
        return float(self.resistance(gone, penalty).sum() / (n * (n - 1))) if n > 1 else 0.0

    def eigenvector(self) -> np.ndarray:
        return np.abs(np.linalg.eigh(self.adjacency())[1][:, -1])

    def pagerank(self, damping: float = 0.85, steps: int = 100) -> np.ndarray:
        a = self.adjacency()
        out, n = a.sum(1, keepdims=True), len(a)
        p = np.divide(a, out, out=np.full_like(a, 1 / n), where=out > 0)
        x = np.full(n, 1 / n)
        for _ in range(steps):
            x = (1 - damping) / n + damping * (x @ p)
        return x


def collected(edges: DataFrame) -> list[tuple]:
    """All edges, refused beyond a stated size."""
    rows = edges.select("src", "dst", "cond", "cost").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"graph kernels take at most {MAX_EDGES} edges")
    return [tuple(r) for r in rows]


class Shared:
    """A graph that every task can have: its edges broadcast, built once a task."""

    def __init__(self, edges: DataFrame):
        rows = collected(edges)
        self.kind, self.spark = edges.schema["src"].dataType.simpleString(), edges.sparkSession
        self.nodes = sorted({*(r[0] for r in rows), *(r[1] for r in rows)})
        self.held = self.spark.sparkContext.broadcast([list(c) for c in zip(*rows, strict=True)] or [[]] * 4)

    def each(self, kernel, schema: str, tasks: int | None = None, own: list | None = None) -> DataFrame:
        """kernel(graph, numbers of nodes) -> rows, over all nodes (or own) dealt among tasks."""
        held, n = self.held, len(self.nodes)
        numbers = list(range(n)) if own is None else own
        tasks = tasks or max(1, min(len(numbers), 4 * self.spark.sparkContext.defaultParallelism))
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches):
            own = [int(i) for batch in batches for i in batch["i"]]
            if own:
                yield pd.DataFrame(list(kernel(Graph(list(zip(*held.value, strict=True))), own)), columns=names)

        return self.spark.createDataFrame([(i,) for i in numbers], "i long").repartition(tasks, "i").mapInPandas(run, schema)

    def whole(self, kernel, schema: str) -> DataFrame:
        """kernel(graph) -> rows, in one task."""
        return self.each(lambda g, _: kernel(g), schema, 1, [0])


def node_metrics(edges: DataFrame, sample: list | None = None) -> DataFrame:
    """node, degree, strength, betweenness (from a sample of source nodes, if given), closeness, eigenvector, pagerank,
    cf_closeness, kbar. Shortest paths are spread over tasks by source, dense algebra is one task."""
    shared = Shared(edges)
    chosen = set(shared.nodes if sample is None else sample)

    def paths(g: Graph, own: list[int]):
        n = len(g.nodes)
        through = g.dependencies([i for i in own if g.nodes[i] in chosen])
        for i in own:
            _, total, reached = g.lengths(i)
            yield g.nodes[i], 0.0, float(reached / total * reached / (n - 1)) if reached else 0.0
        for i in np.flatnonzero(through):
            yield g.nodes[i], float(through[i]), 0.0

    def dense(g: Graph):
        cf, kbar = g.current_flow()
        for i, (v, e, p) in enumerate(zip(g.nodes, g.eigenvector(), g.pagerank(), strict=True)):
            yield v, len(g.near[i]), float(sum(c for _, c, _ in g.near[i])), float(e), float(p), float(cf[i]), float(kbar)

    n = len(shared.nodes)
    scale = n / max(1, len(chosen & set(shared.nodes))) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    by_source = shared.each(paths, f"node {shared.kind}, betweenness double, closeness double")
    by_source = by_source.groupBy("node").agg((F.sum("betweenness") * scale).alias("betweenness"), F.max("closeness").alias("closeness"))
    of_all = shared.whole(dense, f"node {shared.kind}, degree long, strength double, eigenvector double, pagerank double, cf_closeness double, kbar double")
    return of_all.join(by_source, "node").select("node", "degree", "strength", "betweenness", "closeness", "eigenvector", "pagerank", "cf_closeness", "kbar")


def removal_impact(edges: DataFrame, nodes: DataFrame, sources: list | None = None, penalty: float | None = None) -> DataFrame:
    """node, delta_conn_pairs, delta_eff, delta_aspl, articulation, resk: what the removal of each node costs (delta_aspl is
    null where no path is left; resk is the rise of the mean resistance); nodes are spread over tasks."""
    shared = Shared(edges)
    at = {v: i for i, v in enumerate(shared.nodes)}
    chosen = [at[r.node] for r in nodes.select("node").distinct().limit(MAX_EDGES).collect()]  # nodes of a graph whose edges fit

    def run(g: Graph, removed: list[int]):
        own = [g.at[s] for s in sources] if sources else list(range(len(g.nodes)))
        whole, (eff, aspl), kbar = g.components(), g.sampled(own), g.kbar(penalty=penalty)
        for i in removed:
            left = g.components(i)
            e, a = g.sampled(own, i)
            yield g.nodes[i], pair_fraction(whole) - pair_fraction(left), eff - e, a - aspl, len(left) > len(whole), g.kbar(i, penalty) - kbar

    return shared.each(run, f"node {shared.kind}, delta_conn_pairs double, delta_eff double, delta_aspl double, articulation boolean, resk double", own=chosen)


def efficiency(edges: DataFrame) -> DataFrame:
    """efficiency and mean path length (aspl) over all pairs, sources spread over tasks."""
    shared = Shared(edges)
    n = len(shared.nodes)
    sums = shared.each(lambda g, own: (g.lengths(i) for i in own), "inverse double, total double, reached long")
    return sums.agg((F.sum("inverse") / float(max(1, n * (n - 1)))).alias("efficiency"), F.try_divide(F.sum("total"), F.sum("reached")).alias("aspl"))


def resistances(edges: DataFrame, penalty: float | None = None) -> DataFrame:
    """src, dst, resistance of every pair src < dst."""
    shared = Shared(edges)

    def run(g: Graph):
        r = g.resistance(penalty=penalty)
        return ((g.nodes[i], g.nodes[j], float(r[i, j])) for i in range(len(r)) for j in range(i + 1, len(r)))

    return shared.whole(run, f"src {shared.kind}, dst {shared.kind}, resistance double")


def component_labels(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each is joined to."""
    shared = Shared(edges)
    return shared.whole(lambda g: ((g.nodes[i], g.nodes[p[0]]) for p in g.parts() for i in p), f"node {shared.kind}, component {shared.kind}")


def removal_nodes(edges: DataFrame, mode: str = "all", k: int = 100, seed: int = 0) -> DataFrame:
    """node: all, random_k (by a seeded hash), top_degree_k or top_cond_degree_k (ties to the smaller node)."""
    d = degrees(edges)
    orders = {"random_k": [F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string"))), F.col("node")], "top_degree_k": [F.desc("degree"), F.col("node")], "top_cond_degree_k": [F.desc("strength"), F.col("node")]}
    if mode != "all" and mode not in orders:
        raise ValueError(f"no mode {mode}: all, {', '.join(orders)}")
    return (d if mode == "all" else d.orderBy(*orders[mode]).limit(k)).select("node")


def ring(spark, n: int, chords: int = 0, seed: int = 0) -> DataFrame:
    """A ring of n nodes with random chords, as arcs without cost."""
    at = F.col("id")
    base = spark.range(n).select(at.alias("src"), ((at + 1) % n).alias("dst"))
    more = spark.range(chords).select(F.pmod(F.xxhash64(F.lit(seed), at, F.lit(0)), F.lit(n)).alias("src"), F.pmod(F.xxhash64(F.lit(seed), at, F.lit(1)), F.lit(n)).alias("dst"))
    return base.union(more).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def with_costs(arcs: DataFrame, low: float = 1.0, high: float = 10.0, seed: int = 0, eps: float = 1e-9) -> DataFrame:
    """Arcs with a random cost between low and high, the same for every run, and cond = 1 / (cost + eps)."""
    share = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 30)) / float(1 << 30)
    return arcs.withColumn("cost", F.lit(low) + share * (high - low)).withColumn("cond", 1 / (F.col("cost") + eps))
