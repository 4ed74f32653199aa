"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph for each shard.

Equal vectors are indexed once, with the smallest of their ids. Distinct vectors are dealt by hash to shards of about SHARD
vectors; each shard's graph is built in one task and stored as one row of flat arrays: the vectors, and for each layer a
table of neighbour numbers. A query meets every shard's graph; the shards' results are merged by score.

Inner product becomes nearness by one more coordinate that gives all vectors of a shard the same length. Vectors enter a graph in
batches: a beam search for a whole batch at a time, with array operations, finds their candidates in the graph so far and in
the batch itself; neighbours are chosen for spread (a candidate nearer to a chosen one than to the vector comes last).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlake.llm.common import register, table, written

K = 20
SHARD = 8192
LINKS = 16  # of a node in the upper layers; twice as many in the lowest
EF_BUILD, EF_SEARCH = 80, 112
BATCH = 512
QUERY_PART = 2048
AT_ONCE = 4  # beam entries expanded in one step


class Graph:
    """Vectors (float32, one length) and for each layer the neighbours of every vector, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], top: int):
        self.vectors, self.layers, self.top = vectors, layers, top

    def beam(self, layer: int, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef best nodes found for each query, best first (-1 beyond those found), and their products."""
        near, n = self.layers[layer], len(self.vectors)
        b = len(queries)
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        done = np.ones((b, ef), bool)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # number -1
        rows = np.arange(b)
        first = start[:, :ef]
        ids[:, :first.shape[1]] = first
        got = np.einsum("bkd,bd->bk", self.vectors[first], queries)
        sims[:, :first.shape[1]] = np.where(first >= 0, got, -np.inf)
        done[:, :first.shape[1]] = first < 0
        seen[rows[:, None], first] = True
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims, done = (np.take_along_axis(x, order, 1) for x in (ids, sims, done))
        active = rows
        width = min(AT_ONCE, ef)
        while len(active):
            open_ = ~done[active]
            active = active[open_.any(axis=1)]
            if not len(active):
                break
            open_ = ~done[active]
            rank = np.cumsum(open_, axis=1)
            fresh, masks = [], []
            for w in range(1, width + 1):
                hit = open_ & (rank == w)
                has = hit.any(axis=1)
                place = hit.argmax(axis=1)
                node = np.where(has, ids[active, place], -1)
                done[active[has], place[has]] = True
                nb = np.where(node[:, None] >= 0, near[node], -1)
                new = ~seen[active[:, None], nb]
                seen[active[:, None], nb] = True
                fresh.append(nb)
                masks.append(new)
            nb, new = np.concatenate(fresh, axis=1), np.concatenate(masks, axis=1)
            got = np.where(new, np.einsum("bkd,bd->bk", self.vectors[nb], queries[active]), -np.inf)
            all_s = np.concatenate([sims[active], got], axis=1)
            best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_s, best, 1), axis=1, kind="stable"), 1)
            sims[active] = np.take_along_axis(all_s, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(new, nb, -1)], axis=1), best, 1)
            done[active] = np.take_along_axis(np.concatenate([done[active], ~new], axis=1), best, 1)
        return np.where(np.isneginf(sims), -1, ids), sims

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Node numbers found for each query in the lowest layer, best first."""
        start = np.full((len(queries), 1), self.top, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.beam(layer, queries, start, 1)[0]
        return self.beam(0, queries, start, min(ef, len(self.vectors)))[0]


def _chosen(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Up to links of the candidates of each row, spread out first, then the nearest of the others. ids: best first, -1 at the end."""
    b, c = ids.shape
    between = np.matmul(vectors[ids], vectors[ids].transpose(0, 2, 1))
    crowd = np.full((b, c), -np.inf, np.float32)
    taken, count = np.zeros((b, c), bool), np.zeros(b, np.int64)
    for j in range(c):
        ok = (sims[:, j] > crowd[:, j]) & (count < links) & (ids[:, j] >= 0)
        taken[ok, j] = True
        count += ok
        np.maximum(crowd, between[:, j, :], out=crowd, where=ok[:, None])
    order = np.argsort(np.where(taken, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :links]
    out = np.take_along_axis(ids, order, 1)
    if out.shape[1] < links:
        out = np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)
    return out


def _sorted(ids: np.ndarray, sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")[:, :keep]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isneginf(sims), -1, ids), sims


def _link_back(graph: Graph, layer: int, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Adds each node to the lists of its neighbours; a list that is too long is chosen anew."""
    near = graph.layers[layer]
    links = near.shape[1]
    to, frm = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
    to, frm = to[to >= 0], frm[chosen.ravel() >= 0]
    order = np.argsort(to, kind="stable")
    to, frm = to[order], frm[order]
    owner, start, count = np.unique(to, return_index=True, return_counts=True)
    by = np.argsort(count, kind="stable")  # lists of about one length together
    for a in range(0, len(by), 1024):
        part = by[a:a + 1024]
        width = int(count[part].max())
        place = start[part][:, None] + np.arange(width)
        more = np.where(np.arange(width) < count[part][:, None], frm[np.minimum(place, len(frm) - 1)], -1)
        own = owner[part]
        more[(more[:, :, None] == near[own][:, None, :]).any(axis=2)] = -1
        ids = np.concatenate([near[own].astype(np.int64), more], axis=1)
        sims = np.einsum("bkd,bd->bk", graph.vectors[ids], graph.vectors[own])
        ids, sims = _sorted(ids, sims, max(EF_BUILD, links))
        full = (ids >= 0).sum(axis=1) > links
        near[own[~full]] = ids[~full, :links] if ids.shape[1] >= links else np.pad(ids[~full], ((0, 0), (0, links - ids.shape[1])), constant_values=-1)
        if full.any():
            near[own[full]] = _chosen(graph.vectors, ids[full], sims[full], links)


def build(vectors: np.ndarray) -> Graph:
    """The graph of the rows of vectors (float64); same rows, same graph."""
    n = len(vectors)
    length2 = (vectors * vectors).sum(axis=1)
    extra = np.sqrt(np.maximum(length2.max() - length2, 0))
    scale = np.sqrt(length2.max())
    v = (np.concatenate([vectors, extra[:, None]], axis=1) / scale).astype(np.float32)
    rng = np.random.default_rng(n)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 8)
    order = rng.permutation(n)
    layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(level.max()) + 1)]
    graph = Graph(v, layers, int(order[0]))
    at, top = 0, -1
    while at < n:
        batch = order[at:at + min(BATCH, max(1, at))] if at else order[:1]
        at += len(batch)
        start = np.full((len(batch), 1), graph.top, np.int64)
        for layer in range(int(level[batch].max()), -1, -1) if top < 0 else range(max(top, int(level[batch].max())), -1, -1):
            here = level[batch] >= layer
            if layer <= top:
                ef = EF_BUILD if here.any() else 1
                found, sims = graph.beam(layer, v[batch], start, ef)
                start = found[:, :1]
            else:
                found, sims = np.full((len(batch), 1), -1, np.int64), np.full((len(batch), 1), -np.inf, np.float32)
            if not here.any():
                continue
            own, found, sims = batch[here], found[here], sims[here]
            links = layers[layer].shape[1]
            if len(own) > 1:  # those that enter together see each other too
                beside = v[own] @ v[own].T
                np.fill_diagonal(beside, -np.inf)
                k = min(links, len(own) - 1)
                who = np.argpartition(-beside, k - 1, axis=1)[:, :k]
                found = np.concatenate([found, own[who]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(beside, who, 1)], axis=1)
            found, sims = _sorted(found, sims, EF_BUILD)
            chosen = _chosen(v, found, sims, links)
            _link_once(graph, layer, own, chosen)
        best = int(batch[level[batch].argmax()])
        if level[best] > top:
            top = int(level[best])
            graph.top = best
    return graph


def _link_once(graph: Graph, layer: int, own: np.ndarray, chosen: np.ndarray) -> None:
    graph.layers[layer][own] = chosen
    _link_back(graph, layer, own, chosen)


def _built(key: tuple, group: pa.Table) -> pa.Table:
    ids = group.column("ids").combine_chunks()
    values = group.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    order = sorted(range(len(ids)), key=lambda k: ids[k][0].as_py())
    values = values[order]
    graph = build(values)
    return pa.table({
        "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
        "ids": pa.array([[ids[k].as_py() for k in order]], pa.list_(pa.list_(pa.int64()))), "vectors": pa.array([values.astype("<f8").tobytes()], pa.binary()),
        "layers": pa.array([[x.astype("<i4").tobytes() for x in graph.layers]], pa.list_(pa.binary())), "top": pa.array([graph.top], pa.int32())})


def _loaded(row: dict) -> tuple[Graph, np.ndarray, list[list[int]]]:
    n = len(row["ids"])
    values = np.frombuffer(row["vectors"], "<f8").reshape(n, -1)
    length2 = (values * values).sum(axis=1)
    extra = np.sqrt(np.maximum(length2.max() - length2, 0))
    v = (np.concatenate([values, extra[:, None]], axis=1) / np.sqrt(length2.max())).astype(np.float32)
    return Graph(v, [np.frombuffer(x, "<i4").reshape(n, -1) for x in row["layers"]], row["top"]), values, row["ids"]


def _searched(k: int, ef: int):
    def run(key: tuple, graphs: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if graphs.num_rows and queries.num_rows:
            graph, values, ids = _loaded(graphs.slice(0, 1).to_pylist()[0])
            q_ids = queries.column("query_id").to_pylist()
            q = queries.column("q").combine_chunks().flatten().to_numpy().reshape(len(q_ids), -1)
            norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
            asked = np.concatenate([q / norm, np.zeros((len(q), 1))], axis=1).astype(np.float32)
            for a in range(0, len(q), BATCH):
                found = graph.search(asked[a:a + BATCH], ef)
                exact = np.where(found >= 0, np.einsum("bkd,bd->bk", values[found], q[a:a + BATCH]), -np.inf)
                order = np.argsort(-exact, axis=1, kind="stable")
                for r in range(len(found)):
                    rows = [(-exact[r, c], i) for c in order[r] if found[r, c] >= 0 for i in ids[found[r, c]] if i != q_ids[a + r]][:k * (k + 1)]
                    for s, i in sorted(rows)[:k]:
                        out[0].append(q_ids[a + r])
                        out[1].append(i)
                        out[2].append(-s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def valid_vectors(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): rows with an id and a vector that isn't null, empty, all zero, or with a null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def build_index(vectors: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """One row for each shard: dim, shard, ids (the k + 1 smallest of each vector), vectors, layers, top. Written to the shared folder.

    Vectors of different length are in different shards, and never meet.
    """
    smallest = Window.partitionBy("v").orderBy("vec_id")  # cut before the shuffle too, however many ids share a vector
    distinct = (vectors.select("vec_id", "v").distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
                .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    distinct = written(distinct.select("v", "ids", F.size("v").alias("dim")), "vectors")
    shards = distinct.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = distinct.join(shards, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))
    # few rows make much work here: as many tasks as shards, not as the size of the rows suggests
    tasks = 2 * (shards.agg(F.sum("shards")).first()[0] or 1)
    return written(dealt.select("dim", "shard", "ids", "v").repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(
        _built, "dim int, shard int, ids array<array<long>>, vectors binary, layers array<binary>, top int"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (vec_id, v): the k nearest others found, nearest first, ties to the smaller id."""
    queries = queries.distinct()
    parts = max(1, -(-queries.count() // QUERY_PART))
    shards = index.select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"))
    asked = (queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("q_dim"),
                            F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("q_part")).join(shards, "q_dim"))  # every query meets every shard
    graphs = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = graphs.groupBy("dim", "shard", "part").cogroup(asked.groupBy("q_dim", "q_shard", "q_part")).applyInArrow(
        _searched(k, ef), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every`, its k nearest others by inner product.

    score is the product of the original vectors in double precision. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do rows without an id; repeated rows count once. Vectors of another length are no
    candidates. With fewer than k candidates all are returned, with none no row. An empty table gives an empty result.
    """
    vectors = valid_vectors(embeddings)
    index = build_index(vectors, k)
    return search(index, vectors.where(F.pmod("vec_id", F.lit(every)) == 0), k)


@register("op5_nearest")
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
