"""Exact top-k search by inner product with cover trees of queries and data, searched together.

Rows are dealt to the nearest of ``PIVOTS`` pivots, the first points of a farthest-first traversal of a bounded sample,
and a pivot's rows are dealt into blocks of about ``BLOCK_ROWS``. A task makes a cover tree of each block: a node's
children are the next points of a farthest-first traversal of its rows, which are as far from one another as the
covering radius that is left, and every row goes to the nearest one. Blocks are stored with their trees. Queries get a
tree of their own, in the same way, and are sent to all blocks, ``QUERY_ROWS`` at a time.

A pair of nodes is pruned if the inner products of its rows can't reach the worst k-th score of the query node: with
centres a and b and covering radii r and s, none is above <a, b> + r |b| + s |a| + r s. Otherwise the node with the
larger radius is split, the most promising child first; two leaves are compared by one exact product. The k-th scores
start from the sample, rise within a task over all its blocks, and the tasks' results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitrank.llm.blocks import dropped, written

PIVOTS, SAMPLE = 64, 2048  #: pivots, and the rows (those with the smallest hashes) that they are chosen from
BLOCK_ROWS, LEAF, FAN = 4096, 32, 8
QUERY_ROWS = 1 << 15
NO_ID, LEAST = 2**63 - 1, -(2**63)
_NODES = {"start": np.int32, "end": np.int32, "child": np.int32, "children": np.int32, "centre": np.int32, "radius": np.float64}
_BLOCK_DDL = "dim int, ids binary, rows binary, " + ", ".join(f"{k} binary" for k in _NODES)


def whole(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(1024 x), missing components 0, as 64-bit integers."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = np.floor(1024 * lists.flatten().to_numpy().astype(np.float64)).astype(np.int64)
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact: in doubles while sums stay below 2**53, else in 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = d * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2.0**53 else a @ b.T


class Tree:
    """A cover tree: rows in an order in which every node's are neighbours, and per node its rows (start, end),
    children (child, children), centre (a row), and covering radius. Parents come before children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, nodes: dict[str, np.ndarray]):
        self.ids, self.rows, self.nodes = ids, rows, nodes
        for k, kind in _NODES.items():
            setattr(self, k, nodes[k].astype(kind))
        self.at = rows[self.centre].astype(np.float64)
        self.norm = np.sqrt((self.at**2).sum(axis=1))

    @staticmethod
    def make(ids: np.ndarray, rows: np.ndarray) -> Tree:
        v, order = rows.astype(np.float64), np.arange(len(rows))
        nodes: dict[str, list] = {k: [] for k in _NODES}
        todo = [(0, len(rows), 0)] if len(rows) else []
        done = 0
        while done < len(todo):
            start, end, centre = todo[done]
            done += 1
            own = order[start:end]
            near = np.sqrt(((v[own] - v[centre]) ** 2).sum(axis=1))
            radius, centres = float(near.max()), [centre]
            if end - start > LEAF and radius > 0:
                owner = np.zeros(len(own), np.int64)
                while len(centres) < FAN and near.max() > 0:
                    new = own[near.argmax()]
                    d = np.sqrt(((v[own] - v[new]) ** 2).sum(axis=1))
                    owner[d < near] = len(centres)
                    near = np.minimum(near, d)
                    centres.append(new)
                by = np.argsort(owner, kind="stable")
                order[start:end] = own[by]
                edge = start + np.searchsorted(owner[by], np.arange(len(centres) + 1))
            child = len(todo) if len(centres) > 1 else 0
            for k, x in zip(_NODES, (start, end, child, len(centres) if child else 0, centre, radius), strict=True):
                nodes[k].append(x)
            if child:
                todo += [(int(a), int(b), c) for a, b, c in zip(edge[:-1], edge[1:], centres, strict=True)]
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        made = {k: np.array(x, _NODES[k]) for k, x in nodes.items()}
        made["centre"] = place[made["centre"]].astype(np.int32)
        return Tree(ids[order], rows[order], made)


class Heaps:
    """The k best scores and ids of each query, in the order of the query tree, above thresholds known before."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.scores, self.ids, self.floor = np.full((n, k), LEAST), np.full((n, k), NO_ID), floor.copy()
        self.pairs = [0, 0]  #: node pairs seen, leaf pairs compared

    def offer(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = np.flatnonzero((scores >= self.floor[a:b, None]).any(axis=1))
        if not len(rows):
            return
        k, at = self.scores.shape[1], a + rows
        s = np.concatenate([self.scores[at], scores[rows]], axis=1)
        i = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((i, ~s), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.floor[at] = np.maximum(self.floor[at], self.scores[at, -1])


def _bounds(q: Tree, i: int | np.ndarray, r: Tree, j: int | np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of rows below nodes i and j, one of which is an array."""
    d = min(q.at.shape[1], r.at.shape[1])
    x = r.at[j][..., :d] @ q.at[i][:d] if np.ndim(j) else q.at[i][..., :d] @ r.at[j][:d]
    up = x + q.radius[i] * r.norm[j] + r.radius[j] * q.norm[i] + q.radius[i] * r.radius[j]
    return up + 1e-9 * np.abs(up) + 1e-3  # roundings


def dual(q: Tree, r: Tree, heaps: Heaps) -> None:
    """Compares the queries of one tree with the rows of another, depth first."""
    if not len(q.start) or not len(r.start):
        return
    todo = [(math.inf, 0, 0)]
    while todo:
        bound, i, j = todo.pop()
        a, b = q.start[i], q.end[i]
        heaps.pairs[0] += 1
        if bound < heaps.floor[a:b].min():
            continue
        if q.children[i] and (q.radius[i] >= r.radius[j] or not r.children[j]):
            new = np.arange(q.child[i], q.child[i] + q.children[i])
            up = _bounds(q, new, r, j)
            todo += [(up[x], int(new[x]), j) for x in np.argsort(up)]
        elif r.children[j]:
            new = np.arange(r.child[j], r.child[j] + r.children[j])
            up = _bounds(q, i, r, new)
            todo += [(up[x], i, int(new[x])) for x in np.argsort(up)]
        else:
            heaps.pairs[1] += 1
            c, d = r.start[j], r.end[j]
            scores = products(q.rows[a:b], r.rows[c:d])
            scores[q.ids[a:b, None] == r.ids[c:d]] = LEAST
            heaps.offer(a, b, scores, r.ids[c:d])


def _pivots(sample: np.ndarray) -> np.ndarray:
    """The first points of a farthest-first traversal."""
    v, near, at = sample.astype(np.float64), np.full(len(sample), np.inf), []
    while len(at) < PIVOTS and len(v) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, np.sqrt(((v - v[at[-1]]) ** 2).sum(axis=1)))
    return v[at]


def _bytes(rows: np.ndarray) -> bytes:
    """Rows in as few bytes a component as all of them allow; the width is found again from the length."""
    most = int(np.abs(rows).max(initial=0))
    return rows.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64).tobytes()


def _tree_of(block: pa.Table) -> pa.Table:
    rows = whole(block["v"])
    t = Tree.make(block["id"].fill_null(NO_ID).to_numpy(), rows)
    data = [pa.array([rows.shape[1]], pa.int32()), pa.array([t.ids.astype(np.int64).tobytes()]), pa.array([_bytes(t.rows)])]
    data += [pa.array([getattr(t, k).tobytes()]) for k in _NODES]
    return pa.table(data, names=["dim", "ids", "rows", *_NODES])


def stored(row: dict) -> Tree:
    """The tree of a row of the index."""
    ids = np.frombuffer(row["ids"], np.int64)
    width = len(row["rows"]) // max(1, len(ids) * row["dim"])
    return Tree(ids, np.frombuffer(row["rows"], f"<i{width or 2}").astype(np.int64).reshape(len(ids), row["dim"]), {k: np.frombuffer(row[k], kind) for k, kind in _NODES.items()})


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id and v of the rows whose vector is there, with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))


def build(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, pa.Table]:
    """The index, a row for each block with its tree, and the sample (id, v). A pivot near to which very many rows lie
    gets as many blocks as they need."""
    d = usable(vectors, vec_id, vector)
    sample = d.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).toArrow()
    at = _pivots(whole(sample["v"]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (at**2).sum(axis=1)
        for batch in batches:
            v = whole(batch["v"]).astype(np.float64)
            dim = min(v.shape[1], at.shape[1] if len(at) else 0)
            pivot = (size - 2 * v[:, :dim] @ at[:, :dim].T).argmin(axis=1) if len(at) else np.zeros(len(v), np.int64)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.array(pivot.astype(np.int32))], ["id", "v", "pivot"])

    dealt = d.mapInArrow(near, f"id long, v {d.schema['v'].dataType.simpleString()}, pivot int")
    many = {p: -(-n // BLOCK_ROWS) for p, n in dealt.groupBy("pivot").count().collect()}  # a row for each pivot
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("pivot")], F.lit(1)) if many else F.lit(1)
    # rows that repeat are dealt by their place as well, so that they don't fill one block
    salt = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), parts).cast("int")
    return dealt.withColumn("part", salt).groupBy("pivot", "part").applyInArrow(_tree_of, _BLOCK_DDL), sample


def _floors(q: Tree, sample: pa.Table, k: int) -> np.ndarray:
    """For each query the k-th best score within the sample."""
    s, ids = whole(sample["v"]), sample["id"].combine_chunks().fill_null(NO_ID).to_numpy()
    out = np.full(len(q.ids), LEAST)
    for a in range(0, len(out), 1024):
        scores = products(q.rows[a : a + 1024], s)
        scores[q.ids[a : a + 1024, None] == ids] = LEAST
        if scores.shape[1] >= k:
            out[a : a + 1024] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def search(index: DataFrame, sample: pa.Table, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` rows of the index with the greatest inner products, for each query.

    Components count as floor(1024 x); missing ones, where vectors differ in length, as 0. Products must stay below
    2**63. Equal scores go by vec_id, null last. Vectors that are null or hold null or non-finite components take no
    part. A row with the query's own id is the query itself and isn't returned; a query row that repeats is answered
    once for each time; a query without id has every row for a candidate. Fewer rows than ``k`` are all returned."""
    spark = index.sparkSession
    own = usable(queries, vec_id, vector)
    own = written(own.select("id", "v", F.monotonically_increasing_id().alias("n")))
    slices = max(1, math.ceil(own.count() / query_rows))
    done = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for x in range(slices):
        some = own.filter(F.pmod(F.xxhash64("n"), F.lit(slices)) == x).toArrow()
        if not some.num_rows:
            continue
        lone = some["id"].combine_chunks().fill_null(LEAST).to_numpy()
        q = Tree.make(lone, whole(some["v"]))
        sent = spark.sparkContext.broadcast((q.ids, q.rows, {k: getattr(q, k) for k in _NODES}, _floors(q, sample, k)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, rows, nodes, floors = sent.value
            tree = Tree(ids, rows, nodes)
            heaps = Heaps(len(ids), k, floors)
            for batch in batches:
                for row in batch.to_pylist():
                    dual(tree, stored(row), heaps)
            at, col = np.nonzero(heaps.scores > LEAST)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(ids[at]), pa.array(heaps.ids[at, col]), pa.array(heaps.scores[at, col])], ["q", "query_id", "vec_id", "score"])

        found = index.mapInArrow(run, "q int, query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
        named = best.select(F.nullif("query_id", F.lit(LEAST)).alias("query_id"), "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
        done = done.unionByName(written(named))
    dropped(own)
    return done


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made, sample = build(vectors)
    index = written(made)
    out = search(index, sample, vectors.filter("vec_id % 100 = 0"))
    dropped(index)  # the results are written
    return out


ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
