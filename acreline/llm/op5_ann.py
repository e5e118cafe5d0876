"""Operator 5: approximate nearest neighbours by cosine in a hierarchical k-means tree.

The tree is fitted on at most `sample_rows` vectors (the least by a hash of their id) on
the driver; every vector is then indexed under the leaf it descends to. A query walks the
tree best bin first: a priority queue holds the unexplored branches by their distance, and
leaves are visited in that order. The sample's own brute-force neighbours calibrate how
many leaves reach `recall`; a query visits that many, and more until they hold MORE_THAN
vectors, or all.

Leaves are cut into blocks of vectors and of queries by the leaves' counts, so a crowded
leaf or a vector that a third of rows share spreads over tasks; each block keeps the best
`k` per query (with all that tie), scored in double on the original vectors.

How large a share of the leaves that takes is the data's: of vectors without clusters (each
direction as likely) a query must see about half, of clustered ones few.

Vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part. Rows that repeat an id count as often as they come,
and no row with the query's id is its neighbour. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acreline.llm.common import materialize, plain

SAMPLE_ROWS = 8_000
BRANCHES = 8
LEAF = 60
RECALL = 0.94
PROBES = 200
K = 5
#: Vectors that the visited leaves hold at least.
MORE_THAN = 64
#: Vectors and queries of a leaf that meet in one task.
BLOCK = 1_000


class Tree:
    """Nodes as (children's centers, children's numbers); a leaf has a number below zero."""

    def __init__(self, vectors: np.ndarray, seed: int = 11) -> None:
        self.nodes: list[tuple[np.ndarray, list[int]]] = []
        self.leaves = 0
        self.visits = 1
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(unit(vectors))

    def _grow(self, v: np.ndarray) -> int:
        if len(v) > LEAF:
            centers, own = self._means(v)
            if len(np.unique(own)) > 1:
                at = len(self.nodes)
                self.nodes.append((centers, []))
                kept = [c for c in range(len(centers)) if (own == c).any()]
                self.nodes[at] = centers[kept], [self._grow(v[own == c]) for c in kept]
                return at
        self.leaves += 1
        return -self.leaves

    def _means(self, v: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        centers = v[self.rng.choice(len(v), min(BRANCHES, len(v)), replace=False)]
        for _ in range(rounds):
            own = (v @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, v)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
        return centers, (v @ centers.T).argmax(axis=1)

    def leaf_of(self, v: np.ndarray) -> np.ndarray:
        """The leaf (from 0) each unit vector descends to."""
        node = np.full(len(v), self.root, np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            for n in np.unique(node[inner]).tolist():
                at = inner[node[inner] == n]
                centers, children = self.nodes[n]
                node[at] = np.array(children)[(v[at] @ centers.T).argmax(axis=1)]
        return -node - 1

    def best_first(self, v: np.ndarray) -> Iterator[int]:
        """Leaves in the order of their branches' similarity to one unit vector."""
        queue: list[tuple[float, int]] = [(-1.0, self.root)]
        while queue:
            _, n = heapq.heappop(queue)
            while n >= 0:
                centers, children = self.nodes[n]
                near = centers @ v
                best = int(near.argmax())
                for c, s in enumerate(near.tolist()):
                    if c != best:
                        heapq.heappush(queue, (-s, children[c]))
                n = children[best]
            yield -n - 1

    def calibrate(self, vectors: np.ndarray, recall: float = RECALL, probes: int = PROBES, k: int = K) -> None:
        """Set the least number of visits at which probes find `recall` of their true neighbours in the sample."""
        v = unit(vectors)
        if len(v) <= k + 1:
            self.visits = self.leaves
            return
        leaf = self.leaf_of(v)
        probe = self.rng.choice(len(v), min(probes, len(v)), replace=False)
        needed = []
        for p in probe.tolist():
            near = v @ v[p]
            near[p] = -2
            rank = {n: i + 1 for i, n in enumerate(self.best_first(v[p]))}
            needed += [rank[n] for n in leaf[np.argpartition(-near, k)[:k]].tolist()]
        self.visits = int(np.quantile(needed, recall, method="higher"))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: exact, and nothing over- or underflows later."""
    v = v.astype(np.float64)
    _, exponent = np.frexp(np.abs(v).max(axis=-1, keepdims=True))
    return np.ldexp(v, -exponent)


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(lists: list, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(which lists take part, their vectors)."""
    keep = np.zeros(len(lists), bool)
    out = []
    for i, x in enumerate(lists):
        if x is None or size is not None and len(x) != size or any(c is None for c in x):
            continue
        v = np.array(x, np.float64)
        if len(v) and np.isfinite(v).all() and v.any():
            keep[i] = True
            out.append(v)
    return keep, np.array(out) if out else np.zeros((0, size or 0))


def nearest(query: np.ndarray, query_id: int, ids: np.ndarray, vectors: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, cosines): those near the k-th by `rough` are scored anew, alike wherever they stand."""
    rough = np.where(ids == query_id, -3, rough)
    if len(ids) > k:
        at = np.flatnonzero(rough >= np.partition(rough, -k)[-k] - 1e-9)
    else:
        at = np.arange(len(ids))
    at = at[ids[at] != query_id]
    some, query = scaled(vectors[at]), scaled(query)
    score = (some * query).sum(axis=1) / (np.sqrt((some * some).sum(axis=1)) * np.sqrt((query * query).sum()))
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def search(vectors: DataFrame, queries: str, k: int = K, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `queries` (SQL over vec_id) selects."""
    spark = vectors.sparkSession
    kind = "query_id long, rank int, vec_id long, score double"
    rows = plain(vectors, ["vec_id", "embedding"]).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("vec_id is not null and embedding is not null")
    sample = [r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()]
    sizes = Counter(len(x) for x in sample)
    size = max(sizes, key=lambda n: (sizes[n], n), default=0)
    known = usable(sample, size)[1]
    if not len(known):
        return spark.createDataFrame([], kind)
    tree = Tree(known)
    tree.calibrate(known, recall, k=k)
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            keep, v = usable(batch.column("embedding").to_pylist(), size)
            leaf = tree.leaf_of(unit(v)) if len(v) else np.zeros(0, np.int64)
            packed = [x.tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(keep)), pa.array(leaf, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "leaf", "vector"])

    indexed = materialize(rows.mapInArrow(index, "vec_id long, leaf int, vector binary"), "index")
    held = {r.leaf: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # a number a leaf
    counts_of = spark.sparkContext.broadcast(np.array([held.get(i, 0) for i in range(tree.leaves)]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, counts = shared.value, counts_of.value
        for batch in batches:
            ids, leaves = [], []
            for i, raw in enumerate(batch.column("vector").to_pylist()):
                seen = total = 0
                v = np.frombuffer(raw)
                for leaf in tree.best_first(unit(v[None])[0]):
                    seen += 1
                    total += int(counts[leaf])
                    if counts[leaf]:
                        ids.append(i)
                        leaves.append(leaf)
                    if seen >= tree.visits and total > MORE_THAN:
                        break
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(ids, pa.int64())), pa.array(leaves, pa.int32()), batch.column("vector").take(pa.array(ids, pa.int64()))], names=["query_id", "leaf", "query"])

    asked = materialize(indexed.filter(queries).mapInArrow(visit, "query_id long, leaf int, query binary"), "visits")
    wanted = {r.leaf: r["count"] for r in asked.groupBy("leaf").count().collect()}
    cuts = spark.createDataFrame([(i, -(-n // BLOCK), -(-wanted[i] // BLOCK)) for i, n in held.items() if i in wanted] or [(-1, 1, 1)], "leaf int, parts int, asked_parts int")
    cuts = F.broadcast(cuts)  # a row a leaf
    left = indexed.join(cuts, "leaf").select("leaf", F.pmod(F.xxhash64("vec_id", "vector"), "parts").alias("part"), F.explode(F.sequence(F.lit(0), F.col("asked_parts") - 1)).alias("block"), "vec_id", "vector")
    right = asked.join(cuts, "leaf").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"), F.pmod(F.xxhash64("query_id", "query"), "asked_parts").cast("int").alias("block"), "query_id", "query")

    def meet(some: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if some.num_rows and queries.num_rows:
            ids = some.column("vec_id").to_numpy()
            v = np.frombuffer(b"".join(some.column("vector").to_pylist())).reshape(-1, size)
            u = unit(v)
            for query_id, raw in zip(queries.column("query_id").to_pylist(), queries.column("query").to_pylist(), strict=True):
                q = np.frombuffer(raw)
                got, score = nearest(q, query_id, ids, v, u @ unit(q[None])[0], k)
                out += [(query_id, *x) for x in zip(got.tolist(), score.tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ["leaf", "part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
