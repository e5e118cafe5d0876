"""Operator 11: near duplicates among embeddings by product quantisation.

Equal vectors are one node with a count. An index is fitted on a bounded sample of nodes:
`lists` coarse centers, and codebooks of the residuals, one for each run of up to four
components. Every node is indexed in the list of its nearest center, by the codes of its
residual and the length of what the codes leave out. Every node also asks the lists of its
nearest centers. In a list, tables of squared distances from the asking residual to all
entries of each codebook give a distance to every member by lookups alone; as the true one
is within what the member's codes leave out, a pair is dropped only if it can't link, and
the others are scored by cosine in double precision on the original vectors.

How many lists are asked is calibrated on pairs made at the threshold from sampled vectors,
the hardest there are, so that `recall` of them meet in one list or the other.

Where many sampled vectors lie within half the threshold's angle of one of them, that one is
the center of a core: a list whose members link with each other by the triangle inequality,
so a core of any size is counted, not compared. A core is asked by all nodes outside it that
could link with a member. The parts of crowded lists meet in blocks; a block tells sums of
links and a forest of what it joined, never pairs.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing. Repeated ids are rows of their own; component_id is the least
id among a component's rows (null if none has one), and `kept` is whether it is the row's
own, nulls being equal. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreline.llm.common import materialize, plain, told
from acreline.llm.op3_minhash import components
from acreline.llm.op5_ann import scaled, unit

SIMILAR = 0.9
#: Share of pairs at the threshold that must meet.
RECALL = 0.97
SAMPLE_ROWS = 16_384
#: Lists at most; fewer for small tables, the square root of their nodes.
LISTS = 1_024
#: Sampled vectors that are looked at for cores, and how many of them a core holds at least.
CORE_SAMPLE, CORE_LEAST = 4_096, 16
#: Components of a subspace at most, and entries of its codebook.
SUBSPACE, CODES = 4, 256
#: Members of a list, and nodes that ask it, that meet at once.
BLOCK = 4_096
#: What rounding can do to an angle or a squared distance.
SLACK = 1e-6


class Index:
    """Centers of lists and of cores, codebooks of residuals, and the number of lists that are asked."""

    def __init__(self, sample: np.ndarray, lists: int, similar: float = SIMILAR, recall: float = RECALL, seed: int = 5) -> None:
        self.similar, self.rng = similar, np.random.default_rng(seed)
        self.angle = float(np.arccos(similar))
        self.size = sample.shape[1]
        u = unit(sample)
        self.cores = self._cores(u[:CORE_SAMPLE])
        loose = u[self._core_of(u) < 0]
        self.centers = self._means(loose if len(loose) else u, lists)
        home = self.home_of(u)
        edges = np.arange(0, self.size + SUBSPACE, SUBSPACE).clip(max=self.size)
        self.spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        left = u - self.center_of(home)
        self.books = [self._book(left[:, a:b]) for a, b in self.spans]
        self.asked = self._calibrate(loose if len(loose) else u, recall)

    def _cores(self, u: np.ndarray) -> np.ndarray:
        """Centers that hold at least CORE_LEAST of the vectors within half the angle, the fullest first."""
        half = np.cos(self.angle / 2)
        held = np.concatenate([(u[at : at + 512] @ u.T >= half).sum(axis=1) for at in range(0, len(u), 512)])
        free = np.ones(len(u), bool)
        out = []
        for i in np.argsort(-held, kind="stable").tolist():
            if held[i] < CORE_LEAST:
                break
            if free[i]:
                within = free & (u @ u[i] >= half)
                if within.sum() >= CORE_LEAST:
                    center = u[within].sum(axis=0)
                    center /= np.linalg.norm(center)
                    better = free & (u @ center >= half)
                    if better.sum() < within.sum():
                        center, better = u[i], within
                    out.append(center)
                    free &= ~better
        return np.array(out).reshape(-1, self.size)

    def _means(self, u: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
        centers = u[self.rng.choice(len(u), min(lists, len(u)), replace=False)]
        for _ in range(rounds):
            own = (u @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, u)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norms > SLACK, sums / np.where(norms > SLACK, norms, 1), centers)
        return centers

    def _book(self, x: np.ndarray, rounds: int = 6) -> np.ndarray:
        x = x[:8_192]
        book = x[self.rng.choice(len(x), min(CODES, len(x)), replace=False)]
        for _ in range(rounds):
            own = self._code(x, book)
            sums = np.zeros_like(book)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=len(book))[:, None]
            book = np.where(n > 0, sums / np.maximum(n, 1), book)
        return book

    @staticmethod
    def _code(x: np.ndarray, book: np.ndarray) -> np.ndarray:
        return ((book * book).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)

    def _core_of(self, u: np.ndarray) -> np.ndarray:
        """The nearest core that holds each unit vector, or -1."""
        if not len(self.cores):
            return np.full(len(u), -1)
        near = u @ self.cores.T
        own = near.argmax(axis=1)
        return np.where(near[np.arange(len(u)), own] >= np.cos(self.angle / 2) + SLACK, own, -1)

    def home_of(self, u: np.ndarray) -> np.ndarray:
        """The list of each unit vector; cores are numbered after the other lists."""
        core = self._core_of(u)
        return np.where(core >= 0, len(self.centers) + core, (u @ self.centers.T).argmax(axis=1))

    def center_of(self, home: np.ndarray) -> np.ndarray:
        return np.concatenate([self.centers, self.cores])[home]

    def lists_of(self, u: np.ndarray, home: np.ndarray) -> np.ndarray:
        """(rows, lists) whether each unit vector asks each list."""
        near = u @ self.centers.T
        asked = min(self.asked, near.shape[1])
        least = np.partition(near, near.shape[1] - asked, axis=1)[:, near.shape[1] - asked]
        out = near >= least[:, None]
        if len(self.cores):
            reach = min(np.pi, 1.5 * self.angle + SLACK)
            out = np.concatenate([out, u @ self.cores.T >= np.cos(reach)], axis=1)
            inside = np.flatnonzero(home >= len(self.centers))
            out[inside, home[inside]] = False  # a core's members link without being asked
        return out

    def _calibrate(self, u: np.ndarray, recall: float, probes: int = 400) -> int:
        if len(u) < 2 or len(self.centers) < 2:
            return len(self.centers)
        one = u[self.rng.integers(0, len(u), probes)]
        aside = np.where(np.arange(probes)[:, None] % 2 == 0, u[self.rng.integers(0, len(u), probes)], self.rng.normal(size=one.shape))
        aside = aside - (aside * one).sum(axis=1, keepdims=True) * one
        norms = np.linalg.norm(aside, axis=1)
        one, aside = one[norms > SLACK], aside[norms > SLACK] / norms[norms > SLACK, None]
        if not len(one):
            return len(self.centers)
        two = np.cos(self.angle) * one + np.sin(self.angle) * aside
        a, b = one @ self.centers.T, two @ self.centers.T
        rank = lambda near, home: (near > near[np.arange(len(near)), home][:, None]).sum(axis=1) + 1
        return int(np.quantile(np.minimum(rank(a, b.argmax(axis=1)), rank(b, a.argmax(axis=1))), recall, method="higher"))

    def codes_of(self, u: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, length of what they leave out) of each unit vector."""
        left = u - self.center_of(home)
        codes = np.stack([self._code(left[:, a:b], book) for (a, b), book in zip(self.spans, self.books, strict=True)], axis=1)
        rest = sum(((left[:, a:b] - book[codes[:, m]]) ** 2).sum(axis=1) for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)))
        return codes.astype(np.uint8), np.sqrt(rest)

    def candidates(self, u: np.ndarray, home: int, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking row, member) of all pairs that their table distances let pass."""
        left = u - self.center_of(np.array([home]))
        far = np.zeros((len(u), len(codes)), np.float32)
        for m, ((a, b), book) in enumerate(zip(self.spans, self.books, strict=True)):
            x = left[:, a:b]
            table = (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1) - 2 * (x @ book.T)
            far += table.astype(np.float32)[:, codes[:, m]]
        reach = (np.sqrt(2 - 2 * self.similar) + rest) ** 2
        return np.nonzero(far <= (reach * (1 + 1e-4) + 1e-4).astype(np.float32))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node joined with it) of the nodes on these links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        low = least.copy()
        np.minimum.at(low, one, least[two])
        np.minimum.at(low, two, low[one])
        low = low[low]
        if (low == least).all():
            return nodes, nodes[least]
        least = low


def _rows(vectors: DataFrame) -> tuple[DataFrame, int, np.dtype]:
    """(vec_id, key: null if it takes no part, vector as bytes), components of a vector, their type."""
    rows = plain(vectors, ["vec_id", "embedding"])
    single = rows.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"))
    sizes = rows.filter("size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            whole = np.array(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == size) & (size > 0)
            flat = lists.filter(pa.array(whole)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(-1, max(size, 1))  # a null is a NaN here
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            at = np.flatnonzero(whole)[good]
            held: list[bytes | None] = [None] * batch.num_rows
            for i, v in zip(at.tolist(), x[good], strict=True):
                held[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(held, pa.binary())], names=["vec_id", "vector"])

    packed = rows.mapInArrow(work, "vec_id long, vector binary")
    return packed.select("vec_id", F.unhex(F.md5("vector")).alias("key"), "vector"), size, kind


def near_duplicates(vectors: DataFrame, similar: float = SIMILAR, sample_rows: int = SAMPLE_ROWS, lists: int = LISTS, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = vectors.sparkSession
    rows, size, kind = _rows(vectors)
    nodes = rows.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min("vector").alias("vector"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered once, as written
    apart = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    many = nodes.count()
    if not many:
        return apart
    sample = nodes.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("vector").collect()
    index = Index(np.array([np.frombuffer(r.vector, kind) for r in sample]), max(1, min(lists, int(many**0.5))), similar, recall)
    shared = spark.sparkContext.broadcast(index)  # bounded by the sample

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                u = unit(np.frombuffer(b"".join(batch.column("vector").to_pylist()), kind).reshape(-1, size))
                home = index.home_of(u)
                codes, rest = index.codes_of(u, home)
                asks = [np.flatnonzero(x).astype(np.int32) for x in index.lists_of(u, home)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("n"), batch.column("vector"), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(rest), pa.array(asks, pa.list_(pa.int32()))],
                    names=["node", "n", "vector", "home", "codes", "rest", "asks"],
                )

    placed = nodes.select("node", "n", "vector").mapInArrow(place, "node long, n long, vector binary, home int, codes binary, rest double, asks array<int>")
    placed = materialize(placed, "placed")
    # a row a core: the node that stands for all of it, and the rows in it
    cores = placed.filter(F.col("home") >= len(index.centers)).groupBy(F.col("home").alias("core")).agg(F.min("node").alias("top"), F.sum("n").alias("within"))
    cores = F.broadcast(materialize(cores, "cores"))  # bounded by the sample
    known = placed.join(cores, F.col("home") == F.col("core"), "left").withColumn("top", F.coalesce("top", "node"))

    members = placed.groupBy("home").count().withColumnRenamed("home", "list")
    asking = placed.select(F.explode("asks").alias("list")).groupBy("list").count().withColumnRenamed("count", "asking")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    cuts = members.join(asking, "list").select("list", parts("count").alias("parts"), parts("asking").alias("asking_parts"))
    cuts = F.broadcast(materialize(cuts, "cuts"))  # a row a list
    some = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = known.join(cuts, F.col("home") == F.col("list")).select("list", dealt("parts").alias("part"), some("asking_parts").alias("block"), "node", "top", "n", "vector", "codes", "rest", "asks")
    right = known.select(F.explode("asks").alias("list"), "node", "top", "n", "vector", "home").join(cuts, "list").select("list", some("parts").alias("part"), dealt("asking_parts").alias("block"), "node", "top", "n", "vector", "home")
    right = right.toDF(*right.columns)  # columns of its own, as both sides come from one table

    def meet(held: pa.Table, asks: pa.Table) -> pa.Table:
        index = shared.value
        nodes, links, tops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if held.num_rows and asks.num_rows:
            at = held.column("list")[0].as_py()
            raw = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(-1, size)
            longs = lambda t, c: t.column(c).to_numpy().astype(np.int64)
            mine, theirs = raw(held), raw(asks)
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(held.num_rows, -1)
            rest, asked_back = held.column("rest").to_numpy(), [set(x) for x in held.column("asks").to_pylist()]
            node, n, top = longs(held, "node"), longs(held, "n"), longs(held, "top")
            other, m, other_top, home = longs(asks, "node"), longs(asks, "n"), longs(asks, "top"), longs(asks, "home")
            step = max(1, 1_000_000 // len(mine))
            for i in range(0, len(theirs), step):
                q, v = index.candidates(unit(theirs[i : i + step]), at, codes, rest)
                q = q + i
                # a pair that meets in two lists, or twice in one, counts where it meets first
                once = np.fromiter((other[x] < node[y] if home[x] == at else at < home[x] or home[x] not in asked_back[y] for x, y in zip(q.tolist(), v.tolist(), strict=True)), bool, len(q))
                q, v = q[once], v[once]
                near = np.concatenate([np.zeros(0, bool), *[cosines(theirs[q[k : k + 65_536]], mine[v[k : k + 65_536]]) >= index.similar for k in range(0, len(q), 65_536)]])
                q, v = q[near], v[near]
                nodes += [other[q], node[v]]
                links += [n[v], m[q]]
                tops.append(forest(other_top[q], top[v]))
                if sum(map(len, nodes)) > 1 << 20:
                    nodes, links = _summed(nodes, links)
            nodes, links = _summed(nodes, links)
        joined = forest(*[np.concatenate(x) for x in zip(*tops, strict=True)])
        linked, lone = np.concatenate(nodes), joined[0] != joined[1]
        pad = lambda a, b: pa.array(np.concatenate([a, b]))
        none = np.zeros(int(lone.sum()), np.int64)
        return pa.table({"node": pad(linked, none - 1), "links": pad(np.concatenate(links), none), "a": pad(np.zeros(len(linked), np.int64), joined[0][lone]), "b": pad(np.zeros(len(linked), np.int64), joined[1][lone])})

    keys = ["list", "part", "block"]
    found = materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "node long, links long, a long, b long"), "found")
    pairs = found.filter("a <> b").select("a", "b")
    labels = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().withColumn("class", F.col("key"))
    classes = components(pairs, labels) if pairs.limit(1).count() else labels
    counted = found.filter("node >= 0").groupBy("node").agg(F.sum("links").alias("links"))
    result = known.select("node", "top", (F.col("n") - 1 + F.coalesce(F.col("within") - F.col("n"), F.lit(0))).alias("own")).join(counted, "node", "left")
    result = result.select("node", "top", (F.col("own") + F.coalesce("links", F.lit(0))).alias("n_links"))
    # members of a core share its top, so a top may be hot; those of joined tops are few
    moved = classes.filter("key <> class").select(F.col("key").alias("top"), "class", F.lit(1).alias("n"))
    sizes = result.groupBy("top").agg(F.count("*").alias("n"))
    moved = materialize(sizes.join(moved.drop("n"), "top", "left").select("top", F.coalesce("class", "top").alias("class"), "n"), "classes")
    result = told(result, moved, "top", ["class"]).join(nodes.select("node", "key", "n", "least"), "node").select("key", "n", "least", "n_links", "class")
    result = materialize(result, "linked")
    ids = materialize(result.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "components")
    result = told(result.withColumnRenamed("n", "copies"), ids, "class", ["component_id"])
    single = result.filter("copies = 1").select(F.col("least").alias("vec_id"), "n_links", "component_id")
    repeated = materialize(result.filter("copies > 1").select("key", "n_links", "component_id", F.col("copies").alias("n")), "repeated")
    copies = rows.filter("key is not null").select("vec_id", "key")
    copies = told(copies, repeated, "key", ["n_links", "component_id"]).select("vec_id", "n_links", "component_id")
    out = single.unionByName(copies).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    return out.unionByName(apart)


def _summed(nodes: list[np.ndarray], links: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same with one sum a node."""
    own, at = np.unique(np.concatenate(nodes), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, np.concatenate(links))
    return [own], [total]


SQL = """
WITH RECURSIVE kept AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM kept a JOIN kept b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN least ON e.vec_id = least.a
"""
