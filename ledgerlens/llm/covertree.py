"""Exact top-k inner products by dual-tree search: cover trees over queries and over blocks of the data."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_once

K = 5
EVERY = 50
SCALE = 256
BASE = 2.0
LEAF = 64
BLOCK = 8192
CHUNK = 1024
CHUNKS_AT_ONCE = 16
SEEDS = 2048
PIVOTS = 64


class CoverTree:
    """A cover tree over integer vectors, grown from the top.

    The children of a node of radius r have centres more than r / BASE apart, the node's own among them, and each covers points
    within r / BASE of its centre. A node is a leaf if it has few points, if they are equal, or if covering them takes so many centres that
    they show no groups at its scale. Points are kept in an order in which every node covers one stretch.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centers, self.radii, self.kids, self.lo, self.hi = [], [], [], [], []
        order: list[int] = []
        space = points.astype(np.float64)
        if len(points):
            middle = int(np.argmin(((space - space.mean(axis=0)) ** 2).sum(axis=1)))
            self._grow(space, np.arange(len(points)), middle, order)
        self.order = np.array(order, np.int64)
        self.points = points[self.order]
        self.space = space[self.order]
        self.middle = space[self.centers] if self.centers else space[:0]
        self.norms = np.sqrt((self.middle**2).sum(axis=1))
        self.radii, self.lo, self.hi = np.array(self.radii), np.array(self.lo, np.int64), np.array(self.hi, np.int64)

    def _grow(self, space: np.ndarray, own: np.ndarray, center: int, order: list[int]) -> int:
        node = len(self.centers)
        far = np.sqrt(((space[own] - space[center]) ** 2).sum(axis=1))
        self.centers.append(center)
        self.radii.append(float(far.max()) * (1 + 1e-9))
        self.kids.append([])
        self.lo.append(len(order))
        self.hi.append(0)
        kids = []
        if len(own) > LEAF and far.max() > 0:
            reach, most = far.max() / BASE, 16 + 4 * int(len(own) ** 0.5)
            centers, owner = [center], np.zeros(len(own), np.int64)
            while far.max() > reach and len(centers) < most:
                new = int(own[np.argmax(far)])
                from_new = np.sqrt(((space[own] - space[new]) ** 2).sum(axis=1))
                owner[from_new < far] = len(centers)
                far = np.minimum(far, from_new)
                centers.append(new)
            if far.max() <= reach:
                kids = [(own[owner == k], c) for k, c in enumerate(centers)]
        for part, c in kids:
            self.kids[node].append(self._grow(space, part, c, order))
        if not kids:
            order.extend(own.tolist())
        self.hi[node] = len(order)
        return node


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats where every sum is below 2 ** 53, else in 64-bit integers."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The best ``k`` (score, id) of each query so far, higher scores and then smaller ids first, and its kth score."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k, self.queries = k, queries
        self.floor = np.full(queries, np.iinfo(np.int64).min) if floor is None else floor.copy()
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        row, score, id_ = (np.concatenate(x) for x in ((self.row, rows), (self.score, scores), (self.id, ids)))
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kth = place == self.k - 1
        self.floor[row[kth]] = np.maximum(self.floor[row[kth]], score[kth])
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]


def dual_search(queries: CoverTree, data: CoverTree, id_at: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Put into ``best`` (by place in ``queries``) all that the data tree can add; point ``p`` of the data has the ids
    ``ids[id_at[p]:id_at[p + 1]]``. Returns how many products were taken.

    Node pairs wait with the most promising last. The inner product of a pair is at most <cq, cd> + rq |cd| + rd |cq| + rq rd;
    the pair is dropped if that is below the kth score of every query under the node. The larger node is opened first; two
    leaves are compared point by point.
    """
    if not len(queries.points) or not len(data.points):
        return 0
    products = 0

    def bound(q: int, d: np.ndarray) -> np.ndarray:
        rq, rd = queries.radii[q], data.radii[d]
        top = data.middle[d] @ queries.middle[q] + rq * data.norms[d] + rd * queries.norms[q] + rq * rd
        return top + 1e-9 * np.abs(top) + 1e-6

    stack = [(0, 0, float(bound(0, np.array([0]))[0]))]
    while stack:
        q, d, top = stack.pop()
        a, b = queries.lo[q], queries.hi[q]
        if top < best.floor[a:b].min():
            continue
        open_data = data.kids[d] and (data.radii[d] >= queries.radii[q] or not queries.kids[q])
        if open_data:
            kids = np.array(data.kids[d])
            tops = bound(q, kids)
            stack += sorted(((q, int(k), float(t)) for k, t in zip(kids, tops)), key=lambda x: x[2])
        elif queries.kids[q]:
            found = [(k, d, float(bound(k, np.array([d]))[0])) for k in queries.kids[q]]
            stack += sorted(found, key=lambda x: x[2])
        else:
            lo, hi = data.lo[d], data.hi[d]
            scores = _dot(queries.points[a:b], data.points[lo:hi])
            products += scores.size
            row, column = np.nonzero(scores >= best.floor[a:b, None])
            if len(row):
                score, point = scores[row, column], lo + column
                if len(row) > 4 * best.k * (b - a):
                    # more than any result can use: of each row only scores from its kth on can stay
                    kth = np.sort(scores, axis=1)[:, -min(best.k, scores.shape[1])]
                    stay = score >= kth[row]
                    row, score, point = row[stay], score[stay], point[stay]
                many = (id_at[point + 1] - id_at[point]).astype(np.int64)
                at = np.repeat(id_at[point] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                best.add(a + np.repeat(row, many), np.repeat(score, many), ids[at])
    return products


def _pack(tree: CoverTree, **more: np.ndarray) -> bytes:
    kids = np.concatenate([np.zeros(0, np.int64), *[np.array(k, np.int64) for k in tree.kids]])
    kid_at = np.concatenate([[0], np.cumsum([len(k) for k in tree.kids])]).astype(np.int64)
    out = io.BytesIO()
    np.savez(out, points=tree.points, middle=tree.middle, radii=tree.radii, lo=tree.lo, hi=tree.hi, kids=kids, kid_at=kid_at, **more)
    return out.getvalue()


def _unpack(data: bytes) -> tuple[CoverTree, dict]:
    found = dict(np.load(io.BytesIO(data), allow_pickle=False))
    tree = CoverTree.__new__(CoverTree)
    tree.points, tree.middle, tree.radii, tree.lo, tree.hi = (found.pop(k) for k in ("points", "middle", "radii", "lo", "hi"))
    kids, at = found.pop("kids"), found.pop("kid_at")
    tree.kids = [kids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    tree.norms = np.sqrt((tree.middle**2).sum(axis=1))
    return tree, found


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, packed``: components as ``floor(SCALE * x)`` in 64-bit little-endian integers, without the zeros that
    end them. Rows with a null id, or a vector that is null or has a null or non-finite component, are left out."""
    own = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, packed = [], []
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("x")):
                if vec_id is None or not x.is_valid or x.values.null_count:
                    continue
                values = x.values.to_numpy(zero_copy_only=False)
                if np.isfinite(values).all():
                    ids.append(vec_id)
                    packed.append(np.trim_zeros(np.floor(SCALE * values).astype("<i8"), "b").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary())], ["vec_id", "packed"])

    return own.mapInArrow(run, "vec_id long, packed binary")


def _points(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for k, p in enumerate(packed):
        out[k, : len(p) // 8] = np.frombuffer(p, "<i8")
    return out


def top_products(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, the ``k`` other rows with the
    highest integer inner product of the quantised vectors (all, if there are fewer), ties to the smaller id.

    Null ids, null vectors and those with null or non-finite components take no part; shorter vectors count as ended by
    zeros; rows that repeat an id and vector count once; an empty table gives no rows.

    Equal vectors are one point that carries its ``k + 1`` smallest ids, as no query can use more. Points are dealt by nearest
    pivot into blocks, each indexed by one cover tree; distinct query vectors are cut into chunks with a tree each. A chunk meets every block
    as one pair of trees. The kth scores start from ``SEEDS`` points that every block knows, so a block prunes from its first node pair.
    """
    rows = write_once(quantised(vectors, id_col, vector_col).distinct())
    width = (rows.agg(F.max(F.length("packed"))).first()[0] or 0) // 8
    # of each vector the k + 1 smallest ids; the limit is applied before the shuffle
    nth = F.dense_rank().over(Window.partitionBy("packed").orderBy("vec_id"))
    points = rows.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1)
    points = write_once(points.groupBy("packed").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.filter(F.col("vec_id") % every == 0)
    queries = write_once(asked.select("packed").distinct())

    seeds = points.orderBy(F.xxhash64("packed"), "packed").limit(SEEDS).collect()
    seed_points = _points([bytes(s.packed) for s in seeds], width)
    seed_ids = np.array([len(s.ids) for s in seeds], np.int64)
    pivots = seed_points[:PIVOTS].astype(np.float64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _points(batch.column("packed").to_pylist(), width).astype(np.float64)
            near = ((pivots**2).sum(axis=1) - 2 * at @ pivots.T).argmin(axis=1) if len(pivots) else np.zeros(len(at))
            yield batch.append_column("pivot", pa.array(near.astype(np.int32)))

    near = write_once(points.mapInArrow(deal, "packed binary, ids array<long>, pivot int"))
    sizes = {r.pivot: r["count"] for r in near.groupBy("pivot").count().collect()}  # one row per pivot
    starts, blocks = {}, 0
    for pivot in sorted(sizes):
        starts[pivot] = blocks
        blocks += -(-sizes[pivot] // BLOCK)
    first = F.create_map(*[F.lit(x) for p in starts for x in (p, starts[p])] or [F.lit(0), F.lit(0)])
    parts = F.create_map(*[F.lit(x) for p in starts for x in (p, -(-sizes[p] // BLOCK))] or [F.lit(0), F.lit(1)])
    block = F.element_at(first, F.col("pivot")) + F.pmod(F.xxhash64("packed"), F.element_at(parts, F.col("pivot"))).cast("int")

    def index(table: pa.Table) -> pa.Table:
        tree = CoverTree(_points(table["packed"].to_pylist(), width))
        ids = [table["ids"][int(i)].as_py() for i in tree.order]
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        packed = _pack(tree, id_at=at, ids=np.array([i for x in ids for i in x], np.int64))
        return pa.table({"block": table["block"][:1], "tree": pa.array([packed], pa.binary())})

    trees = write_once(near.withColumn("block", block).groupBy("block").applyInArrow(index, "block int, tree binary"))

    n_chunks = max(1, -(-queries.count() // CHUNK))

    def chunk(table: pa.Table) -> pa.Table:
        tree = CoverTree(_points(table["packed"].to_pylist(), width))
        packed = [table["packed"][int(i)].as_py() for i in tree.order]
        scores = _dot(tree.points, seed_points)
        floor = np.full(len(packed), np.iinfo(np.int64).min)
        if seed_ids.sum() > k:
            entries = np.sort(np.repeat(scores, seed_ids, axis=1), axis=1)
            floor = entries[:, -(k + 1)]
        return pa.table({"chunk": table["chunk"][:1], "qtree": pa.array([_pack(tree, floor=floor)], pa.binary()), "asked": pa.array([packed], pa.list_(pa.binary()))})

    chunks = queries.withColumn("chunk", F.pmod(F.xxhash64("packed"), F.lit(n_chunks)).cast("int"))
    chunks = chunks.groupBy("chunk").applyInArrow(chunk, "chunk int, qtree binary, asked array<binary>")
    groups = -(-n_chunks // CHUNKS_AT_ONCE)
    left = trees.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = write_once(chunks).withColumn("batch", (F.col("chunk") / CHUNKS_AT_ONCE).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))

    def search(data: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"packed": [], "score": [], "vec_id": []}
        if data.num_rows:
            tree, found = _unpack(data["tree"][0].as_py())
            for row in range(asked.num_rows):
                queries, more = _unpack(asked["qtree"][row].as_py())
                best = Best(len(queries.points), k + 1, more["floor"])
                dual_search(queries, tree, found["id_at"], found["ids"], best)
                names = asked["asked"][row].as_py()
                out["packed"] += [names[i] for i in best.row]
                out["score"] += best.score.tolist()
                out["vec_id"] += best.id.tolist()
        kinds = {"packed": pa.binary(), "score": pa.int64(), "vec_id": pa.int64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    met = left.groupBy("block", "batch").cogroup(right.groupBy("block", "batch"))
    found = met.applyInArrow(search, "packed binary, score long, vec_id long")
    by_vector = Window.partitionBy("packed").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("_nth", F.row_number().over(by_vector)).filter(F.col("_nth") <= k + 1)
    found = found.groupBy("packed").agg(F.collect_list(F.struct((-F.col("score")).alias("low"), F.col("vec_id"))).alias("best"))
    mine = asked.withColumnRenamed("vec_id", "query_id").join(found, "packed")
    others = F.slice(F.filter(F.array_sort("best"), lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = mine.select("query_id", F.posexplode(others).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))


#: The same in DuckDB SQL, over the table ``embeddings``.
SQL = f"""
WITH rows AS (SELECT DISTINCT vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
          FROM rows q JOIN rows c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""
