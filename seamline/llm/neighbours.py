"""Nearest neighbours by cosine: a vantage-point tree in each shard, pruned by the triangle inequality.

Trees are built once, each where its rows were read, and written to the shared folder; blocks of queries are then dealt
out and pass by all trees in turn, so that what one tree gave already prunes the next.

Distances are those of unit vectors, whose order is that of cosines. A branch is left out where `factor` times the
least distance that the triangle inequality allows there exceeds the query's k-th best: factor 1 is exact, larger ones
search less.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as candidate or query;
a query meets candidates of its own length only. Equal scores go by the smaller id; a row that repeats an id is a
candidate of its own, and so is one whose id is null, last among equals; a query leaves out all rows of its own id. An
empty table gives an empty table. Only id_col and vector_col are read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import bounded

#: Vectors of a shard and queries of a block, about; vectors of a leaf, at most.
SHARD, BLOCK, LEAF = 4_096, 2_048, 64
#: Stands for a null id, behind all others.
MISSING = np.iinfo(np.int64).max
#: Distances are lowered by this where branches are judged: a cosine off by 1e-16 puts a distance near 0 off by 1e-8.
SLACK = 1e-7
#: What a cosine of unit vectors may be off by, generously.
NEAR = 1e-9


class VantageTree:
    """Nodes in arrays: an inner node has a vantage point and the ball and shell around it that its children fill, a leaf its rows in `order`."""

    PARTS = ("order", "point", "bounds", "children", "span")

    def __init__(self, unit: np.ndarray, parts: dict[str, np.ndarray] | None = None, leaf: int = LEAF):
        self.unit, self.leaf = unit, leaf
        self.parts = parts or self._built()
        self.__dict__.update(self.parts)

    def _built(self) -> dict[str, np.ndarray]:
        order = np.arange(len(self.unit))
        point, bounds, children, span = [-1], [(0.0,) * 4], [(-1, -1)], [(0, len(order))]
        open_ = [0]
        while open_:
            node = open_.pop()
            lo, hi = span[node]
            if hi - lo <= self.leaf:
                continue
            rows = order[lo:hi]
            spread = self.unit[rows] @ self.unit[rows[0]]
            point[node] = int(rows[int(spread.argmin())])  # far from the first: its shell cuts the set in halves that lie apart
            away = _distance(self.unit[rows] @ self.unit[point[node]])
            by_distance = np.argsort(away, kind="stable")
            order[lo:hi], away = rows[by_distance], away[by_distance]
            half = (hi - lo) // 2
            bounds[node] = (away[0], away[half - 1], away[half], away[-1])
            children[node] = (len(point), len(point) + 1)
            open_ += children[node]
            for part in ((lo, lo + half), (lo + half, hi)):
                point.append(-1)
                bounds.append((0.0,) * 4)
                children.append((-1, -1))
                span.append(part)
        return {"order": order, "point": np.array(point), "bounds": np.array(bounds, float), "children": np.array(children), "span": np.array(span)}

    def search(self, queries: np.ndarray, own: np.ndarray, key: np.ndarray, score, best: tuple, factor: float) -> None:
        """Improves best = (scores, keys), each (queries, k), best first; rows whose key is own[i] are no answer to query i.

        score(queries' places, rows) is the exact score of each pair.
        """
        self._visit(0, np.arange(len(queries)), np.zeros(len(queries)), queries, own, key, score, best, factor)

    def _visit(self, node: int, active: np.ndarray, floor: np.ndarray, queries, own, key, score, best, factor) -> None:
        reach = _distance(np.maximum(best[0][active, -1], -1.0))
        open_ = (factor * (floor - SLACK) <= reach) | np.isneginf(best[0][active, -1])
        active, floor = active[open_], floor[open_]
        if not len(active):
            return
        if self.point[node] < 0:
            lo, hi = self.span[node]
            self._leaf(self.order[lo:hi], queries, active, own, key, score, best)
            return
        children = self.children[node]
        away = _distance(queries[active] @ self.unit[self.point[node]])
        floors = [np.maximum(floor, np.maximum(lo - away, away - hi)) for lo, hi in self.bounds[node].reshape(2, 2)]
        inner_first = floors[0] <= floors[1]
        for first, second in ((0, 1), (1, 0)):
            mine = inner_first if first == 0 else ~inner_first
            if mine.any():
                self._visit(children[first], active[mine], floors[first][mine], queries, own, key, score, best, factor)
                self._visit(children[second], active[mine], floors[second][mine], queries, own, key, score, best, factor)

    def _leaf(self, rows, queries, active, own, key, score, best) -> None:
        """Scores the pairs alone that a cosine of unit vectors, off by far less than NEAR, lets in among the best."""
        near = queries[active] @ self.unit[rows].T >= best[0][active, -1][:, None] - NEAR
        at, which = np.nonzero(near & (own[active][:, None] != key[rows]))
        if not len(at):
            return
        asked, first = np.unique(at, return_index=True)
        width = int(np.diff(np.append(first, len(at))).max())
        found, keys = np.full((len(asked), width), -np.inf), np.full((len(asked), width), MISSING)
        row = np.searchsorted(asked, at)
        column = np.arange(len(at)) - first[row]
        found[row, column] = score(active[at], rows[which])
        keys[row, column] = key[rows[which]]
        mine, k = active[asked], best[0].shape[1]
        scores = np.concatenate([best[0][mine], found], 1)
        keys = np.concatenate([best[1][mine], keys], 1)
        order = np.lexsort((np.where(np.isneginf(scores), MISSING, keys), -scores), axis=1)[:, :k]
        best[0][mine] = np.take_along_axis(scores, order, 1)
        best[1][mine] = np.take_along_axis(keys, order, 1)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def exact_cosine(a: np.ndarray, norm_a: np.ndarray, b: np.ndarray, norm_b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of pairs of rows, every dot product summed in the order of its components."""
    return np.cumsum(a * b, axis=1)[:, -1] / (norm_a * norm_b)


def _norm(vectors: np.ndarray) -> np.ndarray:
    squares = np.zeros(len(vectors))
    for x in vectors.T:
        squares += x * x
    return np.sqrt(squares)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def build_shards(vectors: DataFrame, files: store.Files, *, shard: int = SHARD) -> list[tuple[int, str]]:
    """Writes a tree for each `shard` rows that a task reads (_id, _v); returns (components, name) of all, a row a file.

    Names follow the task and its order, and files are moved to them when whole, so a repeated task leaves the same files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files.make()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        task, made = TaskContext.get().partitionId(), []

        def flush(dim: int) -> None:
            keys, base = (np.concatenate([part[k] for part in held[dim]]) for k in (0, 1))
            for lo in range(0, len(keys), shard):
                order = np.argsort(keys[lo : lo + shard], kind="stable")
                key, rows = keys[lo : lo + shard][order], base[lo : lo + shard][order]
                norm = _norm(rows)
                parts = VantageTree(rows / norm[:, None]).parts
                name, attempt = f"tree-{dim}-{task}-{len(made)}.npz", f"attempt-{uuid.uuid4().hex}"
                out = io.BytesIO()
                np.savez(out, key=key, base=rows, norm=norm, **parts)
                with files.write(attempt) as f:
                    f.write(out.getvalue())
                files.move(attempt, name)
                made.append((dim, name))
            held[dim] = []

        for batch in batches:
            ids, matrices = _columns(batch)
            for dim, (rows, matrix) in matrices.items():
                held.setdefault(dim, []).append((ids[rows], matrix))
                if sum(len(k) for k, _ in held[dim]) >= 4 * shard:
                    flush(dim)
        for dim in list(held):
            if held[dim]:
                flush(dim)
        yield pa.RecordBatch.from_pydict({"dim": pa.array([d for d, _ in made], pa.int32()), "name": pa.array([n for _, n in made], pa.string())})

    listed = store.written(bounded(vectors).mapInArrow(run, "dim int, name string"), "tree-names")
    return sorted(tuple(r) for r in listed.collect())  # a short row for every `shard` vectors or scan task


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Ids of _id, MISSING for null, and rows and matrix of _v for each number of components."""
    ids = batch.column("_id").fill_null(MISSING).to_numpy()
    vectors = batch.column("_v")
    dims = pc.list_value_length(vectors).to_numpy()
    found = {}
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        found[dim] = rows, np.asarray(vectors.take(pa.array(rows)).flatten(), float).reshape(len(rows), dim)
    return ids, found


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: float = 1.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest vectors.

    Queries are dealt to tasks, which hold up to `block` of them at a time; each such block passes by every tree once.
    """
    spark = vectors.sparkSession
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    narrow = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), vector.alias("_v")).where(usable(F.col("_v")))
    files = store.Files(store.scratch(spark, "vantage-trees"))
    shards = build_shards(narrow(vectors), files, shard=shard)
    asked = narrow(queries).where("_id is not null")
    spread = max(-(-queries.count() // block), spark.sparkContext.defaultParallelism)

    def answered(ask: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        norm = _norm(ask)
        unit = ask / norm[:, None]
        best = (np.full((len(ask), k), -np.inf), np.full((len(ask), k), -1, np.int64))
        for dim, name in shards:
            if dim != ask.shape[1]:
                continue
            with files.read(name) as f:
                held = dict(np.load(io.BytesIO(f.read())))
            base, base_norm = held["base"], held["norm"]
            tree = VantageTree(base / base_norm[:, None], {part: held[part] for part in VantageTree.PARTS})
            tree.search(unit, own, held["key"], lambda q, rows: exact_cosine(ask[q], norm[q], base[rows], base_norm[rows]), best, factor)
        got = ~np.isneginf(best[0])
        keys = best[1][got]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k).reshape(got.shape)[got]), pa.array(keys, mask=keys == MISSING), pa.array(best[0][got])], names=["query_id", "key", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids, matrices = _columns(batch)
            for dim, (rows, matrix) in matrices.items():
                held.setdefault(dim, []).append((matrix, ids[rows]))
                if sum(len(own) for _, own in held[dim]) >= block:
                    parts = held.pop(dim)
                    yield answered(*(np.concatenate([part[x] for part in parts]) for x in (0, 1)))
        for parts in held.values():
            yield answered(*(np.concatenate([part[x] for part in parts]) for x in (0, 1)))

    found = bounded(asked.repartition(spread)).mapInArrow(run, "query_id long, key long, score double")
    first = F.row_number().over(_window())
    return found.withColumn("rank", first).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias("vec_id"), "score")


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("key"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
