"""Exact and clustered vector top-k, as block matrix products.

Scores are rounded to ``DIGITS`` so that a ranking never depends on the order of
floating-point additions; ties go to the lower item id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import staged

DIGITS = 9
#: Query vectors above this many bytes are not broadcast.
BROADCAST_BYTES = 64 << 20
#: Rows on either side that are multiplied at a time.
ITEM_BLOCK, QUERY_BLOCK = 8192, 2048
#: Bytes of vectors of one block on either side of the distributed product: each row is copied to all blocks of the other side.
BLOCK_BYTES = 16 << 20
#: More than rounding to ``DIGITS`` can move a score.
SLACK = 1e-8
#: Width in radians of the shells that a list is cut into.
SHELL = 0.1
HITS = "query_id string, chunk_id string, score double"


def _matrix(column: pd.Series, dim: int | None = None) -> np.ndarray:
    """Unit rows; null and zero vectors, and those of another length than ``dim``, are zero rows and so score 0."""
    vectors = column.tolist()
    dim = max((len(v) for v in vectors if v is not None), default=0) if dim is None else dim
    empty = np.zeros(dim)
    rows = np.stack([empty if v is None or len(v) != dim else np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(queries: np.ndarray, query_ids: np.ndarray, items: np.ndarray, item_ids: np.ndarray, k: int) -> pd.DataFrame:
    """Top-k items of each query inside one block (ties by item id kept exactly).

    Zero rows all score 0, so only the first k of them are looked at. Tiles are multiplied one by one;
    past the first, only scores that reach a query's k-th so far are looked at.
    """
    order = np.argsort(item_ids)  # stable ranking by (score desc, id)
    items, ids = items[order], item_ids[order]
    zero = ~items.any(axis=1)
    keep = ~zero | (np.cumsum(zero) <= k)
    items, ids = items[keep], ids[keep]
    rows, cols, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(query_ids), -np.inf)
    for first in range(0, len(ids), ITEM_BLOCK):
        scores = queries @ items[first : first + ITEM_BLOCK].T
        least = floor
        if first == 0 and scores.shape[1] > k:
            # everything at or above the k-th score, then the stable cut
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        near, at = np.nonzero(scores >= (least - SLACK)[:, None])
        rows, cols = np.append(rows, near), np.append(cols, at + first)
        values = np.append(values, np.round(scores[near, at], DIGITS))
        rank = np.lexsort((cols, -values, rows))
        rows, cols, values = rows[rank], cols[rank], values[rank]
        starts = np.searchsorted(rows, np.arange(len(query_ids)))
        nth = np.arange(len(rows)) - starts[rows]
        floor[rows[nth == k - 1]] = values[nth == k - 1]
        rows, cols, values = rows[nth < k], cols[nth < k], values[nth < k]
    return pd.DataFrame({"query_id": query_ids[rows], "chunk_id": ids[cols], "score": values})


def _first_k(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _compact(hits: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The first k of each query among several lists of hits."""
    both = pd.concat(hits, ignore_index=True).sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
    return both.groupby("query_id", sort=False).head(k)


def _topk_broadcast(queries: DataFrame, items: DataFrame, k: int, key: str) -> DataFrame:
    """One pass over the items, no shuffle of vectors: each task keeps k hits per query.

    ``queries`` are of a checked size. Scores are made for ``QUERY_BLOCK`` queries and one batch at
    a time, and hits are cut to k per query whenever they have grown to a few times that.
    """
    table = queries.toArrow()
    rows = pd.DataFrame({key: table.column(key).to_pandas(), "query_id": table.column("query_id").to_pandas(), "query_vec": table.column("query_vec").to_pandas()})
    packed = {owner: (_matrix(part["query_vec"]), part["query_id"].to_numpy(dtype=object)) for owner, part in rows.groupby(key)}
    shared = items.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, least = 0, 0
        for batch in batches:
            for owner, part in batch.groupby(key):
                if owner not in shared.value:
                    continue
                vectors, ids = shared.value[owner]
                for first in range(0, len(part), ITEM_BLOCK):
                    some = part.iloc[first : first + ITEM_BLOCK]
                    block, names = _matrix(some["embedding"], vectors.shape[1]), some["chunk_id"].to_numpy(dtype=object)
                    for at in range(0, len(ids), QUERY_BLOCK):
                        held.append(_best(vectors[at : at + QUERY_BLOCK], ids[at : at + QUERY_BLOCK], block, names, k))
                        size += len(held[-1])
                        if size > 4 * least + 200_000:
                            held = [_compact(held, k)]
                            size = least = len(held[0])
        if held:
            yield _compact(held, k)

    return items.select(key, "chunk_id", "embedding").mapInPandas(run, HITS)


def _blocks_of(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Number of ``size``-row blocks each key needs."""
    return rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))


def _with_direction(items: DataFrame, k: int, key: str) -> DataFrame:
    """``items`` without null and zero vectors but the first ``k`` by id: they score 0 with any query."""
    real = F.coalesce(F.exists("embedding", lambda x: x.isNull() | (x != 0)), F.lit(False))
    first = Window.partitionBy(key).orderBy("chunk_id")
    some = items.where(~real).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    return items.where(real).unionByName(some)


def _rows(vectors: DataFrame, column: str, least: int) -> int:
    """Rows of a block of ``BLOCK_BYTES``, of the longest vector's size each; ``least`` at least."""
    longest = vectors.agg(F.max(F.size(column))).first()[0]
    return max(least, BLOCK_BYTES // (8 * max(longest or 1, 1)))


def _topk_blocks(queries: DataFrame, items: DataFrame, k: int, key: str) -> DataFrame:
    """Distributed product: every (item block, query block) of a key is one bounded task."""
    queries = staged(queries)
    items = _with_direction(staged(items.select(key, "chunk_id", "embedding")), k, key)
    # by column name: both tables may come from one source
    item_rows, query_rows = _rows(items, "embedding", ITEM_BLOCK), _rows(queries, "query_vec", QUERY_BLOCK)
    counts = _blocks_of(items, key, item_rows, "_ni").join(_blocks_of(queries, key, query_rows, "_nq"), key)

    def spread(rows: DataFrame, id_col: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        numbered = rows.join(counts.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key")).drop("_key")
        numbered = numbered.withColumn(own, F.pmod(F.xxhash64(id_col), F.col(n_own)).cast("int"))
        return numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("_ni", "_nq")

    left = spread(items.select(key, "chunk_id", "embedding"), "chunk_id", "_ib", "_ni", "_qb", "_nq")
    right = spread(queries.select(key, "query_id", "query_vec"), "query_id", "_qb", "_nq", "_ib", "_ni")

    def run(item: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if item.empty or query.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        asked, names = _matrix(query["query_vec"]), query["query_id"].to_numpy(dtype=object)
        block, ids = _matrix(item["embedding"], asked.shape[1]), item["chunk_id"].to_numpy(dtype=object)
        tiles = range(0, len(names), QUERY_BLOCK)
        return pd.concat([_best(asked[at : at + QUERY_BLOCK], names[at : at + QUERY_BLOCK], block, ids, k) for at in tiles], ignore_index=True)

    keys = [key, "_ib", "_qb"]
    fresh = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(fresh.groupBy(*keys)).applyInPandas(run, HITS)


def vector_topk(
    queries: DataFrame, items: DataFrame, k: int = 30, key: str = "workspace_id", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Top-k of ``items(key, chunk_id, embedding)`` for ``queries(key, query_id, query_vec)`` of the same key.

    Query vectors proven to fit in ``broadcast_bytes`` are broadcast; more go through
    the blocked product. Both return ``query_id, chunk_id, score, rank``.
    """
    queries = queries.select(key, "query_id", "query_vec")
    width = F.greatest(F.size("query_vec"), F.lit(0)) * 8 + F.coalesce(F.octet_length("query_id"), F.lit(0)) + 64
    size = queries.agg(F.sum(width)).first()[0] or 0
    if size <= broadcast_bytes:
        hits = _topk_broadcast(queries, items, k, key)
    else:
        hits = _topk_blocks(queries, items, k, key)
    return _first_k(hits, k)


def ivf_fit(items: DataFrame, lists: int = 100, seed: int = 7, iterations: int = 10) -> np.ndarray:
    """Unit centres (one row per list) of the vectors by cosine; ``lists`` rows at most, whatever the table size.

    Null and zero vectors, and those not of the most frequent length, have no part in them.
    """
    usable = items.where(F.exists("embedding", lambda x: x != 0)).select(F.col("embedding").cast("array<double>").alias("v"))
    length = usable.agg(F.mode(F.size("v"))).first()[0]
    if length is None:
        return np.zeros((0, 0))
    rows = usable.where(F.size("v") == length).select(array_to_vector("v").alias("features"))
    model = KMeans(k=max(2, lists), seed=seed, maxIter=iterations, initSteps=2, distanceMeasure="cosine").fit(rows)
    centres = np.asarray(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def _angles(vectors: pd.Series, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of the vectors to each centre, and which rows have a direction at all."""
    unit = _matrix(vectors, centres.shape[1])
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0)), unit.any(axis=1)


def ivf_assign(items: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``cluster``, the list of the nearest centre, and ``angle`` to it; partition the stored table by cluster.

    Vectors that score 0 with everything (null, zero, of another length) are list -1, angle 0.
    """

    @F.pandas_udf("cluster int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        if not len(centres):
            return pd.DataFrame({"cluster": np.full(len(vectors), -1, np.int32), "angle": np.zeros(len(vectors))})
        angles, real = _angles(vectors, centres)
        nearest = angles.argmin(axis=1)
        angle = angles[np.arange(len(nearest)), nearest]
        return pd.DataFrame({"cluster": np.where(real, nearest, -1).astype(np.int32), "angle": np.where(real, angle, 0.0)})

    return items.withColumn("_at", place("embedding")).select(*items.columns, "_at.cluster", "_at.angle")


def write_clusters(assigned: DataFrame, path: str) -> None:
    """Store assigned vectors one folder per cluster, by angle within its files; a large cluster is spread over files."""
    spread = assigned.repartition("cluster", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("cluster", "angle")
    spread.write.mode("overwrite").partitionBy("cluster").parquet(path)


def _probes(queries: DataFrame, centres: np.ndarray, nprobe: int) -> DataFrame:
    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        angles, _ = _angles(vectors, centres)
        near = np.argsort(angles, axis=1, kind="stable")[:, :nprobe]
        return pd.Series(list(np.insert(near, near.shape[1], -1, axis=1).astype(np.int32)))  # and vectors without a direction

    return queries.withColumn("cluster", F.explode(nearest("query_vec")))


def ivf_topk(
    queries: DataFrame, assigned: DataFrame, centres: np.ndarray, k: int = 30, nprobe: int = 10, key: str = "workspace_id"
) -> DataFrame:
    """Approximate top-k: only the ``nprobe`` lists nearest to a query are searched. ``ivf_search`` is exact."""
    nprobe = min(nprobe, len(centres))
    probed = _probes(queries.select(key, "query_id", "query_vec"), centres, nprobe)
    # at most as many as there are lists; prunes the folders of a table written by write_clusters
    wanted = [r["cluster"] for r in probed.select("cluster").distinct().collect()]
    assigned = assigned.filter(F.col("cluster").isin(wanted))
    cell = F.concat_ws("|", key, "cluster").alias("cell")
    probes = probed.select(cell, "query_id", "query_vec")
    cells = assigned.select(cell, "chunk_id", "embedding")
    found = vector_topk(probes, cells, k, key="cell").drop("rank")
    return _first_k(found, k)


def _shell(angle: Column) -> Column:
    return F.floor(angle / SHELL).cast("int")


def ivf_cells(assigned: DataFrame) -> pd.DataFrame:
    """``cluster, shell, low, high, n``: the lists cut into shells of ``SHELL`` radians around their centres, with the angles that occur.

    At most pi / ``SHELL`` rows per list, whatever the table size.
    """
    cut = assigned.groupBy("cluster", _shell(F.col("angle")).alias("shell"))
    return cut.agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).orderBy("cluster", "shell").toPandas()


def ivf_search(queries: DataFrame, assigned: DataFrame, centres: np.ndarray, k: int = 30, key: str = "workspace_id", first: int = 4096) -> DataFrame:
    """Exact top-k over a clustered table, reading no more of it than the bounds ask for.

    A vector at angle a to its centre, with the query at angle b, is at least |a - b| from the query
    (triangle inequality on the sphere), so cos of the gap between b and a shell's angles bounds
    every score in that shell. A query probes shells by falling bound, in waves: the first covers
    about ``first`` vectors, each further one four times as many, until the bounds of all shells left are below
    its k-th score. Waves are as few as the logarithm of the table; a query takes no part in a
    wave once it is settled. ``assigned`` is what ``ivf_assign`` or ``write_clusters`` made.
    """
    spark = queries.sparkSession
    table = ivf_cells(assigned)
    clusters, shells, counts = (table[c].to_numpy() for c in ("cluster", "shell", "n"))
    low, high = table["low"].to_numpy(), table["high"].to_numpy()

    def picker(reach: int):
        @F.pandas_udf("cells array<int>, upto int")
        def pick(vectors: pd.Series, done: pd.Series, least: pd.Series) -> pd.DataFrame:
            if len(centres):
                angles, real = _angles(vectors, centres)
                mine = angles[:, np.maximum(clusters, 0)]
                bound = np.cos(np.maximum(np.maximum(low - mine, mine - high), 0.0))
                bound[~real] = 0.0
            else:
                bound = np.zeros((len(vectors), len(clusters)))
            bound[:, clusters < 0] = 0.0  # vectors without a direction score 0
            cells, upto = [], []
            for b, at, floor in zip(bound, done, least):
                order = np.argsort(-b, kind="stable")
                end = int(np.searchsorted(np.cumsum(counts[order]), reach)) + 1
                open_ = int((b + 1e-8 >= floor).sum())  # they come first in this order
                cells.append(order[at : max(at, min(end, open_))].astype(np.int32))
                upto.append(max(at, min(end, open_)))
            return pd.DataFrame({"cells": cells, "upto": np.array(upto, np.int32)})

        return pick

    cell_of = F.create_map(*[F.lit(x) for n, (c, s) in enumerate(zip(clusters, shells)) for x in (f"{c}:{s}", n)]) if len(table) else None
    state = queries.select(key, "query_id", "query_vec", F.lit(0).alias("done"), F.lit(-2.0).alias("least"))
    hits, reach = None, max(first, 4 * k)
    while len(table):
        picked = staged(state.withColumn("_p", picker(reach)("query_vec", "done", "least")).select(key, "query_id", "query_vec", "_p.cells", "_p.upto"))
        probes = picked.select(key, "query_id", "query_vec", F.explode("cells").alias("cell"))
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most one row per shell
        if not wanted:
            break
        folders = sorted({int(clusters[c]) for c in wanted})
        items = assigned.filter(F.col("cluster").isin(folders)).withColumn("_c", cell_of[F.concat_ws(":", "cluster", _shell(F.col("angle")))])
        items = items.filter(F.col("_c").isin(wanted))
        name = lambda c: F.concat_ws("|", key, c).alias("cell")
        found = vector_topk(probes.select(name("cell"), "query_id", "query_vec"), items.select(name("_c"), "chunk_id", "embedding"), k, key="cell").drop("rank")
        hits = staged(_first_k(found if hits is None else found.unionByName(hits.drop("rank")), k))
        kth = hits.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_s"))
        state = picked.join(kth, F.col("query_id") == F.col("_q"), "left")
        state = state.select(key, "query_id", "query_vec", F.col("upto").alias("done"), F.coalesce("_s", F.lit(-2.0)).alias("least"))
        reach *= 4
    return hits if hits is not None else spark.createDataFrame([], f"{HITS}, rank int")
