"""k-nearest-neighbour join (RS0), exact unless ``method="lsh"`` is asked for (``operators.lsh``).

Base rows are assigned to the nearest of a bounded set of pivots; a pivot's rows
form a cell with known count and radius. Cells are packed into about ``GRID`` blocks,
large cells are cut. A query first meets the blocks of its nearest cells, which gives an
exact upper bound for its k-th distance, and then only blocks with a cell that the
triangle inequality cannot exclude; inside a block it excludes cells again. Queries of a
block are cut into about ``GRID`` chunks. So a row is sent about ``GRID`` times however many
there are, until a block or chunk has ``GROUP_ROWS`` rows; from there more of them bound a
task's memory. Distances are made in tiles, first in single precision, and only the k best of
each (chunk, block) leave a task. Copies of one vector are reduced to the few that can be a result before
anything else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netlens.functions.lineage import cut_lineage
from netlens.functions.numbers import seeded_digest
from netlens.operators.lsh import LshParams, Meetings, lsh_candidates

BLOCK_ROWS = 4096
CHUNK_ROWS = 2048
GRID = 16
GROUP_ROWS = 65_536
TILE_QUERIES, TILE_BASE = 512, 4096
MAX_PIVOTS = 1024
DISTANCE_DIGITS = 9

FOUND = "q_id bigint, b_id bigint, b_y int, d2 double"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, good to rounding error of the norms."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def nearest(k: int, exclude_self: bool, centre: np.ndarray | None = None, radius: np.ndarray | None = None, index=None):
    """The k nearest rows of one block for every query of one chunk.

    Queries may bring the ``bound`` of their k-th squared distance. With ``centre`` and
    ``radius`` of cells, those of the block that no query of a tile can reach are left out;
    with ``index``, an ``LshIndex``, a query meets only rows in buckets that it looks into.
    """

    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return pd.DataFrame({"q_id": [], "b_id": [], "b_y": [], "d2": []})
        cells = met = None
        if centre is not None:
            block = block.sort_values("cell", kind="stable")
            cells, place = np.unique(block["cell"].to_numpy(), return_inverse=True)
        a, b = _matrix(queries["features"]), _matrix(block["features"])
        if index is not None:
            keys = index.keys(b)
            order = np.argsort(index.keys(a)[:, 0], kind="stable")  # queries of one bucket side by side
            queries, a = queries.iloc[order], a[order]
        q_ids, b_ids, labels = queries["q_id"].to_numpy(), block["b_id"].to_numpy(), block["b_y"].to_numpy()
        bound = queries["bound"].fillna(np.inf).to_numpy(float) if "bound" in queries else np.full(len(a), np.inf)
        pairs = Pairs(a, b)
        own = int(np.unique(b_ids, return_counts=True)[1].max()) if exclude_self else 0  # rows a query may meet of its own id
        out = []
        for i in range(0, len(a), TILE_QUERIES):
            some = slice(i, i + TILE_QUERIES)
            limit, columns = bound[some].copy(), np.arange(len(b))
            if cells is not None:
                d = np.sqrt(_squared(a[some], centre[cells]))
                reached = (d - radius[cells] - 1e-6 * (1 + d) <= np.sqrt(limit)[:, None]).any(0)
                columns = np.flatnonzero(reached[place])
            if index is not None:
                met = Meetings(index.probed(a[some]), keys)
                columns = np.flatnonzero(met.any_query())
            best = (np.empty(0, int), np.empty(0, int), np.empty(0))
            for j in range(0, len(columns), TILE_BASE):
                found = pairs.near(some, columns[j : j + TILE_BASE], limit, k + own, met)
                best = _merged(best, found, k, q_ids[some], b_ids, exclude_self)
                rows, _, d2 = best
                full = np.bincount(rows, minlength=len(limit)) == k
                farthest = np.full(len(limit), -np.inf)
                np.maximum.at(farthest, rows, d2)
                limit[full] = np.minimum(limit[full], farthest[full])
            out.append((best[0] + i, *best[1:]))
        rows, cols, d2 = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"q_id": q_ids[rows], "b_id": b_ids[cols], "b_y": labels[cols], "d2": d2})

    return search


class Pairs:
    """Pairs of queries and base rows that can be among the nearest, by tiles.

    Distances less the query's own square are first made in single precision, with one product
    a tile, and compared to limits widened by the rounding errors. What is left gets its exact
    distance. Where that leaves many pairs, or numbers are too large, a tile is made again in doubles.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b, middle = a, b, b.mean(0)
        a, b = a - middle, b - middle
        self.norms, self.b_norms = (a * a).sum(1), (b * b).sum(1)
        self.wide = not max(self.norms.max(), self.b_norms.max()) < 1e30  # also NaN
        if not self.wide:
            self.left = np.ones((len(a), a.shape[1] + 1), np.float32)
            self.left[:, :-1] = a
            self.right = np.empty((len(b), b.shape[1] + 1), np.float32)
            self.right[:, :-1], self.right[:, -1] = -2 * b, self.b_norms

    def near(self, some: slice, columns: np.ndarray, limit: np.ndarray, wanted: int, met=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query of the tile, base row, squared distance); ``met`` (``Meetings``) marks the pairs that count."""
        a, norms = self.a[some], self.norms[some]
        large = norms + self.b_norms[columns].max()
        hits = None
        if not self.wide:
            rough = self.left[some] @ self.right[columns].T
            slack = 2.0**-23 * (self.left.shape[1] + 8) * large + 1e-9 * (1 + large)
            hits = self._hits(rough, norms, limit, slack, columns, wanted, met)
        if hits is None:
            part = self.b[columns]
            rough = (part * part).sum(1) - 2 * a @ part.T
            norms = (a * a).sum(1)
            hits = self._hits(rough, norms, limit, 1e-9 * (1 + norms + (part * part).sum(1).max()), columns, wanted, met, True)
        rows, cols = np.divmod(hits, len(columns))
        cols = columns[cols]
        if met is not None:
            both = met.pairs(rows, cols)
            rows, cols = rows[both], cols[both]
        d2 = np.empty(len(rows))
        for i in range(0, len(rows), 1 << 16):  # exact distances of the few candidates
            at = slice(i, i + (1 << 16))
            d2[at] = ((a[rows[at]] - self.b[cols[at]]) ** 2).sum(1)
        return rows, cols, d2

    @staticmethod
    def _hits(rough, norms, limit, slack, columns, wanted, met, all_=False) -> np.ndarray | None:
        """Places of the pairs within the limits; None if they are many."""
        top = limit - norms + slack
        new = np.flatnonzero(np.isinf(limit))
        if len(new):
            known = rough[new]
            if met is not None:
                known[~met.dense(new, columns)] = np.inf
            if wanted <= rough.shape[1]:
                top[new] = np.partition(known, wanted - 1, axis=1)[:, wanted - 1] + 2 * slack[new]
        with np.errstate(over="ignore"):
            top = np.nextafter(top.astype(rough.dtype), rough.dtype.type(np.inf))
        near = rough <= top[:, None]
        if met is not None and len(new):
            near[new] &= known < np.inf
        flat = near.reshape(-1)
        if len(flat) % 8:
            hits = np.flatnonzero(flat)
        else:  # most words of eight pairs are empty
            words = np.flatnonzero(flat.view(np.uint64))
            hits = (8 * words[:, None] + np.arange(8)).reshape(-1)
            hits = hits[flat[hits]]
        return hits if all_ or len(hits) <= len(flat) // 32 + 8 * wanted * len(top) else None


def _merged(best: tuple, found: tuple, k: int, q_ids: np.ndarray, b_ids: np.ndarray, exclude_self: bool) -> tuple:
    """The k best of each query by rounded distance, then id."""
    if exclude_self:
        other = q_ids[found[0]] != b_ids[found[1]]
        found = tuple(x[other] for x in found)
    if not len(found[0]):
        return best
    rows, cols, d2 = (np.concatenate(x) for x in zip(best, found, strict=True))
    order = np.lexsort((b_ids[cols], d2.round(DISTANCE_DIGITS), rows))
    rows, cols, d2 = rows[order], cols[order], d2[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], d2[keep]


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best per query; the rank limit also applies before the shuffle."""
    order = Window.partitionBy("q_id").orderBy(F.round("d2", DISTANCE_DIGITS), "b_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _useful_copies(base: DataFrame, k: int) -> DataFrame:
    """Of equal vectors only the k + 1 smallest ids can be among k neighbours."""
    order = Window.partitionBy("features").orderBy("b_id")
    return base.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= k + 1).drop("_copy")


def _pieces(batches: Iterator[pd.DataFrame], rows: int = 1024) -> Iterator[pd.DataFrame]:
    """Small pieces: a row meets up to MAX_PIVOTS centres."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]


def _with_cell(pivots: np.ndarray):
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            points = _matrix(pdf["features"])
            cell = _squared(points, pivots).argmin(1)
            radius = np.sqrt(((points - pivots[cell]) ** 2).sum(1))
            yield pdf.assign(cell=cell.astype("int32"), radius=radius)

    return assign


def _packed(sizes: list[int], rows: int) -> list[list[int]]:
    """For each cell the blocks that hold it: small cells share one, large ones are cut."""
    out, block, room = [], -1, 0
    for n in sizes:
        if n > rows:
            parts = math.ceil(n / rows)
            out.append(list(range(block + 1, block + 1 + parts)))
            block, room = block + parts, 0
            continue
        if n > room:
            block, room = block + 1, rows
        out.append([block])
        room -= n
    return out


def _homes(centre: np.ndarray, sizes: np.ndarray, held: np.ndarray, k: int):
    """Queries with the blocks that hold their nearest cells."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            d = _squared(_matrix(pdf["features"]), centre)
            order = np.argsort(d, axis=1)
            enough = np.cumsum(sizes[order], axis=1) - sizes[order] <= k  # one more for the query itself
            at_home = np.zeros(d.shape, bool)
            np.put_along_axis(at_home, order, enough, axis=1)
            yield pdf.assign(visits=[np.flatnonzero(v).astype("int32") for v in at_home @ held])

    return route


def _others(centre: np.ndarray, radius: np.ndarray, held: np.ndarray):
    """Queries with the blocks, besides those of their home, that their bound leaves open."""

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _pieces(batches):
            d = np.sqrt(_squared(_matrix(pdf["features"]), centre))
            bound = np.sqrt(pdf["bound"].fillna(np.inf).to_numpy(float))
            visit = (d - radius[None, :] - 1e-6 * (1 + d) <= bound[:, None]) @ held
            for i, seen in enumerate(pdf["visits"]):
                visit[i, seen] = False
            yield pdf.assign(visits=[np.flatnonzero(v).astype("int32") for v in visit])

    return route


def wide(rows: int, least: int) -> int:
    """Rows of one of about ``GRID`` equal parts, within bounds."""
    return max(least, min(GROUP_ROWS, math.ceil(rows / GRID)))


def _search(asked: DataFrame, blocks: DataFrame, chunk_rows: int, search) -> DataFrame:
    """Meet every query chunk of a block with the block."""
    spark = asked.sparkSession
    routed = asked.withColumn("block", F.explode("visits")).drop("visits")
    counts = routed.groupBy("block").count().collect()  # one row a block
    plan = F.broadcast(spark.createDataFrame([(r["block"], math.ceil(r["count"] / chunk_rows)) for r in counts], "block int, chunks int"))
    q = routed.join(plan, "block").withColumn("chunk", F.pmod(F.xxhash64("q_id"), "chunks").cast("int")).drop("chunks")
    b = blocks.join(plan, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    key = ["block", "chunk"]
    return q.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(search, FOUND)


def _named(best: DataFrame, id_col: str) -> DataFrame:
    return best.select(
        F.col("q_id").alias(id_col),
        "rank",
        F.col("b_id").alias("neighbour_id"),
        F.col("b_y").alias("neighbour_y"),
        F.sqrt("d2").alias("distance"),
    )


def knn_join(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    id_col: str = "id",
    features: str = "features",
    label: str = "y",
    exclude_self: bool = True,
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
    method: str = "exact",
    lsh: LshParams | None = None,
) -> DataFrame:
    """(id, rank, neighbour_id, neighbour_y, distance): the k nearest base rows.

    Equal distances (to nine digits of the square) are settled by id. ``features``
    are arrays of doubles; ids are integers. ``method="lsh"`` may miss neighbours, at
    a rate that ``lsh`` sets; the method never follows from the size of the tables.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"Unknown method of the neighbour join: {method}")
    q = queries.select(F.col(id_col).cast("long").alias("q_id"), F.col(features).alias("features"))
    b = base.select(
        F.col(id_col).cast("long").alias("b_id"), F.col(label).cast("int").alias("b_y"), F.col(features).alias("features")
    )
    b = cut_lineage(_useful_copies(b, k))
    if method == "lsh":
        best = cut_lineage(_best(lsh_candidates(q, b, k, exclude_self, lsh or LshParams()), k))
        least = min(k, b.count() - exclude_self)
        few = q.join(best.where(F.col("rank") == least).select("q_id"), "q_id", "left_anti")
        few = cut_lineage(few.select(F.col("q_id").alias(id_col), F.col("features").alias(features)))
        if few.isEmpty():
            return _named(best, id_col)
        rest = knn_join(few, base, k, id_col, features, label, exclude_self, block_rows, seed)
        return _named(best, id_col).join(few.select(id_col), id_col, "left_anti").unionByName(rest)
    n = b.count()
    size = max(1, min(MAX_PIVOTS, n // (4 * block_rows)))
    chosen = b.orderBy(seeded_digest(seed, "b_id"), "b_id").limit(size).select("features").toPandas()  # <= MAX_PIVOTS
    if chosen.empty:
        raise ValueError("The base of a neighbour join is empty.")
    pivots = np.unique(_matrix(chosen["features"]), axis=0)
    cellular = b.mapInPandas(
        _with_cell(pivots), "b_id bigint, b_y int, features array<double>, cell int, radius double"
    )
    if len(pivots) > 1:
        cellular = cut_lineage(cellular)
    cells = cellular.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("radius")).toPandas().sort_values("cell")
    sizes, radius, centre = cells["n"].to_numpy(), np.zeros(len(pivots)), pivots[cells["cell"].to_numpy()]
    radius[cells["cell"].to_numpy()] = cells["radius"].to_numpy()
    packed = _packed(sizes.tolist(), wide(n, block_rows))
    held = np.zeros((len(cells), packed[-1][-1] + 1), bool)
    for i, some in enumerate(packed):
        held[i, some] = True
    places = queries.sparkSession.createDataFrame(
        [(int(c), some[0], len(some)) for c, some in zip(cells["cell"], packed, strict=True)], "cell int, first_block int, parts int"
    )  # at most MAX_PIVOTS rows
    blocks = cellular.join(F.broadcast(places), "cell").select(
        "b_id", "b_y", "features", "cell", (F.col("first_block") + F.pmod(F.xxhash64("b_id"), "parts")).cast("int").alias("block")
    )
    schema = "q_id bigint, features array<double>"
    asked = cut_lineage(q.mapInPandas(_homes(centre, sizes, held, k), f"{schema}, visits array<int>"))
    chunk_rows = wide(asked.count(), CHUNK_ROWS)
    best = _best(_search(asked, blocks, chunk_rows, nearest(k, exclude_self)), k)
    if held.shape[1] > 1:
        best = cut_lineage(best)
        bound = best.where(F.col("rank") == k).select("q_id", F.col("d2").alias("bound"))
        rest = asked.join(bound, "q_id", "left").select("q_id", "features", "bound", "visits")
        rest = cut_lineage(rest.mapInPandas(_others(centre, cells["radius"].to_numpy(), held), f"{schema}, bound double, visits array<int>"))
        more = _search(rest, blocks, chunk_rows, nearest(k, exclude_self, pivots, radius))
        best = _best(best.drop("rank").unionByName(more), k)
    return _named(best, id_col)
