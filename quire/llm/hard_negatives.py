"""Hard negatives by a vector-approximation file: cells of each dimension bound a score before it is worked out."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage

#: Cells of a dimension; a cell's number is one byte.
CELLS = 64
#: Rows that a task holds, at most and (where there are enough tasks) at least, and rows whose bounds are looked up at once.
MOST_ROWS, LEAST_ROWS, SLICE = 131_072, 1024, 2048


def quantised(vector: Column) -> Column:
    """Each component x as floor(256 * x); null if the vector or a component is null, or a component isn't finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * 256)))


@dataclass
class Grid:
    """For each dimension the least and the greatest value of each of its cells."""

    lows: np.ndarray
    highs: np.ndarray

    @property
    def dims(self) -> int:
        return len(self.lows)

    def cells(self, values: np.ndarray) -> np.ndarray:
        made = np.empty(values.shape, np.uint8)
        for d in range(self.dims):
            made[:, d] = np.searchsorted(self.lows[d, 1:], values[:, d], "right")
        return made

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each cell adds to a score with ``anchor``, at least and at most; one dimension after the other."""
        if too_large(self.lows, anchor) or too_large(self.highs, anchor):  # then every row is scored
            wide = np.full(self.lows.size, (1 << 62) // max(1, self.dims))
            return -wide, wide
        a, b = self.lows * anchor[:, None], self.highs * anchor[:, None]
        return np.minimum(a, b).ravel(), np.maximum(a, b).ravel()


def grid(vectors: DataFrame, cells: int) -> Grid:
    """Cells that hold about as many components each. What comes to the driver is as long as a vector, whatever the rows.

    Zero lies within the outer cells: a vector that is shorter than others counts as ending in zeros.
    """
    cuts = [k / cells for k in range(1, cells)]
    found = (
        vectors.select(F.posexplode("vector").alias("dim", "x"))
        .groupBy("dim")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", cuts, 1000).alias("cuts"))
        .orderBy("dim")
        .collect()
    )
    lows = np.array([[min(r["low"], 0), *r["cuts"]] for r in found], np.int64).reshape(-1, cells)
    # A value on a cut is in the cell that begins there; equal cuts leave cells without a value between them.
    highs = np.hstack((np.maximum(lows[:, 1:] - 1, lows[:, :-1]), [[max(r["high"], 0)] for r in found])) if found else lows
    return Grid(lows, np.maximum(highs, lows))


def matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of ``dims`` values; shorter vectors end in zeros."""
    counts = vectors.value_lengths().to_numpy()
    flat = vectors.flatten().to_numpy()
    if (counts == dims).all():
        return flat.reshape(len(counts), dims)
    made = np.zeros((len(counts), dims), np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    made[of, np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
    return made


def too_large(rows: np.ndarray, anchor: np.ndarray) -> bool:
    """Whether 64 bits might not hold a sum of products."""
    return bool(rows.size) and float(np.abs(rows).max()) * float(np.abs(anchor).max()) * len(anchor) >= 2.0**62


def exact(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products; by integers of any size where 64 bits might not hold the sums."""
    if too_large(rows, anchor):
        return (rows.astype(object) @ anchor.astype(object)).astype(np.int64)
    return rows @ anchor


@dataclass
class Best:
    """The ``most`` best of the rows seen so far: higher scores first, then smaller ids (null ids last), then rows."""

    most: int
    scores: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    rows: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def least(self) -> int:
        """A score below this can't enter."""
        return int(self.scores[-1]) if len(self.scores) >= self.most else np.iinfo(np.int64).min

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores, ids, rows = (np.concatenate(x) for x in ((self.scores, scores), (self.ids, ids), (self.rows, rows)))
        order = np.lexsort((rows, ids, -scores))[: self.most]
        self.scores, self.ids, self.rows = scores[order], ids[order], rows[order]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; the least possible one if there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else np.iinfo(np.int64).min


class Block:
    """The rows that one task holds, ordered by label: their cells, and their vectors for the scores that must be exact."""

    def __init__(self, rows: pa.Table, cells: Grid):
        self.grid = cells
        labels = rows["label"].to_numpy()
        order = np.argsort(labels, kind="stable")
        self.labels = labels[order]
        self.rows = rows["row"].to_numpy()[order]
        self.ids = rows["id"].combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()[order]
        self.vectors = matrix(rows["vector"].combine_chunks(), cells.dims)[order]
        flat = b"".join(rows["cells"].to_pylist())
        self.cells = np.frombuffer(flat, np.uint8).reshape(len(labels), cells.dims)[order]
        self.scored = 0  # rows whose score was worked out

    def _slices(self, first: int, last: int):
        """(first, last, places): of consecutive rows, where their cells are in an anchor's table."""
        offsets = (np.arange(self.grid.dims) * self.grid.lows.shape[1] if self.grid.dims else np.empty(0, int)).astype(np.int32)
        for a in range(first, last, SLICE):
            b = min(last, a + SLICE)
            yield a, b, self.cells[a:b].T.astype(np.int32) + offsets[:, None]

    def _scores(self, at: np.ndarray, vector: np.ndarray) -> np.ndarray:
        self.scored += len(at)
        return exact(self.vectors[at], vector)

    def nearest(self, anchors: list[dict], most: int) -> list[Best]:
        """For each anchor the best rows of its label but itself."""
        best = [Best(most) for _ in anchors]
        tables = [self.grid.tables(x["vector"]) for x in anchors]
        labels = np.array([x["label"] for x in anchors])
        for label in np.unique(labels):
            chosen = np.flatnonzero(labels == label)
            for a, b, places in self._slices(*np.searchsorted(self.labels, [label, label + 1])):
                for n in chosen:
                    low, high = tables[n]
                    upper = high.take(places).sum(0)
                    some = np.flatnonzero((upper >= best[n].least) & (self.rows[a:b] != anchors[n]["row"]))
                    if len(some) > most:
                        some = some[upper[some] >= kth(low.take(places[:, some]).sum(0), most)]
                    if len(some):
                        at = some + a
                        best[n].add(self._scores(at, anchors[n]["vector"]), self.ids[at], self.rows[at])
        return best

    def within(self, anchors: list[dict], most: int) -> list[list[Best]]:
        """For each anchor and each of its windows (least, greatest score) the best rows of other labels inside."""
        best = [[Best(most) for _ in x["windows"]] for x in anchors]
        tables = [self.grid.tables(x["vector"]) for x in anchors]
        for a, b, places in self._slices(0, len(self.labels)):
            for n, x in enumerate(anchors):
                low, high = tables[n]
                floors = [max(w[0], y.least) for w, y in zip(x["windows"], best[n], strict=True)]
                upper = high.take(places).sum(0)
                some = np.flatnonzero((upper >= min(floors)) & (self.labels[a:b] != x["label"]))
                if not len(some):
                    continue
                upper, lower = upper[some], low.take(places[:, some]).sum(0)
                wanted = []
                for (least, greatest), bound in zip(x["windows"], floors, strict=True):
                    inside = lower[(lower >= least) & (upper <= greatest)]  # these are in the window, whatever their scores
                    wanted.append((upper >= max(bound, kth(inside, most))) & (lower <= greatest))
                needed = np.flatnonzero(np.logical_or.reduce(wanted))
                at = some[needed] + a
                scores = self._scores(at, x["vector"])
                for (least, greatest), want, y in zip(x["windows"], wanted, best[n], strict=True):
                    hit = want[needed] & (scores >= least) & (scores <= greatest)
                    if hit.any():
                        y.add(scores[hit], self.ids[at[hit]], self.rows[at[hit]])
        return best


def _met(rows: DataFrame, anchors: DataFrame, groups: int, cells: Grid, found, schema: str) -> DataFrame:
    """``found(block, anchors)`` for each group of rows and each batch of anchors.

    A group holds MOST_ROWS rows at most; the anchors go to each group and stream past it, so that a task holds
    its rows and one batch of anchors, and no row is sent twice.
    """
    small_batches(rows.sparkSession)
    windows = "array<struct<least: bigint, greatest: bigint>>"
    kept = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("g"), F.lit(0).alias("kind"), "row", "id", "label", "vector", "cells", F.lit(None).cast(windows).alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.lit(1).alias("kind"), "row", "id", "label", "vector", F.lit(None).cast("binary").alias("cells"), "windows")

    def run(batches):
        held: list[pa.RecordBatch] = []
        block, at = None, None
        for batch in batches:
            g, kind = batch.column("g").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero(np.diff(2 * g + kind)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(g)], strict=True):
                if a == b:
                    continue
                if g[a] != at:
                    at, held, block = g[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held or block:
                    if block is None:
                        block, held = Block(pa.Table.from_batches(held), cells), []
                    part = batch.slice(a, b - a)
                    vectors = matrix(part.column("vector"), cells.dims)
                    asking = [
                        {"row": r, "label": x, "vector": vectors[n], "windows": [(w["least"], w["greatest"]) for w in s or ()]}
                        for n, (r, x, s) in enumerate(zip(part.column("row").to_pylist(), part.column("label").to_pylist(), part.column("windows").to_pylist(), strict=True))
                    ]
                    yield found(block, asking)

    return kept.unionByName(asked).repartition(groups, "g").sortWithinPartitions("g", "kind").mapInArrow(run, schema)


def _batch(parts: list[tuple[list, Best]], names: list[str]) -> pa.RecordBatch:
    """One row for each row of each Best, after the values that belong to it; the largest id stands for null."""
    counts = [len(b.rows) for _, b in parts]
    keys = [np.repeat(np.array([k[c] for k, _ in parts], np.int64), counts) for c in range(len(names) - 2)]
    scores, ids = (np.concatenate([np.empty(0, np.int64), *(getattr(b, x) for _, b in parts)]) for x in ("scores", "ids"))
    return pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(ids, mask=ids == np.iinfo(np.int64).max), pa.array(scores)], names)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cells: int = CELLS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    ``vectors`` has id long, label, vector (array of whole numbers) and anchor boolean; further columns aren't read.
    A row's score with an anchor is the inner product. An anchor's positives are its first rows of the same label,
    negatives the first rows of other labels whose scores lie between ``low`` and ``high`` hundredths of the
    positive's; higher scores come first, then smaller ids. An anchor without a positive, and a positive without a
    negative, give no row.

    Every row is in the approximation file: its cells, and its vector beside them. Two passes over it take the
    anchors in batches against groups of rows, and only rows whose bounds might enter a result are scored. Rows are
    told apart by row, not by id: repeated rows are rows of their own, so an anchor's copy is one of its positives.
    Rows with a null label, vector or component take no part; a null id is no anchor's and stands last among equal
    scores. Vectors of unequal length meet as if the shorter one ended in zeros; an empty one has score zero with
    any. Scores must fit 64 bits. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    clean = vectors.filter("label is not null and vector is not null and not exists(vector, x -> x is null)").select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"), (F.col("anchor") & F.col("id").isNotNull()).alias("anchor")
    )
    own = grid(clean, cells)

    def approximated(batches):
        for batch in batches:
            made = own.cells(matrix(batch.column("vector"), own.dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in made], pa.binary())], [*batch.schema.names, "cells"])

    small_batches(spark)
    numbered = clean.withColumn("row", F.monotonically_increasing_id())
    rows = stage(numbered.mapInArrow(approximated, "id long, label long, vector array<long>, anchor boolean, row long, cells binary"), "approximations")
    n = rows.count()
    groups = max(1, -(-n // MOST_ROWS), min(n // LEAST_ROWS, 4 * spark.sparkContext.defaultParallelism))
    anchors = rows.filter("anchor")

    def nearest(block, asking):
        best = block.nearest(asking, positives)
        return _batch([([x["row"]], b) for x, b in zip(asking, best, strict=True)], ["row", "id", "score"])

    first = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    near = _met(rows, anchors.withColumn("windows", F.lit(None)), groups, own, nearest, "row long, id long, score long")
    near = stage(near.withColumn("nth", F.row_number().over(first(["row"]))).filter(F.col("nth") <= positives), "positives")
    bounds = near.groupBy("row").agg(
        F.collect_set(F.struct(F.ceil(F.lit(low) * F.col("score").cast("decimal(25,0)") / 100).cast("long").alias("least"), F.floor(F.lit(high) * F.col("score").cast("decimal(25,0)") / 100).cast("long").alias("greatest"))).alias("windows")
    )
    asked = anchors.join(bounds, "row")

    def within(block, asking):
        best = block.within(asking, negatives)
        parts = [([x["row"], *w], y) for x, each in zip(asking, best, strict=True) for w, y in zip(x["windows"], each, strict=True)]
        return _batch(parts, ["row", "least", "greatest", "id", "score"])

    hard = _met(rows, asked, groups, own, within, "row long, least long, greatest long, id long, score long")
    hard = hard.withColumn("rank", F.row_number().over(first(["row", "least", "greatest"]))).filter(F.col("rank") <= negatives)
    positive = near.select("row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).withColumns({
        "least": F.ceil(F.lit(low) * F.col("positive_score").cast("decimal(25,0)") / 100).cast("long"),
        "greatest": F.floor(F.lit(high) * F.col("positive_score").cast("decimal(25,0)") / 100).cast("long"),
    })
    return (
        positive.join(hard.select("row", "least", "greatest", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["row", "least", "greatest"])
        .join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def sql() -> str:
    """DuckDB SQL of the query over ``embeddings``, by scoring all rows."""
    return """
    WITH clean AS (
        SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
        FROM clean a JOIN clean r ON a.id <> r.id WHERE a.id % 100 = 0
    ), positive AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    ), hard AS (
        SELECT p.anchor_id, positive_id, positive_score, s.id AS negative_id, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
        FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id
        WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
    )
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5
    """
