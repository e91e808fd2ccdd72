"""Vectors by cosine: an inverted-file index with exact or probing search, and a threshold join by Voronoi cells with rims.

Vectors are brought to length 1, so cosine c is distance sqrt(2 - 2c), and distances obey the triangle inequality.

* ``Cells``: k-means centres. They start from a bounded draw and are moved by passes over all rows that exchange a sum for
  each (cell, dimension) and task. Product codes (a byte for each of ``PARTS`` stretches of the residual) are fitted on the draw.
* ``search``: queries visit their nearest cells first; the k-th distance found bounds the rest: a cell is visited only if its
  nearest point could be closer (distance to the centre less radius), a vector is compared only if neither its distance to the
  centre nor its code, whose error is stored, rules it out. With ``probes`` the search ends after that many cells, ranks by
  codes and compares the best of each cell exactly.
* ``links``: a vector is at home in its nearest cell, and visits each cell whose bisector it is near enough to for a pair
  across to exist; each pair is found once, in the home of its lesser member. Visits are counted first: where cells rule out
  so little that a vector would be sent to more of them than there are blocks of ``TOGETHER``, all pairs of blocks are compared.

Cells and queries meet in blocks of bounded size, so neither a cell with a third of all vectors nor many queries are one task.
Equal vectors are one class before anything is compared.

Edge cases: null vectors, those with null or non-finite values, of length zero or of another dimension than most rows are
left out, and so are null ids; scores are rounded to DIGITS decimals before ranking, equal scores rank by id; a repeated id
counts as a row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.joins import look_up, stored

#: Rows drawn for the first centres and the product codes at most; passes that move the centres.
DRAW, PASSES = 8_000, 4
#: Vectors of a cell on average, cells at most.
PER_CELL, MOST_CELLS = 2_000, 1_024
#: Vectors of a block of a cell, queries of a block.
BLOCK, QUERIES = 2_048, 1_024
#: Vectors of a block where all are compared, blocks at least, vectors of a block that are compared with the other at once.
TOGETHER, LEAST_BLOCKS, AT_ONCE = 16_384, 8, 512
PARTS, DIGITS = 8, 9
K, EVERY, SIMILAR = 10, 20, 0.85


def prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): ids and vectors of the table's dimension that have a direction, as doubles of length 1."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (most.d if most else 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).where("norm > 0 AND norm < double('Infinity')").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between points of length 1 or less (centres)."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Cells:
    """Centres, and product codes of what is left of a vector without its centre."""

    def __init__(self, vectors: DataFrame, per_cell: int = PER_CELL, most: int = MOST_CELLS, passes: int = PASSES, draw: int = DRAW):
        n = vectors.count()
        share = draw / max(n, 1)
        some = vectors.where(F.xxhash64("id", F.lit("cells")) / F.lit(2.0**64) + 0.5 < share).select("v").limit(2 * draw).toArrow()
        points = matrix(some.column(0).combine_chunks()) if some.num_rows else np.zeros((0, 1))
        if not len(points) and n:
            points = matrix(vectors.select("v").limit(draw).toArrow().column(0).combine_chunks())
        rnd = np.random.default_rng(3)
        count = max(1, min(most, math.ceil(n / per_cell), len(points)))
        self.centres = points[rnd.choice(len(points), count, replace=False)] if len(points) else np.zeros((1, 1))
        for _ in range(passes if n else 0):
            self._move(vectors)
        parts = min(PARTS, self.centres.shape[1])
        self.cuts = np.linspace(0, self.centres.shape[1], parts + 1).astype(int)
        rest = points - self.centres[distances(points, self.centres).argmin(1)] if len(points) else np.zeros((1, self.centres.shape[1]))
        self.books = [_lloyd(rest[:, a:b], min(256, len(rest)), rnd) for a, b in zip(self.cuts, self.cuts[1:])]

    def _move(self, vectors: DataFrame) -> None:
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros_like(centres), np.zeros(len(centres))
            for batch in batches:
                points = matrix(batch.column(0))
                if len(points):
                    nearest = distances(points, centres).argmin(1)
                    np.add.at(sums, nearest, points)
                    counts += np.bincount(nearest, minlength=len(centres))
            cell, dimension = (x.ravel() for x in np.indices(sums.shape))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (cell, dimension, sums.ravel(), np.repeat(counts, sums.shape[1])))], names=["cell", "dimension", "total", "n"])

        means = vectors.select("v").mapInArrow(run, "cell long, dimension long, total double, n double").groupBy("cell", "dimension").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        for r in means.where("n > 0").collect():  # a number for each cell and dimension
            self.centres[r.cell, r.dimension] = r.total / r.n

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte for each part, and how far what they stand for is from ``rest``."""
        found = np.stack([distances_any(rest[:, a:b], book).argmin(1) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])], 1)
        return found.astype(np.uint8), np.sqrt(((rest - self.decoded(found)) ** 2).sum(1))

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)


def distances_any(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b * b).sum(1)[None, :] - 2 * a @ b.T


def _lloyd(points: np.ndarray, count: int, rnd: np.random.Generator, passes: int = 6) -> np.ndarray:
    centres = points[rnd.choice(len(points), count, replace=False)].copy()
    for _ in range(passes):
        nearest = distances_any(points, centres).argmin(1)
        counts = np.bincount(nearest, minlength=count)
        sums = np.stack([np.bincount(nearest, weights=points[:, d], minlength=count) for d in range(points.shape[1])], 1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def index(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(id, v, cell, away, code, error), stored: a vector's cell, its distance to the centre, its product code and that one's error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1))
            if len(points):
                cell = distances(points, cells.centres).argmin(1)
                rest = points - cells.centres[cell]
                code, error = cells.codes(rest)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.sqrt((rest * rest).sum(1))), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["id", "v", "cell", "away", "code", "error"])

    return stored(vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, cell long, away double, code binary, error double"), "vector-index")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(cell, n blocks) of ``size`` rows on average."""
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("blocks"))


def _meet(asked: DataFrame, rows: DataFrame, work, schema: str, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """``work(asked, rows)`` of every block of ``asked`` and every block of ``rows`` of the same cell, as Arrow tables."""
    of_rows, of_asked = _blocks(rows, block).withColumnRenamed("blocks", "of_rows"), _blocks(asked, queries).withColumnRenamed("blocks", "of_asked")
    # not more cells than MOST_CELLS
    shares = F.broadcast(of_rows.join(of_asked, "cell"))
    here = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    all_ = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(shares, "cell").withColumn("ask", here("of_asked")).withColumn("block", all_("of_rows")).drop("of_rows", "of_asked")
    right = rows.join(shares, "cell").withColumn("block", here("of_rows")).withColumn("ask", all_("of_asked")).drop("of_rows", "of_asked")
    keys = ["cell", "block", "ask"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name))


def _points(table: pa.Table, name: str = "v") -> np.ndarray:
    return matrix(table.column(name).combine_chunks())


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best (score, then neighbour) of each id; what each task has of an id is cut to k before it is exchanged."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _compare(cells: Cells, k: int, exact: bool):
    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        names = ["id", "neighbour", "score"]
        if not asked.num_rows or not rows.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        q, x, ids, others = _points(asked), _points(rows), _column(asked, "id"), _column(rows, "id")
        reach, to_centre, away = _column(asked, "reach"), _column(asked, "to_centre"), _column(rows, "away")
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        rest, square = q - cells.centres[_column(rows, "cell")[0]], np.zeros((len(q), len(x)))
        for p, (a, b, book) in enumerate(zip(cells.cuts, cells.cuts[1:], cells.books)):
            square += (distances_any(rest[:, a:b], book) + (rest[:, a:b] ** 2).sum(1)[:, None])[:, code[:, p]]
        coded, error = np.sqrt(np.maximum(square, 0)), _column(rows, "error")  # to what the code stands for, which is within ``error`` of the vector
        if exact:
            allowed = (np.abs(to_centre[:, None] - away[None, :]) <= reach[:, None]) & (coded - error[None, :] <= reach[:, None])
        else:
            allowed = np.zeros(coded.shape, bool)
            first = np.argpartition(coded, min(4 * k, len(x) - 1), 1)[:, : 4 * k]
            np.put_along_axis(allowed, first, True, 1)
        allowed &= ids[:, None] != others[None, :]
        out: list[list] = [[], [], []]
        for i in np.flatnonzero(allowed.any(1)):
            at = np.flatnonzero(allowed[i])
            score = np.round((x[at] * q[i]).sum(1), DIGITS)
            order = np.lexsort((others[at], -score))[:k]
            for to, value in zip(out, (np.full(len(order), ids[i]), others[at][order], score[order])):
                to.append(value)
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, float if n == "score" else np.int64) for n, o in zip(names, out)})

    return work


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY, probes: int | None = None, first: int = 2, block: int = BLOCK, queries: int = QUERIES, **sizes: int) -> DataFrame:
    """(id, neighbour, score, place): for each id divisible by ``every`` the ``k`` other rows of the greatest cosine.

    Exact, or with ``probes`` from that many cells only. ``sizes`` are those of ``Cells``.
    """
    vectors = stored(prepared(df, key, vector), "vectors")
    # of equal vectors only the least ids can be among the best, one more than k as a row isn't its own neighbour
    alike = Window.partitionBy("v").orderBy("id")
    few = stored(vectors.withColumn("n", F.row_number().over(alike)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    cells = Cells(few, **sizes)
    rows = index(few, cells)
    asked = vectors.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    radii = dict(rows.groupBy("cell").agg(F.max("away")).collect())  # not more cells than MOST_CELLS
    radius = np.array([radii.get(i, -np.inf) for i in range(len(cells.centres))])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, reach, rank = matrix(batch.column(1)), np.asarray(batch.column(2)), np.arange(len(radius))
            if not len(points):
                continue
            to = distances(points, cells.centres)
            order = np.argsort(to, 1, kind="stable")
            position = np.empty_like(order)
            np.put_along_axis(position, order, np.broadcast_to(rank, order.shape), 1)
            new = np.isinf(reach)[:, None]
            chosen = np.where(new, position < (probes or first), (position >= first) & (to - radius[None, :] <= reach[:, None])) & np.isfinite(radius)[None, :]
            i, c = np.nonzero(chosen)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([*(x.take(at) for x in batch.columns), pa.array(c), pa.array(to[i, c])], names=["id", "v", "reach", "cell", "to_centre"])

    schema = "id long, v array<double>, reach double, cell long, to_centre double"
    plan = lambda some: stored(some.select("id", "v", "reach").mapInArrow(visits, schema), "visits")
    compared = lambda some, exact: _meet(some, rows, _compare(cells, k, exact), "id long, neighbour long, score double", block, queries)
    found = stored(best(compared(plan(asked.withColumn("reach", F.lit(float("inf")))), probes is None), k), "found")
    if probes is None:
        last = found.groupBy("id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        # a little more than the k-th distance, so that rounding loses nothing; without k so far, all there is
        reach = F.when(F.col("n") < k, F.lit(4.0)).otherwise(F.sqrt(F.greatest(2 - 2 * F.col("least"), F.lit(0.0))) + 1e-6)
        rest = asked.join(last, "id", "left").withColumn("reach", F.coalesce(reach, F.lit(4.0)))
        found = best(compared(plan(rest), True).unionByName(found.drop("place")), k)
    return found


def _near(similar: float):
    def work(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        ids, others = _column(asked, "id"), _column(rows, "id")
        score = np.round(_points(asked) @ _points(rows).T, DIGITS)
        # at home a pair is met from both sides, across cells only where its lesser id is at home
        i, j = np.nonzero((score >= similar) & (ids[:, None] < others[None, :]))
        return pa.table({"a": ids[i], "b": others[j]})

    return work


def _in_blocks(rows: DataFrame, similar: float, many: int) -> DataFrame:
    """(a, b): all pairs of ``rows`` (id, v) of a cosine of ``similar`` or more; a row goes once to each pair of blocks that its own is in."""
    own = F.pmod(F.xxhash64("id", F.lit("block")), F.lit(many))
    dealt = rows.select("id", "v", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("other"))
    dealt = dealt.select("id", "v", "own", (F.least("own", "other") * many + F.greatest("own", "other")).alias("pair"))

    def work(rows: pa.Table) -> pa.Table:
        first, second = divmod(rows.column("pair")[0].as_py(), many)
        ids, points, own = _column(rows, "id"), _points(rows), _column(rows, "own")
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        short = points.astype(np.float32)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start in range(0, len(left), AT_ONCE):
            some = left[start : start + AT_ONCE]
            # products of 32 bits leave out what is far below, the others are made again
            i, j = np.nonzero(short[some] @ short[right].T >= similar - 1e-4)
            i, j = some[i], right[j]
            if first == second:
                i, j = i[ids[i] < ids[j]], j[ids[i] < ids[j]]
            score = np.concatenate([np.zeros(0), *(np.round((points[i[x : x + TOGETHER]] * points[j[x : x + TOGETHER]]).sum(1), DIGITS) for x in range(0, len(i), TOGETHER))])
            out.append((ids[i[score >= similar]], ids[j[score >= similar]]))
        i, j = map(np.concatenate, zip(*out))
        return pa.table({"a": np.minimum(i, j), "b": np.maximum(i, j)})

    return dealt.groupBy("pair").applyInArrow(work, "a long, b long")


def links(df: DataFrame, key: str = "vec_id", vector: str = "embedding", similar: float = SIMILAR, block: int = BLOCK, together: int = TOGETHER, **sizes: int) -> DataFrame:
    """(id, class_id, n_links): the least id with an equal vector, and how many other classes have a cosine of ``similar`` or more with it."""
    vectors = stored(prepared(df, key, vector).withColumn("class", F.xxhash64("v")), "vectors")
    classes = stored(vectors.groupBy("class", "v").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "vector-classes")
    rows = classes.select(F.col("class").alias("id"), "v")
    cells = Cells(rows, **sizes)
    placed = index(rows, cells).select("id", "v", "cell")
    width = math.sqrt(2 - 2 * similar) + 1e-6
    centres = cells.centres

    def rims(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        between = distances(centres, centres)
        np.fill_diagonal(between, np.inf)
        for batch in batches:
            points, home = matrix(batch.column(1)), np.asarray(batch.column(2))
            if not len(points):
                continue
            to = distances(points, centres) ** 2
            own = to[np.arange(len(to)), home]
            # how far the bisector of two centres is from a point on the home's side of it
            rim = (to - own[:, None]) / (2 * np.maximum(between[home], 1e-12)) <= width
            rim[np.arange(len(to)), home] = True
            yield batch, rim

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rim in rims(batches):
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([int(rim.sum())])], names=["n", "visits"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rim in rims(batches):
            i, c = np.nonzero(rim)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(c)], names=["id", "v", "cell"])

    seen = placed.mapInArrow(count, "n long, visits long").agg(F.sum("n").alias("n"), F.sum("visits").alias("visits")).first()
    many = max(LEAST_BLOCKS, math.ceil((seen.n or 0) / together))
    if (seen.visits or 0) > many * (seen.n or 0):
        pairs = stored(_in_blocks(placed, similar, many), "links")
    else:
        around = stored(placed.mapInArrow(visits, "id long, v array<double>, cell long"), "rims")
        pairs = stored(_meet(placed, around, _near(similar), "a long, b long", block, block), "links")
    ends = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("n_links"))
    known = classes.drop("v").join(ends, "class", "left").select("class", "class_id", "n", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return look_up(vectors.select("id", "class"), known, "class", "n").select("id", "class_id", "n_links")
