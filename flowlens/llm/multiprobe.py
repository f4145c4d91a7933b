"""Approximate nearest neighbours by inner product, with multiprobe p-stable hashing.

Vectors are scaled by the largest norm and given one more component that makes all of them unit vectors;
queries get a zero there. Then the nearest by distance are the nearest by inner product. A table hashes a
vector by several Gaussian projections, each shifted and cut into slots of one width. A query visits its own
bucket and buckets whose slots differ by one, in the order in which a bucket is expected to hold near
vectors: a step across a slot's edge costs the squared distance to that edge, expected costs by rank of the
edge fix one sequence of sets of ranks for all queries, and each query maps ranks to its own edges.

How many buckets to visit is measured, not guessed: for a bounded sample of queries the true neighbours are
found among all rows, and the sequence is followed until its buckets hold the wanted share of them. Every
row is indexed. Equal vectors are one point with its smallest ids, so copies cost nothing; a bucket of very
many points is dealt into blocks, all of which a query visits.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlens.operators.shared import ship_with_tasks, written_table

ship_with_tasks(__name__)

# Points wanted in a bucket, and in a block of a larger one at least; blocked buckets at most.
BUCKET_POINTS = 2_000
BLOCK_POINTS = 20_000
BLOCKED_BUCKETS = 20_000
# Queries whose true neighbours are looked up to choose the number of visits.
SAMPLE_QUERIES = 200
LONGEST_SEQUENCE = 4_000
# Slot width; projections of unit vectors have a standard deviation of one, which gives a slot number BITS bits.
WIDTH, BITS = 1.5, 1.4
QUERY_ROWS = 500
PRODUCTS = 10_000_000


def probing_sequence(functions: int, longest: int = LONGEST_SEQUENCE) -> list[tuple[int, ...]]:
    """Sets of edge ranks (1 the nearest of 2 * functions edges) by ascending expected cost, first the empty set.

    The j-th nearest of the 2m edges has an expected squared distance, in slots, of j(j+1) / (4(m+1)(m+2)) for
    j <= m, and of 1 - (2m+1-j)/(m+1) + (2m+1-j)(2m+2-j) / (4(m+1)(m+2)) beyond. Ranks j and 2m+1-j are the
    two edges of one slot, of which only one can be crossed. A set is followed by the one with its largest rank
    raised and the one with the next rank added.
    """
    m = functions
    cost = [0.0] * (2 * m + 1)
    for j in range(1, 2 * m + 1):
        k = 2 * m + 1 - j
        near = j * (j + 1) / (4 * (m + 1) * (m + 2))
        cost[j] = near if j <= m else 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    sequence: list[tuple[int, ...]] = [()]
    heap = [(cost[1], (1,))]
    while heap and len(sequence) < longest:
        total, ranks = heappop(heap)
        if all(2 * m + 1 - j not in ranks for j in ranks):
            sequence.append(ranks)
        last = ranks[-1]
        if last < 2 * m:
            heappush(heap, (total - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heappush(heap, (total + cost[last + 1], (*ranks, last + 1)))
    return sequence


class Tables:
    """The hash functions of all tables, from a seed."""

    def __init__(self, dimensions: int, tables: int, functions: int, width: float, norm: float, seed: int):
        draw = np.random.default_rng(seed)
        self.tables, self.functions, self.norm, self.width = tables, functions, norm, width
        self.directions = draw.standard_normal((dimensions + 1, tables * functions))
        self.shifts = draw.uniform(0, width, tables * functions)
        self.keys = draw.integers(1, 1 << 62, functions) | 1
        # Added to a table's bucket numbers, so that tables do not share buckets.
        self.apart = draw.integers(1, 1 << 62, tables)

    def _slots(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        spots = vectors @ self.directions[:-1] + last[:, None] * self.directions[-1] + self.shifts
        return (spots / self.width).reshape(len(vectors), self.tables, self.functions)

    def _bucket(self, slots: np.ndarray) -> np.ndarray:
        return (slots.astype(np.int64) * self.keys).sum(axis=-1)

    def of_points(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table."""
        scaled = vectors / self.norm
        last = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
        return self._bucket(np.floor(self._slots(scaled, last)))

    def of_queries(self, vectors: np.ndarray, sequence: list[tuple[int, ...]]) -> np.ndarray:
        """Buckets to visit, in order: queries x tables x visits."""
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        spots = self._slots(unit, np.zeros(len(unit)))
        home = np.floor(spots)
        below = spots - home
        # Edges: first those below each slot, then those above; ranked by distance.
        order = np.argsort(np.concatenate([below, 1 - below], axis=-1), axis=-1, kind="stable")
        steps = np.concatenate([-self.keys, self.keys])
        moves = steps[order]
        base = self._bucket(home)
        buckets = np.empty((*base.shape, len(sequence)), np.int64)
        for i, ranks in enumerate(sequence):
            buckets[..., i] = base + moves[..., [j - 1 for j in ranks]].sum(axis=-1) if ranks else base
        return buckets


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), dimensions))
    values = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(dimensions) < sizes[:, None]] = values
    return out


def _best(scores: np.ndarray, keep: int) -> Iterator[np.ndarray]:
    """Columns of the ``keep`` largest scores of each row, with all that tie with the last, up to rounding."""
    if keep >= scores.shape[1]:
        yield from (np.arange(scores.shape[1]) for _ in scores)
        return
    least = np.partition(scores, -keep, axis=1)[:, -keep]
    for row, edge in zip(scores, (least - 1e-9 * (1 + np.abs(least))).tolist()):
        yield np.flatnonzero(row >= edge)


def _top(queries: np.ndarray, points: np.ndarray, ids: pa.Array, keep: int) -> Iterator[tuple[int, list, list]]:
    """For each query the ids and scores of its ``keep`` nearest among some points."""
    firsts = np.append(0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    height = min(QUERY_ROWS, max(1, PRODUCTS // max(len(points), 1)))
    for first in range(0, len(queries), height):
        block = queries[first : first + height]
        near = _best(block @ points.T, keep)
        for i, columns in enumerate(near):
            # Summed again in one fixed order, so that a pair's score is the same wherever it is found.
            scores = (points[columns] * block[i]).sum(axis=1)
            sizes = firsts[columns + 1] - firsts[columns]
            found = np.concatenate([flat[firsts[c] : firsts[c + 1]] for c in columns.tolist()])
            score = np.repeat(scores, sizes)
            order = np.lexsort((found, -score))[:keep]
            yield first + i, found[order].tolist(), score[order].tolist()


HITS = pa.schema([("query", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
HITS_SQL = "query long, ids array<long>, scores array<double>"


def _scan(queries: np.ndarray, dimensions: int, keep: int):
    """The nearest points of a few queries in each batch of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = _matrix(batch.column("vector"), dimensions)
                rows = list(_top(queries, points, batch.column("ids"), keep))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), HITS)], schema=HITS)

    return run


PLACED = pa.schema(
    [("place", pa.int64()), ("block", pa.int32()), ("query", pa.int64()), ("vector", pa.list_(pa.float64())),
     ("ids", pa.list_(pa.int64()))]
)
PLACED_SQL = "place long, block int, query long, vector array<double>, ids array<long>"


def _place(tables: Tables, sequence: list[tuple[int, ...]], blocks: dict[int, int], dimensions: int):
    """Each point to its bucket in every table, each query to all buckets it visits, with all their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"), dimensions)
            number = batch.column("point").to_numpy()
            place = tables.of_points(vectors) + tables.apart
            block = np.zeros(place.shape, np.int32)
            for i, j in zip(*np.nonzero(np.isin(place, list(blocks)))):
                block[i, j] = number[i] % blocks[int(place[i, j])]
            row = np.repeat(np.arange(len(vectors)), tables.tables)
            at = pa.array(row)
            yield pa.record_batch(
                [place.ravel(), block.ravel(), pa.nulls(len(row), pa.int64()), batch.column("vector").take(at),
                 batch.column("ids").take(at)],
                schema=PLACED,
            )
            asking = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False))
            for first in range(0, len(asking), QUERY_ROWS):
                some = asking[first : first + QUERY_ROWS]
                visits = tables.of_queries(vectors[some], sequence) + tables.apart[:, None]
                row, visit = [], []
                for i, found in zip(some.tolist(), visits.reshape(len(some), -1)):
                    for p in np.unique(found).tolist():
                        for b in range(blocks.get(p, 1)):
                            row.append(i)
                            visit.append((p, b))
                places, numbers = zip(*visit)
                yield pa.record_batch(
                    [pa.array(places, pa.int64()), pa.array(numbers, pa.int32()), pa.array(number[row]),
                     batch.column("vector").take(pa.array(row)), pa.nulls(len(row), PLACED.field("ids").type)],
                    schema=PLACED,
                )

    return run


def _buckets(tables: Tables, dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = tables.of_points(_matrix(batch.column("vector"), dimensions)) + tables.apart
            yield pa.record_batch([pa.array(places.ravel())], ["place"])

    return run


def _meet(dimensions: int, keep: int):
    """The nearest points of one block for all queries that visit it."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("query").is_valid()
        queries, points = table.filter(asks), table.filter(table.column("query").is_null())
        if not queries.num_rows or not points.num_rows:
            return HITS.empty_table()
        number = queries.column("query").to_pylist()
        ids = points.column("ids").combine_chunks()
        found = _top(_matrix(queries.column("vector"), dimensions), _matrix(points.column("vector"), dimensions), ids, keep)
        rows = [(number[i], near, scores) for i, near, scores in found]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), HITS)], schema=HITS)

    return run


def _merged(hits: DataFrame, keep: int) -> DataFrame:
    """One list of (-score, id) per query: the nearest of all lists, each id once."""
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("i"))
    lists = hits.select("query", pairs.alias("near"))
    merged = lists.groupBy("query").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("all"))
    # array_distinct compares all pairs of structs; in a sorted list the neighbour before tells.
    once = F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1)))
    return merged.select("query", F.slice(once, 1, keep).alias("near"))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector of finite numbers that are not all zero; zeros at its end go."""
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and vector is not null").where(finite)
    last = F.array_max(F.transform("vector", lambda x, i: F.when(x != 0, i + 1)))
    # Minus zero is zero: equal vectors have to group.
    plain = F.transform(F.slice("vector", F.lit(1), last), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    return rows.where(F.exists("vector", lambda x: x != 0)).select("vec_id", plain.alias("vector"))


def _points(rows: DataFrame, k: int, query_modulus: int) -> DataFrame:
    """Distinct vectors: the smallest id as their number, their k + 1 smallest ids, and whether one asks."""
    asks = rows.groupBy("vector").agg(F.max(F.col("vec_id") % query_modulus == 0).alias("asks"))
    # A limit by rank is kept per task before the shuffle, so copies of one vector meet as few rows.
    once = rows.groupBy("vector", "vec_id").agg(F.count("*").alias("copies"))
    turn = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    first = once.select("vector", "vec_id", turn.alias("turn")).where(F.col("turn") <= k + 1)
    listed = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return listed.join(asks, "vector").select("vector", "ids", "asks", F.monotonically_increasing_id().alias("point"))


def _fitted(
    points: DataFrame, asking: list, hashes: Tables, dimensions: int, k: int, recall: float
) -> list[tuple[int, ...]]:
    """The probing sequence, as far as it takes to meet the share ``recall`` of the sample's true neighbours."""
    sample = np.zeros((len(asking), dimensions))
    for i, row in enumerate(asking):
        sample[i, : len(row["vector"])] = row["vector"]
    scanned = points.select("vector", F.array("point").alias("ids"))
    scanned = _merged(scanned.mapInArrow(_scan(sample, dimensions, k + 1), HITS_SQL), k + 1).collect()
    near = {r["query"]: [x["i"] for x in r["near"] if x["i"] != asking[r["query"]]["point"]] for r in scanned}
    # At most k of each sampled query.
    wanted = points.sparkSession.createDataFrame([(x,) for x in sorted({x for xs in near.values() for x in xs})], "point long")
    known = points.join(F.broadcast(wanted), "point").select("point", "vector").collect()
    vectors = np.zeros((len(known), dimensions))
    for i, row in enumerate(known):
        vectors[i, : len(row["vector"])] = row["vector"]
    number = {row["point"]: i for i, row in enumerate(known)}
    sequence = probing_sequence(hashes.functions)
    if not known:
        return sequence[:1]
    visits, held = hashes.of_queries(sample, sequence), hashes.of_points(vectors)
    turns = []
    for query, found in near.items():
        for x in found:
            met = visits[query] == held[number[x]][:, None]
            turns.append(int(met.any(axis=0).argmax()) if met.any() else len(sequence))
    return sequence[: int(np.quantile(turns, recall, method="higher")) + 1]


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    query_modulus: int = 20,
    tables: int = 3,
    recall: float = 0.97,
    bucket_points: int = BUCKET_POINTS,
    sample_queries: int = SAMPLE_QUERIES,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` vectors of largest inner product found for every row whose id ``query_modulus`` divides.

    Returns query_id, rank (from 1), vec_id, score (double). Candidates are all rows but those of the query's
    own id; ties go to the smaller id. Approximate: buckets are visited until, on a sample of at most
    ``sample_queries`` queries, they hold the share ``recall`` of the true neighbours among all rows, or the
    sequence of visits ends. Scores are exact.

    Vectors that are null or zero or hold null or non-finite components, and rows without id, take no part.
    A shorter vector counts as filled up with zeros. A row that stands there twice is one candidate; an id with
    several vectors asks and is found with each of them. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col)
    points = written_table(_points(rows, k, query_modulus), "ann-points")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    total, dimensions, norm = points.agg(F.count("*"), F.max(F.size("vector")), F.max(length)).first()
    asking = points.where("asks").orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(sample_queries).collect()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    functions = int(np.clip(np.ceil(np.log2(max(total / bucket_points, 1)) / BITS), 1, 24))
    hashes = Tables(dimensions, tables, functions, WIDTH, norm, seed)
    sequence = _fitted(points, asking, hashes, dimensions, k, recall)

    limit = max(BLOCK_POINTS, tables * total // BLOCKED_BUCKETS)
    sizes = points.select("vector").mapInArrow(_buckets(hashes, dimensions), "place long").groupBy("place").count()
    blocks = {r["place"]: -(-r["count"] // limit) for r in sizes.where(F.col("count") > limit).collect()}
    placed = points.mapInArrow(_place(hashes, sequence, blocks, dimensions), PLACED_SQL)
    hits = placed.groupBy("place", "block").applyInArrow(_meet(dimensions, k + 1), HITS_SQL)
    # Every id of a point that asks, from all rows, as points list their smallest ids only.
    queries = rows.where(F.col("vec_id") % query_modulus == 0).distinct()
    queries = queries.join(points.select("vector", F.col("point").alias("query")), "vector").select("vec_id", "query")
    found = queries.join(_merged(hits, k + 1), "query")
    others = F.slice(F.filter("near", lambda x: x["i"] != F.col("vec_id")), 1, k)
    ranked = found.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("rank", "hit"))
    return ranked.select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.i").alias("vec_id"), (-F.col("hit.s")).alias("score")
    )
