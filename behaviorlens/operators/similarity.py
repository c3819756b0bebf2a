"""Look-alike search over embeddings by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from behaviorlens.sources.store import written

#: Signs of a code.
CODE_BITS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(vector: Column) -> Column:
    """The vector over its length, which is computed once; null for one of length 0."""
    length = F.nullif(F.sqrt(dot(vector, vector)), F.lit(0.0))
    return F.get(F.transform(F.array(length), lambda n: F.when(n.isNotNull(), F.transform(vector, lambda x: x.cast("double") / n))), F.lit(0))


#: Numbers in the query vectors of one cell, and points of one cell.
BLOCK_NUMBERS, CELL_POINTS = 4_000_000, 8192
#: Queries and points whose products are looked at together, and how far such a product may be from `dot`.
TOGETHER, NEAR = 1024, 1e-9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _codes_met(points: pa.Table, queries: pa.Table):
    """Whether the codes of some queries and some points are as near as the queries' reach."""
    own, asked = (_matrix(t["code"]).view(np.uint64) for t in (points, queries))
    reach = queries["reach"].to_numpy()

    def met(qs: slice, ps: slice) -> np.ndarray:
        apart = sum(np.bitwise_count(asked[qs, None, w] ^ own[None, ps, w]).astype(np.int32) for w in range(own.shape[1]))
        return apart <= reach[qs, None]

    return met


def _first_met(points: pa.Table, queries: pa.Table):
    """Whether the cell's table is the first in which some queries and some points share a bucket."""
    table, n = points["table"][0].as_py(), len(points["buckets"][0])
    words = pa.concat_arrays([t["buckets"].combine_chunks().flatten() for t in (points, queries)]).dictionary_encode().indices.to_numpy().reshape(-1, n)
    own, asked = words[: len(points)], words[len(points) :]

    def met(qs: slice, ps: slice) -> np.ndarray:
        before = np.zeros((qs.stop - qs.start, ps.stop - ps.start), bool)
        for t in range(table):
            before |= asked[qs, None, t] == own[None, ps, t]
        return ~before

    return met


def _best(k: int, meeting=None):
    """(query_id, point_id, score): the k points of a cell that are nearest to each of its queries.

    Products of matrices tell which pairs may be among the k best; those are scored as `dot` does,
    number by number, so that equal vectors tie wherever they are. What is held is a block of
    products and k pairs a query. `meeting` takes the cell's points and queries and returns which pairs count.
    """

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(points) or not len(queries):
            points, queries = points.slice(0, 0), queries.slice(0, 0)
            return pa.table({"query_id": queries["query_id"], "point_id": points["point_id"], "score": pa.array([], pa.float64())})
        ids = points["point_id"].combine_chunks()
        place = np.empty(len(ids), np.int64)  # the places of the points by their ids, for ties
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        same = pa.concat_arrays([ids, queries["query_id"].combine_chunks().cast(ids.type)]).dictionary_encode().indices.to_numpy()
        own, asked = same[: len(ids)], same[len(ids) :]
        x, q = _matrix(points["v"]), _matrix(queries["qv"])
        met = None if meeting is None else meeting(points, queries)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(q), TOGETHER):
            qs = slice(a, min(a + TOGETHER, len(q)))
            n = qs.stop - a
            who, what, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
            for b in range(0, len(x), TOGETHER):
                ps = slice(b, min(b + TOGETHER, len(x)))
                products = q[qs] @ x[ps].T
                products[np.isnan(products)] = np.inf  # no number comes before all numbers, as in Spark
                products[asked[qs, None] == own[None, ps]] = -np.inf
                if met is not None:
                    products[~met(qs, ps)] = -np.inf
                rows = np.flatnonzero(products.max(axis=1) >= least - NEAR)
                block, floor = products[rows], least[rows]
                if block.shape[1] > k:
                    floor = np.maximum(floor, np.partition(block, -k, axis=1)[:, -k])
                i, j = np.nonzero((block >= (floor - NEAR)[:, None]) & (block > -np.inf))
                i, j = rows[i], j + b
                exact = np.zeros(len(i))
                for d in range(x.shape[1]):
                    exact += x[j, d] * q[a + i, d]
                who, what, score = np.concatenate([who, i]), np.concatenate([what, j]), np.concatenate([score, exact])
                order = np.lexsort((place[what], -np.where(np.isnan(score), np.inf, score), who))
                who = who[order]
                kept = np.arange(len(who)) - np.searchsorted(who, who) < k
                who, what, score = who[kept], what[order][kept], score[order][kept]
                last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == k - 1)
                least[who[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
            found.append((who + a, what, score))
        who, what, score = (np.concatenate(c) for c in zip(*found))
        return pa.table({"query_id": queries["query_id"].combine_chunks().take(pa.array(who)), "point_id": ids.take(pa.array(what)), "score": score})

    return run


def _ranked(points: DataFrame, queries: DataFrame, cell: list[str], k: int, meeting=None) -> DataFrame:
    """(query_id, point_id, score, rank): the k best pairs of each query that share a cell.

    `points` have point_id and v, `queries` query_id and qv, both what `meeting` looks at. A pair is to count in one cell alone.
    A cell is one group of one task, so it is to be of bounded size.
    """
    kinds = dict(points.dtypes)["point_id"], dict(queries.dtypes)["query_id"]
    cells = points.groupBy(*cell).cogroup(queries.groupBy(*cell))
    best = cells.applyInArrow(_best(k, meeting), f"query_id {kinds[1]}, point_id {kinds[0]}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "point_id", "score", "rank")


def _directed(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    return rows.select(F.col("point_id").alias(id_col), normalised(F.col("vector")).alias(name)).where(F.col(name).isNotNull() & F.col(id_col).isNotNull())


def _grid(points: DataFrame, queries: DataFrame, block_numbers: int, vector: str) -> tuple[DataFrame, DataFrame]:
    """Points and queries in the cells (block, share, size): a block of queries, a share of the points, vectors of one length."""
    counted = queries.agg(F.sum(F.size(vector))).first()[0] or 0
    blocks, shares = max(1, -(-counted // block_numbers)), max(1, -(-points.count() // CELL_POINTS))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = points.withColumns({"share": part("point_id", shares), "size": F.size("v")}).withColumn("block", each(blocks))
    asked = queries.withColumns({"block": part("query_id", blocks), "size": F.size(vector)}).withColumn("share", each(shares))
    return own, asked


def find_similar(points: DataFrame, queries: DataFrame, k: int = 10, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(query_id, point_id, score, rank): the k points nearest to each query, the query itself left out.

    `queries` is a stated set of points. All pairs are looked at, in a grid of cells of bounded
    size that tasks share; of a cell only the k best of each query leave it. Points without a
    direction (null, empty or zero) are near nothing and are left out, and so are pairs of vectors
    of unlike lengths.
    """
    own, asked = _grid(_directed(points, "point_id", "v"), _directed(queries, "query_id", "qv"), block_numbers, "qv")
    return _ranked(own, asked, ["block", "share", "size"], k)


def random_planes(dimension: int, bits: int, tables: int, seed: int = 0) -> list[list[list[float]]]:
    """For each table, `bits` random directions: the same for the same seed."""
    return np.random.default_rng(seed).standard_normal((tables, bits, dimension)).tolist()


def lsh_neighbours(points: DataFrame, queries: DataFrame, planes: list[list[list[float]]], k: int = 10) -> DataFrame:
    """`find_similar` among the points that share a bucket with the query in some table.

    A bucket is the signs of a vector on a table's directions. Points and queries meet in cells: a
    table, a bucket and a share of its points, so a query is compared with its buckets and not with
    all points, and a bucket of any size is many tasks'. It is approximate, and good for vectors in
    clusters: more tables or fewer bits find more. Without clusters it misses many;
    `code_neighbours` doesn't. A pair that meets in several tables counts in the first.
    """

    def keyed(rows: DataFrame, id_col: str, name: str) -> DataFrame:
        signs = lambda table: F.concat(*[F.when(dot(F.col(name), F.array(*map(F.lit, p))) >= 0, "1").otherwise("0") for p in table])
        found = written(_directed(rows, id_col, name).withColumns({"size": F.size(name), "buckets": F.array(*[signs(t) for t in planes])}))
        return found.select("*", F.posexplode("buckets").alias("table", "bucket"))

    own, asked, key = keyed(points, "point_id", "v"), keyed(queries, "query_id", "qv"), ["table", "bucket", "size"]
    sizes = own.groupBy(*key).agg(F.ceil(F.count("*") / CELL_POINTS).alias("shares"))  # a row per bucket
    own = own.join(sizes, key).withColumn("share", F.pmod(F.xxhash64("point_id"), F.col("shares"))).drop("shares")
    asked = asked.join(sizes, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    return _ranked(own, asked, [*key, "share"], k, _first_met)


def sign_codes(points: DataFrame, dimension: int, bits: int = CODE_BITS, seed: int = 0) -> DataFrame:
    """(point_id, vector, code): the signs of a vector on `bits` random directions, 64 of them in a word.

    Points without a direction, or of another dimension, are left out.
    """
    directions = np.random.default_rng(seed).standard_normal((dimension, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dimension)
                words = np.packbits(x @ directions >= 0, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(words), pa.list_(pa.int64()))], ["point_id", "vector", "code"])

    kept = points.select("point_id", normalised(F.col("vector")).alias("vector")).where("vector is not null").where(F.size("vector") == dimension)
    kind = dict(points.dtypes)["point_id"]
    return kept.mapInArrow(run, f"point_id {kind}, vector array<double>, code array<bigint>")


def code_neighbours(points: DataFrame, queries: DataFrame, dimension: int, k: int = 10, share: float = 0.05, bits: int = CODE_BITS, seed: int = 0, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """`find_similar` among the `share` of the points whose sign codes are nearest to the query's: (query_id, point_id, score, rank).

    Every point is looked at by its code, 64 signs at a time; the distances of a query to all of
    them are counted first, a number for each distance, and tell which distance the share reaches.
    Only points as near as that are compared by their vectors. It is approximate: with 512 bits
    and a share of 0.05 a test holds it to a recall of 0.9 on vectors without any clusters.
    Queries are a stated set that meets the points in blocks of bounded size.
    """
    coded, asked = written(sign_codes(points, dimension, bits, seed)), written(sign_codes(queries, dimension, bits, seed))
    n, n_queries, parts = coded.count(), asked.count(), []
    blocks = max(1, -(-n_queries * dimension // block_numbers))
    apart = F.aggregate(F.zip_with("code", "_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("point_id"), F.lit(blocks)) == i).toDF("query_id", "_vector", "_code")
        met = coded.join(F.broadcast(block), F.col("point_id") != F.col("query_id")).withColumn("apart", apart)
        counts = met.groupBy("query_id", "apart").agg(F.count("*").alias("n"))  # a row per query and distance
        upto = F.sum("n").over(Window.partitionBy("query_id").orderBy("apart"))
        reach = counts.withColumn("upto", upto).where(F.col("upto") - F.col("n") < F.lit(max(k, share * n))).groupBy("query_id").agg(F.max("apart").alias("reach"))
        parts.append(block.join(reach, "query_id"))
    reached = written(reduce(DataFrame.unionByName, parts)).withColumnsRenamed({"_vector": "qv", "_code": "code"})
    own, wanted = _grid(coded.withColumnRenamed("vector", "v").where("point_id is not null"), reached, block_numbers, "qv")
    return _ranked(own, wanted, ["block", "share", "size"], k, _codes_met)


def mean_embedding(points: DataFrame, key: str) -> DataFrame:
    """(key, vector): the mean of the vectors of each key."""
    cells = points.select(key, F.posexplode("vector").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(key, F.transform("c", lambda x: x["x"]).alias("vector"))


def upsert(stored: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("version", "user_id")) -> DataFrame:
    """Stored points whose key isn't written anew, and the new ones, with defaults for their payload."""
    new = new.fillna({"score": 0.0, "department": "", "scenario": 0})
    return stored.join(new.select(*keys), list(keys), "left_anti").unionByName(new)
