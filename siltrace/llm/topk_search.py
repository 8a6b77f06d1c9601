"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse: (id, terms, weights).  Queries and candidates are cut into blocks of bounded size, and every pair of blocks
is one task's work: each term's postings are scattered, weighted by the query rows that hold the term, into a dense score
array (queries x candidates), a tile at a time; partition gives each query's k largest scores of the tile, which are merged with
those of earlier tiles, and the blocks' selections are merged last.  Blocks are large, as every candidate is sent once for each
block of queries, and every query once for each block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_PER_BLOCK = 32_768
QUERIES_PER_BLOCK = 16_384
_TILE_SCORES = 1 << 21  # held at once
_NONE = np.iinfo(np.int64).min

_ROW = "id long, terms array<int>, weights array<long>"


def sparse_rows(df: DataFrame, id_col: str, vector: Column, scale: int = 1024) -> DataFrame:
    """(id, terms, weights) of floor(scale * x); rows without id and rows with null or non-finite components are left out, zeros
    are implied.  Components whose scaled size reaches 2**53 are no exact whole numbers and are refused (a Spark error)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    sound = F.col(id_col).isNotNull() & vector.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    large = F.raise_error(F.lit("a component is too large for exact scores")).cast("long")
    q = F.transform(v, lambda x: F.when(F.abs(x * float(scale)) < 2.0**53, F.floor(x * float(scale)).cast("long")).otherwise(large))
    rows = df.filter(sound).select(F.col(id_col).cast("long").alias("id"), q.alias("q"))
    terms = F.filter(F.sequence(F.lit(0), F.size("q") - 1), lambda i: F.get("q", i) != 0)
    terms = F.when(F.size("q") > 0, terms).otherwise(F.array().cast("array<int>"))
    return rows.select("id", terms.alias("terms"), F.filter("q", lambda x: x != 0).alias("weights"))


def _csr(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, row of each entry, term, weight), rows by ascending id."""
    table = table.sort_by("id").combine_chunks()
    ids = table["id"].to_numpy()
    terms, weights = table["terms"].combine_chunks(), table["weights"].combine_chunks()
    row = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
    return ids, row, terms.flatten().to_numpy(), weights.flatten().to_numpy()


def _postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    order = np.argsort(term, kind="stable")
    names, at = np.unique(term[order], return_index=True)
    cut = np.append(at, len(order))
    return {int(t): (row[order[a:b]], weight[order[a:b]]) for t, a, b in zip(names, cut[:-1], cut[1:], strict=True)}


def _scores(c: tuple, q_postings: dict, n_queries: int, lo: int, hi: int) -> np.ndarray:
    """Dense scores (queries x candidates lo..hi), accumulated term by term."""
    _, row, term, weight = c
    a, b = np.searchsorted(row, [lo, hi])
    out = np.zeros((n_queries, hi - lo), np.int64)
    for t, (own, w) in _postings(row[a:b] - lo, term[a:b], weight[a:b]).items():
        if t not in q_postings:
            continue
        queries, qw = q_postings[t]
        if len(queries) == n_queries and len(own) == hi - lo:
            out += qw[:, None] * w
        else:
            out[np.ix_(queries, own)] += qw[:, None] * w
    return out


def _first_of_each(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by descending score, then id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], ids[place < k], scores[place < k]


def _block(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        best = (empty, empty, empty)  # (query's place, candidate, score)
        asked = empty
        if candidates.num_rows and queries.num_rows:
            c, q = _csr(candidates), _csr(queries)
            asked, n, q_postings = q[0], len(q[0]), _postings(*q[1:])
            least = np.full(n, _NONE)  # a query's k-th best score so far
            step = max(k + 1, _TILE_SCORES // n)
            for lo in range(0, len(c[0]), step):
                ids = c[0][lo : lo + step]
                dense = _scores(c, q_postings, n, lo, lo + len(ids))
                own = asked[:, None] == ids
                dense[own] = _NONE
                floor = np.maximum(least, np.partition(dense, len(ids) - k, axis=1)[:, len(ids) - k]) if len(ids) > k else least
                i, j = np.nonzero((dense >= floor[:, None]) & ~own)
                best = _first_of_each(*[np.concatenate(x) for x in zip(best, (i, ids[j], dense[i, j]), strict=True)], k)
                full = np.flatnonzero(np.bincount(best[0], minlength=n) == k)
                least[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
        return pa.table({"query_id": asked[best[0]], "vec_id": best[1], "score": best[2]})

    return run


def topk_search(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
    queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Both sides are (id, terms, weights) rows as of :func:`sparse_rows`.  A candidate with the query's own id takes no part.
    A query with fewer than k candidates gets all; with none it has no rows.  Repeated candidate rows each take a rank;
    repeated query rows count once (of several rows with one id, any one).  Rows without id take no part on either side.  Terms
    that one side lacks add nothing, so vectors may differ in length; a task holds the terms of its blocks' rows, however many, and a
    score of 64 bits wraps beyond that.  An empty table on either side gives an empty result; other columns are not read.
    """
    candidates, queries = (x.filter("id IS NOT NULL").select("id", "terms", "weights") for x in (candidates, queries))
    # Small tables are cut into as many blocks as there are cores.
    rows, cores = candidates.count(), candidates.sparkSession.sparkContext.defaultParallelism
    n_c = max(1, -(-rows // candidates_per_block), min(cores, rows // 1024))
    n_q = max(1, -(-queries.count() // queries_per_block))
    unique = queries.dropDuplicates(["id"])
    pick = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("cb", pick(n_c)).withColumn("qb", every(n_q))
    right = unique.withColumn("qb", pick(n_q)).withColumn("cb", every(n_c))
    parts = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(_block(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
