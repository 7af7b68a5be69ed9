"""Exact top-k by integer inner product with an M-tree.

Components are floor(256 * x).  Inner product search becomes metric search by
one more coordinate: with M the largest squared length, a vector v gets
sqrt(M - |v|^2) and a query 0, and then |q - v|^2 = |q|^2 + M - 2 q.v, so the
nearest vectors are those of the largest inner product.

**Tree.**  The root holds ``routers`` routing vectors, drawn from a bounded
sample.  Every vector goes to its nearest router; a router's vectors are
dealt to groups of about ``group_rows``, and each group is split into pages of
at most ``page_rows`` vectors around nearby centres.  A page stores its centre,
covering radius, its distance from the router (the parent distance), and each
vector's distance from the centre, all as rows of a table in Spark.

**Search.**  Queries come in blocks of those with a common nearest router.  In
the first round a block searches its own router's groups and learns the k-th
best distance of each of its queries; in the second it goes to all groups
whose page bounds can still beat that.  In a group, pages are taken best
first by the lower bound |d(q, centre) - 0| - radius; before d(q, centre) is
worked out, the stored parent distance bounds it, and before a vector is
compared, its stored distance from the centre does.  Scores are exact integers:
float64 products where no sum can reach 2^53, else 64-bit integer products;
bounds in floating point have a margin.

Every vector is indexed and the result is exact.  The parameters bound only
sizes.  At most ``routers`` rows are broadcast.

Edge cases: vectors that are NULL, or hold a NULL or non-finite component,
and rows with NULL vec_id take no part.  Of rows that repeat a vec_id, the
smallest vector counts, once.  Vectors of unequal length are compared as if
filled up with zeros; an empty vector is a zero vector.  Fewer candidates
than k: all of them.  A component or a score that does not fit a 64-bit integer
ends the job with an error that says so.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

K = 5
ROUTERS, SAMPLE_ROWS = 64, 2048
GROUP_ROWS, PAGE_ROWS, BLOCK_ROWS = 8192, 256, 512
#: Margin on floating-point distances used as bounds, relative to them and to the longest vector.
MARGIN = 1e-6
#: Stands for no score; far below any, and its negative is a number too.
NONE = 1 - (1 << 63)
#: Longest squared length at which float64 inner products are exact.
EXACT = 2.0**52


def quantised(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): integer components and squared length of each
    vector that takes part."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(F.col(vec_id).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v")
    )
    once = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    return once.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))


def inner(q: np.ndarray, x: np.ndarray, top: float, counts: np.ndarray) -> np.ndarray:
    """Exact integer inner products, where ``counts``, of rows of integers in
    float64 whose squared lengths are at most about ``top``."""
    score = q @ x.T
    if top < EXACT:
        return np.rint(score).astype(np.int64)
    # 64-bit sums wrap, so they are right whenever the true value fits a long.
    error = 1e-12 * np.outer(np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1)))
    if (counts & (np.abs(score) + error >= 2.0**63)).any():
        raise ValueError("an inner product does not fit a 64-bit integer")
    return q.astype(np.int64) @ x.T.astype(np.int64)


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of float64, which holds floors of doubles without loss."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def lifted(x: np.ndarray, norms: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, top - norms))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def build_pages(x: np.ndarray, router: np.ndarray, page_rows: int) -> list[dict]:
    """Pages of a group: rows are split in two around a far pair of centres
    until they fit; ``rows`` are places in the group."""
    pages, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        centre = x[rows].mean(axis=0)
        away = distances(x[rows], centre[None])[:, 0]
        if len(rows) <= page_rows:
            pages.append({"rows": rows, "centre": centre, "radius": float(away.max()), "parent": float(np.sqrt(((centre - router) ** 2).sum())), "away": away})
            continue
        one = x[rows[int(away.argmax())]]
        to_one = distances(x[rows], one[None])[:, 0]
        two = x[rows[int(to_one.argmax())]]
        near = np.argsort(to_one - distances(x[rows], two[None])[:, 0], kind="stable")
        todo += [rows[near[: len(rows) // 2]], rows[near[len(rows) // 2 :]]]
    return pages


class Best:
    """The k best (score, vec_id) of each query of a block."""

    def __init__(self, queries: int, k: int):
        self.score = np.full((queries, k), NONE)
        self.vec = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, which: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """score: (queries, candidates), lowest value for none; vec: of the candidates."""
        k = self.score.shape[1]
        s = np.hstack([self.score[which], score])
        v = np.hstack([self.vec[which], np.broadcast_to(vec, score.shape)])
        order = np.lexsort((v, -s), axis=1)[:, :k]
        self.score[which], self.vec[which] = np.take_along_axis(s, order, 1), np.take_along_axis(v, order, 1)


def search_group(group: dict, pages: list[dict], q: np.ndarray, q_id: np.ndarray, q_router: np.ndarray, limit: np.ndarray, k: int) -> Best:
    """Best-first search of a block in one group.  ``limit``: scores that a
    candidate must reach, from earlier rounds; ``q_router``: distances of the
    queries from the group's router."""
    top, ids, x = group["top"], group["ids"], group["x"]
    best = Best(len(q), k)
    norms = (q * q).sum(1)
    lift = np.hstack([q, np.zeros((len(q), 1))])
    reach = lambda need: np.sqrt(np.maximum(0.0, norms + top - 2.0 * need)) * (1 + MARGIN) + MARGIN * (1 + 4 * np.sqrt(top))  # noqa: E731  farthest distance of a useful vector
    need = limit.astype(float)
    need[limit == NONE] = -np.inf
    # Parent distances bound d(q, centre) before it is worked out.
    parent = np.array([p["parent"] for p in pages])
    radius = np.array([p["radius"] for p in pages])
    floor = np.abs(q_router[:, None] - parent[None, :]) - radius[None, :]
    order = np.argsort(floor.min(axis=0), kind="stable")
    first = reach(need)
    order = order[(floor[:, order] <= first[:, None]).any(axis=0)]
    centre = distances(lift, np.array([pages[i]["centre"] for i in order])) if len(order) else None
    # Then pages best first by the bound from the centre itself.
    bound = [np.maximum(floor[:, i], centre[:, j] - radius[i]) for j, i in enumerate(order)]
    for j in sorted(range(len(order)), key=lambda j: bound[j].min()):
        page = pages[order[j]]
        useful = reach(need)
        live = np.flatnonzero(bound[j] <= useful)
        if not len(live):
            continue
        d = centre[live, j]
        # Stored distances from the centre bound those from the query.
        can = np.abs(d[:, None] - page["away"][None, :]) <= useful[live, None]
        some = can.any(axis=0)
        rows = page["rows"][some]
        counts = can[:, some] & (q_id[live][:, None] != ids[rows][None, :])
        score = inner(q[live], x[rows], top, counts)
        score[~counts] = NONE
        best.add(live, score, ids[rows])
        need[live] = np.maximum(need[live], np.where(best.score[live, -1] == NONE, -np.inf, best.score[live, -1].astype(float)))
    return best


def top_k(
    table: DataFrame,
    is_query: Column,
    k: int = K,
    routers: int = ROUTERS,
    sample_rows: int = SAMPLE_ROWS,
    group_rows: int = GROUP_ROWS,
    page_rows: int = PAGE_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row of ``table`` for which
    ``is_query`` (over vec_id) holds, against all other rows."""
    spark = table.sparkSession
    vectors = cut(quantised(table))
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: F.greatest(s, F.abs(c.cast("double"))))).alias("largest")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not facts.n:
        return spark.createDataFrame([], schema)
    if facts.largest >= 2.0**63:
        raise ValueError("a component times 256 does not fit a 64-bit integer")
    top, width = float(facts.top), max(1, facts.width)

    # Root: routing vectors from a bounded sample.
    chance = min(1.0, sample_rows / facts.n)
    sample = vectors.where(F.xxhash64(F.lit("root"), "vec_id") / F.lit(2.0**64) + 0.5 <= chance).orderBy("vec_id").limit(2 * sample_rows).toPandas()
    sample = sample if len(sample) else vectors.orderBy("vec_id").limit(1).toPandas()
    pool = lifted(matrix(sample["v"], width), sample["norm"].to_numpy(float), top)
    chosen = [0]
    nearest = distances(pool, pool[:1])[:, 0]
    while len(chosen) < min(routers, len(pool), max(1, facts.n // page_rows)):  # each next one is the farthest from those before
        if not nearest.max() > 0:
            break
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(pool, pool[chosen[-1:]])[:, 0])
    roots = spark.sparkContext.broadcast(pool[chosen])

    def assign(last_coordinate: bool):
        """Nearest router and the distance from it; queries have 0 as their last coordinate."""

        def run(batches):
            for part in batches:
                norms = part["norm"].to_numpy(float) if last_coordinate else np.full(len(part), top)
                away = distances(lifted(matrix(part["v"], width), norms, top), roots.value)
                yield part.assign(router=away.argmin(axis=1), away=away.min(axis=1))

        return run

    with_router = "vec_id long, v array<long>, norm double, router int, away double"
    placed = cut(vectors.mapInPandas(assign(True), with_router))
    entries = cut(placed.groupBy("router").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("groups"), F.max("away").alias("radius")))
    placed = placed.join(F.broadcast(entries), "router").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int"))

    def build(key, rows):
        x = matrix(rows["v"], width)
        pages = build_pages(lifted(x, rows["norm"].to_numpy(float), top), roots.value[key[0]], page_rows)
        ids = rows["vec_id"].to_numpy()
        return pd.DataFrame(
            [
                (key[0], key[1], n, p["centre"].tobytes(), p["radius"], p["parent"], p["away"].tobytes(), ids[p["rows"]].tobytes(), x[p["rows"]].tobytes())
                for n, p in enumerate(pages)
            ],
            columns=["router", "part", "page", "centre", "radius", "parent", "away", "ids", "x"],
        )

    paged = placed.groupBy("router", "part").applyInPandas(
        build, "router int, part int, page int, centre binary, radius double, parent double, away binary, ids binary, x binary"
    )
    # One row per group, of at most about 2 * group_rows vectors.
    page = F.struct("page", "centre", "radius", "parent", "away", "ids", "x")
    groups = cut(paged.groupBy("router", "part").agg(F.sort_array(F.collect_list(page)).alias("pages")))
    covered = {r.router: r.radius for r in entries.collect()}  # at most ``routers`` rows

    asked = cut(vectors.where(is_query).mapInPandas(assign(False), with_router).select("vec_id", "v", "norm", "router"))
    by_score = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def search(batches):
        for part in batches:
            for row in part.itertuples(index=False):
                q_id, q, limit = np.array(row.q_ids), matrix(row.qs, width), np.array(row.limits)
                pages, at, xs, ids = [], 0, [], []
                for p in row.pages:
                    member = np.frombuffer(p["ids"], np.int64)
                    pages.append({"rows": np.arange(at, at + len(member)), "centre": np.frombuffer(p["centre"]), "radius": p["radius"], "parent": p["parent"], "away": np.frombuffer(p["away"])})
                    ids.append(member)
                    xs.append(np.frombuffer(p["x"]).reshape(len(member), width))
                    at += len(member)
                group = {"top": top, "ids": np.concatenate(ids), "x": np.concatenate(xs)}
                to_router = distances(np.hstack([q, np.zeros((len(q), 1))]), roots.value[row.router][None])[:, 0]
                best = search_group(group, pages, q, q_id, to_router, limit, k)
                which, place = np.nonzero(best.score != NONE)
                yield pd.DataFrame({"query_id": q_id[which], "vec_id": best.vec[which, place], "score": best.score[which, place]})

    def meet(routed: DataFrame) -> DataFrame:
        """Searches the groups of their routers for (router, vec_id, v, limit),
        in blocks of queries: a stated query set against all rows."""
        split = routed.groupBy("router").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))  # at most ``routers`` rows
        dealt = routed.join(F.broadcast(split), "router").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
        packed = dealt.groupBy("router", "block").agg(F.collect_list(F.struct("vec_id", "v", "limit")).alias("q"))  # at most about 2 * block_rows
        packed = packed.select("router", "block", F.col("q.vec_id").alias("q_ids"), F.col("q.v").alias("qs"), F.col("q.limit").alias("limits"))
        met = groups.join(packed, "router").repartition("router", "part", "block").select("router", "pages", "q_ids", "qs", "limits")
        found = met.mapInPandas(search, "query_id long, vec_id long, score long")
        return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    near = cut(meet(asked.select("router", "vec_id", "v", F.lit(NONE).cast('long').alias("limit"))))

    def route(batches):
        """Routers other than a query's own whose covering ball can hold a
        vector that scores at least the query's limit."""
        for part in batches:
            q, limit = matrix(part["v"], width), part["limit"].to_numpy(float)
            limit[part["limit"].to_numpy() == NONE] = -np.inf
            reach = np.sqrt(np.maximum(0.0, part["norm"].to_numpy(float) + top - 2.0 * limit)) * (1 + MARGIN) + MARGIN * (1 + 4 * np.sqrt(top))
            away = distances(np.hstack([q, np.zeros((len(q), 1))]), roots.value)
            for router, radius in covered.items():
                live = (away[:, router] - radius * (1 + MARGIN) <= reach) & (part["router"].to_numpy() != router)
                if live.any():
                    yield part.loc[live, ["vec_id", "v", "limit"]].assign(router=router)

    kth = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    limited = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "norm", "router", F.coalesce("kth", F.lit(NONE).cast('long')).alias("limit"))
    far = meet(cut(limited.mapInPandas(route, "vec_id long, v array<long>, limit long, router int")))
    both = near.select("query_id", "vec_id", "score").unionByName(far.select("query_id", "vec_id", "score"))
    return both.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
