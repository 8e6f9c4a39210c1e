"""Exact top-k by inner product: paged M-trees, searched best-first.

Vectors are floored to integers. Inner product is no metric, so vectors x get one more component,
sqrt(R^2 - |x|^2) with R the longest length; then |q - x|^2 = |q|^2 + R^2 - 2 q.x, and the nearest are those
with the highest scores. Vectors are dealt to the nearest of some pivots (a sample: one for each ``PAGE`` vectors, between
``PIVOTS`` and ``MOST_PIVOTS``), and those of one pivot to pages of about ``PAGE`` vectors by a hash of the row, so a vector
that fills a third of the table is shared out too. Each page is an M-tree: nodes with a routing vector, its distance to the
parent's, and a covering radius.

A query first searches one page of its nearest pivot, which gives a bound; then every page whose pivot's
covering ball reaches within the bound. In a page, nodes are taken nearest first; an entry is skipped
without computing its distance if the stored parent distance proves by the triangle inequality that it can't
reach the bound. Bounds are widened by what rounding can add. Scores are exact integers: in floating point as long as a page's
sums stay below 2^53, else in Python's integers.

Queries are dealt to groups of about ``QUERIES``, and each page is copied to those groups that ask for it, so queries and pages meet in tasks of
bounded size, whichever pivot is popular; a page's queries are streamed past it. The stated query set grows with the table, so
on vectors without clusters, where bounds prune little, the work grows with its square; that is the searches' own nature.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do
rows with a null id; of vectors shorter than the longest the missing components count as zero; equal scores
go to the smaller id; every query row is answered for itself, and every other row is a candidate, those with the same id too
(so a repeated query id has its ranks once for each of its rows); a
table without queries or candidates gives no rows. Floored components beyond a long are the nearest long; scores are exact
whatever their size, and one beyond a long is ranked exactly and returned as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import bounded_fraction, hash_unit, materialise, table

K, SCALE, EVERY = 5, 256, 50
PIVOTS, MOST_PIVOTS, PAGE, QUERIES, FANOUT, LEAF = 64, 1024, 16_384, 16_384, 16, 256
#: ``place`` tells candidates of equal score and id apart; ``exact`` is the score in decimal digits.
FOUND = "query long, query_id long, vec_id long, place long, score long, exact string, least double, computed long, avoided long"
_FOUND_KIND = pa.schema([(n, pa.int64()) for n in ("query", "query_id", "vec_id", "place", "score")] + [("exact", pa.string()), ("least", pa.float64()), ("computed", pa.int64()), ("avoided", pa.int64())])
_LONG = 1 << 63


class Node:
    """A routing vector (by position), its covering radius and its entries: child nodes, or vectors if it's a leaf."""

    __slots__ = ("center", "radius", "members", "to_parent", "children", "child_at", "child_radius", "size")

    def __init__(self, center: int, radius: float, members: np.ndarray, to_parent: np.ndarray, children: list | None = None) -> None:
        self.center, self.radius, self.members, self.to_parent, self.children = center, radius, members, to_parent, children
        self.size = len(members)
        if children:
            self.size = sum(c.size for c in children)
            self.child_at = np.array([c.center for c in children])
            self.child_radius = np.array([c.radius for c in children])


class MTree:
    """One page. ids, rows: of each vector; points: integer vectors; longest: the largest squared length of all pages."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, points: np.ndarray, longest: float) -> None:
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.whole, self.longest = ids[order], rows[order], points[order], longest
        self.points = self.whole.astype(np.float64)
        self.extra = np.sqrt(np.maximum(longest - (self.points**2).sum(axis=1), 0))
        self.most = float(np.abs(self.points).max(initial=0))
        self.computed = self.avoided = 0
        self.root = self._build(0, np.arange(len(ids)), 0)

    def scores(self, members: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Exact inner products, in floating point where every partial sum is an integer below 2^53."""
        if exact:
            return self.points[members] @ query.astype(np.float64)
        return self.whole[members].astype(object) @ query.astype(object)

    def _distances(self, at: int, members: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[members] - self.points[at]) ** 2).sum(axis=1) + (self.extra[members] - self.extra[at]) ** 2)

    def _build(self, center: int, members: np.ndarray, depth: int) -> Node:
        d = self._distances(center, members)
        radius = float(d.max(initial=0.0))
        if len(members) <= LEAF or radius == 0:
            return Node(center, radius, members, d)
        seeds = members[np.linspace(0, len(members) - 1, FANOUT).astype(int)]
        nearest = np.argmin(np.stack([self._distances(int(s), members) for s in seeds]), axis=0)
        parts = [(int(s), members[nearest == k]) for k, s in enumerate(seeds)]
        parts = [(s, m) for s, m in parts if len(m)]
        if len(parts) == 1 or depth > 24:  # nothing to tell the vectors apart by
            return Node(center, radius, members, d)
        children = [self._build(s, m, depth + 1) for s, m in parts]
        return Node(center, radius, members[:0], self._distances(center, np.array([s for s, _ in parts])), children)

    def search(self, query: np.ndarray, own: int, bound: float | None, k: int = K) -> list[tuple[int, int, int]]:
        """The best (score, id, row) of this page, none that scores below ``bound``. ``query`` is an integer vector."""
        best: list[tuple[int, int, int]] = []  # a heap, worst first: (score, -id, -row)
        point = query.astype(np.float64)
        q2 = float(point @ point)
        small = self.most * float(np.abs(point).max(initial=0)) * max(1, len(point)) < 2**53
        slack = (q2 + self.longest) * 1e-14 * (len(point) + 4)  # of squared distances
        reach = lambda score: np.sqrt(max(0.0, q2 + self.longest - 2 * float(score)) + slack) + 2 * np.sqrt(slack)
        far = np.inf if bound is None else reach(bound)
        to_root = float(np.sqrt(max(0.0, q2 + self.longest - 2 * float(self.points[self.root.center] @ point))))
        self.computed += 1
        agenda = [(max(0.0, to_root - self.root.radius), 0, to_root, self.root)]
        tie = 0
        while agenda:
            least, _, to_center, node = heapq.heappop(agenda)
            if least > far:  # nothing that is left can reach the bound
                self.avoided += node.size + sum(x[3].size for x in agenda)
                break
            if node.children is None:
                near = node.members[np.abs(to_center - node.to_parent) <= far]
                self.avoided += len(node.members) - len(near)
                if not len(near):
                    continue
                score = self.scores(near, query, small)
                self.computed += len(near)
                least = best[0][0] if len(best) == k else -np.inf
                keep = np.flatnonzero(score >= (least if bound is None else max(least, bound)))
                for s, i, r in zip(score[keep].tolist(), self.ids[near[keep]].tolist(), self.rows[near[keep]].tolist(), strict=True):
                    if r == own:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (int(s), -i, -r))
                    elif (int(s), -i, -r) > best[0]:
                        heapq.heapreplace(best, (int(s), -i, -r))
                if len(best) == k:
                    far = min(far, reach(best[0][0]))
                continue
            open_ = np.flatnonzero(np.abs(to_center - node.to_parent) - node.child_radius <= far)
            self.avoided += node.size - sum(node.children[k].size for k in open_)
            if not len(open_):
                continue
            d = np.sqrt(np.maximum(q2 + self.longest - 2 * (self.points[node.child_at[open_]] @ query), 0))
            self.computed += len(open_)
            for c, dc in zip(open_.tolist(), d.tolist(), strict=True):
                child = node.children[c]
                if (low := max(0.0, dc - child.radius)) > far:
                    self.avoided += child.size
                    continue
                tie += 1
                heapq.heappush(agenda, (low, tie, dc, child))
        return [(s, -i, -r) for s, i, r in best]


def quantised(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, x array<long>, n2 double): floored vectors and about their squared lengths, of rows that take part."""
    x = F.col(vector).cast("array<double>")
    usable = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = df.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(SCALE)).cast("long")).alias("x"))
    return scaled.select("vec_id", "x", F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")).alias("n2"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, filled up with zeros."""
    values, ends = column.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy())]
    if len(values) == width * len(column):
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    for row, a, b in zip(out, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        row[: b - a] = values[a:b]
    return out


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other vectors for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    vectors = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", "n2"), "vectors")
    is_query = F.col("vec_id") % every == 0
    size, asked, longest, width = vectors.agg(F.count("*"), F.count_if(is_query), F.max("n2"), F.max(F.size("x"))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wanted = min(MOST_PIVOTS, max(PIVOTS, size // PAGE))
    share = bounded_fraction(wanted, size)
    sample = vectors.where(hash_unit(F.struct("vec_id", "row")) < share).orderBy(F.xxhash64("vec_id", "row"), "row").limit(2 * wanted).select("x").toArrow()["x"]
    sample = sample if len(sample) else vectors.orderBy("row").limit(1).select("x").toArrow()["x"]
    pivots = np.unique(_matrix(sample.combine_chunks(), width), axis=0).astype(np.float64)
    high = float(longest) * (1 + 1e-9)
    pivot_extra = np.sqrt(np.maximum(high - (pivots**2).sum(axis=1), 0))
    slack = lambda q2: (q2 + high) * 1e-14 * (width + 4)

    @F.arrow_udf("pivot int, distance double")
    def place(x: pa.Array) -> pa.Array:
        points = _matrix(x, width).astype(np.float64)
        n2 = (points**2).sum(axis=1)
        extra = np.sqrt(np.maximum(high - n2, 0))
        squares = n2[:, None] + (pivots**2).sum(axis=1) - 2 * points @ pivots.T + (extra[:, None] - pivot_extra) ** 2
        at = squares.argmin(axis=1)
        near = squares[np.arange(len(at)), at]
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.sqrt(np.maximum(near, 0) + slack(n2)))], ["pivot", "distance"])

    placed = materialise(vectors.select("row", "vec_id", "x", place("x").alias("p")).select("row", "vec_id", "x", "p.*"), "placed")
    found = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()  # at most a row for each pivot
    radius = {r["pivot"]: r["radius"] for r in found}
    pages = {r["pivot"]: -(-r["n"] // PAGE) for r in found}
    groups = -(-asked // QUERIES)
    of_pivot = F.element_at(F.create_map(*[F.lit(int(v)) for kv in pages.items() for v in kv]), F.col("pivot"))
    page, group = F.pmod(F.xxhash64("row"), of_pivot).cast("int"), F.pmod(F.xxhash64(F.lit(7), "row"), F.lit(groups)).cast("int")
    none = F.lit(None).cast("long")
    rows = placed.select("pivot", page.alias("page"), none.alias("query"), "row", "vec_id", "x", F.lit(None).cast("double").alias("bound"))

    @F.arrow_udf("array<int>")
    def reached(x: pa.Array, bound: pa.Array) -> pa.Array:
        """Pivots whose ball reaches within the bound; without any bound yet, the nearest one alone."""
        points = _matrix(x, width).astype(np.float64)
        q2 = (points**2).sum(axis=1)
        d = np.sqrt(np.maximum(q2[:, None] + high - 2 * points @ pivots.T, 0))
        used = np.array(sorted(radius))
        balls = np.array([radius[int(p)] for p in used])
        out = []
        for row, n2, b in zip(d, q2, bound.to_pylist(), strict=True):
            if b is None:
                out.append([int(used[row[used].argmin()])])
            else:
                far = np.sqrt(max(0.0, n2 + high - 2 * b) + slack(n2)) + 2 * np.sqrt(slack(n2))
                out.append(used[row[used] - balls <= far].tolist())
        return pa.array(out, pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a page's vectors, then its queries, in as many batches as they take."""
        now, held, tree = None, [], None
        for batch in batches:
            at = np.column_stack([batch.column(c).to_numpy() for c in ("pivot", "page", "group")])
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at)] if len(at) else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if now != (key := tuple(at[lo].tolist())):
                    now, held, tree = key, [], None
                part = batch.slice(lo, hi - lo)
                asks = part.column("query").is_valid()
                vectors, queries = part.filter(pc.invert(asks)), part.filter(asks)
                if vectors.num_rows:
                    held.append((vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy(), _matrix(vectors.column("x"), width)))
                if not queries.num_rows or not held:
                    continue
                tree = tree or MTree(*(np.concatenate(c) for c in zip(*held, strict=True)), high)
                out = []
                for q, i, x, b in zip(queries.column("query").to_pylist(), queries.column("vec_id").to_pylist(), _matrix(queries.column("x"), width), queries.column("bound").to_pylist(), strict=True):
                    tree.computed = tree.avoided = 0
                    for s, v, r in tree.search(x, q, b, k):
                        within = min(_LONG - 1, max(-_LONG, s))
                        out.append({"query": q, "query_id": i, "vec_id": v, "place": r, "score": within, "exact": str(s), "least": float(np.nextafter(float(s), -np.inf)), "computed": tree.computed, "avoided": tree.avoided})
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND_KIND)

    def searched(asking: DataFrame) -> DataFrame:
        wanted = asking.select("pivot", "page", "group").distinct()  # a page is copied to those groups alone that ask for it
        both = rows.join(wanted, ["pivot", "page"]).unionByName(asking.select("pivot", "page", "group", "query", none.alias("row"), F.col("query_id").alias("vec_id"), "x", "bound"))
        return both.repartition("pivot", "page", "group").sortWithinPartitions("pivot", "page", "group", F.col("query").asc_nulls_first()).mapInArrow(run, FOUND)

    asking = placed.where(is_query).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "x", F.col("row"), group.alias("group"))
    start = asking.withColumn("bound", F.lit(None).cast("double")).withColumn("pivot", reached("x", "bound")[0])
    first = searched(start.withColumn("page", page))
    # the k-th best score of one page bounds the answer; fewer than k found bound nothing
    bounds = first.groupBy("query").agg(F.count("*").alias("n"), F.min("least").alias("bound")).where(F.col("n") == k).select("query", "bound")
    bounded = asking.join(materialise(bounds, "bounds"), "query", "left").withColumn("bound", F.coalesce("bound", F.lit(-1e300)))
    wide = bounded.withColumn("pivot", F.explode(reached("x", "bound"))).withColumn("page", F.explode(F.sequence(F.lit(0), of_pivot - 1).cast("array<int>")))
    # digits rank as numbers do: by sign, then by length and digits (turned round below zero)
    low = F.col("exact").startswith("-")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc(F.when(low, -F.length("exact")).otherwise(F.length("exact"))), F.desc(F.when(~low, F.col("exact"))), F.when(low, F.col("exact")), "vec_id", "place")
    ranked = searched(wide).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every 50th."""
    return top_k(quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


OP7_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * {SCALE})::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.own AS place, c.vec_id, list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.own <> q.own)
SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id, place)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= {K}
"""
