"""Distances, neighbours and normalising of vectors (vec_id, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partita.operators import operator


def _doubled(d) -> str:
    return f"select vec_id, {d.map('embedding', 'x', 'cast(x as double)')} as e from {{vectors}}"


def _dot(d, a: str, b: str) -> str:
    if d.name == "duck":
        return f"list_dot_product({a}, {b})"
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (k, x) -> k + x)"


def _power(d, a: str, b: str, p: float) -> str:
    gaps = f"list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))" if d.name == "duck" else f"zip_with({a}, {b}, (x, y) -> abs(x - y))"
    if p == float("inf"):
        return f"list_max({gaps})" if d.name == "duck" else f"array_max({gaps})"
    total = f"list_sum(list_transform({gaps}, lambda g: power(g, {p})))" if d.name == "duck" else f"aggregate(transform({gaps}, g -> power(g, {p})), 0D, (k, x) -> k + x)"
    return f"power({total}, 1.0 / {p})"


@operator
def minkowski_to(d, like: int = 0, p: float = 3) -> str:
    """Distances of order p of all vectors to one."""
    return f"select v.vec_id, round({_power(d, 'v.e', 'q.e', p)}, 4) as dist from ({_doubled(d)}) v cross join (select e from ({_doubled(d)}) t where vec_id = {like}) q"


@operator
def minkowski_pairs(d, p: float = 3, every: int = 25) -> str:
    """Distances of a stated query set (numbers divisible by ``every``) to all larger numbers."""
    return f"select a.vec_id as a, b.vec_id as b, round({_power(d, 'a.e', 'b.e', p)}, 4) as dist from (select * from ({_doubled(d)}) t where vec_id % {every} = 0) a join ({_doubled(d)}) b on a.vec_id < b.vec_id"


@operator
def cosine_to(d, like: int = 0, distance: bool = False) -> str:
    """Cosine similarities (or distances) of all vectors to one."""
    sim = f"{_dot(d, 'v.e', 'q.e')} / (sqrt({_dot(d, 'v.e', 'v.e')}) * sqrt({_dot(d, 'q.e', 'q.e')}) + 1e-10)"
    return f"select v.vec_id, round({'1 - ' if distance else ''}{sim}, 4) as sim from ({_doubled(d)}) v cross join (select e from ({_doubled(d)}) t where vec_id = {like}) q"


@operator
def column_ranges(d, kind: str = "min_max", top: float = 1.0) -> str:
    """Columns brought to [0, 1] (min_max), to [-top, top] (range), or by quartile fences (robust); constant columns become 0."""
    x = f"select vec_id, {d.numbered('embedding', 'k', 'v')} from {{vectors}}"
    t = f"select vec_id, k, cast(v as double) as x from ({x}) u"
    if kind == "robust":
        low, high = f"{d.percentile('x', 0.25)}", f"{d.percentile('x', 0.75)}"
        fence = f"select k, {low} - 1.5 * ({high} - {low}) as lo, {high} + 1.5 * ({high} - {low}) as hi from ({t}) t group by k"
        cut = f"select t.vec_id, t.k, greatest(f.lo, least(f.hi, t.x)) as x from ({t}) t join ({fence}) f on t.k = f.k"
    else:
        cut = t
    body = "(x - min(x) over (partition by k)) / nullif(max(x) over (partition by k) - min(x) over (partition by k), 0)"
    body = f"coalesce({body}, 0)" if kind != "range" else f"coalesce({body} * {2 * top} - {top}, 0)"
    return f"select vec_id, k, round({body}, 4) as x from ({cut}) c"


@operator
def common_levels(d, n: int = 2) -> str:
    """The n commonest values, in tenths of its range, of each vector."""
    x = f"select vec_id, {d.explode}(embedding) as v from {{vectors}}"
    level = "cast(floor(10 * (v - min(v) over (partition by vec_id)) / nullif(max(v) over (partition by vec_id) - min(v) over (partition by vec_id), 0)) as int)"
    return f"select vec_id, level, n from (select vec_id, level, count(*) as n, row_number() over (partition by vec_id order by count(*) desc, level) as rk from (select vec_id, {level} as level from (select vec_id, cast(v as double) as v from ({x}) t) u) w group by vec_id, level) r where rk <= {n}"


# --- neighbours: blocks of vectors meet the others in a shuffle, never a cross join ------------


def _blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """(block, ids, data): rows vectors packed as float64 matrices."""

    def pack(batches):
        from pyspark import TaskContext

        first, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held += list(zip(batch["vec_id"].to_pylist(), batch["embedding"].to_pylist(), strict=True))
            while len(held) >= rows:
                yield out(first, held[:rows])
                held, first = held[rows:], first + 1
        if held:
            yield out(first, held)

    def out(block, part):
        data = np.array([v for _, v in part], dtype=np.float64)
        return pa.RecordBatch.from_pydict({"block": [block], "width": [data.shape[1]], "ids": [np.array([i for i, _ in part], dtype=np.int64).tobytes()], "data": [data.tobytes()]})

    return vectors.where(F.col("embedding").isNotNull()).select("vec_id", "embedding").mapInArrow(pack, "block long, width long, ids binary, data binary")


def _opened(ids: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, width)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 1, rows: int = 2048, eps: float = 1e-10) -> DataFrame:
    """(a, b, sim, rk): the k vectors of largest cosine similarity to each query, itself left out, ties by number.

    Each block of queries meets each block of vectors as one tile of a matrix product; a tile gives at
    most k rows for a query, and a window keeps the best of all tiles."""
    left = _blocks(queries, rows).select(*[F.col(c).alias(f"q_{c}") for c in ("block", "width", "ids", "data")])
    right = _blocks(vectors, rows)
    tiles = left.join(right, F.col("q_width") == F.col("width"))

    def multiply(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a_id, a = _opened(r["q_ids"], r["q_data"], r["q_width"])
                b_id, b = _opened(r["ids"], r["data"], r["width"])
                norm = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :] + eps
                sim = np.round(np.einsum("ij,kj->ik", a, b) / norm, 12)
                sim[a_id[:, None] == b_id[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(b_id, sim.shape), -sim), axis=1)[:, :k]
                best = np.take_along_axis(sim, order, axis=1)
                yield pa.RecordBatch.from_pydict({"a": np.repeat(a_id, order.shape[1]), "b": b_id[order].reshape(-1), "sim": best.reshape(-1)})

    found = tiles.mapInArrow(multiply, "a long, b long, sim double").where(F.col("sim") > float("-inf"))
    from pyspark.sql import Window

    ranked = found.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b")))
    return ranked.where(F.col("rk") <= k)


def spanning_tree(vectors: DataFrame, rows: int = 8192, tile: int = 2048, last: int = 1 << 18) -> DataFrame:
    """(a, b, dist): the tree of least cosine distances that joins all vectors, of equal ones the edge of least numbers.

    All pairs are compared once: each two blocks of vectors meet in one row of a shuffle, and only the least forest
    of their edges leaves the task, since an edge that is not in it is in no least tree.  Boruvka's rounds then join
    those edges: every component takes its shortest edge to another, and components at least halve in number.  Rounds
    go over frames until at most ``last`` edges are left, which one task then joins."""
    from partita.operators.iterate import checkpointed

    spark = vectors.sparkSession
    edges = checkpointed(_edges(vectors, rows, tile))
    tree = None

    def finish(batches):
        parts = [pa.Table.from_batches([b]) for b in batches]
        if parts:
            a, b, dist = _forest(*(pa.concat_tables(parts)[n].to_numpy() for n in ("a", "b", "dist", "u", "v")))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "dist": dist})

    while (n := edges.count()) > last:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b", "dist"))
        best = checkpointed(ends.groupBy("u").agg(F.min(F.struct("dist", "a", "b", "v")).alias("m")).select("u", "m.*"))
        chosen = best.select("a", "b", "dist").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        roots = _roots(best.select("u", "v"))
        of = lambda c: roots.select(F.col("comp").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        edges = checkpointed(edges.join(of("u"), "u").join(of("v"), "v").where("u_root <> v_root").select(F.col("u_root").alias("u"), F.col("v_root").alias("v"), "a", "b", "dist"))
    if n:
        chosen = edges.repartition(1).mapInArrow(finish, "a long, b long, dist double")
        tree = chosen if tree is None else tree.unionByName(chosen)
    empty = spark.createDataFrame([], "a long, b long, dist double")
    return empty if tree is None else tree.distinct()


def _least(dist: np.ndarray, a_id: np.ndarray, b_id: np.ndarray) -> np.ndarray:
    """The place of each row's least distance; of equal ones that of the least edge.  Only rows with equal ones are sorted."""
    at = dist.argmin(axis=1)
    least = dist[np.arange(len(at)), at]
    tied = np.flatnonzero(((dist == least[:, None]).sum(axis=1) > 1) & np.isfinite(least))
    if tied.size:
        low, high = np.minimum(a_id[tied, None], b_id[None, :]), np.maximum(a_id[tied, None], b_id[None, :])
        at[tied] = np.lexsort((high, low, dist[tied]), axis=1)[:, 0]
    return at


def _edges(vectors: DataFrame, rows: int, tile: int) -> DataFrame:
    """(u, v, a, b, dist) with a < b: the least forest of each two blocks of about ``rows`` vectors of one width."""
    from partita.operators.iterate import checkpointed

    spark = vectors.sparkSession
    given = vectors.where("embedding is not null and vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("width"), "embedding")
    widths = given.groupBy("width").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    dealt = given.join(F.broadcast(widths), "width").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    blocks = checkpointed(dealt.groupBy("width", "parts", "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("r")).select("width", "parts", "block", F.col("r.vec_id").alias("ids"), F.flatten("r.embedding").alias("data")))
    left = blocks.select("width", F.col("block").alias("i"), F.explode(F.expr("sequence(block, parts - 1)")).alias("j"), F.col("ids").alias("a_ids"), F.col("data").alias("a_data"))
    right = blocks.select("width", F.explode(F.expr("sequence(0, block)")).alias("i"), F.col("block").alias("j"), F.col("ids").alias("b_ids"), F.col("data").alias("b_data"))
    tasks = min(1024, blocks.agg(F.sum((F.col("parts") + 1) / 2)).first()[0] or 1)

    def forests(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch[name][k] for name in batch.schema.names}
                width = row["width"].as_py()
                a_id, b_id = (np.array(row[n].values).astype(np.int64) for n in ("a_ids", "b_ids"))
                a, b = (np.array(row[n].values.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(i), width) for n, i in (("a_data", a_id), ("b_data", b_id)))
                same, found = row["i"].as_py() == row["j"].as_py(), []
                for p in range(0, len(a_id), tile):
                    for q in range(p if same else 0, len(b_id), tile):
                        s, t = slice(p, p + tile), slice(q, q + tile)
                        found.append(_bipartite(_distances(a[s], b[t], a_id[s], b_id[t]), a_id[s], b_id[t]))
                x, y, dist = _forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
                yield pa.RecordBatch.from_pydict({"u": x, "v": y, "a": x, "b": y, "dist": dist})

    keys = ["width", "i", "j"]
    return left.repartition(int(tasks), *keys).join(right.repartition(int(tasks), *keys), keys).mapInArrow(forests, "u long, v long, a long, b long, dist double")


def _distances(a: np.ndarray, b: np.ndarray, a_id: np.ndarray, b_id: np.ndarray) -> np.ndarray:
    import os

    # BLAS only where it has no threads, which may hang in a process that has forked
    dist = a @ b.T if os.environ.get("OMP_NUM_THREADS") == "1" else np.einsum("ij,kj->ik", a, b)
    dist /= np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :] + 1e-10
    np.round(np.subtract(1, dist, out=dist), 9, out=dist)
    dist[np.isnan(dist)] = np.inf
    _, p, q = np.intersect1d(a_id, b_id, return_indices=True) if len(np.unique(a_id)) == len(a_id) and len(np.unique(b_id)) == len(b_id) else (None, *np.nonzero(a_id[:, None] == b_id[None, :]))
    dist[p, q] = np.inf
    return dist


def _bipartite(dist: np.ndarray, a_id: np.ndarray, b_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, dist) with a < b: the least forest of a tile's edges in the order of (dist, a, b), by Prim's steps.

    Of a vertex's equal edges that to the least number is the least edge."""
    m, across, ids = len(a_id), np.ascontiguousarray(dist.T), np.concatenate([a_id, b_id])
    n = len(ids)
    best, key = np.full(n, np.inf), np.full(n, np.inf)  # of vertices in the forest: -inf, inf
    partner = np.full(n, np.iinfo(np.int64).max)
    waiting, out = np.ones(n, dtype=bool), []
    for _ in range(n):
        at = int(key.argmin())
        least = key[at]
        if least == np.inf:
            at = int(waiting.argmax())
        else:
            tied = np.flatnonzero(key == least)
            if len(tied) > 1:
                mine, other = ids[tied], partner[tied]
                at = int(tied[np.lexsort((np.maximum(mine, other), np.minimum(mine, other)))[0]])
            out.append((ids[at], partner[at], least))
        waiting[at], best[at], key[at] = False, -np.inf, np.inf
        side, far = (slice(m, n), dist[at]) if at < m else (slice(0, m), across[at - m])
        now = best[side]
        better = np.flatnonzero((far < now) | ((far == now) & (ids[at] < partner[side]) & (far < np.inf)))
        if len(better):
            value = far[better]
            now[better] = value
            key[side][better] = value
            partner[side][better] = ids[at]
    x = np.array([r[0] for r in out], dtype=np.int64)
    y = np.array([r[1] for r in out], dtype=np.int64)
    return np.minimum(x, y), np.maximum(x, y), np.array([r[2] for r in out], dtype=np.float64)


def _forest(a: np.ndarray, b: np.ndarray, dist: np.ndarray, u: np.ndarray | None = None, v: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least forest of edges in the order of (dist, a, b), by Boruvka's rounds over arrays; u and v are the
    components that an edge joins, where they aren't its ends."""
    by = np.lexsort((b, a, dist))
    u, v = (a, b) if u is None else (u, v)
    a, b, dist = a[by], b[by], dist[by]
    ids, ends = np.unique(np.concatenate([u[by], v[by]]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    kept, left = np.zeros(len(a), dtype=bool), np.arange(len(a))
    while len(left):
        p, q = np.concatenate([u[left], v[left]]), np.concatenate([v[left], u[left]])
        order = np.argsort(np.concatenate([left, left]), kind="stable")
        comp, first = np.unique(p[order], return_index=True)
        edge = np.concatenate([left, left])[order][first]
        kept[edge] = True
        root = np.arange(len(ids))
        root[comp] = q[order][first]
        mutual = comp[(root[root[comp]] == comp) & (comp < root[comp])]
        root[mutual] = mutual
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        left = left[u[left] != v[left]]
    return a[kept], b[kept], dist[kept]


def _roots(links: DataFrame) -> DataFrame:
    """(comp, root): each component points to the one that its shortest edge leads to; of two that point at each
    other the smaller is the root; pointers are doubled until they stand still."""
    from partita.operators.iterate import checkpointed

    back = links.select(F.col("u").alias("v"), F.col("v").alias("w"))
    now = checkpointed(links.join(back, "v", "left").select(F.col("u").alias("comp"), F.when((F.col("w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("root")))
    while True:
        jump = now.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        step = checkpointed(now.join(jump, "root", "left").select("comp", F.coalesce("next", "root").alias("next"), "root"))
        now = step.select("comp", F.col("next").alias("root"))
        if not step.where("root <> next").limit(1).count():
            return now


def tree_path(tree: DataFrame, start: int, end: int) -> list[int]:
    """The path between two nodes of a tree, from rounds that widen from both; only the path is brought to the driver."""
    from partita.operators.iterate import checkpointed

    edges = checkpointed(tree.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tree.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    seen = checkpointed(edges.sparkSession.createDataFrame([(start, None)], "node long, parent long"))
    frontier = seen
    while not seen.where(F.col("node") == end).limit(1).count():
        frontier = checkpointed(frontier.join(edges, frontier["node"] == edges["u"]).select(F.col("v").alias("node"), F.col("u").alias("parent")).join(seen.select("node"), "node", "left_anti").dropDuplicates(["node"]))
        if not frontier.limit(1).count():
            return []
        seen = checkpointed(seen.unionByName(frontier))
    path = [end]
    while path[-1] != start:
        path.append(seen.where(F.col("node") == path[-1]).first()["parent"])
    return path[::-1]


def pca(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(vec_id, scores): centred principal components, each with its largest loading positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    mean = v.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    model = PCA(k=k, inputCol="v", outputCol="p").fit(v)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    shift = (mean[None, :] @ load)[0]
    scores = [((vector_to_array("p")[j] - F.lit(float(shift[j]))) * float(sign[j])).alias(f"p{j + 1}") for j in range(k)]
    return model.transform(v).select("vec_id", *[F.round(s, 5).alias(f"p{j + 1}") for j, s in enumerate(scores)])
