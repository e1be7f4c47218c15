"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

LEAST_COSINE = 0.93
#: Vectors that a cluster shard aims at, those of neighbouring clusters included, and from which on it is dealt out
#: in blocks. Labels of up to SHARD_MOST vectors have one shard, which needs no overlap.
SHARD, SHARD_MOST = 2_500, 4_000
#: Nearest clusters that a vector goes to at first.
OVERLAP = 2
#: Centroids are fitted on at most so many vectors with the least hash, so there are at most a twentieth as many.
SAMPLE = 20_000
#: ... that hold at most so many components in all, as the driver and a task's splitting have them in memory.
SAMPLE_VALUES = 8_000_000
#: Vectors of each shard whose links are found by brute force too, to measure the search.
SHARD_AUDITED = 64
#: Centroids of a large shard, how often shards are split again, numbers of the shards of a level, and vectors that one
#: task deals out.
CHILDREN, LEVELS, SPACE, DEALT = 128, 2, 1 << 40, 50_000
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 48, 1.2, 32
#: Range search also goes through vectors this much below the threshold.
SLACK = 0.06
AUDITED, LEAST_RECALL = 200, 0.98
#: Vectors of a shard that are checked at once.
AT_ONCE = 500


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(sample: dict[tuple, np.ndarray], counts: dict[tuple, int]) -> dict[tuple, np.ndarray]:
    """A few rounds of spherical k-means per (label, dimension), with so many centroids that a shard holds about
    SHARD vectors at the first overlap."""
    out = {}
    for key, x in sample.items():
        k = 1 if counts[key] <= SHARD_MOST else min(-(-OVERLAP * counts[key] // SHARD), max(1, len(x) // 20))
        out[key] = spherical_means(unit(x), k)
    return out


def spherical_means(x: np.ndarray, k: int) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(6 if k > 1 else 0):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        live = np.linalg.norm(sums, axis=1) > 0
        c[live] = unit(sums[live])
    return c


def split_further(nodes: DataFrame, overlap: int) -> DataFrame:
    """Nodes with shards above SHARD_MOST parted by further centroids, at most CHILDREN to a shard and level. A
    shard's centroids are fitted by one task on a bounded sample of it; its vectors are dealt to as many tasks as
    they need, each of which has the centroids. What LEVELS do not part stays large."""
    shard = ["label", "dim", "s"]
    for level in range(LEVELS):
        rows = nodes.select("label", "dim", "id", "x", F.explode("shards").alias("s"))
        big = rows.groupBy(*shard).agg(F.count("*").alias("n")).where(F.col("n") > SHARD_MOST)
        big = big.withColumn("k", F.least(F.lit(CHILDREN), F.ceil(F.col("n") * overlap / SHARD)).cast("int")).withColumn("deals", F.ceil(F.col("n") / DEALT).cast("int"))
        big = written(big, "vector-large")
        if not big.limit(1).count():
            break
        inside = rows.join(big, shard)
        some = inside.where(F.pmod(F.xxhash64("id", "s"), F.lit(1 << 20)) < F.col("k") * 20 * (1 << 20) / F.col("n")).select(*shard, "x", "k")

        def fitted(t: pa.Table) -> pa.Table:
            c = spherical_means(unit(_matrix(t.column("x"))), min(t.column("k")[0].as_py(), t.num_rows))
            return pa.table({**{k: t.column(k)[:1] for k in shard}, "c": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

        means = written(some.groupBy(*shard).applyInArrow(fitted, "label string, dim int, s long, c array<double>"), "vector-means")
        means = means.join(big.select(*shard, "deals"), shard).select(*shard, "c", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
        dealt = inside.select(*shard, "id", "x", F.pmod(F.xxhash64("id"), F.col("deals")).cast("int").alias("deal"))

        first = (level + 1) * SPACE

        def parted(left: pa.Table, right: pa.Table) -> pa.Table:
            s = left.column("s")[0].as_py() if left.num_rows else 0
            if not right.num_rows:  # nothing of it was in the sample
                return pa.table({"id": left.column("id"), "kids": pa.array([[s]] * left.num_rows, pa.list_(pa.int64()))})
            x = unit(_matrix(left.column("x"))) if left.num_rows else np.zeros((0, 1))
            c = np.array(right.column("c")[0].as_py()).reshape(-1, x.shape[1]) if left.num_rows else np.zeros((1, 1))
            near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :overlap]
            return pa.table({"id": left.column("id"), "kids": pa.array((first + s % SPACE * CHILDREN + near).tolist(), pa.list_(pa.int64()))})

        key = [*shard, "deal"]
        kids = dealt.groupBy(*key).cogroup(means.groupBy(*key)).applyInArrow(parted, "id long, kids array<long>")
        kids = kids.union(rows.join(big, shard, "left_anti").select("id", F.array("s").alias("kids")))
        kids = kids.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("kids"))).alias("shards"))
        nodes = written(nodes.drop("shards").join(kids, "id").select(*nodes.columns), "vector-shards")
    return nodes


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbours of each unit vector: of its nearest candidates, from the nearest out, those that no chosen one is
    nearer to by the factor alpha (in squared distance)."""
    n = len(x)
    k = min(candidates, n - 1)
    out: list[np.ndarray] = []
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        rows = np.arange(len(sims))
        sims[rows, a + rows] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(sims), 0), np.int64)
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        to = 2 - 2 * np.take_along_axis(sims, near, 1)
        among = 2 - 2 * np.einsum("ikd,ijd->ikj", x[near], x[near])
        alive, chosen = np.ones(near.shape, bool), np.zeros(near.shape, bool)
        for j in range(k):
            take = alive[:, j] & (chosen.sum(1) < degree)
            chosen[:, j] = take
            alive &= ~(take[:, None] & (alpha * among[:, j, :] <= to))
        out += [near[i][chosen[i]] for i in range(len(near))]
    return out


def adjacency(graph: list[np.ndarray]) -> np.ndarray:
    """One row of neighbours per node, filled up with -1."""
    edges = np.full((len(graph), max(1, max((len(g) for g in graph), default=0))), -1, np.int64)
    for i, g in enumerate(graph):
        edges[i, : len(g)] = g
    return edges


def entries(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Nodes from which every node can be reached: the medoid, then of the nodes that no entry reaches yet the most
    central, until none is left."""
    central = x @ x.sum(0)
    reached, out = np.zeros(len(x), bool), []
    for node in np.argsort(-central, kind="stable").tolist():
        if reached[node]:
            continue
        out.append(node)
        reached[node], at = True, np.array([node])
        while at.size:
            at = np.unique(edges[at])
            at = at[at >= 0]
            at = at[~reached[at]]
            reached[at] = True
    return np.array(out, np.int64)


def range_search(x: np.ndarray, edges: np.ndarray, starts: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with a cosine of at least ``least - SLACK``, all queries at once: a beam search from the
    entries (``starts``) and the query's own node, then expansion through every node in range."""
    n, q = len(x), len(queries)
    width = min(BEAM, n)
    own = np.arange(q)
    first = x[queries] @ x[starts].T
    first[starts[None, :] == queries[:, None]] = -2  # its own node is a start anyway
    seen = np.zeros((q, n), bool)
    seen[:, starts] = True
    seen[own, queries] = True
    r, c = np.nonzero(first >= least - SLACK)
    hits = [(own, queries), (r, starts[c])]
    beam = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -2.0)
    done = np.ones((q, width), bool)
    beam[:, 0], sims[:, 0], done[:, 0] = queries, 1.0, False
    top = np.argsort(-first, axis=1, kind="stable")[:, : width - 1]
    m = top.shape[1]
    beam[:, 1 : m + 1], sims[:, 1 : m + 1] = starts[top], np.take_along_axis(first, top, 1)
    done[:, 1 : m + 1] = sims[:, 1 : m + 1] < -1.5
    live = np.arange(q)
    while live.size:
        best = np.where(done[live], -3.0, sims[live]).argmax(1)
        open_ = ~done[live, best]
        live, best = live[open_], best[open_]
        if not live.size:
            break
        done[live, best] = True
        cand = edges[beam[live, best]]
        fresh = (cand >= 0) & ~seen[live[:, None], cand]
        rows, cols = np.nonzero(fresh)
        seen[live[rows], cand[rows, cols]] = True
        s = np.full(cand.shape, -2.0)
        for a in range(0, len(rows), 100_000):
            r, c = rows[a : a + 100_000], cols[a : a + 100_000]
            s[r, c] = np.einsum("ij,ij->i", x[queries[live[r]]], x[cand[r, c]])
        r, c = np.nonzero(s >= least - SLACK)
        hits.append((live[r], cand[r, c]))
        allb = np.concatenate([beam[live], np.where(fresh, cand, -1)], 1)
        alls = np.concatenate([sims[live], s], 1)
        alld = np.concatenate([done[live], ~fresh], 1)
        top = np.argsort(-alls, axis=1, kind="stable")[:, :width]
        beam[live], sims[live], done[live] = np.take_along_axis(allb, top, 1), np.take_along_axis(alls, top, 1), np.take_along_axis(alld, top, 1)
    found = [np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])]
    fq, fn = found
    while fq.size:
        nq, nn = [], []
        for a in range(0, len(fq), 20_000):
            cand = edges[fn[a : a + 20_000]]
            cq = np.repeat(fq[a : a + 20_000], cand.shape[1])
            cn = cand.ravel()
            ok = cn >= 0
            key = np.unique(cq[ok] * np.int64(n) + cn[ok])
            cq, cn = key // n, key % n
            ok = ~seen[cq, cn]
            cq, cn = cq[ok], cn[ok]
            seen[cq, cn] = True
            near = np.einsum("ij,ij->i", x[queries[cq]], x[cn]) >= least - SLACK
            nq.append(cq[near])
            nn.append(cn[near])
        fq, fn = np.concatenate(nq), np.concatenate(nn)
        found = [np.concatenate([found[0], fq]), np.concatenate([found[1], fn])]
    return found[0], found[1]


def joined(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Unite nodes p and q in ``root``, the smallest node of each node's component."""
    while True:
        a, b = root[p], root[q]
        low, high = np.minimum(a, b), np.maximum(a, b)
        some = low < high
        if not some.any():
            return
        np.minimum.at(root, high[some], low[some])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, label, x array<double>, dim of the rows that can link: an id, a label, and a vector that is not null or
    zero and holds no null or non-finite component."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("x", lambda e: e != 0), F.lit(False))).withColumn("dim", F.size("x"))


def links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, overlap: int = OVERLAP, exact: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges u, v; id, n_links; seen, lost, mended): a spanning forest of the links among equal labels, and each
    vector's number of links, both over one row per id; of several rows with an id the least vector counts. The last
    is one row: links of audited vectors, those of them that the search has lost, and tasks that compared all pairs.

    Equal vectors of a label become one, with its number of copies, so that a common vector costs one search.
    Vectors go to the shards of their ``overlap`` nearest centroids; a shard above SHARD_MOST is split by further
    centroids, and where that does not do it is dealt out in blocks, and each pair of blocks is a task, so no task
    holds more than two blocks and no pair is lost. Each task prunes its graph; a vector's adjacency lists are united;
    then each task searches for the range of its vectors from entries that reach all of its graph and from themselves,
    and verifies cosines in double precision on the vectors as given. A pair that shares several shards counts in the
    first of them. Only sums and forests leave a task, no pairs.

    The search is measured before anything mends it: SHARD_AUDITED vectors of each task are compared with all of
    its vectors, and what the search has lost of their links is counted. Only where it has lost more than
    LEAST_RECALL allows, that task compares all its pairs.

    With ``exact`` a label is one shard and each task compares all its pairs, so that no link is lost; its work grows
    with the square of a label."""
    v = usable(vectors, id_col, vec_col, label_col)
    v = v.groupBy("id", "label").agg(F.min("x").alias("x")).withColumn("dim", F.size("x"))
    v = written(v, "vectors")
    reps = written(v.groupBy("label", "dim", "x").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vector-reps")
    copies = v.join(reps.where("copies > 1").select("label", "x", F.col("id").alias("rep"), "copies"), ["label", "x"])
    sample: dict[tuple, list] = {}
    longest = reps.agg(F.max("dim")).first()[0] or 1
    for r in reps.select("label", "dim", "x").orderBy(F.xxhash64("x", "label")).limit(max(1, min(SAMPLE, SAMPLE_VALUES // longest))).collect():
        sample.setdefault((r.label, r.dim), []).append(r.x)
    spark = vectors.sparkSession
    # sizes of the labels in the sample only, as there may be any number of others
    met = spark.createDataFrame(list(sample), "label string, dim int")
    counts = {(r.label, r.dim): r.n for r in reps.join(F.broadcast(met), ["label", "dim"], "left_semi").groupBy("label", "dim").agg(F.count("*").alias("n")).collect()}
    fitted = {} if exact else centroids({k: np.array(x, np.float64) for k, x in sample.items()}, counts)
    base, at = {}, 0
    for k in sorted(fitted):
        base[k], at = at, at + len(fitted[k])
    sent = spark.sparkContext.broadcast((fitted, base, at))

    def assigned(batches):
        fitted, base, rest = sent.value
        for b in batches:
            # a label or dimension that the sample has not met goes to the last shard; shards are parted by both
            shards: list = [[rest]] * b.num_rows
            own: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if k in fitted:
                    own.setdefault(k, []).append(i)
            for k, at in own.items():
                near = np.argsort(-(_matrix(b.column(2).take(pa.array(at))) @ fitted[k].T), axis=1, kind="stable")[:, :overlap]
                for i, cells in zip(at, np.sort(base[k] + near, axis=1).tolist()):
                    shards[i] = cells
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.list_(pa.int64()))], names=[*b.schema.names, "shards"])

    nodes = written(reps.mapInArrow(assigned, "label string, dim int, x array<double>, id long, copies long, shards array<long>"), "vector-shards")
    if not exact:
        nodes = split_further(nodes, overlap)
    # a written table, so that Spark knows its size and broadcasts it only where it is small
    shard = ["label", "dim", "s"]
    big = written(nodes.select("label", "dim", F.explode("shards").alias("s")).groupBy(*shard).agg(F.ceil(F.count("*") / SHARD_MOST).cast("int").alias("m")).where("m > 1"), "vector-blocks")
    tasks = nodes.withColumn("s", F.explode("shards")).join(big, shard, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    tasks = tasks.withColumn("b", F.pmod(F.xxhash64("id"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    tasks = tasks.select("label", "dim", "s", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "x", "copies", "shards")
    key = ["label", "dim", "s", "i", "j"]

    def pruned(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t.column("id").to_numpy()
        graph = robust_prune(unit(_matrix(t.column("x"))))
        back = [list(g) for g in graph]
        for i, g in enumerate(graph):
            for j in g:
                if len(back[j]) < 2 * DEGREE:
                    back[j].append(i)
        return pa.table({"id": ids, "near": pa.array([ids[np.unique(np.array(g, np.int64))].tolist() for g in back], pa.list_(pa.int64()))})

    if exact:
        tasks = tasks.withColumn("near", F.lit(None).cast("array<long>"))
    else:
        flat = tasks.groupBy(*key).applyInArrow(pruned, "id long, near array<long>")
        tasks = tasks.join(flat.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "id")

    def searched(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, x, copies, block = t.column("id").to_numpy(), _matrix(t.column("x")), t.column("copies").to_numpy(), t.column("b").to_numpy()
        shards = [set(s) for s in t.column("shards").to_pylist()]
        s, i, j = (t.column(c)[0].as_py() for c in ("s", "i", "j"))
        graph = []
        for near in t.column("near").to_pylist():
            near = np.array(near or [], np.int64)
            p = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            graph.append(p[ids[p] == near])
        u = unit(x)
        size, k = len(ids), max(map(len, shards))
        n_links, root = np.zeros(size, np.int64), np.arange(size)
        common = np.array([sorted(x) + [-1 - y] * (k - len(x)) for x, y in zip(shards, range(size))], np.int64)

        def keys(q, n):
            """A pair may be met from either side; both sides count it once, so put it in one order."""
            ok = q != n
            return np.unique(np.minimum(q, n)[ok] * np.int64(size) + np.maximum(q, n)[ok])

        def all_pairs():
            for a in range(0, size, AT_ONCE):
                q, n = np.nonzero(u[a : a + AT_ONCE] @ u.T >= least - 1e-9)
                yield keys(q[q + a < n] + a, n[q + a < n])

        def audited(met):
            """The links of some vectors, by brute force, and how many of them the search has not met."""
            some = np.unique(np.linspace(0, size - 1, min(size, SHARD_AUDITED)).astype(np.int64))
            q, n = np.nonzero(u[some] @ u.T >= least - 1e-9)
            there = keys(some[q], n)
            there = there[exact_cosine(x[there // size], x[there % size]) >= least]
            return there, int((~np.isin(there, met, assume_unique=True)).sum())

        there, lost, mend = np.zeros(0, np.int64), 0, exact
        if not exact:
            edges = adjacency(graph)
            starts = entries(u, edges)
            met = [np.zeros(0, np.int64)]
            for a in range(0, size, 1000):
                q, n = range_search(u, edges, starts, np.arange(a, min(a + 1000, size)), least)
                met.append(keys(q + a, n))
            met = np.unique(np.concatenate(met))
            there, lost = audited(met)
            mend = lost > (1 - LEAST_RECALL) * len(there)
        for pairs in all_pairs() if mend else [np.union1d(met, there)]:
            for c in range(0, len(pairs), 200_000):
                p, q = pairs[c : c + 200_000] // size, pairs[c : c + 200_000] % size
                ok = exact_cosine(x[p], x[q]) >= least
                if i != j:
                    ok &= block[p] != block[q]
                if k > 1:
                    # the least shard that both are in
                    both = np.where(common[p][:, :, None] == common[q][:, None, :], common[p][:, :, None], np.iinfo(np.int64).max)
                    ok &= both.reshape(len(p), -1).min(1, initial=np.iinfo(np.int64).max) == s
                p, q = p[ok], q[ok]
                np.add.at(n_links, p, copies[q])
                np.add.at(n_links, q, copies[p])
                joined(root, p, q)
        first = np.arange(size) == 0
        return pa.table({"id": ids, "n": n_links, "root": ids[root], "seen": np.where(first, len(there), 0), "lost": np.where(first, lost, 0), "mended": np.where(first & mend, 1, 0)})

    found = written(tasks.groupBy(*key).applyInArrow(searched, "id long, n long, root long, seen long, lost long, mended long"), "vector-links")
    measured = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "lost", "mended")])
    edges = found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v"))
    rep_links = found.groupBy("id").agg(F.sum("n").alias("n"))
    own = v.select("id").join(copies.select("id", "rep", "copies"), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    n_links = own.join(rep_links.withColumnRenamed("id", "rep"), "rep").select("id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    edges = edges.union(copies.where("id <> rep").select("id", "rep"))
    return edges, n_links, measured


def audit(vectors: DataFrame, n_links: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, audited: int = AUDITED) -> float:
    """Links found over links there are, for ``audited`` distinct vectors with the least hash against all, by brute
    force: the lesser of the mean over vectors and the share of all their links. Links to exact copies, which need
    no search, do not count."""
    v = usable(vectors, id_col, vec_col, label_col).groupBy("id", "label").agg(F.min("x").alias("x"))
    some = v.groupBy("label", "x").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id")).limit(audited).collect()
    sent = v.sparkSession.sparkContext.broadcast([(r.id, r.label, np.array(r.x)) for r in some])

    def count(batches):
        total = {i: [0, 0] for i, _, _ in sent.value}
        for b in batches:
            ids, labels, xs = b.column(0).to_numpy(), np.array(b.column(1).to_pylist()), b.column(2)
            dims = np.array([len(x) for x in xs])
            for i, label, q in sent.value:
                own = np.flatnonzero((labels == label) & (dims == len(q)) & (ids != i))
                if own.size:
                    x = _matrix(xs.take(pa.array(own)))
                    same = (x == q).all(1)
                    total[i][0] += int(((x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)) >= least) & ~same).sum())
                    total[i][1] += int(same.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), *[pa.array([t[k] for t in total.values()], pa.int64()) for k in (0, 1)]], names=["id", "n", "same"])

    truth = v.mapInArrow(count, "id long, n long, same long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("same").alias("same")).where("n > 0")
    rows = truth.join(n_links, "id").select("n", F.greatest(F.lit(0), F.least("n", F.col("n_links") - F.col("same"))).alias("got")).collect()
    return min(sum(r.got for r in rows) / sum(r.n for r in rows), sum(r.got / r.n for r in rows) / len(rows)) if rows else 1.0


def dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, report: dict | None = None) -> DataFrame:
    """id, n_links, component_id, kept for every row: links at a cosine of ``least`` or more among rows of one
    label and dimension. Recall is audited against brute force, and the shards overlap more until it suffices; if
    the last overlap does not do, all pairs of a label are compared. ``report`` gets what was measured: the overlap,
    the recall of the whole, and of the search in its shards the recall before anything was mended, the links it is
    taken from, and the tasks that compared all pairs.

    Rows that can't link (a null id or label; a vector that is null, empty, zero, or holds a null or non-finite
    component) have no links and are their own component; repeated rows of an id are one vector and come back as
    often as they were given. An empty table gives an empty result."""
    report = {} if report is None else report
    for overlap in (OVERLAP, 2 * OVERLAP, 4 * OVERLAP, None):
        edges, n_links, measured = links(vectors, id_col, vec_col, label_col, least, overlap or 1, exact=overlap is None)
        n_links = written(n_links, "n-links")
        m = measured.first()
        report.update(overlap=overlap, recall=audit(vectors, n_links, id_col, vec_col, label_col, least), search_recall=1 - m.lost / m.seen if m.seen else None, links_seen=m.seen, tasks_mended=m.mended)
        if report["recall"] >= LEAST_RECALL:
            break
    else:
        raise RuntimeError(f"an exact search found {report['recall']:.3f} of the audited links")
    comp = connected_components(edges)
    v = vectors.select(F.col(id_col).cast("long").alias("id"))
    out = v.join(n_links, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))
