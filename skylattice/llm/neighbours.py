"""Operator 6: approximate nearest neighbours by multiprobe p-stable hashing.

Each table hashes a vector by the cells of a few Gaussian projections. A query visits its own cell and then perturbed
ones in the order of their estimated success (the squared distances to the walls crossed), and all candidates of all
tables are reranked by exact inner products. Largest inner product becomes nearest in Euclidean distance by one more
coordinate. Equal vectors are one node, so copies never crowd a bucket; a bucket that is crowded all the same is dealt, with
its queries, over a grid of shards. How many hashes a table has and how wide their cells are is chosen by the number of
rows and by the distances in a sample, so that buckets do not grow with the table.
"""

from __future__ import annotations

import heapq
import itertools
import logging
import math
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TABLES = 8
#: Hashes of a table and cell widths to choose from.
CHOICES = tuple(itertools.product((2, 3, 4, 6, 8, 10, 12), (1.0, 2.0)))
#: Hashes of a table that so many nodes are worth, at most: (nodes, hashes).
FINER = ((0, 4), (20_000, 8), (1_000_000, 12))
#: Queries that the number of probes is fitted on, at most, and groups of them by density.
SAMPLE_QUERIES, STRATA = 256, 8
#: Nodes that are scored in about the time that one probe takes to be made, sent and looked up.
WORTH = 600
#: Components of the queries that are searched exactly in one pass over the nodes.
BLOCK = 1 << 19
#: Rows of an index shard, and queries of one, about; where one bucket has more, a grid of shards shares them.
SHARD, ASKED = 8192, 16384
#: Nodes whose distances to the sampled queries tell how large buckets are, at most.
SAMPLE_NODES = 4096


@cache
def projections(size: int, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(size * 1_000_003 + tables * 1009 + hashes)
    return rng.standard_normal((size + 1, tables * hashes)), rng.uniform(0, width, tables * hashes), rng.integers(1, 1 << 62, hashes, dtype=np.int64) | 1


def places(vectors: np.ndarray, scale: float, query: bool, tables: int, hashes: int, width: float) -> np.ndarray:
    """Positions along the projections in cell widths, (rows, tables, hashes). Index vectors are scaled into the unit ball
    and lifted onto its sphere; queries are scaled to length one."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    if query:
        lifted = np.hstack([vectors / lengths, np.zeros_like(lengths)])
    else:
        lifted = np.hstack([vectors / scale, np.sqrt(np.maximum(0, 1 - (lengths / scale) ** 2))])
    a, b, _ = projections(vectors.shape[1], tables, hashes, width)
    return ((lifted @ a + b) / width).reshape(len(vectors), tables, hashes)


def keys_of(cells: np.ndarray, table: np.ndarray | int, size: int, hashes: int, tables: int, width: float) -> np.ndarray:
    """One 64-bit key for each row of cells of a table."""
    factors = projections(size, tables, hashes, width)[2]
    with np.errstate(over="ignore"):
        return (cells.astype(np.int64) * factors).sum(axis=-1) * np.int64(6364136223846793005) + np.int64(1442695040888963407) * (np.int64(1) + table)


def probe_sequence(fraction: np.ndarray, count: int) -> list[np.ndarray]:
    """The first ``count`` perturbations (-1, 0 or 1 for each hash) by growing sum of squared distances to the walls that
    are crossed; the first perturbs nothing."""
    hashes = len(fraction)
    walls = sorted([(f * f, i, -1) for i, f in enumerate(fraction.tolist())] + [((1 - f) ** 2, i, 1) for i, f in enumerate(fraction.tolist())])
    out = [np.zeros(hashes, np.int64)]
    heap: list[tuple[float, tuple[int, ...]]] = [(walls[0][0], (0,))]
    while heap and len(out) < count:
        cost, chosen = heapq.heappop(heap)
        axes = [walls[j][1] for j in chosen]
        if len(set(axes)) == len(axes):
            move = np.zeros(hashes, np.int64)
            for j in chosen:
                move[walls[j][1]] = walls[j][2]
            out.append(move)
        last = chosen[-1]
        if last + 1 < len(walls):
            heapq.heappush(heap, (cost - walls[last][0] + walls[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + walls[last + 1][0], (*chosen, last + 1)))
    return out


def cheaper(fraction: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """How many perturbations (-1, 0 or 1 for each hash) cross walls at less than each ``cost``. Those of the first half of
    the hashes and of the second are summed up apart; pairs of them are counted by search."""
    halves = []
    for f in np.array_split(fraction, 2):
        sums = np.zeros(1)
        for x in f.tolist():
            sums = np.concatenate([sums, sums + x * x, sums + (1 - x) ** 2])
        halves.append(np.sort(sums))
    return np.searchsorted(halves[1], cost[:, None] - halves[0][None, :]).sum(axis=1)


def probe_ranks(query: np.ndarray, found: np.ndarray, scale: float, *, most: int, tables: int, hashes: int, width: float) -> np.ndarray:
    """The probe that meets each of the vectors ``found`` first in any table; ``most + 1`` if none does."""
    at = places(query[None], scale, True, tables, hashes, width)[0]
    cells = np.floor(at)
    gap = np.floor(places(found, scale, False, tables, hashes, width)) - cells
    fraction = at - cells
    cost = ((gap < 0) * fraction**2 + (gap > 0) * (1 - fraction) ** 2).sum(axis=2)
    rank = np.stack([cheaper(fraction[t], cost[:, t] - 1e-12) + 1 for t in range(tables)], axis=1)
    return np.minimum(np.where(np.abs(gap).max(axis=2) <= 1, rank, most + 1).min(axis=1), most + 1)


def share_a_cell(distance: np.ndarray, width: float) -> np.ndarray:
    """Probability that one hash puts two points at each distance into one cell."""
    r = width / np.maximum(distance, 1e-9)
    tail = np.array([math.erfc(x / math.sqrt(2)) for x in r.ravel().tolist()]).reshape(r.shape)
    return 1 - tail - math.sqrt(2 / math.pi) / r * (1 - np.exp(-(r**2) / 2))


def fit_probes(queries: np.ndarray, found: list[np.ndarray], scale: float, *, recall: float = 0.96, most: int = 1024, tables: int, hashes: int, width: float) -> int | None:
    """Probes a table that find ``recall`` of the nearest vectors ``found`` for the ``queries``; none, if ``most`` do not.

    Queries are put into groups by the score of their last answer, over their length, and every group must reach ``recall``.
    """
    some = [i for i in range(len(queries)) if len(found[i])]
    if not some:
        return 1
    most = min(most, 3**hashes)
    ranks = {i: probe_ranks(queries[i], found[i], scale, most=most, tables=tables, hashes=hashes, width=width) for i in some}
    last = {i: float((found[i] @ queries[i]).min() / np.linalg.norm(queries[i])) for i in some}
    some.sort(key=lambda i: last[i])
    groups = np.array_split(np.array(some), min(STRATA, len(some)))
    need = max(int(np.quantile(np.concatenate([ranks[i] for i in group.tolist()]), recall, method="higher")) for group in groups)
    return need if need <= most else None


def fit(queries: np.ndarray, found: list[np.ndarray], others: np.ndarray, scale: float, nodes: int, *, tables: int, hashes: int | None, width: float | None) -> tuple[int, int, float, float]:
    """Probes, hashes and width (where they are not given) that serve all of the sample's queries at the least cost, and the
    share of the nodes that a query is then held against at most. The cost, in nodes scored, is that of making, sending and
    looking up the probes and of scoring what is in their buckets, as many of all ``nodes`` as of the sample ``others``."""
    lengths = np.linalg.norm(queries, axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (queries @ others.T) / (lengths[:, None] * scale))) if len(others) else np.zeros((len(queries), 0))
    finest = max(m for least, m in FINER if nodes >= least)
    choices = sorted({(hashes or m, width or w) for m, w in CHOICES if m <= finest})
    one_hash = {w: share_a_cell(apart, w) for w in {w for _, w in choices}}
    best: tuple | None = None
    for m, w in choices:
        if (probes := fit_probes(queries, found, scale, tables=tables, hashes=m, width=w)) is None:
            continue
        met = np.minimum(1, probes * (one_hash[w] ** m).mean(axis=1)) if apart.shape[1] else np.zeros(len(queries))
        cost = tables * (probes * WORTH + met.mean() * nodes)
        if best is None or cost < best[0]:
            best = (cost, probes, m, w, float(met.mean()))
    log = logging.getLogger(__name__)
    if best is None:
        m, w = choices[0]
        best = (0.0, 3**m if m < 7 else 1024, m, w, 1.0)
        log.warning("No choice of hashes reaches the recall on the sample; %d hashes of width %g are taken with all their probes", m, w)
    _, probes, m, w, share = best
    log.info("%d hashes of width %g, %d probes a table, %.3g of the nodes in them", m, w, probes, share)
    if share > 0.25:
        log.warning("Vectors have so little structure that probes meet %.2g of all nodes: the work grows as queries times rows", share)
    return probes, m, w, share


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The batch's nodes by length of vector."""
    sizes = np.diff(batch["vector"].offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        own = batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield own, _vectors(own["vector"])


def best_pairs(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``vectors`` are among each query's ``k`` best, with what ties them but for rounding."""
    rough = queries @ vectors.T
    if len(vectors) <= k:
        return np.nonzero(np.ones_like(rough, bool))
    low = np.partition(rough, len(vectors) - k, axis=1)[:, len(vectors) - k]
    slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max()
    return np.nonzero(rough >= (low - slack)[:, None])


def best_of(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best distinct nodes of each query among ``(query, node, score)``, ties to the smaller node."""
    who, what, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-score, what, who))
    who, what, score = who[order], what[order], score[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (what[1:] != what[:-1])
    who, what, score = who[new], what[new], score[new]
    order = np.lexsort((what, -score, who))
    who, what, score = who[order], what[order], score[order]
    kept = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[kept], what[kept], score[kept]


def exactly(nodes: DataFrame, asking: pa.Table, k: int) -> DataFrame:
    """``query, node, score``: each task's best ``k + 1`` nodes for each row of ``asking`` (node, vector; all of one
    length and few, as they are sent to every task), by inner products with all nodes of that length."""
    names, queries = asking["node"].combine_chunks(), _vectors(asking["vector"].combine_chunks())
    kind = nodes.schema["node"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, what, score = np.zeros(0, np.int64), None, np.zeros(0)
        least = np.full(len(queries), -np.inf)
        slack = 1e-9 * np.linalg.norm(queries, axis=1)
        for batch in batches:
            for own, vectors in _groups(batch):
                if vectors.shape[1] != queries.shape[1]:
                    continue
                ids = own["node"].to_numpy(zero_copy_only=False)
                for a in range(0, len(vectors), 1024):
                    some = vectors[a : a + 1024]
                    parts = []
                    for b in range(0, len(queries), 1024):
                        rough = queries[b : b + 1024] @ some.T
                        low = least[b : b + 1024]
                        if len(some) > k and np.isinf(low).any():
                            low = np.maximum(low, np.partition(rough, len(some) - k - 1, axis=1)[:, len(some) - k - 1])
                        q, v = np.nonzero(rough >= (low - slack[b : b + 1024] * np.linalg.norm(some, axis=1).max())[:, None])
                        parts.append((q + b, v))
                    q, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                    if not len(q):
                        continue
                    who = np.concatenate([who, q])
                    what = ids[a + v] if what is None else np.concatenate([what, ids[a + v]])
                    score = np.concatenate([score, np.einsum("ij,ij->i", some[v], queries[q])])
                    order = np.lexsort((what, -score, who))
                    place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
                    order, place = order[place <= k], place[place <= k]
                    who, what, score = who[order], what[order], score[order]
                    least[who[place == k]] = score[place == k]
        if what is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(who)), pa.array(what, names.type), pa.array(score)], ["query", "node", "score"])

    return nodes.select("node", "vector").mapInArrow(search, f"query {kind}, node {kind}, score double")


def nearest(df: DataFrame, *, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, hashes: int | None = None, width: float | None = None, probes: int | None = None) -> DataFrame:
    """``query_id, rank, id_col, score``: the ``k`` nearest rows found for each row that the SQL condition ``queries`` picks.

    Score is the inner product in double precision; ties go to the smaller id; a query is not its own neighbour. Vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id; only
    vectors of one length are compared with one another. Repeated rows with one id count once. All rows are indexed. Hashes,
    width and probes (where they are not given) are fitted on the true neighbours of at most ``SAMPLE_QUERIES`` queries, so
    that each group of them by density reaches the recall at the least cost; every query is answered by its probes. Only
    queries left with fewer than ``k`` answers though there are more rows, and those of a length that nothing was fitted
    on, are searched exactly. An empty table gives an empty result.
    Other columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, bad) & F.exists(vector_col, lambda x: x != 0))
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.expr(f"coalesce({queries}, false)").alias("asks")).dropDuplicates(["id"])
    rows = rows.withColumn("hash", F.xxhash64("vector"))
    # Of equal vectors no more than the k + 1 smallest ids can be in any answer.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("hash", "vector").orderBy("id"))).where(F.col("n") <= k + 1)
    nodes = materialise(first.groupBy("hash", "vector").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")), "nodes")
    asked = rows.where("asks").select("id", "hash", "vector").join(nodes.select("hash", "vector", "node"), ["hash", "vector"]).select(F.col("id").alias("query_id"), "node")
    asked = materialise(asked, "asked")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n, scale = nodes.agg(F.count("*"), F.max(norm)).first()
    scale = float(scale or 1.0)
    asking = nodes.select("node", "vector").join(asked.select("node").distinct(), "node", "left_semi")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    fitted = None
    if probes is None:
        probes = 1
        common = asking.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
        if common:
            fitted = common["size"]
            sample = asking.where(F.size("vector") == fitted).orderBy(F.xxhash64("node", F.lit(1)), "node").limit(SAMPLE_QUERIES).toArrow()
            known = exactly(nodes, sample, k).where(F.col("query") != F.col("node")).withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k)
            known = known.join(nodes.select("node", "vector"), "node").select("query", "vector").toArrow()
            known_of, known_vectors = np.array(known["query"].to_pylist(), object), _vectors(known["vector"].combine_chunks()) if known.num_rows else None
            found = [known_vectors[np.flatnonzero(known_of == q)] if known.num_rows else np.zeros((0, fitted)) for q in sample["node"].to_pylist()]
            others = nodes.where(F.size("vector") == fitted).orderBy(F.xxhash64("node", F.lit(3)), "node").limit(max(256, min(SAMPLE_NODES, (1 << 23) // fitted))).select("vector").toArrow()
            probes, hashes, width, _ = fit(_vectors(sample["vector"].combine_chunks()), found, _vectors(others["vector"].combine_chunks()), scale, n, tables=tables, hashes=hashes, width=width)
    hashes, width = hashes or 8, width or 2.0

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, vectors in _groups(batch):
                cells = np.floor(places(vectors, scale, False, tables, hashes, width))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(keys_of(cells[:, t], t, vectors.shape[1], hashes, tables, width)), own["node"], own["vector"]], ["key", "node", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, vectors in _groups(batch):
                at = places(vectors, scale, True, tables, hashes, width)
                cells = np.floor(at)
                for i in range(0, len(vectors), 256):
                    some = range(i, min(i + 256, len(vectors)))
                    keys = [keys_of(cells[q, t] + np.array(probe_sequence(at[q, t] - cells[q, t], probes)), t, vectors.shape[1], hashes, tables, width) for q in some for t in range(tables)]
                    who = own["node"].take(pa.array(np.repeat(np.repeat(np.array(some), tables), [len(x) for x in keys])))
                    yield pa.RecordBatch.from_arrays([who, pa.array(np.concatenate(keys))], ["query", "key"])

    vector_kind = nodes.schema["vector"].dataType.simpleString()
    shards = max(1, n * tables // SHARD)
    entries = nodes.select("node", "vector").mapInArrow(index, f"key long, node {kind}, vector {vector_kind}")
    crowded = materialise(entries.groupBy("key").count().where(F.col("count") > SHARD).select("key", F.ceil(F.col("count") / SHARD).cast("int").alias("salts")), "crowded")
    probing = asking.mapInArrow(ask, f"query {kind}, key long")
    asked_of = probing.join(crowded.select("key"), "key").groupBy("key").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts"))
    crowded = materialise(crowded.join(asked_of, "key"), "grid")
    # Entries of a crowded bucket are dealt over its rows of shards and sent to each column, queries the other way round.
    shard = F.pmod(F.xxhash64("key", "salt", "part"), F.lit(shards)).cast("int")
    salts, parts = F.coalesce("salts", F.lit(1)), F.coalesce("parts", F.lit(1))
    entries = entries.join(crowded, "key", "left").withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(shard.alias("shard"), "key", "node", "vector")
    probing = probing.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64("query"), parts).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    probing = probing.select("query", "key", shard.alias("shard")).groupBy("shard", "query").agg(F.collect_list("key").alias("keys"))
    probing = probing.join(asking.select(F.col("node").alias("query"), "vector"), "query")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        """Exact scores of each query's candidates in a shard, of which the best k + 1 stay."""
        schema = pa.schema([("query", left.schema.field("node").type), ("node", left.schema.field("node").type), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        key = left["key"].to_numpy()
        order = np.argsort(key, kind="stable")
        vector, theirs = left["vector"].combine_chunks(), right["vector"].combine_chunks()
        sizes, own_sizes = np.diff(vector.offsets.to_numpy())[order], np.diff(theirs.offsets.to_numpy())
        asks = right["keys"].combine_chunks()
        probe, owner = asks.flatten().to_numpy(), np.repeat(np.arange(len(asks)), np.diff(asks.offsets.to_numpy()))
        found: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for size in np.unique(own_sizes).tolist():
            fits, of_size = order[sizes == size], own_sizes[owner] == size
            if not len(fits):
                continue
            matrix, own_key, own_node = _vectors(vector.take(pa.array(fits))), key[fits], left["node"].to_numpy()[fits]
            line = np.full(len(asks), -1)
            line[own_sizes == size] = np.arange((own_sizes == size).sum())
            asking_of = _vectors(theirs.take(pa.array(np.flatnonzero(own_sizes == size))))
            by_key = np.argsort(probe[of_size], kind="stable")
            probes_of, owners_of = probe[of_size][by_key], owner[of_size][by_key]
            known, first = np.unique(probes_of, return_index=True)
            last = np.append(first[1:], len(probes_of))
            low, high = np.searchsorted(own_key, known, "left"), np.searchsorted(own_key, known, "right")
            for i in np.flatnonzero(high > low).tolist():
                who = owners_of[first[i] : last[i]]
                for a, c in itertools.product(range(0, len(who), 1024), range(low[i], high[i], 4096)):
                    some, q = matrix[c : min(c + 4096, high[i])], who[a : a + 1024]
                    x, y = best_pairs(asking_of[line[q]], some, k + 1)
                    scores = np.einsum("ij,ij->i", some[y], asking_of[line[q[x]]])
                    found.append((q[x], own_node[c + y], scores))
                    waiting += len(x)
                    if waiting > 1 << 20:
                        found, waiting = [best_of(found, k + 1)], 0
        if not found:
            return schema.empty_table()
        who, what, score = best_of(found, k + 1)
        return pa.table([right["query"].combine_chunks().take(pa.array(who)), pa.array(what, schema.field("node").type), pa.array(score)], schema=schema)

    scored = entries.groupBy("shard").cogroup(probing.groupBy("shard")).applyInArrow(meet, f"query {kind}, node {kind}, score double")
    top = lambda x: x.groupBy("query", "node").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= k + 1)
    best = materialise(top(scored), "best")
    # Queries that the probes leave short of answers are searched exactly, block by block.
    copies = nodes.select("node", F.size("ids").alias("copies"))
    rest = best.join(copies, "node").groupBy("query").agg((F.sum("copies") - F.max((F.col("query") == F.col("node")).cast("int"))).alias("found"))
    rows_of = nodes.groupBy(F.size("vector").alias("size")).agg(F.sum(F.size("ids")).alias("rows"))
    state = asking.withColumn("size", F.size("vector")).join(rows_of, "size").join(rest.withColumnRenamed("query", "node"), "node", "left")
    short = F.coalesce("found", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1)
    unfitted = F.col("size") != fitted if fitted is not None else F.lit(False)
    again = materialise(state.where((F.col("rows") > 1) & (short | unfitted)).select("node", "vector", "size"), "again")
    answers = [best.select("query", "node", "score")]
    for size, count in again.groupBy("size").count().orderBy("size").collect():
        blocks = -(-count * size // BLOCK)
        for block in range(blocks):
            own = again.where((F.col("size") == size) & (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(blocks)) == block)).select("node", "vector").toArrow()
            if own.num_rows:
                answers.append(materialise(exactly(nodes, own, k), "exact"))
    best = top(reduce(DataFrame.unionByName, answers))
    # Answers in nodes, then in rows: a node's ids share its score.
    listed = asked.join(best, asked["node"] == best["query"]).select("query_id", best["node"].alias("found"), "score")
    listed = listed.join(nodes.select(F.col("node").alias("found"), "ids"), "found").select("query_id", F.explode("ids").alias(id_col), "score").where(F.col("query_id") != F.col(id_col))
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
