"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label are one class.  Each pass hashes every class, less its
label's mean, with its own 64 random hyperplanes, concatenates the signs to one
key, orders the classes of a label by that key lexicographically and compares
each with the WINDOW classes that follow it; pairs whose cosine, in double
precision, reaches the threshold are united across passes.

How often a pair right at the threshold meets depends on how the vectors lie, so
it is measured: beside some PROBES classes of each label a neighbour at the
threshold is planted, which no result sees.  A label gets passes until the share
RECALL of its probes has met its class, or a class close to both.  Where the
passes to come would cost more than comparing all classes of the label, these
are compared in blocks instead.

A bounded window cannot hold all links of a dense group, so those are counted
exactly afterwards: the members of each component are compared with each other
in blocks, which yields a count for each member and never a list of pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.graph import components
from llm.scratch import drop, save

#: Cosine that links; classes that a class is compared with in a pass; wanted recall of pairs at the threshold.
COSINE, WINDOW, RECALL = 0.93, 16, 0.97
#: Passes that are sorted at once (their rows are on disk together); members of a block of a component.
PASSES_AT_ONCE, MEMBERS = 4, 1000
BITS, SEED = 64, 7
#: Planted neighbours of a label; classes that a class is compared with for the cost of a pass.
PROBES, PASS_COST = 200, 250


def passes_for(n: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold was in some window with probability ``recall``."""
    agree = 1 - math.acos(cosine) / math.pi
    once = agree ** max(1.0, math.log2(max(2.0, n / window)))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _unit(batches):
    """Rows with a direction: vectors of finite numbers, not all zero, scaled to length 1."""
    for batch in batches:
        ids, labels, dims, out = [], [], [], []
        for k, v in enumerate(batch.column("embedding")):
            if not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all() or not x.any():
                continue
            x = x / np.abs(x).max()
            x = x / math.sqrt(float(x @ x)) + 0.0              # + 0.0: no negative zeros
            ids.append(batch.column("vec_id")[k]), labels.append(batch.column("label")[k]), dims.append(len(x)), out.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()),
                                          pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.float64)


def _sums(batches):
    """Number and sum of the vectors of each label and length of a batch."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            coded = part.column("label").dictionary_encode()
            codes = coded.indices.to_numpy()
            total = np.zeros((len(coded.dictionary), d))
            np.add.at(total, codes, _matrix(part.column("vec")).reshape(-1, d))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(total), d, np.int32)), pa.array(np.bincount(codes, minlength=len(total))),
                                              pa.array([x.tobytes() for x in total], pa.binary())], names=["label", "dim", "n", "mean"])


def _mean(table: pa.Table) -> pa.Table:
    n = int(table.column("n").to_numpy().sum())
    mean = _matrix(table.column("mean").combine_chunks()).reshape(table.num_rows, -1).sum(0) / n
    return pa.table({"label": table.column("label")[:1], "dim": table.column("dim")[:1], "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary())})


def _planted(cosine: float):
    """For each class a neighbour right at the threshold, in a random direction; ``of`` is the class's own vector."""
    def run(batches):
        for batch in batches:
            out = []
            for k, d, v in zip(batch.column("cls").to_pylist(), batch.column("dim").to_pylist(), batch.column("vec").to_pylist()):
                x = np.frombuffer(v, np.float64)
                w = np.random.default_rng([SEED, k & 0xFFFFFFFFFFFFFFFF]).standard_normal(d)
                w -= (w @ x) * x
                size = math.sqrt(float(w @ w))
                near = min(1.0, cosine + 1e-9)
                out.append((near * x + math.sqrt(1 - near * near) / size * w if d > 1 and size > 1e-9 else x).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("label", "dim", "cls")], pa.array(out, pa.binary()), batch.column("vec")],
                                             names=["label", "dim", "cls", "vec", "of"])
    return run


def _keys(passes: list[int]):
    """Each class once for each pass, with the pass's key of signs."""
    def run(batches):
        planes: dict[tuple, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                m = (_matrix(part.column("vec")) - _matrix(part.column("mean"))).reshape(-1, d)
                for p in passes:
                    if (p, d) not in planes:
                        planes[p, d] = np.random.default_rng([SEED, p]).standard_normal((int(d), BITS))
                    bits = np.packbits(m @ planes[p, d] > 0, axis=1)
                    key = bits.view(">i8").astype(np.int64).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), p, np.int32)), part.column("label"), part.column("dim"),
                                                      pa.array(key), part.column("cls"), part.column("vec"), part.column("of")],
                                                     names=["pass", "label", "dim", "key", "cls", "vec", "of"])
    return run


def _united(group: np.ndarray, cls: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list, list]:
    """Edges of a forest that connects what ``pairs`` of places connect."""
    root = list(range(len(cls)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for left, right in pairs:
        for x, y in zip(left.tolist(), right.tolist()):
            fx, fy = find(x), find(y)
            if fx != fy:
                root[fy] = fx
                a.append(cls[x]), b.append(cls[y])
    return a, b


def _neighbours(cosine: float, window: int):
    """Edges between rows of a sorted partition that are close in order and in cosine; (a, null) for a planted row that met a."""
    def run(batches):
        tail: pa.RecordBatch | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            dims = table.column("dim").to_numpy()
            labels = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            group = np.stack([table.column("pass").to_numpy(), labels, dims], axis=1)
            cls, pairs = table.column("cls").to_numpy(), []
            whole = _matrix(table.column("vec").combine_chunks() if table.num_rows else [])
            to = np.cumsum(dims.astype(np.int64))
            of = table.column("of").combine_chunks()
            real = ~of.is_valid().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
            met = []
            for d in np.unique(dims):                          # as a rule one
                rows = np.flatnonzero((dims == d) & real)
                m = whole.reshape(-1, d) if len(rows) == len(dims) else np.array([whole[to[r] - d: to[r]] for r in rows]).reshape(-1, d)
                for r in np.flatnonzero((dims == d) & ~real):
                    at = int(np.searchsorted(rows, r))
                    y = slice(max(0, at - window), at + window)
                    both = np.stack([whole[to[r] - d: to[r]], np.frombuffer(of[r].as_buffer(), np.float64)])
                    if ((m[y] @ both.T >= cosine).all(1) & (group[rows[y]] == group[r]).all(1)).any():
                        met.append(cls[r])
                for j in range(1, window + 1):
                    if len(rows) > j:
                        x, y = rows[:-j], rows[j:]
                        ok = (np.einsum("ij,ij->i", m[:-j], m[j:]) >= cosine) & (group[x] == group[y]).all(1) & (cls[x] != cls[y])
                        pairs.append((x[ok], y[ok]))
            a, b = _united(group, cls, pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a + met, pa.int64()), pa.array(b + [None] * len(met), pa.int64())], names=["a", "b"])
            last = np.flatnonzero(real)[-window:]              # planted rows take no place in the window
            kept = int(last[0]) if len(last) == window else 0
            tail = table.slice(kept).combine_chunks().to_batches()[0] if table.num_rows else None
    return run


def _compared(cosine: float):
    """Edges that connect what is linked within one block, or one pair of blocks, of a label."""
    def run(table: pa.Table) -> pa.Table:
        cls = table.column("cls").to_numpy()
        m = _matrix(table.column("vec").combine_chunks()).reshape(len(cls), -1)
        near = m @ m.T >= cosine
        np.fill_diagonal(near, False)
        left, a, b = near.any(1), [], []
        for k in np.flatnonzero(left):
            front = np.array([k])
            left[k], members = False, []
            while len(front):
                front = np.flatnonzero(near[front].any(0) & left)
                left[front] = False
                members += cls[front].tolist()
            a += [int(cls[k])] * len(members)
            b += members
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def _all_edges(classes: DataFrame, labels: DataFrame, cosine: float) -> DataFrame:
    """Edges among all classes of ``labels`` (label, dim, n), compared in blocks of MEMBERS."""
    dealt = (classes.select("label", "dim", "cls", "vec").join(labels.select("label", "dim", F.ceil(F.col("n") / MEMBERS).alias("blocks")), ["label", "dim"])
             .withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("label", "dim", "cls", "vec", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    return dealt.groupBy("label", "dim", "low", "high").applyInArrow(_compared(cosine), "a long, b long")


def _counted(cosine: float):
    """Links of each member within one block, or one pair of blocks, of a component."""
    def run(table: pa.Table) -> pa.Table:
        names = table.column("component").to_numpy()
        dims, block, n = table.column("dim").to_numpy(), table.column("block").to_numpy(), table.column("n").to_numpy()
        low = int(table.column("low")[0].as_py())
        high = int(table.column("high")[0].as_py())
        links = np.zeros(len(names), np.int64)
        vec = table.column("vec").combine_chunks()
        order = np.lexsort((dims, names))
        cuts = np.flatnonzero((np.diff(names[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            m = _matrix(vec.take(pa.array(rows))).reshape(len(rows), -1)
            near = np.zeros((len(rows), len(rows)), bool)
            np.greater_equal(m @ m.T, cosine, out=near)
            np.fill_diagonal(near, False)
            if low != high:                                    # members of one block meet in that block's own group
                near &= block[rows][:, None] != block[rows][None]
            links[rows] = near @ n[rows]
        return pa.table({"cls": table.column("cls"), "links": pa.array(links)})
    return run


def near_vectors(table: DataFrame, cosine: float = COSINE, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row (vec_id, embedding, label).

    Rows without a label or a direction (null, empty or zero vector, null or
    non-finite component) link with nothing, and neither do those without a
    vec_id: for these component_id is null and kept false.  Rows that repeat
    link with each other.  Vectors of different lengths never link.
    """
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
                        F.col("label").cast("string").alias("label"))
    usable = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    unit = save(usable.mapInArrow(_unit, "vec_id long, label string, dim int, vec binary")
                .withColumn("cls", F.xxhash64("label", "dim", "vec")), "unit")
    classes = save(unit.groupBy("cls", "label", "dim", "vec").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")), "classes")
    key = ["label", "dim"]
    shapes = save(classes.select("label", "dim", "vec").mapInArrow(_sums, "label string, dim int, n long, mean binary")
                  .groupBy(*key).applyInArrow(_mean, "label string, dim int, n long, mean binary"), "shapes")
    probes = save(classes.join(shapes.filter(F.col("n") > window).select("label", "dim", F.col("n").alias("of_label")), key)
                  .filter(F.pmod(F.xxhash64("cls", F.lit(5)), F.col("of_label")) < PROBES).select("label", "dim", "cls", "vec")
                  .mapInArrow(_planted(cosine), "label string, dim int, cls long, vec binary, of binary"), "probes")
    both = classes.select("label", "dim", "cls", "vec", F.lit(None).cast("binary").alias("of")).unionByName(probes)
    planted = probes.groupBy(*key).agg(F.count("*").alias("planted"))
    order = ["pass", "label", "dim", "key", "cls"]
    agree = 1 - math.acos(cosine) / math.pi
    once = f"pow({agree!r}D, greatest(1D, log2(greatest(2D, n / {window}))))"
    least = f"greatest(4D, ceil({math.log(1 - RECALL)!r}D / ln(1 - {once})))"     # as passes_for
    edges, exact, todo, k = [], [], shapes, 0
    while True:
        keyed = both.join(todo.select("label", "dim", "mean"), key).mapInArrow(
            _keys(list(range(k, k + PASSES_AT_ONCE))), "pass int, label string, dim int, key long, cls long, vec binary, of binary")
        edges.append(save(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                          .mapInArrow(_neighbours(cosine, window), "a long, b long").distinct(), "edges"))
        k += PASSES_AT_ONCE
        found = edges[0]
        for more in edges[1:]:
            found = found.unionByName(more)
        met = (probes.join(found.filter("b IS NULL").select(F.col("a").alias("cls")), "cls", "left_semi")
               .groupBy(*key).agg(F.count("*").alias("met")))
        state = (todo.join(planted, key, "left").join(met, key, "left")
                 .withColumn("short", F.coalesce(F.coalesce("met", F.lit(0)) / F.col("planted"), F.lit(1.0)) < RECALL)
                 # Half a probe more: where none was met yet, that many passes more are expected, and not endlessly many.
                 .withColumn("likely", (F.coalesce("met", F.lit(0)) + 0.5) / (F.col("planted") + 1))
                 .withColumn("dear", F.expr(f"short AND {PASS_COST} * {k} * greatest(1D, {math.log(1 - RECALL)!r}D / ln(1 - likely)) >= n"))
                 .filter(f"short OR {k} < {least}").select("label", "dim", "n", "mean", "dear"))
        state = save(state, "state")
        exact.append(state.filter("dear").select("label", "dim", "n"))
        todo = state.filter("NOT dear")
        if todo.isEmpty():
            break
    pairs = found.filter("b IS NOT NULL")
    dear = exact[0]
    for more in exact[1:]:
        dear = dear.unionByName(more)
    if not dear.isEmpty():
        edges.append(save(_all_edges(classes, dear, cosine).distinct(), "edges"))
        pairs = pairs.unionByName(edges[-1])
    names = save(components(pairs).select(F.col("node").alias("cls"), "component"), "names")
    drop(*edges)
    members = save(classes.join(names, "cls"), "members")
    size = save(members.groupBy("component").agg(F.count("*").alias("g"), F.min("least").alias("component_id"))
                .withColumn("blocks", F.ceil(F.col("g") / MEMBERS)), "size")
    small = max(1, int(members.count() // MEMBERS))
    dealt = (members.join(size, "component").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(small))).otherwise(F.col("component")).alias("owner"),
                     (F.col("blocks") == 1).alias("packed"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                     "component", "cls", "dim", "block", "n", "vec"))
    counts = save(dealt.groupBy("owner", "packed", "low", "high").applyInArrow(_counted(cosine), "cls long, links long")
                  .groupBy("cls").agg(F.sum("links").alias("links")), "counts")
    facts = save(classes.select("cls", "n", "least").join(counts, "cls", "left")
                 .join(members.join(size.select("component", "component_id"), "component").select("cls", "component_id"), "cls", "left")
                 .select("cls", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "facts")
    linked = unit.select("vec_id", "cls").join(facts, "cls").select("vec_id", "n_links", "component_id")
    # What has no direction: all rows less those above, told apart by the same test.
    lone = (rows.filter("NOT (vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL "
                        "AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity') AND NOT isnan(x)) "
                        "AND exists(embedding, x -> x <> 0))")
            .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector (equal labels, cosine 0.93)."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
