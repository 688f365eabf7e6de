"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong
to; overlapping sources share documents).  Each pattern offers its words once
for each repetition, and every further repetition costs more (a convex cost);
a min-cost flow routes that capacity to the source quotas.  The flow runs over
patterns, never over documents, and apart for each group of sources that
patterns connect: a group is a task of its own, so there may be any number of
sources.  Within a pattern, documents are then selected whole in the order of a
seeded hash until the words that the flow took are reached: rounds that are
used in full take every document, the last one a prefix of that order, found
through a histogram so that no pattern is ever sorted as a whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.graph import components
from llm.scratch import drop, save
from opsight.plans.numbering import global_row_number

#: Source weights by code point order, repeating; total size in hundredths of all words; repetitions of a document.
WEIGHTS, TOTAL_PERCENT, REPEATS = (3, 1, 2), 150, 2
#: Buckets of the seeded order in which the last round's cut is looked for.
BUCKETS = 4096
#: Plans of patterns up to this many are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_PLANS = 100_000
SEED = 20240601


def targets(sizes: dict, weights: dict, total: float, most: float = REPEATS) -> dict:
    """Shares of ``total`` by weight; none above ``most`` times its size, the excess reshared."""
    out, open_ = {}, [s for s in sizes]
    left = total
    while open_:
        weight = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] > most * sizes[s] * weight]
        if not full:
            return out | {s: left * weights[s] / weight for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def route(supply: list[tuple[tuple, int]], quota: dict, repeats: int = REPEATS) -> list[list[dict]]:
    """Min-cost flow from pattern rounds to sources: flow[p][r][source] words.

    supply: (sources of the pattern, words); round r of a pattern costs r * r
    a word.  Successive shortest paths on the graph start -> pattern round ->
    source -> end: the next words go to an open source by the cheapest free
    round it can reach, through sources that give up words of a shared pattern
    in exchange for others.
    """
    names = list(quota)
    left = {s: float(quota[s]) for s in names}
    flow = [[dict() for _ in range(repeats)] for _ in supply]
    room = [[float(size) for _ in range(repeats)] for _, size in supply]
    tiny = 1e-6
    # Free rounds of each source, cheapest first; used up ones are passed over when met.  And its shared patterns.
    free: dict = {s: [] for s in names}
    shared: dict = {s: [] for s in names}
    for p, (members, size) in enumerate(supply):
        for s in members:
            if size > tiny:
                free[s] += [(r * r, p, r) for r in range(repeats)]
            if len(members) > 1:
                shared[s].append(p)
    for own in free.values():
        heapq.heapify(own)

    def cheapest(s):
        own = free[s]
        while own and room[own[0][1]][own[0][2]] <= tiny:
            heapq.heappop(own)
        return own[0] if own else None

    def path():
        """(free round, source that takes it, exchanges) of the cheapest way to some open source."""
        best = {s: (0.0, None) for s in opened}
        heap = [(0.0, k, s) for k, s in enumerate(best)]
        heapq.heapify(heap)
        goal, done, tick = None, set(), len(heap)
        while heap:
            cost, _, s = heapq.heappop(heap)
            if s in done or cost > best[s][0] + 1e-12:
                continue
            if goal and cost >= goal[0]:
                break
            done.add(s)
            top = cheapest(s)
            if top and (goal is None or cost + top[0] < goal[0] - 1e-12):
                goal = (cost + top[0], s, top[1], top[2])
            for p in shared[s]:
                for r in range(repeats):
                    for t, amount in flow[p][r].items():
                        if t != s and amount > tiny and t not in done and (t not in best or cost < best[t][0] - 1e-12):
                            best[t] = (cost, (s, p, r))
                            tick += 1
                            heapq.heappush(heap, (cost, tick, t))
        return goal, best

    # Open sources that share patterns are searched together; the others reach their own rounds alone.
    for group in [[s] for s in names if not shared[s]] + [[s for s in names if shared[s]]]:
        while True:
            opened = [s for s in group if left[s] > tiny]
            goal, best = path() if opened else (None, {})
            if goal is None:
                break
            _, s, p, r = goal
            steps, amount, end = [], room[p][r], s
            while best[s][1] is not None:
                u, q, k = best[s][1]
                steps.append((u, s, q, k))
                amount = min(amount, flow[q][k][s])
                s = u
            amount = min(amount, left[s])
            left[s] -= amount
            room[p][r] -= amount
            flow[p][r][end] = flow[p][r].get(end, 0.0) + amount
            for u, t, q, k in steps:
                flow[q][k][t] -= amount
                flow[q][k][u] = flow[q][k].get(u, 0.0) + amount
    return flow


def _planned(table: pd.DataFrame) -> pd.DataFrame:
    """What the mix takes of each pattern of one group of connected sources: full rounds, and words of the next."""
    quota = dict(zip(table["source"], table["target"]))
    members: dict = defaultdict(list)
    words: dict = {}
    for pattern, source, n in zip(table["pattern__"], table["source"], table["words"]):
        members[pattern].append(source)
        words[pattern] = int(n)
    names = sorted(members)
    flow = route([(tuple(sorted(members[p])), words[p]) for p in names], {s: quota[s] for s in sorted(quota)})
    full, rest = [], []
    for p, rounds in zip(names, flow):
        n, taken = words[p], sum(sum(r.values()) for r in rounds)
        full.append(min(REPEATS, int((taken + 1e-6) // n)) if n else 0)
        rest.append(float(max(0.0, taken - full[-1] * n)) if n and full[-1] < REPEATS else 0.0)
    return pd.DataFrame({"pattern__": names, "full": full, "rest": rest})


def word_count(text: str = "text") -> Column:
    """Words of a text: runs of bytes other than space and 0x09-0x0D."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def _name(c: Column) -> Column:
    """Sortable by code point, null last."""
    return F.concat(F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(c.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = 0.0, most: float = REPEATS) -> DataFrame:
    """(source, size, target) of ``sizes`` (source, size): as ``targets``, for any number of sources.

    Weights repeat along the sources' order by code point.  Each step finds the
    sources that are full at the present share of a unit of weight; the share
    only grows, so the steps end when no further source is full.
    """
    order = global_row_number(sizes, [F.col("source")], "k__")
    own = F.array(*[F.lit(float(w)) for w in weights])
    rows = save(order.select("source", "size", F.element_at(own, (F.pmod(F.col("k__") - 1, F.lit(len(weights))) + 1).cast("int")).alias("weight")), "sources")
    at = rows.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first().w
    share, n_full = total / at if at else 0.0, 0
    while True:
        full = F.col("size") * most < F.lit(share) * F.col("weight")
        got = rows.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("size"),
                       F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("w")).first()
        if got.n == n_full or not got.w:
            break
        n_full, share = got.n, (total - most * got["size"]) / got.w
    return rows.select("source", "size", F.least(F.col("size") * F.lit(float(most)), F.lit(share) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, members: Column | None = None, weights: tuple = WEIGHTS,
                total_percent: int = TOTAL_PERCENT, seed: int = SEED) -> tuple[DataFrame, dict]:
    """``docs`` with size__, source_size__, target__, taken__, and the plan by source.

    ``members``: array of the sources a document belongs to; by default its
    own source alone.  size__ counts words (null text: 0); taken__ is size__
    times the number of times the mix uses the document.  Rows that repeat are
    documents of their own; a null source is a source; an empty table gives an
    empty mix.  Reruns agree: the order within a pattern depends on the seed,
    doc_id and text only, so ties are rows that are alike.
    """
    own = _name(F.col("source"))
    pattern = F.array(own) if members is None else F.array_sort(F.array_distinct(F.transform(members, lambda m: F.concat(F.lit("0"), m))))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    known = docs.withColumns({"size__": word_count(), "own__": own, "pattern__": F.concat_ws("\x01", pattern), "order__": order})
    facts = save(known.select("size__", "pattern__", "order__").groupBy(
        "pattern__", F.pmod(F.shiftrightunsigned("order__", 20), F.lit(BUCKETS)).alias("bucket")).agg(
        F.sum("size__").alias("words")), "sizes")
    patterns = save(facts.groupBy("pattern__").agg(F.sum("words").alias("words")).withColumn("source", F.explode(F.split("pattern__", "\x01"))), "patterns")
    # A source's size: all words that belong to it.
    total = facts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n * total_percent / 100
    sources = save(source_targets(patterns.groupBy("source").agg(F.sum("words").cast("long").alias("size")), weights, total), "targets")
    met = patterns.join(sources.select("source", "target"), "source")
    lead = patterns.groupBy("pattern__").agg(F.min("source").alias("first"))
    pairs = patterns.join(lead, "pattern__").filter("source <> first").select(F.col("first").alias("a"), F.col("source").alias("b"))
    groups = components(pairs).withColumnRenamed("node", "source").withColumnRenamed("component", "group")
    grouped = met.join(groups, "source", "left").withColumn("group", F.coalesce("group", "source"))
    plans = save(grouped.groupBy("group").applyInPandas(lambda t: _planned(t), "pattern__ string, full long, rest double"), "plans")
    few = plans.count() <= BROADCAST_PLANS
    sent = lambda df: F.broadcast(df) if few else df
    # The bucket of the seeded order in which the last round ends, by pattern.
    ahead = facts.withColumn("before", F.expr("sum(words) OVER (PARTITION BY pattern__ ORDER BY bucket) - words")).join(sent(plans), "pattern__")
    cut = (ahead.filter("before < rest").groupBy("pattern__")
           .agg(F.max(F.struct("bucket", "before")).alias("c")).select("pattern__", "c.bucket", "c.before"))
    steps = save(plans.join(cut, "pattern__", "left").select("pattern__", "full", "rest", "bucket", "before"), "steps")
    drop(facts, patterns, plans)
    return known, {"steps": steps, "few": few,
                   "sources": sources.select(F.col("source").alias("own__"), F.col("size").alias("source_size__"), F.col("target").alias("target__"))}


def _taken(known: DataFrame, plan: dict) -> DataFrame:
    steps, sources = plan["steps"], plan["sources"]
    sent = lambda df: F.broadcast(df) if plan["few"] else df
    at = known.join(sent(steps), "pattern__").withColumn("at__", F.pmod(F.shiftrightunsigned("order__", 20), F.lit(BUCKETS)))
    # Within the one bucket where a round ends: documents by order, until the next would pass the quota by more than half of itself.
    edge = save(at.filter("at__ = bucket").select("pattern__", "order__", "size__", "before", "rest")
                .withColumn("upto", F.expr("before + sum(size__) OVER (PARTITION BY pattern__ ORDER BY order__)"))
                .filter("upto - size__ / 2 <= rest").groupBy("pattern__").agg(F.max("order__").alias("last")), "edge")
    at = at.join(sent(edge), "pattern__", "left")
    extra = F.expr("CASE WHEN full >= 2 OR bucket IS NULL THEN 0 WHEN at__ < bucket THEN 1 WHEN at__ = bucket AND order__ <= last THEN 1 ELSE 0 END")
    return at.withColumn("times__", F.col("full") + extra).join(sent(sources), "own__", "left")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return _taken(*mix_sources(docs)).select("doc_id", F.col("size__").alias("size"), F.col("source_size__").alias("source_size"),
                                             F.col("target__").alias("target"), (F.col("size__") * F.col("times__")).alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it."""
    return (_taken(*mix_sources(docs)).filter("times__ > 0")
            .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times__"))).alias("time__")).select(*docs.columns))
