"""Periodic runs of words by block convolution.

A run of period q holds an aligned block of B words that occurs again q words
later, for the dyadic scale B with (2B - 1) / 3 <= q < (4B - 1) / 3: an interval
of 2B - 1 words always holds an aligned block, and a run without its last
period is 3q words long at least.  At every scale

1. blocks whose words all come back within reach are compared with the window
   that follows them: the squared differences of word numbers, summed for every
   distance by an exact integer number-theoretic transform, are zero where the
   block occurs again without a mismatch;
2. a zero at distance d seeds a stretch with w[i] = w[i + d]; seeds of
   neighbouring blocks are one stretch, which extends by less than a block on
   either side;
3. stretches long enough are runs.  Of equal stretches the smallest distance is
   the period; distances inside a run known from a smaller scale are its
   multiples and are not tried again.

A whole slice of documents is one sequence: words carry their document, so no
run crosses documents.  Work is n log n for any text, in blocks of bounded
size; a document of any length is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import columns
from llm.text import slices, words

#: A run is LEAST words and TIMES periods long at least.  Numbers transformed or compared at a time.
LEAST, TIMES, AT_ONCE = 6, 4, 1 << 19

# Primes p with 2^25 dividing p - 1, and a generator of each.
PRIMES = ((2013265921, 31), (2113929217, 5), (469762049, 3), (167772161, 3))

_roots: dict[tuple[int, int, bool], np.ndarray] = {}


def _powers_of_root(p: int, g: int, size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size / 2 - 1 of a root of unity of order ``size`` modulo p."""
    key = (p, size, inverse)
    if key not in _roots:
        root = pow(g, (p - 1) // size, p)
        root = pow(root, -1, p) if inverse else root
        out = np.ones(1, np.uint64)
        while len(out) < size // 2:                # doubling: the upper half is the lower times root^len
            out = np.concatenate([out, out * np.uint64(pow(root, len(out), p)) % np.uint64(p)])
        _roots[key] = out
    return _roots[key]


def _forward(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Transform of every row, in bit-reversed order (decimation in frequency)."""
    rows, size = a.shape
    m, span = np.uint64(p), size
    while span > 1:
        x = a.reshape(rows, size // span, 2, span // 2)
        u, v = x[:, :, 0], x[:, :, 1]
        out = np.empty_like(x)
        out[:, :, 0] = (u + v) % m
        out[:, :, 1] = (u + m - v) * _powers_of_root(p, g, span, False) % m
        a, span = out, span // 2
    return a.reshape(rows, size)


def _backward(a: np.ndarray, p: int, g: int) -> np.ndarray:
    """Inverse of ``_forward``, from bit-reversed order (decimation in time)."""
    rows, size = a.shape
    m, span = np.uint64(p), 2
    while span <= size:
        x = a.reshape(rows, size // span, 2, span // 2)
        u, v = x[:, :, 0], x[:, :, 1] * _powers_of_root(p, g, span, True) % m
        out = np.empty_like(x)
        out[:, :, 0] = (u + v) % m
        out[:, :, 1] = (u + m - v) % m
        a, span = out, span * 2
    return a.reshape(rows, size) * np.uint64(pow(size, -1, p)) % m


def no_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For every row, at which distances its block occurs in its window.

    The sum of squared differences at distance d is sum(b^2) + sum(w^2) over
    the window's words d .. d + B - 1, less twice their correlation.  It is
    taken modulo so many primes that only zero is zero in all of them.
    """
    rows, b = blocks.shape
    reach = windows.shape[1] - b + 1
    size = 1 << (windows.shape[1] - 1).bit_length()
    most = b * (int(max(blocks.max(), windows.max())) + 1) ** 2
    zero, product = np.ones((rows, reach), bool), 1
    for p, g in PRIMES:
        if product > most:
            break
        product *= p
        m = np.uint64(p)
        x, y = np.zeros((rows, size), np.uint64), np.zeros((rows, size), np.uint64)
        x[:, :b] = blocks[:, ::-1] % m
        y[:, : windows.shape[1]] = windows % m
        squares = np.zeros((rows, windows.shape[1] + 1), np.uint64)
        np.cumsum(y[:, : windows.shape[1]] ** 2 % m, axis=1, out=squares[:, 1:])
        both = _backward(_forward(x, p, g) * _forward(y, p, g) % m, p, g)[:, b - 1: b - 1 + reach]
        total = (x[:, :b] ** 2 % m).sum(axis=1, keepdims=True) + squares[:, b:] - squares[:, :-b]
        zero &= (total % m + m + m - 2 * both % m) % m == 0
    if product <= most:
        raise OverflowError("a document of this many words needs more primes")
    return zero


def _next_same(units: np.ndarray) -> np.ndarray:
    """Distance to the next equal unit; beyond the end if there is none."""
    order = np.argsort(units, kind="stable")
    out = np.full(len(units), 2 * len(units) + 2, np.int64)
    same = units[order[1:]] == units[order[:-1]]
    out[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return out


def _seeds(units: np.ndarray, block: int, low: int, high: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the occurrences of live blocks at distances low .. high."""
    n, width = len(units), block + high
    padded = np.concatenate([units, np.full(width + 1, n + 1, np.uint64)])
    starts, distances = [], []
    step = max(1, AT_ONCE // (1 << (width - 1).bit_length()))
    for k in range(0, len(live), step):
        at = live[k: k + step] * block
        windows = padded[at[:, None] + np.arange(width)]
        hit, d = np.nonzero(no_mismatch(windows[:, :block], windows))
        far = d >= low
        starts.append(at[hit[far]])
        distances.append(d[far])
    none = np.zeros(0, np.int64)
    return np.concatenate([*starts, none]), np.concatenate([*distances, none])


def _grown(units: np.ndarray, edge: np.ndarray, d: np.ndarray, block: int, back: bool) -> np.ndarray:
    """By how many words, fewer than a block, each stretch goes on past its edge."""
    n = len(units)
    pad = np.arange(n + 1, n + 2 + block + int(d.max(initial=0)), dtype=np.uint64)     # equal to nothing
    padded = np.concatenate([units, pad])
    out = np.zeros(len(edge), np.int64)
    k = -1 - np.arange(block - 1) if back else np.arange(block - 1)
    step = max(1, AT_ONCE // block)
    for a in range(0, len(edge), step):
        at = edge[a: a + step, None] + k
        there = at >= 0
        at = np.maximum(at, 0)
        equal = there & (padded[np.minimum(at, n)] == padded[np.minimum(at + d[a: a + step, None], len(padded) - 1)])
        out[a: a + step] = np.logical_and.accumulate(equal, axis=1).sum(axis=1)
    return out


def runs_of(units: np.ndarray, longest: int | None = None) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``units`` (numbers 0 .. n), sorted.

    ``longest`` bounds the length of a run, where units of different documents
    are known to differ.
    """
    n = len(units)
    longest = min(n, longest if longest is not None else n)
    units = units.astype(np.uint64)
    found = np.zeros((0, 3), np.int64)
    soon = _next_same(units) if n else np.zeros(0, np.int64)
    block = 2
    while True:
        low, high = -(-(2 * block - 1) // 3), -(-(4 * block - 1) // 3) - 1
        if max(LEAST, TIMES * low) > longest:
            return found
        high = min(high, longest // TIMES)
        order = np.argsort(found[:, 0], kind="stable")
        opened, reach = found[order, 0], np.maximum.accumulate(found[order, 1])

        def covered(at: np.ndarray) -> np.ndarray:
            """End of the known run that goes furthest among those begun by ``at``."""
            if not len(opened):
                return np.zeros(len(at), np.int64)
            k = np.searchsorted(opened, at, side="right")
            return np.where(k > 0, reach[np.maximum(k - 1, 0)], 0)

        back = soon[: n // block * block].reshape(-1, block).max(axis=1)
        live = np.flatnonzero(back <= high)
        live = live[covered(live * block) < live * block + block + high]
        at, d = _seeds(units, block, low, high, live)
        new = covered(at) < at + block + d
        at, d = at[new], d[new]
        if len(at):
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            first = np.append(True, (np.diff(d) != 0) | (np.diff(at) != block))
            last = np.append(first[1:], True)
            start, end, q = at[first], at[last] + block, d[first]
            start = start - _grown(units, start, q, block, True)
            end = end + _grown(units, end, q, block, False) + q
            good = end - start >= np.maximum(LEAST, TIMES * q)
            both = np.concatenate([found, np.stack([start, end, q], axis=1)[good]])
            both = both[np.lexsort((both[:, 2], both[:, 1], both[:, 0]))]
            found = both[np.append(True, (np.diff(both[:, :2], axis=0) != 0).any(axis=1))] if len(both) else both
        block *= 2


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, off in slices(batch):
            start, end, hashes, first = words(data, off)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            units, _ = pd.factorize(hashes) if len(hashes) else (np.zeros(0, np.int64), None)
            units, kinds = pd.factorize(doc * (int(units.max(initial=0)) + 1) + units) if len(units) else (units, ())
            runs = runs_of(units, int(n.max(initial=0)))

            # A word that any run holds after the run's first period goes.
            edge = np.zeros(len(units) + 1, np.int64)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            size = end[kept] - start[kept] + 1                      # and a space
            to = np.cumsum(size)
            index = np.repeat(start[kept] - (to - size), size) + np.arange(to[-1] if len(to) else 0)
            flat = data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else data
            flat[to - 1] = 0x20
            edges = np.concatenate([[0], to])[np.searchsorted(kept, first)]
            raw = flat.tobytes()
            own = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
            cut = np.searchsorted(own[:, 0], first).astype(np.int32)
            where = own[:, 0] - first[np.searchsorted(first, own[:, 0], side="right") - 1]
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id").cast(pa.int64()), "n_words": pa.array(n.astype(np.int64)),
                "runs": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(where), pa.array(own[:, 1] - own[:, 0]), pa.array(own[:, 2])], ["start", "length", "period"])),
                "collapsed": pa.array([raw[a: max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:])], pa.binary()).cast(pa.string())})


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text).

    ``runs`` are sorted by start, then period; ``collapsed`` is the text of the
    words that no run holds after its first period, joined by one space.  A null
    or empty text has no words, no runs and an empty ``collapsed``.  Rows are
    independent: null and repeated ids give a row each, ties cannot arise (a
    stretch has one smallest period).  Other columns are dropped; an empty table
    gives an empty table.  A very long text is a slice of its own.
    """
    return columns(docs, doc_id="long", text="string").mapInArrow(_found, RUNS)


def repeated_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the contract's tails: of every tenth text by crc32 of its id, words from a on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), "")
    n, g = F.size("w"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1),
                        lambda i: F.element_at("w", (F.when(i < a, i).otherwise(a + F.pmod(i - a, p)) + 1).cast("int")))
    chosen = F.pmod(h, F.lit(10)) == 0
    held = columns(docs, doc_id="long", text="string").withColumn("w", F.when(chosen, w))
    return held.select("doc_id", F.when(F.size("w") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the one that repeats most, and digests of all runs and of the collapsed text."""
    found = periodic_runs(repeated_tails(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    # Fractions of numbers below 2^26 that differ do so as doubles.
    most = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("times"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return (found.withColumn("most", most).withColumn("lines", F.array_join(lines, ""))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.start")).alias("start"), F.col("most.length").alias("length"),
                    (-F.col("most.period")).alias("period"), F.expr("1000 * most.length div -most.period").alias("exponent_milli"),
                    F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words"))
