"""Benchmark decontamination by template canonicalisation.

Every word is stripped of outer punctuation and lower-cased; numbers, names
(capitalised inside a sentence) and units (after a number) become typed
placeholders whose text is kept as the slot's value.  Windows of consecutive
template words are hash-joined with those of the benchmark items.  Matches at
one alignment of document and item must fill the slots consistently - one
value in the document for each value in the item - so a question asked again
with other numbers is caught and an accidental match of templates is not.  A
document leaks an item when such matches cover enough of the item's words, or
a long enough run of them.

Where few literal words remain, a template says little: such a window is exact,
its slots' values being part of its hash.  An item of up to WHOLE template
words that ordinary windows do not cover (shorter than a window, or dense in
slots) is moreover looked for whole: by its template if that has literals
enough, else exactly.  Items of fewer than LEAST words, which any text may
hold, leak only to a document that is nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import columns, save
from llm.text import _BYTE_CODE, _LOWER, mix, slices, span_hashes, window_hashes, words

#: Template words in a window, literal words that one needs, share of an item's words that makes a leak.
WIDTH, LITERALS, LEAK_FROM = 5, 3, 0.6
#: Template words of one alignment that make a leak of a longer item; of the longest item that is looked for whole; of the shortest that any text may leak.
RUN, WHOLE, LEAST = 25, 16, 3
#: Benchmark windows looked up at a time (8 MB); larger benchmarks take more passes.
WINDOWS_A_PASS = 1_000_000
#: Bytes of text held as words and windows at a time.
SLICE = 1 << 19
#: Ids and item windows up to this many are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

# Unit words, as written after a number.
UNITS = ("%", "°c", "°f", "cm", "cents", "days", "dollars", "euros", "feet", "ft", "g", "gb", "grams", "h", "hours", "hz",
         "inches", "kb", "kg", "kilograms", "kilometers", "km", "kw", "l", "lb", "lbs", "liters", "litres", "m", "mb",
         "meters", "metres", "mg", "miles", "min", "minutes", "ml", "mm", "months", "ms", "oz", "percent", "pounds", "s",
         "seconds", "tons", "v", "w", "watts", "weeks", "yards", "years")

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_CORE = _DIGIT | _UPPER
_CORE[97:123] = True
_CORE[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
_NUM, _NAME, _UNIT = (np.uint64(k) for k in (1, 2, 3))
_KIND_HASH = mix(np.arange(100, 104, dtype=np.uint64))


def _unit_hashes() -> np.ndarray:
    text = [np.frombuffer(u.encode(), np.uint8) for u in UNITS if u not in ("%",)]
    return np.sort(np.array([span_hashes(_BYTE_CODE[t], np.zeros(1, np.int64), np.array([len(t)]))[0] for t in text]))


_UNITS = _unit_hashes()


def template(data: np.ndarray, off: np.ndarray):
    """(start, end, kind, template hash, own hash, first) of the template words of a slice; kind 0 is a literal."""
    start, end, _, first = words(data, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    raw_end = end
    inside = np.concatenate([[0], np.cumsum(_CORE[data])])
    at = np.flatnonzero(_CORE[data])
    some = inside[end] > inside[start]
    doc, raw_end, start, end = doc[some], raw_end[some], start[some], end[some]
    if len(start):
        start, end = at[inside[start]], at[inside[end] - 1] + 1
    opening = np.ones(len(start), bool)            # first of its document, or after the end of a sentence
    opening[1:] = (doc[1:] != doc[:-1]) | _STOP[data[raw_end[:-1] - 1]]
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = np.concatenate([[0], np.cumsum(_CORE[data] & ~_DIGIT[data])])
    number = (digits[end] > digits[start]) & ((letters[end] == letters[start]) | (_DIGIT[data[start]] if len(start) else False))
    hashes = span_hashes(_BYTE_CODE[_LOWER[data]], start, end) if len(start) else np.zeros(0, np.uint64)
    kind = np.zeros(len(start), np.uint64)
    kind[number] = _NUM
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & (doc[1:] == doc[:-1])
    unit &= (_UNITS[np.minimum(np.searchsorted(_UNITS, hashes), len(_UNITS) - 1)] == hashes) & ~number
    kind[unit] = _UNIT
    kind[(_UPPER[data[start]] if len(start) else unit) & ~opening & ~number & ~unit] = _NAME
    return start, end, kind, np.where(kind > 0, _KIND_HASH[kind.astype(np.int64)], hashes), hashes, np.searchsorted(doc, np.arange(len(off)))


_EXACT, _ALONE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _windows(kind: np.ndarray, h: np.ndarray, own: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, row, hash, literals) of the windows of ``width`` words within a row."""
    at = np.arange(max(0, len(h) - width + 1))
    row = np.searchsorted(first, at, side="right") - 1
    inside = at + width <= first[np.minimum(row + 1, len(first) - 1)]
    at, row = at[inside], row[inside]
    literal = np.concatenate([[0], np.cumsum(kind == 0)])
    literals = literal[at + width] - literal[at]
    typed, exact = window_hashes(h, width), window_hashes(own, width)
    win = np.where(literals >= LITERALS, typed[at], mix(exact[at] ^ _EXACT)) if len(at) else np.zeros(0, np.uint64)
    if width < LEAST:                            # such an item must be the whole row
        alone = first[row + 1] - first[row] == width
        at, row, win, literals = at[alone], row[alone], mix(win[alone] ^ _ALONE), literals[alone]
    return at, row, win, literals


def _reached(at: np.ndarray, row: np.ndarray, literals: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By row: words in windows that have literals enough."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    good = at[literals >= LITERALS]
    np.add.at(edge, good, 1)
    np.add.at(edge, good + WIDTH, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


_ROWS = "{} long, key long, at long, width int, hash long, values array<string>, n long"


def _window_rows(key: str, widths: tuple[int, ...], wanted: np.ndarray | None = None):
    """Windows of each row: of WIDTH words and of the other ``widths``; of ``wanted`` hashes only, if given.

    Without ``wanted`` (the items' side) a width other than WIDTH is that of the
    whole item, where ordinary windows do not cover enough of it.
    """
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch, limit=SLICE):
                start, end, kind, h, own, first = template(data, off)
                text = data.tobytes()
                count = np.diff(first)
                base = _windows(kind, h, own, first, WIDTH)
                covered = _reached(base[0], base[1], base[3], first) if wanted is None else None
                for width in (WIDTH, *widths):
                    at, row, win, _ = base if width == WIDTH else _windows(kind, h, own, first, width)
                    if wanted is not None:
                        ok = wanted[np.minimum(np.searchsorted(wanted, win), len(wanted) - 1)] == win
                    elif width == WIDTH:
                        ok = np.ones(len(at), bool)
                    else:
                        ok = (count[row] == width) & ((covered[row] < LEAK_FROM * width) | (width < WIDTH))
                    at, row, win = at[ok], row[ok], win[ok]
                    values = [[text[start[k]:end[k]].decode("utf-8", "replace").lower() if kind[k] else None for k in range(a, a + width)] for a in at.tolist()]
                    yield pa.RecordBatch.from_pydict({
                        **{c: rows.column(c).take(pa.array(row, pa.int64())) for c in (key, "key")},
                        "at": pa.array(at - first[row], pa.int64()), "width": pa.array(np.full(len(at), width, np.int32)),
                        "hash": pa.array(win.view(np.int64)), "values": pa.array(values, pa.list_(pa.string())), "n": pa.array(count[row], pa.int64())})
    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_slots, share): items that documents leak.

    Null and empty texts match nothing, and neither do items without a word.
    Rows that share a doc_id are matched each on its own, and a pair is given
    once, by its best match; items that share an item_id likewise; a null doc_id
    or item_id is dropped from the pairs, having nothing to name.  Either table
    may be empty, which gives no pairs.  A very long text is a slice of its own.
    """
    spark = docs.sparkSession
    texts = columns(docs, doc_id="long", text="string").filter("doc_id IS NOT NULL").withColumn("key", F.xxhash64("text"))
    every = tuple(w for w in range(1, WHOLE + 1) if w != WIDTH)
    items = save(columns(benchmark, item_id="long", text="string").filter("item_id IS NOT NULL").withColumn("key", F.xxhash64("text"))
                 .mapInArrow(_window_rows("item_id", every), _ROWS.format("item_id")), "items")
    widths = tuple(sorted(r.width for r in items.filter(F.col("width") != WIDTH).select("width").distinct().toPandas().itertuples()))    # WHOLE at most
    n = items.select("hash").distinct().count()
    passes = max(1, -(-n // WINDOWS_A_PASS))
    found = []
    for k in range(passes):
        part = items.filter(F.pmod(F.xxhash64("hash"), F.lit(passes)) == k).select("hash").distinct().toPandas()["hash"].to_numpy()
        if len(part):
            wanted = np.sort(part.astype(np.int64).view(np.uint64))
            found.append(save(texts.mapInArrow(_window_rows("doc_id", widths, wanted), _ROWS.format("doc_id")), "found"))
    if not found:
        return spark.createDataFrame([], "doc_id long, item_id long, n_words long, n_covered long, n_slots long, share double")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    side = items.select("item_id", "hash", "width", F.col("at").alias("item_at"), F.col("values").alias("item_values"), F.col("n").alias("n_words"))
    met = hits.drop("n").join(F.broadcast(side) if items.count() <= BROADCAST_ROWS else side, ["hash", "width"])
    slots = F.expr("filter(transform(item_values, (v, k) -> struct(v AS v, values[k] AS d)), x -> x.v IS NOT NULL)")
    words_of = "array_distinct(flatten(transform({}, a -> sequence(a.item_at, a.item_at + a.width - 1))))"
    aligned = (met.groupBy("doc_id", "key", "item_id", "n_words", (F.col("at") - F.col("item_at")).alias("shift"))
               .agg(F.collect_set(F.struct("item_at", "width")).alias("ats"), F.array_distinct(F.flatten(F.collect_set(slots))).alias("pairs"))
               .filter("size(array_distinct(transform(pairs, p -> p.v))) = size(pairs)").withColumn("run", F.size(F.expr(words_of.format("ats")))))
    covered = (aligned.groupBy("doc_id", "key", "item_id", "n_words")
               .agg(F.flatten(F.collect_set("ats")).alias("ats"), F.sum(F.size("pairs")).alias("n_slots"), F.max("run").alias("run"))
               .withColumn("n_covered", F.size(F.expr(words_of.format("ats"))).cast("long"))
               .withColumn("share", F.col("n_covered") / F.col("n_words")))
    return (covered.filter((F.col("share") >= LEAK_FROM) | (F.col("run") >= RUN)).groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("share", "n_words", "n_covered", "n_slots")).alias("m")).select("doc_id", "item_id", "m.n_words", "m.n_covered", "m.n_slots", "m.share"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a benchmark item by a document."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that leak no item."""
    bad = save(leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct(), "leaking")
    return docs.join(F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad, "doc_id", "left_anti").select(*docs.columns)
