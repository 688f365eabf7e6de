"""Substring dedup by De Bruijn compaction of repeated token k-mers.

A window is WINDOW consecutive words.  Every window is represented by its
smallest k-mer (by hash, leftmost on ties), so equal windows in two documents
meet in the same k-mer at the same place.  Those k-mers are the nodes of the
graph; two that follow each other in a document are joined by an edge that
spells all words from the first to the end of the second.

1. Nodes are grouped over the corpus: a node seen in two documents or more is
   repeated, and knows its smallest document and whether one edge alone leaves
   it or enters it.  A join brings that back to every occurrence.
2. Within a document, repeated nodes along edges that are the only one at both
   ends compact into a path.  Every occurrence of such a path spells the same
   words, so a path is decided as one: all its windows also start in the
   path's smallest document.
3. Windows that overlap the ends of a path are verified by source coordinates:
   their own hashes are grouped for their smallest document and joined back.

Nothing is ever grouped by document pair, and a path that thousands of
documents share costs each of them one entry per node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import columns, drop, save
from llm.text import mix, slices, span_hashes, window_hashes, words

#: Words of a window and of a node.
WINDOW, NODE = 50, 20
#: Document keys up to this many are broadcast (some 50 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 300_000

_POSITION = np.uint64((1 << 24) - 1)


def window_nodes(units: np.ndarray, first: np.ndarray, window: int, node: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, their node's place, node hashes) over the documents of a slice."""
    kmer = window_hashes(units, node)
    w = window - node + 1
    if len(units) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), kmer
    low = (mix(kmer) & ~_POSITION) | (np.arange(len(kmer), dtype=np.uint64) & _POSITION)
    width = 1
    while width < w:                     # smallest of w neighbours, by doubling
        step = min(width, w - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    own = np.maximum(np.diff(first) - window + 1, 0)       # windows of each document
    start = np.arange(own.sum()) + np.repeat(first[:-1] - np.cumsum(own) + own, own)
    at = (low[start] & _POSITION).astype(np.int64)
    if len(kmer) > int(_POSITION):       # longer than the place bits: the rest follows from the window's own place
        at += ((start - at + int(_POSITION)) >> 24) << 24
    return start, at, kmer


def _word_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, h, first = words(data, off)
    return h, first


def _nodes(window: int, node: int):
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                units, first = _word_units(data, off)
                _, at, kmer = window_nodes(units, first, window, node)
                at = at[np.flatnonzero(np.diff(at, prepend=-1) != 0)]
                doc = np.searchsorted(first, at, side="right") - 1
                same = doc[1:] == doc[:-1]
                edge = span_hashes(units, at[:-1], at[1:] + node) | np.uint64(1) if len(at) > 1 else np.zeros(0, np.uint64)
                edge[~same] = 0
                zero = np.zeros(min(1, len(at)), np.uint64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id").take(pa.array(doc)), "key": rows.column("key").take(pa.array(doc)),
                    "at": pa.array(at - first[doc], pa.int32()), "node": pa.array(kmer[at].view(np.int64)),
                    "into": pa.array(np.concatenate([zero, edge]).view(np.int64)), "out": pa.array(np.concatenate([edge, zero]).view(np.int64))})
    return run


_PIECES = "doc_id long, key long, spans array<int>, hashes array<long>, starts array<int>"


def _pieces(window: int, node: int):
    """Of each document with repeated nodes: spans that go, and windows still to be verified."""
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                units, first = _word_units(data, off)
                out: dict[str, list] = {"spans": [], "hashes": [], "starts": []}
                for d in range(rows.num_rows):
                    own = units[first[d]: first[d + 1]]
                    known = rows.column("known")[d].values
                    place = known.field("at").to_numpy()
                    order = np.argsort(place, kind="stable")
                    place = place[order]
                    fact = [known.field(c).to_numpy(zero_copy_only=False)[order] for c in ("gone", "one_out", "one_into")]
                    new = np.diff(place, prepend=-1) != 0             # a repeated row gives its nodes twice
                    place, (gone, one_out, one_into) = place[new], [f[new] for f in fact]
                    start, at, _ = window_nodes(own, np.array([0, len(own)]), window, node)
                    every = at[np.flatnonzero(np.diff(at, prepend=-1) != 0)]
                    follows = np.zeros(len(place), bool)              # the node before is the one before in the document
                    rank = np.searchsorted(every, place)
                    follows[1:] = (np.diff(rank) == 1) & one_out[:-1] & one_into[1:]
                    path = np.cumsum(~follows) - 1
                    begin = place[~follows]
                    end = place[np.append(np.flatnonzero(~follows)[1:] - 1, len(place) - 1)] + node
                    i = np.searchsorted(place, at)
                    i = np.minimum(i, len(place) - 1)
                    met = place[i] == at                              # windows whose node is repeated
                    start, i = start[met], i[met]
                    inside = (start >= begin[path[i]]) & (start + window <= end[path[i]])
                    drop_ = start[inside & gone[i]]
                    edge = start[~inside]
                    out["spans"].append(_runs(drop_, window))
                    out["hashes"].append(span_hashes(own, edge, edge + window).view(np.int64) if len(edge) else np.zeros(0, np.int64))
                    out["starts"].append(edge.astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": rows.column("doc_id"), "key": rows.column("key"), "spans": pa.array(out["spans"], pa.list_(pa.int32())),
                    "hashes": pa.array(out["hashes"], pa.list_(pa.int64())), "starts": pa.array(out["starts"], pa.list_(pa.int32()))})
    return run


def _runs(start: np.ndarray, window: int) -> np.ndarray:
    """start, end, start, end ... of the union of windows."""
    if not len(start):
        return np.zeros(0, np.int32)
    cut = np.flatnonzero(np.diff(start) > window)
    return np.stack([start[np.append(0, cut + 1)], start[np.append(cut, len(start) - 1)] + window], axis=1).reshape(-1).astype(np.int32)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key): the key tells rows of one doc_id apart by their text."""
    return columns(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("text"))


def with_facts(texts: DataFrame, facts: DataFrame, how: str) -> DataFrame:
    """``texts`` joined with ``facts`` on (doc_id, key), moving only the texts that have facts.

    how "inner": those texts only; "left": all, the others with nulls.
    """
    n = facts.count()
    if n > BROADCAST_KEYS:
        return texts.join(facts, ["doc_id", "key"], how)
    keys = F.broadcast(facts.select("doc_id", "key"))
    some = texts.join(keys, ["doc_id", "key"], "left_semi").join(facts.hint("shuffle_merge"), ["doc_id", "key"])
    if how == "inner":
        return some
    return some.unionByName(texts.join(keys, ["doc_id", "key"], "left_anti"), allowMissingColumns=True)


def repeated_spans(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """(doc_id, key, spans, starts): words of repeated windows, as runs and as single windows.

    A window goes when its words also start in a document of smaller doc_id.
    Rows of one doc_id never remove from each other; a null doc_id neither
    removes nor is removed; null, empty and shorter texts have no window.
    """
    texts = keyed(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    nodes = save(texts.mapInArrow(_nodes(window, node), "doc_id long, key long, at int, node long, into long, out long"), "nodes")
    repeated = save(nodes.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
                                              (F.min("out") == F.max("out")).alias("same_out"), (F.min("into") == F.max("into")).alias("same_into"))
                    .filter("least <> most").select("node", "least", "same_out", "same_into"), "repeated")
    known = save(nodes.join(repeated, "node").groupBy("doc_id", "key").agg(F.collect_list(F.struct(
        "at", (F.col("least") < F.col("doc_id")).alias("gone"), (F.col("same_out") & (F.col("out") != 0)).alias("one_out"),
        (F.col("same_into") & (F.col("into") != 0)).alias("one_into"))).alias("known")), "known")
    drop(nodes, repeated)
    pieces = save(with_facts(texts, known, "inner").select("doc_id", "key", "text", "known")
                  .mapInArrow(_pieces(window, node), _PIECES), "pieces")
    drop(known)
    edges = pieces.select("doc_id", "key", F.explode(F.arrays_zip("hashes", "starts")).alias("w")).select("doc_id", "key", "w.hashes", "w.starts")
    least = save(edges.groupBy("hashes").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                 .filter("least <> most").select("hashes", "least"), "least")
    verified = (edges.join(least, "hashes").filter("least < doc_id").groupBy("doc_id", "key").agg(F.collect_set("starts").alias("starts")))
    spans = pieces.filter("size(spans) > 0").select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    return spans.join(verified, ["doc_id", "key"], "full")


def _kept(window: int):
    def run(batches):
        for batch in batches:
            n, removed, digest = [], [], []
            for text, spans, starts in zip(batch.column("text"), batch.column("spans"), batch.column("starts")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                w = raw.split()                                # on exactly space and 0x09-0x0D
                gone = np.zeros(len(w) + 1, np.int32)
                for s, e in (spans.values.to_numpy().reshape(-1, 2) if spans.is_valid else ()):
                    gone[s] += 1
                    gone[e] -= 1
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone[:-1]) > 0
                n.append(len(w))
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join(w if not removed[-1] else [x for x, g in zip(w, gone.tolist()) if not g])).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                                              "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())})
    return run


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once repeated 50-word windows are gone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(docs)


def digest(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``.

    Null and empty texts have no words; rows that repeat, or share an id, each
    get their row and never remove from each other; an empty table gives an
    empty table; a very long text is a slice of its own; other columns are dropped.
    """
    found = save(repeated_spans(docs, window, node), "found")
    return (with_facts(keyed(docs), found, "left").select("doc_id", "text", "spans", "starts")
            .mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string"))
