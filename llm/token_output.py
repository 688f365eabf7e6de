"""Token-ID output: documents as compressed id streams, and their reading.

Documents are ordered by doc_id in range partitions; each partition (a shard)
tokenises its texts and writes frames.  A frame is a row that holds whole,
consecutive documents - about FRAME ids, or one document that is longer - as
blocks of the adaptive range coder, each reset and checksummed on its own, with
the documents' ids and lengths.  Frames are Parquet rows in a folder, written
under Spark's commit protocol; any frame can be read without the others.
The offset of a shard is the number of ids of all shards before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.range_coder import BLOCK, decode, encode
from llm.scratch import columns, folder
from llm.text import SLICE_BYTES, _BYTE_CODE, _LOWER, _WHITE, slices, span_hashes

#: Ids of a frame, blocks coded side by side, ids of the words that a worker remembers.
FRAME, LANES, REMEMBERED = 1 << 20, 1024, 8_000_000
#: The same for the pipeline's stage, whose executors hold the memory of the stages before; and bytes of its slices.
STAGE_LANES, STAGE_REMEMBERED, STAGE_SLICE = 512, 1_000_000, 1 << 18

FRAMES = "shard int, frame int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, blocks array<binary>"

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,"]] = True


class Words:
    """Ids of chunks of text that a tokenizer never joins with their neighbours.

    ``by_word`` says that the tokenizer drops white space and lower-cases, so
    that a text's ids are those of its words in turn; each word is then encoded
    once and remembered.  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered

        self.tokenizer = Tokenizer.from_file(path)
        probe = ["Aa b, c.", "É́x  'S don't 12kg\n\tZz."]
        self.by_word = all(self._ids(p) == [i for w in p.split() for i in self._ids(w)] and self._ids(p) == self._ids(p.lower()) for p in probe)
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        # Of each word, in the order of their hashes: where its ids begin, and how many they are.
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _chunks(self, data: np.ndarray, off: np.ndarray):
        """Word chunks; a full stop or comma that ends a word of letters is one of its own."""
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_WHITE[data]
        cut = np.zeros(n + 1, bool)               # at byte i a new chunk may begin
        cut[off[:-1][off[:-1] < n]] = True
        if n > 1:
            last = ~inside[2:]                    # byte i is the last of its word ...
            last[off[1:-1][off[1:-1] > 0] - 1] = True
            mark = _MARK[data] & last[:n]
            mark[1:] &= _LETTER[data[:-1]]
            mark[0] = False
            cut[np.flatnonzero(mark)] = True
        opens = inside[1:] & (~inside[:-1] | cut)
        start = np.flatnonzero(opens[:n])
        word_end = np.flatnonzero(inside[:-1] & ~inside[1:])
        end = word_end[np.searchsorted(word_end, start, side="right")] if len(start) else start
        end = np.minimum(end, np.append(start[1:], n)) if len(start) else end
        return start, end, np.searchsorted(start, off)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a slice, ids of each)."""
        if not self.by_word:
            raw = data.tobytes()
            got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch(
                [raw[a:b].decode() for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)]
            return np.concatenate([*got, np.zeros(0, np.uint32)]), np.array([len(x) for x in got], np.int64)
        if len(self.flat) > self.remembered:
            self.forget()
        start, end, first = self._chunks(data, off)
        plain = _LOWER[data] if not (data == ord("<")).any() else data   # a special token is written in one case only
        code, unique = pd.factorize(span_hashes(_BYTE_CODE[plain], start, end)) if len(start) else (start, start.astype(np.uint64))
        at = np.searchsorted(self.hashes, unique)
        new = np.flatnonzero((at == len(self.hashes)) | (np.append(self.hashes, np.uint64(0))[at] != unique))
        if len(new):
            one = np.zeros(len(unique), np.int64)
            one[code[::-1]] = np.arange(len(code))[::-1]
            raw = plain.tobytes()
            self._learn(unique[new], [raw[start[one[k]]: end[one[k]]].decode() for k in new.tolist()])
            at = np.searchsorted(self.hashes, unique)
        begin, size = self.begin[at][code], self.size[at][code].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - sums[:-1], size) + np.arange(sums[-1])]
        return ids, np.diff(sums[first])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        letters = [k for k, w in enumerate(words) if w.isalpha()]
        ids: list = [None] * len(words)
        for a in range(0, len(letters), 500):     # one text of words of letters: one piece each
            part = letters[a: a + 500]
            x = self.tokenizer.encode_batch([" ".join(words[k] for k in part)], add_special_tokens=False)[0]
            piece = np.array(x.word_ids, np.int64)
            if len(piece) and piece[-1] + 1 == len(part):
                edges = np.searchsorted(piece, np.arange(len(part) + 1))
                got = x.ids
                for j, k in enumerate(part):
                    ids[k] = got[edges[j]: edges[j + 1]]
        rest = [k for k in range(len(words)) if not ids[k]]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            ids[k] = x.ids
        size = np.array([len(x) for x in ids], np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        begin = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
        self.hashes, self.begin, self.size = (np.insert(old, at, own[order]) for old, own in
                                              ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])


_words: dict[tuple, Words] = {}                   # of this Python worker, by tokenizer file


def _frames(path: str, end_id: int | None, lanes: int = LANES, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES):
    def run(batches):
        if (path, remembered) not in _words:
            _words[path, remembered] = Words(path, remembered)
        words, shard = _words[path, remembered], TaskContext.get().partitionId()
        at = frame = 0
        docs: list[int | None] = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        held = 0
        queue: list[tuple] = []

        def closed():
            nonlocal docs, sizes, parts, held, at, frame
            ids = np.concatenate([*parts, np.zeros(0, np.uint32)])
            queue.append((frame, at, docs, sizes, [ids[k: k + BLOCK] for k in range(0, len(ids), BLOCK)]))
            at, frame = at + len(ids), frame + 1
            docs, sizes, parts, held = [], [], [], 0

        def coded() -> Iterator[pa.RecordBatch]:
            blocks = encode([b for q in queue for b in q[4]])
            for number, first, ids, n, own in queue:
                mine, blocks = blocks[: len(own)], blocks[len(own):]
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard], pa.int32()), "frame": pa.array([number], pa.int32()), "first": pa.array([first], pa.int64()),
                    "n_ids": pa.array([sum(n)], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                    "n_tokens": pa.array([n], pa.list_(pa.int64())), "blocks": pa.array([mine], pa.list_(pa.binary()))})
            queue.clear()

        for batch in batches:
            for rows, data, off in slices(batch, limit=slice_bytes):
                ids, n = words.encode(data, off)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    n = n + 1
                to = np.cumsum(n)
                for doc, size, b in zip(rows.column("doc_id").to_pylist(), n.tolist(), to.tolist()):
                    docs.append(doc), sizes.append(size), parts.append(ids[b - size: b])
                    held += size
                    if held >= FRAME:
                        closed()
                if sum(len(q[4]) for q in queue) >= lanes:
                    yield from coded()
        if docs:
            closed()
        yield from coded()
    return run


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 2, lanes: int = LANES, remembered: int = REMEMBERED,
              slice_bytes: int = SLICE_BYTES) -> None:
    """Frames of ``docs`` (doc_id, text) in ``path``, in ascending doc_id order, nulls first.

    Null text is empty; every document gets ``end_id`` at its end.  Rows that
    share a doc_id are each written, next to each other, by text.
    """
    (columns(docs, doc_id="long", text="string").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(_frames(tokenizer, end_id, lanes, remembered, slice_bytes), FRAMES).write.parquet(path))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames with start, the number of ids before the frame in the whole stream."""
    frames = spark.read.schema(FRAMES).parquet(path)
    # One row a shard; as many as the writing job had partitions.
    before = (frames.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .withColumn("before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")))
    return frames.join(F.broadcast(before.select("shard", "before")), "shard").withColumn("start", F.col("before") + F.col("first")).drop("before")


def _decoded(make, lanes: int = LANES):
    """Run ``make(rows, ids of each row)`` over frames, ``lanes`` blocks or more at a time."""
    def run(batches):
        rows: list[dict] = []
        waiting = 0

        def out():
            blocks = decode([b for r in rows for b in r["blocks"]])
            for r in rows:
                mine, blocks = blocks[: len(r["blocks"])], blocks[len(r["blocks"]):]
                yield make(r, np.concatenate([*mine, np.zeros(0, np.uint32)]))
            rows.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                rows.append(batch.slice(k, 1).to_pylist()[0])
                waiting += len(rows[-1]["blocks"])
                if waiting >= lanes:
                    yield from out()
                    waiting = 0
        if rows:
            yield from out()
    return run


def _digest(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    n = np.array(row["n_tokens"], np.int64)
    to = np.cumsum(n)
    raw = ids.astype("<u4").tobytes()
    crc = [zlib.crc32(raw[4 * (b - size): 4 * b]) for b, size in zip(to.tolist(), n.tolist())]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + to - n),
                                       "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())})


def _whole(row: dict, ids: np.ndarray) -> pa.RecordBatch:
    to = np.cumsum(row["n_tokens"])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(row["doc_ids"], pa.int64()),
        "ids": pa.array([ids[b - n: b] for b, n in zip(to, row["n_tokens"])], pa.list_(pa.int64()))})


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document of the frames in ``path``."""
    return read_frames(spark, path).mapInArrow(_decoded(_whole), "doc_id long, ids array<long>")


def digests(spark: SparkSession, path: str, lanes: int = LANES) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""
    return read_frames(spark, path).mapInArrow(_decoded(_digest, lanes), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _written(spark: SparkSession, docs: DataFrame, lanes: int = LANES, remembered: int = REMEMBERED, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    import public_tokenizers

    path = folder(spark, "ids")
    write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path, lanes=lanes, remembered=remembered, slice_bytes=slice_bytes)
    return digests(spark, path, lanes)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the written id stream."""
    return _written(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The id stream of what reached this stage."""
    return _written(spark, docs, STAGE_LANES, STAGE_REMEMBERED, STAGE_SLICE)
