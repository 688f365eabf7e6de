"""Cross-tokenizer alignment with external spill counting of linked id pairs.

Two tokenizers (A and B) encode space + text.  Byte offsets at which tokens of
both end cut the tokens into groups; the tokens that end there are linked.  How
often a pair of ids is linked in the whole corpus, and whether no other pair of
its B id is linked more often, goes back to every document.

1. Every task gathers its links as 64-bit records (radix of B, B, A, document)
   until SPILL of them are held, sorts them, and writes a set: for each radix a
   run of zstd frames with the counts of its pairs, and beside it the documents
   of each pair.  Links of a pair in a set are one count, so a pair or a B id
   that holds a third of all links costs a set one entry a pair.
2. Runs of a radix are merged by a heap over their frames' ends, FAN at a time,
   level by level.  B ids come in order, so the last level knows each B id's
   highest count when its pairs have passed.
3. Contributions stream back the same way: a radix's counts answer each of its
   runs, entry by entry, and every set adds its answers up by document.  What
   documents hold never moves by pair, only by set, which SPILL bounds.

All that is written stands in the shared folder as Parquet rows; a lost
executor costs its running tasks.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import columns, drop, folder, save
from llm.text import slices

#: Links and documents of a set, radixes, runs merged at a time, pairs of a frame.
SPILL, SET_DOCS, RADIXES, FAN, FRAME = 1 << 21, 1 << 16, 256, 64, 1 << 14

_DOC = np.uint64((1 << 24) - 1)

# Fixed value: the published word pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Other characters than these are left to the tokenizer's own reading of the pattern.
_COMMON = re.compile(r"[^\t-\r -~¡-ɏ]")


def _byte_letters() -> dict[str, int]:
    """Byte of each letter of byte-level entries: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """A tokenizer file: ids of texts, and the bytes of every id."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            entries = self._byte_level(path)
        else:
            entries = self._pieces(path)
        self.size = np.array([len(e) for e in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def _pieces(self, path: str) -> list[bytes]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.encode = lambda texts: model.encode(texts, num_threads=1)      # which adds the space by itself
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]

    def _byte_level(self, path: str) -> list[bytes]:
        from tokenizers import Tokenizer

        letter = _byte_letters()
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        entries = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]))
        for t in model["added_tokens"]:
            entries[t["id"]] = t["content"].encode()
        for word, i in vocab.items():
            entries[i] = bytes(letter[c] for c in word) if all(c in letter for c in word) else word.encode()

        def plain(texts: list[str]) -> list[list[int]]:
            return [x.ids for x in tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

        self.encode = plain
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        pre = model["pre_tokenizer"] or {}
        ranked = (model["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                  and all(vocab.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges)))
        if not ranked:
            return entries
        import tiktoken

        # Ids are in order of the merges: the same vocabulary as ranks, which a faster encoder reads.
        ranks = {entries[i]: i for i in vocab.values()}
        fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def mixed(texts: list[str]) -> list[list[int]]:
            out = [None if _COMMON.search(t) else fast.encode_ordinary(" " + t) for t in texts]
            odd = [k for k, x in enumerate(out) if x is None]
            for k, x in zip(odd, plain([texts[k] for k in odd])):
                out[k] = x
            return out

        self.encode = mixed
        return entries

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, joined."""
        size = self.size[ids]
        to = np.cumsum(size)
        return self.flat[np.repeat(self.begin[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]


_tokens: dict[str, Tokens] = {}                  # of this Python worker, by file


def _load(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def _joined(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Aligned:
    """The tokens of a slice of texts in both tokenizers, cut into groups."""

    def __init__(self, a: Tokens, b: Tokens, data: np.ndarray, off: np.ndarray):
        raw, length = data.tobytes(), np.diff(off)
        self.docs = len(length)
        full = np.flatnonzero(length > 0)
        texts = [raw[off[k]: off[k + 1]].decode() for k in full]
        want = np.insert(data, off[full], 0x20)
        length = length[full] + 1
        sides = []
        for side in (a, b):
            ids, n = _joined(side.encode(texts))
            total = np.add.reduceat(np.append(side.size[ids], 0), np.cumsum(n) - n) * (n > 0) if len(n) else n
            sides.append([ids, n, total])
        good = (sides[0][2] == length) & (sides[1][2] == length)
        want = self._keep(good, length, want, sides)
        full, length = full[good], length[good]
        odd = np.zeros(len(full), bool)
        for side, (ids, _, _) in zip((a, b), sides):
            wrong = np.flatnonzero(side.spelled(ids) != want)
            odd[np.searchsorted(np.cumsum(length), wrong, side="right")] = True
        if odd.any():
            self._keep(~odd, length, want, sides)
            full, length = full[~odd], length[~odd]
        (self.a, na, _), (self.b, nb, _) = sides
        edge = np.cumsum(length)
        self.end_a, self.end_b = np.cumsum(a.size[self.a]), np.cumsum(b.size[self.b])
        # By byte: whether tokens of both sides end there, and how many such places come before.
        ends = [np.zeros(len(want) + 1, bool) for _ in sides]
        ends[0][self.end_a] = ends[1][self.end_b] = True
        self.cut = ends[0] & ends[1]
        self.cuts = np.flatnonzero(self.cut)
        spread = lambda n: np.bincount(full, n, self.docs).astype(np.int64)
        self.n_a, self.n_b = spread(na), spread(nb)
        self.doc_of = lambda ends: full[np.searchsorted(edge, ends)]
        self.n_groups = np.bincount(self.doc_of(self.cuts), minlength=self.docs)

    @staticmethod
    def _keep(good: np.ndarray, length: np.ndarray, want: np.ndarray, sides: list) -> np.ndarray:
        if not good.all():
            for s in sides:
                s[0], s[1] = s[0][np.repeat(good, s[1])], s[1][good]
            want = want[np.repeat(good, length)]
        return want

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(A id, B id, document) of every pair of tokens that end together."""
        at_a, at_b = np.flatnonzero(self.cut[self.end_a]), np.flatnonzero(self.cut[self.end_b])
        ends, others = self.end_a[at_a], self.end_b[at_b]
        if len(at_a) != len(self.cuts) or len(at_b) != len(self.cuts):      # tokens without bytes end where another does
            low = np.searchsorted(others, ends, side="left")
            n = np.searchsorted(others, ends, side="right") - low
            to = np.cumsum(n)
            at_b = at_b[np.repeat(low - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
            at_a, ends = np.repeat(at_a, n), np.repeat(ends, n)
        return self.a[at_a], self.b[at_b], self.doc_of(ends)

    def groups(self) -> list[bytes]:
        """Per document a1,a2|b1;a3|b2,b3 ... - the ids of its groups; empty without tokens."""
        before = np.cumsum(self.cut) - self.cut
        group_a, group_b = before[self.end_a], before[self.end_b]
        to_a, to_b = (np.cumsum(np.bincount(g, minlength=len(self.cuts))) for g in (group_a, group_b))
        from_b = np.append(0, to_b[:-1]) if len(to_b) else to_b
        ids = np.empty(len(self.a) + len(self.b), np.int64)
        ids[np.arange(len(self.a)) + from_b[group_a]] = self.a
        ids[np.arange(len(self.b)) + to_a[group_b]] = self.b
        flat, begin, size = _decimals(int(ids.max(initial=0)) + 1)
        size = size[ids]
        to = np.cumsum(size)
        text = flat[np.repeat(begin[ids] - (to - size), size) + np.arange(to[-1] if len(to) else 0)]
        text[to[from_b + to_a - 1] - 1] = ord("|")
        text[to[to_b + to_a - 1] - 1] = ord(";")
        edge = np.append(0, np.append(0, to)[np.cumsum(self.n_a + self.n_b)])
        raw = text.tobytes()
        return [raw[x: max(x, y - 1)] for x, y in zip(edge[:-1].tolist(), edge[1:].tolist())]


_written: list = [np.zeros(0, np.uint8)] + [np.zeros(0, np.int64)] * 2


def _decimals(n: int) -> list[np.ndarray]:
    """(bytes, begin, size) of the decimal numbers below n, each with a comma."""
    if len(_written[1]) < n:
        words = [b"%d," % i for i in range(n)]
        size = np.array([len(w) for w in words], np.int64)
        _written[:] = [np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size]
    return _written


# ------------------------------------------------------------------ runs
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, byte by byte of their numbers (high bytes of small numbers vanish)."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(head + body)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1 + 5 * raw[0]
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<cI", raw, 1 + 5 * k)
        t = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += n * t.itemsize
    return out


def _run(keys: np.ndarray, sums: np.ndarray) -> list[bytes]:
    """Sorted pairs and their counts as frames."""
    out = []
    for a in range(0, len(keys), FRAME):
        k = keys[a: a + FRAME]
        out.append(_pack(k[:1], np.diff(k), sums[a: a + FRAME]))
    return out


def _frames(run: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for blob in run:
        first, steps, sums = _unpack(blob)
        yield np.cumsum(np.concatenate([first, steps]), dtype=np.uint64), sums


def merged(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of all runs in order, each once with its counts added up; a frame of each run is held at a time."""
    streams, heap, held = [_frames(r) for r in runs], [], {}

    def refill(r: int) -> None:
        frame = next(streams[r], None)
        held.pop(r, None)
        if frame is not None:
            held[r] = frame
            heapq.heappush(heap, (int(frame[0][-1]), r))

    for r in range(len(runs)):
        refill(r)
    while heap:
        bound, done, keys, sums = heap[0][0], [], [], []
        while heap and heap[0][0] == bound:       # these frames end here, no other ends before
            done.append(heapq.heappop(heap)[1])
        for r, (k, n) in held.items():
            cut = int(np.searchsorted(k, np.uint64(bound), side="right"))
            if cut:
                keys.append(k[:cut]), sums.append(n[:cut])
                held[r] = (k[cut:], n[cut:])
        for r in done:
            refill(r)
        keys, sums = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[first], np.add.reduceat(sums, first)


def _with_best(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, whether no pair of the same B id counts more); the last B id of a part waits for the next."""
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out(keys, sums):
        if not len(keys):
            return keys, sums, np.zeros(0, bool)
        side = keys >> np.uint64(16)
        first = np.append(True, side[1:] != side[:-1])
        most = np.maximum.reduceat(sums, np.flatnonzero(first))
        return keys, sums, sums == most[np.cumsum(first) - 1]

    for k, n in parts:
        keys, sums = np.concatenate([keys, k]), np.concatenate([sums, n])
        open_ = int(np.searchsorted(keys, (keys[-1] >> np.uint64(16)) << np.uint64(16)))
        if open_:
            yield out(keys[:open_], sums[:open_])
            keys, sums = keys[open_:], sums[open_:]
    if len(keys):
        yield out(keys, sums)


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SETS = f"set long, radix int, counts array<binary>, records binary, docs array<struct<{_DOCS.replace(' ', ':').replace(',:', ',')}>>"


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


_SETS = pa.schema([("set", pa.int64()), ("radix", pa.int32()), ("counts", pa.list_(pa.binary())), ("records", pa.binary()), ("docs", pa.list_(pa.struct(
    [(c.split()[0], pa.string() if "string" in c else pa.int64()) for c in _DOCS.split(", ")])))])


def _radix(b: np.ndarray) -> np.ndarray:
    """Radix of each B id: its number, well mixed."""
    return ((b.astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) >> np.uint64(24)


def _spilled(number: int, links: np.ndarray, docs: list[dict]) -> Iterator[pa.RecordBatch]:
    """A set: its documents, and a run for every radix that its links meet."""
    yield _batch([{"set": number, "radix": -1, "docs": docs}], _SETS)
    links = np.sort(links)
    new = np.flatnonzero(np.append(True, links[1:] != links[:-1])) if len(links) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(links))).astype(np.int64)
    keys, doc = links[new] >> np.uint64(24), (links[new] & _DOC).astype(np.uint32)
    pair = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else new
    sums = np.add.reduceat(times, pair) if len(pair) else times
    size = np.diff(np.append(pair, len(keys))).astype(np.uint32)
    keys = keys[pair]
    radix = (keys >> np.uint64(32)).astype(np.int64)
    edge = np.searchsorted(radix, np.arange(RADIXES + 1))
    starts = np.append(pair, len(doc))
    rows = []
    for r in np.flatnonzero(np.diff(edge)).tolist():
        x, y = edge[r], edge[r + 1]
        own = slice(starts[x], starts[y])
        rows.append({"set": number, "radix": r, "counts": _run(keys[x:y], sums[x:y]), "records": _pack(size[x:y], doc[own], times[own].astype(np.uint32))})
    if rows:
        yield _batch(rows, _SETS)


def _sets(path_a: str, path_b: str, spill: int):
    def run(batches):
        a, b = _load(path_a), _load(path_b)
        if len(a.size) > 1 << 16 or len(b.size) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 ids are supported")
        number = TaskContext.get().partitionId() << 32
        docs: list[dict] = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for rows, data, off in slices(batch):
                one = Aligned(a, b, data, off)
                id_a, id_b, doc = one.links()
                n_links = np.bincount(doc, minlength=one.docs)
                key = (_radix(id_b) << np.uint64(32)) | (id_b.astype(np.uint64) << np.uint64(16)) | id_a.astype(np.uint64)
                parts.append((key << np.uint64(24)) | (doc + len(docs)).astype(np.uint64))
                held += len(key)
                docs += [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), x)) for x in zip(
                    rows.column("doc_id").to_pylist(), one.n_a.tolist(), one.n_b.tolist(), one.n_groups.tolist(), n_links.tolist(),
                    [hashlib.sha256(g).hexdigest() if g else "" for g in one.groups()])]
                if held >= spill or len(docs) >= SET_DOCS:
                    yield from _spilled(number, np.concatenate(parts), docs)
                    number, docs, parts, held = number + 1, [], [], 0
        if docs:
            yield from _spilled(number, np.concatenate(parts), docs)
    return run


def _grouped(rows: Iterator[dict], *by: str) -> Iterator[list[dict]]:
    """Neighbouring rows that agree in ``by``."""
    group: list[dict] = []
    for row in rows:
        if group and any(row[c] != group[0][c] for c in by):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _collected(parts, frames: int = 1 << 6) -> Iterator[list[bytes]]:
    """Frames of merged parts, a few at a time."""
    out: list[bytes] = []
    keys, sums, n = [], [], 0
    for k, s in parts:
        keys.append(k), sums.append(s)
        n += len(k)
        if n >= FRAME:
            out += _run(np.concatenate(keys), np.concatenate(sums))
            keys, sums, n = [], [], 0
        if len(out) >= frames:
            yield out
            out = []
    if n:
        out += _run(np.concatenate(keys), np.concatenate(sums))
    if out:
        yield out


_LEVEL = pa.schema([("radix", pa.int32()), ("set", pa.int64()), ("part", pa.int32()), ("counts", pa.list_(pa.binary()))])


def _merge_level(batches):
    """One run for the runs of each (radix, set); a run's rows are its parts in order."""
    for group in _grouped(_rows(batches), "radix", "set"):
        runs = [sum((x["counts"] for x in g), []) for g in _grouped(iter(group), "old")]
        for part, frames in enumerate(_collected(merged(runs))):
            yield _batch([{"radix": group[0]["radix"], "set": group[0]["set"], "part": part, "counts": frames}], _LEVEL)


_TOTALS = pa.schema([("radix", pa.int32()), ("part", pa.int32()), ("totals", pa.binary())])


def _merge_last(batches):
    for group in _grouped(_rows(batches), "radix"):
        runs = [sum((x["counts"] for x in g), []) for g in _grouped(iter(group), "set")]
        for part, (keys, sums, best) in enumerate(_with_best(merged(runs))):
            yield _batch([{"radix": group[0]["radix"], "part": part, "totals": _pack(keys, sums, best)}], _TOTALS)


_ANSWERS = pa.schema([("set", pa.int64()), ("radix", pa.int32()), ("answer", pa.binary())])


def _answered(batches):
    """Counts of every run's pairs: a radix's totals come first, then its runs."""
    keys = sums = best = radix = None
    parts: list[list[np.ndarray]] = []
    for row in _rows(batches):
        if row["radix"] != radix:
            radix, keys, parts = row["radix"], None, []
        if row["totals"] is not None:
            parts.append(_unpack(row["totals"]))
            continue
        if keys is None:
            keys, sums, best = (np.concatenate(x) for x in zip(*parts))
        own = np.concatenate([k for k, _ in _frames(row["counts"])])
        at = np.searchsorted(keys, own)
        yield _batch([{"set": row["set"], "radix": radix, "answer": _pack(sums[at], best[at])}], _ANSWERS)


RESULT = f"{_DOCS.rsplit(', ', 1)[0]}, n_best long, count_sum long, groups_sha256 string"


def _added(batches):
    """Documents of every set with the answers to their links."""
    for group in _grouped(_rows(batches), "set"):
        docs = group[0]["docs"]
        best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for answer, run in zip(group[1::2], group[2::2]):
            sums, top = _unpack(answer["blob"])
            size, doc, times = _unpack(run["blob"])
            times = times.astype(np.int64)
            np.add.at(total, doc, times * np.repeat(sums, size))
            np.add.at(best, doc, times * np.repeat(top, size))
        out = {c: [d[c] for d in docs] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in out.items()} | {
            "n_best": pa.array(best), "count_sum": pa.array(total), "groups_sha256": pa.array([d["groups_sha256"] for d in docs], pa.string())})


def _in_order(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def align(docs: DataFrame, path_a: str, path_b: str, spill: int = SPILL, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(documents, totals) of the alignment of ``docs`` (doc_id, text) in two tokenizers.

    documents has a row for each row of ``docs``: n_a, n_b, n_groups, n_links,
    n_best, count_sum, groups_sha256.  A text that is null, empty or not spelled
    exactly by the tokens of both sides has no tokens: zeros and ''.  Null, tied
    or repeated ids give a row each; other columns are dropped; an empty table
    gives empty results.  A very long text is a slice of its own.  ``totals``
    holds packed counts, see ``pairs``.  Ties for a B id's highest count all
    count as best.
    """
    spark = docs.sparkSession
    path = folder(spark, "sets")
    columns(docs, doc_id="long", text="string").mapInArrow(_sets(path_a, path_b, spill), SETS).write.parquet(path)
    sets = spark.read.schema(SETS).parquet(path)
    runs = sets.filter("radix >= 0").select("radix", "set", "counts")
    n_sets = sets.filter("radix < 0").count()

    level, own, n = runs.withColumn("part", F.lit(0)), None, n_sets
    while n > fan:
        n = -(-n // fan)
        wide = level.withColumnRenamed("set", "old").withColumn("set", F.pmod(F.xxhash64("old"), F.lit(n)))
        level = save(_in_order(wide, ["radix", "set"], ["old", "part"]).mapInArrow(_merge_level, "radix int, set long, part int, counts array<binary>"), "level")
        if own is not None:
            drop(own)
        own = level
    totals = save(_in_order(level, ["radix"], ["set", "part"]).mapInArrow(_merge_last, "radix int, part int, totals binary"), "totals")
    if own is not None:
        drop(own)

    # Runs of a radix are dealt to several tasks where there are many; its totals go to each.
    tasks = max(1, -(-n_sets // fan))
    asked = runs.select("radix", F.pmod(F.xxhash64("set"), F.lit(tasks)).alias("task"), "set", F.lit(-1).alias("part"), "counts", F.lit(None).cast("binary").alias("totals"))
    known = totals.select("radix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))).alias("task"), F.lit(-1).cast("long").alias("set"), "part",
                          F.lit(None).cast("array<binary>").alias("counts"), "totals")
    answers = _in_order(known.unionByName(asked), ["radix", "task"], ["set", "part"]).mapInArrow(_answered, "set long, radix int, answer binary")

    none = F.lit(None)
    back = (sets.select("set", "radix", F.lit(1).alias("kind"), F.col("records").alias("blob"), "docs")
            .unionByName(answers.select("set", "radix", F.lit(0).alias("kind"), F.col("answer").alias("blob"), none.cast(sets.schema["docs"].dataType).alias("docs"))))
    return _in_order(back, ["set"], ["radix", "kind"]).mapInArrow(_added, RESULT), totals


def _unpacked(batches):
    for row in _rows(batches):
        keys, sums, best = _unpack(row["totals"])
        yield pa.RecordBatch.from_pydict({"b": pa.array(((keys >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)), "a": pa.array((keys & np.uint64(0xFFFF)).astype(np.int64)),
                                          "links": pa.array(sums), "best": pa.array(best.astype(bool))})


def pairs(totals: DataFrame) -> DataFrame:
    """(b, a, links, best) of every pair of ids that any document links."""
    return totals.mapInArrow(_unpacked, "b long, a long, links long, best boolean")


def _group_texts(path_a: str, path_b: str):
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id").cast(pa.int64()), "groups": pa.array(
                    [g.decode() for g in Aligned(_load(path_a), _load(path_b), data, off).groups()], pa.string())})
    return run


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): the groups of every document as text, a1,a2|b1;a3|b2,b3."""
    return columns(docs, doc_id="long", text="string").mapInArrow(_group_texts(path_a, path_b), "doc_id long, groups string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and corpus counts of every document's tokens in two public tokenizers."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
