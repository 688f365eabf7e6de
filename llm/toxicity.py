"""Toxicity by a linear-chain conditional random field over words.

Two states, clean and toxic.  A word's score for the toxic state is a bias and
the weights of its hashed features (the word without case and end marks, its
first four and its first five bytes); transitions tie neighbours together.
Training words are labelled from document labels: a feature that nearly only
occurs in toxic documents (lower confidence bound of that share) marks the
words that have it, in toxic documents.  The field is fitted to such labelled
sequences, a logistic curve to the documents' summed marginals.

A text is one chain, however long.  Its forward and backward passes run over
pieces of SEQUENCE words side by side: the transfer matrix of every piece comes
first, their products carry the state from piece to piece, and the passes
within the pieces start from it.  The marginals add up to a document's score,
and runs of toxic words give the offending offsets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import columns, save
from llm.text import _BYTE_CODE, _LOWER, slices, span_hashes, words

#: Labelled documents and sequences that the field is fitted on, at most (chosen by hashes).
FIT_DOCS, FIT_SEQUENCES = 30_000, 4_000
SEQUENCE, BUCKETS = 128, 1 << 16
#: A feature marks toxic words from this lower bound (so many standard deviations) of its share of toxic documents.
MARK_FROM, DEVIATIONS = 0.5, 2.5
#: A document is toxic from this score; a word is in a span from this marginal.
TOXIC_FROM, SPAN_FROM = 0.3, 0.5
STEPS, RIDGE = 80, 1e-4

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True


def word_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, three feature hashes of each word, first word of each document)."""
    start, end, _, first = words(data, off)
    if not len(start):
        return start, end, np.zeros((3, 0), np.uint64), first
    core = end.copy()
    for _ in range(3):
        core -= _END[data[core - 1]] & (core - 1 > start)
    codes = _BYTE_CODE[_LOWER[data]]
    kinds = [span_hashes(codes, start, np.minimum(core, start + n) if n else core) + np.uint64(n) for n in (0, 4, 5)]
    return start, end, np.stack(kinds), first


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _lattice(score: np.ndarray, length: np.ndarray, move: np.ndarray, with_pairs: bool = False, start: np.ndarray | None = None, stop: np.ndarray | None = None):
    """Marginals of the toxic state, for sequences in rows of ``score`` sorted longest first.

    move: log weights of (clean, clean), (clean, toxic), (toxic, clean), (toxic, toxic).
    start, stop: messages of the two states from before and behind each row (clean before a text, none behind it).
    """
    n, steps = score.shape
    e = np.exp(np.clip(score.T, -20, 20))
    t00, t01, t10, t11 = np.exp(move)
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    a = np.zeros((steps, 2, n))
    b = np.ones((steps, 2, n))
    if stop is not None and n:
        b[length - 1, :, np.arange(n)] = stop
    before = (np.full(n, 0.5), np.zeros(n)) if start is None else (start[:, 0], start[:, 1])
    for t in range(steps):
        k = active[t]
        p0, p1 = (a[t - 1, 0, :k], a[t - 1, 1, :k]) if t else (before[0][:k], before[1][:k])
        x0 = p0 * t00 + p1 * t10
        x1 = (p0 * t01 + p1 * t11) * e[t, :k]
        z = x0 + x1
        a[t, 0, :k], a[t, 1, :k] = x0 / z, x1 / z
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        y0, y1 = b[t + 1, 0, :k], b[t + 1, 1, :k] * e[t + 1, :k]
        x0, x1 = t00 * y0 + t01 * y1, t10 * y0 + t11 * y1
        z = x0 + x1
        b[t, 0, :k], b[t, 1, :k] = x0 / z, x1 / z
    both = a * b
    p = (both[:, 1] / np.maximum(both.sum(1), 1e-300)).T
    if not with_pairs:
        return p
    pairs = np.zeros(4)
    for t in range(1, steps):
        k = active[t]
        a0, a1 = a[t - 1, :, :k]
        b0, b1 = b[t, 0, :k], b[t, 1, :k] * e[t, :k]
        x = np.stack([a0 * b0 * t00, a0 * b1 * t01, a1 * b0 * t10, a1 * b1 * t11])
        pairs += (x / x.sum(0)).sum(1)
    return p, pairs


def _transfer(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """(n, 2, 2): weights from the state before each whole row of ``score`` to the state at its end, up to a factor."""
    e = np.exp(np.clip(score.T, -20, 20))
    (t00, t01), (t10, t11) = np.exp(move).reshape(2, 2)
    m = np.broadcast_to(np.eye(2), (len(score), 2, 2)).copy()
    for own in e:
        x0 = m[:, :, 0] * t00 + m[:, :, 1] * t10
        x1 = (m[:, :, 0] * t01 + m[:, :, 1] * t11) * own[:, None]
        z = (x0 + x1).sum(1)
        m[:, :, 0], m[:, :, 1] = x0 / z[:, None], x1 / z[:, None]
    return m


def marginals(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Toxic marginal of every word of a slice; document d is the chain of words first[d] .. first[d + 1] - 1."""
    out = np.zeros(len(score))
    count = np.diff(first)
    pieces = -(-count // SEQUENCE)
    doc = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[doc] + nth * SEQUENCE
    length = np.minimum(SEQUENCE, first[doc + 1] - begin) if len(doc) else begin
    start, stop = np.tile([0.5, 0.0], (len(doc), 1)), np.ones((len(doc), 2))
    more = np.flatnonzero(np.append(nth[1:] > 0, False)) if len(doc) else doc     # pieces with another behind them: whole ones
    if len(more):
        # The last piece of a long text is short, or whole; its matrix is wanted too, by the message from behind.
        inner = np.unique(np.concatenate([more, more + 1]))
        matrix = np.zeros((len(doc), 2, 2))
        for n in np.unique(length[inner]):
            same = inner[length[inner] == n]
            for k in range(0, len(same), 4096):
                rows = same[k: k + 4096]
                matrix[rows] = _transfer(score[begin[rows][:, None] + np.arange(n)], move)
        for step in range(1, int(nth.max()) + 1):
            at = np.flatnonzero(nth == step)
            v = np.einsum("ni,nij->nj", start[at - 1], matrix[at - 1])
            start[at] = v / v.sum(1, keepdims=True)
        for step in range(int(nth.max()) - 1, -1, -1):
            at = more[nth[more] == step]
            v = np.einsum("nij,nj->ni", matrix[at + 1], stop[at + 1])
            stop[at] = v / v.sum(1, keepdims=True)
    order = np.argsort(-length, kind="stable")
    for k in range(0, len(order), 4096):
        rows = order[k: k + 4096]
        at = begin[rows][:, None] + np.arange(length[rows[0]])
        inside = np.arange(length[rows[0]]) < length[rows][:, None]
        at = np.minimum(at, len(score) - 1)
        out[at[inside]] = _lattice(score[at], length[rows], move, start=start[rows], stop=stop[rows])[inside]
    return out


def _feature_counts(batches):
    """(feature, toxic documents, documents) of each slice."""
    for batch in batches:
        for rows, data, off in slices(batch):
            _, _, h, first = word_features(data, off)
            doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
            toxic = rows.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            key, of = h.reshape(-1), np.tile(doc, 3)
            order = np.lexsort((of, key))
            key, of = key[order], of[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            key, of = key[new], of[new]
            unique, inverse = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(unique.view(np.int64)), "toxic": pa.array(np.bincount(inverse, toxic[of], len(unique)).astype(np.int64)),
                "n": pa.array(np.bincount(inverse, minlength=len(unique)).astype(np.int64))})


def _sequences(marks: np.ndarray, share: float):
    """Feature buckets and labels of training sequences: those with marked words, and a share of the others."""
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                _, _, h, first = word_features(data, off)
                mark = np.zeros(h.shape[1], bool)
                if len(marks):
                    for kind in h:
                        mark |= marks[np.minimum(np.searchsorted(marks, kind), len(marks) - 1)] == kind
                bucket = _buckets(h)
                toxic = rows.column("toxic").to_pylist()
                ids, labels = [], []
                for d in range(rows.num_rows):
                    for a in range(first[d], first[d + 1], SEQUENCE):
                        b = min(a + SEQUENCE, first[d + 1])
                        y = mark[a:b] & bool(toxic[d])
                        pick = (int(h[0, a]) >> 11) % 10_000 / 10_000
                        if pick < (1.0 if y.any() else share):
                            ids.append(bucket[:, a:b].T.reshape(-1)), labels.append(y)
                yield pa.RecordBatch.from_pydict({"f": pa.array(ids, pa.list_(pa.int64())), "y": pa.array(labels, pa.list_(pa.bool_()))})
    return run


def fit_field(buckets: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(weights with the bias last, move) by gradient steps with per-weight rates on the log likelihood."""
    weight = np.zeros(BUCKETS + 1)
    weight[-1] = -4.0
    move = np.array([1.0, -1.0, 0.0, 0.0])
    if not buckets:
        return weight, move
    order = sorted(range(len(labels)), key=lambda k: -len(labels[k]))
    length = np.array([len(labels[k]) for k in order])
    steps = int(length[0])
    f = np.full((len(order), steps, 3), BUCKETS, np.int64)
    y = np.zeros((len(order), steps))
    for row, k in enumerate(order):
        f[row, : length[row]] = buckets[k].reshape(-1, 3)
        y[row, : length[row]] = labels[k]
    inside = np.arange(steps) < length[:, None]
    seen = np.array([((1 - y[:, :-1]) * (1 - y[:, 1:]) * inside[:, 1:]).sum(), ((1 - y[:, :-1]) * y[:, 1:] * inside[:, 1:]).sum(),
                     (y[:, :-1] * (1 - y[:, 1:]) * inside[:, 1:]).sum(), (y[:, :-1] * y[:, 1:] * inside[:, 1:]).sum()])
    m1, m2 = np.zeros(BUCKETS + 5), np.zeros(BUCKETS + 5)
    for step in range(1, STEPS + 1):
        own = np.where(f < BUCKETS, weight[np.minimum(f, BUCKETS - 1)], 0).sum(2) + weight[-1]
        p, pairs = _lattice(own, length, move, with_pairs=True)
        g = np.where(inside, y - p, 0.0)
        grad = np.zeros(BUCKETS + 5)
        grad[:BUCKETS] = np.bincount(f.reshape(-1), np.repeat(g.reshape(-1), 3), BUCKETS + 1)[:BUCKETS]
        grad[BUCKETS] = g.sum()
        grad[BUCKETS + 1:] = seen - pairs
        grad = grad / len(order) - RIDGE * np.concatenate([weight[:-1], [0], move])
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        change = 0.2 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
        weight += change[: BUCKETS + 1]
        move += change[BUCKETS + 1:]
    return weight, move


def _document_facts(total: np.ndarray, most: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(total), most, total / np.maximum(n, 20), np.ones(len(total))], axis=1)


def _scored(model: dict, with_spans: bool):
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                start, end, h, first = word_features(data, off)
                score = model["weight"][_buckets(h)].sum(0) + model["weight"][-1]
                p = marginals(score, first, model["move"])
                count = np.diff(first)
                doc = np.repeat(np.arange(rows.num_rows), count)
                total = np.bincount(doc, p, rows.num_rows)
                most = np.zeros(rows.num_rows)
                np.maximum.at(most, doc, p)
                z = _document_facts(total, most, count) @ model["curve"]
                out = {"doc_id": rows.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))}
                if with_spans:
                    hit = np.flatnonzero(p >= SPAN_FROM)
                    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])        # code points before each byte
                    opens = np.ones(len(hit), bool)
                    opens[1:] = (np.diff(hit) > 1) | (doc[hit][1:] != doc[hit][:-1])
                    a, b = hit[opens], hit[np.append(np.flatnonzero(opens)[1:] - 1, len(hit) - 1)] if len(hit) else hit
                    base = lead[off[:-1]]
                    text: list[list[str]] = [[] for _ in range(rows.num_rows)]
                    for x, y in zip(a.tolist(), b.tolist()):
                        d = doc[x]
                        text[d].append(f"{lead[start[x]] - base[d]}:{lead[end[y]] - base[d]}")
                    out["spans"] = pa.array([",".join(t) for t in text], pa.string())
                else:
                    out["toxic"] = rows.column("toxic")
                    out["facts"] = pa.array(list(_document_facts(total, most, count)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict(out)
    return run


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The field and its curve, from at most FIT_DOCS labelled documents that are not held out."""
    known = (columns(labels, doc_id="long", toxic="double").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic")))
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 0.95 * FIT_DOCS / max(n, 1)))).limit(FIT_DOCS)
    sample = save(columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id"), "fit")
    z = DEVIATIONS ** 2
    share, size = F.col("toxic") / F.col("n"), F.col("n")
    bound = (share + z / (2 * size) - DEVIATIONS * F.sqrt(share * (1 - share) / size + z / (4 * size * size))) / (1 + z / size)
    marks = (sample.mapInArrow(_feature_counts, "key long, toxic long, n long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
             .filter(bound >= MARK_FROM).select("key").toPandas()["key"].to_numpy().astype(np.int64).view(np.uint64))
    marks = np.sort(marks)
    rows = (sample.mapInArrow(_sequences(marks, 0.01), "f array<long>, y array<boolean>")
            .orderBy(F.xxhash64("f")).limit(FIT_SEQUENCES).toPandas())
    weight, move = fit_field([np.asarray(x) for x in rows["f"]], [np.asarray(y, bool) for y in rows["y"]])
    model = {"weight": weight, "move": move, "curve": np.zeros(4)}
    facts = sample.mapInArrow(_scored(model, False), "doc_id long, score double, toxic boolean, facts array<double>").select("toxic", "facts").toPandas()
    model["curve"] = _curve(facts)
    return model


def _curve(facts) -> np.ndarray:
    """Logistic regression of the document label on its summed marginals."""
    if not len(facts):
        return np.array([0.0, 0.0, 0.0, -4.0])
    x, y = np.stack(facts["facts"].to_numpy()), facts["toxic"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.1, 0.1, 0.01]), x.T @ (y - p) - np.array([0.1, 0.1, 0.1, 0.01]) * w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return w


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of ``docs``.

    Null and empty texts get the score of a text without words; without labels
    every score is the same and low.  spans: offending words as start:end in
    code points.  Repeated rows each get their row; a null doc_id is not held out.
    """
    model = fit(docs, labels)
    return (columns(docs, doc_id="long", text="string").mapInArrow(_scored(model, True), "doc_id long, score double, spans string")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, and where."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
