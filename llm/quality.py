"""Quality classifier: hierarchical empirical Bayes over host and path.

A document's own evidence is the log likelihood ratio of a logistic classifier
on byte and word statistics of its whole text, fitted on a bounded sample of
labelled rows.  Sites add what their other documents say: every document
counts with its label, or with the classifier's probability where it has none;
counts are grouped by path and by host, and each rate is shrunk toward the one
above it (path to host, host to the corpus) with a beta prior whose strength
is estimated from how much the rates of that level differ.  Sparse sites thus
follow the corpus and large ones their own record.  The document's posterior
odds are its likelihood ratio times the prior odds of its path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.scratch import columns, drop, save
from llm.text import slices, words

#: Labelled rows that the classifier is fitted on, at most (chosen by a hash of doc_id).
FIT_ROWS = 20_000
#: A document is kept from this posterior probability of good quality.
KEEP_FROM = 0.5
#: Host and path groups up to this many are broadcast (some 100 bytes each).
BROADCAST_GROUPS = 100_000
#: Bytes of text held as features at a time.
SLICE = 1 << 19
#: Weight of the ridge penalty of the classifier.
RIDGE = 1.0

_N_BYTES = 129        # 128 ASCII bytes and all others


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each document of a slice."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    share = np.bincount(doc * _N_BYTES + np.minimum(data, 128), minlength=n * _N_BYTES).reshape(n, _N_BYTES) / np.maximum(size, 1)[:, None]
    start, end, h, first = words(data, off, lower=True)
    count = np.diff(first)
    of = np.repeat(np.arange(n), count)
    per = lambda mask: np.bincount(of[mask], minlength=n) / np.maximum(count, 1)
    length = end - start
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    distinct = np.bincount(of[order][new], minlength=n) / np.maximum(count, 1)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    if len(h):
        head, tail = letter[data[start]], letter[data[end - 1]]
    else:
        head = tail = np.zeros(0, bool)
    plain = np.stack([np.log1p(count), distinct, per(again), per(~head), per(~tail), per(length == 1), per(length > 20),
                      np.bincount(of, weights=length, minlength=n) / np.maximum(count, 1) / 10.0], axis=1)
    return np.concatenate([np.sqrt(share), plain], axis=1).astype(np.float64)


def fit(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray | float]:
    """Ridge logistic regression by Newton steps on standardised features."""
    if not len(y) or y.min() == y.max():
        return {"mean": np.zeros(x.shape[1]), "scale": np.ones(x.shape[1]), "weight": np.zeros(x.shape[1]), "odds": 0.0}
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.concatenate([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))], axis=1)
    penalty = np.full(z.shape[1], RIDGE)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    rate = y.mean()
    # Bias less the odds of the sample: what is left is a likelihood ratio.
    return {"mean": mean, "scale": scale, "weight": w[:-1], "odds": float(w[-1] - np.log(rate / (1 - rate)))}


def _with_features(batches):
    for batch in batches:
        for rows, data, off in slices(batch, limit=SLICE):
            yield pa.RecordBatch.from_pydict({"y": rows.column("y"), "x": pa.array([r.tobytes() for r in features(data, off).astype(np.float32)], pa.binary())})


def _with_evidence(model: dict):
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch, limit=SLICE):
                z = np.clip((features(data, off) - model["mean"]) / model["scale"], -8, 8)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(z @ model["weight"] + model["odds"], pa.float64())],
                                                 names=[*rows.schema.names, "llr__"])
    return run


def with_evidence(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` and llr__, the log likelihood ratio of good quality by the text alone."""
    return docs.mapInArrow(_with_evidence(model), T.StructType([*docs.schema.fields, T.StructField("llr__", T.DoubleType())]))


def _labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the mean label of each labelled document."""
    return (columns(labels, doc_id="long", quality="double").filter("doc_id IS NOT NULL AND quality IS NOT NULL")
            .groupBy("doc_id").agg(F.avg("quality").alias("y")))


def fit_on(docs: DataFrame, labels: DataFrame) -> dict:
    """The classifier, fitted on at most FIT_ROWS labelled documents."""
    y = _labels(labels)
    n = y.count()
    chosen = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 0.9 * FIT_ROWS / max(n, 1)))).limit(FIT_ROWS)
    rows = (columns(docs, doc_id="long", text="string").join(F.broadcast(chosen), "doc_id")
            .select("y", "text").mapInArrow(_with_features, "y double, x binary").toArrow())
    if not rows.num_rows:
        return fit(np.zeros((0, _N_BYTES + 8)), np.zeros(0))
    y = rows.column("y").to_numpy()
    x = np.frombuffer(b"".join(v.as_buffer() for v in rows.column("x")), np.float32).reshape(len(y), -1)
    del rows
    order = np.lexsort((*x.T[:40], y))                          # the same sums whatever the order of tasks
    return fit(x[order].astype(np.float64), (y[order] >= 0.5).astype(float))


def site_rates(counts: DataFrame) -> DataFrame:
    """(host, path, rate) from counts (host, path, n, s): s good documents of n.

    Strength of a level's prior by the method of moments: with between-group
    variance v of the rates and mean m, k = m (1 - m) / v - 1.
    """
    total = counts.agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all")).select(
        ((F.col("s_all") + 1) / (F.col("n_all") + 1)).alias("mean"))

    def strength(groups: DataFrame, rate: str, name: str) -> DataFrame:
        """One row: the prior's strength, from rates weighted by size less their own sampling noise."""
        one = groups.crossJoin(F.broadcast(total)).agg(
            F.sum(F.col("n") * F.pow(F.col(rate) - F.col("mean"), 2)).alias("ss"), F.sum("n").alias("nn"),
            F.count("*").alias("g"), F.max("mean").alias("m"))
        m = F.least(F.greatest("m", F.lit(1e-4)), F.lit(1 - 1e-4))
        v = F.greatest((F.col("ss") - F.col("g") * m * (1 - m)) / F.greatest("nn", F.lit(1.0)), F.lit(1e-7))
        return one.select(F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1e6)).alias(name))

    hosts = counts.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("own", F.col("s") / F.col("n"))
    host_rate = (hosts.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(strength(hosts, "own", "k")))
                 .select("host", ((F.col("s") + F.col("k") * F.col("mean")) / (F.col("n") + F.col("k"))).alias("host_rate")))
    paths = counts.withColumn("own", F.col("s") / F.col("n"))
    return (paths.crossJoin(F.broadcast(strength(paths, "own", "k"))).join(host_rate, "host")
            .select("host", "path", "host_rate", ((F.col("s") + F.col("k") * F.col("host_rate")) / (F.col("n") + F.col("k"))).alias("path_rate")))


def judge(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """``docs`` with llr__, host_rate, path_rate, score__ and kept__.

    host and path default to source, and lang within source; a null is a site
    of its own.  A null or empty text has the evidence of its statistics (all
    zero); without labels, or with one class only, the evidence is nothing and
    every document is kept.  Repeated rows each get their row, so do ties; of
    labels that share a doc_id the mean counts.  An empty table gives an empty
    table.  A very long text is read whole, as a slice of its own.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    model = fit_on(docs, labels)
    scored = with_evidence(docs, model).withColumns({"host__": key(host), "path__": key(path)})
    y = _labels(labels)
    base = y.agg(F.avg("y")).first()[0]
    base = min(max(1.0 if base is None else base, 1e-3), 1 - 1e-3)
    odds = float(np.log(base / (1 - base)))
    # Of each document only its site, its evidence and its label meet here.
    counts = (scored.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("host__").alias("host"), F.col("path__").alias("path"),
                            (1 / (1 + F.exp(-(F.col("llr__") + odds)))).alias("p"))
              .join(y, "doc_id", "left").groupBy("host", "path")
              .agg(F.count("*").cast("double").alias("n"), F.sum(F.round(F.coalesce("y", "p"), 9).cast("decimal(28,9)")).cast("double").alias("s")))
    counts = save(counts, "sites")
    rates = save(site_rates(counts).select(F.col("host").alias("host__"), F.col("path").alias("path__"), "host_rate", "path_rate"), "rates")
    drop(counts)
    near = F.broadcast(rates) if rates.count() <= BROADCAST_GROUPS else rates
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    return (scored.join(near, ["host__", "path__"], "left")
            .withColumn("score__", 1 / (1 + F.exp(-(F.col("llr__") + logit(F.col("path_rate"))))))
            .withColumn("kept__", F.col("score__") >= KEEP_FROM).drop("host__", "path__"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document, its parts, and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", F.col("llr__").alias("evidence"), "host_rate", "path_rate",
                                      F.col("score__").alias("score"), F.col("kept__").alias("kept"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).filter("kept__").select(*docs.columns)
