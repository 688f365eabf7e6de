"""Information-theoretic sanitisation of personal data.

Protected entities are found by form: e-mail and IP addresses, card numbers
that pass Luhn, phone numbers; and, beside these base kinds, secrets: long runs
of letters and digits whose characters carry as many bits as chance would give
them.  Which other words give an entity away is estimated from the whole
corpus: a word t that stands near entity e discloses

    P(e | t) = documents with t near e / documents with t

and log2(P(e | t) / P(e)) bits about it.  Any word may: names, account names,
numbers.  Words that stand near one entity in enough different texts and whose
disclosure exceeds the thresholds are generalised, or removed where they all
but name the entity, wherever they occur.  The corpus statistics are sums over
all documents; word lists of any length are looked up in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.scratch import columns, save
from llm.text import _BYTE_CODE, _LOWER, slices, span_hashes, words

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "secret", "term")
#: Words on either side of an entity; different texts in which a word must stand near it.
NEAR, TEXTS = 8, 3
#: A word is generalised from this posterior, removed from that, if it gives this many bits.
GENERALISE_FROM, REMOVE_FROM, BITS = 0.5, 0.9, 4.0
#: A secret: characters at least, least share of digits and of letters, bits of a character.
SECRET, SECRET_SHARE, SECRET_BITS = 20, 0.15, 3.0
#: Words looked up at a time (8 MB).
WORDS_A_PASS = 1_000_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[A-Za-z0-9]{%d,}" % SECRET)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:!?"]] = True


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the entities of a text, in linear time.

    Leftmost non-overlapping matches of each kind; a match that fails its test
    is dropped and not tried again.
    """
    out: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:      # the whole run before the sign
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def secret_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Long runs of letters and digits of high entropy, apart from the base spans."""
    out = []
    for m in _RUN.finditer(text):
        run, n = m[0], m.end() - m.start()
        digits = sum("0" <= c <= "9" for c in run)
        if min(digits, n - digits) < SECRET_SHARE * n or any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        count = Counter(run)
        if -sum(k / n * math.log2(k / n) for k in count.values()) >= SECRET_BITS:
            out.append((m.start(), "secret", m.end()))
    return out


def _entities(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and base spans and secrets in order."""
    base = base_spans(text)
    return base, sorted(base + secret_spans(text, base), key=lambda x: (x[0], KINDS.index(x[1])))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{_digits(value) if kind in ('card', 'phone') else value.lower()}"


_DIGIT_OR_AT = np.zeros(256, bool)
_DIGIT_OR_AT[48:58] = _DIGIT_OR_AT[ord("@")] = True


def _suspects(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents of a slice with a digit or an @ at all."""
    seen = np.concatenate([[0], np.cumsum(_DIGIT_OR_AT[data])])
    return seen[off[1:]] > seen[off[:-1]]


def _core(data: np.ndarray, off: np.ndarray):
    """(start, end, hash, first) of words without case and end marks."""
    start, end, _, first = words(data, off)
    if not len(start):
        return start, end, np.zeros(0, np.uint64), first
    end = end.copy()
    for _ in range(3):
        end -= _END[data[end - 1]] & (end - 1 > start)
    return start, end, span_hashes(_BYTE_CODE[_LOWER[data]], start, end), first


def _pairs(batches):
    """(text key, entity, word, hash) for the NEAR words on either side of each entity, by place in the whole text."""
    for batch in batches:
        for rows, data, off in slices(batch):
            raw, keys, entities, near, hashes = data.tobytes(), [], [], [], []
            key = rows.column("key").to_pylist()
            start, end, h, first = _core(data, off)
            low = _LOWER[data].tobytes()
            for d in np.flatnonzero(_suspects(data, off)):
                text = raw[off[d]: off[d + 1]].decode()
                spans = _entities(text)[1]
                if not spans:
                    continue
                own = slice(first[d], first[d + 1])
                begins, ends = start[own] - off[d], end[own] - off[d]
                edges = [(len(text[:s].encode()), len(text[:e].encode())) for s, _, e in spans]
                free = np.ones(len(begins), bool)            # words that are no part of an entity
                for x, y in edges:
                    free[np.searchsorted(ends, x, side="right"): np.searchsorted(begins, y)] = False
                met = set()
                for (s, kind, e), (x, y) in zip(spans, edges):
                    left, right = int(np.searchsorted(ends, x, side="right")), int(np.searchsorted(begins, y))
                    around = [*range(max(0, left - NEAR), left), *range(right, min(len(begins), right + NEAR))]
                    met |= {(_entity(kind, text[s:e]), int(first[d]) + k) for k in around if free[k]}
                seen = set()
                for entity, k in sorted(met):
                    if (entity, int(h[k])) not in seen:
                        seen.add((entity, int(h[k])))
                        keys.append(key[d]), entities.append(entity), hashes.append(h[k]), near.append(low[start[k]: end[k]].decode())
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "entity": pa.array(entities, pa.string()),
                                              "term": pa.array(near, pa.string()), "hash": pa.array(np.array(hashes, np.uint64).view(np.int64))})


def _documents_with(wanted: np.ndarray):
    """(hash, documents of the slice with that word), of wanted words."""
    def run(batches):
        for batch in batches:
            for _, data, off in slices(batch):
                _, _, h, first = _core(data, off)
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                hit = wanted[at] == h
                doc = np.repeat(np.arange(len(off) - 1), np.diff(first))[hit]
                both = np.unique(doc * len(wanted) + at[hit])
                word, n = np.unique(both % len(wanted), return_counts=True)
                yield pa.RecordBatch.from_pydict({"hash": pa.array(wanted[word].view(np.int64)), "n": pa.array(n.astype(np.int64))})
    return run


def _blocks(table: DataFrame) -> list[np.ndarray]:
    """The hashes of a table, sorted, at most WORDS_A_PASS in each block."""
    n = table.count()
    passes = -(-n // WORDS_A_PASS)
    out = []
    for k in range(passes):
        part = table.filter(F.pmod(F.xxhash64("hash"), F.lit(passes)) == k).select("hash").toPandas()["hash"].to_numpy().astype(np.int64)
        out.append(np.sort(part.view(np.uint64)))
    return [x for x in out if len(x)]


def disclosing_words(docs: DataFrame) -> DataFrame:
    """(term, hash, posterior, bits, action): words that give an entity away."""
    texts = columns(docs, text="string").filter("text IS NOT NULL").withColumn("key", F.xxhash64("text"))
    near = save(texts.mapInArrow(_pairs, "key long, entity string, term string, hash long"), "near")
    together = save(near.groupBy("entity", "term", "hash", "key").agg(F.count("*").alias("copies")).groupBy("entity", "term", "hash")
                    .agg(F.count("*").alias("texts"), F.sum("copies").alias("n_both")).filter(F.col("texts") >= TEXTS), "together")
    counts = None
    for wanted in _blocks(together.select("hash").distinct()):
        part = save(texts.select("text").mapInArrow(_documents_with(wanted), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n_term")), "counts")
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return docs.sparkSession.createDataFrame([], "term string, hash long, posterior double, bits double, action string")
    holders = near.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = texts.count()
    found = (together.join(counts, "hash").join(holders, "entity")
             .withColumn("posterior", F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")))
             .withColumn("bits", F.log2(F.col("posterior") * F.lit(float(max(total, 1))) / F.col("n_entity")))
             .filter((F.col("posterior") >= GENERALISE_FROM) & (F.col("bits") >= BITS)))
    return (found.groupBy("term", "hash").agg(F.max("posterior").alias("posterior"), F.max("bits").alias("bits"))
            .withColumn("action", F.when(F.col("posterior") >= REMOVE_FROM, "remove").otherwise("generalise")))


_TERMS = "array<struct<start:int,end:int,gone:boolean>>"


def _term_places(data: np.ndarray, off: np.ndarray, wanted: np.ndarray, removed: np.ndarray) -> dict[int, list[tuple[int, int, bool]]]:
    """By document of a slice: (start, end, whether it is removed) of its wanted words, in code points."""
    out: dict[int, list[tuple[int, int, bool]]] = {}
    if not len(wanted):
        return out
    start, end, h, first = _core(data, off)
    at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
    hit = np.flatnonzero(wanted[at] == h)
    if len(hit):
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        doc = np.searchsorted(first, hit, side="right") - 1
        for k, d in zip(hit.tolist(), doc.tolist()):
            out.setdefault(d, []).append((int(lead[start[k]] - lead[off[d]]), int(lead[end[k]] - lead[off[d]]), bool(removed[at[k]])))
    return out


def _placed(wanted: np.ndarray, removed: np.ndarray):
    """Rows with a wanted word: their key and the words' places."""
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                found = _term_places(data, off, wanted, removed)
                docs = sorted(found)
                yield pa.RecordBatch.from_pydict({
                    "key": rows.column("key").take(pa.array(docs, pa.int64())),
                    "terms": pa.array([[{"start": s, "end": e, "gone": g} for s, e, g in found[d]] for d in docs],
                                      pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("gone", pa.bool_())])))})
    return run


def _found(wanted: np.ndarray, removed: np.ndarray, with_text: bool):
    def run(batches):
        for batch in batches:
            for rows, data, off in slices(batch):
                raw = data.tobytes()
                spans: list[list] = [[] for _ in range(rows.num_rows)]
                base: list[list] = [[] for _ in range(rows.num_rows)]
                for d in np.flatnonzero(_suspects(data, off)):
                    base[d], spans[d] = _entities(raw[off[d]: off[d + 1]].decode())
                if "terms" in rows.schema.names:             # looked up before, block by block
                    given = rows.column("terms").to_pylist()
                    terms = {d: sorted((t["start"], t["end"], t["gone"]) for t in x) for d, x in enumerate(given) if x}
                else:
                    terms = _term_places(data, off, wanted, removed)
                gone: dict[tuple[int, int], bool] = {}
                for d, own in terms.items():
                    entities = list(spans[d])
                    for s, e, out in own:
                        if not any(a < e and s < b for a, _, b in entities):
                            spans[d].append((s, "term", e))
                            gone[d, s] = out
                    spans[d].sort(key=lambda x: (x[0], KINDS.index(x[1])))
                out = {"doc_id": rows.column("doc_id")}
                for kind in KINDS:
                    out[f"n_{kind}"] = pa.array([sum(k == kind for _, k, _ in x) for x in spans], pa.int64())
                out["base_sha256"] = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base], pa.string())
                out["spans"] = pa.array([joined(x) for x in spans], pa.string())
                if with_text:
                    clean = []
                    for d, own in enumerate(spans):
                        text, parts, last = raw[off[d]: off[d + 1]].decode(), [], 0
                        for s, kind, e in own:
                            if s < last:                     # kinds may overlap; the first one stands
                                last = max(last, e)
                                continue
                            parts += [text[last:s], "" if gone.get((d, s)) and kind == "term" else f"<{kind.upper()}>"]
                            last = e
                        clean.append("".join([*parts, text[last:]]))
                    out["clean_text"] = pa.array(clean, pa.string())
                yield pa.RecordBatch.from_pydict(out)
    return run


_SCHEMA = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def sanitise(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and, if asked for, clean_text of every row.

    clean_text has <KIND> in place of entities and generalised words, and
    nothing in place of removed ones.  base_sha256 is that of the base kinds'
    spans alone.  Null and empty texts have no spans; repeated rows and null
    ids each get their row; other columns are dropped; an empty table gives an
    empty table.  Of spans that begin together the earlier kind comes first.
    """
    terms = save(disclosing_words(docs), "terms")
    blocks = _blocks(terms.select("hash").distinct())
    gone = terms.filter("action = 'remove'").select("hash").distinct()
    schema = _SCHEMA + (", clean_text string" if with_text else "")
    texts = columns(docs, doc_id="long", text="string")

    def removed(wanted: np.ndarray) -> np.ndarray:
        """Which of a block's words are removed."""
        own = docs.sparkSession.createDataFrame(pa.table({"hash": wanted.view(np.int64)})) if len(blocks) > 1 else None
        out = (gone if own is None else gone.join(F.broadcast(own), "hash", "left_semi")).toPandas()["hash"].to_numpy().astype(np.int64)
        return np.isin(wanted, out.view(np.uint64))

    if len(blocks) <= 1:
        wanted = blocks[0] if blocks else np.zeros(0, np.uint64)
        return texts.mapInArrow(_found(wanted, removed(wanted), with_text), schema)
    keyed = texts.withColumn("key", F.xxhash64("text"))
    places = None
    for wanted in blocks:
        part = save(keyed.select("key", "text").mapInArrow(_placed(wanted, removed(wanted)), f"key long, terms {_TERMS}"), "places")
        places = part if places is None else places.unionByName(part)
    # Rows of one text have the same places: the sets of a block are one, whatever the number of copies.
    places = save(places.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms")), "terms")
    return keyed.join(places, "key", "left").select("doc_id", "text", "terms").mapInArrow(_found(np.zeros(0, np.uint64), np.zeros(0, bool), with_text), schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document, and the words that give it away."""
    return sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
