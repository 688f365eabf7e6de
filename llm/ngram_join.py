"""N-gram Jaccard join: a blocked sparse product of documents by shingles.

Documents are rows and distinct five-word shingles the columns of a sparse 0/1
matrix A; A * A' holds the overlap counts.  The product is computed in blocks
of columns (a column goes to the task that owns its hash) over the entries
that can matter: with similarity s, two sets of sizes n and m that overlap
enough share an entry among the first ``n - ceil(s n) + 1`` of each row in any
fixed column order.  The order puts rare columns first, judged by a count
sketch over all documents; the sketch steers work only, never the result.
The smaller row of a pair need only be looked up by its first
``n - ceil(2 s n / (1 + s)) + 1`` entries.  Pairs whose sizes differ too much,
or whose 1024-bit parity maps differ in more places than the sizes allow sets
to differ, go at once; overlap counts of the others are accumulated, pairs
below the bound that the sizes imply are discarded, and what remains is
compared on the whole sets.

Equal sets are one row (a class).  Columns that the sketch calls rare meet in
packed arrays by range of their hash, which return those that two classes hold;
frequent ones, few in the lists, are rows from the start, so that a column of
very many classes is never gathered.  Within a column, a class is first paired
with the smallest class of like size only, so a group of g near copies costs
g pairs; then only classes still in different components are paired.  No link
between different sets is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.graph import components
from llm.scratch import columns, drop, save
from llm.text import mix, slices, window_hashes, words, span_hashes

#: Similarity in hundredths, words in a shingle.
SIMILARITY, WIDTH = 80, 5
#: Counters of the rarity sketch (8 MB of 16-bit counters a task) in RANGES rows.
SKETCH_BITS, RANGES = 22, 32
#: A column is frequent if its counter is above the mean by so many standard deviations of chance, and this count.
DEVIATIONS, FREQUENT_LEAST = 5, 16
#: Bits of a set's parity map.
MAP_BITS = 1024
#: Rows that one copy of a set is compared with; a set with more pairs is sent once for each so many.
PAIRS_A_COPY = 1000
#: Ids (and places to send their sets to) up to this many are broadcast (some 24 bytes each); more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Entries packed at a time; entries of a hash range, about; those of it sorted at a time; bytes of a slice; classes that a task remembers.
PACK, RANGE_ENTRIES, SORTED, SLICE, CACHE = 1 << 19, 1 << 20, 1 << 18, 1 << 19, 1 << 17

_COLUMNS = "doc_id long, key long, n long, cls long, last long, soon long, rare int, hot array<long>, bits array<long>, range int, entries binary"
_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}.get(c.split()[1], pa.list_(pa.int64()))) for c in _COLUMNS.split(", ")])


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) >= width:
        return window_hashes(h, width)
    return span_hashes(h, np.zeros(1, np.int64), np.full(1, len(h))) if len(h) else h


def _class_key(s: np.ndarray) -> int:
    """Equal for equal sets; its halves come from sum and size, each hash being mixed already."""
    return int(mix(np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].view(np.int64))


def _row_sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a batch with the sorted shingle set of each."""
    for rows, data, off in slices(batch, limit=SLICE):
        _, _, h, first = words(data, off, lower=True)
        yield rows, [np.unique(_shingles(h[first[d]: first[d + 1]], width)) for d in range(rows.num_rows)]


def _sketch(width: int):
    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, data, off in slices(batch, limit=SLICE):
                _, _, h, first = words(data, off, lower=True)
                g = window_hashes(h, width)      # those across documents are few, and only steer work
                np.add.at(counts, (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        parts = np.minimum(counts, 65535, out=counts).astype(np.uint16).reshape(RANGES, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(np.arange(RANGES), pa.int32()),
                                          "counts": pa.array([p.tobytes() for p in parts], pa.binary())})
    return run


def _added(batches):
    """Counters of each part summed, one batch at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(counts, np.uint16).astype(np.int64)
            total[part] = total[part] + got if part in total else got
    for part, counts in total.items():
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                          "counts": pa.array([np.minimum(counts, 2**31).astype(np.uint32).tobytes()], pa.binary())})


def frequent_columns(texts: DataFrame, width: int) -> tuple[bytes, int]:
    """A bitmap of 2**SKETCH_BITS bits - which counters are well above the mean - and the number of shingles counted."""
    parts = (texts.select("text").mapInArrow(_sketch(width), "part int, counts binary")
             .repartition(RANGES, "part").mapInArrow(_added, "part int, counts binary").collect())
    counts = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), np.uint32)
    for row in parts:                            # RANGES rows of fixed size, whatever the input
        counts[row.part] += np.frombuffer(row.counts, np.uint32)
    counts = counts.reshape(-1)
    mean = counts.mean()
    return np.packbits(counts > max(FREQUENT_LEAST, mean + DEVIATIONS * np.sqrt(mean))).tobytes(), int(counts.sum(dtype=np.int64))


def _planes(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame, byte by byte of their numbers."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<cI", a.dtype.char.encode(), len(a)) for a in arrays)
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def _arrays(blob) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 1 + 5 * raw[0]
    for k in range(raw[0]):
        kind, n = struct.unpack_from("<cI", raw, 1 + 5 * k)
        t = np.dtype(kind.decode())
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n).T).reshape(-1).view(t))
        at += n * t.itemsize
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def _packed(lists: list[tuple[int, int, int, np.ndarray]], ranges: int) -> pa.RecordBatch:
    """Rare entries of some classes (cls, n, how many are short, shingles), sorted, a row for each hash range."""
    size = np.array([len(p) for *_, p in lists], np.int64)
    gram = np.concatenate([p for *_, p in lists])
    of = np.repeat(np.arange(len(lists)), size)
    short = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size) < np.repeat([k for _, _, k, _ in lists], size)
    order = np.argsort(gram)
    gram, of, short = gram[order], of[order], short[order]
    part = (gram >> np.uint64(64 - (ranges - 1).bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(gram), np.int64)
    edge = np.searchsorted(part, np.arange(ranges + 1))
    cls, n = np.array([c for c, *_ in lists], np.int64), np.array([k for _, k, *_ in lists], np.int64)
    rows = []
    for r in np.flatnonzero(np.diff(edge)).tolist():
        own = slice(edge[r], edge[r + 1])
        held, at = np.unique(of[own], return_inverse=True)         # only classes with an entry here are sent along
        rows.append({"range": r, "entries": _planes(_steps(gram[own]), at.astype(np.uint32), short[own], cls[held], n[held])})
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _rows(width: int, similarity: int, bitmap: bytes, ranges: int):
    """Per document: class, set size and its frequent deciding shingles; and packed rows of the rare ones that can decide a link."""
    def run(batches):
        often = np.unpackbits(np.frombuffer(bitmap, np.uint8)).view(bool)
        seen = np.zeros(CACHE, np.int64)         # classes met last: most copies are passed over here, the rest later
        lists: list[tuple[int, int, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for rows, sets in _row_sets(batch, width):
                out: dict[str, list] = {c: [] for c in ("n", "cls", "last", "soon", "rare", "hot", "bits")}
                for s in sets:
                    n = len(s)
                    key = _class_key(s) if n else None
                    new = n and seen[key % CACHE] != key
                    out["n"].append(n), out["cls"].append(key)
                    if not new:
                        for c in ("last", "soon", "rare", "hot", "bits"):
                            out[c].append(None)
                        continue
                    seen[key % CACHE] = key
                    need = n - -(-similarity * n // 100) + 1
                    hot = often[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    p = s[~hot][:need]
                    tail = s[hot][: need - len(p)]
                    # Place of the last entry, and of the last of those that a smaller row is looked up by:
                    # frequent flag, then the hash (62 bits of it suffice for a bound).
                    few = n - -(-2 * similarity * n // (100 + similarity)) + 1
                    place = lambda k: (int(p[k] >> np.uint64(2)) if k < len(p) else int(tail[k - len(p)] >> np.uint64(2)) | (1 << 62))
                    out["last"].append(place(need - 1)), out["soon"].append(place(few - 1))
                    out["rare"].append(len(p)), out["hot"].append(tail.view(np.int64))
                    parity = np.bincount((s & np.uint64(MAP_BITS - 1)).astype(np.int64), minlength=MAP_BITS) & 1
                    out["bits"].append(np.packbits(parity.astype(np.uint8)).view(np.int64))
                    lists.append((key, n, few, p.copy()))
                    held += len(p)
                none = pa.nulls(rows.num_rows, pa.int32()), pa.nulls(rows.num_rows, pa.binary())
                kind = {f.name: f.type for f in _SCHEMA}
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("key").cast(pa.int64()),
                                                  *[pa.array(x, kind[c]) for c, x in out.items()], *none], schema=_SCHEMA)
                if held >= PACK:
                    yield _packed(lists, ranges)
                    lists, held = [], 0
        if held:
            yield _packed(lists, ranges)
    return run


_ENTRIES = pa.schema([("gram", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("short", pa.bool_())])


def _shared(batches):
    """Entries of a range whose shingle two classes hold, each once; a range is decided in parts of some SORTED entries."""
    def out(held):
        total = sum(len(x[0]) for x in held)
        low, high = min(int(x[0][0]) for x in held), max(int(x[0][-1]) for x in held)
        steps = -(-total // SORTED)
        edges = [low + (high - low) * k // steps for k in range(1, steps)] + [high]
        begin = [0] * len(held)
        for edge in edges:
            end = [int(np.searchsorted(x[0], np.uint64(edge), side="right")) for x in held]
            gram = np.concatenate([x[0][i:j] for x, i, j in zip(held, begin, end)])
            cls = np.concatenate([x[3][x[1][i:j]] for x, i, j in zip(held, begin, end)])
            order = np.lexsort((cls, gram))
            gram, cls = gram[order], cls[order]
            new = np.append(True, (gram[1:] != gram[:-1]) | (cls[1:] != cls[:-1]))[: len(gram)]
            order, gram, cls = order[new], gram[new], cls[new]
            same = np.append(False, gram[1:] == gram[:-1])[: len(gram)]
            kept = np.flatnonzero(same | np.append(same[1:], False)[: len(gram)])
            n = np.concatenate([x[4][x[1][i:j]] for x, i, j in zip(held, begin, end)])[order[kept]]
            short = np.concatenate([x[2][i:j] for x, i, j in zip(held, begin, end)])[order[kept]]
            begin = end
            yield pa.RecordBatch.from_arrays([pa.array(gram[kept].view(np.int64)), pa.array(cls[kept]), pa.array(n), pa.array(short)], schema=_ENTRIES)

    now, held = None, []
    for batch in batches:
        for r, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if r != now and held:
                yield from out(held)
                held = []
            now = r
            steps, at, short, cls, n = _arrays(blob.as_buffer())
            held.append((np.cumsum(steps, dtype=np.uint64), at, short, cls, n))
    if held:
        yield from out(held)


def _sent_sets(width: int):
    """The set of each wanted class to every place that compares it."""
    def run(batches):
        for batch in batches:
            for rows, sets in _row_sets(batch, width):
                out: dict[str, list] = {c: [] for c in ("a", "part", "b", "grams")}
                for s, cls, to in zip(sets, rows.column("cls").to_pylist(), rows.column("to").to_pylist()):
                    if not len(s) or _class_key(s) != cls:       # a doc_id may stand on rows of several classes
                        continue
                    grams = _planes(_steps(s))
                    for place in to:
                        for c in ("a", "part", "b"):
                            out[c].append(place[c])
                        out["grams"].append(grams)
                yield pa.RecordBatch.from_arrays([*[pa.array(out[c], pa.int64()) for c in ("a", "part", "b")], pa.array(out["grams"], pa.binary())],
                                                 names=["a", "part", "b", "grams"])
    return run


def _compared(similarity: int):
    """Pairs whose whole sets are similar enough; rows of one a follow the row with its own set (b null)."""
    def run(batches):
        own, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for a, part, b, grams in zip(*[batch.column(c) for c in ("a", "part", "b", "grams")]):
                x = np.cumsum(_arrays(grams.as_buffer())[0], dtype=np.uint64)
                if not b.is_valid:
                    own, mine = (a, part), x
                    continue
                assert own == (a, part)
                at = np.searchsorted(mine, x)
                both = int((mine[np.minimum(at, len(mine) - 1)] == x).sum())
                if 100 * both >= similarity * (len(mine) + len(x) - both):
                    out[0].append(a.as_py()), out[1].append(b.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
    return run


def _needed(n: str, m: str, similarity: int) -> str:
    """ceil(s (n + m) / (100 + s)): the overlap that two sizes imply."""
    return f"(({similarity} * ({n} + {m}) + {99 + similarity}) div {100 + similarity})"


def _like_sizes(similarity: int) -> str:
    """Whether rows a (smaller) and b may link by their sizes."""
    return f"(n_a < n_b OR (n_a = n_b AND a < b)) AND 100 * n_a >= {similarity} * n_b"


def _like_maps(similarity: int) -> str:
    """Whether the parity maps of a and b allow a link."""
    differ = " + ".join(f"bit_count(bits_a[{k}] ^ bits_b[{k}])" for k in range(MAP_BITS // 64))
    return f"{differ} <= n_a + n_b - 2 * {_needed('n_a', 'n_b', similarity)}"


def _enough(similarity: int) -> str:
    """Whether ``common``, counted over the columns that a (smaller) is looked up by and b lists, allows a link.

    All entries up to the smaller of the two last places are on both lists, so
    the row that ends first can miss no more than size - need of its own.
    """
    need = _needed("n_a", "n_b", similarity)
    a = f"(n_a - {_needed('n_a', 'n_a', similarity)} + 1) - (n_a - {need})"
    b = f"(n_b - ({similarity} * n_b + 99) div 100 + 1) - (n_b - {need})"
    return f"common >= CASE WHEN soon_a < last_b THEN {a} WHEN soon_a > last_b THEN {b} ELSE least({a}, {b}) END"


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, width: int, similarity: int) -> DataFrame:
    """Of pairs (a, b): those that pass the comparison of their whole sets."""
    left = save(pairs, "pairs")
    # Each pair brings the set of b to where the set of a is; a's set goes there once
    # for every PAIRS_A_COPY pairs, and is held while they pass.  A class is wanted in
    # no more places than its set has columns.
    copies = left.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).alias("copies"))
    dealt = left.join(copies, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("copies")))
    owns = copies.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    places = (dealt.select(F.col("b").alias("cls"), "a", "part", "b").unionByName(owns.select(F.col("a").alias("cls"), "a", "part", "b"))
              .groupBy("cls").agg(F.collect_list(F.struct("a", "part", "b")).alias("to")))
    wanted = save(places.join(reps, "cls").select("cls", F.col("rep").alias("doc_id"), "key", "to"), "wanted")
    n, n_named, n_places = wanted.agg(F.count("*"), F.count("doc_id"), F.coalesce(F.sum(F.size("to")), F.lit(0))).first()
    few = n + n_places <= BROADCAST_IDS
    sent = lambda df: F.broadcast(df) if few else df
    # Rows that repeat bring the same set twice, which only finds the same links again.
    of = texts.select("doc_id", "text").join(sent(wanted.filter("doc_id IS NOT NULL").drop("key")), "doc_id").select("text", "cls", "to")
    if n > n_named:                              # classes that only rows without an id hold: one row each, by its text's hash
        lone = texts.filter("doc_id IS NULL").select("key", "text").join(sent(wanted.filter("doc_id IS NULL").drop("doc_id")), "key").dropDuplicates(["key", "cls"])
        of = of.unionByName(lone.select("text", "cls", "to"))
    links = save(of.mapInArrow(_sent_sets(width), "a long, part long, b long, grams binary")
                 .repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
                 .mapInArrow(_compared(similarity), "a long, b long"), "links")
    drop(left, wanted)
    return links


def _meeting(part: DataFrame, similarity: int) -> DataFrame:
    """A row for each column and pair (a, b) of its classes that are apart and may link by sizes and maps."""
    side = lambda df, x, *more: df.select("gram", F.col("cls").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "component", *more)])
    return (side(part.filter("short"), "a", "soon", "bits").join(side(part, "b", "last", "bits"), "gram")
            .filter(f"component_a <> component_b AND {_like_sizes(similarity)} AND {_like_maps(similarity)}"))


def _jaccard(docs: DataFrame, similarity: int, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows with doc_id, key, n, cls, component, component_id; tables of links)."""
    texts = columns(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("text"))
    bitmap, total = frequent_columns(texts, width)
    ranges = 16
    while ranges * RANGE_ENTRIES < (100 - similarity) * total // 100:
        ranges *= 2
    rows = save(texts.mapInArrow(_rows(width, similarity, bitmap, ranges), _COLUMNS), "rows")
    own = rows.filter("range IS NULL")
    # One row for each class: its smallest id that holds that class's text, or a hash of such a text if no row has an id.
    reps = save(own.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.min(F.when(F.col("doc_id").isNull(), F.col("key"))).alias("key")), "reps")
    rare = (rows.filter("range IS NOT NULL").select("range", "entries").repartition(ranges, "range").sortWithinPartitions("range")
            .mapInArrow(_shared, "gram long, cls long, n long, short boolean"))
    hot = (own.filter("size(hot) > 0").select("cls", "n", "rare", F.posexplode("hot").alias("at", "gram"))
           .select("gram", "cls", "n", F.expr(f"at + rare <= n - {_needed('n', 'n', similarity)}").alias("short")).distinct())
    entries = save(rare.unionByName(hot).withColumn("band", F.floor(F.log("n") / float(np.log(100 / similarity))).cast("int")), "entries")
    facts = save(own.filter("soon IS NOT NULL").select("cls", "last", "soon", "bits").dropDuplicates(["cls"]), "facts")
    slim = save(own.select("doc_id", "key", "n", "cls"), "slim")
    drop(rows)
    bits = lambda x: facts.select(F.col("cls").alias(x), F.col("bits").alias(f"bits_{x}"))
    mapped = lambda pairs: pairs.join(bits("a"), "a").join(bits("b"), "b").filter(_like_maps(similarity)).select("a", "b")
    # Round 1: the smallest set of each column and size band, with the others of the band.
    middle = save(entries.filter("short").groupBy("gram", "band").agg(F.min(F.struct("n", "cls")).alias("m"))
                  .select("gram", "band", F.col("m.cls").alias("a"), F.col("m.n").alias("n_a")), "middle")
    stars = (entries.select("gram", "band", F.col("cls").alias("b"), F.col("n").alias("n_b")).join(middle, ["gram", "band"])
             .filter(f"a <> b AND {_like_sizes(similarity)}").select("a", "n_a", "b", "n_b").distinct())
    first = _verified(mapped(stars), reps, texts, width, similarity)
    joined = save(components(first), "joined")
    # Round 2: columns whose classes are still apart; overlap counts are accumulated over all of them.
    placed = save(entries.select("gram", "cls", "n", "short").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left")
                  .withColumn("component", F.coalesce("component", "cls")), "placed")
    apart = (placed.groupBy("gram").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.max("short").alias("found"))
             .filter("least <> most AND found").select("gram"))
    # The whole parity map goes with every entry: a shorter one lets most pairs of a large group of near
    # copies pass, linked or not, and they are as many as the square of the group's size.
    part = save(placed.join(apart, "gram", "left_semi").join(facts, "cls"), "part")
    drop(entries, middle, placed)
    met = (_meeting(part, similarity)
           .groupBy("a", "b", "n_a", "n_b", "soon_a", "last_b").agg(F.count("*").alias("common"))
           .filter(_enough(similarity)).select("a", "b"))
    second = _verified(met, reps, texts, width, similarity)
    drop(part, facts)
    names = save(components(second.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))), "names")
    least = (reps.join(names.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    least = save(least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("cls", "component", "component_id"), "least")
    drop(joined, names, reps)
    full = slim.filter("cls IS NOT NULL").join(least, "cls", "left").select("doc_id", "key", "n", "cls", "component", "component_id")
    none = slim.filter("cls IS NULL").select("doc_id", "key", "n", "cls", F.col("cls").alias("component"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none), [first, second]


def jaccard_classes(docs: DataFrame, similarity: int = SIMILARITY, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of ``docs`` (doc_id, text).

    documents: doc_id, n_shingles, cls (equal for equal shingle sets, null
    without words), component_id (smallest doc_id reachable by links).
    links: pairs of classes (a, b) that were found to be similar enough to
    connect the components.  Null text is empty; a document without words links
    with nothing; repeated rows and repeated ids are each returned; a null
    doc_id takes part and never names a component that has another id.  An
    empty table gives empty results; a very long text is a slice of its own.
    """
    found, links = _jaccard(docs, similarity, width)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "cls", "component_id"), links[0].unionByName(links[1])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document (five words, 0.8)."""
    found, _ = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the row of its smallest id, and of its rows the first by the hash of their text.

    Documents without words, or without an id, are no copies of anything and stay.
    Rows are told apart by id and text: unrelated texts under one id belong to
    components of their own, and each stays; of rows that repeat one stays.
    """
    found, _ = _jaccard(docs, SIMILARITY, WIDTH)
    named = found.filter("doc_id IS NOT NULL AND cls IS NOT NULL").select("component", "doc_id", "key")
    rows = save(named.groupBy("component", "doc_id", "key").agg(F.count("*").alias("times")), "held")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("f"))
    rows = rows.join(first, "component").withColumn("stays", F.col("f") == F.struct("doc_id", "key"))
    marks = save(rows.filter("NOT stays OR times > 1").select("doc_id", F.col("key").alias("key__"), "stays"), "marks")
    n_gone, n = marks.agg(F.count(F.when(~F.col("stays"), 1)), F.count("*")).first()
    few = n <= BROADCAST_IDS
    own = docs.withColumn("key__", F.xxhash64("text"))
    marked = own.join(F.broadcast(marks) if few else marks, ["doc_id", "key__"], "left")
    left = marked.filter("stays IS NULL").select(*docs.columns)
    if n == n_gone:
        return left
    again = own.join(marks.filter("stays").drop("stays"), ["doc_id", "key__"], "left_semi").dropDuplicates(["doc_id", "key__"])
    return left.unionByName(again.select(*docs.columns))
