"""License scan by diagonal voting, in DataFrame operations only.

Words are runs of characters other than ASCII punctuation, white space and
controls, with A-Z lower-cased.  Every three consecutive words of a document
(a gram) are hashed and joined to the grams of the templates; the join also
compares the words themselves, so a vote is never a mere hash match.  A vote of
word ``pos`` for template word ``tpos`` stands on the diagonal ``pos - tpos``:
the word where the template would begin.

1. Votes are grouped by (document, template, diagonal).
2. Diagonals at most GAP words apart are merged: words were put in or left out.
3. A merged span is verified by the share of the template's words that its
   votes cover, and by its length.  Of overlapping spans the best stay.

A phrase is a template that counts only where one diagonal holds all its grams.

Templates are fixed and few (their grams are the broadcast side, some hundreds
of rows whatever the corpus).  Three end marks close each document, so that its
row is there without a vote and carries its length.  Only votes and end marks
are shuffled, once, by row: no document's votes meet another's, and a line that
a third of all documents hold costs each of them its own votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.scratch import columns

#: Words of a gram, words by which merged diagonals may differ, share of a template's words that a span must cover.
GRAM, GAP, SHARE = 3, 2, 0.8

# Phrases whose places are counted, with their labels.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# License notices as words, with their labels.
TEMPLATES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_END = ""                                          # never a word
_PARTS = [f"w{k}" for k in range(GRAM)]


def _words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def _grams(words: Column) -> Column:
    """Every GRAM consecutive entries of an array, as structs of w0, w1, ..."""
    return F.arrays_zip(*[(F.slice(words, k + 1, F.size(words)) if k else words).alias(p) for k, p in enumerate(_PARTS)])


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """(template, label, base, size, tpos, w0, w1, ..., gram) of every gram of every template; template -1 is the end mark."""
    both = [(label, words, True) for label, words in phrases] + [(label, words, False) for label, words in templates]
    if any(len(words.split()) < GRAM for _, words, _ in both):
        raise ValueError(f"a template needs {GRAM} words at least")
    rows = [F.struct(F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.split(F.lit(words), " ").alias("words"))
            for k, (label, words, base) in enumerate(both)]
    rows.append(F.struct(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"),
                         F.array(*[F.lit(_END)] * GRAM).alias("words")))
    out = spark.range(1).select(F.inline(F.array(*rows))).select("template", "label", "base", F.size("words").alias("size"),
                                                                 F.posexplode(_grams(F.col("words"))).alias("tpos", "g"))
    return (out.filter(F.col(f"g.{_PARTS[-1]}").isNotNull()).select("template", "label", "base", "size", "tpos", "g.*")
            .withColumn("gram", F.xxhash64(*_PARTS)))


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_words, base places and verified spans.

    ``places`` holds (label, start) of every phrase, ``spans`` (label, start,
    end, share) of every verified template span, both sorted; ``score`` is the
    largest share of a template's words that any span covers, 1 where a phrase
    stands.  A null text is empty; an empty text has no words, no places and
    score 0.  Rows are told apart by themselves, so null, tied or repeated ids
    give a row each; other columns are dropped; no rows give no rows.  A text
    of any length is one row of the scan, and only its votes go on.
    """
    spark = docs.sparkSession
    text = columns(docs, doc_id="long", text="string").select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.concat(_words(F.col("text")), F.array(*[F.lit(_END)] * GRAM)).alias("words"))
    grams = text.select("doc_id", "row", F.posexplode(_grams(F.col("words"))).alias("pos", "g")).select(
        "doc_id", "row", "pos", *[F.col(f"g.{p}").alias(p) for p in _PARTS])
    known = template_grams(spark, phrases, templates)
    votes = (grams.withColumn("gram", F.xxhash64(*_PARTS)).join(F.broadcast(known), ["gram", *_PARTS])
             .select("doc_id", "row", "template", "label", "base", "size", "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal"))
             .repartition("row"))

    one = ["row", "doc_id", "template", "label", "base", "size"]
    diagonals = votes.groupBy(*one, "diagonal").agg(
        F.collect_list("tpos").alias("hits"), F.min("pos").alias("start"), (F.max("pos") + GRAM).alias("end"))

    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= gap, 0).otherwise(1)
    merged = (diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(along))
              .groupBy(*one, "group").agg(
                  F.flatten(F.collect_list("hits")).alias("hits"), F.min("start").alias("start"), F.max("end").alias("end"),
                  F.collect_list(F.when(F.col("base") & (F.size("hits") == F.col("size") - GRAM + 1), F.col("diagonal"))).alias("whole")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda t: F.sequence(t, t + GRAM - 1)))))
    spans = merged.withColumn("share", F.least(F.lit(1.0), covered / F.col("size"))).withColumn(
        "good", ~F.col("base") & (F.col("template") >= 0) & (F.col("share") >= share)
        & (F.col("end") - F.col("start") <= F.col("size") / share))

    # Verified spans that overlap, one after another, are decided together; the others are no rivals.
    before = Window.partitionBy("row", "good").orderBy("start", "end", "template")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") < reach, 0).otherwise(1)
    rivals = Window.partitionBy("row", "good", "place")
    spans = (spans.withColumn("fresh", fresh).withColumn("place", F.sum("fresh").over(before))
             .withColumn("kept", F.col("good") & (F.col("share") == F.max("share").over(rivals))))

    span = F.struct("label", "start", "end", "share")
    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("template") < 0, F.col("start"))).cast("long").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list(F.transform("whole", lambda d: F.struct(F.col("label").alias("label"), d.alias("start")))))).alias("places"),
        F.array_sort(F.collect_list(F.when(F.col("kept"), span))).alias("spans"),
        F.max(F.when(F.col("template") < 0, 0.0).when(F.col("base"), F.when(F.size("whole") > 0, 1.0)).otherwise(F.col("share"))).alias("score"),
    ).drop("row")


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document: places of the phrases, labels of phrases and verified notices."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    starts = F.transform("places", lambda p: p["start"])
    named = F.transform("places", lambda p: p["label"])
    every = F.concat(named, F.transform("spans", lambda s: s["label"]))
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), join(named).alias("base_labels"), join(every).alias("labels"), "score",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


def oracle_sql() -> str:
    """The same rule for DuckDB: phrases by comparing word lists, notices by their shared grams."""
    rows = ", ".join(f"({k}, '{label}', {words.split()!r})" for k, (label, words) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{label}', {words.split()!r})" for label, words in PHRASES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
phrase(label, ws) AS (VALUES {phrases}),
notice(t, label, ws) AS (VALUES {rows}),
word AS (SELECT r, unnest(range(len(w))) AS pos, unnest(w) AS w0, unnest(w[2:]) AS w1, unnest(w[3:]) AS w2, unnest(w[4:]) AS w3 FROM d),
place AS (
  SELECT r, label, pos FROM word JOIN phrase
    ON w0 = ws[1] AND w1 = ws[2] AND w2 = ws[3] AND (len(ws) = 3 OR w3 = ws[4])),
based AS (
  SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS found FROM place GROUP BY r),
piece AS (SELECT t, label, len(ws) AS n, ws, unnest(range(len(ws) - 2)) AS tpos FROM notice),
vote AS (
  SELECT r, t, label, n, pos, tpos, pos - tpos AS diag FROM word JOIN piece
    ON w0 = ws[tpos + 1] AND w1 = ws[tpos + 2] AND w2 = ws[tpos + 3]),
step AS (
  SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY r, t ORDER BY diag, pos) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM vote),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY diag, pos ROWS UNBOUNDED PRECEDING) AS g FROM step),
held AS (
  SELECT r, t, label, n, g, min(pos) AS a, max(pos) + 3 AS b,
         len(list_distinct(flatten(list([tpos, tpos + 1, tpos + 2])))) / n AS share
  FROM grouped GROUP BY r, t, label, n, g),
good AS (SELECT * FROM held WHERE share >= {SHARE} AND b - a <= n / {SHARE}),
chain AS (
  SELECT *, CASE WHEN a < max(b) OVER (PARTITION BY r ORDER BY a, b, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh2 FROM good),
island AS (SELECT *, sum(fresh2) OVER (PARTITION BY r ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS k FROM chain),
best AS (SELECT * FROM island QUALIFY share = max(share) OVER (PARTITION BY r, k)),
noticed AS (
  SELECT r, list(label) AS found,
         string_agg(label || ':' || a || ':' || b, ',' ORDER BY label, a, b, share) AS spans FROM best GROUP BY r),
top AS (SELECT r, max(share) AS score FROM held GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(based.found, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(based.found, []), coalesce(noticed.found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0)::DOUBLE END AS score, coalesce(spans, '') AS spans
FROM d LEFT JOIN based USING (r) LEFT JOIN noticed USING (r) LEFT JOIN top USING (r)
"""
