"""License notices by diagonal voting of word k-grams.

Every rolling k-gram hash of a document joins the k-gram hashes of the license
templates.  A match at document word ``i`` and template word ``j`` votes for
the diagonal ``i - j``; votes are counted per document, template and diagonal,
diagonals that insertions and deletions can bring together are merged, and each
merged region is verified word by word against its template.

How far to merge, how many votes to ask and how wide a region is follow from
the similarity alone (:func:`fewest_votes`, :func:`reach`), so that no stretch of
that similarity goes unverified.
"""

from __future__ import annotations

import bisect
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import as_bytes, column, cut, lower_words, row_key, small_batches

#: Words to a gram: of longer ones a few changes, evenly spread, leave none.
KGRAM, MIN_SIMILARITY = 2, 0.8
_A = np.uint64(0x9E3779B97F4A7C15)
#: Templates are broadcast up to this many k-grams; a larger set is joined by a shuffle.
BROADCAST_GRAMS = 1_000_000

# Phrases and labels of the base rule.
BASE_PHRASES = {
    "gpl": "gnu general public license",
    "apache": "apache license",
    "cc-by": "cc by",
    "mit": "mit license",
}

# Short notices of common public licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd-3-clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def gram_hashes(words: list[bytes], k: int = KGRAM) -> np.ndarray:
    """Rolling hashes of ``k`` consecutive words, as signed longs."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = (out ^ (out >> np.uint64(31))) * _A + h[j : n + j]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def base_places(words: list[bytes], phrases=BASE_PHRASES) -> list[tuple[int, str]]:
    """Word index and label of every place where a phrase's words stand consecutively."""
    joined = b" " + b" ".join(words) + b" "
    found = []
    for label, phrase in phrases.items():
        needle = b" " + phrase.encode() + b" "
        at, counted, place = joined.find(needle), 0, 0
        while at >= 0:
            # blanks before it, counted on from the last one
            place, counted = place + joined.count(b" ", counted, at), at
            found.append((place, label))
            at = joined.find(needle, at + 1)
    return sorted(found)


def similarity(words: list[bytes], template: list[bytes], least: float = 0.0) -> tuple[float, int, int]:
    """Best agreement of a stretch of ``words`` with the template: twice the common
    subsequence over both lengths, and the stretch ``[start, end)``; zeros below ``least``.

    The best ratio p / q is that at which no stretch has a positive balance of ``2 q`` for
    each common word less ``p`` for each word; each round goes on from a better ratio.
    """
    known, ratio, found = set(template), Fraction(least).limit_denominator(1000), (0.0, 0, 0)
    while True:
        p, q = ratio.numerator, ratio.denominator
        # for each beginning of the template: balance and start of the best stretch up to here
        above, best = [(0, 0)] * (len(template) + 1), (-1, 0, 0)
        for i, w in enumerate(words):
            none = (0, i + 1)
            if w not in known:
                above = [(v - p, s) if v > p else none for v, s in above]
                continue
            row = [none]
            for j, t in enumerate(template):
                v, s = above[j + 1]
                cell = max((v - p, s), row[j])
                if w == t:
                    v, s = above[j]
                    cell = max(cell, (v + 2 * q - p, s))
                row.append(max(cell, none))
            above = row
            if row[-1][0] > best[0]:
                best = (row[-1][0], row[-1][1], i + 1)
        balance, s, e = best
        gained = balance - p * len(template)
        if gained < 0 or s >= e or (gained == 0 and found[0]):
            return found
        ratio = Fraction((balance + p * (e - s)) // q, e - s + len(template))
        found = (float(ratio), s, e)
        if gained == 0:
            return found


def fewest_votes(length: int, least: float = MIN_SIMILARITY, k: int = KGRAM) -> int:
    """Grams that every stretch at a similarity of ``least`` shares with a template of
    ``length`` words, in order; at least one is asked.

    Of ``total`` words of both, ``least / 2`` are in common, and each of the others breaks
    at most one run of common words; a run of n words has ``n - k + 1`` grams.  A template
    of three words or fewer may share none.
    """
    total = 2 * length / (2 - least)
    return max(1, math.ceil(total * (least / 2 - (k - 1) * (1 - least)) - (k - 1) - 1e-9))


def reach(length: int, least: float = MIN_SIMILARITY) -> int:
    """How far apart two diagonals of one such stretch can be: it has no more words of its own."""
    return int(2 * length * (1 / least - 1) + 1e-9)


def stretches(words: list[bytes], low: int, high: int, template: list[bytes]):
    """A region in overlapping pieces of four template lengths.  A stretch at a similarity of
    0.8 is at most one and a half long, so it lies whole in a piece; pieces, unlike
    regions of many chained diagonals, don't grow with the text."""
    step = 2 * len(template)
    for at in range(low, max(low + 1, min(high, len(words)) - step), step):
        yield at, words[at : min(high, at + 2 * step)]


def similar_spans(words: list[bytes], template: list[bytes], least: float = MIN_SIMILARITY):
    """``(similarity, start, end)`` of the most similar stretch, and of those before and after it."""
    known, parts = set(template), [(0, len(words))]
    # a stretch has this many of the template's words: S words of both have least * S / 2 in common
    needed = least * len(template) / (2 - least) - 1e-9
    while parts:
        low, high = parts.pop()
        here = known.intersection(words[low:high])
        if sum(t in here for t in template) < needed:
            continue
        score, s, e = similarity(words[low:high], template, least)
        if score:
            yield score, low + s, low + e
            parts += [(low, low + s), (low + e, high)]


def _template_grams(spark, templates, k: int, least: float) -> DataFrame:
    rows = []
    for number, (_, text) in enumerate(templates):
        words = lower_words(text.encode())
        asked = len(words), fewest_votes(len(words), least, k), reach(len(words), least)
        rows += [(number, at, int(h), *asked) for at, h in enumerate(gram_hashes(words, k))]
    grams = spark.createDataFrame(rows, "template int, tpos int, h long, length int, enough int, reach int")
    return F.broadcast(grams) if len(rows) <= BROADCAST_GRAMS else grams


def voted_regions(rows: DataFrame, templates, k: int, least: float) -> DataFrame:
    """``rows(key, text)`` to ``(key, template, from_word, to_word)``: regions of merged diagonals.

    Repeated rows vote again, for regions that are verified like any other.
    """

    def grams(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hashes = [gram_hashes(lower_words(t), k) for t in part.column(1).to_pylist()]
                offsets = np.r_[0, np.cumsum([len(h) for h in hashes])].astype(np.int32)
                values = pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["key", "hashes"])

    hashed = rows.mapInArrow(grams, "key string, hashes array<long>")
    rolling = hashed.select("key", F.posexplode("hashes").alias("pos", "h"))
    per_template = ["key", "template", "length", "enough", "reach"]
    votes = (
        rolling.join(_template_grams(rows.sparkSession, templates, k, least), "h")
        .groupBy(*per_template, (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.count("*").alias("votes"))
    )
    order = W.partitionBy("key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(0)) > F.col("reach")
    merged = votes.withColumn("group", F.sum(F.when(apart, 1).otherwise(0)).over(order)).groupBy(*per_template, "group")
    regions = merged.agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high")).where("votes >= enough")
    # a stretch begins on a diagonal within reach of a voted one, and ends on another
    return regions.select("key", "template", F.greatest(F.col("low") - F.col("reach"), F.lit(0)).alias("from_word"), (F.col("high") + F.col("length") + F.col("reach")).alias("to_word"))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates=TEMPLATES,
    k: int = KGRAM,
    min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """``(doc_id, n_words, base array<struct<at,label>>, spans array<struct<start,end,label,similarity>>)``.

    ``base`` has every place of a base phrase; ``spans`` the verified template
    spans in words, of overlapping ones only the most similar, of equally
    similar ones the first.  One row for each input row, repeated rows and null
    ids included; null and empty texts have no words and no spans; other columns
    are not read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    numbered = docs.select(column(id_col).alias("doc_id"), row_key(column(id_col), column(text_col)).alias("key"), as_bytes(column(text_col)).alias("text"))
    regions = voted_regions(numbered.select("key", "text"), templates, k, min_similarity)
    per_key = cut(regions.groupBy(F.col("key").alias("voted")).agg(F.collect_list(F.struct("template", "from_word", "to_word")).alias("regions")), "regions")

    words_of = [(label, lower_words(text.encode())) for label, text in templates]
    kind, base_kind = to_arrow_type(id_type), pa.list_(pa.struct([("at", pa.int64()), ("label", pa.string())]))
    span_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("similarity", pa.float64())]))

    def verified(words, found):
        spans = set()
        for r in found or ():
            label, template = words_of[r["template"]]
            for at, piece in stretches(words, r["from_word"], r["to_word"], template):
                spans.update((-score, at + s, at + e, label) for score, s, e in similar_spans(piece, template, min_similarity))
        kept = []  # disjoint, by start
        for score, s, e, label in sorted(spans):
            at = bisect.bisect_left(kept, (s,))
            if (at == 0 or kept[at - 1][1] <= s) and (at == len(kept) or kept[at][0] >= e):
                kept.insert(at, (s, e, label, -score))
        return [dict(zip(("start", "end", "label", "similarity"), x)) for x in kept]

    def read(batches):
        for batch in batches:
            words = [lower_words(t) for t in batch.column(1).to_pylist()]
            places = [[{"at": a, "label": x} for a, x in base_places(w)] for w in words]
            spans = [verified(w, found) for w, found in zip(words, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(kind), pa.array([len(w) for w in words], pa.int64()), pa.array(places, base_kind), pa.array(spans, span_kind)], ["doc_id", "n_words", "base", "spans"]
            )

    out = f"doc_id {id_type.simpleString()}, n_words long, base array<struct<at:long,label:string>>, spans array<struct<start:long,end:long,label:string,similarity:double>>"
    return numbered.join(per_key, F.col("key") == F.col("voted"), "left").select("doc_id", "text", "regions").mapInArrow(read, out)


def license_report(found: DataFrame) -> DataFrame:
    """Digest columns of :func:`license_scan`."""
    base = F.transform("base", lambda b: b["label"])
    own = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    places = F.transform("base", lambda b: b["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["similarity"])), F.lit(0.0))).alias("score"),
    )
