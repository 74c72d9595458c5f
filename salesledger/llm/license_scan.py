"""License scans on built-in functions: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates become lower-case tokens of letters and digits and 3-token shingles. For each template length there is a
window of that many tokens at every position of a text. A window and a template with one band of equal minima are a
candidate pair; the pair is a match where the window holds at least 75% of the template's shingles.

A band can only be equal where the window holds the shingles that give the template's minima. So the join is
prepared by marking the positions of such shingles, and windows are built around marked positions only: the candidates
are those of all windows, the cost is that of the marked ones.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 3
CONTAINED = 0.75
BANDS, ROWS = 16, 2
CERTAIN = 0.99
"""Least chance that a window with the threshold's containment shares a band with its template."""

MOST_TEMPLATES = 4096
MOST_TOKENS = 512
"""Bounds of the template table, which is broadcast and, as a list of its minima, part of the plan."""

# --- fixed values: notices that name a license ---
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def band_chance(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """Chance that two sets of this similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def least_similarity(contained: float, shingles: int, window: int) -> float:
    """Least Jaccard similarity, by which bands meet, of a template's shingles and a window that holds enough of them."""
    shared = max(1, math.ceil(contained * shingles - 1e-9))
    return shared / (window + shingles - shared)


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    return spark.createDataFrame(list(templates.items()), "license string, template string")


def _tokens(text: str) -> str:
    return f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')"


def _shingles(tokens: str) -> str:
    """Hashes of the shingles by first token; fewer tokens than a shingle has give none."""
    parts = ", ".join(f"{tokens}[i + {k}]" for k in range(SHINGLE))
    return f"""if(size({tokens}) < {SHINGLE}, CAST(array() AS ARRAY<BIGINT>),
                  transform(sequence(0, size({tokens}) - {SHINGLE}), i -> xxhash64({parts})))"""


def _minima(shingles: str, hashes: int) -> str:
    """Shingles that are least under each hash function, as an array."""
    least = ", ".join(
        f"aggregate({shingles}, named_struct('m', CAST(NULL AS BIGINT), 's', CAST(NULL AS BIGINT)),"
        f" (a, s) -> IF(a.m IS NULL OR xxhash64(s, {k}) < a.m, named_struct('m', xxhash64(s, {k}), 's', s), a), a -> a.s)"
        for k in range(hashes)
    )
    return f"array({least})"


def _bands(minima: str, bands: int, rows: int) -> str:
    keys = ", ".join(
        f"xxhash64({b}, {', '.join(f'{minima}[{b * rows + r}]' for r in range(rows))})" for b in range(bands)
    )
    return f"array({keys})"


def scan(
    docs: DataFrame,
    templates: DataFrame | None = None,
    contained: float = CONTAINED,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per place where a text holds a template: doc_id, license, start, end (in tokens), containment.

    ``templates`` has license and template; it defaults to ``TEMPLATES``. Places of one license that overlap give their
    best one, the first of equals. Null and empty texts, and texts without a match, have no rows; a repeated row gives
    its matches once. Templates need as many tokens as a shingle has. Texts are read whole. Raises where band settings
    miss a window of the threshold's containment more often than 1 - CERTAIN, for any template or for one of the table
    that repeats its shingles, and where the template table is
    larger than its bound.
    """
    if band_chance(contained / (2 - contained), bands, rows) < CERTAIN:
        raise ValueError("more bands or fewer rows are needed to find matches with high probability")
    spark = docs.sparkSession
    templates = template_table(spark) if templates is None else templates
    hashes = bands * rows
    wanted = (
        templates.select("license", F.expr(_tokens("template")).alias("t"))
        .select("license", F.expr("CAST(size(t) AS INT)").alias("n"), F.expr(f"array_distinct({_shingles('t')})").alias("set"))
        .where("size(set) > 0")
        .select("*", F.expr(_minima("set", hashes)).alias("m"))
        .select("license", "n", "set", "m", F.expr(_bands("m", bands, rows)).alias("keys"))
    )
    # One row more than the bound allows tells that it does not hold.
    known = wanted.limit(MOST_TEMPLATES + 1).collect()
    if len(known) > MOST_TEMPLATES or any(row.n > MOST_TOKENS for row in known):
        raise ValueError(f"a scan takes {MOST_TEMPLATES} templates of {MOST_TOKENS} tokens at most")
    for row in known:
        similarity = least_similarity(contained, len(row.set), row.n - SHINGLE + 1)
        if band_chance(similarity, bands, rows) < CERTAIN:
            raise ValueError(f"more bands or fewer rows are needed for the template of {row.license}")
    marks = sorted({s for row in known for s in row.m})
    lengths = sorted({row.n for row in known})
    if not marks:
        marks, lengths = [0], [SHINGLE]
    marked = f"({', '.join(f'{s}L' for s in marks)})"
    wanted = spark.createDataFrame(known, wanted.schema)

    texts = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", f"{_tokens('CAST(text AS STRING)')} AS t")
    hashed = texts.selectExpr("doc_id", f"{_shingles('t')} AS h")
    hit = hashed.selectExpr(
        "doc_id", "h", f"filter(transform(h, (s, i) -> IF(s IN {marked}, i, -1)), i -> i >= 0) AS at"
    )
    # Every start whose window holds a marked shingle, by window length; windows reach over the text's end. Texts
    # without a mark have none and go here.
    starts = f"array_distinct(flatten(transform(at, i -> sequence(greatest(0, i - n + {SHINGLE}), i))))"
    windows = hit.selectExpr(
        "doc_id",
        f"""inline(flatten(transform(array({', '.join(map(str, lengths))}), n -> transform({starts}, s -> named_struct(
              'n', n, 'start', s, 'set', array_distinct(slice(h, s + 1, n - {SHINGLE - 1})))))))""",
    )
    keyed = windows.select("*", F.expr(_minima("set", hashes)).alias("m")).select(
        "doc_id", "n", "start", "set", F.expr(_bands("m", bands, rows)).alias("keys")
    )
    band = F.broadcast(wanted.select("license", F.col("n").alias("tn"), F.col("set").alias("tset"), "keys"))
    pairs = (
        keyed.alias("w")
        .join(band.alias("t"), F.expr("w.n = t.tn AND arrays_overlap(w.keys, t.keys)"))
        .selectExpr("doc_id", "license", "start", "start + n AS end", "size(array_intersect(set, tset)) / size(tset) AS containment")
        .where(F.col("containment") >= contained)
        .distinct()
    )
    return best_places(pairs)


def best_places(pairs: DataFrame) -> DataFrame:
    """Of overlapping places of one license in one text the best, the first of equals.

    A text's places of one license are in one row; there are no more than it has tokens.
    """
    grouped = pairs.groupBy("doc_id", "license").agg(
        F.expr("array_sort(collect_list(struct(start, end, containment)))").alias("places")
    )
    kept = """aggregate(places, CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, containment: DOUBLE, reach: INT>>),
        (done, p) -> CASE
            WHEN size(done) = 0 OR element_at(done, -1).reach <= p.start
                THEN concat(done, array(named_struct('start', p.start, 'end', p.end, 'containment', p.containment, 'reach', p.end)))
            WHEN element_at(done, -1).containment < p.containment
                THEN concat(slice(done, 1, size(done) - 1),
                            array(named_struct('start', p.start, 'end', p.end, 'containment', p.containment, 'reach', p.end)))
            ELSE concat(slice(done, 1, size(done) - 1),
                        array(named_struct('start', element_at(done, -1).start, 'end', element_at(done, -1).end,
                                           'containment', element_at(done, -1).containment, 'reach', element_at(done, -1).reach)))
        END)"""
    return grouped.select("doc_id", "license", F.explode(F.expr(kept)).alias("p")).selectExpr(
        "doc_id", "license", "CAST(p.start AS BIGINT) AS start", "CAST(p.end AS BIGINT) AS end", "p.containment AS containment"
    )
