"""License scans with a positional rare-token index, in DataFrame functions only.

``TEMPLATES`` are licence passages as word sequences with mandatory key phrases.
Document frequencies of their words are counted over the whole corpus, and each
key phrase is indexed under its ``RARE`` words of the highest IDF: word to
(phrase, position). A file looks up which of these words it holds; for a phrase
of which it holds all of them, the places that each word's occurrences give the
phrase (place in the file less position in the phrase) are intersected, and the
phrase is verified word by word at the places that are left. All words of a
phrase stand in a file that holds the phrase, so no label is lost, whatever else
the file holds. A label's score is the share of its whole passage that stands in
place around the phrase.

The base phrases are matched in every file by themselves, wherever they stand.

Files stay rows: the index is a literal of a fixed size, the frequencies are
one row of at most ``len(vocabulary())`` numbers, and nothing else is shuffled.

Defined results: null and empty texts have no words, no places and no labels,
and score 0; texts are read whole, however long; words of equal IDF count in
the order of their names, which changes no result; repeated rows give equal
rows; an empty table gives no rows; other columns stay, whatever their names,
unless an output has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Passages of public licences, lower-cased, and phrases of which one must stand in place.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-2.0": ("this program is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "lgpl": ("gnu lesser general public license", ("lesser general public license",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    "mit-release": ("released under the mit license", ("released under the mit license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission to use copy modify and or distribute this software",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    "all-rights": ("copyright all rights reserved", ("all rights reserved",)),
}

RARE = 3
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES) -> list[str]:
    return sorted({w for passage, _ in templates.values() for w in passage.split()})


def pieces(text: Column) -> Column:
    """The text cut at what is no word; only the first and the last piece can be empty.

    ``lower`` also lower-cases characters beyond ASCII. That moves no border
    between words, and of what it turns into ASCII (the kelvin sign into k)
    nothing stands in a base phrase.
    """
    return F.split(F.lower(text), SPLIT, -1)


def _count(pieces: str) -> Column:
    """Words among the pieces."""
    return F.expr(f"size({pieces}) - case when {pieces}[0] = '' then 1 else 0 end - case when size({pieces}) > 1 and {pieces}[size({pieces}) - 1] = '' then 1 else 0 end").cast("long")


def triggers() -> list[str]:
    """The longest word of each base phrase: a file that lacks them all has no place."""
    return sorted({max(p.split(), key=len) for p in BASE})


def _places(phrase: str, spaced: str, ws: str) -> Column:
    """Starts of a phrase, in words; a file without it costs one search."""
    parts = phrase.split()
    test = " and ".join(f"{ws}[i + {k}] = '{w}'" for k, w in enumerate(parts))
    return F.expr(f"case when contains({spaced}, ' {phrase} ') then filter(sequence(0, size({ws}) - {len(parts)}), i -> {test}) else cast(array() as array<int>) end")


def frequencies(df: DataFrame, text: str = "text", templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Rows of the whole table, and the rows that hold each licence word; one row of partial counts for each task is all that is shuffled."""
    known = vocabulary(templates)
    held = F.array_intersect(F.array(*map(F.lit, known)), pieces(F.coalesce(df[text], F.lit(""))))
    row = df.select(held.alias("h")).agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("h", w)).alias(f"w{i}") for i, w in enumerate(known))).first()
    return row["n"], {w: row[f"w{i}"] for i, w in enumerate(known)}


def _offset(passage: str, phrase: str) -> int:
    """Where a phrase starts in its passage, in words."""
    words, parts = passage.split(), phrase.split()
    return next(k for k in range(len(words)) if words[k : k + len(parts)] == parts)


def index(order: dict[str, int], templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES, rare: int = RARE) -> list[tuple[str, int, str, list[tuple[str, int]]]]:
    """Label, offset in the passage, key phrase and its rarest words with their positions, rarest first; ``order`` gives each word's place by IDF."""
    out = []
    for label, (passage, phrases) in templates.items():
        for phrase in phrases:
            parts = phrase.split()
            chosen = sorted(set(parts), key=order.__getitem__)[:rare]
            out.append((label, _offset(passage, phrase), phrase, [(w, parts.index(w)) for w in chosen]))
    return out


def scan(df: DataFrame, text: str = "text", templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES, rare: int = RARE, counts: tuple[int, dict[str, int]] | None = None) -> DataFrame:
    """``df`` with ``n_words``, ``places`` (starts of base phrases by label), ``found`` (labels of templates, where the passage would start, and the share of it that stands there)."""
    import math

    total, having = counts or frequencies(df, text, templates)
    idf = {w: math.log((1 + total) / (1 + n)) for w, n in having.items()}
    order = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
    entries = index(order, templates, rare)
    looked_up = sorted({w for _, _, _, chosen in entries for w, _ in chosen})

    # The input's columns stand in a struct of their own, so that no name of theirs meets one of these.
    row = F.struct(*(df[c] for c in common.others(df, ("n_words", "places", "found")))).alias("row")
    out = df.select(row, pieces(F.coalesce(df[text], F.lit(""))).alias("cut"))
    wanted = F.array(*map(F.lit, sorted({*triggers(), *looked_up})))
    out = out.select("row", _count("cut").alias("n_words"), F.array_intersect(wanted, "cut").alias("held"), F.array_remove("cut", "").alias("w"))
    base = F.arrays_overlap("held", F.array(*map(F.lit, triggers())))
    out = out.withColumn("spaced", F.when(base, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))))
    out = out.withColumns({f"p{i}": _places(p, "spaced", "w") for i, p in enumerate(BASE)})
    # Phrases of which the file holds every chosen word.
    holds = [" and ".join(f"array_contains(held, '{w}')" for w, _ in chosen) for _, _, _, chosen in entries]
    out = out.withColumn("hit", F.expr(" or ".join(f"({h})" for h in holds)))
    # Occurrences of chosen words. A column that only a lambda uses would be computed within it, for every word; so the condition uses it too.
    rare_held = F.array_intersect("held", F.array(*map(F.lit, looked_up)))
    out = out.withColumn("rare", F.when(F.col("hit"), rare_held))
    placed = F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    out = out.withColumn("at", F.when(F.col("hit") & (F.size("rare") > 0), F.filter(placed, lambda x: F.array_contains(F.col("rare"), x["w"]))))
    found = []
    for (label, offset, phrase, chosen), held in zip(entries, holds, strict=True):
        # Postings of each chosen word as places of the phrase, intersected.
        sets = [f"transform(filter(at, x -> x.w = '{w}'), x -> x.i - {p})" for w, p in chosen]
        both = sets[0]
        for s in sets[1:]:
            both = f"array_intersect({both}, {s})"
        same = " and ".join(f"get(w, i + {k}) = '{x}'" for k, x in enumerate(phrase.split()))
        passage = templates[label][0].split()
        share = " + ".join(f"if(get(w, i + {k - offset}) <=> '{x}', 1, 0)" for k, x in enumerate(passage))
        none = "cast(array() as array<struct<label:string,start:int,score:double>>)"
        found.append(f"case when hit and {held} then transform(filter({both}, i -> {same}), i -> named_struct('label', '{label}', 'start', i - {offset}, 'score', cast(({share}) / {float(len(passage))} as double))) else {none} end")
    places = F.array(*(F.struct(F.lit(label).alias("label"), F.col(f"p{i}").alias("starts")) for i, label in enumerate(BASE.values())))
    return out.select("row.*", "n_words", places.alias("places"), F.expr(f"concat({', '.join(found)})").alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.flatten(F.transform("places", lambda p: p["starts"]))
    base = F.transform(F.filter("places", lambda p: F.size(p["starts"]) > 0), lambda p: p["label"])
    found = found.withColumn("starts", starts).withColumn("base", base)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    best = F.array_max(F.transform("found", lambda x: x["score"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    """SQL for the same rows from phrases alone, without an index: a label is a key phrase in place."""
    base = list(BASE.items())
    key = [(t, _offset(passage, p), len(passage.split()), p) for t, (passage, phrases) in TEMPLATES.items() for p in phrases]
    word = [(t, i, w) for t, (passage, _) in TEMPLATES.items() for i, w in enumerate(passage.split())]
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return rf"""
WITH base(phrase, label) AS (VALUES {values(base)}), key(t, offs, n, phrase) AS (VALUES {values(key)}), word(t, pos, word) AS (VALUES {values(word)}),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
b AS (SELECT DISTINCT d.doc_id, label, i FROM d JOIN u ON u.doc_id = d.doc_id JOIN base ON split_part(phrase, ' ', 1) = u.word
  WHERE array_to_string(d.w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
p AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
k AS (SELECT DISTINCT d.doc_id, t, n, i - offs AS start FROM d JOIN u ON u.doc_id = d.doc_id JOIN key ON split_part(phrase, ' ', 1) = u.word
  WHERE array_to_string(d.w[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
f AS (SELECT k.doc_id, k.t AS label, k.start, count(*) / any_value(k.n)::DOUBLE AS score FROM k JOIN word ON word.t = k.t JOIN u ON u.doc_id = k.doc_id AND u.i = k.start + word.pos AND u.word = word.word GROUP BY 1, 2, 3),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, 1.0::DOUBLE AS score FROM b UNION ALL SELECT doc_id, label, score FROM f) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(l.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
"""


ORACLE_SQL = _oracle()
