"""License scans by diagonal voting (DataFrame operations only).

All rolling word k-grams of every text are joined, by hash, to the k-gram positions of the templates; the gram's words are
confirmed.  A match votes for the diagonal ``text position - template position``.  A phrase stands at a place exactly if
all its grams vote for one diagonal; longer templates tolerate edits: neighbouring diagonals are merged into one span,
which is verified by the share of distinct template grams it holds, by the gram that tells the licence from its relatives,
and by its length in the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_GRAM = -1  # in place of the hash in the row that stands for a text itself
MAX_TEMPLATE_WORDS = 20_000  # the broadcast bound, over all templates


class Template(NamedTuple):
    label: str
    text: str
    exact: bool  # a phrase whose every word must stand consecutively
    key: str = ""  # a gram that a span must hold, where much of the wording is shared with other licences


# Phrases and labels of the base contract.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Notices from public license texts and one-sentence references to them, matched with tolerance.
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", False),
    Template("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", False),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", False),
    Template("bsd", "licensed under the BSD license", False, "the bsd license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", False, "gnu general public"),
    Template("gpl", "licensed under the GNU General Public License version 3", False, "gnu general public"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", False, "gnu lesser general"),
    Template("lgpl", "licensed under the GNU Lesser General Public License", False, "gnu lesser general"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", False, "mozilla public license"),
    Template("mpl-2", "licensed under the Mozilla Public License version 2", False, "mozilla public license"),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial International License", False, "commons attribution noncommercial"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike International License", False, "commons attribution sharealike"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", False),
)


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATORS, text.translate(str.maketrans(_UPPER, _UPPER.lower()))) if w]


def template_grams(text: str, k: int) -> list[str]:
    w = template_words(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def _gram_table(spark, templates: Sequence[Template], k: int) -> DataFrame:
    """(tgram, th, tid, tpos, gid, is_key) of every template gram, and the row (null gram, tid -1) that every text meets once.

    gid: the first position of an equal gram in the template.
    """
    rows = ["(CAST(NULL AS STRING), -1, -1, -1, false)"]
    for tid, t in enumerate(templates):
        grams = template_grams(t.text, k)
        if not grams:
            raise ValueError(f"template {t.text!r} has fewer than {k} words")
        if t.key and t.key not in grams:
            raise ValueError(f"key {t.key!r} is no {k}-gram of template {t.text!r}")
        rows += [f"('{g}', {tid}, {i}, {grams.index(g)}, {str(g == t.key).lower()})" for i, g in enumerate(grams)]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {MAX_TEMPLATE_WORDS} grams")
    table = spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(tgram, tid, tpos, gid, is_key)")
    return table.withColumn("th", F.coalesce(_gram_hash(*[F.get(F.split("tgram", " "), F.lit(i)) for i in range(k)]), F.lit(_NO_GRAM).cast("long")))


def _gram_hash(*own: Column) -> Column:
    """Hash of a gram's words; null where the text has ended."""
    return F.when(own[-1].isNotNull(), F.xxhash64(*own))


def license_scan(
    docs: DataFrame,
    templates: Sequence[Template] = BASE + NOTICES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 3,
    drift: int = 4,
    min_share: float = 0.6,
) -> DataFrame:
    """Spans of license templates: (rid, doc_id, n_words, label, exact, first_word, last_word, score) for each span.

    Each text also has one row with null label, so that texts without spans are kept.  ``rid`` tells input rows apart when
    doc_ids repeat.  drift: how far apart diagonals may lie that are merged; min_share: share of a tolerant template's
    distinct grams that a span must hold to be verified.

    Null and empty texts have n_words 0 and no span; texts shorter than k words have no span.  Repeated rows are scanned
    one by one.  An empty table gives an empty result; other columns of the input are not read.
    """
    table = _gram_table(docs.sparkSession, templates, k)
    sizes = [len(template_words(t.text)) - k + 1 for t in templates]
    kinds = [len(set(template_grams(t.text, k))) for t in templates]
    # The i-th words of all grams side by side; behind the last word stands one null, the row of the text itself.
    padded = F.concat("w", F.array(F.lit(None).cast("string")))
    zipped = F.arrays_zip(*[F.slice(padded, i + 1, F.greatest(F.size("w") + (1 - i), F.lit(0))).alias(f"w{i}") for i in range(k)])
    own = [F.col(f"g.w{i}") for i in range(k)]
    gram = F.concat_ws(" ", *own)
    rolled = (
        docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
        .withColumn("rid", F.monotonically_increasing_id())
        .select("rid", "doc_id", F.size("w").alias("n_words"), F.posexplode(zipped).alias("pos", "g"))
        .withColumn("h", F.when(own[0].isNull(), F.lit(_NO_GRAM).cast("long")).otherwise(_gram_hash(*own)))
    )
    # The hash alone is the join's key, so that a gram's string is built for hits only; >= and <= confirm it.
    confirmed = F.when(F.col("tid") < 0, own[0].isNull()).otherwise((gram >= F.col("tgram")) & (gram <= F.col("tgram")))
    hits = rolled.join(F.broadcast(table), (F.col("h") == F.col("th")) & confirmed)
    votes = hits.groupBy("rid", "doc_id", "n_words", "tid", F.when(F.col("tid") >= 0, F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"),
        F.min("tpos").alias("t0"),
        F.max("tpos").alias("t1"),
        F.collect_set("gid").alias("grams"),
        F.max("is_key").alias("has_key"),
    )
    ids = range(len(templates))
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("tid") + 1)
    exact = F.when(F.col("tid") >= 0, pick([templates[i].exact for i in ids]))
    by = Window.partitionBy("rid", "tid").orderBy("diagonal")
    apart = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(by) > drift), F.lit(True))
    spans = (
        votes.withColumn("exact", exact)
        .withColumn("span", F.sum(apart.cast("int")).over(by))
        .groupBy("rid", "doc_id", "n_words", "tid", "exact", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("grams")))).alias("grams"),
            F.max("has_key").alias("has_key"),
            F.sum("votes").alias("votes"),
            F.min(F.col("diagonal") + F.col("t0")).alias("first_word"),
            F.max(F.col("diagonal") + F.col("t1") + (k - 1)).alias("last_word"),
        )
        .withColumn("share", F.when(F.col("tid") >= 0, F.col("grams") / pick(kinds)))
    )
    tolerated = (
        (F.col("share") >= min_share)
        & (F.col("has_key") | ~pick([bool(t.key) for t in templates]))
        & (F.col("last_word") - F.col("first_word") < 2 * pick(sizes) + 2 * k)
    )
    fits = F.when(F.col("exact"), F.col("votes") == pick(sizes)).otherwise(tolerated)
    return spans.filter((F.col("tid") < 0) | fits).select(
        "rid",
        "doc_id",
        "n_words",
        F.when(F.col("tid") >= 0, pick([t.label for t in templates])).alias("label"),
        "exact",
        "first_word",
        "last_word",
        F.col("share").alias("score"),
    )


def license_labels(spans: DataFrame) -> DataFrame:
    """One row per text from the spans of :func:`license_scan`; base_* columns count exact phrases only."""
    base = F.col("exact") & F.col("label").isNotNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("rid", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).cast("double").alias("score"),
    ).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
