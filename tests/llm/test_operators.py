"""Each operator against the plain form of its contract, on texts with nulls, empties, copies, ties and clashing columns."""

import json
import math
import random
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.sqlcheck import same

from siltrace.llm import queries as Q
from siltrace.llm.bpe import bpe_decode, bpe_digests, bpe_encode
from siltrace.llm.components import connected_components
from siltrace.llm.language_id import WIDTHS, WINDOW, ByteCnn, held_out, predict_language, train_language_model, windows_of
from siltrace.llm.license_scan import license_labels, license_scan
from siltrace.llm.minhash_dedup import near_duplicates
from siltrace.llm.mixing import DOMAINS, domain_posteriors, drawn, fit_rates, mix_to_targets
from siltrace.llm.quality_rules import quality_filter, quality_rules
from siltrace.llm.substring_dedup import substring_dedup
from siltrace.llm.suffix_dedup import deep_buckets, suffix_dedup, suffix_digests
from siltrace.llm.topk_search import sparse_rows, topk_search
from siltrace.llm.url_filter import url_filter


POSTERIORS = "rid long, doc_id long, text_key long, n_tokens long, posteriors array<double>"


def pairs(corpus):
    return [(r[0], r[1]) for r in corpus]


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    same(Q.QUERIES[name](spark, sf), Q.ORACLES[name], sf)


# 1


def embeddings(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (260, 8)).round(1)
    v[7] = v[3]
    v[:, 5] = 0
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows[11] = (11, None)
    rows[12] = (12, [float("nan")] * 8)
    rows[13] = (13, [1.0] * 7 + [None])
    rows[14] = (14, [])
    return rows + [rows[20]], spark.createDataFrame(rows + [rows[20]], "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "terms": F.lit(1)})


def test_topk_equals_exhaustive_search(spark):
    rows, df = embeddings(spark)
    own = sparse_rows(df, "vec_id", F.col("embedding"))
    got = topk_search(own, own.filter("id % 100 = 0"), 10, candidates_per_block=50, queries_per_block=2)
    q = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, a in {k: v for k, v in q if k % 100 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i)[:10]
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_topk_leaves_out_rows_without_id(spark):
    rows = [(1, [1.0, 0.0]), (None, [9.0, 9.0]), (2, [0.5, 0.5]), (None, [0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cb", "qb", "rank", "score", "query_id")})
    own = sparse_rows(df, "vec_id", F.col("embedding"))
    assert own.count() == 2
    given = spark.createDataFrame([(1, [0], [3]), (None, [0], [5]), (2, [0], [7])], "id long, terms array<int>, weights array<long>")
    assert [tuple(r) for r in topk_search(given, given.filter("id IS NULL OR id = 1")).collect()] == [(1, 1, 2, 21)]
    wide = spark.createDataFrame([(i, [float(i)] * 3000) for i in range(3)], "vec_id long, embedding array<double>")
    wide = sparse_rows(wide, "vec_id", F.col("embedding"))
    assert [tuple(r) for r in topk_search(wide, wide.filter("id = 1"), 1).collect()] == [(1, 1, 2, 3000 * 1024 * 2048)]
    with pytest.raises(Exception, match="too large"):
        sparse_rows(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), "vec_id", F.col("embedding")).collect()


def test_topk_with_few_or_no_candidates(spark):
    _, df = embeddings(spark)
    own = sparse_rows(df, "vec_id", F.col("embedding"))
    assert topk_search(own.filter("id in (0, 1, 2)"), own.filter("id = 0")).count() == 2
    assert topk_search(own.filter("id < 0"), own.filter("id = 0")).count() == 0
    assert topk_search(own, own.filter("id < 0")).count() == 0


# 2


def test_suffix_dedup_equals_brute_force(docs, corpus):
    got = {r.doc_id: tuple(r) for r in suffix_digests(suffix_dedup(docs)).collect()}
    assert got == brute.byte_repeats(pairs(corpus))


def test_bucket_pointers_tell_strings_apart():
    rng = np.random.default_rng(0)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 4000)
    text[500:900] = text[100:500]
    room = len(text) - np.arange(len(text))
    suffixes = np.flatnonzero(room >= 50)
    pointer = deep_buckets(text, room, suffixes, 50)
    by_string, by_pointer = {}, {}
    for s, p in zip(suffixes, pointer, strict=True):
        by_string.setdefault(text[s : s + 50].tobytes(), set()).add(int(s))
        by_pointer.setdefault(int(p), set()).add(int(s))
    assert sorted(map(sorted, by_string.values())) == sorted(map(sorted, by_pointer.values()))


def test_repeated_ids_never_remove_each_other(spark):
    text = "word%d " * 60 % tuple(range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in suffix_dedup(df).collect()) == [(0, True), (1, False), (1, False)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup(df).collect()) == [(0, 60), (1, 0), (1, 0)]


def repeating(n, seed=3):
    """Texts of odd lengths with shared passages, copies and runs of one letter."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages, rows = [prose(70), prose(55), prose(200)], []
    for i in range(n):
        t = prose(rng.randint(0, 120)) + (f" {rng.choice(passages)} {prose(rng.randint(0, 30))}" if rng.random() < 0.5 else "")
        t = "a" * rng.randint(0, 200) if rng.random() < 0.1 else rng.choice(rows)[1] if rows and rng.random() < 0.2 else t
        rows.append((i, t if rng.random() > 0.03 else None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [4096, 0, 2])
def test_suffix_dedup_over_many_batches_and_hot_anchors(spark, hot):
    rows = repeating(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in suffix_digests(suffix_dedup(df, batch_bytes=4000, hot_stretches=hot)).collect()}
    assert got == brute.byte_repeats(rows)


def test_one_anchor_in_every_text(spark):
    # 40 bytes that every text holds between bytes of its own: one anchor, many different strings, few of them repeated.
    rng = random.Random(8)
    own = lambda: "".join(rng.choice("xyz") for _ in range(rng.randint(3, 12)))
    rows = [(i, f"{own()}0123456789abcdefghijklmnopqrstuvwxyz+-*/{own()}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (10, 4096):
        got = {r.doc_id: tuple(r) for r in suffix_digests(suffix_dedup(df, batch_bytes=3000, hot_stretches=hot)).collect()}
        assert got == brute.byte_repeats(rows)


def test_substring_dedup_over_many_batches(spark):
    rows = repeating(120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, batch_bytes=4000).collect()}
    assert got == brute.word_repeats(rows)


def test_dedup_of_very_long_texts(spark):
    # One text above the size that is handled at once and above a batch, and one that repeats parts of it.
    rng = random.Random(4)
    text = " ".join(f"{rng.randrange(10**6):06d}" for _ in range(200_000))
    part = text[700_000:700_700]
    df = spark.createDataFrame([(1, text), (2, f"new words before {part} and after"), (None, text), (None, part)], "doc_id long, text string")
    words = len(brute.WORD.findall(part.strip()))
    got = sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in substring_dedup(df, batch_bytes=1 << 19).collect())
    assert [g for g in got if g[0] < 9] == [(1, 200_000, 0), (2, words + 5, words)] or got[1][2] in (words - 2, words - 1)
    assert sorted(g[1:] for g in got if g[0] == 9)[1] == (200_000, 200_000)
    got = {(r.doc_id, r.n_bytes): (r.n_removed, len(r.spans)) for r in suffix_dedup(df, batch_bytes=1 << 19).collect()}
    assert got[(1, len(text))] == (0, 0) and got[(None, len(text))] == (len(text), 1) and got[(None, len(part))] == (len(part), 1)
    assert got[(2, 17 + len(part) + 10)] [0] >= len(part)


def test_rows_without_an_id_lie_in_many_batches(spark):
    from siltrace.llm.exchange import Rounds

    df = spark.createDataFrame([(None, f"text number {i}") for i in range(200)], "doc_id long, text string")
    sizes = [r["count"] for r in Rounds(df, "doc_id", "text", batch_bytes=300).texts.groupBy("batch").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 60


def test_carried_columns_must_not_clash(docs):
    for run in (substring_dedup, suffix_dedup):
        with pytest.raises(ValueError, match="spans"):
            run(docs.withColumn("Spans", F.lit(1)), carry=("Spans",))


# 3


def least_squares(p, n, goal, have, pull, most, rounds=60_000):
    """The fit of rates in its plainest form: projected gradient on the dense problem until nothing changes."""
    r, weight = np.ones(len(n)), n / n.sum()
    for _ in range(rounds):
        new = np.clip(r - (p @ (((weight * r) @ p - goal) / have) + pull * (r - 1)) / (1 + pull), 0, most)
        if np.abs(new - r).max() < 1e-13:
            break
        r = new
    return r


@pytest.mark.parametrize("most", [np.inf, 1.2])
def test_rates_equal_dense_least_squares(spark, most):
    rng = np.random.default_rng(2)
    p, n = rng.dirichlet([0.4, 0.3, 0.3], 300), rng.integers(1, 200, 300)
    df = spark.createDataFrame([(i, i, i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))], POSTERIORS)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit = fit_rates(df, {"good": 0.7, "poor": 0.2, "toxic": 0.1}, passes=1.0, pull=0.02, most=most, steps=150, tolerance=0.0)
    rows = sorted(fit.collect(), key=lambda r: r.rid)
    have = (n / n.sum()) @ p
    goal = np.array([0.7, 0.2, 0.1]) / 0.7 * have[0]
    want = least_squares(p, n, goal, have, 0.02, most)
    assert np.abs(np.array([r.rate for r in rows]) - want).max() < 2e-3
    assert np.abs(np.array(rows[0].residuals) - ((n / n.sum() * want) @ p - goal)).max() < 1e-3


def test_targets_out_of_reach_are_reported(spark):
    df = spark.createDataFrame([(i, i, i, 10, [0.5, 0.3, 0.2]) for i in range(5)], POSTERIORS)
    with pytest.warns(UserWarning, match="targets missed"):
        rows = fit_rates(df, {"good": 0.9, "poor": 0.05, "toxic": 0.05}).collect()
    assert max(map(abs, rows[0].residuals)) > 0.01


def test_drawn_copies_follow_the_rates(spark):
    docs = spark.createDataFrame([(i, f"t{i}", 0) for i in range(3000)] + [(None, "x", 1), (None, "x", 1)], "doc_id long, text string, _copies long")
    rate = F.when(F.col("doc_id") < 1000, 0.25).when(F.col("doc_id") < 2000, 1.5).when(F.col("doc_id") < 3000, 0.0).otherwise(2.0)
    got = drawn(docs, docs.select("doc_id", F.xxhash64("text").alias("text_key"), rate.alias("rate")))
    assert got.schema == docs.schema
    n = {r.k: r["count"] for r in got.groupBy(F.floor(F.col("doc_id") / 1000).alias("k")).count().collect()}
    assert 200 < n[0] < 300 and 1430 < n[1] < 1570 and 2 not in n and n[None] == 4


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 800)
    n = rng.integers(0, 200, 800)
    rows = [(i, i, i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p, strict=True))]
    df = spark.createDataFrame(rows, POSTERIORS)
    out = {r.rid: r.rate for r in fit_rates(df, {"good": 0.6, "poor": 0.3, "toxic": 0.1}, passes=1.0).collect()}
    rate = np.array([out[i] for i in range(800)])
    assert (rate >= 0).all() and (rate[n == 0] == 1).all()
    have, got = n @ p, (n * rate) @ p
    goal = np.array([0.6, 0.3, 0.1]) / 0.6 * have[0]
    assert np.abs(got - goal).max() / n.sum() < 2e-3


def test_mixing_edge_cases(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = mix_to_targets(docs, none).collect()
    assert len(out) == docs.count()
    assert all(r.posteriors == pytest.approx([1 / len(DOMAINS)] * len(DOMAINS)) for r in out)
    assert mix_to_targets(no_docs, none).count() == 0
    assert domain_posteriors(no_docs, None).count() == 0


# 4


def test_quality_counts_equal_brute_force(docs, corpus):
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    for i, t in pairs(corpus):
        want = brute.quality(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_frequent_lines_are_removed_and_copies_count_once(spark):
    common = "Accept  all cookies to continue reading this page"
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{common.upper() if i % 2 else common}\n{body(i)}", "h") for i in range(40)]
    rows += [(200, "\n".join([common] * 12), "h"), (201, f"{common}\n{body(7)}", "other"), (202, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.unionByName(spark.createDataFrame([(100 + i, body(1000) + "\nown line of the copies", "h") for i in range(60)], df.schema))
    kept = {r.doc_id: r.text for r in quality_filter(df, copies_once=True).collect()}
    assert {*range(40), *range(100, 160), 201} == set(kept)
    assert kept[3] == body(3) and kept[100].endswith("copies") and kept[201].startswith("Accept")
    # By documents the lines of 60 copies are above the limit too: nothing of them is left.
    assert {r.doc_id for r in quality_filter(df).collect()} == {*range(40), 201}


def test_a_line_in_a_twelfth_of_a_large_host_is_removed(spark):
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    rows = [(i, f"{body(i)}\nshare this page\n" if i % 12 == 0 else body(i), "large") for i in range(600)]
    rows += [(1000 + i, f"{body(1000 + i)}\nin five documents only" if i < 5 else body(1000 + i), "small") for i in range(50)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, r in got.items() if r.n_removed_words} == set(range(0, 600, 12))
    assert all(r.n_removed_words in (0, 3) and r.kept for r in got.values())


def test_quality_filter_by_host_and_with_any_column_names(spark):
    body = " ".join(f"w{j}" for j in range(60))
    rows = [(7, f"{body}\nfoot of a", "a", 1), (7, f"{body}\nfoot of a", "b", 2)]
    rows += [(10 + i, f"{body} {i}\nfoot of a", "a", i) for i in range(6)]
    rows += [(30 + i, f"{body} b{i}", "b", i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _lines long")
    df = df.withColumns({c: F.col("_lines") for c in ("_id", "_key", "row", "host", "text_key", "removed_lines", "kept")})
    got = quality_filter(df)
    assert got.columns == df.columns and got.schema == df.schema
    assert {(r.source, r.text.endswith("foot of a")) for r in got.filter("doc_id = 7").collect()} == {("a", False), ("b", True)}


def test_quality_of_nothing(no_docs):
    assert quality_rules(no_docs).count() == 0 and quality_filter(no_docs).count() == 0


# 5


def test_substring_dedup_equals_brute_force(docs, corpus):
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(docs).collect()}
    assert got == brute.word_repeats(pairs(corpus))


def test_dedup_carries_columns_and_layout(docs, corpus):
    got = {r.doc_id: r for r in substring_dedup(docs, carry=("lang", "source"), keep_layout=True).collect()}
    for i, text, lang, source, _ in corpus:
        assert (got[i].lang, got[i].source) == (lang, source)
        assert got[i].n_removed or got[i].kept == (text or "")
        assert sum(s.last - s.first + 1 for s in got[i].spans) == got[i].n_removed


def test_dedup_of_nothing(no_docs):
    assert substring_dedup(no_docs).count() == 0 and suffix_dedup(no_docs).count() == 0


# 6


def test_license_phrases_and_notices(spark, no_docs):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    rows = [(1, "x Under the MIT-License. Under the MIT License"), (2, notice), (3, "cc by nc cc by nc"), (4, None), (5, ""), (6, "apache license"), (6, "Apache License, Version 2.0"), (7, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pos": F.lit(1), "gram": F.lit("x"), "label": F.lit("y")})
    got = sorted(tuple(r) for r in license_labels(license_scan(df)).fillna(-1).collect())
    assert [g[:7] for g in got] == [
        (1, 9, 2, 1, 5, "mit", "mit"), (2, len(re.findall("[A-Za-z]+", notice)), 0, -1, -1, "", "mit"), (3, 6, 2, 0, 3, "cc-by-nc", "cc-by-nc"), (4, 0, 0, -1, -1, "", ""),
        (5, 0, 0, -1, -1, "", ""), (6, 2, 0, -1, -1, "", ""), (6, 5, 1, 0, 0, "apache-2", "apache-2"), (7, 2, 0, -1, -1, "", ""),
    ]
    assert all(0 <= g[7] <= 1 for g in got)
    assert license_labels(license_scan(no_docs)).count() == 0


def test_license_notices_by_their_distinct_grams(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    texts = {
        "under the terms " * 9: "",
        "under the terms of " * 10: "",
        "words before. This work is licensed under the GNU General Public License, version 3. And after": "gpl",
        "LICENSED under the GNU Lesser General Public License v3": "lgpl",
        gpl: "gpl",
        gpl.replace("General", "Lesser General"): "lgpl",
        f"{gpl.replace('redistribute it and/or modify it', 'share it')} and under the terms of the GNU Lesser General Public License as published there by the Free Software Foundation": "gpl,lgpl",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "Licensed under the Mozilla Public License, version 2.0, or under the BSD license": "bsd,mpl-2",
        "licensed under the BSD license": "bsd",
        "\u212apache license version 2 \u0130n under the m\u0131t license": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_labels(license_scan(df)).collect()}
    assert [got[i].labels for i in range(len(texts))] == list(texts.values())
    assert all((r.score > 0) == bool(r.labels) and r.base_labels == "" for r in got.values())


# 7


def test_lookups_equal_direct_convolution():
    rng = np.random.default_rng(6)
    model = ByteCnn(["a", "b", "c"], seed=3)
    x = rng.integers(0, 256, (9, WINDOW)).astype(np.uint8)
    e, pooled = model.p["E"][x], []
    for w in WIDTHS:
        answers = np.stack([sum(e[:, at + j] @ model.p[f"W{w}"].reshape(w, model.dim, -1)[j] for j in range(w)) for at in range(WINDOW - w + 1)], 1)
        pooled.append(answers.max(1))
    want = np.maximum(np.concatenate(pooled, 1), 0) @ model.p["V"] + model.p["c"]
    assert np.abs(model.logits(x, model.tables()) - want).max() < 1e-3


def test_windows_of_many_texts_and_of_one():
    texts = [b"", b"x" * 300, b"y" * 256, b"z"]
    buf, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    out, text = windows_of(buf, at)
    assert text.tolist() == [1, 1, 2, 3] and bytes(out[1]) == b"x" * 44 + bytes(212) and bytes(out[2]) == b"y" * 256
    one, _ = windows_of(buf[:300], np.array([0, 300]))
    assert (one == out[:2]).all()


def test_prediction_of_a_very_long_text_is_the_mean_over_its_windows(spark):
    model = ByteCnn(["a", "b"], seed=5)
    text = " ".join(str(i) for i in range(400_000)) + " end"
    x, _ = windows_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    mean = model.logits(x, model.tables()).mean(0)
    want = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
    r = predict_language(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r.lang_pred == model.languages[int(want.argmax())] and abs(r.score - want.max()) < 1e-3


def test_language_accuracy_on_held_out_rows(spark, sf):
    out = Q.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out AND lang_pred <> 'und'")
    assert held.filter("lang = lang_pred").count() >= 0.9 * held.count() > 0


def test_language_edge_cases(spark, docs, no_docs):
    model = train_language_model(docs.filter(~held_out(F.col("doc_id"))))
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (4, "é"), (5, "word " * 5000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in predict_language(rows, model).collect())
    assert [g[1] for g in got[:3]] == ["und"] * 3 and all(g[1] in model.languages for g in got[3:]) and all(0 <= g[2] <= 1 for g in got)
    assert train_language_model(no_docs) is None
    assert predict_language(no_docs, model).count() == 0
    assert {r.lang_pred for r in predict_language(rows, None).collect()} == {"und"}


# 8


def test_bpe_equals_the_library(spark, docs, corpus, no_docs):
    from tokenizers import Tokenizer

    path = Q.vocabulary()
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in bpe_decode(bpe_encode(docs, path), path).collect()}
    for i, t in pairs(corpus):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False)
    digest = {r.doc_id: r for r in bpe_digests(bpe_decode(bpe_encode(docs, path), path)).collect()}
    i, t = pairs(corpus)[20]
    assert digest[i].ids_sha256 == brute.sha(" ".join(map(str, lib.encode(t, add_special_tokens=False).ids)))
    assert bpe_encode(no_docs, path).count() == 0


def test_vocabulary_files_of_another_kind_are_refused(tmp_path, docs):
    with open(Q.vocabulary(), encoding="utf-8") as f:
        text = f.read()
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"model": {**json.loads(text)["model"], "byte_fallback": True}}):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**json.loads(text), **change}), encoding="utf-8")
        with pytest.raises(ValueError, match="vocabulary file"):
            bpe_encode(docs, str(path))
        path.unlink()
        from siltrace.llm import bpe

        bpe.load.cache_clear()


def test_forgotten_words_are_encoded_again(monkeypatch):
    from siltrace.llm import bpe

    encoder, text = bpe.Bpe(Q.vocabulary()), " ".join(f"word{i % 40} Zürich's" for i in range(200))
    want = encoder.encode(text)
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 1000)
    small = bpe.Bpe(Q.vocabulary())
    assert small.encode(text) == want and len(small.words) < 6


def test_words_are_remembered_and_merged_once():
    from siltrace.llm import bpe

    encoder, seen = bpe.Bpe(Q.vocabulary()), []
    for text in ("alphax Alphax alphax, zürichx", "Zürichx! betax zürichx betax."):
        seen.append(encoder.encode(text))
    assert not {"alphax", "betax", "zürichx"} & encoder.words.keys()  # they are stretches, which are remembered anyway
    assert len(encoder.words) + len(encoder.stretches) == 3 + 7  # marks, and texts between white space
    assert seen == [bpe.Bpe(Q.vocabulary()).encode(t) for t in ("alphax Alphax alphax, zürichx", "Zürichx! betax zürichx betax.")]


def test_bpe_of_odd_letters_and_of_long_pieces_equals_the_library():
    from tokenizers import Tokenizer

    from siltrace.llm import bpe

    encoder, lib, pick = bpe.Bpe(Q.vocabulary()), Tokenizer.from_file(Q.vocabulary()), random.Random(8)
    letters = [chr(c) for c in range(0x3000) if chr(c).isalpha()] + list("J\u030cİΣςſKÅﬁ\u1112\u1161\u11ab힣\u0344\u0345\u0301'.,-7")
    texts = ["J\u030c ǰ İstanbul i\u0307stanbul", "ΟΔΟΣ ΟΔΟΣ, οδοσ", "\u1112\u1161\u11ab \u1112\u1161\u11ab. 한", "\u0344 \u0308\u0301 x\u0344", "'s ''s !'s it's IT'S", "a<|endoftext|>B <|ENDOFTEXT|>"]
    texts += ["".join(pick.choices(letters, k=pick.randint(1, 6))) + pick.choice(["", ",", "'s"]) for _ in range(3000)]
    texts += ["".join(pick.choices("etaoinéß", k=n)) for n in (1, 2, 3)] + ["".join(pick.choices("etaoin", k=n)) for n in (8191, 8192, 8193, 30_000)] + ["a" * 8192, "!" * 20_000]
    texts += [t.upper() for t in texts] + [f"{t} {t}." for t in texts]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), np.int32).tolist() == lib.encode(t, add_special_tokens=False).ids, t[:50]


# 9


def test_components_equal_brute_force(docs, corpus):
    got = {r.doc_id: tuple(r) for r in near_duplicates(docs, shingle=4).collect()}
    assert got == brute.components(pairs(corpus))


def test_near_duplicates_with_odd_ids(spark, no_docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A B C D E F"), (None, "a b c d e f"), (None, "z"), (9, None), (10, ""), (11, " ")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (0, 3, False), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True), (10, 10, True), (11, 11, True),
    ]
    assert near_duplicates(no_docs).count() == 0


def test_a_hub_keeps_all_its_leaves(spark):
    # 400 texts of two changed words each: 0.85 to the hub, 0.72 to each other.
    rng, hub = random.Random(6), [f"h{j}" for j in range(103)]
    rows = [(1000, " ".join(hub))]
    for i in range(400):
        own = list(hub)
        for at in (rng.randrange(4, 45), rng.randrange(55, 98)):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 401


def test_all_texts_of_a_repeated_id_keep_their_links(spark):
    text = lambda c, last="": " ".join([f"{c}{j}" for j in range(40)] + ([last] if last else []))
    rows = [(1, text("a")), (1, text("b")), (2, text("a", "x")), (3, text("b", "y")), (4, text("c"))]
    for _ in range(2):
        rows.reverse()
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def test_links_of_a_crowded_template_are_all_found(spark):
    # 92 words of a template and 17 own ones: similarity 0.73 to all others; each of 200 planted pairs shares 7 own words more: 0.83.
    template, n, pairs_of = " ".join(f"t{j}" for j in range(92)), 2000, 200
    own = lambda i: [f"o{i}x{j}" for j in range(17)]
    rows = [(i, f"{template} {' '.join(own(i) if i >= pairs_of else own(i + n // 2)[:7] + own(i)[7:])}") for i in range(n)]
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string"), shingle=1).collect()}
    want = dict(zip(ids, ids, strict=True))
    for i in range(pairs_of):
        want[ids[i]] = want[ids[i + n // 2]] = min(ids[i], ids[i + n // 2])
    assert got == want


def test_components_of_a_crowded_region_meet(spark):
    # One component of 1,300 classes and 700 single ones, of which 30 are linked with one of its members each.
    from siltrace.llm.exchange import pack
    from siltrace.llm.minhash_dedup import crowded_links

    rng = np.random.default_rng(4)
    sets = {i: np.sort(rng.integers(0, 1 << 48, 20, dtype=np.uint64)) for i in range(2000)}
    linked = {1300 + 7 * k: 40 * k for k in range(30)}
    for i, j in linked.items():
        sets[i] = np.sort(np.append(sets[j][:18], sets[i][:2]))
    crowds = spark.createDataFrame([(1, i, 20) for i in sets] + [(2, i, 20) for i in range(100)], "region long, id long, size long")
    joined = spark.createDataFrame([(i, 0) for i in range(1300)], "id long, component long")
    packed = spark.createDataFrame([(i, len(x), pack(x)) for i, x in sets.items()], "id long, n_shingles long, shingles binary")
    want = {frozenset((i, 0)) for i in linked}  # every one of them joins the component
    for block, shingles in ((1024, 1 << 19), (64, 1 << 19), (1024, 900)):
        found = crowded_links(crowds, joined, packed, 80, block, shingles).collect()
        assert {frozenset((r.ca, r.cb)) for r in found} == want
    assert crowded_links(crowds.filter("region = 2"), joined, packed, 80) is None


def test_common_counts_and_met_components():
    from siltrace.llm.minhash_dedup import common_counts, met_components

    rng = np.random.default_rng(3)
    x, y = ([np.unique(rng.integers(0, 300, rng.integers(0, 90), dtype=np.uint64)) for _ in range(n)] for n in (17, 23))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    for step in (7, 4096):
        assert common_counts(x, y, step).tolist() == want
    assert common_counts(x, [np.zeros(0, np.uint64)]).tolist() == [[0]] * 17
    chain = np.arange(50)
    a, b = met_components(np.concatenate((chain[:-1], [90])), np.concatenate((chain[1:], [80])))
    assert dict(zip(a.tolist(), b.tolist())) == {i: 0 for i in range(1, 50)} | {90: 80}
    assert len(met_components(chain[:0], chain[:0])[0]) == 0


def test_form_letters_meet_in_blocks(spark):
    # 400 words with 25 slots of 4 values: similarity 0.65 to all others, so that nearly all pairs meet somewhere; 60 planted near copies.
    rng, n = random.Random(12), 1200
    frame = [f"w{k}" for k in range(400)]

    def letter():
        own = list(frame)
        for slot in range(25):
            own[16 * slot + 3] = f"s{slot}v{rng.randrange(4)}"
        return own

    letters = [letter() for _ in range(n)]
    near = []
    for k in range(60):
        own = list(letters[k])
        own[7 + k] = f"changed{k}"
        near.append(own)
    rows = [(i, " ".join(x)) for i, x in enumerate(letters + near)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    every = letters + near
    names, held = {}, np.zeros((len(every), 2000), np.float32)
    for i, x in enumerate(every):
        for k in range(396):
            held[i, names.setdefault(tuple(x[k : k + 5]), len(names))] = 1
    common, size = held @ held.T, held.sum(1)
    links = np.argwhere(100 * common >= 80 * (size[:, None] + size[None, :] - common))
    want = {i: i for i in range(len(every))}
    while any(want[i] != want[j] for i, j in links.tolist()):
        for i, j in links.tolist():
            want[i] = want[j] = min(want[i], want[j])
    assert 60 <= sum(i != c for i, c in want.items()) < 200  # the planted ones, and some letters that differ in few slots by chance
    # Regions of more than 100 classes are dealt by deeper levels here.
    got = {r.doc_id: r.component_id for r in near_duplicates(df, hot_region=100).collect()}
    assert got == want


def test_connected_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}


# 10


def test_url_rules(spark):
    urls = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q", "http://example.org", "x://org/", "http://b.com/de/", "http://com/fr/a#b", "nothing", None, "", "http://notorg/", "http://a.b.c.d.e.org/en/1", "http://com.example/de/", "a://b.net/p://c.com/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumns({"host": F.lit("h"), "rule": F.lit("r")})
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter(df, Q.URL_RULES).collect() if r.rule)
    assert got == [
        (0, "example.org/es/", "block"), (0, "example.org/es/", "block"), (1, "example.org/en/1", "block"), (3, "org/", "allow"),
        (4, "com/de/", "block"), (5, "com/fr/", "allow"), (10, "org/", "allow"),
    ]
    assert url_filter(df, Q.URL_RULES).count() == len(urls) + 1
    assert url_filter(df.filter("page_id < 0"), Q.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter(df, [], default_verdict="block").collect()} == {"block"}


def test_long_urls_and_rules_in_capitals(spark):
    long = "http://" + "a." * 50_000 + "Example.ORG/es/" + "x/" * 200_000
    rows = [(1, long), (2, "http://\u00c9cole.fr/"), (3, "http://\u00e9cole.fr/"), (4, "http://sub.\u00c9COLE.FR/x"), (None, "http://a.example.org/es/")]
    rules = [*Q.URL_RULES, ("block", "\u00c9COLE.fr", "/")]
    got = {r.page_id: (r.rule, r.verdict, len(r.host)) for r in url_filter(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[1] == ("example.org/es/", "block", 100_011)
    assert got[2][:2] == got[4][:2] == ("\u00c9cole.fr/", "block") and got[3][:2] == (None, "allow")  # only A-Z are lowered
    assert got[None][0] == "example.org/es/"


def test_license_in_a_very_long_text(spark):
    text = "word " * 300_000 + "under the MIT license" + " other" * 100_000
    got = license_labels(license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got.n_words, got.n_base, got.first_word, got.base_labels) == (400_004, 1, 300_000, "mit")


def test_mixing_with_a_very_long_text(spark):
    docs = [(i, ("plain prose " * 30 if i % 2 else "buy now cheap " * 30)) for i in range(40)] + [(99, "plain prose " * 200_000)]
    labels = [(i, int(i % 2 == 1), 0) for i in range(40)]
    out = mix_to_targets(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"good": 0.6, "poor": 0.4, "toxic": 0.0})
    rates = {r.doc_id: r.rate for r in out.collect()}
    assert len(rates) == 41 and all(x >= 0 for x in rates.values())


def test_a_cluster_must_name_its_shared_folder():
    from siltrace.llm.storage import shared_dir

    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
