"""Periodic runs against trying every period, on texts with runs in runs, nulls, empties, copies and clashing columns."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from siltrace.llm import queries as Q
from siltrace.llm.periodic_runs import SuffixArray, nearest_smaller, periodic_runs, run_digests


def texts(seed=4, n=150):
    rng = random.Random(seed)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "ab ab\nab\tab  ab ab", "a b a b a b a b a b", "é É é É é É é É"]
    for _ in range(n):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 4)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
            if rng.random() < 0.3:
                unit = unit * 4 + [rng.choice("abcd")]  # runs inside a run
            words += (unit * rng.randint(2, 9))[: rng.randint(1, 80)] + [rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))]
        out.append(" ".join(words))
    return out + [out[12]] * 3


def expected(text):
    words = brute.WORD.findall(text or "")
    runs = brute.periodic_runs(words)
    return len(words), runs, brute.collapsed(words, runs)


def test_runs_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("x"), "words": F.lit(1), "_best": F.lit(2)}).repartition(3)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()}
    want = {i: expected(t) for i, t in rows}
    assert got == want
    assert sum(len(r) for _, r, _ in want.values()) > 200  # the texts do hold runs, several in some
    digests = {r.doc_id: r for r in run_digests(periodic_runs(df)).collect()}
    for i, (_, runs, text) in want.items():
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = digests[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == brute.sha(text)


def test_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x x x x x x"), (1, "x x x x x x"), (None, "y " * 9)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.runs[0].length) for r in periodic_runs(df).collect()) == [(0, 9), (1, 6), (1, 6)]
    assert periodic_runs(df.filter("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, least_exponent=1)


def test_other_exponents(spark):
    rows = list(enumerate(texts(9, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs(df, least_length=4, least_exponent=2).collect()}
    assert got == {i: brute.periodic_runs(brute.WORD.findall(t or ""), 4, 2) for i, t in rows}


def test_very_long_texts(spark):
    # One word, one long period, and a word without squares of more than a few letters: all in time that follows the length.
    rng = random.Random(1)
    long = [str(rng.randrange(10**6)) for _ in range(25_000)]
    rows = [(0, "a " * 200_000), (1, " ".join(long * 4)), (2, " ".join(rng.choice("ab") for _ in range(100_000)))]
    began = time.perf_counter()
    got = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.perf_counter() - began < 60
    assert [tuple(x) for x in got[0].runs] == [(0, 200_000, 1)] and got[0].collapsed == "a"
    assert (0, 100_000, 25_000) in [tuple(x) for x in got[1].runs]
    words = rows[2][1].split()
    for s, n, q in got[2].runs:
        assert words[s : s + n - q] == words[s + q : s + n] and n >= max(6, 4 * q)


def test_planted_words(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 37))) for i in range(200)] + [(None, "x y z"), (-3, "q " * 5)]
    got = {r.doc_id: r.text for r in Q.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    import zlib

    for i, t in rows:
        words, h = t.split(), 1 if i is None else zlib.crc32(str(i).encode())
        g, n = h // 10, len(t.split())
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (k - a) % p] if k >= a else words[k] for k in range(n)]
        assert got[i].split() == words


def test_suffix_array_parts():
    rng = np.random.default_rng(2)
    word = rng.integers(0, 3, 500)
    text = np.repeat([0, 1, 2], [100, 150, 250])
    end = np.repeat([100, 250, 500], [100, 150, 250])
    s = SuffixArray(word, text, end)
    suffix = lambda i: (int(text[i]), *word[i : end[i]].tolist())
    assert s.sa.tolist() == sorted(range(500), key=suffix)
    for x in range(1, 500):
        a, b = suffix(s.sa[x]), suffix(s.sa[x - 1])
        same = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        assert s.lcp[x] == max(0, same - 1)  # without the text's number
    values = rng.integers(0, 6, 400)
    for x, near in enumerate(nearest_smaller(values, -1)):
        if values[x]:
            assert near == max([y for y in range(x) if values[y] < values[x]], default=-1)
