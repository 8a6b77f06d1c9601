"""Decontamination against looking every window up, on texts with near misses, short items, copies, nulls and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from siltrace.llm.decontamination import Bits, decontaminate
from siltrace.llm.digests import joined_digests

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def shout(text):
    return "".join(c.upper() if "a" <= c <= "z" else c for c in text)


def tables(seed=6):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ9") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(8, 60))) for i in range(25)]
    items += [(40, None), (41, ""), (42, " ... "), (43, "Zebra"), (44, "two Words"), (45, "one TWO three"), (None, prose(14)), (46, items[3][1]), (46, items[4][1]), (7, prose(12))]
    items += [(50, "same same same same same same same same same same same same"), (51, prose(5) + " " + items[0][1])]
    docs = [None, "", "zebra", "a zebra; TWO.words two-words", "same " * 30, "\x00one\x7ftwo[three]"]
    for _ in range(120):
        t = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, len(own) // 2)
            own = own[a : a + rng.randint(8, 40)]
            if own and rng.random() < 0.4:
                own[rng.randrange(len(own))] = "other"
            t += rng.choice([" ", "\n", " -- "]) + rng.choice([str, str.title, shout])(" ".join(own)) + ", " + prose(rng.randint(0, 9))
        docs.append(t)
    docs += [docs[-1]] * 4 + [prose(20_000) + items[0][1]]
    return list(enumerate(docs)), items


def judged(spark, docs, items, **more):
    clash = {c: F.lit("x") for c in ("rid", "token", "hits", "windows", "item", "words", "n")}
    d = spark.createDataFrame(docs, DOCS).withColumns(clash).repartition(3)
    b = spark.createDataFrame(items, ITEMS).withColumns(clash)
    return decontaminate(d, b, **more)


def test_decontamination_equals_brute_force(spark):
    docs, items = tables()
    want = {i: x for (i, _), x in zip(docs, brute.contaminated(docs, items), strict=True)}
    rows = judged(spark, docs, items).collect()
    assert {r.doc_id: (r.n_words, r.hit_words, r.n_items, r.items_sha256) for r in rows} == want
    assert all(r.contaminated == bool(r.hit_words) for r in rows) and len(rows) == len(docs)
    assert 20 < sum(r.contaminated for r in rows) < len(rows) - 10  # some are and some are not


def test_other_windows_and_a_table_of_bits_that_lets_much_through(spark):
    docs, items = tables(7)
    for window, shingle, bits in ((6, 2, 16), (4, 4, 8)):
        want = {i: x for (i, _), x in zip(docs, brute.contaminated(docs, items, window), strict=True)}
        got = judged(spark, docs, items, window=window, shingle=shingle, filter_bits=bits).collect()
        assert {r.doc_id: (r.n_words, r.hit_words, r.n_items, r.items_sha256) for r in got} == want
    with pytest.raises(ValueError):
        judged(spark, docs, items, window=2)


def test_a_passage_in_most_texts_and_items(spark):
    # One passage in 900 texts and 300 items: the lists of items are made once for the texts that hold the same windows.
    passage = " ".join(f"p{k}" for k in range(16))
    items = [(i, f"{passage} own{i} tail{i}") for i in range(300)] + [(999, passage)]
    docs = [(i, f"begin{i} {passage} end{i}") for i in range(900)] + [(i, f"begin{i} only") for i in range(900, 950)]
    rows = judged(spark, docs, items).collect()
    every = brute.sha(",".join(sorted(str(i) for i, _ in items)))
    assert all((r.hit_words, r.n_items, r.items_sha256) == ((list(range(1, 17)), 301, every) if r.doc_id < 900 else ([], 0, brute.sha(""))) for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(12))
    got = judged(spark, [(1, text), (1, text), (None, text), (1, "clean"), (None, None)], [(None, text)]).collect()
    assert sorted((r.doc_id or 0, len(r.hit_words), r.n_items) for r in got) == [(0, 0, 0), (0, 12, 1), (1, 0, 0), (1, 12, 1), (1, 12, 1)]
    assert judged(spark, [(1, text)], [(1, None)]).first().contaminated is False
    d, b = spark.createDataFrame([(1, text)], DOCS), spark.createDataFrame([(1, text)], ITEMS)
    assert decontaminate(d.limit(0), b).count() == 0
    assert [r.contaminated for r in decontaminate(d, b.limit(0)).collect()] == [False]


def test_bits_hold_all_their_tokens(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    bits = Bits(spark.createDataFrame([(int(x), 3) for x in h[:2000].view(np.int64)], "token long, k int"), 27)
    assert bits.holds(h[:2000]).all() and bits.holds(h[2000:]).mean() < 0.01 and bits.sizes == [3]


def test_joined_digests(spark):
    rows = [(i % 3, str(i)) for i in range(50)] + [(None, "x")]
    got = {r.key: (r.n, r.digest) for r in joined_digests(spark.createDataFrame(rows, "k long, v string").repartition(4), "k", ["v"], "v").collect()}
    for k in (0, 1, 2, None):
        own = sorted(v for x, v in rows if x == k)
        assert got[k] == (len(own), brute.sha(",".join(own)))
