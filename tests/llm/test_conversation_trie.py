"""The prefix trie against plain dictionaries, on conversations of uneven lengths, copies, nulls, ties and clashing columns."""

import random

from pyspark.sql import functions as F
from tests.llm import brute

from siltrace.llm import queries as Q
from siltrace.llm.conversation_trie import conversation_trie, conversation_turns, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "pos", "key", "len", "name", "depth", "base")}).repartition(3)


def random_rows(seed, convs, most, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice([1, 2, 3, most, rng.randint(1, most)])):
            rows.append((c, t, rng.choice(["user", "user", None]), rng.choice(["", "a", "bé", None, "c" * 9][:kinds] if rng.random() < 0.9 else ["x", "yy"])))
    rng.shuffle(rows)
    return rows


def sequences(rows):
    own = {}
    for c, n, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        own.setdefault(c, []).append((role or "", text or ""))
    return own


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def test_trie_equals_dictionaries(spark):
    rows = random_rows(1, range(-7, 50), 6) + random_rows(2, [60, 61], 21)
    rows += [(c, t, "user", f"turn {t}") for c in range(70, 90) for t in range(5)]  # copies
    rows += [(c, t, "user", "a") for c in (91, 92) for t in range(33)]
    rows += [(None, 0, "user", "lost"), (None, 1, "user", "lost")]
    assert collected(conversation_trie(table(spark, rows))) == brute.trie(sequences(rows))


def test_query_rebuilds_conversations(spark, tmp_path):
    rows = random_rows(3, [c for c in range(-12, 60) if c % 7], 10, 5)
    rows += [(5, None, "system", "no number"), (5, None, None, None), (6, 1, "user", "tie"), (6, 1, "assistant", "tie"), (6, 1, "user", "tie"), (None, 0, "a", "b")]
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    want = brute.rebuilt(rows)
    assert any(not s for s in want.values())  # some have no turn left
    assert collected(Q.op12_conversation_trie(spark, str(tmp_path))) == brute.trie(want)


def test_turnless_and_empty(spark):
    turns = spark.createDataFrame([], "conv long, pos long, key binary, bytes long, len long")
    lengths = spark.createDataFrame([(4, 0), (3, 0)], "conv long, len long")
    assert collected(prefix_trie(turns, lengths)) == [(3, 0, None, 2, 0, 1, 0, brute.sha("3,4"))]
    assert prefix_trie(turns, lengths.limit(0)).count() == 0
    assert conversation_trie(table(spark, [(1, 0, "a", "b")]).limit(0)).count() == 0


def test_turns_are_numbered(spark):
    rows = [(1, 5, "a", "x"), (1, None, "a", "y"), (1, 2, None, "zé"), (2, 0, "a", None)]
    got = {(r.conv, r.pos): r.bytes for r in conversation_turns(table(spark, rows)).collect()}
    assert got == {(1, 0): 1, (1, 1): 3, (1, 2): 1, (2, 0): 0}
