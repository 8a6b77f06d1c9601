"""The pipeline against brute-force forms of its stages."""

from tests.llm import brute
from tokenizers import Tokenizer

import corpus_pipeline as P


def test_stages_take_effect(spark, docs, corpus, sf):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in corpus[::2]] + [(r[0], 0, 1) for r in corpus[1::7]], "doc_id long, quality int, toxic int")
    folder = f"{P.written(labels, 'labels-of-test').inputFiles()[0].rsplit('/', 1)[0]}"
    import os
    import tempfile

    top = tempfile.mkdtemp(prefix="spark-pipeline-")
    os.symlink(folder.removeprefix("file://").removeprefix("file:"), f"{top}/labels.parquet")

    texts = {r[0]: r[1] for r in corpus}
    one = P.written(P.quality(spark, docs, top), "one")
    assert one.columns == list(P.COLUMNS)
    passed = {i for i, t in texts.items() if (q := brute.quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    assert {r.doc_id for r in one.collect()} == passed

    two = P.written(P.near_dedup(spark, one, top), "two")
    left = [(i, texts[i]) for i in sorted(passed)]
    kept = {i for i, _, c, _ in brute.components(left, size=5).values() if c == i}
    assert {r.doc_id for r in two.collect()} == kept

    three = P.written(P.repeats(spark, two, top), "three")
    want = brute.word_repeats([(i, t) for i, t in left if i in kept])
    for r in three.collect():
        assert " ".join(brute.WORD.findall(r.text)) == want[r.doc_id][3] and r.n_chars == len(r.text)

    four = P.written(P.mixing(spark, three, top), "four")
    assert four.columns == list(P.COLUMNS)
    assert {r.doc_id for r in four.collect()} <= kept

    lib = Tokenizer.from_file(P.vocabulary())
    five = sorted((r.doc_id, r.ids, r.n_tokens, r.decoded) for r in P.encoding(spark, four, top).collect())
    ids = {r.text: lib.encode(r.text, add_special_tokens=False).ids for r in four.collect()}
    assert five == sorted((r.doc_id, ids[r.text], len(ids[r.text]), lib.decode(ids[r.text], skip_special_tokens=False)) for r in four.collect())


def test_the_drawn_corpus_meets_its_targets(spark, sf):
    from siltrace.llm.mixing import DOMAINS, TARGETS, domain_posteriors, train_domain_classifier

    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = train_domain_classifier(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = domain_posteriors(P.mixing(spark, docs, sf), weights).collect()
    totals = [sum(r.n_tokens * r.posteriors[i] for r in rows) for i in range(len(DOMAINS))]
    assert all(abs(t / sum(totals) - TARGETS[d]) < 0.01 for d, t in zip(DOMAINS, totals, strict=True))


def test_run_over_a_small_folder(spark, sf):
    out = P.run(spark, sf)
    assert 0 < out.count() <= spark.read.parquet(f"{sf}/documents.parquet").count()
