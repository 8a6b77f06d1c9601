"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltrace.llm.bpe import bpe_decode, bpe_digests, bpe_encode, vocabulary
from siltrace.llm.conversation_trie import conversation_turns, prefix_trie
from siltrace.llm.decontamination import decontaminate
from siltrace.llm.language_id import held_out, predict_language, train_language_model
from siltrace.llm.license_scan import BASE, NOTICES, license_labels, license_scan, template_words
from siltrace.llm.minhash_dedup import near_duplicates
from siltrace.llm.mixing import DOMAINS, mix_to_targets
from siltrace.llm.periodic_runs import periodic_runs, run_digests
from siltrace.llm.quality_rules import quality_rules
from siltrace.llm.substring_dedup import substring_dedup, substring_digests
from siltrace.llm.storage import written
from siltrace.llm.suffix_dedup import suffix_dedup, suffix_digests
from siltrace.llm.topk_search import sparse_rows, topk_search
from siltrace.llm.url_filter import url_filter
from siltrace.operators.joins import looked_up

URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_rows(_read(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"))
    return topk_search(rows, rows.filter(F.col("id") % 100 == 0), k=10)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_digests(suffix_dedup(_read(spark, sf_dir, "documents")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mix_to_targets(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    own = [F.get("posteriors", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return rates.select("doc_id", "n_tokens", *own, "rate")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents")).drop("removed_lines", "text_key", "host")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(substring_dedup(_read(spark, sf_dir, "documents")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(license_scan(_read(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    model = train_language_model(docs.filter(~out))
    return predict_language(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary()
    return bpe_digests(bpe_decode(bpe_encode(_read(spark, sf_dir, "documents"), path), path))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, threshold=80)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_read(spark, sf_dir, "pages"), URL_RULES)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth document, by the checksum h of its id, words from place a on repeat with period p."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", "text", words.alias("words"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    placed = split.withColumn("n", n).withColumn("a", F.when(n > 0, g % n).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    cycle = F.slice("words", F.col("a") + 1, F.col("p"))
    turned = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), turned), " ")
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(_read(spark, sf_dir, "documents"))))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with lengths, lengths): conversations that begin with the first h turns of another and go on with their own after their first h."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    own = own.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % 9).alias("h"))
    own = written(own, "own-lengths")
    borrowed = F.least("h", F.coalesce("n_base", F.lit(0)))
    with_base = own.hint("merge").join(own.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = with_base.select("conv", "base", "h", borrowed.alias("b"), (borrowed + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    plan = written(plan, "rebuilt-lengths")
    rest = looked_up(turns, plan.select("conv", "h", "b", "len"), ["conv"]).filter("pos >= h")
    rest = rest.select("conv", (F.col("b") + F.col("pos") - F.col("h")).alias("pos"), "key", "bytes", "len")
    # At most 8 turns of a conversation are borrowed, by at most 5 others.
    first = turns.filter("pos < 8").withColumnRenamed("conv", "base")
    begin = plan.filter("b > 0").hint("merge").join(first, "base").filter("pos < b").select("conv", "pos", "key", "bytes", "len")
    return written(begin.unionByName(rest), "rebuilt"), plan.select("conv", "len")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(conversation_turns(_read(spark, sf_dir, "conversations")), "turns")
    return prefix_trie(*rebuilt(turns))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "n_items", "items_sha256", "contaminated")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_decontamination": op13_decontamination,
    "pipeline": pipeline,
}



def _template_rows() -> str:
    """The license templates as rows of SQL."""
    word = lambda t: ", ".join(f"'{w}'" for w in template_words(t))
    return ", ".join(f"({i}, '{t.label}', {t.exact}, [{word(t.text)}], '{t.key}')" for i, t in enumerate(BASE + NOTICES))


def _crc32(number: str) -> str:
    """SQL of the unsigned CRC-32 of a whole number's decimal digits: the bits of the digits go through the divisor one by one."""
    bits = f"flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: list_transform(range(0, 8), lambda b: (ord(x) >> b) & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"


ORACLES = {
    "op2_suffix_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, p, substr(h, 512 * p + 1, 610) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 512 + 1)) AS p FROM b)),
win AS (SELECT doc_id, 256 * p + j AS i, substr(s, 2 * j - 1, 100) AS k FROM (SELECT doc_id, p, s, unnest(range(1, least(257, len(s) // 2 - 48))) AS j FROM piece)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE doc_id > m),
runs AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 49 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g),
cuts AS (
  SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS back FROM spans),
kept AS (
  SELECT doc_id, string_agg(h[2 * before + 1 : 2 * a - 2], '' ORDER BY a) || any_value(h[2 * z + 1 :]) FILTER (back = 1) AS t,
    sum(z - a + 1) AS n, count(*) AS spans
  FROM cuts JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM b LEFT JOIN kept USING (doc_id)
""",
    "op1_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
""",
    "op4_quality_rules": r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
tri AS (
  SELECT doc_id, i, w[i : i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
marked AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM w),
worded AS (
  SELECT doc_id, host, text, line,
    list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM w GROUP BY host),
freq AS (
  SELECT host, lw FROM (SELECT host, lw, count(DISTINCT doc_id) AS n FROM worded GROUP BY host, lw) JOIN hosts USING (host)
  WHERE n > 5 AND n > docs * 0.05),
lost AS (SELECT doc_id, sum(len(lw)) AS n FROM worded JOIN freq USING (host, lw) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w.w) AS n_words, length(array_to_string(w.w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(marked.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS n_removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN marked USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  CAST(n_removed_words AS BIGINT) AS n_removed_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words <= 0.5 * n_words AS kept
FROM m
""",
    "op10_url_filter": r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
""",
    "op6_license_scan": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
t(tid, label, exact, tw, key) AS (VALUES """ + _template_rows() + r"""),
tg AS (SELECT tid, i - 1 AS tpos, array_to_string(tw[i : i + 2], ' ') AS gram FROM (SELECT tid, tw, unnest(range(1, len(tw) - 1)) AS i FROM t)),
tn AS (SELECT tid, count(*) AS size, count(DISTINCT gram) AS kinds FROM tg GROUP BY tid),
dg AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i : i + 2], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, tid, pos - tpos AS d, pos, gram FROM dg JOIN tg USING (gram)),
dia AS (SELECT doc_id, tid, d, exact FROM (SELECT DISTINCT doc_id, tid, d FROM hit) JOIN t USING (tid)),
cut AS (
  SELECT *, CASE WHEN exact THEN 1 ELSE coalesce(CAST(d - lag(d) OVER (PARTITION BY doc_id, tid ORDER BY d) > 4 AS INTEGER), 1) END AS c FROM dia),
span AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, tid ORDER BY d) AS s FROM cut),
found AS (
  SELECT doc_id, tid, s, count(*) AS votes, count(DISTINCT gram) AS grams, min(pos) AS first, max(pos) + 2 AS last,
    bool_or(gram = key) AS has_key
  FROM hit JOIN span USING (doc_id, tid, d) JOIN t USING (tid) GROUP BY doc_id, tid, s),
fits AS (
  SELECT doc_id, label, exact, first, CAST(grams AS DOUBLE) / kinds AS share
  FROM found JOIN t USING (tid) JOIN tn USING (tid)
  WHERE CASE WHEN exact THEN votes = size
    ELSE CAST(grams AS DOUBLE) / kinds >= 0.6 AND (has_key OR key = '') AND last - first < 2 * size + 6 END),
g AS (
  SELECT doc_id, count(*) FILTER (exact) AS n, min(first) FILTER (exact) AS f, max(first) FILTER (exact) AS l,
    array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM fits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_base,
  CAST(g.f AS BIGINT) AS first_word, CAST(g.l AS BIGINT) AS last_word,
  coalesce(g.base_labels, '') AS base_labels, coalesce(g.labels, '') AS labels, coalesce(g.score, CAST(0 AS DOUBLE)) AS score
FROM w LEFT JOIN g USING (doc_id)
""",
    "op5_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i FROM win JOIN firsts USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(0, 50) AS r(j)),
words AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
kept AS (
  SELECT doc_id, array_to_string(list(word ORDER BY p), ' ') AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
""",
    "op9_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM w),
sh AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
comp(id, c) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  (SELECT l.b, min(x.c) FROM comp x JOIN links l ON l.a = x.id JOIN recurring.comp p ON p.id = l.b WHERE x.c < p.c GROUP BY l.b))
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, comp.c AS component_id, s.doc_id = comp.c AS kept FROM sets s JOIN comp ON comp.id = s.doc_id
""",
    "op11_periodic_runs": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS o,
    """ + _crc32("doc_id") + r""" AS h
  FROM documents),
k AS (SELECT *, len(o) AS n, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM d),
w AS MATERIALIZED (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE o END AS w
  FROM k),
-- A run of four periods q holds two whole ones from a multiple of q on.
mark AS (SELECT doc_id, w, n, q, unnest(range(0, n - 2 * q + 1, q)) AS m FROM (SELECT *, unnest(range(1, n // 4 + 1)) AS q FROM w)),
near AS (SELECT doc_id, w, q, m FROM mark WHERE w[m + 1] = w[m + q + 1] AND w[m + q] = w[m + 2 * q]),
cand AS MATERIALIZED (SELECT DISTINCT doc_id, q FROM near WHERE w[m + 1 : m + q] = w[m + q + 1 : m + 2 * q]),
same AS (SELECT doc_id, q, i FROM (SELECT doc_id, w, q, unnest(range(1, n - q + 1)) AS i FROM cand JOIN w USING (doc_id)) WHERE w[i] = w[i + q]),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
long AS (SELECT doc_id, q, min(i) - 1 AS s, count(*) + q AS l FROM isle GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM long GROUP BY doc_id, s, l),
per AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    arg_min({'s': s, 'l': l, 'q': q}, {'x': -l, 's': s, 'q': q}) AS b
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s + q + 1, s + l + 1)) AS i FROM run)),
lost AS (SELECT doc_id, list(i) AS x FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM w JOIN lost USING (doc_id)) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.q AS BIGINT) AS period,
  CAST((1000 * b.l) // b.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(t, array_to_string(w.w, ' '))) AS collapsed_sha256
FROM w LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op13_decontamination": r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, CAST(NULL AS VARCHAR) AS item, text FROM documents UNION ALL
  SELECT 'b', NULL, coalesce(CAST(item_id AS VARCHAR), ''), text FROM benchmark),
w AS (
  SELECT kind, id, item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM t),
win AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS k
  FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM w WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win),
roll AS (SELECT id, m, i, array_to_string(w[i : i + m - 1], ' ') AS k FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, sizes WHERE kind = 'd')),
hit AS (SELECT id, m, i, k FROM roll SEMI JOIN win USING (m, k)),
words AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY id),
items AS (SELECT DISTINCT id, item FROM hit JOIN win USING (m, k)),
listed AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM items GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(listed.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (id) LEFT JOIN listed USING (id) WHERE kind = 'd'
""",
    "op12_conversation_trie": r"""
WITH t AS MATERIALIZED (
  SELECT conv_id AS c, {'r': r, 'x': x} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n, c - c % 5 AS base, """ + _crc32("c") + r""" % 9 AS h FROM t GROUP BY c),
seq AS (
  SELECT n.c, t.pos, t.t FROM n JOIN t ON t.c = n.base AND t.pos < n.h UNION ALL
  SELECT n.c, t.pos + 1000000000, t.t FROM n JOIN t ON t.c = n.c AND t.pos >= n.h),
s AS (SELECT n.c, coalesce(any_value(l.s), []) AS s FROM n LEFT JOIN (SELECT c, list(t ORDER BY pos) AS s FROM seq GROUP BY c) l USING (c) GROUP BY n.c),
p AS (SELECT c, d, s[d].x AS x, len(s) = d AS ends, sha256(CAST(s[1 : d] AS VARCHAR)) AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
path AS MATERIALIZED (SELECT c, d, x, ends, min(c) OVER (PARTITION BY d, k) AS rep FROM p),
node AS MATERIALIZED (
  SELECT rep, d, count(*) AS n_convs, CAST(coalesce((count(*) - 1) * octet_length(encode(any_value(x))), 0) AS BIGINT) AS saved, bool_and(ends) AS leaf,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM path GROUP BY rep, d),
up AS (SELECT path.rep, path.d, sum(u.saved) AS saved, count(*) FILTER (u.leaf) AS leaves FROM node u JOIN path ON path.c = u.rep AND path.d <= u.d GROUP BY path.rep, path.d),
parent AS (SELECT node.rep, node.d, path.rep AS parent FROM node JOIN path ON path.c = node.rep AND path.d = node.d - 1),
kids AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n FROM parent GROUP BY ALL)
SELECT node.rep AS conv_id, CAST(node.d AS BIGINT) AS depth, parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, ends_sha256
FROM node JOIN up USING (rep, d) LEFT JOIN parent USING (rep, d) LEFT JOIN kids USING (rep, d)
""",
}
