"""URL filtering by hashed host-suffix / path-prefix expressions (DataFrame operations only).

Every URL is expanded into the expressions that could name a rule fitting it: host suffixes at label borders crossed with
path prefixes.  Only suffix depths and prefix lengths that occur among the rules are made, which is exact and keeps the
expansion at (depths x lengths) short strings whatever the URL.  Expressions meet the rules in an equi-join on a short
hash prefix; the full SHA-256 digest is confirmed afterwards, then the longest rule wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltrace.llm.storage import written

MAX_RULES = 10_000  # the broadcast bound: rules are a Python sequence and refused beyond this

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or a string without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, _URL, 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def url_filter(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default_verdict: str = "allow",
    prefix_hex: int = 8,
) -> DataFrame:
    """Judge every row of ``pages``: one output row (page_id, host, path, rule, verdict) for each input row.

    rules: (verdict, host, path) triples.  A rule fits its host and subdomains when the path starts with the rule's path;
    among fitting rules the longest ``host + path`` wins, ``block`` before ``allow`` at equal length, then by name.

    Null or malformed URLs have empty host and path, no rule and the default verdict.  Repeated rows are judged one by
    one.  URLs of any length are split and looked up whole, in as many expressions as rules have host depths times path lengths.  A-Z of
    a rule's host count as a-z, as a URL's do.  An empty table gives an empty result.  Other columns of the input, whatever their names, are not read.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} can be broadcast")
    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default_verdict)})

    depths = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    suffixes = [F.when(dots >= d - 1, F.substring_index("host", ".", -d)) for d in depths]
    prefixes = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    expressions = F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes]))
    # Row numbers are written before rows are dealt by them: a task that runs again could number them otherwise.
    numbered = written(base.withColumn("rid", F.monotonically_increasing_id()), "urls")
    probes = (
        numbered.select("rid", "page_id", "host", "path", F.explode_outer(expressions).alias("expression"))
        .withColumn("digest", F.sha2(F.col("expression"), 256))
        .withColumn("short", F.substring("digest", 1, prefix_hex))
    )

    values = ", ".join(f"({_quoted(v)}, {_quoted(h.translate(str.maketrans(_UPPER, _LOWER)) + p)})" for v, h, p in rules)
    table = (
        pages.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(action, rule_text)")
        .withColumn("rule_digest", F.sha2("rule_text", 256))
        .withColumn("rule_short", F.substring("rule_digest", 1, prefix_hex))
    )
    # The short prefix alone is the join's key; >= and <= confirm the full digest of what it finds.
    confirmed = (F.col("digest") >= F.col("rule_digest")) & (F.col("digest") <= F.col("rule_digest"))
    hits = probes.join(F.broadcast(table), (F.col("short") == F.col("rule_short")) & confirmed, "left")
    best = F.max(
        F.when(
            F.col("rule_text").isNotNull(),
            F.struct(F.length("rule_text").alias("size"), (F.col("action") == "block").alias("blocks"), "rule_text", "action"),
        )
    )
    return (
        hits.groupBy("rid", "page_id", "host", "path")
        .agg(best.alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule_text").alias("rule"),
            F.coalesce("best.action", F.lit(default_verdict)).alias("verdict"),
        )
    )
