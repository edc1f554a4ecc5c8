"""The named queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression, divergence, media, mixing, passages, personal, probminhash, qualityrules, repair, sortmeans, tokencount, urlcascade
from .common import shared_dir, stored, table

def multilingual_ranks() -> tuple[str, str]:
    """Path of the ranks, and the pattern that goes with them."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = multilingual_ranks()
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, digest=True)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.write(table(spark, sf_dir, "documents"), shared_dir(spark)))


def op3_qualityrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(qualityrules.statistics(table(spark, sf_dir, "documents")))
    return qualityrules.judge(stats, qualityrules.fit(stats, table(spark, sf_dir, "labels")))


#: A source's domain is found from its number.
DOMAINS = ["web", "books", "news", "forum"]
MIX_WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "forum": 1}, "lang": {"en": 4, "de": 3, "fr": 2, "es": 3}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 1.0, 2, 17


def mix_levels() -> dict:
    domain = f"element_at(array({', '.join(map(repr, DOMAINS))}), cast(coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) as bigint), 0) % {len(DOMAINS)} + 1 as int))"
    return {"domain": F.expr(domain), "lang": F.col("lang"), "source": F.col("source")}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS, MIX_SHARE, MIX_SEED, MIX_EPOCHS)
    return out.select(F.col("row.doc_id").alias("doc_id"), "domain", "lang", "source", "epoch", "n_tokens")


#: verdict, host, beginning of the path
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Hosts blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op5_urlcascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "host string")
    return urlcascade.judge(table(spark, sf_dir, "pages"), URL_RULES, listed)


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), *tokencount.sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(table(spark, sf_dir, "documents")).drop("key")


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op9_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    docs = table(spark, sf_dir, "documents")
    model = compression.fit(docs, table(spark, sf_dir, "labels"), third != 1)
    return compression.score(docs, model).select("doc_id", (third == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return repair.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


#: Clusters, rounds, seed of the starts' hashes.
CLUSTERS, ROUNDS, CLUSTER_SEED = 8, 10, 3


def op11_sortmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sortmeans.report(table(spark, sf_dir, "embeddings"), CLUSTERS, ROUNDS, CLUSTER_SEED)


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _mixing_sql(), "op5_urlcascade": _url_sql(), "op11_sortmeans": _cluster_sql(), "op13_divergence": _divergence_sql()}


def _cluster_sql() -> str:
    """Plain k-means, a component a row."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
            n{k} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place
                                  FROM (SELECT r, c, sum((x - m) * (x - m)) AS d FROM x JOIN c{k} USING (i) GROUP BY r, c)) WHERE place = 1)""")
        if k < ROUNDS:
            steps.append(f"""
            c{k + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, m)::BIGINT AS m FROM c{k} LEFT JOIN (SELECT c, i, sum(x) AS s, count(*) AS n FROM n{k} JOIN x USING (r) GROUP BY c, i) USING (c, i))""")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
                                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        x AS MATERIALIZED (SELECT r, i, floor(1024 * e::DOUBLE)::BIGINT AS x FROM (SELECT r, unnest(embedding) AS e, unnest(range(64)) AS i FROM v)),
        first AS (SELECT r, row_number() OVER (ORDER BY sha256('{CLUSTER_SEED}:' || vec_id) NULLS LAST, embedding) - 1 AS c FROM v),
        c0 AS MATERIALIZED (SELECT c, i, x AS m FROM first JOIN x USING (r) WHERE c < {CLUSTERS}), {",".join(steps)},
        marks AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
        SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM n{ROUNDS} JOIN v USING (r) JOIN marks USING (c)"""


def _divergence_sql() -> str:
    """Shares of every kept term in every group, joined by term."""
    least, top, unit, more = divergence.LEAST_DOCS, divergence.TOP, divergence.UNIT, divergence.SMOOTHING
    return rf"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM d),
        w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {least}),
        c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
        f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS MATERIALIZED (SELECT lang, source, term, n, (1 + ({unit}::HUGEINT * (n + {more})) // (sum(n) OVER s + {more} * count(*) OVER s))::BIGINT AS p,
                     (1 + ({unit}::HUGEINT * (total + {more})) // (sum(total) OVER s + {more} * count(*) OVER s))::BIGINT AS q FROM f WINDOW s AS (PARTITION BY lang, source)),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
                 ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
        own AS (SELECT lang, source, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
        ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
                   UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM own) WHERE rank <= {top})
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked"""


def _mixing_sql() -> str:
    """Budgets by the same closed form, prefixes by one running sum a leaf."""
    keys = ["domain", "lang", "source"]
    case = lambda level: f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items()) + " ELSE 1 END" if level in MIX_WEIGHTS else "1"
    steps = []
    for k, level in enumerate(keys):
        own, parent = ", ".join(keys[: k + 1]), ", ".join(keys[:k])
        part = f"PARTITION BY {parent} " if parent else ""
        source = f"(SELECT {own}, sum(tokens) AS tokens, sum(tokens) * {MIX_EPOCHS} AS supply FROM leaves GROUP BY {own})"
        above = f"{source} JOIN (SELECT {parent}, budget AS up FROM b{k - 1}) USING ({parent})" if parent else f"{source}, (SELECT sum(tokens) * {float(MIX_SHARE)} AS up FROM leaves)"
        steps.append(f"""
            w{k} AS (SELECT *, ({case(level)})::DOUBLE AS w FROM {above}),
            x{k} AS (SELECT *, greatest(0, up - coalesce(sum(supply) OVER ({part}ORDER BY supply / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                               / sum(w) OVER ({part}ORDER BY supply / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x FROM w{k}),
            y{k} AS (SELECT *, arg_min(CASE WHEN x * w < supply THEN x END, CASE WHEN x * w < supply THEN supply / w END) OVER ({part.strip()}) AS level_x FROM x{k}),
            b{k} AS (SELECT {own}, tokens, supply, CASE WHEN level_x IS NULL THEN supply::DOUBLE ELSE least(supply::DOUBLE, level_x * w) END AS budget FROM y{k})""")
    return rf"""
        WITH d AS (SELECT doc_id, ['{"', '".join(DOMAINS)}'][coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1] AS domain, lang, source,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL), {",".join(steps)},
        plan AS (SELECT domain, lang, source, (floor(least(budget, supply) + 1e-6)::BIGINT // tokens)::BIGINT AS whole, (floor(least(budget, supply) + 1e-6)::BIGINT % tokens)::BIGINT AS rest FROM b2 WHERE tokens > 0),
        placed AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), doc_id) - n_tokens AS before FROM d JOIN plan USING (domain, lang, source))
        SELECT doc_id, domain, lang, source, unnest(range((whole + CASE WHEN before < rest THEN 1 ELSE 0 END)::BIGINT)) AS epoch, n_tokens::BIGINT AS n_tokens FROM placed"""


def _url_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for _, h, p in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    )
    kinds = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in URL_RULES)
    blocked = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in BLOCKED_HOSTS)
    return rf"""
            WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
            parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            ruled AS (SELECT *, CASE {fits} END AS rule FROM parts)
            SELECT page_id, host, path, rule, CASE {kinds} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM ruled"""
