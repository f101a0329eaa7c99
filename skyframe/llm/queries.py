"""The operators of this subpackage as registered queries over the driver's tables."""

from __future__ import annotations

from checks.registry import Registry
from skyframe.llm import (
    decontaminate,
    exact_dedup,
    manifest,
    mixing,
    pii,
    preference,
    quality,
    secrets,
    sharding,
    simhash,
    trie,
    url_filter,
    warc,
)

registry = Registry()


@registry.query("op1_simhash_near_dedup")
def op1(spark, sf_dir):
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@registry.query("op2_exact_dedup", exact_dedup.ORACLE)
def op2(spark, sf_dir):
    return exact_dedup.exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@registry.query("op3_pii")
def op3(spark, sf_dir):
    return pii.find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@registry.query("op4_secret_scan")
def op4(spark, sf_dir):
    return secrets.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The rules of the production filter.
URL_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

OP5_SQL = f"""
WITH parts AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), rules(rule, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
fitting AS (
    SELECT page_id, host, path, rule, verdict,
           row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, instr(rule, '/') DESC) AS nth
    FROM parts JOIN rules
      ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
     AND starts_with(path, substr(rule, instr(rule, '/')))
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON f.page_id = p.page_id AND f.nth = 1
"""


@registry.query("op5_url_filter", OP5_SQL)
def op5(spark, sf_dir):
    rules = spark.createDataFrame(list(URL_RULES), "rule string, verdict string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter.judge_urls(pages, url_filter.publish(spark, rules))


@registry.query("op6_sharding")
def op6(spark, sf_dir):
    return sharding.interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@registry.query("op7_decontamination")
def op7(spark, sf_dir):
    documents, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return decontaminate.leaks(documents, benchmark)


@registry.query("op8_preference_format", preference.ORACLE)
def op8(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = preference.format_pairs(preference.swapped_replies(turns))
    return rows.withColumns({c: preference.mask_text(rows[c]) for c in ("chosen_mask", "rejected_mask")})


@registry.query("op9_mixing")
def op9(spark, sf_dir):
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@registry.query("op10_quality_classifier")
def op10(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return quality.score_documents(documents, labels)


@registry.query("op11_warc", warc.ORACLE)
def op11(spark, sf_dir):
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@registry.query("op12_merkle_manifest", manifest.ORACLE)
def op12(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest.checked(manifest.manifest(documents, presented={"text": manifest.tampered_text()}))


@registry.query("op13_prefix_trie", trie.ORACLE)
def op13(spark, sf_dir):
    own = trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.prefix_trie(*trie.rebuilt(own))
