"""The operators applied to whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import Template, conversation_digests
from .decontaminate import contaminated
from .htmlextract import extract_main_text
from .jaccard import jaccard_components
from .langid import fit_language_model, identify_language
from .mixing import allocate
from .pii import find_personal_data, span_digest
from .quality import fit_quality, score_quality
from .repetition import RepetitionRules, repetition_rules
from .storage import held_out
from .urlfilter import LINK, LinkTrust, judge_urls

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
QUALITY_CUT = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out()))
    return identify_language(docs, model).withColumn("held_out", held_out())


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(table(spark, sf_dir, "pages"), keep=("url",))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.lit(True))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score_quality(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocate(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents")).drop("ngram_coverage", "top_coverage", "line_coverage")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return conversation_digests(turns.union(more))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pii, op2_language, op3_urls, op4_html, op5_decontaminate, op6_quality, op7_mixing, op8_repetition, op9_jaccard, op10_chat)}


def _repetition_sql() -> str:
    rules = RepetitionRules()
    sizes = sorted({*rules.ngrams, *rules.top, rules.repeat_window})
    long_ones = sorted({*rules.ngrams, rules.repeat_window})
    windows = "".join(f", CASE WHEN count(*) OVER f{n} = {n} THEN string_agg(word, chr(1)) OVER f{n} END AS g{n}, sum(length(word)) OVER f{n} AS z{n}" for n in sizes)
    frames = ", ".join(f"f{n} AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in sizes)
    twice = "".join(f", CASE WHEN g{n} IS NOT NULL THEN count(*) OVER (PARTITION BY doc_id, g{n}) ELSE 0 END AS k{n}" for n in sizes)
    hit = "".join(f", max(CASE WHEN k{n} > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS h{n}" for n in long_ones)
    sums = "".join(f", sum(h{n} * length(word)) / greatest(sum(length(word)), 1) AS c{n}" for n in long_ones)
    sums += "".join(f", max(CASE WHEN k{n} >= {rules.top_times} THEN k{n} * z{n} ELSE 0 END) / greatest(sum(length(word)), 1) AS t{n}" for n in rules.top)
    bad = " OR ".join([*(f"coalesce(c{n}, 0) > {most}" for n, most in rules.ngrams.items()), *(f"coalesce(t{n}, 0) > {most}" for n, most in rules.top.items())])
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM d)),
g AS (SELECT *{windows} FROM w WINDOW {frames}), t AS (SELECT *{twice} FROM g), h AS (SELECT *{hit} FROM t),
c AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, sum(h{rules.repeat_window}) AS n_repeat_words{sums} FROM h GROUP BY 1),
l AS (SELECT doc_id, line, count(*) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS z FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
r AS (SELECT doc_id, sum(k - 1) AS n_dup_lines, sum(CASE WHEN k > 1 THEN k * z ELSE 0 END) AS repeated FROM l GROUP BY 1),
j AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(repeated, 0) / greatest(coalesce(word_chars, 0), 1) AS lines, c.* EXCLUDE (doc_id, n_words, word_chars, n_repeat_words) FROM d LEFT JOIN c USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_percent} * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT ({bad} OR lines > {rules.lines}) AS kept FROM b"""


def _url_sql() -> str:
    """Rules, and trust and distrust over links in as many rounds as the operator takes."""
    how = LinkTrust()
    low = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

    def fits(rule: str) -> str:
        own, slash, rest = rule.partition("/")
        return f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}')"

    longest = sorted(URL_RULES, key=lambda r: (-len(r[0]), r[1] != "block", r[0]))
    case = lambda place: "CASE " + " ".join(f"WHEN {fits(r[0])} THEN '{r[place]}'" for r in longest) + " END"
    link = LINK.replace("'", "''")

    def rank(name: str, verdict: str, src: str, dst: str) -> str:
        parts = [
            f"{name}_s AS (SELECT host, (1 - {how.damping}) * count(*) / sum(count(*)) OVER () AS mass FROM f WHERE ruled = '{verdict}' AND host <> '' GROUP BY host)",
            f"{name}_p AS (SELECT {src} AS src, {dst} AS dst, {how.damping} * n / sum(n) OVER (PARTITION BY {src}) AS p FROM e)", f"{name}_0 AS (SELECT host, mass FROM {name}_s)",
        ]
        for i in range(1, how.rounds + 1):
            parts.append(f"{name}_r{i} AS MATERIALIZED (SELECT dst AS host, sum(p * mass) AS mass FROM {name}_p JOIN {name}_{i - 1} ON src = host GROUP BY dst)")
            parts.append(f"{name}_{i} AS MATERIALIZED (SELECT host, sum(mass) AS mass FROM (SELECT * FROM {name}_r{i} UNION ALL SELECT * FROM {name}_s) GROUP BY host)")
        return ", ".join(parts)

    return rf"""WITH k AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {low}) ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM (SELECT page_id, html, coalesce(url, '') AS url FROM pages)),
f AS (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS ruled FROM k),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: translate(x, {low})))) AS dst FROM k) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
{rank("trust", "allow", "src", "dst")}, {rank("distrust", "block", "dst", "src")},
h AS (SELECT count(DISTINCT host) AS hosts FROM (SELECT src AS host FROM e UNION ALL SELECT dst FROM e)),
bad AS (SELECT d.host FROM distrust_r{how.rounds} d LEFT JOIN trust_r{how.rounds} t USING (host), h WHERE d.mass > coalesce(t.mass, 0) AND d.mass * hosts >= {how.share})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM f"""


_JACCARD_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], chr(1)))) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE CAST([] AS VARCHAR[]) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM x), e AS (SELECT doc_id, unnest(s) AS s FROM x),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
ways AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM n JOIN reach ON reach.a = n.doc_id GROUP BY 1, 2"""


def _chat_sql() -> str:
    template = Template()
    control = "|".join(re.escape(c) for c in [*template.controls(), template.escape]).replace("'", "''")
    frame = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in template.frames.items())
    said = "</s>[INST] ok [/INST]"
    in_order = "ORDER BY turn, role, text"
    return rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {in_order})) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {in_order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE role {frame} END + length(text) + len(regexp_extract_all(text, '{control}'))) AS BIGINT) AS formatted_chars, regexp_matches(string_agg(left(role, 1), '' {in_order}), '^s?u(au)*a?$') AS valid
FROM c GROUP BY conv_id"""


#: The other operators learn, draw or extract in ways that SQL doesn't express; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op3_urls": _url_sql(), "op8_repetition": _repetition_sql(), "op9_jaccard": _JACCARD_SQL, "op10_chat": _chat_sql()}
