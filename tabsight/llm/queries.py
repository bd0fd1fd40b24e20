"""The registered queries of these operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bitpack, infill, latent, packing, pii, preference, quality, resampling, simhash, sketches, suffix, toxicity, urls
from .common import table
from .tokens import tokenizer_path

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query(
    "op4_preference_formatting",
    """WITH own AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
             FROM conversations WHERE conv_id IS NOT NULL),
         last AS (SELECT pair_id, max(turn) AS last FROM own WHERE role = 'assistant' GROUP BY pair_id),
         sided AS (SELECT own.*, last FROM own LEFT JOIN last USING (pair_id)),
         sides AS (
             SELECT pair_id, 'chosen' AS side, turn, role, text FROM sided
             UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM sided WHERE last IS NULL OR turn < last
             UNION ALL SELECT l.pair_id, 'rejected', l.last, s.role, s.text FROM sided s JOIN last l ON l.pair_id = xor(s.pair_id, 1)
                 WHERE s.role = 'assistant' AND s.turn = s.last),
         messages AS (SELECT pair_id, turn, role, text, bool_or(side = 'chosen') AS c, bool_or(side = 'rejected') AS r
             FROM sides GROUP BY ALL),
         ends AS (SELECT pair_id, min(turn) FILTER (c <> r) AS fork FROM messages GROUP BY pair_id),
         cut AS (SELECT messages.*, fork IS NULL OR turn < fork AS common FROM messages JOIN ends USING (pair_id)),
         parts AS (SELECT pair_id, 'prompt' AS part, turn, role, text FROM cut WHERE common
             UNION ALL SELECT pair_id, 'chosen', turn, role, text FROM cut WHERE NOT common AND c
             UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM cut WHERE NOT common AND r),
         shown AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, part <> 'prompt' AND role = 'assistant' AS trained FROM parts)
         SELECT pair_id, part, turn, role, head || text || '<|end|>' || chr(10) AS rendered,
             CASE WHEN trained THEN length(head) ELSE 0 END::BIGINT AS loss_from,
             CASE WHEN trained THEN length(head || text || '<|end|>' || chr(10)) ELSE 0 END::BIGINT AS loss_to FROM shown""",
)
def op4(spark, d):
    return preference.preference_segments(preference.swapped_replies(table(spark, d, "conversations")))


@query("op1_simhash_near_dedup")
def op1(spark, d):
    return simhash.near_duplicates(table(spark, d, "documents"))


@query("op2_quality_rules")
def op2(spark, d):
    got = quality.judge_quality(table(spark, d, "documents"), table(spark, d, "labels"))
    return got.select("doc_id", *quality.COUNTS[:5], "base_failed", "kept", "anomaly")


@query("op3_token_files")
def op3(spark, d):
    manifest = bitpack.write_token_files(table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return bitpack.read_token_files(manifest)


@query("op5_suffix_dedup")
def op5(spark, d):
    got = suffix.remove_repeats(table(spark, d, "documents"))
    digests = [F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return got.select("doc_id", "n_bytes", "n_removed", *digests, (F.col("n_removed") > 0).alias("has_repeat"))


@query("op6_personal_data")
def op6(spark, d):
    return pii.span_digest(pii.find_personal_data(table(spark, d, "documents")))


@query("op7_toxicity")
def op7(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, table(spark, d, "labels")))


@query("op8_packing")
def op8(spark, d):
    return packing.pack_documents(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


@query("op9_benchmark_decontamination")
def op9(spark, d):
    return latent.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


# The rules of the contract.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


@query(
    "op10_url_filters",
    """WITH cut AS (SELECT page_id,
             translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
         rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
             ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
         SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
         FROM cut c LEFT JOIN (
             SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
             FROM (SELECT DISTINCT host, path FROM cut), rules
             WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
         ) b ON b.host = c.host AND b.path = c.path""",
)
def op10(spark, d):
    return urls.judge_urls(table(spark, d, "pages").select("page_id", "url"), spark.createDataFrame(URL_RULES, urls.RULE_SCHEMA))


@query("op11_importance_resampling")
def op11(spark, d):
    got = resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query(
    "op12_minhash_near_dedup",
    r"""WITH RECURSIVE own AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
         sets AS (SELECT r, doc_id, CASE WHEN len(w) > 1
             THEN list_sort(list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) ELSE w END AS s FROM own),
         nodes AS (SELECT s, min(doc_id) AS name, len(s) AS size FROM sets WHERE len(s) > 0 GROUP BY s),
         members AS (SELECT name, size, unnest(s) AS m FROM nodes),
         links AS (SELECT a.name AS a, b.name AS b FROM members a JOIN members b
                 ON a.m = b.m AND a.name < b.name AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
             GROUP BY a.name, b.name, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
         edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
         reach(node, other) AS (SELECT a, b FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON edges.a = reach.other),
         parts AS (SELECT node, min(other) AS least FROM reach GROUP BY node)
         SELECT sets.doc_id, len(sets.s) AS n_shingles, coalesce(least(least, name), sets.doc_id) AS component_id,
             sets.doc_id = coalesce(least(least, name), sets.doc_id) AS kept
         FROM sets LEFT JOIN nodes USING (s) LEFT JOIN parts ON node = name""",
)
def op12(spark, d):
    return sketches.near_duplicates(table(spark, d, "documents"))


@query(
    "op13_fill_in_middle",
    """WITH own AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
         drawn AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens,
             ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM own),
         cut AS (SELECT *, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
             greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
         parts AS (SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m,
             array_to_string(tokens[b + 1:], '') AS s FROM cut)
         SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
             CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
             sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                 ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
             sha256(text) AS restored_sha256 FROM parts""",
)
def op13(spark, d):
    made = infill.fill_in_middle(table(spark, d, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
