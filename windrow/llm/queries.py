"""Registered queries of the operators for training text, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from windrow.llm import bpe, conversations, divergence, embeddings, exact_dedup, fingerprints, lm_score, mixing, near_dedup, phrase_dedup, secret_scan, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules and the hosts that are blocked where no rule fits.
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]
URL_BLOCKS = ["*spam-farm*/**", "*spam-farm*", "*cheap-pills*/**", "*cheap-pills*"]


@query(
    "op1_url_filter",
    r"""
    WITH parts AS (
        SELECT page_id,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
        FROM pages
    ), rules(action, rule, h, p) AS (
        VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
               ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
    ), numbered AS (SELECT row_number() OVER () AS n, * FROM parts),
    best AS (
        SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
        FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY n
    )
    SELECT page_id, host, path, rule,
           coalesce(action, CASE WHEN host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%' THEN 'block' ELSE 'allow' END) AS verdict
    FROM numbered LEFT JOIN best USING (n)
    """,
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKS)


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    out = lm_score.score(docs, bucket != 2, least=1)
    return out.select("doc_id", (bucket == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def toxicity_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Index:
    """Index over the documents whose labels may be learnt from."""
    return toxicity.fit(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_index(spark, docs, sf_dir), threshold=0.7)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"), samples=64)


@query("op5_source_mix")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


def word_vocabulary() -> str:
    """Path of the public vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoding_digests() -> list[Column]:
    """SHA-256 of ``ids`` (decimal, joined by a space) and of ``decoded``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return [F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), word_vocabulary())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), *encoding_digests())


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    spans = secret_scan.written(F.concat("base", "random"))
    return out.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


@query(
    "op8_phrase_dedup",
    r"""
    WITH words AS (
        SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ), windows AS (
        SELECT d, s, list_aggregate(w[s : s + 34], 'string_agg', ' ') AS k FROM (SELECT d, w, unnest(range(1, len(w) - 33)) AS s FROM words WHERE len(w) >= 35)
    ), again AS (SELECT d, s FROM windows JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)),
    gone AS (SELECT DISTINCT d, unnest(range(s, s + 35)) AS p FROM again),
    places AS (SELECT d, doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words),
    kept AS (SELECT d, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (d, p) GROUP BY d)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (d)
    """,
)
def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_dedup.deduplicated(table(spark, sf_dir, "documents"), size=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op9_near_dedup",
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                            ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
    ), numbered AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
    terms AS (SELECT c, n, unnest(s) AS t FROM numbered),
    rare AS (SELECT t, count(*) AS df FROM terms GROUP BY t),
    ranked AS (SELECT c, n, t, row_number() OVER (PARTITION BY c ORDER BY df, t) AS r FROM terms JOIN rare USING (t)),
    prefix AS (SELECT * FROM ranked WHERE r <= n - ceil(n * 0.8) + 1),
    pairs AS (SELECT DISTINCT a.c AS a, b.c AS b, a.n AS an, b.n AS bn FROM prefix a JOIN prefix b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    links AS (
        SELECT a, b FROM (SELECT a, b, an, bn, count(*) AS i FROM pairs JOIN terms x ON x.c = a JOIN terms y ON y.c = b AND y.t = x.t GROUP BY ALL)
        WHERE 100 * i >= 80 * (an + bn - i)
    ), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(a, b) AS (SELECT c, c FROM numbered UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
    least AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
    SELECT doc_id, len(s) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
    FROM sets LEFT JOIN numbered USING (s) LEFT JOIN least USING (c)
    """,
)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=2, similarity=(80, 100))


@query(
    "op10_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
    ), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = F.sha2(exact_dedup.normalised(docs["text"]), 256)
    out = exact_dedup.exact_groups(docs, carry={"text_sha256": digest})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op13_source_divergence",
    r"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    words AS (
        SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
    ), kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
    uses AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    langs AS (SELECT lang, coalesce(sum(total), 0) + 5 * count(term) AS size FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang),
    groups AS (
        SELECT lang, source, coalesce(sum(n), 0) + 5 * any_value(v) AS size
        FROM (SELECT DISTINCT lang, source FROM docs) JOIN (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang) USING (lang)
             LEFT JOIN uses USING (lang, source) GROUP BY lang, source
    ), rates AS (
        SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)) // g.size AS p, 1 + (1000000000 * (total + 5)) // l.size AS q
        FROM groups g JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN uses USING (lang, source, term)
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(v, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS v FROM rates x JOIN rates y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) t
                    ON t.lang = a.lang AND t.source = a.source AND t.other = b.source
    ), ranked AS (
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
        UNION ALL
        SELECT * FROM (SELECT lang, source, 'term', term, p - q AS value, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS rank FROM rates WHERE n > 0 AND p > q) WHERE rank <= 50
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    """,
)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


@query(
    "op11_conversation_repair",
    r"""
    WITH RECURSIVE named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
    ), fated AS (
        SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                                  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS fate FROM named
    ), damaged AS (
        SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
               CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM fated WHERE fate <> 0
    ), placed AS (
        SELECT coalesce(conv_id::VARCHAR, 'null') AS c, turn, role, text, left(role, 1) AS r,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
               CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 2
                    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
        FROM damaged
    ), inserts(a, b, letters, lines, price) AS (
        VALUES ('E', 'E', '', []::VARCHAR[], 0), ('S', 'S', '', [], 0), ('U', 'U', '', [], 0), ('A', 'A', '', [], 0), ('E', 'U', 'I', ['user:'], 5), ('S', 'U', 'I', ['user:'], 5),
               ('U', 'A', 'I', ['assistant:'], 5), ('A', 'U', 'I', ['user:'], 5), ('E', 'A', 'II', ['user:', 'assistant:'], 10), ('S', 'A', 'II', ['user:', 'assistant:'], 10)
    ), arcs(a, b, letter, role, r, price) AS (
        VALUES ('E', 'E', 'D', NULL, NULL, 2), ('S', 'S', 'D', NULL, NULL, 2), ('U', 'U', 'D', NULL, NULL, 2), ('A', 'A', 'D', NULL, NULL, 2),
               ('E', 'S', 'K', NULL, 's', 0), ('E', 'U', 'K', NULL, 'u', 0), ('S', 'U', 'K', NULL, 'u', 0), ('A', 'U', 'K', NULL, 'u', 0), ('U', 'A', 'K', NULL, 'a', 0),
               ('E', 'U', 'R', 'user', NULL, 1), ('S', 'U', 'R', 'user', NULL, 1), ('A', 'U', 'R', 'user', NULL, 1), ('U', 'A', 'R', 'assistant', NULL, 1)
    ), best AS (
        SELECT DISTINCT c, 0::BIGINT AS i, 'E' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM placed
        UNION ALL
        SELECT c, i, state, m.cost, m.audit, m.lines FROM (
            SELECT p.c, p.i, arcs.b AS state, min({'cost': t.cost + inserts.price + arcs.price + CASE WHEN fault = 3 AND letter <> 'D' THEN 5 ELSE 0 END, 'audit': t.audit || letters || letter,
                   'lines': list_concat(t.lines, inserts.lines, CASE WHEN letter = 'D' THEN [] ELSE [coalesce(arcs.role, p.role) || ':' || p.text] END)}) AS m
            FROM best t JOIN placed p ON p.c = t.c AND p.i = t.i + 1 JOIN inserts ON inserts.a = t.state JOIN arcs ON arcs.a = inserts.b
            WHERE (letter = 'D' OR fault NOT IN (1, 2)) AND (letter <> 'K' OR arcs.r = p.r)
            GROUP BY p.c, p.i, arcs.b
        )
    ), ended AS (
        SELECT c, min({'cost': cost + price, 'audit': audit || letters, 'lines': list_concat(best.lines, inserts.lines)}) AS m
        FROM best JOIN (SELECT c, max(i) AS i FROM placed GROUP BY c) USING (c, i) JOIN inserts ON inserts.a = state AND inserts.b IN ('E', 'A') GROUP BY c
    ), totals AS (
        SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM placed GROUP BY c
    ), joints AS (SELECT c, count(*) FILTER (before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, r, lag(r) OVER (PARTITION BY c ORDER BY i) AS before FROM placed) WHERE before IS NOT NULL GROUP BY c)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(array_to_string(m.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, 'null') AS c FROM conversations) LEFT JOIN ended USING (c) LEFT JOIN totals USING (c) LEFT JOIN joints USING (c)
    """,
)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.audited(conversations.damaged(turns), names=turns)


@query(
    "op12_embedding_near_dedup",
    r"""
    WITH RECURSIVE rows AS (SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    sound AS (
        SELECT * FROM rows WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
    ), links AS (SELECT a.n AS a, b.n AS b FROM sound a JOIN sound b ON a.label = b.label AND a.n <> b.n AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    reach(a, b) AS (SELECT n, n FROM rows UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT reach.a AS n, min(rows.vec_id) AS component_id FROM reach JOIN rows ON rows.n = reach.b GROUP BY reach.a),
    counts AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM rows JOIN least USING (n) LEFT JOIN counts USING (n)
    """,
)
def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)
