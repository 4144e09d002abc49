"""The queries of these operators over the standard tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table

BENCHMARK_WINDOW = 10


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; another path may be given to token_counts()."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_prob, grade_decided, selected."""
    from lectern.llm.quality import grade

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return grade(docs, ratings).select("doc_id", "expected_grade", "tail_prob", "grade_decided", (F.col("tail_prob") >= 0.5).alias("selected"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_block, mix_slot, mix_position, in_mix."""
    from lectern.llm.mixing import mixed, tempered

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixed(docs, tempered(docs)).select("doc_id", "source", "mix_block", "mix_slot", "mix_position", "in_mix")


#: What conversation -7 says, in both of its turns.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.chat import chains, conversations, read_back

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return read_back(conversations(chains(rows.unionByName(more)))).withColumnRenamed("conv", "conv_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"), 40)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.decontaminate import digest, matches

    return digest(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), BENCHMARK_WINDOW))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.pivots import neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.llm.suffix_dedup import without_repeats

    done = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256; one of ten texts has a periodic tail."""
    from lectern.llm.periodic import digest, periodic_runs, with_periodic_tails

    return digest(periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents"))))


#: (host, path, action)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_of; links are what pages declare and their sites' usual redirects."""
    from lectern.llm.url_filters import declared_links, url_verdicts, usual_redirects

    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_verdicts(pages, rules, declared_links(pages).unionByName(usual_redirects(pages)))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank: documents drawn by how much their words are those of benchmark."""
    from lectern.llm.importance import resampled

    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality_classifier, op3_mixing, op4_chat_formatting, op5_sharding, op6_decontamination, op7_minhash, op8_neighbours, op9_token_counts, op10_suffix_dedup, op11_periodic_runs, op12_url_filters, op13_importance_resampling)}

def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


_ITEM_WORDS = _words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SHINGLE_WORDS = _words("text", r"[^\x20\x09-\x0D]+")

#: The table of crc32, and the crc32 of a text by it.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str) -> str:
    numbers = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: Every pair of places in a text where three words are the same; stretches of such pairs are runs.
_RUNS_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("doc_id::VARCHAR")} AS h FROM documents, {_CRC_TABLE}),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 % greatest(len(w), 1) AS a, 3 + h // 10 % 8 AS e FROM d),
p AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // e) END]) ELSE w END AS w FROM a),
x AS (SELECT doc_id, unnest(w) AS v, unnest(range(n)) AS i FROM p), g AS (SELECT doc_id, i, v || ' ' || lead(v) OVER o || ' ' || lead(v, 2) OVER o AS g FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i AS i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS k FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + 2 + q AS l FROM m GROUP BY doc_id, q, k), r AS (SELECT doc_id, s, l, min(q) AS q FROM s WHERE l >= 2 * q AND l >= 12 GROUP BY doc_id, s, l),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS told, first(struct_pack(s := s, l := l, q := q) ORDER BY l DESC, s, q) AS b FROM r GROUP BY 1),
o AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r), c AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM x ANTI JOIN o USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""

_URL = {"host": r"translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "path": r"coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"}
_CANONICAL = rf"""CASE WHEN NOT contains(url, '://') THEN url ELSE 'https://' || regexp_replace({_URL["host"].format("url")}, '^(www|m)\.([^.]+\.)', '\2') || regexp_replace({_URL["path"].format("url")}, '(/|\.html?)$', '') ||
coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_[a-z]+|igshid)(=|$)'))), '&'), ''), '') END"""
_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)
_FITS = "u.host = r.host OR ends_with(u.host, '.' || r.host)"
_URLS_SQL = rf"""WITH RECURSIVE rules(host, path, action) AS (VALUES {_RULES}), l AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS link FROM pages),
f AS (SELECT url AS a, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
ELSE rtrim(regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1), '/') || '/' || link END AS b FROM l WHERE link <> '' UNION SELECT url, {_CANONICAL} FROM pages),
e AS (SELECT a, b FROM f WHERE a <> b UNION SELECT b, a FROM f WHERE a <> b), n AS (SELECT DISTINCT a AS url FROM e UNION SELECT DISTINCT url FROM pages WHERE url IS NOT NULL),
c(url, c) AS (SELECT url, url FROM n UNION SELECT e.b, c.c FROM c JOIN e ON e.a = c.url WHERE c.c < e.b), k AS (SELECT url, min(c) AS c FROM c GROUP BY 1),
u AS (SELECT url, {_URL["host"].format("url")} AS host, {_URL["path"].format("url")} AS path FROM n),
j AS (SELECT url, first(r.host || r.path ORDER BY length(r.host || r.path) DESC, action, length(r.host) DESC) AS rule, first(action ORDER BY length(r.host || r.path) DESC, action, length(r.host) DESC) AS action FROM u JOIN rules r ON ({_FITS}) AND starts_with(u.path, r.path) GROUP BY url),
v AS (SELECT c, min(action) AS v FROM j JOIN k USING (url) GROUP BY c)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(action, v, 'allow') AS verdict, k.c AS alias_of FROM pages p LEFT JOIN u ON u.url = p.url LEFT JOIN j ON j.url = p.url LEFT JOIN k ON k.url = p.url LEFT JOIN v ON v.c = k.c"""

_RESAMPLED_SQL = rf"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS v FROM d), y AS (SELECT unnest({_ITEM_WORDS}) AS v FROM benchmark),
h AS (SELECT v, {_crc("v")} % 10000 AS b FROM (SELECT v FROM x UNION SELECT v FROM y), {_CRC_TABLE}), s AS (SELECT b, count(*) AS s FROM x JOIN h USING (v) GROUP BY b), t AS (SELECT b, count(*) AS t FROM y JOIN h USING (v) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM x) AS s, (SELECT count(*) FROM y) AS t), g AS (SELECT s.b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.s + 10000) / ((s.s + 1)::DOUBLE * (n.t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), n),
w AS (SELECT doc_id, count(*) AS n_features, sum(g)::BIGINT AS total FROM x JOIN h USING (v) JOIN g USING (b) GROUP BY doc_id),
o AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM o), q AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, r AS rank FROM z LEFT JOIN (SELECT doc_id, r FROM q WHERE r <= (SELECT count(*) * 10 // 100 FROM q)) USING (doc_id)"""

#: SQL for the queries that it can express. The others are fitted (1, 2), approximate (8), need a tokenizer (9) or bytes (10), or
#: are one of many equally good arrangements (3, 5, the pipeline); tests compare them with brute force or a law.
ORACLE_SQL: dict[str, str] = {
    "op11_periodic_runs": _RUNS_SQL,
    "op12_url_filters": _URLS_SQL,
    "op13_importance_resampling": _RESAMPLED_SQL,
    "op4_chat_formatting": f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '</?s>|\\[/?INST\\]')) AS escaped FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(escaped + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op6_decontamination": f"""WITH i AS (SELECT item_id::VARCHAR AS item, {_ITEM_WORDS} AS w FROM benchmark), iw AS (SELECT DISTINCT item, least(len(w), {BENCHMARK_WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {BENCHMARK_WINDOW}) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {BENCHMARK_WINDOW}) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), sizes AS (SELECT DISTINCT n FROM iw), dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, item, k, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents), s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b), c AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id""",
}
