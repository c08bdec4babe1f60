"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.chat import format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return read_back(format_conversations(turns.union(spark.createDataFrame(own, turns.schema))))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.vptree import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.mixing import replicate

    return replicate(table(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "source", "copy", "shuffle_key")


#: Target weights of the registered mix; every other source weighs 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.urls import filter_urls, host_of

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The block list of the registered query: hosts whose MD5 starts with 0 to 3.
    hosts = pages.select(host_of(F.col("url")).alias("key")).distinct()
    listed = hosts.where(F.left(F.md5("key"), F.lit(1)).isin(*"0123") & (F.col("key") != ""))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op9_audio_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all conversations as recordings, a note a word; the turns of every hundredth conversation are asked.

    Rows of kind "member": (conv_id, turn) is in the class named by (class_conv_id,
    class_turn). Rows of kind "link": that class, of an asked turn, aligns with the one found.
    """
    from batonflow.llm.audio import align, spoken_fingerprints
    from batonflow.llm.text import in_batches

    turns = in_batches(table(spark, sf_dir, "conversations")).where("conv_id IS NOT NULL")
    recordings = turns.select(F.struct("conv_id", "turn").alias("rec_id"), spoken_fingerprints(F.col("text")).alias("print"))
    found = align(recordings, F.col("rec_id.conv_id") % 100 == 0)
    ids = [F.col(f"{c}.{p}").alias(f"{to}{p}") for c, to in (("rec", ""), ("class", "class_"), ("found", "found_")) for p in ("conv_id", "turn")]
    return found.select("kind", *ids, "offset", "votes", "overlap", "error")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.codebooks import encode

    return encode(table(spark, sf_dir, "embeddings"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.lattice import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from batonflow.llm.lexical import index, search

    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_packing, op4_suffix_dedup, op5_chat_format, op6_nearest, op7_mixing, op8_url_filter, op9_audio_align, op10_jaccard_join, op11_vector_codes, op12_embedding_dedup, op13_ranked_search)}

_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '(\[|<)(INST\]|/INST\]|s>|/s>|<SYS>>|</SYS>>|ROLE\]|SEP\]|/ROLE\])', '\1\\\2', 'g')"

ORACLE_SQL = {
    "op5_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
steps AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS last_no FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(3 + sum(length({_ESCAPED.format("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
    ELSE 18 + length({_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
    WHEN prev = 'user' THEN role = 'assistant' ELSE false END) AND max(CASE WHEN last_no = 1 THEN role END) = 'assistant' AS valid
FROM steps GROUP BY conv_id""",
    "op6_nearest": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
    "op7_mixing": """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
w AS (SELECT *, CASE source WHEN 'src0' THEN 4.0::DOUBLE WHEN 'src1' THEN 2.0::DOUBLE WHEN 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n),
r AS (SELECT *, (SELECT sum(n) FROM n)::DOUBLE * w / (SELECT sum(w) FROM w) / n AS rate FROM w),
p AS (SELECT *, greatest(1, ceil(rate / 16))::INT AS parts FROM r),
t AS (SELECT *, list_transform(range(0, 96), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate / parts) * pow(rate / parts, i) / gamma(i + 1)))) AS sums FROM p),
k AS (SELECT d.doc_id, d.name, d.source, list_sum(list_transform(range(1, t.parts + 1), lambda j: len(list_filter(t.sums, lambda c:
    c <= ('0x' || left(md5('17:' || d.name || ':' || j::VARCHAR), 13))::BIGINT / 4503599627370496.0::DOUBLE)))) AS copies
  FROM (SELECT *, coalesce(doc_id::VARCHAR, 'null ' || md5(coalesce(text, ''))) AS name FROM documents) d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, copy::INT AS copy, md5('17 order:' || name || ':' || copy::VARCHAR) AS shuffle_key
FROM (SELECT doc_id, name, source, unnest(range(0, copies::BIGINT)) AS copy FROM k WHERE copies > 0)""",
    "op8_url_filter": r"""
WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS (SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN host <> '' AND left(md5(host), 1) IN ('0', '1', '2', '3') THEN 'block' ELSE 'allow' END AS verdict FROM r""",
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT m.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(m.vec_id, coalesce(l.b, m.vec_id)) AS component_id,
  m.vec_id <= coalesce(l.b, m.vec_id) AS kept
FROM embeddings m LEFT JOIN n ON n.a = m.vec_id LEFT JOIN least l ON l.a = m.vec_id""",
    "op13_ranked_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
k AS (SELECT *, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0), c AS (SELECT count(*)::BIGINT AS all_n, sum(n)::BIGINT AS all_l FROM k),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM k) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * all_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * all_n) // all_l)))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN t USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20""".replace("\\\\", "\\"),
}


def _codebook_sql(rounds: int = 4) -> str:
    """Lloyd's rounds as one table expression after the other; inner products of integers are exact in doubles."""
    far = "list_inner_product(p.c, p.c) + list_inner_product(b.c, b.c) - 2 * list_inner_product(p.c, b.c)"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (SELECT p.vec_id, p.part, arg_min(b.idx, {{'d': {far}, 'i': b.idx}}) AS idx, min({far})::BIGINT AS d FROM p JOIN b{i} b USING (part) GROUP BY 1, 2)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, idx, list(m ORDER BY pos) AS c FROM (SELECT part, idx, pos, (sum(x) // count(*))::DOUBLE
  - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS m FROM (SELECT p.part, a.idx, unnest(p.c)::BIGINT AS x, generate_subscripts(p.c, 1) AS pos FROM p JOIN a{i} a USING (vec_id, part))
  GROUP BY part, idx, pos) GROUP BY part, idx),
b{i + 1} AS (SELECT b.part, b.idx, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN m{i} m USING (part, idx))""")
    steps = ",\n".join(steps)
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
p AS MATERIALIZED (SELECT vec_id, part, c[part * len(c) // 4 + 1 : (part + 1) * len(c) // 4] AS c FROM v, (SELECT unnest(range(4)) AS part)),
b0 AS (SELECT p.part, k.idx, p.c FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM v QUALIFY idx < 256) k JOIN p USING (vec_id)),
{steps},
s AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, idx, pos)) AS sha FROM (SELECT part, idx, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM b{rounds})),
e AS (SELECT vec_id, string_agg(lower(printf('%02x', idx)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM e JOIN v USING (vec_id), s"""


ORACLE_SQL["op11_vector_codes"] = _codebook_sql()
