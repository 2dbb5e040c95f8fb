"""Registered queries of this subpackage, each over its whole tables, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tachado.llm import chat, credentials, merkle, mixing, ngram_join, packing, quality, sampling, tiling, tokenfiles, trie, urls, windows
from tachado.llm.tables import table, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op4_credentials(spark, d):
    """Secrets in every document, weak parts linked."""
    return credentials.scan(table(spark, d, "documents", "doc_id", "text")).drop("found")


ECHO = "</s>[INST] ok [/INST]"


@query
def op7_chat(spark, d):
    """Every conversation expanded into examples, and read back from them."""
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{ECHO}'), (-7L, 1L, 'assistant', '{ECHO}') AS t(conv_id, turn, role, text)")
    given = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return chat.digest(chat.expand(given.unionByName(own)))


ORACLE["op7_chat"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ECHO}'), (-7, 1, 'assistant', '{ECHO}')),
n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  sum(20 + length(role) + length(text)
    + length(role) - length(replace(role, '~', '')) + length(text) - length(replace(text, '~', ''))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7
  ) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, max(n) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id"""


@query
def op8_tiling(spark, d):
    """Documents that hold benchmark items, one row per pair."""
    docs, items = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")
    return tiling.pairs(tiling.contaminated(docs, items))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op9_url_rules(spark, d):
    """Every page's URL judged by fixed rules and rules mined from labels."""
    return urls.judge(table(spark, d, "pages", "page_id", "url"), table(spark, d, "labels", "doc_id", "quality", "toxic"), RULES)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_files(spark, d):
    """Ids of every document written to flat files, and read back from them."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return tokenfiles.read(spark, tokenfiles.write(docs, vocabulary("word_bpe_49k.json"), end_id=1))


@query
def op6_curve_packing(spark, d):
    """Every document packed along the curve, one row per piece."""
    packed = packing.pack(table(spark, d, "documents", "doc_id", "text"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op1_cotraining(spark, d):
    """Every document scored by two co-trained views."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source")
    views = written(quality.viewed(docs), "views")
    return quality.score(views, quality.train(views, table(spark, d, "labels", "doc_id", "quality", "toxic")))


@query
def op3_weighted_sampling(spark, d):
    """Fingerprints of every document, of its edited text, and their likeness to each other and the next document's."""
    return sampling.compared(table(spark, d, "documents", "doc_id", "text"))


@query
def op10_ngram_jaccard(spark, d):
    """Components of documents that share 90 per cent of their word triples."""
    return ngram_join.linked_components(table(spark, d, "documents", "doc_id", "text"))


@query
def op2_window_dedup(spark, d):
    """Words under repeated windows removed from every document."""
    kept = windows.deduplicated(table(spark, d, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op2_window_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM later),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

ORACLE["op10_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)"""


@query
def op13_merkle(spark, d):
    """Every document proved against the root of the manifest, with line ends lost in those of every second checksum."""
    docs = table(spark, d, "documents", "doc_id", "source", "lang", "n_chars", "text")
    lost = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.verified(merkle.manifest(docs, altered=lost))


def _crc32_sql(x: str) -> str:
    """The unsigned crc32 of an ASCII string, bit by bit, as DuckDB has no function for it."""
    codes = f"list_transform(range(1, len({x}) + 1), lambda i: CAST(ord({x}[i]) AS BIGINT))"
    step = "xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce({codes}, lambda a, c: list_reduce(range(8), lambda b, k: {step}, xor(a, c)), 4294967295), 4294967295)"


ORACLE["op13_merkle"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS hit, concat(
    coalesce(len(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(len(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM documents),
leaf AS (SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
  CASE WHEN hit THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS g FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaf),
low AS (SELECT source, 0 AS lvl, i, n, h FROM placed
  UNION ALL SELECT source, max(lvl) + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY source, i // 3),
sub AS (SELECT source, lvl, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, r AS i, n, h FROM sub
  UNION ALL SELECT max(lvl) + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY i // 3),
beside AS (SELECT a.source, a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM low a JOIN low b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3),
aside AS (SELECT a.lvl, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM high a JOIN high b ON a.lvl = b.lvl AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2),
way AS (SELECT p.doc_id, p.h AS leaf, s.h AS subroot, s.lvl AS top, s.r AS rank, p.source, p.i, 0 AS k, coalesce(p.g, p.h) AS fold, '' AS proof
  FROM placed p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT f.doc_id, f.leaf, f.subroot, f.top, f.rank, f.source, f.i, f.k + 1, sha256(coalesce(b.l, o.l) || f.fold || coalesce(b.r, o.r)), f.proof || coalesce(b.l, o.l) || coalesce(b.r, o.r)
  FROM way f LEFT JOIN beside b ON f.k < f.top AND b.source IS NOT DISTINCT FROM f.source AND b.lvl = f.k AND b.i = f.i // CAST(pow(3, f.k) AS BIGINT)
  LEFT JOIN aside o ON f.k >= f.top AND o.lvl = f.k - f.top AND o.i = f.rank // CAST(pow(3, greatest(f.k - f.top, 0)) AS BIGINT)
  WHERE b.l IS NOT NULL OR o.l IS NOT NULL)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY k DESC) AS last FROM way) CROSS JOIN (SELECT h AS root FROM high WHERE n = 1) WHERE last = 1"""


@query
def op12_mixing(spark, d):
    """Every document with the words that a mix of all sources at weights 1, 2, 3 takes of it."""
    return mixing.taken(mixing.mix(table(spark, d, "documents", "doc_id", "source", "text")))


@query
def op11_prefix_trie(spark, d):
    """Every node of the trie of conversations that share their first turns with one of their hundred."""
    number = F.col("conv_id")
    convs = trie.sequences(table(spark, d, "conversations", "conv_id", "turn", "role", "text"))
    built = trie.with_shared_heads(convs, number - number % 100, (F.crc32(number.cast("string").cast("binary")) % 6).cast("int"))
    return trie.nodes(built).select("conv_id", "depth", "parent_conv_id", *trie.SUMS, F.col("ends").alias("ends_sha256"))


ORACLE["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
built AS (SELECT c.conv_id, 0 AS part, k, m, n FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, m, n FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
seq AS (SELECT conv_id, coalesce(list(m ORDER BY part, k) FILTER (m IS NOT NULL), []) AS ms, coalesce(list(n ORDER BY part, k) FILTER (m IS NOT NULL), []) AS ns
  FROM c LEFT JOIN built USING (conv_id) GROUP BY conv_id),
pre AS (SELECT conv_id, d, md5(array_to_string(ms[1:d], ',')) AS p, coalesce(ns[d], 0) AS n, d = len(ms) AS last
  FROM (SELECT *, unnest(range(len(ms) + 1)) AS d FROM seq)),
up AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS q FROM pre),
node AS (SELECT d, p, any_value(q) AS q, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM up GROUP BY d, p),
kids AS (SELECT d - 1 AS d, q AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),
below AS (SELECT pre.d, pre.p, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((n_convs - 1) * node.n) AS saved_tokens
  FROM node JOIN pre ON pre.conv_id = node.conv_id AND pre.d <= node.d LEFT JOIN kids ON kids.d = node.d AND kids.p = node.p GROUP BY 1, 2)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN below USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN node parent ON parent.d = node.d - 1 AND parent.p = node.q"""
