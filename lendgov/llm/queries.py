"""The registered queries of the operators and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import chat, importance, langid, lattice, line_clean, manifest, mixing, packing, pii, quality, sequence_dp, simhash, toxicity

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_chat_repair")
def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_turns(_table(spark, sf_dir, "conversations"))


#: The rules of ``line_clean`` over one line x in SQL.
_N_SPLIT = "len(regexp_extract_all(x, '[^\\s\\x0B\\x1C-\\x1F\\x85\\xA0]+'))"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, {_WORDS} AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i) WHERE len(w) >= 5),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM often, (SELECT unnest(range(5)) AS k) GROUP BY r),
l AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup_lines FROM l WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
j AS (SELECT r, x, CASE WHEN regexp_matches(x, '(?i){line_clean._BOILERPLATE.pattern}') THEN 'b'
        WHEN len(regexp_extract_all(x, '[|·•→]')) + len(regexp_extract_all(regexp_replace(x, '(\\s)', '\\1\\1', 'g'), '\\s[»›>]\\s')) > 0.3 * {_N_SPLIT} THEN 'n'
        WHEN NOT regexp_matches(x, '[.!?:;…"''”’»)\\]。！？][\\s\\x0B\\x1C-\\x1F\\x85\\xA0]*$')
          OR len(regexp_extract_all(x, '[#*$%&|<>^~{{}}=\\\\]')) > 0.5 * {_N_SPLIT} THEN 'p' END AS fault
      FROM l WHERE {_N_SPLIT} > 0),
v AS (SELECT r, count(*) FILTER (WHERE fault = 'p') AS lost_punctuation, count(*) FILTER (WHERE fault = 'n') AS lost_navigation,
        count(*) FILTER (WHERE fault = 'b') AS lost_boilerplate, coalesce(sum(length(x)) FILTER (WHERE fault IS NOT NULL), 0) AS gone, sum(length(x)) AS total
      FROM j GROUP BY r),
b AS (SELECT d.r, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dup ON d.r = dup.r LEFT JOIN rep ON d.r = rep.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(gone / total, 0.0e0) <= 0.5e0 AS kept, CAST(coalesce(lost_punctuation, 0) AS BIGINT) AS lost_punctuation,
  CAST(coalesce(lost_navigation, 0) AS BIGINT) AS lost_navigation, CAST(coalesce(lost_boilerplate, 0) AS BIGINT) AS lost_boilerplate,
  coalesce(gone / total, 0.0e0) AS lost_share
FROM f LEFT JOIN v ON f.r = v.r"""


@query("op2_line_cleaning", oracle=_OP2_SQL)
def op2_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_clean.assess(C.documents(spark, sf_dir))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(C.documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(C.documents(spark, sf_dir))


_OP8_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e
      WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
          AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.98e0),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN root ON e.vec_id = root.vec_id LEFT JOIN deg ON e.vec_id = deg.vec_id"""


@query("op8_embedding_dedup", oracle=_OP8_SQL)
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.linked(_table(spark, sf_dir, "embeddings"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(C.documents(spark, sf_dir))


@query("op6_simhash_dedup")
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(C.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(C.documents(spark, sf_dir)))


_OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 16) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM d GROUP BY 1),
-- sources in the order in which they reach three times their size, and the level at which the rest stays open
o AS (SELECT *, 3.0e0 * source_size AS cap, sum(source_size) OVER () AS total,
        coalesce(sum(3.0e0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s),
lv AS (SELECT max((total - capped) / open_weight) AS level FROM o WHERE (total - capped) / open_weight * weight <= cap),
t AS (SELECT o.source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM o CROSS JOIN lv),
b AS (SELECT *, CAST(round(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.k) AS here,
        count(*) FILTER (WHERE d.size > 0) OVER (PARTITION BY d.source, d.k) AS same,
        row_number() OVER (PARTITION BY d.source, d.k, d.size > 0) AS nth
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * epochs + CASE WHEN size = 0 THEN 0 WHEN upto <= rest THEN size WHEN upto - here >= rest THEN 0
         ELSE least(size, (rest - (upto - here)) // same + CASE WHEN nth <= (rest - (upto - here)) % same THEN 1 ELSE 0 END) END AS BIGINT) AS taken FROM r"""


@query("op5_mix_sources", oracle=_OP5_SQL)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(C.documents(spark, sf_dir))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(C.documents(spark, sf_dir)))


#: H of a value of a leaf, and of a leaf's columns, in SQL.
def _h(text: str) -> str:
    def part(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 in SQL: ``crc_table`` is one row with the list t of 256 numbers; ``_crc(x)`` is the crc32 of text x beside it.
_CRC_TABLE = """crc_bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def _crc(x: str) -> str:
    one = f"CAST(('0x' || substr(hex(encode({x})), 2 * CAST(i AS INTEGER) + 1, 2)) AS BIGINT)"
    every = f"list_transform(range(strlen({x})), lambda i: {one})"
    return f"xor(list_reduce(list_prepend(4294967295, {every}), lambda a, b: xor(a // 256, t[CAST(xor(a, b) % 256 AS INTEGER) + 1])), 4294967295)"


_LOW = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"
_OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT row_number() OVER () AS r, CASE WHEN lang IS NULL THEN '' ELSE ':' || lang END AS tree, doc_id, {_h('text')} AS leaf,
  CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_h(_LOW)} ELSE {_h('text')} END AS changed FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, lvl, pos, digest, n) AS (SELECT tree, 0, pos, leaf, n FROM placed UNION ALL
  SELECT tree, lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 8, n),
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes(lvl, pos, digest, n) AS (SELECT 0, pos, digest, n FROM subroots UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM upper_nodes WHERE n > 1 GROUP BY lvl, pos // 8, n),
root AS (SELECT digest AS root FROM upper_nodes WHERE n = 1),
up(r, tree, lvl, pos, digest) AS (SELECT r, tree, 0, pos, changed FROM placed UNION ALL
  SELECT r, u.tree, u.lvl + 1, u.pos // 8, sha256(string_agg(CASE WHEN n.pos = u.pos THEN u.digest ELSE n.digest END, '' ORDER BY n.pos))
  FROM up u JOIN nodes n ON u.tree = n.tree AND u.lvl = n.lvl AND u.pos // 8 = n.pos // 8 WHERE n.n > 1 GROUP BY r, u.tree, u.lvl, u.pos // 8),
top(r, lvl, pos, digest) AS (SELECT r, 0, s.pos, u.digest FROM up u JOIN subroots s ON u.tree = s.tree
  WHERE u.lvl = (SELECT max(lvl) FROM nodes n WHERE n.tree = u.tree) UNION ALL
  SELECT r, t.lvl + 1, t.pos // 8, sha256(string_agg(CASE WHEN n.pos = t.pos THEN t.digest ELSE n.digest END, '' ORDER BY n.pos))
  FROM top t JOIN upper_nodes n ON t.lvl = n.lvl AND t.pos // 8 = n.pos // 8 WHERE n.n > 1 GROUP BY r, t.lvl, t.pos // 8),
beside AS (SELECT u.r, 0 AS part, u.lvl, n.pos, n.digest FROM up u JOIN nodes n ON u.tree = n.tree AND u.lvl = n.lvl AND u.pos // 8 = n.pos // 8 AND u.pos <> n.pos
  UNION ALL SELECT t.r, 1, t.lvl, n.pos, n.digest FROM top t JOIN upper_nodes n ON t.lvl = n.lvl AND t.pos // 8 = n.pos // 8 AND t.pos <> n.pos),
proofs AS (SELECT r, sha256(string_agg(digest, '' ORDER BY part, lvl, pos)) AS proof FROM beside GROUP BY r),
folded AS (SELECT r, digest AS folded_root FROM top WHERE lvl = (SELECT max(lvl) FROM upper_nodes))
SELECT doc_id, leaf, s.digest AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots s ON p.tree = s.tree CROSS JOIN root JOIN folded f ON p.r = f.r LEFT JOIN proofs q ON p.r = q.r"""


@query("op11_merkle_manifest", oracle=_OP11_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(manifest.of_documents(C.documents(spark, sf_dir)).folded("changed"))


_READ = f"regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {_READ} AS w FROM documents),
own AS (SELECT r, unnest(w) AS x FROM d), aim AS (SELECT unnest({_READ}) AS x FROM benchmark),
words AS (SELECT x, {_crc('x')} % 10000 AS bucket FROM (SELECT x FROM own UNION SELECT x FROM aim), crc_table),
b AS (SELECT range AS bucket FROM range(10000)),
s AS (SELECT bucket, count(*) AS s FROM own JOIN words USING (x) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM aim JOIN words USING (x) GROUP BY 1),
st AS (SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t, (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all
  FROM b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM st),
sums AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM own JOIN words USING (x) JOIN g USING (bucket) GROUP BY r),
u AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  (CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5e0) / 4294967296e0 AS h FROM d LEFT JOIN sums ON d.r = sums.r),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(h))) AS BIGINT) AS score FROM u),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, r) AS place, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM sc LEFT JOIN o ON sc.r = o.r"""


@query("op12_importance_resampling", oracle=_OP12_SQL)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    return importance.digest(importance.scored(importance.placed(docs), _table(spark, sf_dir, "benchmark")))


@query("op13_sequence_packing")
def op13_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence_dp.digest(sequence_dp.pack(C.documents(spark, sf_dir)))
