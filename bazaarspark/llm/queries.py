"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from bazaarspark.llm.exact_dedup import exact_dedup
from bazaarspark.llm.lattice import embedding_dedup
from bazaarspark.llm.license_scan import license_scan, license_sql
from bazaarspark.llm.line_dedup import line_dedup
from bazaarspark.llm.lm_scoring import lm_score
from bazaarspark.llm.minhash import near_dedup
from bazaarspark.llm.mixing import mix
from bazaarspark.llm.multi_index import nearest
from bazaarspark.llm.packing import pack
from bazaarspark.llm.periodic_runs import periodic_runs, run_digests
from bazaarspark.llm.repair import damaged, repair_conversations
from bazaarspark.llm.span_dedup import span_dedup
from bazaarspark.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS digest
      FROM documents)
WINDOW g AS (PARTITION BY digest)
"""

def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


OP6_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:least(i + 4, len(ws))], ' ') AS sh
      FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT both_ways.b, r.c FROM r JOIN both_ways ON both_ways.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

def op1_pack_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_lattice_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP4_SQL = """
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE array_inner_product(a.x, b.x) / (sqrt(array_inner_product(a.x, a.x)) * sqrt(array_inner_product(b.x, b.x))) >= 0.95),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""


def op9_context_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP2_SQL = r"""
WITH RECURSIVE
d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
h AS (SELECT source, size, count(*) AS n FROM d GROUP BY ALL),
s AS (SELECT source, CAST(sum(size * n) AS BIGINT) AS source_size, greatest(1.0, CAST(sum(size * n) AS DOUBLE) / sum(n)) AS scale FROM h GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 3.0 * source_size / weight AS ratio, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS nth FROM w),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER b, 0) AS remains, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS share
      FROM r WINDOW b AS (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, min(CASE WHEN remains <= ratio * share THEN nth END) OVER () AS first, min_by(remains / share, CASE WHEN remains <= ratio * share THEN nth END) OVER () AS level FROM l),
t AS (SELECT source, source_size, scale, CAST(CASE WHEN nth < first THEN 3.0 * source_size ELSE least(3.0 * source_size, level * weight) END AS DOUBLE) AS target FROM f),
-- The dual's multiplier of each source, by halving a bracket: the sum of size * rate rises with it.
b AS (SELECT source, scale, target, CAST(-1e5 AS DOUBLE) AS lo, CAST(1e5 AS DOUBLE) AS hi, 0 AS step FROM t
      UNION ALL
      SELECT source, scale, target, CASE WHEN total < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN total < target THEN hi ELSE (lo + hi) / 2 END, step + 1
      FROM (SELECT b.source, any_value(b.scale) AS scale, any_value(b.target) AS target, any_value(lo) AS lo, any_value(hi) AS hi, any_value(step) AS step,
                   sum(h.n * h.size * least(3.0, exp(least((lo + hi) / 2 * h.size / b.scale, 50.0)))) AS total
            FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source WHERE step < 75 GROUP BY b.source)),
m AS (SELECT source, CASE WHEN target >= 3.0 * source_size * (1 - 1e-12) AND target > 0 THEN 1e12 WHEN target = source_size THEN 0.0 ELSE (lo + hi) / 2 END AS lam, t.scale, t.target, source_size
      FROM t JOIN (SELECT source AS o, lo, hi FROM b WHERE step = 75) ON source IS NOT DISTINCT FROM o),
g AS (SELECT d.source, k, size, count(*) AS n, any_value(target) AS target, any_value(source_size) AS source_size,
             any_value(least(3.0, exp(least(lam * size / scale, 50.0)))) AS rate
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source GROUP BY d.source, k, size),
q AS (SELECT *, CASE WHEN target > 0 THEN CAST(floor(rate + 1e-9) AS BIGINT) WHEN size > 0 THEN 0 ELSE 1 END AS whole,
             CASE WHEN rate - floor(rate + 1e-9) > 1e-9 AND target > 0 AND size > 0
                  THEN (CAST(CAST('0x' || substr(k, 1, 13) AS BIGINT) AS DOUBLE) + 1) / 4503599627370496.0 / (rate - floor(rate + 1e-9)) END AS place FROM g),
c AS (SELECT *, greatest(0, CAST(round(target) AS BIGINT) - CAST(sum(whole * size * n) OVER (PARTITION BY source) AS BIGINT)) AS more,
             CASE WHEN place IS NOT NULL THEN CAST(sum(CASE WHEN place IS NOT NULL THEN size * n ELSE 0 END) OVER (PARTITION BY source ORDER BY place NULLS LAST, k, size) AS BIGINT) END AS upto FROM q)
SELECT d.doc_id, d.size, c.source_size, c.target,
       CAST(c.whole * d.size + CASE WHEN c.place IS NULL THEN 0 WHEN c.upto <= c.more THEN d.size WHEN c.upto - c.size * c.n < c.more THEN (c.more - c.upto + c.size * c.n) // c.n ELSE 0 END AS BIGINT) AS taken
FROM d JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.k = d.k AND c.size = d.size
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damaged(_table(spark, sf_dir, "conversations"))
    return repair_conversations(rows, copies)


# Rows one by one: first what remains to be paid from each row on, from the last row back, then the edits, a letter at a time. States are 1 to 4
# (nothing yet, after s, after u, after a); the third of each list is what an inserted or reroled row makes of them.
OP11_SQL = r"""
WITH RECURSIVE
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 1, 2, 3, 4, 5, 6, 7] AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS code FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM d),
x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM w),
y AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS c, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM x),
z AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS live, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more,
        [CASE c WHEN 's' THEN 2 WHEN 'u' THEN 3 END, CASE c WHEN 'u' THEN 3 END, CASE c WHEN 'a' THEN 4 END, CASE c WHEN 'u' THEN 3 END] AS kept FROM y),
b AS (SELECT conv_id, max(i) + 1 AS i, [0, 10, 5, 0] AS v FROM z GROUP BY conv_id
      UNION ALL
      SELECT conv_id, i, [least(s[1], 5 + s[3], 10 + s[4]), least(s[2], 5 + s[3], 10 + s[4]), least(s[3], 5 + s[4]), least(s[4], 5 + s[3])]
      FROM (SELECT z.conv_id, z.i, list_transform([1, 2, 3, 4], lambda k: least(2 + v[k], CASE WHEN live THEN 1 + more + v[[3, 3, 4, 3][k]] ELSE 99999999 END, CASE WHEN live AND kept[k] IS NOT NULL THEN more + v[kept[k]] ELSE 99999999 END)) AS s
            FROM b JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.i = b.i - 1)),
p AS (SELECT b.conv_id, b.i, b.v, n.v AS after, z.role, z.text, z.live, z.more, z.kept, z.i IS NULL AS over FROM b LEFT JOIN b n ON n.conv_id IS NOT DISTINCT FROM b.conv_id AND n.i = b.i + 1 LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM b.conv_id AND z.i = b.i),
f AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM z GROUP BY conv_id
      UNION ALL
      SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept[s] ELSE [3, 3, 4, 3][s] END, audit || e,
             CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, ['user', 'user', 'assistant', 'user'][s] || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
      FROM (SELECT f.*, p.role, p.text, p.kept, CASE WHEN NOT over AND 2 + after[s] = v[s] THEN 'D' WHEN 5 + v[[3, 3, 4, 3][s]] = v[s] THEN 'I' WHEN live AND kept[s] IS NOT NULL AND more + after[kept[s]] = v[s] THEN 'K' ELSE 'R' END AS e
            FROM f JOIN p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i WHERE NOT (over AND v[s] = 0))),
r AS (SELECT f.conv_id, audit, lines FROM f JOIN p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.i = f.i WHERE over AND v[s] = 0),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM z GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(p.v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM o.conv_id AND p.i = 1
"""


def op12_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents end in a repeated stretch, as the hash of the identifier has it. Without one a text stays as it is."""
    if doc_id is None or not words:
        return words
    whole, digit = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if digit:
        return words
    n, start = len(words), whole % len(words)
    period = 1 + (n - start) // (3 + whole % 8)
    return words[:start] + (words[start : start + period] * ((n - start) // period + 1))[: n - start]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), prepare=repeated_tail))


QUERIES = {
    "op1_pack_cutting_stock": op1_pack_cutting_stock,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity_grammar": op3_toxicity_grammar,
    "op4_lattice_embedding_dedup": op4_lattice_embedding_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_context_mixing_lm": op9_context_mixing_lm,
    "op10_sentence_span_dedup": op10_sentence_span_dedup,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_inverted_multi_index": op12_inverted_multi_index,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {"op2_mix_sources": OP2_SQL, "op4_lattice_embedding_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op6_minhash_near_dedup": OP6_SQL, "op8_license_scan": license_sql(), "op11_repair_conversations": OP11_SQL, "op12_inverted_multi_index": OP12_SQL}
