"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP2 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((place - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
      row_number() OVER (ORDER BY cap / weight, place) AS nth FROM w),
f AS (SELECT arg_min(level, nth) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, round(coalesce(least(cap, f.level * weight), cap), 6) AS target FROM l LEFT JOIN f ON true),
o AS (SELECT d.doc_id, d.size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
      sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size DESC ROWS UNBOUNDED PRECEDING) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - start, size)))::BIGINT AS taken FROM o
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS flat FROM documents),
w AS (SELECT *, CASE WHEN flat = '' THEN [] ELSE string_split(flat, ' ') END AS words, list_filter(string_split(raw, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY 1),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, (length(flat) - greatest(len(words) - 1, 0))::BIGINT AS word_chars, length(regexp_replace(raw, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
      length(flat) - length(regexp_replace(flat, '\p{L}+', '', 'g')) AS letters, length(flat) - length(regexp_replace(flat, '\p{Lu}+', '', 'g')) AS uppers,
      (length(flat) - length(replace(replace(replace(replace(replace(replace(replace(flat, '###', ''), '***', ''), '$$$', ''), '%%%', ''), '&&&', ''), '<<<', ''), '>>>', ''))) // 3 AS signs,
      (length(flat) - length(replace(flat, '!!', ''))) // 2 AS shouts, (length(flat) - length(replace(flat, ' | ', ''))) // 3 AS pipes,
      len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutter
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, ((n_words < 20)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 30)::BIGINT + 4 * (n_symbols * 10 > word_chars)::BIGINT + 8 * (n_dup_lines * 10 > n_lines * 3)::BIGINT
      + 16 * (word_chars > n_words * 20)::BIGINT + 32 * (word_chars < n_words * 2)::BIGINT + 64 * (letters * 10 < word_chars * 6)::BIGINT + 128 * (uppers * 2 > letters)::BIGINT
      + 256 * (signs * 5 > n_words)::BIGINT + 512 * (shouts * 5 > n_words)::BIGINT + 1024 * (pipes * 5 > n_words)::BIGINT + 2048 * (stutter * 3 > n_words)::BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 4039) = 0 AS kept, failures, 1::INT AS policy_version FROM b
"""

_ROUND = """
a{r} AS MATERIALIZED (SELECT vec_id, part, entry, sum((x.val - c.val) * (x.val - c.val))::BIGINT AS dist FROM x JOIN c{r} c USING (part, pos) GROUP BY vec_id, part, entry
       QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1),
c{n} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.val, c.val) AS val FROM c{r} c LEFT JOIN
       (SELECT part, a.entry, pos, floor(sum(val) / count(*))::BIGINT AS val FROM x JOIN a{r} a USING (vec_id, part) GROUP BY part, a.entry, pos) m USING (part, entry, pos)),"""

OP11 = """
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor(4096 * x)::BIGINT) AS v FROM embeddings
     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT vec_id, i // (len(v) // 8) AS part, i % (len(v) // 8) AS pos, v[i + 1] AS val FROM k, unnest(range(len(v))) AS u(i)),
c0 AS MATERIALIZED (SELECT part, entry, pos, val FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < 16) USING (vec_id)),""" + "".join(
    _ROUND.format(r=r, n=r + 1) for r in range(7)) + """
f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a6 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c6) AS codebooks_sha256
FROM f JOIN k USING (vec_id)
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, substr(t, 1, least(a, b)) AS x, substr(t, least(a, b) + 1, abs(a - b)) AS y, substr(t, greatest(a, b) + 1) AS z FROM u)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM c
"""

#: The rules of both policies as bits, and the policies as sums of them, over the rows of OP8.
ABLATIONS = f"""WITH judged AS ({OP8}),
rules(rule, bit, v1, v2) AS (VALUES ('few_words', 1, true, true), ('repeated_windows', 2, true, true), ('many_symbols', 4, true, true), ('dup_lines', 8, false, true),
  ('long_words', 16, false, true), ('short_words', 32, false, true), ('few_letters', 64, true, true), ('shouting', 128, true, false),
  ('symbol_words', 256, true, false), ('exclaimed', 512, true, false), ('piped', 1024, true, false), ('stutter', 2048, true, false)),
used AS (SELECT 1 AS policy_version, rule, bit FROM rules WHERE v1 UNION ALL SELECT 2, rule, bit FROM rules WHERE v2),
masks AS (SELECT policy_version, sum(bit)::BIGINT AS mask FROM used GROUP BY policy_version)
SELECT policy_version, rule, count(*) FILTER (failures & bit <> 0) AS failing, count(*) FILTER (failures & mask = bit) AS failing_alone,
  count(*) FILTER (failures & (mask - bit) = 0) AS kept_without
FROM used JOIN masks USING (policy_version), judged GROUP BY policy_version, rule"""

ORACLES = {"op1_maxscore_top_k": OP1, "op2_mix_sources": OP2, "op8_quality_ledger": OP8, "quality_ablations": ABLATIONS, "op11_va_file_codes": OP11, "op13_fill_in_middle": OP13}
