"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.alignment import align_tokens
from quillon.llm.embeddings import near_duplicate_vectors, top_k
from quillon.llm.jaccard import jaccard_components
from quillon.llm.language import identify_languages
from quillon.llm.licenses import THRESHOLD, Index, scan_licenses, templates
from quillon.llm.mixing import mix_sources
from quillon.llm.packing import pack_documents
from quillon.llm.secrets import RULES, scan_secrets
from quillon.llm.sharding import shard_documents
from quillon.llm.spelling import spelling_variants
from quillon.llm.substrings import dedup_substrings
from quillon.llm.token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_ngram_jaccard, op3_license_scan, op4_language_id, op5_mix_sources, op6_secret_scan, op7_exact_top_k, op8_token_counts, op9_embedding_near_dedup, op10_sharding, op11_substring_dedup, op12_spelling_variants, op13_token_alignment)}


_WORD = r"'[^\x20\x09-\x0D]+'"



def _level_sql(k: int) -> str:
    """A level's rate, and where the next one begins."""
    return f"""
, q{k} AS (
  SELECT p.*, CASE WHEN w.words > 0 THEN greatest(0.0::DOUBLE, least(rest / w.words, 3.0::DOUBLE)) ELSE 0.0::DOUBLE END AS rate
  FROM p{k} p JOIN (SELECT t.source, coalesce(sum(n.words), 0)::BIGINT AS words FROM t LEFT JOIN n ON t.source IS NOT DISTINCT FROM n.source AND n.level >= {k} GROUP BY 1) w ON p.source IS NOT DISTINCT FROM w.source
), p{k + 1} AS (
  SELECT q.source, rest - coalesce(g.got, 0) AS rest, place + coalesce(g.docs, 0) * rate AS place, before + coalesce(g.docs, 0) AS before
  FROM q{k} q LEFT JOIN (
    SELECT r.source, count(*) AS docs, sum(least(3, floor(place + (rank - before) * rate + rate) - floor(place + (rank - before) * rate))::BIGINT * size)::BIGINT AS got
    FROM r JOIN q{k} q ON r.source IS NOT DISTINCT FROM q.source WHERE r.level = {k} GROUP BY 1) g ON q.source IS NOT DISTINCT FROM g.source
)"""


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), v AS (
  SELECT *, 3 * source_size AS cap, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight FROM s
), f AS (
  SELECT *, row_number() OVER o AS k,
    ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
      / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) AS level
  FROM v WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size,
    least(cap::DOUBLE, coalesce((SELECT arg_min(level, k) FROM f WHERE level * weight < cap), 0.0) * weight) AS target,
    ('0x' || left(md5('mix:' || coalesce('s:' || source, 'null')), 8))::BIGINT / 4294967296.0::DOUBLE AS shift
  FROM f
), r AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN d.size * 4 > t.target THEN 0 WHEN d.size * 16 > t.target THEN 1 WHEN d.size * 64 > t.target THEN 2 WHEN d.size * 256 > t.target THEN 3 ELSE 4 END AS level,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, left(md5(d.doc_id::VARCHAR), 16) NULLS FIRST, d.doc_id) - 1 AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT source, level, count(*) AS docs, sum(size)::BIGINT AS words FROM r GROUP BY ALL
), p0 AS (
  SELECT source, target AS rest, shift AS place, 0::BIGINT AS before FROM t
){"".join(_level_sql(k) for k in range(5))}
SELECT r.doc_id, r.size, r.source_size, r.target, least(3, floor(place + (rank - before) * rate + rate) - floor(place + (rank - before) * rate))::BIGINT * size AS taken
FROM r JOIN (SELECT *, 0 AS k FROM q0 UNION ALL SELECT *, 1 FROM q1 UNION ALL SELECT *, 2 FROM q2 UNION ALL SELECT *, 3 FROM q3 UNION ALL SELECT *, 4 FROM q4) q
ON r.source IS NOT DISTINCT FROM q.source AND r.level = q.k
"""

#: The generator's products need 128 bits, which HUGEINT has.
OP10_SQL = r"""
WITH RECURSIVE jump AS (
  SELECT doc_id, (CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END)::UHUGEINT AS k,
    0::BIGINT AS j, 0::BIGINT AS s24, 0::BIGINT AS s25
  FROM (SELECT DISTINCT doc_id FROM documents)
  UNION ALL
  SELECT doc_id, k2, jump, CASE WHEN jump < 24 THEN jump ELSE s24 END, CASE WHEN jump < 25 THEN jump ELSE s25 END
  FROM (
    SELECT *, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT AS jump
    FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k2 FROM jump WHERE j < 25)
  )
), s AS (
  SELECT doc_id, max(s24)::INT AS shard, max(s25)::INT AS grown_shard FROM jump GROUP BY doc_id
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b)
  )
), d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table
)
SELECT d.doc_id, d.size::BIGINT AS size, d.text_crc32::BIGINT AS text_crc32, 'key' AS law, s.shard,
  row_number() OVER (PARTITION BY s.shard ORDER BY d.doc_id NULLS FIRST, d.text_crc32) - 1 AS slot, s.grown_shard
FROM d JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id
"""


OP7_SQL = r"""
WITH e AS (
  SELECT row_number() OVER () AS "row", vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q."row", q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q."row" <> c."row" AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op3_sql() -> str:
    """Every window that an anchor points at, from joins of bigrams with their places."""
    index = Index(templates(), THRESHOLD)
    quoted = lambda x: "'" + "|".join(x) + "'"
    rows = ", ".join(f"({k}, '{name}', {len(seq)}, string_split({quoted(own)}, '|'))" for k, (name, seq, own) in enumerate(zip(index.names, index.lists, index.sets, strict=True)))
    anchors = ", ".join(f"('{g}', {k}, {o})" for g, places in index.anchors.items() for k, o in places)
    return rf"""
WITH t(k, license, n, bigrams) AS (VALUES {rows}), anchor(gram, k, place) AS (VALUES {anchors}), w AS (
  SELECT row_number() OVER () AS "row", doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT "row", doc_id, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS grams FROM w WHERE len(words) > 1
), h AS (
  SELECT "row", unnest(grams) AS gram, unnest(range(len(grams))) AS i FROM g
), s AS (
  SELECT DISTINCT "row", k, i - place AS start FROM h JOIN anchor USING (gram)
), m AS (
  SELECT "row", doc_id, k, license, bigrams, greatest(start, 0) AS first_word, least(start + n, len(grams)) AS stop, list_distinct(grams[greatest(start, 0) + 1:least(start + n, len(grams))]) AS own
  FROM s JOIN g USING ("row") JOIN t USING (k)
), d AS (
  SELECT *, 2.0::DOUBLE * shared / (len(own) + len(bigrams)) AS dice FROM (SELECT *, len(list_intersect(own, bigrams)) AS shared FROM m)
), c AS (
  SELECT *, shared * dice AS strength, (first_word + stop) // 2 AS middle FROM d WHERE dice >= 0.8
), e AS (
  SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE x."row" = y."row" AND x.license = y.license AND y.first_word <= x.middle AND x.middle < y.stop
    AND (y.strength > x.strength OR y.strength = x.strength AND (y.k < x.k OR y.k = x.k AND y.first_word < x.first_word)))
), l AS (
  SELECT x."row", x.doc_id, x.k, x.first_word, x.stop, x.license, arg_max(y.license, (y.strength, -y.k, -y.first_word)) AS winner FROM e x JOIN e y
  ON x."row" = y."row" AND x.license <> y.license AND y.first_word <= x.middle AND x.middle < y.stop AND (y.strength > x.strength OR y.strength = x.strength AND y.k < x.k) GROUP BY ALL
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, first_word) AS place FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l."row" = e."row" AND l.k = e.k AND l.first_word = e.first_word AND l.stop = e.stop)
), a AS (
  SELECT doc_id, winner, string_agg(DISTINCT license, ',' ORDER BY license) AS alternatives FROM l GROUP BY ALL
)
SELECT b.doc_id, license, dice, first_word::INT AS first_word, coalesce(alternatives, '') AS alternatives FROM b LEFT JOIN a ON b.doc_id IS NOT DISTINCT FROM a.doc_id AND b.license = a.winner WHERE place = 1
"""


def _op6_sql() -> str:
    """The spans of each rule from the matches and the gaps between them."""
    either = lambda p: "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in p)
    names, _, rest = RULES[0].pattern.partition(")")
    patterns = [either(names) + ")" + rest, *(r.pattern for r in RULES[1:])]
    each = []
    for i, (r, p) in enumerate(zip(RULES, patterns, strict=True)):
        p = p.replace("'", "''")
        each.append(
            f"""SELECT "row", {i} AS number, '{r.kind}' AS kind, pos AS "start", pos + length(hit) AS "end" FROM (
  SELECT "row", hits[i] AS hit, kept[i] AS part,
    (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS pos
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT "row", string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {r.group}) AS kept
    FROM d WHERE regexp_matches(t, '{p}')))
) WHERE length(part) >= {r.least}"""
        )
    base = [i for i, r in enumerate(RULES) if r.base]
    counts = ", ".join(f"count(number) FILTER (number = {i}) AS n_{RULES[i].kind}" for i in base)
    listed = """string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", number)"""
    return f"""
WITH d AS (SELECT row_number() OVER () AS "row", doc_id, coalesce(text, '') AS t FROM documents), s AS (
{" UNION ALL ".join(each)}
)
SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (number IN ({", ".join(map(str, base))})), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM d LEFT JOIN s USING ("row") GROUP BY "row", doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mix_sources": OP5_SQL, "op3_license_scan": _op3_sql(), "op6_secret_scan": _op6_sql(), "op7_exact_top_k": OP7_SQL, "op10_sharding": OP10_SQL}
