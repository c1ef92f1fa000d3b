"""One thin query for each operator of this subpackage, with production parameters, over whole tables; SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), size=4096, segments=256, end_id=2)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), run=3, words=50)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.substring_dedup import passages

    return passages(table(spark, sf_dir, "documents"), least_words=50, words=5, percent=80)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), rate=0.5, rounds=12)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    held = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs, most=400, train=lambda c: ~held(c))
    return identify(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), top=20, every=20)


def op9_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.importance import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20, orders=1, buckets=10000)


def op13_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from morphlake.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH r AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, bare, len(regexp_extract_all(bare, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, pos, line, trim(line, E' \t\r') AS bare
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents))),
w AS (
  SELECT doc_id, pos, 1 AS n, bare AS lines FROM l WHERE words >= 50
  UNION ALL
  SELECT doc_id, pos, 2 AS n, lines FROM (SELECT doc_id, pos, words + lead(words) OVER o AS words, bare || E'\n' || lead(bare) OVER o AS lines FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE words >= 50
  UNION ALL
  SELECT doc_id, pos, 3 AS n, bare || E'\n' || lead(bare, 1) OVER o || E'\n' || lead(bare, 2) OVER o AS lines FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT doc_id, pos, n FROM (SELECT doc_id, pos, n, row_number() OVER (PARTITION BY n, lines ORDER BY doc_id, pos) AS k FROM w WHERE lines IS NOT NULL) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + unnest(range(n)) AS pos FROM later)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted,
       sha256(coalesce(string_agg(l.line, E'\n' ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY l.doc_id
"""


def _mixing_sql(rate: float, rounds: int) -> str:
    """The same steps over the same cells, one common table expression for each."""
    powers = {"source": 0.5, "lang": 0.5, "topic": 0.75}
    count = lambda pattern: f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"
    parts = [
        f"""d AS (SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang,
          {count(r"[^\x20\x09-\x0D]+")} AS n_tokens, {count(chr(92) + "n")} + 1 AS n_lines, {count("[|]")} AS bars FROM documents)""",
        """r AS (SELECT *, CASE WHEN bars >= 2 * n_lines THEN 'table' WHEN n_lines >= 8 AND n_tokens < 12 * n_lines THEN 'notes'
          WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM d)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM r GROUP BY ALL)",
    ]
    parts += [f"s_{d} AS (SELECT {d}, pow(sum(t), {p}) / sum(pow(sum(t), {p})) OVER () AS share FROM c WHERE t > 0 GROUP BY {d})" for d, p in powers.items()]
    parts.append("x0 AS (SELECT c.*, s_source.share AS a_source, s_lang.share AS a_lang, s_topic.share AS a_topic, 1.0::DOUBLE AS w FROM c JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic) WHERE t > 0)")
    k = 0
    for _ in range(rounds):
        for d in powers:
            parts.append(f"x{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * a_{d} / sum(t * w) OVER (PARTITION BY {d}) AS w) FROM x{k})")
            k += 1
    parts.append(f"f AS (SELECT r.doc_id, r.source, r.lang, r.topic, r.n_tokens, round(coalesce(w * (SELECT sum(t) FROM c), 0), 6) AS weight FROM r LEFT JOIN x{k} USING (source, lang, topic))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, source, lang, topic, n_tokens, weight,
       (floor(weight * {rate}) + CASE WHEN ('0x' || substr(md5('mix' || doc_id), 1, 8))::BIGINT / 4294967296.0 < weight * {rate} - floor(weight * {rate}) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM f"""


OP11_SQL = r"""
WITH p AS (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
w AS MATERIALIZED (SELECT lang, words FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p) WHERE len(words) > 0),
g AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 6) t(m) WHERE len(words) >= m)
  GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM g WHERE f >= 100),
c AS (SELECT lang, m, phrase, f AS a, k, array_to_string(x[1:k], ' ') AS first, array_to_string(x[k + 1:], ' ') AS rest FROM (SELECT *, string_split(phrase, ' ') AS x FROM h WHERE m > 1), range(1, 5) t(k) WHERE k < m),
s AS (SELECT c.lang, c.phrase, c.m, c.a, c.k, a.f AS l, b.f AS r, n.n, ((1000::HUGEINT * c.a * n.n) // (a.f::HUGEINT * b.f))::BIGINT AS score
  FROM c JOIN h a ON a.lang = c.lang AND a.phrase = c.first JOIN h b ON b.lang = c.lang AND b.phrase = c.rest JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, array_to_string(x[i:i + q - 1], ' ') AS phrase, max(f) AS f FROM (SELECT *, string_split(phrase, ' ') AS x FROM h WHERE m > 2), range(1, 5) t(i), range(2, 5) u(q) WHERE q < m AND i + q - 1 <= m GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase WHERE longer.f IS NULL OR 100 * longer.f < 100 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) WHERE rank <= 2000
"""

#: Word counts by distinct word; the checksum goes through its bytes with the table of remainders of the fixed polynomial 0xEDB88320.
OP12_SQL = r"""
WITH RECURSIVE g AS (SELECT i, i::BIGINT AS r, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM g WHERE k < 8),
rest AS (SELECT list(r ORDER BY i) AS t FROM g WHERE k = 8),
w AS (
  SELECT 'd' AS side, row, word, count(*) AS c FROM (SELECT doc_id AS row, unnest(regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents)) GROUP BY ALL
  UNION ALL
  SELECT 'b', 0, word, count(*) FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL),
x AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295) % 10000 AS bucket FROM x, rest),
c AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(c) FILTER (WHERE side = 'b'), 0) AS t FROM w JOIN b USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
f AS (SELECT row AS doc_id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM w JOIN b USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
z AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN f USING (doc_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS m FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * m // 100 THEN k END AS rank FROM y
"""

QUERIES = {
    "op1_pack_sequences": op1_pack_sequences,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_language_id": op7_language_id,
    "op8_nearest": op8_nearest,
    "op9_find_pii": op9_find_pii,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_collocations": op11_collocations,
    "op12_importance_resample": op12_importance_resample,
    "op13_find_secrets": op13_find_secrets,
}
ORACLES = {
    "op2_line_dedup": OP2_SQL,
    "op6_mixing": _mixing_sql(0.5, 12),
    "op3_exact_dedup": OP3_SQL,
    "op11_collocations": OP11_SQL,
    "op12_importance_resample": OP12_SQL,
}
