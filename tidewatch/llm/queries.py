"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import byte_bpe, conversation, hard_negative, html_extract, language_id, license_scan, line_dedup, media, near_dup, packing, quality, token_counts, url_filter
from tidewatch.llm.common import table


#: Production parameters: the vocabulary files, and the tokens a document may have.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKEN_LIMIT = 2048


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_VOCABULARY, TOKEN_LIMIT)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_VOCABULARY)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the tables give no day of fetch, so it follows from page_id."""
    return table(spark, sf_dir, "pages", "page_id", "url").withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(730)).cast("int")))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the captures: hosts are listed, delisted and listed again, their
    parent domains are listed for two months, and their first path segments are allowed for a year."""
    day = F.lit("2023-06-01").cast("date")
    hosts = pages.select(url_filter.url_host(F.col("url")).alias("h"), F.split_part(url_filter.url_path(F.col("url")), F.lit("/"), F.lit(2)).alias("seg")).where("h is not null").distinct()
    n = F.ascii("h") + 3 * F.length("h")
    own = hosts.select("h").distinct()
    parts = [
        own.select(F.col("h").alias("pattern"), F.date_add(day, n.cast("int") + shift).alias("entry_date"), F.lit(verdict).alias("verdict"))
        for shift, verdict in ((0, "block"), (150, "none"), (300, "block"), (520, "none"))
    ]
    parent = own.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct()
    length = F.length("pattern")
    parts += [parent.select("pattern", F.date_add(day, shift + 7 * length).alias("entry_date"), F.lit(verdict).alias("verdict")) for shift, verdict in ((400, "block"), (460, "none"))]
    paths = hosts.where("seg <> ''").select(F.concat("h", F.lit("/"), "seg", F.lit("/")).alias("pattern")).distinct()
    parts += [paths.select("pattern", F.date_add(day, shift + 2 * length).alias("entry_date"), F.lit(verdict).alias("verdict")) for shift, verdict in ((230, "allow"), (595, "none"))]
    entries = parts[0]
    for part in parts[1:]:
        entries = entries.unionByName(part)
    return entries


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = captures(spark, sf_dir)
    judged = url_filter.judge(pages, list_entries(pages))
    return judged.withColumn("fetched_on", F.col("fetched_on").cast("string")).withColumn("list_since", F.col("list_since").cast("string"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = media.media(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "media_width", "media_height", "media_bits", "digest", "shard", "offset", "length"
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negative.hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.damage_and_repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def queries():
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_minhash_near_dedup": op4_minhash_near_dedup,
        "op5_html_extraction": op5_html_extraction,
        "op7_url_filters": op7_url_filters,
        "op6_media_columns": op6_media_columns,
        "op8_license_scans": op8_license_scans,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_quality_rules": op10_quality_rules,
        "op11_language_id": op11_language_id,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_conversation_repair": op13_conversation_repair,
    }


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.last_doc AS gone
  FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


OP7_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(((page_id % 730) + 730) % 730 AS INTEGER) AS fetched_on,
    nullif(rtrim(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '.'), '') AS host,
    regexp_extract(url, '^[^/?#]*//[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), hosts AS (SELECT DISTINCT host AS h, split_part(path, '/', 2) AS seg FROM captures WHERE host IS NOT NULL),
own AS (SELECT DISTINCT h FROM hosts),
parent AS (SELECT DISTINCT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS pattern FROM own WHERE regexp_extract(h, '([^.]+\.[^.]+)$', 1) <> ''),
paths AS (SELECT DISTINCT h || '/' || seg || '/' AS pattern FROM hosts WHERE seg <> ''),
entries AS (
  SELECT h AS pattern, DATE '2023-06-01' + CAST(ascii(h) + 3 * length(h) + shift AS INTEGER) AS entry_date, verdict
  FROM own, (VALUES (0, 'block'), (150, 'none'), (300, 'block'), (520, 'none')) v(shift, verdict)
  UNION ALL
  SELECT pattern, DATE '2023-06-01' + CAST(shift + 7 * length(pattern) AS INTEGER), verdict
  FROM parent, (VALUES (400, 'block'), (460, 'none')) v(shift, verdict)
  UNION ALL
  SELECT pattern, DATE '2023-06-01' + CAST(shift + 2 * length(pattern) AS INTEGER), verdict
  FROM paths, (VALUES (230, 'allow'), (595, 'none')) v(shift, verdict)
), patterns AS (SELECT DISTINCT pattern FROM entries),
keyed AS (
  SELECT c.*, p.pattern FROM captures c JOIN patterns p
  ON c.host = p.pattern OR c.host LIKE '%.' || p.pattern OR (contains(p.pattern, '/') AND starts_with(c.host || c.path, p.pattern))
), held AS (
  SELECT k.page_id, k.url, k.fetched_on, k.pattern, e.verdict, e.entry_date
  FROM keyed k ASOF JOIN entries e ON k.pattern = e.pattern AND k.fetched_on >= e.entry_date
), best AS (
  SELECT * FROM held WHERE verdict <> 'none'
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(pattern) DESC, pattern DESC) = 1
)
SELECT c.page_id, c.url, CAST(c.fetched_on AS VARCHAR) AS fetched_on, c.host, coalesce(b.verdict, 'none') = 'block' AS blocked,
  b.pattern AS list_pattern, b.verdict AS list_verdict, CAST(b.entry_date AS VARCHAR) AS list_since
FROM captures c LEFT JOIN best b ON c.page_id = b.page_id AND c.url = b.url
"""

#: Length of the text as in the contract; words, windows and lines by DuckDB's list functions.
OP10_BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5)
), rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, generate_series(0, 4) s(k) GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
    - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words
FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id
"""


def _op10_sql() -> str:
    """The base figures and the distances of op10 in SQL, from the same reference tables."""
    q = quality
    text = "coalesce(text, '')"

    def term(p: str, r: float) -> str:
        m = f"(({p} + {r}) / 2)"
        return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + {r} * log2({r} / {m}))"

    def distance(shares: list[str], refs: list[float]) -> str:
        return "sqrt(greatest((" + " + ".join(term(p, r) for p, r in zip(shares, refs, strict=True)) + ") / 2, 0))"

    classes = [f"length({text}) - length(regexp_replace({text}, '{c.replace(chr(39), chr(39) * 2)}', '', 'g'))" for c in q.CHAR_CLASSES]
    n = "greatest(b.word_chars, 1)"
    shares = [f"(c{i}::DOUBLE / {n})" for i in range(len(classes))]
    shares.append(f"greatest(0, ({n} - {' - '.join(f'c{i}' for i in range(len(classes)))})::DOUBLE / {n})")
    words = [f"len(list_filter(u.pieces, lambda x: x = '{w}'))" for w in q.WORD_LIST]
    total = "greatest(v.n_pieces, 1)"
    lower = f"lower(replace({text}, chr(304), 'i' || chr(775)))"  # the one letter whose lower case has two characters
    pieces = f"list_filter(string_split_regex({lower}, '[\\x20\\x09-\\x0D{q.MARKS.replace(chr(39), chr(39) * 2)}]+'), lambda x: x <> '')"
    usual = []
    for ref in q.COMMON_WORDS.values():
        seen = [f"(w{q.WORD_LIST.index(w)}::DOUBLE / {total})" for w in ref]
        usual.append(distance([*seen, f"greatest(0, 1 - ({' + '.join(seen)}))"], [*ref.values(), 1 - sum(ref.values())]))
    char = [distance(shares, list(r)) for r in q.CHAR_REFERENCES.values()]
    return f"""
WITH b AS ({OP10_BASE_SQL}),
u AS (SELECT doc_id, {pieces} AS pieces, {', '.join(f'{c} AS c{i}' for i, c in enumerate(classes))} FROM documents),
v AS (SELECT u.*, len(pieces) AS n_pieces, {', '.join(f'{w} AS w{i}' for i, w in enumerate(words))} FROM u),
d AS (SELECT b.*, round(least({', '.join(char)}), 6) AS class_distance, round(least({', '.join(usual)}), 6) AS common_distance FROM b JOIN v ON b.doc_id = v.doc_id),
f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_SHARE} * n_words AS base_failed FROM d)
SELECT *, NOT (base_failed OR (word_chars >= {q.MIN_CHARS_FOR_CLASSES} AND class_distance > {q.MAX_CLASS_DISTANCE})
  OR (n_words >= {q.MIN_WORDS_FOR_COMMON} AND common_distance > {q.MAX_COMMON_DISTANCE})) AS kept FROM f
"""


OP12_SQL = r"""
WITH fit AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS score
  FROM fit a JOIN fit b ON a.vec_id % 50 = 0 AND a.r <> b.r
), positives AS (
  SELECT ar, anchor_id, id AS positive_id, CAST(score AS BIGINT) AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS place
  FROM pairs WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.place ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  n.id AS negative_id, p.positive_score, CAST(n.score AS BIGINT) AS negative_score
FROM positives p JOIN pairs n ON p.ar = n.ar AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


def _op13_sql() -> str:
    """Damage, faults and the cheapest repair as a recursive query over four states: start (S), after s (P), after u (U), after a (A)."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(str(c))
    half = lambda x: f"xor({x} >> 4, ([{', '.join(table)}])[CAST({x} & 15 AS INTEGER) + 1])"
    crc = f"xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda c, b: {half(half('xor(c, b)'))}, 4294967295), 4294967295)"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), drawn AS (SELECT *, {crc} % 20 AS d FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM drawn, (VALUES (1), (2)) v(copy) WHERE d <> 0 AND (copy = 1 OR d = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed
), judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS neighbours
  FROM seen
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (neighbours NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), inserted(state, after, added, letters, words) AS (VALUES
  ('S', 'S', 0, '', NULL), ('S', 'U', 3, 'I', 'user:'), ('S', 'A', 6, 'II', 'user:' || chr(10) || 'assistant:'),
  ('P', 'P', 0, '', NULL), ('P', 'U', 3, 'I', 'user:'), ('P', 'A', 6, 'II', 'user:' || chr(10) || 'assistant:'),
  ('A', 'A', 0, '', NULL), ('A', 'U', 3, 'I', 'user:'), ('A', 'A', 6, 'II', 'user:' || chr(10) || 'assistant:'),
  ('U', 'U', 0, '', NULL), ('U', 'A', 3, 'I', 'assistant:'), ('U', 'U', 6, 'II', 'assistant:' || chr(10) || 'user:')
), read(letter, state, initial, after, price, role) AS (VALUES
  ('D', 'S', NULL, 'S', 4, NULL), ('D', 'P', NULL, 'P', 4, NULL), ('D', 'U', NULL, 'U', 4, NULL), ('D', 'A', NULL, 'A', 4, NULL),
  ('K', 'S', 's', 'P', 0, NULL), ('K', 'S', 'u', 'U', 0, NULL), ('K', 'P', 'u', 'U', 0, NULL), ('K', 'A', 'u', 'U', 0, NULL), ('K', 'U', 'a', 'A', 0, NULL),
  ('R', 'S', NULL, 'U', 3, 'user'), ('R', 'P', NULL, 'U', 3, 'user'), ('R', 'A', NULL, 'U', 3, 'user'), ('R', 'U', NULL, 'A', 3, 'assistant')
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 'S' AS state, 0 AS cost, '' AS audit, CAST(NULL AS VARCHAR) AS said FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i + 1, r.after, w.cost + n.added + r.price + CASE WHEN r.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END,
    w.audit || n.letters || r.letter,
    nullif(concat_ws(chr(10), w.said, n.words, CASE WHEN r.letter <> 'D' THEN coalesce(r.role, j.role) || ':' || j.text END), '')
  FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1
  JOIN inserted n ON n.state = w.state JOIN read r ON r.state = n.after
  WHERE (r.letter = 'D' OR j.fault NOT IN ('blank', 'duplicate')) AND (r.letter <> 'K' OR r.initial = left(j.role, 1)) AND (r.letter <> 'R' OR r.role <> j.role)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, r.after ORDER BY w.cost + n.added + r.price + CASE WHEN r.letter <> 'D' AND j.fault = 'truncated' THEN 3 ELSE 0 END, w.audit || n.letters || r.letter) = 1
), ended AS (
  SELECT w.conv_id, w.cost + n.added AS cost, w.audit || n.letters AS audit, concat_ws(chr(10), w.said, n.words) AS said
  FROM walk w LEFT JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id JOIN inserted n ON n.state = w.state
  WHERE w.i = coalesce(c.n, 0) AND n.after IN ('S', 'A')
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + n.added, w.audit || n.letters) = 1
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(said) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op7_url_filters": OP7_SQL, "op10_quality_rules": _op10_sql(), "op12_hard_negatives": OP12_SQL, "op13_conversation_repair": _op13_sql()}
