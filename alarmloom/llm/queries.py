"""Queries of the text operators over whole tables, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alarmloom.llm import audit, collocations, curriculum, decontaminate, html, jaccard, lattice, pieces, pii, quality, secrets, suffixes, superkmers

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a similarity of 0.9 or more."""
    return jaccard.join(table(spark, sf_dir, "documents"), size=3, part=90, whole=100)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 400-byte strings that also start elsewhere."""
    return suffixes.deduplicate(table(spark, sf_dir, "documents"), depth=400).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that lie in a window of the benchmark."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op4_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and lattice scores of documents."""
    return lattice.score(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces of every document and of the text decoded from them."""
    return pieces.decode(pieces.encode(table(spark, sf_dir, "documents"))).drop("text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and the perplexity verdict of documents."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that an earlier document has."""
    return superkmers.deduplicate(table(spark, sf_dir, "documents"), window=13).drop("text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, per source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of sources takes from every document, in training order."""
    return curriculum.by_position(curriculum.mix(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_lattice_scores": op4_lattice_scores,
    "op5_pii": op5_pii,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_secrets": op7_secrets,
    "op8_html": op8_html,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_mix": op12_source_mix,
    "op13_collocations": op13_collocations,
}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
ITEM_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_jaccard_join": f"""WITH RECURSIVE
w AS MATERIALIZED (SELECT doc_id, {WORDS.format(LOWER.format("text"))} AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, CAST(greatest(len(words) - 1, 2) AS BIGINT))) AS i FROM w WHERE len(words) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op3_decontamination": f"""WITH
w AS MATERIALIZED (SELECT doc_id, {ITEM_WORDS.format(LOWER.format("text"))} AS words FROM documents),
items AS (SELECT item_id, {ITEM_WORDS.format(LOWER.format("text"))} AS words FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT *, least(10, len(words)) AS size, unnest(range(1, CAST(greatest(len(words) - 8, 2) AS BIGINT))) AS i
        FROM items WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT w.*, size, unnest(range(1, CAST(greatest(len(words) - size + 2, 1) AS BIGINT))) AS i FROM w, sizes)
),
found AS MATERIALIZED (SELECT doc_id, size, i, item_id FROM places JOIN windows USING (size, phrase)),
hits AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + size AS BIGINT))) AS word FROM found) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op10_substring_dedup": f"""WITH
w AS MATERIALIZED (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
places AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, CAST(greatest(len(words) - 11, 1) AS BIGINT))) AS i FROM w)
),
firsts AS (SELECT phrase, min(doc_id) AS least FROM places GROUP BY phrase),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + 13 AS BIGINT))) AS place
  FROM places JOIN firsts USING (phrase) WHERE least < doc_id
),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS left_over
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, CAST(len(words) + 1 AS BIGINT))) AS place FROM w)
  ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(left_over, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_filter_audit": f"""WITH
w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS.format("text")} AS words FROM documents),
least AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY ALL),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS MATERIALIZED (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
  FROM w JOIN least USING (text) LEFT JOIN l USING (doc_id)
),
g AS MATERIALIZED (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM one a JOIN one b ON b.x <> a.x JOIN one c ON c.x NOT IN (a.x, b.x)
  JOIN one d ON d.x NOT IN (a.x, b.x, c.x) JOIN one e ON e.x NOT IN (a.x, b.x, c.x, d.x)
),
steps AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step:step] AS letter, filter_order[1:step - 1] AS before
          FROM orders, range(1, 6) r(step)),
s AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (NOT contains(failed, letter) AND translate(failed, before, '') = failed), 0) AS kept,
    coalesce(sum(n) FILTER (contains(failed, letter) AND translate(failed, before, '') = failed), 0) AS removed,
    coalesce(sum(n) FILTER (contains(failed, letter) AND translate(failed, before, '') <> failed), 0) AS redundant,
    coalesce(sum(n) FILTER (failed = letter), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(failed, letter) AND translate(failed, before, '') = failed), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(failed, letter) AND translate(failed, before, '') = failed), 0) AS toxic_lost
  FROM g, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s""",
    "op12_source_mix": f"""WITH
d AS MATERIALIZED (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((place - 1) % 3 + 1 AS INT)] AS weight, 2 * source_size AS most FROM s),
r AS (
  SELECT *, coalesce(sum(most) OVER o, 0) AS stopped, coalesce(sum(weight) OVER o, 0) AS used, row_number() OVER (ORDER BY most / weight, place) AS turn
  FROM w WINDOW o AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
v AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM w) - stopped) / ((SELECT sum(weight) FROM w) - used) AS level FROM r),
t AS (SELECT source, source_size, least(most::DOUBLE, weight * (SELECT arg_min(level, turn) FROM v WHERE level * weight <= most)) AS target FROM w),
p AS (
  SELECT doc_id, size, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (CAST(middle <= target AS INT) + CAST(middle + source_size <= target AS INT)) AS BIGINT) AS taken FROM p""",
    "op13_collocations": rf"""WITH
pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
total AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang),
places AS (
  SELECT lang, words, size, unnest(range(1, CAST(len(words) - size + 2 AS BIGINT))) AS i
  FROM w, range(1, 6) r(size) WHERE len(words) >= size
),
f AS MATERIALIZED (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f
  FROM places GROUP BY ALL HAVING count(*) >= 100
),
c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
cuts AS (
  SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, CAST(size AS BIGINT))) AS k FROM c) c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(words[k + 1:], ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_places AS (SELECT lang, words, a, s, unnest(range(1, CAST(size - s + 2 AS BIGINT))) AS i FROM c, range(2, 5) r(s) WHERE s < size),
inside AS (SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM inner_places GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000""",
}
