"""The registered query of each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import (
    collocations,
    decontaminate,
    fill_middle,
    html_content,
    line_dedup,
    mixing,
    near_duplicates,
    quotient_filter,
    repeated_spans,
    secrets,
    sharding,
    toxicity,
    warc,
)
from wardlake.llm.ship import ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination_report(docs, items)


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))
    return classes.drop("rid")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.scores(docs, labels)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient_filter.exact_duplicates(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op9_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(_table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_spans.remove_repeats(_table(spark, sf_dir, "documents"))
    return rows.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.withColumns({
        "output_sha256": F.sha2("output", 256),
        "restored_sha256": F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256),
    }).drop("output")


_OPERATORS = (
    op1_warc, op2_decontaminate, op3_order_minhash, op4_line_dedup, op5_mixing, op6_toxicity,
    op7_exact_dedup, op8_secrets, op9_html_content, op10_sharding,
    op11_collocations, op12_repeated_spans, op13_fill_middle,
)


def _shipped(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    each.__name__: _shipped(each) for each in _OPERATORS
}


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

_WARC_SQL = """
WITH p AS (
    SELECT page_id, url, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS h FROM pages
), b AS (
    SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
        array_to_string(list_transform(string_split(h, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') AS bits
    FROM p
)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
        + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
        + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
    CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to,
    url
FROM b
"""

_DECONTAMINATE_SQL = f"""
WITH items AS (
    SELECT item_id, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS phrase
    FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0
), docs AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), found AS (
    SELECT DISTINCT d.doc_id, v.item_id, r.i, v.size
    FROM docs d, (SELECT DISTINCT size FROM windows) s, unnest(range(1, len(d.w) - s.size + 2)) AS r(i), windows v
    WHERE v.size = s.size AND v.phrase = array_to_string(d.w[r.i : r.i + s.size - 1], ' ')
), hit AS (
    SELECT doc_id, count(DISTINCT k) AS n FROM found, unnest(range(i, i + size)) AS r(k) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(DISTINCT item_id) AS n,
        array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids
    FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
    sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

_EXACT_SQL = """
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
        regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
    FROM documents
), g AS (
    SELECT *, count(*) OVER (PARTITION BY norm) AS n,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id
    FROM d
)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

_COLLOCATIONS_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), f AS (
    SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
    FROM w, unnest(range(1, 6)) AS s(size), unnest(range(1, len(w) - size + 2)) AS r(i) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE size >= 2 AND f >= 100
), inner_ones AS (
    SELECT lang, array_to_string(w[i : i + short - 1], ' ') AS phrase, max(a) AS longer
    FROM c, unnest(range(2, size)) AS s(short), unnest(range(1, size - short + 2)) AS r(i) GROUP BY ALL
), kept AS (
    SELECT c.* FROM c LEFT JOIN inner_ones USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
    SELECT kept.lang, kept.phrase, w, a, k, l.f AS l, r.f AS r, n,
        CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept) kept
    JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(w[1 : k], ' ')
    JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(w[k + 1 :], ' ')
    JOIN totals t ON t.lang = kept.lang
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""

_REPEATED_SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), w AS (
    SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS s FROM d, unnest(range(0, n - 99)) AS r(i)
), f AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM w
), e AS (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new
    FROM f WHERE nth > 1
), g AS (
    SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e
), runs AS (
    SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run
), cut AS (
    SELECT d.doc_id, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS p, a, b, x
    FROM runs JOIN d USING (doc_id)
), kept AS (
    SELECT doc_id, count(*) AS spans, sum(b - a) AS removed, max(b) AS last,
        string_agg(substr(x, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS y
    FROM cut GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
    sha256(unhex(coalesce(y || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_FILL_SQL = """
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), v AS (
    SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS c2,
        CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS d3, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS d4
    FROM h
), f AS (
    SELECT *, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain'
            WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM v
), p AS (
    SELECT *, substr(text, 1, lo) AS pre, substr(text, lo + 1, hi - lo) AS mid, substr(text, hi + 1) AS suf FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
    sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""

# Where SQL can express the result. The others depend on models, alignments or hashes and are
# tested against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": _WARC_SQL,
    "op2_decontaminate": _DECONTAMINATE_SQL,
    "op7_exact_dedup": _EXACT_SQL,
    "op11_collocations": _COLLOCATIONS_SQL,
    "op12_repeated_spans": _REPEATED_SQL,
    "op13_fill_middle": _FILL_SQL,
}
