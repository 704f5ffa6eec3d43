"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import backoff_langid, bbit_minhash, content_sort, fair_mix, filter_audit, group_pack, hard_negatives, kernel_quality, paragraph_bands, robust_outliers, suffix_groups, toxic_trees, warc_derive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Capture date of the pages, which do not carry one.
CAPTURED = "2024-01-01T00:00:00Z"


def op1_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc_derive.derive(warc_derive.responses(_table(spark, sf_dir, "pages"), CAPTURED), keep=("page_id",))
    return made.withColumn("block", made["block"].cast("string"))


def op2_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.content_sort(_table(spark, sf_dir, "documents"))


def op3_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.taken(_table(spark, sf_dir, "documents"))


def op4_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return backoff_langid.identify(docs, backoff_langid.learn(docs))


def op5_toxic_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxic_trees.learn(docs, _table(spark, sf_dir, "labels")).score(docs)


def op6_group_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pack.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.digests(suffix_groups.cut(_table(spark, sf_dir, "documents")))


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return robust_outliers.judge(docs).drop("lang", "source", "d2")


def op9_paragraph_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_bands.repeated(_table(spark, sf_dir, "documents"))


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel_quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label, F.col("id") % 50 == 0)


_OPERATORS = (
    op1_warc_derive, op2_content_sort, op3_fair_mix, op4_backoff_langid, op5_toxic_trees, op6_group_pack, op7_suffix_groups, op8_robust_outliers, op9_paragraph_bands, op10_bbit_minhash,
    op11_kernel_quality, op12_filter_audit, op13_hard_negatives,
)
QUERIES = {f.__name__: f for f in _OPERATORS}

_UUID = "'<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>'"
_STRIPPED = "html"
for _pattern, _to in (
    (r"(?s)<!--.*?-->", "' '"),
    *[(rf"(?is)<{_x}(?:[ \t\r\n/][^>]*)?>.*?</{_x}[ \t\r\n]*>", "' '") for _x in warc_derive.SILENT],
    (rf"(?i)</?(?:{warc_derive.LINES})(?:[ \t\r\n/][^>]*)?>", "chr(10)"),
    (r"<[a-zA-Z/!?][^>]*>", "''"),
):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', {_to}, 'g')"
for _entity, _char in warc_derive.ENTITIES.items():
    _quoted = _char.replace("'", "''")
    _STRIPPED = f"replace({_STRIPPED}, '{_entity}', '{_quoted}')"
for _pattern, _to in ((r"[ \t\r]+", "' '"), (r" ?\n[ \n]*", "chr(10)"), (r"^[ \n]+|[ \n]+$", "''")):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_pattern}', {_to}, 'g')"

ORACLES = {
    "op1_warc_derive": rf"""
        WITH named AS (SELECT page_id, url, coalesce(html, '') AS html, md5(concat_ws(' ', 'response', page_id::VARCHAR, url)) AS h FROM pages),
        source AS (
            SELECT page_id, url, html, {_UUID} AS refers_to, 'sha256:' || sha256(html) AS source_digest,
                   'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) AS source_headers
            FROM named),
        meta AS (SELECT page_id, {_UUID} AS meta_id FROM (SELECT page_id, md5('metadata ' || refers_to) AS h FROM source)),
        conv AS (SELECT page_id, {_UUID} AS text_id FROM (SELECT page_id, md5('conversion ' || refers_to) AS h FROM source)),
        all_ AS (
            SELECT *, {_STRIPPED} AS body,
                   concat('http-status: 200', chr(13), chr(10), 'http-content-type: text/html; charset=utf-8', chr(13), chr(10), 'source-payload-digest: ', source_digest, chr(13), chr(10),
                          'title: ', trim(regexp_extract(html, '(?is)<title(?:[ \t\r\n][^>]*)?>([^<]*)', 1), ' '), chr(13), chr(10),
                          'language: ', regexp_extract(html, '(?i)<html[^>]*[ \t\r\n]lang=["'']?([a-zA-Z-]+)', 1), chr(13), chr(10),
                          'outlinks: ', len(regexp_extract_all(html, '(?i)<a[ \t\r\n][^>]*href=')), chr(13), chr(10), 'conversion-record-id: ', text_id, chr(13), chr(10)) AS facts
            FROM source JOIN meta USING (page_id) JOIN conv USING (page_id)),
        both_ AS (
            SELECT page_id, meta_id AS record_id, 'metadata' AS warc_type, url, 'application/warc-fields' AS content_type, facts AS block, refers_to, text_id AS concurrent_to, source_headers, source_digest FROM all_
            UNION ALL
            SELECT page_id, text_id, 'conversion', url, 'text/plain; charset=utf-8', body, refers_to, meta_id, source_headers, source_digest FROM all_)
        SELECT page_id, record_id, warc_type, url AS target_uri, '{CAPTURED}' AS date, content_type, block, refers_to, url AS refers_to_uri, '{CAPTURED}' AS refers_to_date,
               concurrent_to, source_headers, source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length
        FROM both_""",
    "op2_content_sort": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
        FROM t""",
    "op3_fair_mix": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(concat(coalesce(doc_id::VARCHAR, ''), ':0')) AS deal
            FROM documents),
        placed AS (
            SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY deal, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
            FROM sized),
        per AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
                   row_number() OVER (ORDER BY source NULLS LAST) AS turn
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, (source_size * 2) / weight::DOUBLE AS ratio,
                   ((sum(source_size) OVER ())::DOUBLE * 1.5
                    - coalesce(sum(source_size * 2) OVER (ORDER BY (source_size * 2) / weight::DOUBLE, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / (sum(weight) OVER (ORDER BY (source_size * 2) / weight::DOUBLE, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
            FROM per),
        goal AS (
            SELECT source, source_size,
                   least((source_size * 2)::DOUBLE, coalesce((SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, turn LIMIT 1) * weight, (source_size * 2)::DOUBLE)) AS target
            FROM levels),
        entries AS (
            SELECT p.source, p.size, p.upto, g.target, e.epoch, e.epoch * g.source_size + p.upto - p.size AS begin_
            FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source, range(2) AS e(epoch)
            WHERE p.size > 0),
        packets AS (SELECT *, begin_ + size <= target AS over_, unnest(CASE WHEN begin_ + size <= target THEN [0] ELSE range(0, size, 256) END) AS packet FROM entries),
        sliced AS (SELECT *, CASE WHEN over_ THEN size ELSE least(256, size - packet) END AS n FROM packets),
        served AS (
            SELECT *, sum(n) OVER (ORDER BY (begin_ + packet + n)::DOUBLE / target, source NULLS LAST, upto, epoch, packet ROWS UNBOUNDED PRECEDING) AS running
            FROM sliced),
        got AS (
            SELECT source, upto, sum(least(n, budget - (running - n))) AS words
            FROM served, (SELECT floor(sum(target) + 0.001) AS budget FROM goal) WHERE running - n < budget GROUP BY source, upto)
        SELECT p.doc_id, p.size, g.source_size, g.target, coalesce(t.words, 0)::BIGINT AS taken
        FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
        LEFT JOIN got t ON p.source IS NOT DISTINCT FROM t.source AND p.upto = t.upto AND p.size > 0""",
    "op10_bbit_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM documents),
        shingled AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM words),
        one AS (SELECT doc_id, unnest(s) AS g FROM shingled),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN shingled a ON a.doc_id = x JOIN shingled b ON b.doc_id = y
            WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n)),
        either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT x, y FROM either UNION SELECT r.x, e.y FROM reach r JOIN either e ON r.y = e.x)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id,
               s.doc_id = least(s.doc_id, coalesce(m.y, s.doc_id)) AS kept
        FROM shingled s LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = s.doc_id""",
    "op9_paragraph_bands": rf"""
        WITH RECURSIVE lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, (generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1)::INTEGER AS paragraph FROM documents),
        words AS (
            SELECT doc_id, paragraph, [x FOR x IN regexp_split_to_array(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
            FROM lines),
        shingled AS (
            SELECT doc_id * 100000 + paragraph AS id, len(w)::INTEGER AS length,
                   CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
            FROM words WHERE len(w) > 0),
        one AS (SELECT id, unnest(s) AS g FROM shingled),
        pairs AS (SELECT a.id AS x, b.id AS y, count(*) AS n FROM one a JOIN one b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN shingled a ON a.id = x JOIN shingled b ON b.id = y
            WHERE 100 * n >= 75 * (len(a.s) + len(b.s) - n) AND greatest(len(a.s), len(b.s)) >= {paragraph_bands.LEAST}),
        either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(x, y) AS (SELECT x, y FROM either UNION SELECT r.x, e.y FROM reach r JOIN either e ON r.y = e.x),
        least_ AS (SELECT x AS id, least(x, min(y)) AS keep FROM reach GROUP BY x),
        para AS (
            SELECT id // 100000 AS doc_id, (id % 100000)::INTEGER AS paragraph, length, len(s)::BIGINT AS n_shingles, keep // 100000 AS keep_doc_id, (keep % 100000)::INTEGER AS keep_paragraph,
                   count(*) OVER (PARTITION BY keep) AS members, id = keep AS kept
            FROM least_ JOIN shingled USING (id)),
        tokens AS (SELECT doc_id, paragraph, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words WHERE len(w) > 0),
        placed AS (
            SELECT doc_id, paragraph, i - 1 AS inside, word, ('0x' || substr(md5(word), 1, 16))::UBIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS n,
                   row_number() OVER (PARTITION BY doc_id ORDER BY paragraph, i) - 1 AS pos
            FROM tokens),
        keyed AS (
            SELECT doc_id, pos, n,
                   ((h::UHUGEINT * {paragraph_bands.KEY[0]} + (lead(h, 1) OVER w)::UHUGEINT * {paragraph_bands.KEY[1]} + (lead(h, 2) OVER w)::UHUGEINT * {paragraph_bands.KEY[2]}) % 18446744073709551616)::UBIGINT AS key
            FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        leasts AS (
            SELECT doc_id, pos, n, min(key - key % 16777216 + pos::UBIGINT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {paragraph_bands.REACH - 1} FOLLOWING) AS low
            FROM keyed WHERE pos <= n - {paragraph_bands.PASSAGE}),
        chosen AS (SELECT DISTINCT doc_id, (low % 16777216)::BIGINT AS pos FROM leasts WHERE pos <= greatest(0, n - {paragraph_bands.PASSAGE + paragraph_bands.REACH - 1})),
        whole AS (SELECT doc_id, list(word ORDER BY pos) AS w, list(paragraph ORDER BY pos) AS p, list(inside ORDER BY pos) AS k FROM placed GROUP BY doc_id),
        spelled AS (
            SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {paragraph_bands.PASSAGE}], ' ') AS t, p[pos + 1] AS p0, p[pos + {paragraph_bands.PASSAGE}] AS p1, k[pos + 1]::INTEGER AS inside
            FROM chosen JOIN whole USING (doc_id)),
        fresh AS (
            SELECT * FROM spelled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
            QUALIFY coalesce(t <> lag(t) OVER w OR pos - lag(pos) OVER w >= {paragraph_bands.PASSAGE}, true)),
        untouched AS (SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM para r WHERE NOT r.kept AND r.doc_id = f.doc_id AND r.paragraph BETWEEN f.p0 AND f.p1)),
        grouped AS (
            SELECT *, count(*) OVER (PARTITION BY t) AS members, first_value(doc_id) OVER g AS keep_doc_id, first_value(p0) OVER g AS keep_paragraph, first_value(inside) OVER g AS keep_start, row_number() OVER g = 1 AS kept
            FROM untouched WINDOW g AS (PARTITION BY t ORDER BY doc_id, pos)),
        opened AS (
            SELECT *, coalesce((pos > lag(pos) OVER w + {paragraph_bands.PASSAGE})::INTEGER, 1) AS o FROM grouped WHERE members > 1 WINDOW w AS (PARTITION BY doc_id, kept ORDER BY pos)),
        runs AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, kept ORDER BY pos) AS run FROM opened),
        parts AS (
            SELECT doc_id, kept, arg_min(p0, pos) AS paragraph, arg_min(inside, pos) AS start, (max(pos) - min(pos) + {paragraph_bands.PASSAGE})::INTEGER AS length,
                   arg_min(keep_doc_id, pos) AS keep_doc_id, arg_min(keep_paragraph, pos) AS keep_paragraph, arg_min(keep_start, pos) AS keep_start, max(members) AS members
            FROM runs GROUP BY doc_id, kept, run)
        SELECT doc_id, 'paragraph' AS kind, paragraph, 0 AS start, length, n_shingles, keep_doc_id, keep_paragraph, 0 AS keep_start, members, kept FROM para
        UNION ALL SELECT doc_id, 'passage', paragraph, start, length, (length - 4)::BIGINT, keep_doc_id, keep_paragraph, keep_start, members, kept FROM parts""",
    "op12_filter_audit": r"""
        WITH worded AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
        flagged AS (
            SELECT doc_id, part,
                   [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
                    regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails
            FROM worded),
        said AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
        docs AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM flagged LEFT JOIN said USING (doc_id)),
        letters AS (SELECT range AS i FROM range(1, 6)),
        orders AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS seq, array_to_string([substr('ABCDE', x::INTEGER, 1) FOR x IN [a.i, b.i, c.i, d.i, e.i]], '') AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        met AS (
            SELECT part, filter_order, good, toxic, s.range::INTEGER AS step, seq[s.range] AS f, fails[seq[s.range]] AS failed, fails,
                   coalesce(list_position([fails[x] FOR x IN seq], true), 6) AS first
            FROM docs, orders, range(1, 6) s),
        counted AS (
            SELECT part, filter_order, step, f, count(*) FILTER (step < first) AS kept, count(*) FILTER (step = first) AS removed, count(*) FILTER (failed AND step > first) AS redundant,
                   count(*) FILTER (failed AND len([1 FOR x IN fails IF x]) = 1) AS unique_fails, count(*) FILTER (step = first AND good = 1) AS good_lost, count(*) FILTER (step = first AND toxic = 1) AS toxic_lost
            FROM met GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted""",
    "op13_hard_negatives": r"""
        WITH shaped AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT a.vec_id AS anchor, a.label AS anchor_label, b.vec_id AS other, b.label AS label, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, b.v)::BIGINT END AS score
            FROM shaped a JOIN shaped b ON a.vec_id % 50 = 0 AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor, other AS positive, score AS positive_score FROM scored WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
        ranked AS (
            SELECT p.anchor, positive, positive_score, other AS negative, score, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other) AS rank
            FROM positives p JOIN scored s ON s.anchor = p.anchor AND s.label <> s.anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
        SELECT anchor AS anchor_id, positive AS positive_id, rank::INTEGER AS rank, negative AS negative_id, positive_score, score AS negative_score FROM ranked WHERE rank <= 3""",
}
