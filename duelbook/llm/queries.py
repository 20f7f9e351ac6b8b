"""The registered queries of this subpackage: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from duelbook.llm import (
    archives, exact, jaccard, language, packing, pii, spelling, suffixes, templates, token_files, toxicity, urls, whitening)
from duelbook.llm.common import remainder, table
from duelbook.session import scratch_path, tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(tune(spark), sf_dir)
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query()
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder("doc_id", 3) != 1))
    found = toxicity.judge(docs, model).withColumn("held_out", remainder("doc_id", 3) == 1)
    predicted = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return found.select("doc_id", "held_out", "score", predicted, F.size("offending").alias("n_offending"))


@query()
def op2_repeated_strings(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query()
def op3_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query(r"""
WITH k AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(n) AS text_sha256
FROM k WINDOW same AS (PARTITION BY n)""")
def op4_exact_dedup(spark, sf_dir):
    marked = exact.mark_copies(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op5_personal_data(spark, sf_dir):
    return pii.find_spans(table(spark, sf_dir, "documents")).drop("scores")


@query()
def op6_decontamination(spark, sf_dir):
    found = templates.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "share", "n_changed")


@query()
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(remainder("doc_id", 5) != 0))
    found = language.identify(docs, model)
    return found.withColumn("held_out", remainder("doc_id", 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query(r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g
    FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, id) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.id FROM r JOIN l ON r.doc_id = l.a AND r.id < l.b)
SELECT s.doc_id, len(any_value(s.g)) AS n_shingles, min(r.id) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""")
def op8_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def url_sql() -> str:
    """The templates, merges and verdicts of ``urls`` in SQL."""
    names = ", ".join(f"s{i}" for i in range(4))
    levels, before = "", "paths"
    for i in range(4):
        template = "token" if i == 0 else "template || '/' || token"
        branch = "token AS branch" if i == 0 else "branch"
        kept = "'' AS template, '' AS branch" if i == 0 else "template, branch"
        levels += f"""
b{i} AS (SELECT host, {names}, n, blocked, labels, {kept} FROM {before}),
k{i} AS (SELECT host, template, s{i}, sum(n) AS own FROM b{i} GROUP BY ALL),
c{i} AS (SELECT host, template, s{i}, CASE WHEN count(*) OVER w > 20 AND own * 20 < sum(own) OVER w THEN '*' ELSE s{i} END AS token
    FROM k{i} WINDOW w AS (PARTITION BY host, template)),
t{i} AS (SELECT b.host, {", ".join(f"b.s{j}" for j in range(4))}, n, blocked, labels, {branch},
    {template.replace("template", "b.template")} AS template
    FROM b{i} b JOIN c{i} c ON b.host = c.host AND b.template = c.template AND b.s{i} = c.s{i}),"""
        before = f"t{i}"
    return f"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
pp AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
        string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/') AS seg FROM pp),
rows_ AS (
    SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled,
        coalesce(seg[2], '') AS s0, coalesce(seg[3], '') AS s1, coalesce(seg[4], '') AS s2, array_to_string(seg[5:], '/') AS s3 FROM ruled),
paths AS (
    SELECT host, {names}, count(*) AS n, count(*) FILTER (ruled = 'block') AS blocked, count(ruled) AS labels FROM rows_ GROUP BY ALL),{levels}
tree AS (SELECT *, substr(template, length(branch) + 1) AS child FROM t3),
cnt AS (SELECT host, branch, child, sum(n) AS n, sum(blocked) AS blocked, sum(labels) AS labels FROM tree GROUP BY ALL),
siz AS (SELECT host, branch, sum(n)::DOUBLE AS size, sum(blocked)::DOUBLE AS blocked, sum(labels)::DOUBLE AS labels FROM cnt GROUP BY ALL),
piv AS (SELECT host, branch AS top, size AS top_size, blocked AS top_blocked, labels AS top_labels FROM siz
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY size DESC, branch) = 1),
com AS (SELECT o.host, o.branch, sum(least(o.n * p.top_size, t.n * s.size)) AS common
    FROM cnt o JOIN piv p ON o.host = p.host JOIN cnt t ON t.host = p.host AND t.branch = p.top AND t.child = o.child
    JOIN siz s ON s.host = o.host AND s.branch = o.branch GROUP BY ALL),
mer AS (SELECT s.host, s.branch, CASE WHEN coalesce(common, 0.0) >= 0.8::DOUBLE * size * top_size AND (labels = 0 AND top_labels = 0
        OR labels > 0 AND top_labels > 0 AND abs(blocked * top_labels - top_blocked * labels) <= 0.2::DOUBLE * labels * top_labels)
        THEN top ELSE s.branch END AS merged
    FROM siz s JOIN piv p ON s.host = p.host LEFT JOIN com c ON c.host = s.host AND c.branch = s.branch),
mt AS (SELECT t.*, merged FROM tree t JOIN mer m ON t.host = m.host AND t.branch = m.branch),
whole AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labels), 0) + 2.0::DOUBLE) AS whole FROM mt),
prior AS (SELECT host, (sum(blocked) + 2.0::DOUBLE * any_value(whole)) / (sum(labels) + 2.0::DOUBLE) AS prior FROM mt, whole GROUP BY host),
pur AS (SELECT m.host, merged, child, sum(labels) >= 3 AND (sum(blocked) + 2.0::DOUBLE * any_value(prior)) / (sum(labels) + 2.0::DOUBLE) >= 0.5 AS rejected
    FROM mt m JOIN prior p ON m.host = p.host GROUP BY ALL)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict,
    '/' || m.merged || m.child AS template
FROM rows_ r JOIN mt m ON r.host = m.host AND r.s0 = m.s0 AND r.s1 = m.s1 AND r.s2 = m.s2 AND r.s3 = m.s3
JOIN pur p ON p.host = m.host AND p.merged = m.merged AND p.child = m.child"""


@query(url_sql())
def op9_url_filter(spark, sf_dir):
    """Branches are merged into the host's largest alone, as the SQL has it; the operator compares all of them by itself."""
    return urls.judge(table(spark, sf_dir, "pages"), every=False)


@query()
def op10_token_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, strlen(h) >= 1000 AND page_id < max(page_id) OVER (PARTITION BY h) AS again, max(page_id) OVER (PARTITION BY h) AS head FROM p)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN head END AS refers_to FROM m""")
def op11_web_archives(spark, sf_dir):
    path = archives.write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return archives.read_archives(spark, path, fields="page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


@query()
def op12_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def misspell(doc_id, run):
    """The run without one of its letters where 97 divides the crc32 of ``doc_id:run``; the letter follows from it too."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


# The checksum bit by bit: the bits of ``doc_id:run``, lowest first, shifted into the register one at a time.
SPELLING_SQL = """
WITH RECURSIVE runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS x
    FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
sums AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(4 * len(x)), lambda i:
        ((strpos('0123456789ABCDEF', substr(x, (2 * (i // 8) + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END)::INT, 1)) - 1) >> (i % 4)::INT) & 1)),
        lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h FROM each),
words AS (
    SELECT word, sum(n)::BIGINT AS n
    FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM sums)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min(other ORDER BY n DESC, other) FILTER (n = top_n) AS other
    FROM (SELECT *, max(n) OVER (PARTITION BY word) AS top_n FROM pairs) GROUP BY word),
led AS (
    SELECT w.word, CASE WHEN top >= 2 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN top END AS form_n
    FROM words w LEFT JOIN best b ON w.word = b.word),
path(word, root, k) AS (SELECT word, word, 0 FROM led UNION ALL SELECT p.word, l.form, k + 1 FROM path p JOIN led l ON p.root = l.word WHERE l.form IS NOT NULL)
SELECT led.word, form, ends.root, led.n, n_near, form_n FROM led JOIN (SELECT word, arg_max(root, k) AS root FROM path GROUP BY word) ends ON led.word = ends.word"""


@query(SPELLING_SQL)
def op13_spelling(spark, sf_dir):
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), change=misspell))
