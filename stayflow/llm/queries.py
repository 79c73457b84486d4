"""The registered queries of the subpackage, each next to the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayflow.llm import (decontaminate, language, line_crf, mixing, near_dedup, pii, prefix_trie, quality_rules, sharding, spelling, substring,
                          url_filter, wavelet)
from stayflow.session import work_dir
from stayflow.llm.texts import id_remainder
from stayflow.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
N_WORDS = f"CAST(len({WORDS}) AS BIGINT)"


def digest_sql(text: str) -> str:
    """The number that stayflow.llm.texts.digest60 makes of a text."""
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query(rf"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM starts),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS least FROM windows) WHERE least < doc_id),
cut AS (SELECT DISTINCT doc_id, p + i AS p FROM gone, (SELECT unnest(range(50)) AS i)),
cuts AS (SELECT doc_id, list(p) AS ps FROM cut GROUP BY doc_id),
pos AS (SELECT doc_id, len(w) AS n, w, unnest(CASE WHEN len(w) = 0 THEN [0] ELSE range(1, len(w) + 1) END) AS p FROM d),
kept AS (SELECT pos.doc_id, n, p, CASE WHEN p > 0 AND cut.p IS NULL THEN w[pos.p] END AS word
         FROM pos LEFT JOIN cut USING (doc_id, p))
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_words, any_value(n) - count(word) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p), '')) AS kept_sha256
FROM kept GROUP BY doc_id""")
def op1_substring_dedup(spark, sf_dir):
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


CRC_SQL = """list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

FEISTEL_SQL = f"""list_reduce([{{'k': CAST(-1 AS BIGINT), 'l': x // b, 'r': x % b}}] ||
  list_transform(range({sharding.ROUNDS}), lambda i: {{'k': i, 'l': CAST(0 AS BIGINT), 'r': CAST(0 AS BIGINT)}}), lambda s, i: {{'k': i.k,
  'l': CASE WHEN i.k % 2 = 0 THEN (s.l + {digest_sql("'shuffle|' || i.k || '|' || s.r")}) % a ELSE s.l END,
  'r': CASE WHEN i.k % 2 = 1 THEN (s.r + {digest_sql("'shuffle|' || i.k || '|' || s.l")}) % b ELSE s.r END}})"""

SHARDS = 24


@query(f"""WITH RECURSIVE crc AS (SELECT {CRC_SQL} AS t),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(coalesce(text, '')) AS bytes FROM documents),
sums AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(range(1, length(bytes), 2), lambda i: CAST('0x' || substr(bytes, i, 2) AS BIGINT))),
    lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS crc32 FROM d, crc),
n AS (SELECT count(*) AS n FROM d),
root AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS root FROM n),
sides AS (SELECT n, root + i AS a, (n + root + i - 1) // (root + i) AS b
          FROM root, (SELECT unnest(range({sharding.SEARCH})) AS i) ORDER BY (root + i) * ((n + root + i - 1) // (root + i)), a LIMIT 1),
numbers AS (SELECT doc_id, row_number() OVER (ORDER BY {digest_sql("CAST(doc_id AS VARCHAR)")} % {sharding.BUCKETS}, doc_id) - 1 AS x FROM d),
walk AS (SELECT doc_id, x, false AS moved FROM numbers
  UNION ALL SELECT doc_id, m.l * b + m.r, true FROM (SELECT doc_id, a, b, {FEISTEL_SQL} AS m FROM walk, sides WHERE NOT moved OR x >= n))
SELECT doc_id, CAST(size AS BIGINT) AS size, crc32 AS text_crc32, 'rows' AS law, CAST(x % {SHARDS} AS INTEGER) AS shard,
       CAST(x // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM walk JOIN d USING (doc_id) JOIN sums USING (doc_id), n WHERE moved AND x < n""")
def op2_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shard(rows, SHARDS, ["doc_id", "text_crc32", "size"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS miss, {N_WORDS} AS size FROM documents),
c AS (SELECT *, CASE WHEN size < 64 THEN size ELSE (length(bin(size)) - 6) * 32 + (size >> (length(bin(size)) - 6)) END AS cls,
             {digest_sql("CAST(doc_id AS VARCHAR)")} % {mixing.BUCKETS} AS part FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY miss, src ORDER BY cls, part, size, doc_id) AS place FROM c),
s AS (SELECT src, miss, sum(size) AS words, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY miss, src) - 1) % 3 AS INTEGER)] AS weight
      FROM d GROUP BY src, miss),
caps AS (SELECT *, words * CAST(2.0 AS DOUBLE) AS cap FROM s),
levels AS (SELECT *, (CAST(sum(words) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, miss, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, miss, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
goals AS (SELECT src, miss, words, least(cap, (max(level) OVER ()) * weight) AS target,
    ({digest_sql("'mix|' || CAST(miss AS VARCHAR) || '|' || src")} % 1024 + CAST(0.5 AS DOUBLE)) / 1024 AS start FROM levels),
rates AS (SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0 END AS rate FROM goals)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
       CAST(least(floor(start + place * rate) - floor(start + (place - 1) * rate), ceil(rate)) AS BIGINT) AS copies,
       CAST(least(floor(start + place * rate) - floor(start + (place - 1) * rate), ceil(rate)) * size AS BIGINT) AS taken
FROM placed JOIN rates USING (src, miss)""")
def op3_mixing(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", quality_rules.word_count(F.col("text")).alias("size"))
    planned, name = mixing.plan_copies(rows, F.col("size"), "source", ["doc_id"])
    return planned.select("doc_id", "size", F.col(name["source_size"]).alias("source_size"),
                          F.col(name["target"]).alias("target"), F.col(name["copies"]).alias("copies"),
                          (F.col(name["copies"]) * F.col("size")).alias("taken"))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) >= 3),
named AS (SELECT doc_id, p, [w[p], w[p + 1], w[p + 2]] AS g FROM grams),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM named) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + i) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS i) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
  length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS upper
  FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 10 > n_words OR word_chars > 15 * n_words
       OR word_chars < 2 * n_words OR upper * 2 > word_chars OR n_dup_lines * 10 > n_lines * 3) AS kept
FROM m""")
def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rules = quality_rules.order_rules(docs, quality_rules.default_rules(F.col("text")), F.col("doc_id"))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = quality_rules.measure(docs).withColumn("base_failed", base)
    kept = F.when(F.col("base_failed"), False).otherwise(quality_rules.first_rejection(rules).isNull())
    return judged.withColumn("kept", kept).drop("text")


URL_RULES = [url_filter.UrlRule("allow", "org/"), url_filter.UrlRule("block", "example.org/es/"),
             url_filter.UrlRule("block", "example.org/en/1"), url_filter.UrlRule("allow", "com/fr/"),
             url_filter.UrlRule("block", "com/de/")]


def _url_rule_sql() -> str:
    cases = []
    for rule in sorted(URL_RULES, key=lambda r: -len(r.place)):
        name, slash, rest = rule.place.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') "
                     f"THEN {{'rule': '{rule.place}', 'label': '{rule.verdict}'}}")
    return "CASE " + " ".join(cases) + " END"


def _url_level_sql(k: int) -> str:
    """Chances of the last character after k characters, by Witten-Bell from those after k - 1."""
    size = url_filter.ORDER + 1
    part = f"substr(gram, {size - k}, {k + 1})"
    mixed = ", ".join(
        f"CASE WHEN {c}_all = 0 THEN {low} ELSE ({c} + {c}_kinds * {low}) / ({c}_all + {c}_kinds) END AS p{c}"
        for c, low in (("a", "q.pa" if k else "CAST(1 AS DOUBLE) / 256"), ("b", "q.pb" if k else "CAST(1 AS DOUBLE) / 256")))
    join = f"JOIN p{k - 1} q ON q.g = substr(s.g, 2, {k})" if k else ""
    return f"""c{k} AS (SELECT {part} AS g, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1),
s{k} AS (SELECT *, sum(a) OVER w AS a_all, sum(b) OVER w AS b_all, sum(CAST(a > 0 AS INTEGER)) OVER w AS a_kinds,
  sum(CAST(b > 0 AS INTEGER)) OVER w AS b_kinds FROM c{k} WINDOW w AS (PARTITION BY substr(g, 1, {k}))),
p{k} AS (SELECT s.g AS g, {mixed} FROM s{k} s {join})"""


@query(f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, host || path AS place, {_url_rule_sql()} AS fit FROM u),
g AS (SELECT page_id, place, fit.label AS label, unnest(list_transform(range(1, length(place) + 2),
    lambda i: substr(repeat(chr(10), {url_filter.ORDER}) || place || chr(10), i, {url_filter.ORDER + 1}))) AS gram FROM r WHERE place <> ''),
counts AS (SELECT gram, sum(CAST(label IS NOT DISTINCT FROM 'allow' AS INTEGER)) AS a, sum(CAST(label IS NOT DISTINCT FROM 'block' AS INTEGER)) AS b
           FROM g GROUP BY gram),
{", ".join(_url_level_sql(k) for k in range(url_filter.ORDER + 1))},
scores AS (SELECT page_id, round(sum(ln(pa) - ln(pb)) / count(*), 9) AS score FROM g JOIN p{url_filter.ORDER} ON p{url_filter.ORDER}.g = gram GROUP BY page_id),
all_scores AS (SELECT r.*, fit.label AS label, coalesce(score, 0) AS score FROM r LEFT JOIN scores USING (page_id)),
m AS (SELECT avg(score) FILTER (label = 'allow') AS ma, stddev_pop(score) FILTER (label = 'allow') AS sa,
             avg(score) FILTER (label = 'block') AS mb, stddev_pop(score) FILTER (label = 'block') AS sb FROM all_scores)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(label, CASE WHEN score >= (ma * sb + mb * sa) / (sa + sb) THEN 'allow' ELSE 'block' END) AS verdict
FROM all_scores, m""")
def op8_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("score")


WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@query()
def op9_token_output(spark, sf_dir):
    folder = work_dir(spark, "tokens")
    wavelet.write_shards(table(spark, sf_dir, "documents"), folder, WORD_VOCABULARY, end_id=1, by_word=True)
    return wavelet.read_summaries(spark, folder)


@query()
def op4_decontaminate(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = id_remainder(F.col("doc_id"), 3)
    held_out = F.coalesce(fold == 1, F.lit(False))
    net = language.fit(docs, F.coalesce(fold != 1, F.lit(False)))  # a row without an id is in no fold
    judged = language.predict(docs.select("doc_id", "text"), net)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op10_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    field = line_crf.fit(docs, labels.where(~held_out))
    scored = line_crf.score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [md5(array_to_string(w, ' '))]
        ELSE list_transform(range(1, len(w) - 1), lambda i: md5(array_to_string(w[i:i + 2], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN n USING (doc_id)""")
def op7_minhash_near_dedup(spark, sf_dir):
    return near_dedup.components(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def _crc_sql(text: str) -> str:
    """crc32 of a text of ASCII or longer characters, with the table of CRC_SQL joined as crc.t."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(hex({text})), 2),
      lambda i: CAST('0x' || substr(hex({text}), i, 2) AS BIGINT))), lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295)"""


@query(rf"""WITH RECURSIVE crc AS (SELECT {CRC_SQL} AS t),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
         FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents)),
kinds AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS place, any_value(r) AS r, count(*) AS n FROM runs WHERE length(r) >= 5 GROUP BY 1),
marked AS (SELECT r, n, {_crc_sql("place")} AS h FROM kinds, crc),
changed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, CAST(h % length(r) AS INTEGER)) || substr(r, CAST(h % length(r) AS INTEGER) + 2) ELSE r END AS word, n
            FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT DISTINCT word, p, substr(word, 1, CAST(p AS INTEGER) - 1) || substr(word, CAST(p AS INTEGER) + 1) AS rest
         FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word AS word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
          UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
          UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest),
best AS (SELECT pairs.word AS word, count(*) AS n_near, arg_min(near, (-x.n, near)) AS form, max(x.n) AS form_n
         FROM pairs JOIN words x ON x.word = near GROUP BY pairs.word),
formed AS (SELECT w.word AS word, w.n AS n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form,
           CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
led AS (SELECT word, word AS at FROM formed UNION ALL SELECT led.word, f.form FROM led JOIN formed f ON f.word = led.at WHERE f.form IS NOT NULL)
SELECT word, formed.form AS form, led.at AS root, formed.n AS n, formed.n_near AS n_near, formed.form_n AS form_n
FROM formed JOIN led USING (word) JOIN formed f ON f.word = led.at AND f.form IS NULL""")
def op11_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"), least_points=5, least_n=3, one_in=97)


@query(rf"""WITH RECURSIVE crc AS (SELECT {CRC_SQL} AS t),
turns AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, length(coalesce(text, '')) AS points, turn
          FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, h, points, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS p FROM turns),
sizes AS (SELECT conv_id, count(*) AS k FROM own GROUP BY conv_id),
skips AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS b, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM sizes, crc),
rebuilt AS (SELECT c, p AS pos, own.h, points FROM skips JOIN own ON conv_id = b AND p <= skips.h
  UNION ALL SELECT c, p - skips.h + least(skips.h, coalesce(k, 0)), own.h, points
  FROM skips JOIN own ON own.conv_id = c AND p > skips.h LEFT JOIN sizes ON sizes.conv_id = b),
seqs AS (SELECT c, coalesce(list(h ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s, list(points ORDER BY pos) FILTER (pos IS NOT NULL) AS points
         FROM (SELECT DISTINCT c FROM skips) LEFT JOIN rebuilt USING (c) GROUP BY c),
members AS (SELECT c, s, points, unnest(range(0, len(s) + 1)) AS d FROM seqs),
nodes AS (SELECT d, array_to_string(s[1:d], '') AS name, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(points[d]), 0) AS points,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256
          FROM members GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, left(name, 32 * (d - 1)) AS name, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
weights AS (SELECT nodes.d AS d, nodes.name AS name, (n_convs - 1) * points AS w, CAST(kids.n IS NULL AS BIGINT) AS leaf
            FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.name = nodes.name),
above AS (SELECT name, w, leaf, unnest(range(0, d + 1)) AS k FROM weights),
sums AS (SELECT k AS d, left(name, 32 * k) AS name, sum(w) AS saved, sum(leaf) AS leaves FROM above GROUP BY 1, 2)
SELECT n.conv_id AS conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs AS n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256 AS ends_sha256
FROM nodes n JOIN sums ON sums.d = n.d AND sums.name = n.name LEFT JOIN kids ON kids.d = n.d AND kids.name = n.name
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.name = left(n.name, 32 * (n.d - 1))""")
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.build(table(spark, sf_dir, "conversations"), heads=6, group=100)


@query()
def op12_personal_data(spark, sf_dir):
    return pii.find_personal(table(spark, sf_dir, "documents"))
