"""The queries of this subpackage, op1 to op13, and their DuckDB twins where SQL expresses the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm import automata, decontaminate, interactions, minhash, mixing, planes, recurrent, repair, secrets, shards, suffixes, tokens
from proofline.llm import quality as quality_rules

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


SQL["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, p, l FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id),
keyed AS (SELECT *, regexp_replace(lower(regexp_replace(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS k FROM lines),
common AS (SELECT source, k FROM keyed GROUP BY source, k HAVING count(DISTINCT text) > 10),
lost AS (SELECT doc_id, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS n FROM keyed JOIN common USING (source, k) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ws) - coalesce(lost.n, 0) AS BIGINT) AS n_left
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= 50 AND n_left >= 0.5 * n_words AS kept, n_left FROM r
"""


@query
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("secret_spans", lambda s: s["strong"])
    counts = [F.expr(f"cast(size(filter(secret_spans, s -> s.kind = '{k[0]}')) as bigint)").alias(f"n_{k[0]}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(base).cast("binary"), 256).alias("base_sha256"), secrets.span_text(F.col("secret_spans")).alias("spans"))


@query
def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", F.round("mix_rate", 6).alias("mix_rate"), "mix_copies", "mix_copy", "mix_key")


SQL["op1_mixing_sources"] = """
WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
rates AS (SELECT source, (SELECT sum(size) FROM sizes) * sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) / size AS rate FROM sizes),
cdf AS (SELECT source, rate, 0 AS k, -rate AS p, exp(-rate) AS c FROM rates
  UNION ALL SELECT source, rate, k + 1, p + ln(rate / (k + 1)), c + exp(p + ln(rate / (k + 1))) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
sums AS (SELECT source, any_value(rate) AS rate, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.*, rate, len(list_filter(cs, lambda c: c <= u)) AS n
  FROM (SELECT *, CAST(('0x' || substr(md5('17:' || doc_id), 1, 13)) AS BIGINT) / pow(2, 52) AS u FROM documents) d JOIN sums USING (source))
SELECT doc_id, text, lang, source, n_chars, round(rate, 6) AS mix_rate, n AS mix_copies, copy AS mix_copy, substr(md5('17:' || doc_id || ':' || copy), 1, 16) AS mix_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM drawn)
"""


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _duck_parts() -> str:
    rows = []
    for kind, rank, pattern, group, least, part, strong in secrets.KINDS:
        p = pattern.replace("'", "''")
        rows.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, '{part}' AS part, {strong} AS strong, e - length(m) AS s, e FROM (SELECT doc_id, m, v, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e "
            f"FROM (SELECT doc_id, unnest(string_split_regex(text, '{p}')) AS g, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(regexp_extract_all(text, '{p}', {group})) AS v, unnest(range(len(string_split_regex(text, '{p}')))) AS i FROM d) WHERE m IS NOT NULL) WHERE length(v) >= {least}"
            + (" AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')" if kind == "bearer" else "")
        )
    return " UNION ALL ".join(rows)


SQL["op6_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({_duck_parts()}),
met AS (SELECT a.*, b.part AS b_part, b.strong AS b_strong, a.s < b.e AND b.s < a.e AS over FROM parts a JOIN parts b ON a.doc_id = b.doc_id AND (a.s, a.rank) <> (b.s, b.rank)
  AND NOT a.strong AND greatest(a.s, b.s) - CASE WHEN (a.s, a.rank) < (b.s, b.rank) THEN a.e ELSE b.e END <= {secrets.SCOPE}),
near AS (SELECT doc_id, kind, rank, s, e FROM met GROUP BY doc_id, kind, rank, part, s, e
  HAVING NOT bool_or(b_strong AND over AND part <> 'endpoint') AND (bool_or(b_strong AND part <> b_part) OR count(DISTINCT CASE WHEN b_part <> part THEN b_part END) = 2)),
spans AS (SELECT doc_id, kind, rank, s, e, true AS base FROM parts WHERE strong UNION ALL SELECT *, false FROM near),
told AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base) AS base,
  {", ".join(f"count(*) FILTER (kind = '{k[0]}') AS n_{k[0]}" for k in secrets.KINDS)} FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in secrets.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (doc_id)
"""


def _spans_told(found: DataFrame) -> DataFrame:
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), spans.alias("removed_spans"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans_told(automata.without_copied_spans(table(spark, sf_dir, "documents")))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans_told(suffixes.without_repeated_passages(table(spark, sf_dir, "documents")))


def _duck_copied(length: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + {length - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {length - 2})) AS i FROM d WHERE len(ws) >= {length})),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM w),
g AS (SELECT DISTINCT doc_id, i + k AS p FROM f, (SELECT unnest(range({length})) AS k) WHERE first < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id),
islands AS (SELECT doc_id, min(p) - 1 AS b, max(p) AS e FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g) GROUP BY doc_id, k),
told AS (SELECT doc_id, string_agg(b || ':' || e, ',' ORDER BY b) AS spans FROM islands GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d) x ANTI JOIN g ON x.doc_id = g.doc_id AND x.i = g.p GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256, coalesce(spans, '') AS removed_spans
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


SQL["op4_substring_dedup"] = _duck_copied(13)
SQL["op3_suffix_array_dedup"] = _duck_copied(50)


@query
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("id", "first")


SQL["op9_minhash_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT node, b FROM r JOIN e ON seen = a),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON doc_id = node
"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    told = F.array_join(F.transform("leaks", lambda x: F.concat_ws(":", x["item_id"].cast("string"), x["start"].cast("string"), x["n_words"].cast("string"))), ",")
    return found.select("doc_id", F.coalesce(F.size("leaks"), F.lit(0)).cast("long").alias("n_leaks"), F.coalesce(told, F.lit("")).alias("leaks"), F.coalesce(F.round(F.array_max(F.transform("leaks", lambda x: x["weight_similarity"])), 6), F.lit(0.0)).alias("best_similarity"), "clean")


SQL["op5_benchmark_decontamination"] = r"""
WITH i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
ig AS (SELECT item_id, len(ws) AS n, p, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM i WHERE len(ws) > 0)),
dg AS (SELECT doc_id, len(ws) AS n, p, array_to_string(ws[p : p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
h AS (SELECT DISTINCT doc_id, item_id, ig.n AS size, dg.n AS words, dg.p, g FROM dg JOIN ig USING (g)),
w AS (SELECT *, unnest(range(greatest(p - greatest(size - 4, 1), 0), least(p - 1, words - size) + 1)) AS start FROM h),
wg AS (SELECT doc_id, item_id, start, size, g, count(*) AS c FROM w GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS c FROM ig GROUP BY ALL),
m AS (SELECT doc_id, start, size, item_id, sum(least(wg.c, ic.c)) AS b FROM wg JOIN ic USING (item_id, g) GROUP BY ALL),
l AS (SELECT *, b / (2 * greatest(size - 4, 1) - b) AS s FROM m WHERE b >= 0.8 * (2 * greatest(size - 4, 1) - b)),
t AS (SELECT doc_id, count(*) AS n_leaks, string_agg(item_id || ':' || start || ':' || size, ',' ORDER BY start, item_id) AS leaks, max(s) AS best FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_leaks, 0) AS n_leaks, coalesce(leaks, '') AS leaks, coalesce(round(CAST(best AS DOUBLE), 6), 0.0) AS best_similarity, n_leaks IS NULL AS clean FROM d LEFT JOIN t USING (doc_id)
"""


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent.score(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op11_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.through_files(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damaged(table(spark, sf_dir, "conversations")))


def _duck_repair() -> str:
    """One column for each state of the roles so far (b none, h a system turn, u and a the last one), as (cost, audit, lines)."""

    def add(x: str, cost: str, letter: str, line: str | None) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': " + (f"list_append({x}.o, {line})" if line else f"{x}.o") + "} END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"

    def when(test: str, x: str) -> str:
        return f"CASE WHEN {test} THEN {x} END"

    put = {r: lambda x, r=r: add(x, "2", "I", f"'{r}:'") for r in ("user", "assistant")}
    stays, own, user, assistant = "fault <> 'bad'", "role || ':' || text", "'user:' || text", "'assistant:' || text"
    to_u = [w for x in ("b", "h", "a2") for w in (when(f"{stays} AND ini = 'u'", add(x, "cut", "K", own)), when(stays, add(x, "2 + cut", "R", user)))]
    to_a = [when(f"{stays} AND ini = 'a'", add("u2", "cut", "K", own)), when(stays, add("u2", "2 + cut", "R", assistant))]
    start = "CAST({'c': 0, 'a': '', 'o': []} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]))"
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR[]))"
    return rf"""
WITH RECURSIVE t AS (SELECT i AS n, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY n) AS l FROM t WHERE k = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bs FROM conversations),
m AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([4294967295], bs), lambda c, b: xor(l[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE '' END AS ini FROM d),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS first, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM n),
g AS (SELECT *, CASE WHEN first IN ('blank', 'duplicate') THEN 'bad' ELSE '' END AS fault, CASE WHEN first = 'truncated' THEN 1 ELSE 0 END AS cut FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(first = 'blank') AS BIGINT) AS blank, CAST(count_if(first = 'duplicate') AS BIGINT) AS duplicate, CAST(count_if(first = 'truncated') AS BIGINT) AS truncated, CAST(count_if(pair NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {start} AS b, {none} AS h, {none} AS u, {none} AS a FROM s
  UNION ALL SELECT conv_id, i, {add("b", "3", "D", None)}, {least(add("h", "3", "D", None), when(f"{stays} AND ini = 's'", add("b", "cut", "K", own)))}, {least(add("u", "3", "D", None), *to_u)}, {least(add("a", "3", "D", None), *to_a)}
  FROM (SELECT g.*, b, h, u, a, {least("u", *map(put["user"], ("b", "h", "a")))} AS u2, {least("a", put["assistant"]("u"), *[put["assistant"](f"({put['user'](x)})") for x in ("b", "h")])} AS a2 FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i + 1)),
e AS (SELECT r.conv_id, {least("b", "a", put["assistant"]("u"), put["assistant"](f"({put['user']('h')})"))} AS w FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND i = n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


SQL["op12_conversation_repair"] = _duck_repair()


@query
def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.document_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op13_filter_interactions"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
k AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT) + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) AS INT)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS mask FROM d LEFT JOIN k USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, x.i, y.i, z.i] AS p FROM l a, l b, l x, l y, l z WHERE len(list_distinct([a.i, b.i, x.i, y.i, z.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: 'ABCDE'[i + 1]), '') AS filter_order, step, 1 << p[step] AS bit, CAST(coalesce(list_sum(list_transform(p[: step - 1], lambda i: 1 << i)), 0) AS INT) AS before FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & bit = 0 AND mask & before = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit > 0 AND mask & before > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & bit > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley FROM r
"""
