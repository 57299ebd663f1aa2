"""Queries of the integrity family; orders, lineitem and part stand in for chunks, observations and panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import integrity as I
from proofline.operators.sequences import spread
from proofline.plans.registry import query
from proofline.plans.texts import RIGHTS, STATUS, with_rights


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)")
def joi1_orphan_rows(t):
    return I.orphan_rows(t.lineitem, t.part.filter("p_size <= 40"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber")


@query("""WITH l AS (SELECT * FROM lineitem WHERE l_quantity < 40), o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P'), p AS (SELECT * FROM part WHERE p_size <= 45)
SELECT o_custkey AS project_id, 'ORPHAN_ORDER' AS code, 'error' AS severity, false AS passed, CAST(o_orderkey AS VARCHAR) AS subject_id, '' AS detail FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT NULL, 'WITHOUT_ORDER', 'error', false, CAST(c_custkey AS VARCHAR), '' FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM o)
UNION ALL SELECT l_orderkey, 'ORPHAN_LINE', 'error', false, CAST(l_linenumber AS VARCHAR), '' FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT NULL, 'WITHOUT_LINE', 'error', false, CAST(o_orderkey AS VARCHAR), '' FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM l)
UNION ALL SELECT l_orderkey, 'ORPHAN_PANEL', 'error', false, CAST(l_linenumber AS VARCHAR), '' FROM l WHERE l_partkey NOT IN (SELECT p_partkey FROM p)
UNION ALL SELECT NULL, 'WITHOUT_PANEL', 'error', false, CAST(p_partkey AS VARCHAR), '' FROM p WHERE p_partkey NOT IN (SELECT l_partkey FROM l)
UNION ALL SELECT l_orderkey, 'DUPLICATE_LINE', 'error', false, CAST(l_linenumber AS VARCHAR), '' FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'DUPLICATE_PANEL', 'error', false, CAST(l_linenumber AS VARCHAR), '' FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'DUPLICATE_ORDER_LINE', 'error', false, CAST(l_suppkey AS VARCHAR), '' FROM l GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'OUT_OF_ORDER_LINE', 'error', false, CAST(l_linenumber AS VARCHAR), '' FROM (SELECT *, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM l) WHERE l_suppkey < b
UNION ALL SELECT o_custkey, 'NO_EVIDENCE_CLAIM', 'error', false, CAST(o_orderkey AS VARCHAR), '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20)
UNION ALL SELECT o_custkey, 'UNKNOWN_EVIDENCE_CLAIM', 'error', false, CAST(o_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM orders JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20) ON l_orderkey = o_orderkey WHERE l_partkey NOT IN (SELECT p_partkey FROM p)""")
def joi4_lineage_chain_audit(t):
    lines, orders = t.lineitem.filter("l_quantity < 40"), t.orders.filter("o_orderstatus <> 'P'")
    a = I.lineage_chain_audit([("ORDER", orders, "o_orderkey", "o_custkey", t.customer.filter("c_acctbal > 0").select("c_custkey"), "c_custkey")], "o_custkey")
    b = I.lineage_chain_audit([("LINE", lines, "l_linenumber", "l_orderkey", orders, "o_orderkey"), ("PANEL", lines, "l_linenumber", "l_partkey", t.part.filter("p_size <= 45"), "p_partkey")], "l_orderkey")
    refs = t.lineitem.filter("l_quantity > 20").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("refs"))
    claims = t.orders.join(refs, "o_orderkey", "left")
    order = I.source_order_findings("LINE", lines, "l_orderkey", "l_linenumber", "l_suppkey")
    return I.union_all([a, b, order, I.evidence_findings("CLAIM", claims, "o_custkey", "o_orderkey", "refs", t.part.filter("p_size <= 45"), "p_partkey")])


@query("SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS state FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 50000) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def joi5_manifest_diff(t):
    return I.manifest_diff(t.orders.filter("o_totalprice > 50000"), t.lineitem.filter("l_quantity > 45").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), h AS (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 20),
g AS (SELECT c.l_orderkey, count(*) AS required, count(h.l_partkey) AS covered FROM c LEFT JOIN h ON c.l_orderkey = h.l_orderkey AND c.l_partkey = h.l_partkey GROUP BY c.l_orderkey UNION ALL SELECT l_orderkey, 0, 0 FROM h WHERE l_orderkey NOT IN (SELECT l_orderkey FROM c) GROUP BY l_orderkey)
SELECT *, CASE WHEN required > 0 THEN round(covered / required, 6) END AS ratio, CASE WHEN required = 0 THEN 'UNKNOWN_CLAIM' WHEN covered = 0 THEN 'NO_OVERLAP' WHEN covered < required THEN 'INCOMPLETE' ELSE 'OK' END AS code FROM g""")
def joi6_claim_coverage(t):
    passages = t.lineitem.filter("l_quantity > 20").withColumn("l_orderkey", F.expr("if(l_linenumber = 7, -l_orderkey, l_orderkey)"))
    return I.claim_coverage(t.lineitem, passages, "l_orderkey", "l_partkey")


@query("WITH e AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 40) SELECT DISTINCT * FROM (SELECT * FROM e UNION ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.05 AND l_orderkey NOT IN (SELECT l_orderkey FROM e))")
def joi7_eligibility(t):
    return I.eligibility(t.lineitem.filter("l_quantity > 40"), t.lineitem.filter("l_discount > 0.05"), "l_orderkey", "l_partkey")


@query("SELECT o_orderkey, reason FROM (SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'orphan' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40) AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-09-01') > 900 THEN 'expired' END AS reason FROM orders) WHERE reason IS NOT NULL")
def joi12_unreferenced_files(t):
    live = t.customer.filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    refs = t.lineitem.filter("l_quantity > 40").withColumnRenamed("l_orderkey", "o_orderkey")
    return I.unreferenced_files(t.orders, live, refs, "o_orderkey", "o_custkey", F.datediff(F.lit("1998-09-01").cast("date"), F.to_date("o_orderdate")), 900)


@query("SELECT md5(text) AS blob FROM documents GROUP BY text HAVING bool_and(source IN ('src1', 'src2', 'src3'))")
def joi13_unshared_blobs(t):
    return I.unshared_blobs(t.documents.withColumn("blob", F.md5(F.col("text").cast("binary"))), "source", F.col("source").isin("src1", "src2", "src3"), "blob")


@query("""WITH m AS (SELECT DISTINCT l_orderkey, md5(CAST(l_suppkey % 4 AS VARCHAR)) AS h FROM lineitem), s AS (SELECT l_orderkey, sha256(count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))) AS set_hash FROM m GROUP BY l_orderkey)
SELECT set_hash, min(l_orderkey) AS l_orderkey FROM s WHERE set_hash IN (SELECT set_hash FROM s WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)) GROUP BY set_hash""")
def joi14_same_set_match(t):
    members = t.lineitem.withColumn("m", F.col("l_suppkey") % 4)
    return I.same_set_match(members, members.join(members.filter("l_quantity > 49").select("l_orderkey"), "l_orderkey", "left_semi"), "l_orderkey", "m", "l_orderkey")


@query("WITH f AS (SELECT md5(text) AS h, min(doc_id) AS path, arg_min(n_chars, doc_id) AS s FROM documents WHERE lang <> 'de' GROUP BY 1) SELECT doc_id, path, CASE WHEN path IS NULL THEN 'MISSING' WHEN s <> n_chars + CASE WHEN lang = 'fr' THEN 1 ELSE 0 END THEN 'MISMATCH' ELSE 'OK' END AS code FROM documents LEFT JOIN f ON md5(text) = h")
def joi15_resolve_by_checksum(t):
    d = t.documents.withColumn("h", F.md5(F.col("text").cast("binary")))
    files = d.filter("lang <> 'de'").select("h", "n_chars", F.col("doc_id").alias("p"))
    return I.resolve_by_checksum(d.withColumn("n_chars", F.expr("n_chars + if(lang = 'fr', 1, 0)")), files, "doc_id", "h", "n_chars", "p")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM documents c WHERE c.source IN ('src0', 'src2') AND c.lang = d.lang AND md5(c.text) = md5(d.text)) AS cached FROM documents d")
def joi16_reuse_split(t):
    d = t.documents.withColumn("h", F.md5(F.col("text").cast("binary")))
    return I.reuse_split(d, d.filter("source in ('src0', 'src2')"), ["h", "lang"]).select("doc_id", "cached")


_STAGES = ["signup", "view", "click", "purchase", "error"]


@query("""WITH r AS (SELECT user_id, ascii(event_type) AS stage, arg_min(CAST(value AS INT), (ts, event_id)) // 30 AS a, arg_max(CAST(value AS INT), (ts, event_id)) // 30 AS b FROM events GROUP BY 1, 2)
SELECT user_id, stage, bool_or(a IS DISTINCT FROM b) OVER (PARTITION BY user_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stale FROM r""".replace("event_type)", "event_type)").replace("ascii(event_type)", "length(event_type) * 1000 + ascii(event_type)"))
def joi17_stale_results(t):
    g = t.events.groupBy("user_id", F.expr("length(event_type) * 1000 + ascii(event_type)").alias("stage")).agg(*[f(F.bround("value", 0).cast("int"), F.struct("ts", "event_id")).alias(n) for f, n in ((F.min_by, "_a"), (F.max_by, "_b"))])
    old, new = (g.select("user_id", "stage", F.expr(f"_{c} div 30").alias("h")) for c in "ab")
    return I.stale_results(old, new, "user_id", "stage", ["h"])


_RECORD = '''(SELECT *, '{"a":{"k":' || k || ',"type":"' || event_type || '"},"days":[' || CASE WHEN k % 7 = 0 THEN '' ELSE user_id % 3 || ',' END || (event_id % 2) || ']}' AS r FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))'''


@query(f'''SELECT event_id, path, sha256(ar) AS old_hash, sha256(br) AS new_hash FROM (SELECT a.event_id, a.r AS ar, b.r AS br, CASE WHEN a.k <> b.k THEN 'a.k' WHEN a.event_type <> b.event_type THEN 'a.type' WHEN a.k % 7 = 0 AND a.event_id % 2 <> b.event_id % 2 THEN 'days.0'
WHEN a.user_id % 3 <> b.user_id % 3 THEN 'days.0' WHEN a.event_id % 2 <> b.event_id % 2 THEN 'days.1' END AS path FROM {_RECORD} a JOIN {_RECORD} b ON b.event_id = a.event_id + 1) WHERE path IS NOT NULL''')
def joi18_record_diff(t):
    k = F.expr("cast(get_json_object(props, '$.k') as int)")
    made = t.events.withColumn("k", k).selectExpr("event_id", "to_json(struct(struct(k, event_type as type) as a, if(k % 7 = 0, array(event_id % 2), array(user_id % 3, event_id % 2)) as days)) as r")
    return I.record_diff(made, made.withColumn("event_id", F.col("event_id") - 1), "event_id", "r")


@query("SELECT o_custkey, count(DISTINCT b.l_orderkey) AS claims FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE b.l_quantity > 45 GROUP BY o_custkey")
def joi19_beat_claim_overlap(t):
    lines = t.lineitem.count()
    orders, panels = spread(t.orders, "o_orderkey", rows=lines), spread(t.lineitem, "l_orderkey", rows=lines)
    beats = orders.join(panels, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey")
    return I.beat_claim_overlap(beats, t.lineitem.filter("l_quantity > 45"), "o_custkey", "l_orderkey", "l_partkey", lines)


@query("SELECT c.l_orderkey, count(DISTINCT n.c_custkey) AS panels, count(DISTINCT CASE WHEN s.s_nationkey IS NULL THEN c.l_suppkey END) AS unresolved FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) c LEFT JOIN (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0) s ON c.l_suppkey = s.s_suppkey LEFT JOIN customer n ON s.s_nationkey = n.c_nationkey GROUP BY c.l_orderkey")
def joi20_evidence_closure(t):
    sections = t.supplier.filter("s_acctbal > 0").selectExpr("s_suppkey as l_suppkey", "s_nationkey as section")
    return I.evidence_closure(t.lineitem, sections, t.customer.selectExpr("c_nationkey as section", "c_custkey"), "l_orderkey", "l_suppkey", "section", "c_custkey")


@query("""WITH i AS (SELECT 'c' || (o_orderkey % 3) || '__' || (o_orderkey % 5000) AS id FROM orders), t AS (SELECT string_split(id, '__')[-1] AS t, count(*) AS n, min(id) AS id FROM i GROUP BY 1), r AS (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'c0__' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS ref FROM orders)
SELECT ref, coalesce(e.id, CASE WHEN n = 1 THEN t.id END) AS id, CASE WHEN coalesce(e.id, CASE WHEN n = 1 THEN t.id END) IS NOT NULL THEN 'OK' WHEN n > 1 THEN 'SEVERAL' ELSE 'NONE' END AS code FROM r LEFT JOIN (SELECT DISTINCT id FROM i) e ON ref = e.id LEFT JOIN t ON ref = t""")
def joi23_resolve_ids(t):
    ids = t.orders.selectExpr("concat('c', o_orderkey % 3, '__', o_orderkey % 5000) as id")
    refs = t.orders.selectExpr("if(o_orderkey % 2 = 0, concat('c0__', o_orderkey), cast(o_orderkey as string)) as ref").distinct()
    return I.resolve_ids(refs, ids, "ref", "id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'MISSING' WHEN o_orderkey % 7 = 0 THEN 'O_ORDERSTATUS' WHEN o_orderkey % 5 = 0 THEN 'O_TOTALPRICE' WHEN coalesce(n, 0) = 0 THEN 'NO_ACCEPTED' WHEN n > 1 THEN 'MANY_ACCEPTED' ELSE 'OK' END AS code
FROM orders LEFT JOIN (SELECT l_orderkey, count_if(l_quantity > 35) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def joi25_snapshot_parity(t):
    now = t.orders.filter("o_orderkey % 11 <> 0").withColumns({"o_orderstatus": F.expr("if(o_orderkey % 7 = 0, 'X', o_orderstatus)"), "o_totalprice": F.expr("if(o_orderkey % 5 = 0, o_totalprice + 1, o_totalprice)")})
    attempts = t.lineitem.selectExpr("l_orderkey as o_orderkey", "l_quantity > 35 as accepted")
    return I.snapshot_parity(t.orders, now, "o_orderkey", ["o_orderstatus", "o_totalprice"], attempts)


@query("SELECT source, bool_and(doc_id % 97 <> 0) AS equal, count_if(doc_id % 97 = 0) AS changed_rows FROM documents GROUP BY source")
def joi26_ledger_match(t):
    changed = t.documents.withColumn("text", F.expr("if(doc_id % 97 = 0, concat(text, '!'), text)"))
    return I.ledger_match(t.documents, changed, "source", "doc_id", ["text", "lang"])


_CHUNKS = "k AS (SELECT source, c, count(*) AS n, sha256(string_agg(h, ',' ORDER BY doc_id)) AS d FROM h GROUP BY ALL), m AS (SELECT source, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(c || ':' || d, ',' ORDER BY c)) AS fingerprint FROM k GROUP BY source)"


@query("WITH h AS (SELECT source, doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) AS c, sha256(coalesce(text, '') || '|' || coalesce(lang, '')) AS h FROM documents), " + _CHUNKS + " SELECT * FROM m")
def agg20_set_fingerprint(t):
    return I.set_fingerprint(t.documents, "source", "doc_id", ["text", "lang"])


_FINDINGS = "f AS (SELECT user_id AS project_id, CASE WHEN event_type IN ('error', 'signup') THEN 'error' ELSE 'warning' END AS severity, upper(event_type) AS code, value < 60 AS passed, CAST(event_id AS VARCHAR) AS subject_id FROM events)"


def findings(t):
    return t.events.selectExpr("user_id as project_id", "if(event_type in ('error', 'signup'), 'error', 'warning') as severity", "upper(event_type) as code", "value < 60 as passed", "cast(event_id as string) as subject_id")


@query(f"WITH {_FINDINGS} SELECT project_id, count(*) AS checks, count_if(severity = 'error' AND NOT passed) AS errors, count_if(severity = 'warning' AND NOT passed) AS warnings, coalesce(string_agg(DISTINCT CASE WHEN severity = 'error' AND NOT passed THEN code END, ',' ORDER BY CASE WHEN severity = 'error' AND NOT passed THEN code END), '') AS error_codes, coalesce(string_agg(DISTINCT CASE WHEN severity = 'warning' AND NOT passed THEN code END, ',' ORDER BY CASE WHEN severity = 'warning' AND NOT passed THEN code END), '') AS warning_codes, bool_and(severity <> 'error' OR passed) AS can_publish FROM f GROUP BY project_id")
def agg15_check_summary(t):
    return I.check_summary(findings(t))


@query("SELECT CASE WHEN grouping(source) = 1 THEN '<all>' ELSE source END AS area, CAST(sum(n_chars) AS BIGINT) AS bytes, sum(n_chars) > 120000 AS over_limit FROM documents GROUP BY ROLLUP (source)")
def agg16_usage_by_area(t):
    return I.usage_by_area(t.documents, "source", "n_chars", 120000)


@query("SELECT conv_id, count(DISTINCT role) AS identities, bool_or(role = '') AS empty, count(DISTINCT role) = 1 AS passed FROM conversations GROUP BY conv_id")
def agg17_single_identity(t):
    return I.single_identity(t.conversations, "conv_id", ["role"])


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 440000))")
def agg18_missing_sections(t):
    allowed = t.customer.selectExpr("c_nationkey as n_nationkey", "c_custkey as beat")
    return I.missing_sections(t.nation, allowed, t.orders.filter("o_totalprice > 440000").withColumnRenamed("o_custkey", "beat"), "n_nationkey", "beat")


@query(r"""WITH p AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents), k AS (SELECT *, (row_number() OVER (PARTITION BY token ORDER BY doc_id) - 1) // 64 AS block FROM p)
SELECT token, block, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM k GROUP BY token, block""")
def agg19_inverted_index(t):
    return I.inverted_index(t.documents.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")), "token", "doc_id", 64)


@query("""WITH c AS (SELECT l_partkey % 2000 AS id, l_orderkey % 50 AS chunk, l_suppkey % 2 AS payload FROM lineitem), g AS (SELECT id, min(chunk) AS a, max(chunk) AS b, count(DISTINCT chunk) AS n, count(DISTINCT payload) AS p FROM c GROUP BY id HAVING count(DISTINCT chunk) > 1)
SELECT id, a AS first_chunk, CASE WHEN p > 1 THEN 'CONFLICT' WHEN b - a + 1 <> n THEN 'SCATTERED' ELSE 'OK' END AS code FROM g""")
def agg21_overlap_agreement(t):
    return I.overlap_agreement(t.lineitem.selectExpr("l_partkey % 2000 as id", "l_orderkey % 50 as chunk", "l_suppkey % 2 as payload"), "id", "chunk", "payload")


@query("SELECT user_id, event_type, count(*) AS requests, round(count(*) * 0.002::DOUBLE, 6) AS cost FROM events GROUP BY ALL")
def agg22_request_accounting(t):
    return I.request_accounting(t.events, "user_id", "event_type", 0.002)


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN user_id % 9 > 0 OR event_type <> 'error' THEN value - 1 END AS v FROM events), g AS (SELECT user_id, max(v) AS largest, min(v) AS least, count(v) AS n, count(*) AS rows FROM v GROUP BY user_id)
SELECT user_id, event_id, v, largest, n, CASE WHEN n < rows THEN 'MISSING' WHEN least < 0 OR largest > 250 + 1e-9 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS code FROM v JOIN g USING (user_id)""")
def agg24_measured_limits(t):
    return I.measured_limits(t.events.withColumn("v", F.expr("if(user_id % 9 > 0 or event_type <> 'error', value - 1, null)")), "user_id", "event_id", "v", 250)


@query("SELECT project_id, code, severity, passed, subject_id, detail FROM (SELECT CAST(substring(source, 4) AS BIGINT) AS project_id, 'RIGHTS' AS code, 'error' AS severity, " + STATUS + " IN ('declared', 'verified') AS passed, CAST(doc_id AS VARCHAR) AS subject_id, " + STATUS + " AS detail FROM " + RIGHTS + " UNION ALL SELECT CAST(substring(source, 4) AS BIGINT), 'MARKER', 'warning', NOT contains(text, 'token'), CAST(doc_id AS VARCHAR), '' FROM documents)")
def set1_findings_union(t):
    project = F.expr("cast(substring(source, 4) as bigint)")
    rights = with_rights(t).select(*I.finding("RIGHTS", project, F.col("doc_id"), passed=F.col("rights_status").isin("declared", "verified"), detail=F.col("rights_status")))
    return I.union_all([rights, t.documents.select(*I.finding("MARKER", project, F.col("doc_id"), "warning", ~F.contains("text", F.lit("token"))))])


@query(f"WITH {_FINDINGS}, e AS (SELECT project_id, code, min(subject_id) AS o FROM f WHERE NOT passed GROUP BY ALL) SELECT project_id, string_agg(code, ',' ORDER BY o, code) AS first_seen, string_agg(code, ',' ORDER BY code) AS sorted FROM e GROUP BY project_id")
def set2_distinct_codes(t):
    return I.distinct_codes(findings(t).filter("not passed"))


@query("SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'common' END AS side FROM (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 60000) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_discount > 0.08) b ON a.k = b.k")
def set3_id_set_compare(t):
    return I.id_set_compare(t.orders.filter("o_totalprice > 60000"), t.lineitem.filter("l_discount > 0.08").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey % 6 AS chunk, 'c' || (o_orderkey % 6) || '__' || o_orderkey AS id, 'c' || (o_orderkey % 6) || '__' || o_custkey AS link FROM orders")
def set4_prefix_merge(t):
    return I.prefix_merge(t.orders.selectExpr("o_orderkey % 6 as chunk", "o_orderkey as id", "o_custkey as link"), "chunk", ["id", "link"])


@query("SELECT p_brand, p_partkey, arg_min(q, (p_size2, r2, q)) AS replacement FROM (SELECT a.p_brand, a.p_partkey, b.p_partkey AS q, b.p_size AS p_size2, b.p_retailprice AS r2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND b.p_size < a.p_size AND a.p_partkey <> b.p_partkey) GROUP BY ALL")
def top1_remap_best(t):
    return I.remap_best(t.part, t.part, "p_brand", "p_partkey", "p_size", ["p_size", "p_retailprice", "p_partkey"])


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1")
def top4_fifo_next(t):
    return t.events.filter("event_type = 'error'").orderBy("ts", "event_id").limit(1).select("event_id", "user_id")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def src1_scan_ordered(t):
    return t.orders.selectExpr("o_custkey", "o_orderkey", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place")


@query("WITH f AS (SELECT source, doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents), h AS (SELECT source, doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) AS c, sha256(doc_id || '|' || sha256 || '|' || size) AS h FROM f), " + _CHUNKS + " SELECT f.*, fingerprint AS manifest FROM f JOIN m USING (source)")
def src3_file_manifest(t):
    return I.file_manifest(t.documents, "source", "doc_id", "text")
