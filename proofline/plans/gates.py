"""Quality gates over the other operators, and queries of records and chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import chunks as C
from proofline.operators import integrity as I
from proofline.operators import records as R
from proofline.operators import sequences as S
from proofline.operators import texts as O
from proofline.plans import integrity as PI
from proofline.plans import sequences as PS
from proofline.plans.registry import SQL, Tables, query
from proofline.plans.sequences import SHOTS, shots
from proofline.plans.texts import LEXICAL, NARR, RIGHTS, STATUS, _grams, with_rights

Rule = Callable[[Tables], DataFrame]


class Rules:
    """Named checks with the one finding schema."""

    def __init__(self) -> None:
        self.rules: dict[str, Rule] = {}

    def register(self, rule: Rule) -> Rule:
        self.rules[rule.__name__] = rule
        return rule

    def findings(self, t: Tables) -> DataFrame:
        """What all rules find; the tables that several of them derive are written once."""
        shared = t.shared()
        return I.union_all([rule(shared) for rule in self.rules.values()])


policy, quality = Rules(), Rules()


def project():
    return F.expr("cast(substring(source, 4) as bigint)")



@policy.register
def rights(t):
    return with_rights(t).select(*I.finding("RIGHTS", project(), F.col("doc_id"), passed=F.col("rights_status").isin("declared", "verified")))


@policy.register
def markers(t):
    return t.documents.select(*I.finding("MARKER", project(), F.col("doc_id"), "warning", ~F.contains(F.lower("text"), F.lit("token"))))


@policy.register
def similarity(t):
    overlap = O.shingle_overlap(t.documents, t.benchmark, "doc_id").select("doc_id", "band")
    return t.documents.join(overlap, "doc_id").select(*I.finding("SIMILARITY", project(), F.col("doc_id"), passed=F.col("band") == "clear", detail=F.col("band")))


@policy.register
def volume(t):
    return t.documents.groupBy("source").agg(F.sum("n_chars").alias("_n")).select(*I.finding("VOLUME", project(), F.lit(None), "info", F.col("_n") < 120000, F.col("_n")))


@policy.register
def banned(t):
    hits = O.banned_terms(t.documents, t.spark.createDataFrame([("icense",), (" TOKEN",), ("@",)], "term string"), "doc_id")
    return t.documents.select("doc_id", "source").join(hits, "doc_id").select(*I.finding("BANNED", project(), F.col("doc_id"), detail=F.col("terms")))


@policy.register
def citations(t):
    cited = t.documents.withColumn("evidence_ids", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    return O.uncited(cited, ["fr"], "lang").select(*I.finding("UNCITED", project(), F.col("doc_id"), "warning"))


_PID = "CAST(substring(source, 4) AS BIGINT)"


@query(f"""WITH a AS ({_grams(5, 'documents', 'doc_id')}), b AS (SELECT DISTINCT s FROM ({_grams(5, 'benchmark', 'item_id')})), c AS (SELECT doc_id, round(count(b.s) / count(*), 6) AS o FROM a LEFT JOIN b USING (s) GROUP BY doc_id), d AS (SELECT documents.*, CASE WHEN coalesce(o, 0) >= 0.5 THEN 'block' WHEN coalesce(o, 0) >= 0.25 THEN 'warn' ELSE 'clear' END AS band FROM documents LEFT JOIN c USING (doc_id))
SELECT {_PID} AS project_id, 'RIGHTS' AS code, 'error' AS severity, {STATUS} IN ('declared', 'verified') AS passed, CAST(doc_id AS VARCHAR) AS subject_id, '' AS detail FROM {RIGHTS}
UNION ALL SELECT {_PID}, 'MARKER', 'warning', NOT contains(lower(text), 'token'), CAST(doc_id AS VARCHAR), '' FROM documents
UNION ALL SELECT {_PID}, 'SIMILARITY', 'error', band = 'clear', CAST(doc_id AS VARCHAR), band FROM d
UNION ALL SELECT {_PID}, 'VOLUME', 'info', sum(n_chars) < 120000, NULL, CAST(sum(n_chars) AS VARCHAR) FROM documents GROUP BY source
UNION ALL SELECT {_PID}, 'BANNED', 'error', false, CAST(doc_id AS VARCHAR), string_agg(DISTINCT term, ',' ORDER BY term) FROM documents JOIN (VALUES ('icense'), ('token'), ('@')) v(term) ON contains(lower(text), term) GROUP BY source, doc_id
UNION ALL SELECT {_PID}, 'UNCITED', 'warning', false, CAST(doc_id AS VARCHAR), '' FROM documents WHERE lang <> 'fr' AND NOT regexp_matches(text, '[0-9]')""")
def gat1_policy_findings(t):
    return policy.findings(t)


@quality.register
def dominance(t):
    return S.dominance(shots(t), "mode").select(*I.finding("DOMINANT", F.col("project_id"), F.lit("mode"), passed=F.col("passed")))


@quality.register
def patterns(t):
    found = S.alternating_pattern(shots(t), "mode")
    return found.select(*I.finding("ALTERNATING", F.col("project_id"), F.col("first_pos"), "warning"))


@quality.register
def stillness(t):
    return S.static_ratio(shots(t), "mode = 'view'").select(*I.finding("STATIC", F.col("project_id"), F.lit("mode"), "warning", F.col("static_ratio") < 0.2))


@query("SELECT user_id, count(*) AS audited, count_if(value < 15) AS weak, count_if(event_type = 'signup') AS unsigned FROM events GROUP BY user_id")
def flt6_weak_alignment(t):
    return O.weak_alignment(t.events.selectExpr("user_id", "value / 100 as score", "if(event_type = 'signup', '', event_type) as signature"), "user_id", "score", "signature")


_JOBS = "p_partkey, CASE WHEN p_partkey % 11 > 0 THEN 'renders/' || p_partkey END AS output, p_partkey % 7 > 0 AS there, 1080 + p_size % 3 * 20 AS width, CASE p_partkey % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1270 ELSE 0 END AS height, CASE WHEN p_partkey % 13 > 0 THEN p_size * 2.5 - 5 END AS seconds, 70 AS target"


@query(f"""WITH j AS (SELECT {_JOBS} FROM part), s AS (SELECT *, output IS NOT NULL AND there AS seen, coalesce(seconds, 0) <= 0 AS unknown FROM j),
c AS (SELECT p_partkey, unnest([CASE WHEN output IS NULL THEN 'render.missing' END, CASE WHEN output IS NOT NULL AND NOT there THEN 'render.file_missing' END, CASE WHEN seen AND height > 0 AND abs(width / nullif(height, 0) - 0.5625) > 0.02 THEN 'render.wrong_aspect' END, CASE WHEN seen AND height > 0 AND height < 1280 THEN 'render.low_resolution' END,
CASE WHEN seen AND (height = 0 OR height = 1920 AND abs(width / nullif(height, 0) - 0.5625) <= 0.02) THEN 'render.ok' END, CASE WHEN unknown THEN 'duration.unknown' END, CASE WHEN NOT unknown AND seconds > 90 THEN 'duration.too_long' END, CASE WHEN NOT unknown AND seconds <= 90 AND seconds > 80.5 THEN 'duration.over_target' END,
CASE WHEN NOT unknown AND seconds < 60 THEN 'duration.too_short' END, CASE WHEN NOT unknown AND seconds BETWEEN 60 AND 80.5 THEN 'duration.ok' END]) AS code FROM s)
SELECT p_partkey, code, CASE WHEN code IN ('render.ok', 'duration.ok') THEN 'info' WHEN code IN ('render.low_resolution', 'duration.over_target', 'duration.too_short') THEN 'warning' ELSE 'error' END AS severity, code IN ('render.ok', 'duration.ok') AS passed FROM c WHERE code IS NOT NULL""")
def gat7_output_checks(t):
    jobs = t.part.selectExpr("p_partkey", "if(p_partkey % 11 > 0, concat('renders/', p_partkey), null) as output", "p_partkey % 7 > 0 as there", "1080 + p_size % 3 * 20 as width", "case p_partkey % 3 when 0 then 1920 when 1 then 1270 else 0 end as height", "if(p_partkey % 13 > 0, p_size * 2.5D - 5, null) as seconds", "70 as target")
    return R.output_checks(jobs, "p_partkey", "output", "there", "width", "height", "seconds", "target")


#: Checks by the queries of other operators: code, query, its project, whether a row passes, its subject and detail. The
#: expressions mean the same in Spark and in DuckDB.
CHECKS = [
    ("VOICE", PI.agg17_single_identity, "conv_id", "passed", "identities", "''"), ("ALIGNMENT", flt6_weak_alignment, "user_id", "weak * 3 <= audited", "audited", "''"),
    ("REPETITION", PS.win11_repetition_audit, "project_id", "codes = ''", "'shots'", "codes"), ("LONG_RUN", PS.win13_longest_same_run, "project_id", "longest_s <= 300", "'mode'", "''"),
    ("MOTION", PS.win14_motion_audit, "project_id", "codes = ''", "'mode'", "codes"), ("GAP", PS.win15_boundary_gap, "project_id", "false", "pos", "''"),
    ("REUSE", PS.agg8_reuse_cap, "project_id", "false", "asset", "uses"), ("DIVERSITY", PS.agg10_mode_diversity, "project_id", "top_share <= 0.3 or justified", "top_mode", "''"),
    ("CUE", PS.win8_validate_cues, "project_id", "false", "pos", "code"), ("CAPTIONS", PS.agg11_caption_stats, "project_id", "overflow_s = 0", "'cues'", "most_words"),
    ("GROUP", PS.win10_validate_groups, "project_id", "false", "sentence", "code"), ("CADENCE", PS.agg12_cadence_bands, "project_id", "codes = ''", "profile_id", "codes"),
    ("MEASURED", PI.agg24_measured_limits, "user_id", "code = 'OK'", "event_id", "code"), ("OUTPUT", gat7_output_checks, "p_partkey", "passed", "p_partkey", "code"),
]


def _check(code, found, owner, passed, subject, detail):
    return lambda t: found(t).select(*I.finding(code, F.expr(owner), F.expr(subject), "warning", F.expr(passed), F.expr(detail)))


for check in CHECKS:
    quality.rules[check[0].lower()] = _check(*check)


def told() -> str:
    """The twins of CHECKS as branches of a union."""
    return "".join(f"\nUNION ALL SELECT {owner}, '{code}', 'warning', {passed}, CAST({subject} AS VARCHAR), CAST({detail} AS VARCHAR) FROM ({SQL[found.__name__]})" for code, found, owner, passed, subject, detail in CHECKS)


GAT2 = f"""{SHOTS}, m AS (SELECT project_id, mode, sum(dur) AS s FROM sh GROUP BY ALL), al AS (SELECT project_id, min(pos) - 3 AS p FROM (SELECT *, mode = lag(mode, 2) OVER w AND lag(mode) OVER w = lag(mode, 3) OVER w AND mode <> lag(mode) OVER w AS h FROM sh WINDOW w AS (PARTITION BY project_id ORDER BY pos)) WHERE h GROUP BY project_id),
qf AS (SELECT project_id, 'DOMINANT' AS code, 'error' AS severity, NOT (round(max(s) / sum(s), 6) > 0.35 AND count(*) >= 2) AS passed, 'mode' AS subject_id, '' AS detail FROM m GROUP BY project_id
UNION ALL SELECT project_id, 'ALTERNATING', 'warning', false, CAST(p AS VARCHAR), '' FROM al
UNION ALL SELECT project_id, 'STATIC', 'warning', round(sum(CASE WHEN mode = 'view' THEN s ELSE 0 END) / sum(s), 6) < 0.2, 'mode', '' FROM m GROUP BY project_id{told()})"""


@query(f"WITH {GAT2} SELECT * FROM qf UNION ALL SELECT * FROM ({SQL['gat1_policy_findings']})")
def gat2_quality_findings(t):
    return I.union_all([policy.findings(t), quality.findings(t)])


@query(f"""WITH {GAT2}, j AS (SELECT user_id AS project_id, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id), c AS (SELECT project_id, bool_and(severity <> 'error' OR passed) AS ok FROM qf GROUP BY project_id)
SELECT project_id, last = 'purchase' AND coalesce(ok, false) AS ready, CASE WHEN last <> 'purchase' THEN 'NO_FINISHED_JOB' WHEN NOT coalesce(ok, false) THEN 'BLOCKED' ELSE 'READY' END AS reason FROM j LEFT JOIN c USING (project_id)""")
def gat3_publish_ready(t):
    jobs = S.latest(t.events, ["user_id"], ["ts", "event_id"]).selectExpr("user_id as project_id", "event_type")
    summary = I.check_summary(quality.findings(t)).select("project_id", "can_publish")
    done, ok = F.col("event_type") == "purchase", F.coalesce("can_publish", F.lit(False))
    return jobs.join(summary, "project_id", "left").select("project_id", (done & ok).alias("ready"), F.when(~done, "NO_FINISHED_JOB").when(~ok, "BLOCKED").otherwise("READY").alias("reason"))


_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_''-]*[\p{L}\p{N}_])?"
_SECTION = "CASE turn WHEN 0 THEN 'hook' WHEN 1 THEN 'setup' WHEN 2 THEN 'conflict' WHEN 3 THEN 'twist' ELSE 'cta' END"


@query(rf"""WITH r AS (SELECT conv_id, turn, {_SECTION} AS sec, text, regexp_extract_all(lower(text), '{_WORD}') AS ws, regexp_matches(text, 'Ther') AS cited FROM conversations),
o AS (SELECT conv_id, sum(len(regexp_extract_all(text, '\S+'))) AS spoken, count(*) FILTER (NOT regexp_matches(text, '\S')) AS empty, sum(len(ws)) AS said, bool_or(cited AND sec IN ('setup', 'conflict', 'twist')) AS proved,
  coalesce(lower(max(text) FILTER (turn = 0)), '') AS hook, coalesce(lower(max(text) FILTER (turn = 1)), '') AS setup, coalesce(lower(max(text) FILTER (turn = 2)), '') AS conflict, coalesce(lower(max(text) FILTER (turn = 3)), '') AS twist, coalesce(lower(arg_max(text, turn) FILTER (sec = 'cta')), '') AS cta FROM r GROUP BY conv_id),
t AS (SELECT *, CASE WHEN spoken = 0 THEN 0.0 ELSE round(greatest(0.6, spoken / 2.4::DOUBLE), 2) END AS sec_s, list_sum([CAST(NOT regexp_matches(x, '\S') AS INT) for x in [hook, setup, conflict, twist, cta]]) AS missing FROM o),
p AS (SELECT conv_id, sec, trim(s) AS s FROM (SELECT conv_id, sec, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM r) WHERE trim(s) <> ''),
k AS (SELECT conv_id, sec, len(regexp_extract_all(lower(s), '{_WORD}')) AS n, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS key, regexp_replace(lower(s), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS letters FROM p),
w AS (SELECT conv_id, list(word ORDER BY turn, i) AS ws FROM (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM r) GROUP BY conv_id),
g AS (SELECT conv_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT conv_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 12)),
tied AS (SELECT DISTINCT conv_id FROM (SELECT conv_id, unnest(regexp_extract_all(cta, '{_WORD}')) AS word FROM o) JOIN (SELECT conv_id, unnest(ws) AS word FROM r WHERE sec <> 'cta') USING (conv_id, word))
SELECT conv_id, 'TOO_LONG' AS code, CAST(1 AS BIGINT) AS n FROM t WHERE sec_s > 30 * 1.1::DOUBLE
UNION ALL SELECT conv_id, 'TOO_SHORT', 1 FROM t WHERE sec_s < 30 * 0.4::DOUBLE
UNION ALL SELECT conv_id, 'EMPTY_SECTION', empty FROM t WHERE empty > 0
UNION ALL SELECT conv_id, 'MISSING_SECTION', missing FROM t WHERE missing > 0
UNION ALL SELECT conv_id, 'INSIGHT_MISSING', 1 FROM t WHERE NOT (contains(twist, 'was') OR contains(twist, 'que') OR contains(twist, 'und'))
UNION ALL SELECT conv_id, 'HOOK_REPEATS_SETUP', 1 FROM t WHERE hook = setup
UNION ALL SELECT conv_id, 'EVIDENCE_MISSING', 1 FROM t WHERE NOT coalesce(proved, false)
UNION ALL SELECT conv_id, 'SENTENCE_FRAGMENT', count(*) FROM k WHERE n < 3 GROUP BY conv_id
UNION ALL SELECT conv_id, 'REPEATED_SENTENCE', count(*) FROM (SELECT conv_id, key FROM k GROUP BY ALL HAVING count(*) > 1) GROUP BY conv_id
UNION ALL SELECT conv_id, 'REPETITION', count(*) FROM (SELECT conv_id, letters FROM k WHERE length(letters) >= 15 GROUP BY ALL HAVING count(DISTINCT sec) > 1) GROUP BY conv_id
UNION ALL SELECT conv_id, 'REPEATED_PHRASE', count(*) FROM (SELECT conv_id, s FROM g GROUP BY ALL HAVING count(*) > 1) GROUP BY conv_id
UNION ALL SELECT conv_id, 'CTA_CONTEXT_MISSING', 1 FROM o WHERE conv_id NOT IN (SELECT conv_id FROM tied)""")
def gat4_script_checks(t):
    sections = t.conversations.withColumns({"section": F.expr(_SECTION), "evidence": F.regexp_extract_all("text", F.lit("Ther[a-z]*"), F.lit(0))})
    return O.script_checks(sections, "conv_id", "turn", "section", "evidence", ["was", "que", "und"], 2.4, 30.0)


@query(f"""WITH a AS ({_grams(4, 'documents', 'doc_id', LEXICAL)}), b AS (SELECT DISTINCT s FROM ({_grams(4, 'benchmark', 'item_id', LEXICAL)})), c AS (SELECT DISTINCT doc_id FROM a JOIN b USING (s)), w AS (SELECT doc_id, {NARR.format('text')} AS w FROM documents)
SELECT w.doc_id, array_to_string(list_sort(list_filter([CASE WHEN w NOT BETWEEN 115 AND 125 OR w.doc_id % 5 = 0 THEN 'WORDS' END, CASE WHEN greatest(0.6, round(w / 2.2, 2)) NOT BETWEEN 50 AND 60 OR w.doc_id % 7 = 0 THEN 'DURATION' END, CASE WHEN c.doc_id IS NOT NULL THEN 'COPIED' END], lambda x: x IS NOT NULL)), ',') AS codes FROM w LEFT JOIN c ON w.doc_id = c.doc_id""")
def gat5_narration_contract(t):
    n = T.narration_word_count(F.col("text"))
    stated = t.documents.select("doc_id", "text", (n + F.expr("if(doc_id % 5 = 0, 1, 0)")).alias("n"), (T.spoken_seconds(n, F.lit(2.2)) + F.expr("if(doc_id % 7 = 0, 0.5D, 0.0D)")).alias("s"))
    return O.narration_contract(stated, t.benchmark, "doc_id", "n", "s", 2.2)


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind, 'aaaa,b' AS tags, substring('event ' || event_id, 1, 8) AS title FROM events".replace("'aaaa,b'", "'aaaaaaaa,b'"))
def jsn1_parse_untrusted(t):
    made = t.events.withColumn("p", F.to_json(F.struct(F.col("event_type").alias("kind"), F.array(F.lit("aaaaaaaaaa"), F.lit("b"), F.lit("c")).alias("tags"), F.concat(F.lit("event "), "event_id").alias("title"))))
    return R.parse_untrusted(made, "event_id", "p", ["click", "view"], "other", 2, 8)


@query("SELECT o_orderkey, code FROM (SELECT o_orderkey, unnest([CASE WHEN o_orderstatus = 'P' THEN 'KEYS' END, CASE WHEN o_totalprice > 300000 THEN 'ORDER' END, CASE WHEN o_orderpriority LIKE '1%' THEN 'NO_SELF' END, CASE WHEN o_orderstatus = 'P' THEN 'NO_FACTS' END, CASE WHEN o_totalprice > 300000 OR o_custkey > 1000 THEN 'BOUNDS_ORDER' END]) AS code FROM orders) WHERE code IS NOT NULL")
def jsn2_validate_observations(t):
    full = F.struct(F.expr("if(o_totalprice > 300000, -1L, o_custkey)").alias("order"), F.array(F.expr("if(o_orderpriority like '1%', 'x', cast(o_orderkey as string))")).alias("refs"), F.expr("if(o_orderstatus = 'P', null, 'f')").alias("facts"))
    return R.validate_observations(t.orders.withColumn("p", F.to_json(full)), "o_orderkey", "p", ["order", "refs", "facts"], "o_custkey", {"order": (0, 1000)})


@query("""WITH e AS (SELECT l_orderkey, l_partkey AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem), a AS (SELECT l_orderkey, l_partkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem WHERE l_quantity > 3),
g AS (SELECT l_orderkey, count(*) AS n, count(a) AS m, count_if(coalesce(e = a, false)) AS s FROM e LEFT JOIN a USING (l_orderkey, k) GROUP BY l_orderkey) SELECT l_orderkey, n = m AS count_equal, n = s AS order_equal, round(s / n, 6) AS ratio, n - s AS unresolved FROM g""")
def jsn3_validate_manifest(t):
    return R.validate_manifest(t.lineitem.filter("l_quantity > 3"), t.lineitem, "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH e AS (SELECT user_id, floor(value / 20)::BIGINT AS position, CAST(json_extract(props, '$.k') AS INT) % 10 AS id FROM events), c AS (SELECT user_id, position, position % 12 AS chunk, list(id) AS ids FROM e WHERE id <> 9 GROUP BY ALL),
x AS (SELECT DISTINCT user_id, id FROM e WHERE id <> user_id % 10), n AS (SELECT DISTINCT user_id, unnest(ids) AS id FROM c), l AS (SELECT user_id, id AS a, (id + 1) % 10 AS b FROM (SELECT DISTINCT user_id, id FROM e WHERE id % 3 = 0))
SELECT user_id, CAST(chunk AS VARCHAR) AS subject, 'DUPLICATE_CHUNK' AS code FROM c GROUP BY user_id, chunk HAVING count(*) > 1
UNION ALL SELECT user_id, CAST(chunk AS VARCHAR), 'REPEATED_ID' FROM c WHERE len(list_distinct(ids)) < len(ids)
UNION ALL SELECT user_id, CAST(chunk AS VARCHAR), 'NO_OVERLAP' FROM (SELECT *, lag(ids) OVER (PARTITION BY user_id ORDER BY position) AS b FROM c) WHERE b IS NOT NULL AND NOT list_has_any(ids, b)
UNION ALL SELECT user_id, CAST(id AS VARCHAR), 'UNKNOWN_ID' FROM n ANTI JOIN x USING (user_id, id)
UNION ALL SELECT user_id, CAST(id AS VARCHAR), 'UNCOVERED' FROM x ANTI JOIN n USING (user_id, id)
UNION ALL SELECT user_id, CAST(id AS VARCHAR), 'UNKNOWN_LINK' FROM (SELECT user_id, a AS id FROM l UNION ALL SELECT user_id, b FROM l) ANTI JOIN x USING (user_id, id)""")
def jsn4_validate_continuity(t):
    e = t.events.selectExpr("user_id", "cast(floor(value / 20) as bigint) as position", "cast(get_json_object(props, '$.k') as int) % 10 as id")
    chunks = e.filter("id <> 9").groupBy("user_id", "position").agg(F.collect_list("id").alias("ids")).withColumn("chunk", F.expr("position % 12"))
    links = e.filter("id % 3 = 0").selectExpr("user_id", "id as a", "(id + 1) % 10 as b").distinct()
    return R.validate_continuity(chunks, "user_id", "position", "chunk", "ids", e.filter("id <> user_id % 10"), "id", links, ("a", "b"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), x AS (SELECT DISTINCT user_id, k FROM e WHERE k % 10 <> 3),
n AS (SELECT user_id, CASE WHEN value > 190 THEN 'click' ELSE event_type END AS entity_id, event_type AS name, event_id, k FROM e WHERE event_id % 5 = 0 AND user_id % 11 > 0 AND (value < 100 OR event_type <> 'error')), m AS (SELECT user_id, event_type AS entity_id, k, event_id FROM e WHERE event_id % 5 = 1)
SELECT DISTINCT user_id, '' AS subject, 'NO_ENTITIES' AS code FROM x WHERE user_id NOT IN (SELECT user_id FROM n)
UNION ALL SELECT user_id, entity_id, 'BLANK_ENTITY' FROM n WHERE event_id % 7 = 0 UNION ALL SELECT user_id, entity_id, 'REPEATED_ENTITY' FROM n GROUP BY user_id, entity_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT user_id, entity_id, 'UNKNOWN_ENTITY' FROM m ANTI JOIN n USING (user_id, entity_id) UNION ALL SELECT user_id, entity_id, 'BLANK_TEXT' FROM m WHERE event_id % 9 = 0
UNION ALL SELECT user_id, entity_id, 'NO_EVIDENCE' FROM (SELECT * FROM n UNION ALL SELECT user_id, entity_id, NULL, event_id, k FROM m) WHERE event_id % 8 = 0
UNION ALL SELECT user_id, CAST(k AS VARCHAR), 'UNKNOWN_PANEL' FROM (SELECT DISTINCT user_id, k FROM (SELECT user_id, k, event_id FROM n UNION ALL SELECT user_id, k, event_id FROM m) WHERE event_id % 8 > 0) ANTI JOIN x USING (user_id, k)""")
def jsn4_validate_entities(t):
    e = t.events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    panels = "if(event_id % 8 = 0, array(), array(k)) as ids"
    entities = e.filter("event_id % 5 = 0 and user_id % 11 > 0 and (value < 100 or event_type <> 'error')").selectExpr("user_id", "if(value > 190, 'click', event_type) as entity_id", "if(event_id % 7 = 0, ' ', event_type) as name", panels)
    mentions = e.filter("event_id % 5 = 1").selectExpr("user_id", "event_type as entity_id", "if(event_id % 9 = 0, array('was', ''), array('was', 'is')) as texts", panels)
    return R.validate_entities(entities, mentions, e.filter("k % 10 <> 3"), "user_id", "k")


_ROLES = [("user", 20, 60), ("assistant", 20, 150), ("user", 10, 80), ("assistant", 20, 150)]
_LEX = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@query(rf"""WITH r AS (SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '\S+')) AS n, array_to_string({_LEX.format('text')}[1:3], ' ') AS o, row_number() OVER w AS k, lead(turn) OVER w IS NULL AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS total, row_number() OVER (PARTITION BY conv_id, o ORDER BY turn) > 1 AS again FROM r),
f(k, want, low, high) AS (VALUES (1, 'user', 20, 60), (2, 'assistant', 20, 150), (3, 'user', 10, 80), (4, 'assistant', 20, 150)),
s AS (SELECT DISTINCT conv_id, turn, array_to_string({_LEX.format('s')}, ' ') AS s FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '[.!?]+')) AS s FROM conversations))
SELECT conv_id, turn, code FROM (SELECT conv_id, turn, unnest([CASE WHEN role IS DISTINCT FROM want THEN 'ROLE' END, CASE WHEN NOT coalesce(n BETWEEN low AND high, false) THEN 'WORDS' END, CASE WHEN again THEN 'OPENING' END, CASE WHEN last AND x.k <> 4 THEN 'COUNT' END, CASE WHEN last AND total NOT BETWEEN 90 AND 425 THEN 'TOTAL' END, CASE WHEN last AND NOT ends_with(rtrim(text), '?') THEN 'ENDING' END]) AS code FROM x LEFT JOIN f ON f.k = x.k) WHERE code IS NOT NULL
UNION ALL SELECT DISTINCT conv_id, turn, 'SENTENCE' FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) AS i FROM s WHERE s <> '') WHERE i > 1""")
def jsn5_validate_passages(t):
    return R.validate_passages(t.conversations, "conv_id", "turn", "role", "text", _ROLES, (90, 425))


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events")
def jsn6_alias_fields(t):
    return R.alias_fields(t.events, "event_id", "props", ["key", "k"])


@query("""SELECT conv_id, turn, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, doc) AS place FROM (SELECT s.conv_id, s.turn, c.turn AS doc,
round(round(c.q + round(CASE WHEN s.role = 'user' THEN 3 * c.close ELSE 0 END + CASE WHEN s.role = 'assistant' THEN 2.5 * (c.close + c.q) ELSE 0 END + CASE WHEN s.turn % 3 = 0 THEN 1.5 * c.q ELSE 0 END, 3), 6)
+ 0.35 * greatest(0, 1 - CASE WHEN s.turn > 0 THEN abs(c.turn - s.turn + 1) ELSE 0 END / 6.0::DOUBLE) + CASE WHEN s.turn = 0 THEN 0 WHEN c.turn < s.turn - 1 THEN -least(2.0, (s.turn - 1 - c.turn) * 0.25::DOUBLE) ELSE least(0.18, (c.turn - s.turn + 1) * 0.03::DOUBLE) END, 6) AS score
FROM conversations s JOIN (SELECT conv_id, turn, length(text) % 97 / 100::DOUBLE AS q, length(text) % 11 / 10::DOUBLE AS close FROM conversations) c ON s.conv_id = c.conv_id)) WHERE place <= 3""")
def joi21_score_candidates(t):
    spans = t.conversations.selectExpr("conv_id", "turn", "array_compact(array(role, if(turn % 3 = 0, 'reveal', null))) as tags", "if(turn > 0, turn - 1, null) as previous")
    candidates = t.conversations.selectExpr("conv_id", "turn as doc", "length(text) % 97 / 100D as quality", "length(text) % 11 / 10D as close", "turn as position")
    return R.score_candidates(spans, candidates, "conv_id", "turn", "doc", {"user": "3 * close", "assistant": "2.5D * (close + quality)", "reveal": "1.5D * quality"})


@query(f"WITH {SHOTS} SELECT project_id, pos, array_to_string(list_filter([CASE WHEN dur / 100 > 0.5 THEN 'strong' END, CASE WHEN asset >= lag(asset) OVER w THEN 'chronological' END, CASE WHEN mode <> lag(mode) OVER w THEN 'new_family' END, CASE WHEN dur / 100 < 0.2 THEN 'weak' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sh WINDOW w AS (PARTITION BY project_id ORDER BY pos)")
def joi22_selection_reasons(t):
    return R.selection_reasons(shots(t), "project_id", "pos", "asset", "mode", "(dur / 100)")


@query("SELECT o_orderkey, 100 * c + 5 * (o_custkey % 4) + 3 * (o_custkey % 3) + least(p, 16) AS score FROM orders JOIN (SELECT l_orderkey, count(*) AS c, count(DISTINCT l_partkey) * 4 AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def win21_beat_score(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("c"), (F.count_distinct("l_partkey") * 4).alias("p"))
    return R.beat_score(t.orders.join(lines, "o_orderkey"), "c", "(o_custkey % 4)", "(o_custkey % 3)", "p").select("o_orderkey", "score")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, octet_length(encode(text)) AS size, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY source) AS n, sum(octet_length(encode(text))) OVER w AS upto FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
e AS (SELECT a.source, a.r, a.n, greatest(a.r + 1, coalesce(max(b.r + 1) FILTER (b.upto - a.upto + a.size <= 20000), 0)) AS ends FROM d a JOIN d b ON a.source = b.source AND b.r BETWEEN a.r AND a.r + 11 GROUP BY a.source, a.r, a.n),
s AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS r, 0 AS chunk FROM d UNION ALL SELECT s.source, greatest(ends - 2, s.r + 1), chunk + 1 FROM s JOIN e ON e.source = s.source AND e.r = s.r WHERE ends < n)
SELECT d.source, doc_id, size, chunk FROM s JOIN e ON e.source = s.source AND e.r = s.r JOIN d ON d.source = s.source AND d.r >= s.r AND d.r < ends""")
def win18_byte_bounded_chunks(t):
    return C.byte_bounded_chunks(t.documents.select("source", "doc_id", F.octet_length("text").alias("size")), "source", "doc_id", "size", 12, 20000, 2)


def _measure(rows: pd.DataFrame) -> pd.DataFrame:
    if rows["text"].str.contains("token").any():
        raise ValueError("secret")
    return pd.DataFrame({"doc_id": rows["doc_id"], "letters": rows["text"].str.len()})


@query("SELECT doc_id, CASE WHEN contains(text, 'token') THEN NULL ELSE length(text) END AS letters, contains(text, 'token') AS quarantined FROM documents")
def udf1_map_chunks(t):
    good, bad = C.map_chunks(t.documents, "source", "doc_id", "doc_id", _measure, "letters long", 16)
    return good.selectExpr("doc_id", "letters", "false as quarantined").union(bad.selectExpr("doc_id", "cast(null as bigint)", "true"))


@query("SELECT source, CAST(coalesce(sum(CASE WHEN NOT contains(text, 'token') THEN length(text) END), 0) AS BIGINT) AS letters, count_if(contains(text, 'token')) AS missing FROM documents GROUP BY source")
def udf2_map_reduce_text(t):
    return C.map_reduce_text(t.documents, "source", "doc_id", "doc_id", _measure, "letters long", 16, [F.coalesce(F.sum("letters"), F.lit(0)).alias("letters")])


@query("SELECT user_id, 'REQUEUED' AS status, n + 1 AS attempt FROM (SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last FROM events GROUP BY user_id) WHERE last + 1800000000 < (SELECT max(epoch_us(ts)) FROM events)")
def str2_lease_expiry(t):
    from proofline.streaming import leases

    at = t.events.withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))
    jobs = at.groupBy("user_id").agg(F.count("*").alias("attempt"), F.max("us").alias("beat"))
    return leases.expired(jobs, jobs.agg(F.max("beat").alias("now")), 1_800_000_000).select("user_id", "status", "attempt")
