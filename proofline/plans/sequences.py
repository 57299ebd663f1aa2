"""Queries of the sequence family, over events as shots and conversations as narration."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.functions import text as T
from proofline.operators import sequences as O
from proofline.plans.registry import query

SHOTS = "sh AS (SELECT user_id AS project_id, event_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS pos, event_type AS mode, value AS dur, CAST(json_extract(props, '$.k') AS INT) AS asset FROM events)"
LAID = SHOTS + ", laid AS (SELECT *, coalesce(sum(dur + {gap}) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start_s FROM sh), tl AS (SELECT *, start_s + dur AS end_s FROM laid)"
DISPLAY = r"replace(upper(trim(regexp_replace(regexp_replace(word, '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g'))), 'ẞ', 'SS')"
WORDS = r"""w0 AS (SELECT conv_id AS project_id, turn AS seg, unnest(ws) AS word, unnest(range(len(ws))) AS k FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS ws FROM conversations)),
w AS (SELECT project_id, seg, word, """ + DISPLAY + r""" AS display, CAST(row_number() OVER (PARTITION BY project_id ORDER BY seg, k) AS INT) AS pos FROM w0), tw AS (SELECT *, pos * 0.4::DOUBLE AS start_s, pos * 0.4::DOUBLE + CASE WHEN length(word) > 9 THEN 0.45::DOUBLE ELSE 0.3 END AS end_s FROM w)"""


def shots(t):
    return t.once_by("shots", lambda: t.events, "user_id", _shots, "project_id", lambda: t.events.count())


def _shots(events):
    return events.selectExpr("user_id as project_id", "event_id", "ts", "cast(row_number() over (partition by user_id order by ts, event_id) as int) as pos", "event_type as mode", "value as dur", "cast(get_json_object(props, '$.k') as int) as asset")


def timeline(t, gap=0.0):
    return O.lay_out(shots(t), gap)


#: Characters of narration that have no more than a word each, about.
CHARS_A_WORD = 6


def timed_words(t):
    """The words of conversations with their times; for shared tables also with their sentences."""
    size = lambda: (t.conversations.agg(F.sum(F.length("text"))).first()[0] or 0) // CHARS_A_WORD
    return t.once_by("words", lambda: t.conversations, "conv_id", lambda turns: _timed_words(turns, t.kept is not None), "project_id", size)


def _timed_words(conversations, sentences=False):
    """Signs are taken from all words of a turn at once, and all are set in capitals at once: a line each, as no word has a blank."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    shown = F.split(F.upper(F.regexp_replace(F.array_join("ws", "\n"), r"[^\p{L}\p{N}\s]", "")), "\n", -1)
    turns = conversations.select(F.col("conv_id").alias("project_id"), F.col("turn").alias("seg"), words.alias("ws")).filter("size(ws) > 0")
    w = turns.select("project_id", "seg", F.posexplode(F.arrays_zip(F.col("ws").alias("word"), shown.alias("display"))).alias("k", "w")).select("project_id", "seg", "k", "w.word", "w.display")
    w = O.sentence_of(w, "seg, k") if sentences else w
    w = w.withColumn("pos", F.expr("cast(row_number() over (partition by project_id order by seg, k) as int)")).drop("k")
    return w.selectExpr("*", "cast(pos * 0.4D as double) as start_s", "pos * 0.4D + if(length(word) > 9, 0.45D, 0.3D) as end_s")


def laid(sql: str, gap: str = "0.0") -> str:
    return f"WITH {LAID.format(gap=gap)} {sql}"


@query(laid("SELECT project_id, pos, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, CASE k WHEN 0 THEN mode ELSE 'end' END AS word, CASE k WHEN 0 THEN round(start_s + 0.1, 3) ELSE round(start_s + dur / 2, 3) END AS word_start, CASE k WHEN 0 THEN round(start_s + dur / 2, 3) ELSE round(start_s + dur, 3) END AS word_end FROM tl, (SELECT unnest([0, 1]) AS k)", "0.25"))
def win1_lay_out(t):
    spoken = shots(t).withColumn("words", F.expr("array(named_struct('word', mode, 'start_s', 0.1D, 'end_s', dur / 2), named_struct('word', 'end', 'start_s', dur / 2, 'end_s', dur))"))
    laid_out = O.lay_out(spoken, 0.25, words="words").select("project_id", "pos", "start_s", "end_s", F.explode("words").alias("w"))
    return laid_out.selectExpr("project_id", "pos", "round(start_s, 6) as start_s", "round(end_s, 6) as end_s", "w.word", "w.start_s as word_start", "w.end_s as word_end")


@query(laid("SELECT project_id, pos, round(greatest(end_s, coalesce(lead(start_s) OVER (PARTITION BY project_id ORDER BY pos), end_s)), 6) AS end_s FROM tl", "0.25"))
def win2_absorb_gap(t):
    return O.absorb_gap(timeline(t, 0.25)).selectExpr("project_id", "pos", "round(end_s, 6) as end_s")


@query(laid("""SELECT project_id, pos, slot, index, round(start_s + dur * slot / n, 6) AS start_s, round(start_s + dur * (slot + 1) / n, 6) AS end_s, index % 5 AS asset FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos, slot) - 1 AS index
FROM (SELECT *, unnest(range(n)) AS slot FROM (SELECT *, CAST(greatest(1, least(4, floor((end_s - start_s) / 20.0))) AS INT) AS n FROM tl)))"""))
def win3_split_slots(t):
    return O.split_slots(timeline(t), 20.0).selectExpr("project_id", "pos", "slot", "index", "round(start_s, 6) as start_s", "round(end_s, 6) as end_s", "asset")


@query(f"WITH {SHOTS}, l AS (SELECT *, CAST(round_even(dur * 60000 / sum(dur) OVER (PARTITION BY project_id), 0) AS BIGINT) AS l FROM sh), e AS (SELECT *, CAST(sum(l) OVER w AS BIGINT) AS e, lead(pos) OVER w IS NULL AS last FROM l WINDOW w AS (PARTITION BY project_id ORDER BY pos)) SELECT project_id, pos, (e - l) / 1000 AS start_s, CASE WHEN last THEN 60.0 ELSE e / 1000 END AS end_s FROM e")
def win4_rescale(t):
    return O.rescale(shots(t), 60.0)


WEIGHT = r"length(regexp_replace(word, '[^\p{L}\p{N}_]', '', 'g')) + 1 + CASE WHEN regexp_matches(word, '[,;:]$') THEN 1.5 WHEN regexp_matches(word, '[.!?]$') THEN 2.5 ELSE 0 END"


@query(f"""WITH {WORDS}, x AS (SELECT project_id, seg, pos, word, CAST({WEIGHT} AS DOUBLE) AS v FROM w), y AS (SELECT *, sum(v) OVER (PARTITION BY project_id, seg ORDER BY pos) AS e, sum(v) OVER (PARTITION BY project_id, seg) AS t, lead(word) OVER (PARTITION BY project_id, seg ORDER BY pos) IS NULL AS l FROM x)
SELECT project_id, seg, pos, word, round(1.5 + 8.0 * (e - v) / t, 3) AS start_s, CASE WHEN l THEN 9.5 ELSE round(1.5 + 8.0 * e / t, 3) END AS end_s FROM y""")
def win5_weighted_word_times(t):
    return O.weighted_word_times(timed_words(t).drop("start_s", "end_s").withColumn("seconds", F.lit(8.0)), offset=1.5)


@query(f"""WITH {WORDS}, s AS (SELECT project_id, seg, count(*) AS n FROM w GROUP BY ALL), x AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER (PARTITION BY project_id) AS a, unnest(range(n)) AS pos FROM s)
SELECT project_id, seg, pos, round(CAST((b + pos) * 60.0 AS DOUBLE) / a, 6) AS start_s, round(CAST((b + pos + 1) * 60.0 AS DOUBLE) / a, 6) AS end_s FROM x""".replace("unnest(range(n)) AS pos FROM s)", "FROM s), z AS (SELECT *, unnest(range(n)) AS pos FROM x)").replace("sum(n) OVER (PARTITION BY project_id) AS a, FROM", "sum(n) OVER (PARTITION BY project_id) AS a FROM").replace("AS end_s FROM x", "AS end_s FROM z"))
def win6_uniform_word_times(t):
    return O.uniform_word_times(timed_words(t).groupBy("project_id", "seg").agg(F.count("*").alias("n_words")), 60.0)


CUES = WORDS + ", cu AS (SELECT project_id, pos, word, display, start_s, least(CASE WHEN end_s - start_s < 0.38 THEN greatest(end_s, least(start_s + 0.38, coalesce(lead(start_s) OVER (PARTITION BY project_id ORDER BY pos), 90.0))) ELSE end_s END, 90.0) AS end_s FROM tw)"


def cues(t):
    return O.build_cues(timed_words(t).select("project_id", "pos", "word", "display", "start_s", "end_s"), 0.38, 90.0)


@query(f"WITH {CUES} SELECT project_id, pos, display, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM cu")
def win7_build_cues(t):
    return cues(t).selectExpr("project_id", "pos", "display", "round(start_s, 6) as start_s", "round(end_s, 6) as end_s")


@query(f"""WITH {CUES}, x AS (SELECT *, lead(start_s) OVER (PARTITION BY project_id ORDER BY pos) AS nx FROM cu)
SELECT project_id, pos, code FROM (SELECT project_id, pos, unnest([CASE WHEN display = '' THEN 'EMPTY' END, CASE WHEN contains(display, ' ') THEN 'MULTI_WORD' END, CASE WHEN display <> upper(display) THEN 'NOT_UPPER' END, CASE WHEN regexp_matches(display, '[.,!?;:]') THEN 'PUNCTUATION' END,
CASE WHEN end_s - start_s < 0.35 THEN 'TOO_FAST' END, CASE WHEN start_s < 0 OR end_s > 80 THEN 'OUT_OF_MEDIA' END, CASE WHEN end_s > nx + 0.000001 THEN 'OVERLAP' END]) AS code FROM x) WHERE code IS NOT NULL""")
def win8_validate_cues(t):
    return O.validate_cues(cues(t), 80.0, 0.35)


GROUPS = WORDS + r""", sg AS (SELECT project_id, sentence, CAST(min(pos) AS INT) AS first_pos, count(*) AS n_words, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(word, ' ' ORDER BY pos) AS text, max(e) = 1 AS closed
FROM (SELECT *, coalesce(sum(e) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM (SELECT *, CAST(regexp_matches(word, '[.!?]$') AS INT) AS e FROM tw)) GROUP BY project_id, sentence)"""


@query(f"WITH {GROUPS} SELECT project_id, CAST(sentence AS BIGINT) AS sentence, first_pos, n_words, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, text, closed FROM sg")
def win9_sentence_groups(t):
    return O.sentence_groups(timed_words(t)).withColumns({"start_s": F.round("start_s", 6), "end_s": F.round("end_s", 6)})


@query(f"""WITH {GROUPS}, x AS (SELECT *, coalesce(lag(end_s) OVER (PARTITION BY project_id ORDER BY sentence), 0) AS b FROM sg),
k AS (SELECT project_id, pos, start_s, CASE WHEN pos % 50 = 0 THEN end_s + 1 ELSE end_s END AS end_s, regexp_full_match(display, '[A-Z0-9]+') AS fine, display FROM tw WHERE pos % 101 <> 0), n0 AS (SELECT x.project_id, sentence, count(k.pos) AS n, min(k.start_s) AS f, max(k.end_s) AS t, bool_and(fine) AS fine, list_filter(list(display ORDER BY k.pos), lambda d: d <> '') AS shown FROM x LEFT JOIN k ON k.project_id = x.project_id AND k.pos >= first_pos AND k.pos < first_pos + n_words GROUP BY x.project_id, sentence),
n AS (SELECT *, CASE WHEN len(shown) > 0 THEN string_split(list_reduce(shown, lambda a, w: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 22 THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10)) ELSE [] END AS wrapped FROM n0)
SELECT project_id, CAST(sentence AS BIGINT) AS sentence, code FROM (SELECT x.project_id, x.sentence, unnest([CASE WHEN n < 2 THEN 'FEW_WORDS' END, CASE WHEN start_s < -0.01 OR end_s > 80.01 THEN 'OUT_OF_BOUNDS' END, CASE WHEN start_s < b - 0.01 OR end_s <= start_s THEN 'OVERLAP' END, CASE WHEN NOT closed THEN 'UNCLOSED' END, CASE WHEN f < start_s - 0.01 OR t > end_s + 0.01 THEN 'WORD_OUTSIDE' END, CASE WHEN NOT fine THEN 'CHARSET' END, CASE WHEN len(wrapped) > 2 OR len(wrapped) > 1 AND len(list_filter(wrapped, lambda l: NOT contains(l, ' '))) > 0 THEN 'OVERFLOW' END]) AS code
FROM x JOIN n ON n.project_id = x.project_id AND n.sentence = x.sentence) WHERE code IS NOT NULL""")
def win10_validate_groups(t):
    words = O.sentence_of(timed_words(t))
    shown = words.filter("pos % 101 <> 0").withColumn("end_s", F.expr("if(pos % 50 = 0, end_s + 1, end_s)"))
    return O.validate_groups(O.sentence_groups(timed_words(t)), shown, 80.0, "[A-Z0-9]+", 2)


def lagged(sql: str) -> str:
    return f"WITH {SHOTS} {sql}"


_P = "OVER (PARTITION BY project_id ORDER BY pos)"


_SAME = f"coalesce(asset % 10 = lag(asset % 10) {_P} AND abs(dur / 490 - lag(dur / 490) {_P}) < 0.3 AND abs(asset / 100 - lag(asset / 100) {_P}) < 0.3, false)"
_MOVED = "OVER (PARTITION BY project_id, mode <> 'view' ORDER BY pos)"


@query(lagged(f"""m AS (SELECT project_id, {_SAME} AS a, {_SAME} AND mode = 'view' AND lag(mode) {_P} = 'view' AS s, coalesce(mode <> 'view' AND mode = lag(mode) {_MOVED} AND mode = lag(mode, 2) {_MOVED}, false) AS b,
coalesce(asset % 10 = lag(asset % 10) {_P} AND asset % 10 = lag(asset % 10, 2) {_P}, false) AS c, mode <> 'view' AS m, dur > 200 AS h FROM sh),
o AS (SELECT project_id, count_if(a) AS same_frames, count_if(s) AS still_frames, count_if(b) AS same_curves, count_if(c) AS same_assets, count_if(h) AS long_holds, round(avg(CAST(m AS INT)::DOUBLE), 6) AS moving_share FROM m GROUP BY project_id)
SELECT *, array_to_string(list_filter([CASE WHEN same_assets > 0 THEN 'ASSET_COOLDOWN' END, CASE WHEN long_holds > 0 THEN 'LONG_HOLD' END, CASE WHEN same_curves > 0 THEN 'REPEATED_CURVE' END, CASE WHEN same_frames > 0 THEN 'REPEATED_FRAME' END,
CASE WHEN still_frames > 0 THEN 'REPEATED_STILL' END, CASE WHEN moving_share > 0.8 THEN 'RESTLESS' END], lambda x: x IS NOT NULL), ',') AS codes FROM o""").replace("FROM events) m AS", "FROM events), m AS"))
def win11_repetition_audit(t):
    s = shots(t).selectExpr("*", "asset % 10 as a", "dur / 490 as x", "asset / 100 as y")
    return O.repetition_audit(s, "a", "x", "y", "mode", "view", near=0.3, longest=200)


@query(lagged(f"SELECT project_id, min(pos) - 3 AS first_pos FROM (SELECT *, mode = lag(mode, 2) {_P} AND lag(mode) {_P} = lag(mode, 3) {_P} AND mode <> lag(mode) {_P} AS h FROM sh) WHERE h GROUP BY project_id"))
def win12_alternating_pattern(t):
    return O.alternating_pattern(shots(t), "mode")


ISLES = SHOTS + f", il AS (SELECT *, sum(c) {_P} AS island FROM (SELECT *, CASE WHEN mode = lag(mode) {_P} THEN 0 ELSE 1 END AS c FROM sh))"


@query(f"WITH {ISLES} SELECT project_id, round(max(s), 6) AS longest_s FROM (SELECT project_id, island, sum(dur) AS s FROM il GROUP BY ALL) GROUP BY project_id")
def win13_longest_same_run(t):
    return O.longest_same_run(shots(t), "mode")


@query(lagged(f"""SELECT project_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM (SELECT project_id, unnest([CASE WHEN mode IN ('click', 'error') AND lag(mode) {_P} IN ('click', 'error') THEN 'ADJACENT_STRONG' END, CASE WHEN mode = lag(mode) {_P} THEN 'REPEATED_MODE' END,
CASE WHEN mode IN ('signup') THEN 'FORBIDDEN' END, CASE WHEN (dur - 20) * lag(dur - 20) {_P} + (asset - 50) * lag(asset - 50) {_P} < -900 THEN 'REVERSAL' END]) AS code FROM sh) WHERE code IS NOT NULL GROUP BY project_id"""))
def win14_motion_audit(t):
    return O.motion_audit(shots(t), "mode", ["click", "error"], ["signup"], "dur - 20", "asset - 50", 900).select("project_id", "codes")


@query(laid(f"SELECT project_id, arg_min(pos, pos) AS pos, round(arg_min(g, pos), 6) AS gap FROM (SELECT *, lead(start_s) {_P} - end_s + CASE WHEN asset > 60 THEN 0.6 ELSE 0 END AS g FROM tl) WHERE g < -0.01 OR g > 0.5 GROUP BY project_id"))
def win15_boundary_gap(t):
    moved = timeline(t).withColumn("end_s", F.expr("if(asset > 60, end_s - 0.6D, end_s)"))
    return O.boundary_gap(moved)


@query(lagged("SELECT project_id, round(avg(dur), 4) AS mean_s, round(sum(dur), 4) AS total_s, count(DISTINCT (round(dur / 100, 2), asset)) AS crops FROM sh GROUP BY project_id"))
def agg6_shot_metrics(t):
    return O.shot_metrics(shots(t).withColumns({"x": F.col("dur") / 100, "y": F.col("asset")}), ["x", "y"])


@query(lagged("SELECT *, NOT (by_time > 0.35 AND signatures >= 2) AS passed FROM (SELECT project_id, round(max(s) / sum(s), 6) AS by_time, round(max(n) / sum(n), 6) AS by_count, count(*) AS signatures FROM (SELECT project_id, mode, sum(dur) AS s, count(*) AS n FROM sh GROUP BY ALL) GROUP BY project_id)"))
def agg7_dominance(t):
    return O.dominance(shots(t), "mode")


@query(lagged("SELECT project_id, asset, uses, cap FROM (SELECT *, greatest(2, CAST(floor(0.02 * sum(uses) OVER (PARTITION BY project_id)) AS BIGINT)) AS cap, count(*) OVER (PARTITION BY project_id) AS a FROM (SELECT project_id, asset, count(*) AS uses FROM sh GROUP BY ALL)) WHERE a > 1 AND uses > cap"))
def agg8_reuse_cap(t):
    return O.reuse_cap(shots(t), "asset", 0.02)


@query(lagged("SELECT project_id, round(sum(CASE WHEN mode IN ('view', 'error') THEN dur ELSE 0 END) / sum(dur), 6) AS static_ratio FROM sh GROUP BY project_id"))
def agg9_static_ratio(t):
    return O.static_ratio(shots(t), "mode in ('view', 'error')")


@query(lagged("""SELECT project_id, modes, mode AS top_mode, round(n / a, 6) AS top_share, j AS justified FROM (SELECT *, count(*) OVER (PARTITION BY project_id) AS modes, sum(n) OVER (PARTITION BY project_id) AS a, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, ascii(mode)) AS k
FROM (SELECT project_id, mode, count(*) AS n, bool_and(dur < 150) AS j FROM sh GROUP BY ALL)) WHERE k = 1"""))
def agg10_mode_diversity(t):
    return O.mode_diversity(shots(t), "mode", "dur < 150")


@query(f"WITH {CUES} SELECT project_id, round(avg(CASE WHEN len(regexp_extract_all(display, '\\S+')) = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS single_word, min(len(regexp_extract_all(display, '\\S+'))) AS least_words, max(len(regexp_extract_all(display, '\\S+'))) AS most_words, round(greatest(0.0::DOUBLE, max(end_s) - 70.0), 6) AS overflow_s FROM cu GROUP BY project_id")
def agg11_caption_stats(t):
    return O.caption_stats(cues(t), 70.0)


PROFILES = [("short", 500.0, 2500.0, 30, 60, 5.0, 60.0, 0.5, 0.6, 60.0, 150.0, 0.2, 0.35, 40.0, 60.0, 0.4), ("long", 2000.0, 6000.0, 50, 100, 10.0, 80.0, 0.7, 0.8, 70.0, 200.0, 0.2, 0.3, 30.0, 50.0, 0.5)]
_BOUNDS = "duration_min, duration_max, shot_min, shot_max, normal_min, normal_max, normal_ratio_min, normal_ratio_max, emphasis_min, emphasis_max, emphasis_ratio_min, emphasis_ratio_max, mean_min, mean_max, hard_cut_min"
_CUT = "CASE WHEN mode IN ('click', 'view') OR pos % 9 = 0 THEN 'cut' WHEN pos = 1 AND mode <> 'error' THEN 'none' ELSE 'fade' END"


@query(lagged(f"""SELECT project_id, profile_id, total_s, shots, normal_share, emphasis_share, mean_s, hard_cut_share, array_to_string(list_sort(list_filter([CASE WHEN total_s < duration_min THEN 'SHORT' END, CASE WHEN total_s > duration_max THEN 'LONG' END, CASE WHEN shots < shot_min THEN 'FEW_SHOTS' END, CASE WHEN shots > shot_max THEN 'MANY_SHOTS' END, CASE WHEN ins <> shots THEN 'OUT_OF_BAND' END,
CASE WHEN normal_share < normal_ratio_min THEN 'FEW_NORMAL' END, CASE WHEN normal_share > normal_ratio_max THEN 'MANY_NORMAL' END, CASE WHEN emphasis_share < emphasis_ratio_min THEN 'FEW_EMPHASIS' END, CASE WHEN emphasis_share > emphasis_ratio_max THEN 'MANY_EMPHASIS' END, CASE WHEN mean_s NOT BETWEEN mean_min AND mean_max THEN 'MEAN' END, CASE WHEN hard_cut_share < hard_cut_min THEN 'FEW_HARD_CUTS' END], lambda x: x IS NOT NULL)), ',') AS codes
FROM (SELECT project_id, p.*, round(sum(dur), 6) AS total_s, count(*) AS shots, round(avg(CAST(dur BETWEEN normal_min AND normal_max AS INT)), 6) AS normal_share, round(avg(CAST(dur BETWEEN emphasis_min AND emphasis_max AS INT)), 6) AS emphasis_share, round(avg(dur), 6) AS mean_s, round(avg(CAST(tr = CASE WHEN pos = 1 THEN 'none' ELSE 'cut' END AS INT)), 6) AS hard_cut_share, count_if(dur BETWEEN normal_min AND normal_max) + count_if(dur BETWEEN emphasis_min AND emphasis_max) AS ins
FROM (SELECT *, {_CUT} AS tr FROM sh), (VALUES {', '.join(map(str, PROFILES))}) p(profile_id, {_BOUNDS}) GROUP BY ALL)"""))
def agg12_cadence_bands(t):
    schema = "profile_id string, " + ", ".join(f"{c} {'int' if c.startswith('shot') else 'double'}" for c in _BOUNDS.split(", "))
    return O.cadence_bands(shots(t).withColumn("transition", F.expr(_CUT)), t.spark.createDataFrame(PROFILES, schema))


def chunked(size: int, overlap: int, inner: str, key: str, order: str) -> str:
    step = size - overlap
    return f"SELECT *, unnest(range(greatest(0, CAST(ceil((r - {size - 1}) / {step}) AS INT)), least(CASE WHEN n <= {size} THEN 0 ELSE CAST(ceil((n - {size}) / {step}) AS INT) END, CAST(floor(r / {step}) AS INT)) + 1)) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS r, count(*) OVER (PARTITION BY {key}) AS n FROM {inner})"


@query(f"SELECT source, doc_id, chunk, repeated FROM ({chunked(12, 3, '(SELECT source, doc_id, count(*) OVER (PARTITION BY source, sha256(text)) > 1 AS repeated FROM documents)', 'source', 'doc_id')})")
def win16_overlapping_chunks(t):
    named = t.documents.select("source", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("id"))
    return O.overlapping_chunks(named, 12, 3, "source", "doc_id", "id").select("source", "doc_id", "chunk", "repeated")


@query("""SELECT doc_id, tile, y0, y1, CASE WHEN tile > 0 THEN 200 ELSE 0 END AS above, CASE WHEN tile < last THEN 200 ELSE 0 END AS below, sha256(concat_ws('|', doc_id, n_chars, 1000, 200, tile, y0, y1)) AS digest
FROM (SELECT *, tile * 800 AS y0, least(tile * 800 + 1000, n_chars) AS y1 FROM (SELECT doc_id, n_chars, last, unnest(range(last + 1)) AS tile FROM (SELECT *, CASE WHEN n_chars <= 1000 THEN 0 ELSE CAST(ceil((n_chars - 1000) / 800) AS INT) END AS last FROM documents WHERE n_chars > 0)))""")
def win17_plan_tiles(t):
    return O.plan_tiles(t.documents, "doc_id", "n_chars", 1000, 200)


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) x WHERE n <= 7 OR r IN (floor(0 * n / 7), floor(1 * n / 7), floor(2 * n / 7), floor(3 * n / 7), floor(4 * n / 7), floor(5 * n / 7), floor(6 * n / 7))")
def win19_stride_sample(t):
    return O.stride_sample(t.documents, 7, "source", "doc_id").select("source", "doc_id")


@query("SELECT o_custkey, bucket, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, bucket ORDER BY o_totalprice DESC, i, o_orderkey DESC) AS k FROM (SELECT *, CAST(floor(((i + 1) * least(4, n) - 1) / n) AS INT) AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders))) WHERE k = 1")
def win20_bucket_best(t):
    return O.bucket_best(t.orders, 4, "o_totalprice", "o_orderkey", "o_custkey", "o_orderdate, o_orderkey").select("o_custkey", "bucket", "o_orderkey")


@query("""WITH n AS (SELECT n_regionkey, c_nationkey, count(*) AS w, 20 + c_nationkey % 3 AS cap FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
q AS (SELECT *, w * (100 - count(*) OVER (PARTITION BY n_regionkey)) / sum(w) OVER (PARTITION BY n_regionkey) AS q FROM n), f AS (SELECT *, least(cap, 1 + CAST(floor(q) AS INT)) AS f, row_number() OVER (PARTITION BY n_regionkey ORDER BY round(q - floor(q), 9) DESC, c_nationkey) AS k FROM q),
t AS (SELECT n_regionkey, CAST(100 - sum(f) AS INT) AS rest, sum(cap) >= 100 AS fits FROM f GROUP BY n_regionkey),
u AS (SELECT n_regionkey, c_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY turn, k) AS r FROM (SELECT *, unnest(range(1, cap - f + 1)) AS turn FROM f)),
m AS (SELECT n_regionkey, c_nationkey, count(*) AS more FROM u JOIN t USING (n_regionkey) WHERE r <= rest GROUP BY ALL)
SELECT n_regionkey, c_nationkey, CASE WHEN fits THEN f + coalesce(more, 0) END AS share FROM f JOIN t USING (n_regionkey) LEFT JOIN m USING (n_regionkey, c_nationkey)""")
def win22_apportion(t):
    weights = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.count("*").alias("w"))
    return O.apportion(weights.withColumn("cap", F.expr("20 + c_nationkey % 3")), 100, "w", "c_nationkey", "n_regionkey", "cap")


@query(lagged("""SELECT project_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY dur DESC, event_id) AS k FROM (SELECT *, CAST(ceil(0.25 * count(*) OVER (PARTITION BY project_id)) AS INT) AS t, row_number() OVER (PARTITION BY project_id, mode ORDER BY dur DESC, event_id) AS s FROM sh) WHERE s <= greatest(1, floor(0.4 * t))) WHERE k <= t"""))
def win23_emphasis_pick(t):
    return O.emphasis_pick(shots(t), "dur", "mode", "event_id").select("project_id", "event_id")


@query(f"""WITH {ISLES}, g AS (SELECT project_id, island, any_value(mode) AS section, sum(dur) AS l FROM il GROUP BY project_id, island), r AS (SELECT *, round(l * 600 / sum(l) OVER (PARTITION BY project_id), 3) AS r FROM g)
SELECT project_id, CAST(island AS BIGINT) AS island, section, round(CASE WHEN lead(island) OVER (PARTITION BY project_id ORDER BY island) IS NULL THEN 600 - coalesce(sum(r) OVER (PARTITION BY project_id ORDER BY island ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) ELSE r END, 6) AS share_s FROM r""")
def win24_section_share(t):
    return O.section_share(shots(t), "mode", 600.0)


VERSIONS = "v AS (SELECT o_custkey AS project_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS approved_at, o_orderpriority, o_orderkey FROM orders)"


def versions(t):
    return t.orders.selectExpr("o_custkey as project_id", "row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version", "if(o_orderstatus = 'F', o_orderdate, null) as approved_at", "o_orderpriority", "o_orderkey")


@query(f"WITH {VERSIONS} SELECT project_id, version, approved_at IS NOT NULL AS approved FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY approved_at IS NULL, version DESC) AS k FROM v) WHERE k = 1")
def win25_current_version(t):
    return O.current_version(versions(t), "project_id", "version", "approved_at").selectExpr("project_id", "version", "approved_at is not null as approved")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def win26_latest_snapshot(t):
    return O.latest(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query(f"WITH {VERSIONS}, o AS (SELECT project_id, max(version) AS top FROM v WHERE approved_at IS NOT NULL GROUP BY ALL) SELECT v.project_id, o_orderkey, coalesce(top, 0) + row_number() OVER (PARTITION BY v.project_id ORDER BY o_orderkey) AS version FROM v LEFT JOIN o USING (project_id) WHERE approved_at IS NULL")
def win27_next_version(t):
    v = versions(t)
    return O.next_version(v.filter("approved_at is null").select("project_id", "o_orderkey"), v.filter("approved_at is not null"), "project_id", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, code FROM (SELECT l_orderkey, l_linenumber, l_partkey, unnest([CASE WHEN l_linenumber <= lag(l_linenumber) OVER w THEN 'NOT_INCREASING' END, CASE WHEN l_linenumber <> row_number() OVER w THEN 'GAP' END, CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1 THEN 'DUPLICATE_ID' END, CASE WHEN l_quantity >= 45.5 THEN 'BAD_BOUNDS' END]) AS code FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE code IS NOT NULL""")
def win28_order_contract(t):
    return O.order_contract(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "45.5D")


@query(f"WITH {ISLES} SELECT project_id, CAST(island AS BIGINT) AS island, any_value(mode) AS evidence, min(pos) AS first_pos, max(pos) AS last_pos, string_agg(CAST(event_id AS VARCHAR), ' ' ORDER BY pos) AS text FROM il GROUP BY project_id, island")
def win29_coalesce_adjacent(t):
    return O.coalesce_adjacent(shots(t).withColumn("t", F.col("event_id").cast("string")), "mode", "t", "cast(asset as string)").drop("claims")


@query("SELECT vec_id, round(greatest(0.0, 1 - list_sum(list_transform(list_zip(embedding, b), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))), 6) AS similarity FROM (SELECT vec_id, embedding[1:8] AS embedding, lag(embedding[1:8]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)".replace("round(greatest", "CASE WHEN b IS NULL THEN NULL ELSE round(greatest").replace(", 6) AS similarity", ", 6) END AS similarity"))
def win33_adjacent_similarity(t):
    return O.adjacent_similarity(t.embeddings.withColumn("f", F.slice("embedding", 1, 8)), "label", "vec_id", "f").select("vec_id", F.when(F.expr("similarity is not null"), F.col("similarity")).alias("similarity"))


@query("""WITH c AS (SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, value < 30 AS passed FROM events), o AS (SELECT user_id, arg_max(value > 10, (ts, event_id)) AS p FROM events WHERE event_type = 'click' GROUP BY user_id)
SELECT event_id, severity, CASE WHEN severity = 'error' OR p IS NULL THEN passed ELSE p END AS passed, severity <> 'error' AND p IS NOT NULL AS overridden FROM c LEFT JOIN o USING (user_id)""")
def win34_override_latest(t):
    checks = t.events.selectExpr("event_id", "user_id", "if(event_type = 'error', 'error', 'warning') as severity", "value < 30 as passed")
    last = O.latest(t.events.filter("event_type = 'click'"), ["user_id"], ["ts", "event_id"]).selectExpr("user_id", "'reviewer' as actor", "ts as at", "value > 10 as passed")
    merged = checks.join(last.select("user_id", "actor", "at", F.col("passed").alias("verdict")), "user_id", "left")
    overrides = merged.filter("actor is not null").selectExpr("event_id", "actor", "at", "verdict as passed")
    return O.override_latest(checks.select("event_id", "severity", "passed"), overrides, "event_id")


@query(f"WITH {VERSIONS} SELECT project_id, version FROM (SELECT *, coalesce(lag(approved_at IS NOT NULL) OVER w, false) AND o_orderpriority IS DISTINCT FROM lag(o_orderpriority) OVER w AS x FROM v WINDOW w AS (PARTITION BY project_id ORDER BY version)) WHERE x")
def win35_identity_change(t):
    return O.identity_change(versions(t).withColumn("ok", F.col("approved_at").isNotNull()), "project_id", "version", "ok", ["o_orderpriority"])


@query("""WITH n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC, l_extendedprice DESC) AS back FROM lineitem)
SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_linenumber) AS k FROM n WHERE back > 1) WHERE k <= n - 3""")
def win36_removable(t):
    return O.removable(t.lineitem, "l_orderkey", 3, ["l_linenumber", "l_quantity", "l_extendedprice"], ["l_quantity", "l_extendedprice", "l_linenumber"]).select("l_orderkey", "l_linenumber")


_CURVE = "CASE mode WHEN 'view' THEN 'slow_push_in' WHEN 'click' THEN 'slow_pull_out' WHEN 'error' THEN 'static' WHEN 'purchase' THEN 'orbit' ELSE 'pan_diagonal' END"


@query(lagged(f"""c AS (SELECT project_id, pos, {_CURVE} AS curve, greatest(0.05, least(0.95, dur / 490)) AS x0, greatest(0.05, least(0.95, asset / 100)) AS y0, greatest(0.05, least(0.95, asset / 100)) AS x1, greatest(0.05, least(0.95, dur / 100)) AS y1, unnest(range(6)) AS frame FROM sh),
u AS (SELECT *, (frame / 5.0::DOUBLE) * (frame / 5.0::DOUBLE) * (3 - 2 * (frame / 5.0::DOUBLE)) AS u FROM c)
SELECT project_id, pos, frame, round(CASE WHEN curve IN ('static', 'orbit') THEN x0 ELSE x0 + (x1 - x0) * u END, 9) AS x, round(CASE WHEN curve IN ('static', 'orbit') THEN y0 ELSE y0 + (y1 - y0) * u END, 9) AS y,
round(CASE curve WHEN 'slow_push_in' THEN 1 + 0.06 * u WHEN 'slow_pull_out' THEN 1.06 - 0.06 * u WHEN 'static' THEN 1 WHEN 'orbit' THEN 1.02 ELSE 1.04 END, 9) AS scale FROM u""").replace("FROM events) c AS", "FROM events), c AS"))
def jsn17_sample_curve(t):
    return O.sample_curve(shots(t).selectExpr("project_id", "pos", f"{_CURVE} as curve", "dur / 490 as x0", "asset / 100 as y0", "asset / 100 as x1", "dur / 100 as y1"), 6)


_NAMED = "['pan', 'zoom', 'hold', 'cut']"


@query(lagged(f"""h AS (SELECT *, CAST(('0x' || substr(sha256('seed:' || pos || ':' || mode), 1, 8))::BIGINT % 4 AS INT) AS k, [{_NAMED}[lag(asset) {_P} % 4 + 1], {_NAMED}[lag(asset, 2) {_P} % 4 + 1]] AS past FROM sh)
SELECT project_id, pos, list_filter([{_NAMED}[k + 1], {_NAMED}[(k + 1) % 4 + 1], {_NAMED}[(k + 2) % 4 + 1], {_NAMED}[(k + 3) % 4 + 1]], lambda o: NOT coalesce(list_contains(past, o), false))[1] AS choice FROM h""").replace("FROM events) h AS", "FROM events), h AS"))
def jsn18_stable_choice(t):
    options = ["pan", "zoom", "hold", "cut"]
    listed = "array('pan', 'zoom', 'hold', 'cut')"
    w = "over (partition by project_id order by pos)"
    past = shots(t).withColumn("past", F.expr(f"array_compact(array(get({listed}, lag(asset) {w} % 4), get({listed}, lag(asset, 2) {w} % 4)))"))
    return O.stable_choice(past, "seed", "mode", options, "past").select("project_id", "pos", "choice")


@query("""WITH e AS (SELECT user_id AS project_id, epoch_us(ts) AS "at" FROM events WHERE event_type = 'error'), c AS (SELECT DISTINCT user_id AS project_id, epoch_us(ts) AS cut FROM events WHERE event_type = 'click'),
n AS (SELECT e.project_id, "at", arg_min(cut, (abs("at" - cut), cut)) AS cut FROM (SELECT DISTINCT * FROM e) e LEFT JOIN c USING (project_id) GROUP BY ALL) SELECT e.project_id, e."at", n.cut, abs(e."at" - n.cut) AS distance FROM e JOIN n ON e.project_id = n.project_id AND e."at" = n."at" """)
def joi11_nearest_boundary(t):
    at = t.events.selectExpr("user_id as project_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) as at", "event_type")
    return O.nearest_boundary(at.filter("event_type = 'error'"), at.filter("event_type = 'click'"))


SLOTS = ", slots AS (SELECT project_id, s AS slot, s * 100.0 AS start_s, s * 100.0 + 100 AS end_s FROM (SELECT DISTINCT project_id FROM tl), (SELECT unnest(range(10)) AS s))"


def slots(t):
    return shots(t).select("project_id").distinct().selectExpr("project_id", "explode(sequence(0, 9)) as slot").selectExpr("project_id", "slot", "slot * 100.0D as start_s", "slot * 100.0D + 100 as end_s")


@query(f"WITH {LAID.format(gap='0.25')} {SLOTS} SELECT project_id, slot, beat FROM (SELECT t.project_id, slot, t.pos AS beat, row_number() OVER (PARTITION BY t.project_id, slot ORDER BY asset % 3 DESC, round(t.end_s - t.start_s, 6) DESC, t.pos) AS k FROM tl t JOIN slots s ON t.project_id = s.project_id AND t.end_s > s.start_s AND t.start_s < s.end_s) WHERE k = 1")
def joi9_interval_overlap(t):
    return O.interval_overlap(timeline(t, 0.25).selectExpr("project_id", "pos as beat", "asset % 3 as priority", "start_s", "end_s"), slots(t), 100.0)


@query(f"WITH {LAID.format(gap='0.25')} {SLOTS} SELECT t.project_id, slot AS beat, pos FROM tl t JOIN slots s ON t.project_id = s.project_id AND t.start_s >= s.start_s AND t.start_s < s.end_s")
def joi10_window_membership(t):
    return O.window_membership(timeline(t, 0.25).selectExpr("project_id", "pos", "start_s as at"), slots(t).withColumnRenamed("slot", "beat"), 100.0)


@query(f"WITH {LAID.format(gap='0.25')} {SLOTS} SELECT project_id, pos FROM tl t WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE t.project_id = s.project_id AND t.start_s >= s.start_s - 1e-9 AND t.end_s <= s.end_s + 1e-9)")
def joi24_contained_in_one(t):
    return O.contained_in_one(timeline(t, 0.25).select("project_id", "pos", "start_s", "end_s"), slots(t), 100.0).select("project_id", "pos")


@query(f"""WITH {CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY pos) AS n, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b FROM cu WHERE trim(display) <> '')
SELECT project_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', a // 3600000, (a // 60000) % 60, (a // 1000) % 60, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, (b // 60000) % 60, (b // 1000) % 60, b % 1000) || chr(10) || display, chr(10) || chr(10) ORDER BY n) AS srt FROM n GROUP BY project_id""")
def src11_export_srt(t):
    return O.caption_files(O.export_srt(cues(t)))
