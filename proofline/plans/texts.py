"""Queries of the text family."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from proofline.functions import lexicons as L
from proofline.functions import text as T
from proofline.operators import integrity as I
from proofline.operators import texts as O
from proofline.plans.registry import query

CUES = ["the", "and", "of"]
STOP = ["The", "And", "For", "Les", "Die"]
NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
PIECES = r"""string_split_regex(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01|\n+')"""
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
WRAPPED = r"string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\s*\n')"
UNWRAP = f"array_to_string(list_filter(list_transform({WRAPPED}, lambda p: {STRIP}), lambda p: p <> ''), chr(10) || chr(10))".format(r"regexp_replace(p, '\s*\n\s*', ' ', 'g')")
SENT = f"list_filter(list_transform({PIECES.format(UNWRAP)}, lambda s: {STRIP.format('s')}), lambda s: length(s) > 12)"
SENT0 = f"list_filter(list_transform({PIECES.format('text')}, lambda s: trim(s)), lambda s: length(s) > 0)"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
LEXICAL = r"regexp_extract_all(replace(replace(lower(replace(upper(replace(text, 'ı', chr(57344))), 'ẞ', 'SS')), 'ς', 'σ'), chr(57344), 'ı'), '[\p{L}\p{N}]+')"
NARR = "len(regexp_extract_all({}, '[A-Za-z0-9]+(?:[''’][A-Za-z0-9]+)?'))"
DISPLAY = r"replace(upper(trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g'))), 'ẞ', 'SS')"


def scalar(name: str, make, sql: str, tab: str = "documents", key: str = "doc_id", col: str = "out") -> None:
    @query(f"SELECT {key}, {sql} AS {col} FROM {tab}", name)
    def run(t):
        return getattr(t, tab).select(*key.split(", "), make(F.col("text") if "text" in getattr(t, tab).columns else None).alias(col))


scalar("txt1_normalise_text", T.normalise_text, NORM)
scalar("txt2_unwrap_paragraphs", T.unwrap_paragraphs, UNWRAP)
scalar("txt6_display_text", T.display_text, DISPLAY.format("text"))
scalar("txt9_cue_score", lambda c: T.cue_score(c, ["there", "where", "que"]), "CAST(contains(lower(text), 'there') AS INT) + CAST(contains(lower(text), 'where') AS INT) + CAST(contains(lower(text), 'que') AS INT)")
#: A phrase for each row by its number, behind its text, so that each branch of a rule has rows.
PHRASES = ["It turns out so.", "They must go.", "Suddenly, he left.", "", "He ran with a sword and hit the dragon.", "Subscribe! An epic battle.", "Orang itu dan yang ini sudah pergi dari pada akan untuk karena."]
SAID = "text || ' ' || " + repr(PHRASES) + "[{} % 7 + 1]"


def said(key: str) -> Column:
    return F.concat(F.col("text"), F.lit(" "), F.get(F.array(*map(F.lit, PHRASES)), (F.col(key) % 7).cast("int")))


def _has(words: list[str], text: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{w}')" for w in words) + ")"


_PLAIN = "list_distinct(regexp_extract_all(lower({}), '[a-z]+'))"
_DOC, _TURN = SAID.format("doc_id"), SAID.format("conv_id")
scalar("txt10_classify_event", lambda _: T.classify_event(said("doc_id")), f"CASE WHEN {_has(L.TWIST_CUES, _DOC)} THEN 'twist' WHEN {_has(L.CONFLICT_CUES, _DOC)} THEN 'conflict' WHEN {_has(L.CLIFF_CUES, _DOC)} THEN 'cliffhanger' ELSE 'event' END")
_TAGGED = ", ".join(f"CASE WHEN list_has_any({_PLAIN.format(_TURN)}, {words!r}) THEN '{tag}' END" for tag, words in {**L.TAG_WORDS, "attack": L.ATTACK_WORDS}.items())
scalar("txt12_topic_tags", lambda _: F.array_join(T.narration_tags(said("conv_id")), ","), f"array_to_string(list_sort(list_filter([{_TAGGED}], lambda x: x IS NOT NULL)), ',')", "conversations", "conv_id, turn")
scalar("txt15_guess_language", lambda _: T.narration_language(said("doc_id")), f"CASE WHEN len(list_intersect({_PLAIN.format(_DOC)}, {L.ENGLISH!r})) > len(list_intersect({_PLAIN.format(_DOC)}, {L.INDONESIAN!r})) THEN 'en' ELSE 'id' END")
_KEPT = rf"trim(array_to_string(list_filter(string_split_regex(regexp_replace({_DOC}, '([.!?])\s+', '\1' || chr(1), 'g'), '\x01'), lambda s: NOT regexp_matches(s, '(?i){L.REVEAL}')), ' '), chr(32) || chr(10))"
scalar("txt18_drop_reveal_sentences", lambda _: T.without_reveals(said("doc_id"), F.expr("if(doc_id % 4 = 0, 'full', 'minimal')")), f"CASE WHEN doc_id % 4 = 0 THEN {_DOC} WHEN {_KEPT} = '' THEN '{L.TEASE}' ELSE {_KEPT} END")
scalar("txt20_replace_terms", lambda c: T.replace_terms(c, [("the", "ze"), ("ze", "za"), ("and", "und")]), r"regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'ze', 'g'), '(?i)\bze\b', 'za', 'g'), '(?i)\band\b', 'und', 'g')")
scalar("txt22_redact_secrets", lambda c: T.redact(c, ['token = "[0-9a-f]+"', "[A-Za-z0-9.]+@[a-z0-9.]+"]), r"""substring(trim(regexp_replace(regexp_replace(regexp_replace(text, 'token = "[0-9a-f]+"', '[redacted]', 'g'), '[A-Za-z0-9.]+@[a-z0-9.]+', '[redacted]', 'g'), '\s+', ' ', 'g')), 1, 300)""")
scalar("txt26_strip_code_fence", lambda c: T.strip_code_fence(F.concat(F.lit("```json\n"), c, F.lit("\n```"))), r"regexp_replace(regexp_replace(trim('```json' || chr(10) || text || chr(10) || '```'), '^```[A-Za-z]*\s*', ''), '\s*```$', '')")
scalar("txt23_mask_tail", lambda _: T.mask_tail(F.col("c_name"), 4), "CASE WHEN coalesce(c_name, '') = '' THEN '<unset>' WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END", "customer", "c_custkey")
scalar("txt24_normalise_url", lambda _: T.normalise_url(F.col("url"), 60), "CASE WHEN regexp_matches(url, '^https?://[^/?#]+') AND length(url) <= 60 THEN rtrim(regexp_replace(url, '[?#].*$', ''), '/') END", "pages", "page_id")


@query(r"""WITH p AS (SELECT page_id, list_filter(string_split(trim(replace(regexp_replace(url, '[?#].*$', ''), '\', '/'), '/'), '/'), lambda p: p NOT IN ('', '.')) AS ps FROM pages),
s AS (SELECT page_id, ps, coalesce(regexp_replace(ps[-1], '^(.+)\.[^.]+$', '\1'), '') AS stem FROM p),
n AS (SELECT *, CASE WHEN contains(stem, '__') THEN regexp_replace(stem, '(?i)[_-]p[0-9]+$', '') ELSE regexp_replace(stem, '(?i)[_-]p?[0-9]+$', '') END AS cut FROM s)
SELECT page_id, array_to_string(list_append(ps[:-2], coalesce(nullif(regexp_replace(cut, '[_-]+$', ''), ''), nullif(stem, ''), 'unknown')), '/') AS out FROM n""")
def txt21_source_family(t):
    return t.pages.select("page_id", T.source_family(F.regexp_replace("url", r"[?#].*$", "")).alias("out"))


SENTENCES = f"SELECT doc_id, i - 1 AS pos, s[i] AS s FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents))"
_SHORT = r"CASE WHEN len(regexp_extract_all({0}, '\S+')) <= 8 THEN regexp_replace({0}, '^\s+|\s+$', '', 'g') ELSE regexp_replace(array_to_string(regexp_extract_all({0}, '\S+')[1:8], ' '), '[,;:.]+$', '') || '...' END"


@query(
    "WITH s AS (" + SENTENCES + r"""),
a AS (SELECT *, regexp_replace(regexp_replace(s, '(?i)^(?:The|And|In)(?:[,\s]+|([^\p{L}\p{N}_])|$)', '\1'), '(?i)(^|[^\p{L}\p{N}_])(?:that|which|of)(?:[^\p{L}\p{N}_].*)?$', '\1') AS t FROM s),
b AS (SELECT *, regexp_replace(t, '[ .,;:]+$', '') AS u FROM a),
c AS (SELECT *, list_distinct(regexp_extract_all(lower(u), '[a-z]+')) AS k, list_filter(regexp_extract_all(u, '[\p{L}\p{N}_''-]+|[.,!?]'), lambda w, i: w NOT IN ('.', ',', '!', '?') AND (i = 1 OR lower(w) NOT IN ('the', 'a', 'de', 'la')))[1:8] AS kept FROM b)
SELECT doc_id, pos, CASE WHEN len(list_intersect(k, ['and', 'was', 'is'])) > len(list_intersect(k, ['de', 'la', 'et'])) THEN CASE WHEN u = '' THEN '' ELSE regexp_replace(""" + _SHORT.format("u") + r""", '\.+$', '') || '.' END
  WHEN len(kept) = 0 THEN """ + _SHORT.format("s") + r""" ELSE upper(left(array_to_string(kept, ' '), 1)) || substring(array_to_string(kept, ' '), 2) END AS clause FROM c"""
)
def txt16_compress_clause(t):
    clause = T.compress_clause(F.col("sentence"), ["The", "And", "In"], ["that", "which", "of"], ["the", "a", "de", "la"], (["and", "was", "is"], ["de", "la", "et"]), 8)
    return O.split_sentences(t.documents, "doc_id").select("doc_id", "pos", clause.alias("clause"))


@query(f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents))")
def txt3_split_sentences(t):
    return O.split_sentences(t.documents, "doc_id")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, {NARR.format('text')} AS narration_words FROM documents")
def txt4_word_count(t):
    return t.documents.select("doc_id", T.word_count(F.col("text")).alias("words"), T.narration_word_count(F.col("text")).alias("narration_words"))


STYLES = [("user", 2.4), ("assistant", 2.9)]


@query(f"SELECT conv_id, turn, w AS words, CASE WHEN p IS NULL THEN NULL WHEN w = 0 THEN 0.0 ELSE round(greatest(0.6, w / p), 2) END AS seconds FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+')) AS w, CASE role WHEN 'user' THEN 2.4::DOUBLE WHEN 'assistant' THEN 2.9::DOUBLE END AS p FROM conversations)")
def txt5_estimate_duration(t):
    styles = t.spark.createDataFrame(STYLES, "role string, per_second double")
    return O.estimate_duration(t.conversations, styles, style="role").select("conv_id", "turn", "words", F.when(F.col("words").isNotNull(), F.col("seconds")).alias("seconds"))


@query(f"SELECT conv_id, turn, i - 1 AS pos, word, d AS display FROM (SELECT conv_id, turn, i, ws[i] AS word, {DISPLAY.format('ws[i]')} AS d FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\\S+') AS ws FROM conversations))) WHERE d <> ''")
def txt7_spoken_tokens(t):
    return O.spoken_tokens(t.conversations, ["conv_id", "turn"])


@query(r"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS ws FROM conversations),
l AS (SELECT conv_id, turn, CASE WHEN len(ws) > 0 THEN string_split(list_reduce(ws, lambda a, w: CASE WHEN length(string_split(a, chr(10))[-1]) + 1 + length(w) <= 42 THEN a || ' ' || w ELSE a || chr(10) || w END), chr(10)) ELSE [] END AS ls FROM w)
SELECT conv_id, turn, len(ls) AS n_lines, list_max(list_transform(ls, lambda l: length(l))) AS longest, len(ls) <= 2 AS fits FROM l""")
def txt8_wrap_lines(t):
    lines = T.wrap_lines(F.col("text"), 42)
    return t.conversations.select("conv_id", "turn", F.size(lines).alias("n_lines"), F.array_max(F.transform(lines, lambda x: F.length(x))).alias("longest"), (F.size(lines) <= 2).alias("fits"))


LEXICON = [("was", "reveal", 1), ("that", "turn", 2), ("des", "turn", 2), ("the", "scene", 3), ("la", "scene", 3)]
KINDS = [("reveal", "surprise", "awe", 0.1, None), ("turn", "tension", "fear", 0.2, None), ("scene", "calm", "rest", 0.0, "user"), ("event", "inform", "neutral", 0.0, "assistant")]


@query(f"""WITH w AS (SELECT DISTINCT conv_id, turn, unnest({TOKENS}) AS word FROM conversations), l(word, kind, p) AS (VALUES ('was', 'reveal', 1), ('that', 'turn', 2), ('des', 'turn', 2), ('the', 'scene', 3), ('la', 'scene', 3)),
f AS (SELECT conv_id, turn, arg_min(kind, p) AS k FROM w JOIN l USING (word) GROUP BY ALL)
SELECT conv_id, turn, kind, CASE kind WHEN 'reveal' THEN 'surprise' WHEN 'turn' THEN 'tension' WHEN 'scene' THEN 'calm' WHEN 'event' THEN 'inform' END AS intent,
  CASE kind WHEN 'reveal' THEN 'awe' WHEN 'turn' THEN 'fear' WHEN 'scene' THEN 'rest' WHEN 'event' THEN 'neutral' END AS emotion, CASE kind WHEN 'reveal' THEN 0.1::DOUBLE WHEN 'turn' THEN 0.2 ELSE 0.0 END AS offset_s
FROM (SELECT c.conv_id, c.turn, coalesce(k, CASE role WHEN 'user' THEN 'scene' WHEN 'assistant' THEN 'event' END, 'event') AS kind FROM conversations c LEFT JOIN f USING (conv_id, turn))""")
def txt11_beat_kind(t):
    lexicon = t.spark.createDataFrame(LEXICON, "word string, kind string, priority int")
    kinds = t.spark.createDataFrame(KINDS, "kind string, intent string, emotion string, offset_s double, default_section string")
    return O.beat_kind(t.conversations, lexicon, kinds, ["conv_id", "turn"], section="role")


@query(r"""WITH w AS (SELECT conv_id, turn, i - 1 AS pos, ws[i] AS word FROM (SELECT conv_id, turn, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+') AS ws FROM conversations))),
l(w2, tag, r, impact) AS (VALUES ('the', 'scene', 2, false), ('the', 'action', 1, true), ('was', 'past', 3, false), ('des', 'scene', 2, true))
SELECT conv_id, turn, pos, word, tag, impact, pos * 0.5::DOUBLE AS start_s, pos * 0.5::DOUBLE + 0.5 AS end_s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY r, tag) AS n FROM w JOIN l ON lower(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')) = w2) WHERE n = 1""")
def txt13_timed_event_words(t):
    words = t.conversations.select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("pos", "word"))
    words = words.withColumns({"start_s": F.col("pos") * 0.5, "end_s": F.col("pos") * 0.5 + 0.5})
    lexicon = t.spark.createDataFrame([("the", "scene", 2, False), ("the", "action", 1, True), ("was", "past", 3, False), ("des", "scene", 2, True)], "word string, tag string, rank int, impact boolean")
    return O.timed_event_words(words, lexicon, ["conv_id", "turn"])


EN, FR = ["the", "and", "was"], ["des", "les", "qui"]
_L = "len(list_intersect(" + TOKENS.replace("{", "{{").replace("}", "}}") + ", {}))"


@query(f"""SELECT doc_id, o AS own_hits, f AS foreign_hits, NOT (o > 0 AND f > 0) AS passed FROM (SELECT doc_id, CASE lang WHEN 'en' THEN {_L.format("['the', 'and', 'was']")} WHEN 'fr' THEN {_L.format("['des', 'les', 'qui']")} ELSE 0 END AS o,
CASE lang WHEN 'en' THEN {_L.format("['des', 'les', 'qui', 'an']")} WHEN 'fr' THEN {_L.format("['the', 'and', 'was', 'on']")} ELSE 0 END AS f FROM documents)""")
def txt14_mixed_language(t):
    return O.mixed_language(t.documents, "doc_id", {"en": EN, "fr": FR}, {"en": [*FR, "an"], "fr": [*EN, "on"]})


@query(r"""SELECT doc_id, min(i) - 1 AS pos, line FROM (SELECT doc_id, i, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE line <> '' GROUP BY doc_id, line""")
def txt17_distinct_lines(t):
    return O.distinct_lines(t.documents, "doc_id")


@query(f"""WITH s AS (SELECT doc_id, i - 1 AS pos, s[i] AS sentence, sum({NARR.format('s[i]')}) OVER (PARTITION BY doc_id ORDER BY i) / 2.5 AS t FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents)))
SELECT doc_id, count(*) AS n_kept, round(max(t), 6) AS seconds, string_agg(sentence, ' ' ORDER BY pos) AS text FROM s WHERE t <= 30 OR pos = 0 GROUP BY doc_id""")
def txt19_trim_to_budget(t):
    return O.trim_to_budget(t.documents, "doc_id", 30.0, 2.5)


@query(r"""SELECT conv_id, substring(trim(regexp_replace(f, '\s+', ' ', 'g')), 1, 60) AS title, substring(f, 1, 280) AS lead, credits, array_to_string(tags[1:15], ',') AS tags FROM (SELECT conv_id, f, credits, (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i) GROUP BY w)) AS tags
FROM (SELECT conv_id, arg_min(text, turn) AS f, string_agg(DISTINCT role, '; ' ORDER BY role) AS credits, regexp_extract_all(lower(arg_min(text, turn)), '[a-z]{4,}') AS ws FROM conversations GROUP BY conv_id))""")
def txt25_draft_metadata(t):
    return O.draft_metadata(t.conversations, "conv_id", "turn", "text", "role").withColumn("tags", F.when(F.col("tags") != "", F.col("tags")))


RIGHTS = "documents LEFT JOIN labels USING (doc_id)"
STATUS = "CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'verified' WHEN quality IS NOT NULL THEN 'declared' ELSE 'undeclared' END"


def with_rights(t):
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "verified").when(F.col("quality").isNotNull(), "declared").otherwise("undeclared")
    return t.documents.join(t.labels, "doc_id", "left").withColumn("rights_status", status)


@query(f"SELECT doc_id, {STATUS} AS rights_status, {STATUS} IN ('declared', 'verified') AS passed FROM {RIGHTS}")
def flt1_publishable(t):
    return O.publishable(with_rights(t)).select("doc_id", "rights_status", "passed")


@query("""SELECT source, doc_id, CASE WHEN bool_and(contains(lower(text), 'released')) OVER (PARTITION BY source) THEN 'info' ELSE 'error' END AS severity FROM documents WHERE contains(lower(text), 'token') OR contains(lower(text), 'all rights')""")
def flt2_marker_hits(t):
    return O.marker_hits(t.documents, "source", "doc_id", ["token", "All rights"], "released")


@query("""SELECT doc_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM documents JOIN (VALUES ('icense'), ('token'), ('@')) v(term) ON contains(lower(text), term) GROUP BY doc_id""")
def flt3_banned_terms(t):
    return O.banned_terms(t.documents, t.spark.createDataFrame([(" icense",), ("TOKEN",), ("@",), (" ",)], "term string"), "doc_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE role <> 'system' AND len(regexp_extract_all(text, '[0-9]+')) = 0")
def flt4_uncited(t):
    cited = t.conversations.withColumn("evidence_ids", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    return O.uncited(cited, ["system"], "role").select("conv_id", "turn", "role")


@query("SELECT doc_id, regexp_matches(text, '(?i)released under|@') AS promo, CAST(contains(lower(text), 'queen') AS INT) + CAST(contains(lower(text), '!') AS INT) + CAST(contains(lower(text), '***') AS INT) AS hype FROM documents")
def flt5_promo_or_hype(t):
    return O.promo_or_hype(t.documents, "doc_id", "(?i)released under|@", ["queen", "!", "***"])


_NAMES = "SELECT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS name FROM documents) WHERE regexp_matches(name, '^[A-Z][a-z]{2,}$')"


@query(f"""WITH w AS (SELECT source, doc_id, trim(w, chr(39)) AS name FROM (SELECT source, doc_id, unnest(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_'']+')) AS w FROM (SELECT source, doc_id, unnest({SENT}) AS s FROM documents))),
c AS (SELECT source, name, count(*) AS mentions, min(doc_id) AS first_source FROM w WHERE regexp_matches(name, '^[A-Z][a-zà-ÿA-Z'']{{2,}}$') AND lower(name) NOT IN ('the', 'and', 'for', 'les', 'die') GROUP BY ALL HAVING count(*) > 1)
SELECT source, name, mentions, first_source, place, CASE place WHEN 1 THEN 'lead' WHEN 2 THEN 'support' WHEN 3 THEN 'other' ELSE 'extra' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mentions DESC, name) AS place FROM c) WHERE place <= 8""")
def agg1_entity_mentions(t):
    return O.entity_mentions(t.documents, "source", "doc_id", STOP, ["lead", "support", "other"])


@query(r"""SELECT doc_id, place, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM (SELECT doc_id, phrase, min(i) AS pos FROM (SELECT doc_id, unnest(m) AS phrase, unnest(range(len(m))) AS i FROM
(SELECT doc_id, regexp_extract_all(replace(text, '. ', ' '), '\b(?:in|of|the|de) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1) AS m FROM documents)) GROUP BY ALL)) WHERE place <= 6""")
def agg2_locations(t):
    return O.locations(t.documents.withColumn("text", F.replace("text", F.lit(". "), F.lit(" "))), "doc_id", ["in", "of", "the", "de"])


@query(f"""WITH s AS (SELECT doc_id, i - 1 AS pos, s[i] AS sentence, len(s) AS n, CAST(contains(lower(s[i]), 'there') AS INT) + CAST(contains(lower(s[i]), 'que') AS INT) AS score FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents)))
SELECT doc_id, pos, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, CASE WHEN score > 0 THEN 0 WHEN pos = n // 2 THEN 1 ELSE 0 END DESC, pos) AS k FROM s) WHERE k = 1""")
def agg3_best_sentence(t):
    return O.best_sentence(t.documents, "doc_id", ["there", "que"])


_REPORT = f"""WITH s AS (SELECT doc_id, lower(x) AS x, {NARR.format('x')} AS w FROM (SELECT doc_id, unnest({SENT0}) AS x FROM documents)), f AS (SELECT *, array_to_string(string_split_regex(x, '\\s+')[1:2], ' ') AS o, list_filter(['that', 'with', 'que'], lambda c: contains(x, ' ' || c || ' ')) AS c FROM s WHERE w > 0),
g AS (SELECT doc_id, count(*) AS n_sentences, CAST(sum(w) AS BIGINT) AS n_words, list_sort(list(w)) AS l, round(var_pop(w), 6) AS length_variance, round(1 - count(DISTINCT x) / count(*), 6) AS repeated_sentences, round(1 - count(DISTINCT o) / count(*), 6) AS repeated_openings,
len(list_distinct(flatten(list(c)))) AS n_connectors, round(avg(CASE WHEN len(c) > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS connected_share, CAST(sum(len(regexp_extract_all(x, '[A-Za-z]''[A-Za-z]'))) AS BIGINT) AS n_contractions FROM f GROUP BY doc_id)"""
_RANK = "l[CAST(round_even({} * (len(l) - 1), 0) AS BIGINT) + 1]"


@query(f"{_REPORT} SELECT doc_id, n_sentences, n_words, {_RANK.format('0.1::DOUBLE')} AS p10, {_RANK.format('0.5::DOUBLE')} AS p50, {_RANK.format('0.9::DOUBLE')} AS p90, length_variance, repeated_sentences, repeated_openings, n_connectors, connected_share, n_contractions FROM g")
def agg4_style_report(t):
    return O.style_report(t.documents, "doc_id", ["that", "with", "que"])


def _grams(n: int, tab: str, key: str, words: str = TOKENS) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(ws[i : i + {n - 1}], ' ') AS s FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM (SELECT {key}, {words} AS ws FROM {tab}) WHERE len(ws) >= {n})"


@query(f"""{_REPORT}, ca AS ({_grams(4, 'documents', 'doc_id', LEXICAL)}), cb AS (SELECT DISTINCT s FROM ({_grams(4, 'benchmark', 'item_id', LEXICAL)})), fl AS (SELECT doc_id, 'GENERIC_HYPE' AS code FROM documents WHERE contains(lower(text), 'queen') OR contains(text, '***') UNION SELECT doc_id, 'CTA' FROM documents WHERE regexp_matches(text, '(?i)released under|@')
UNION SELECT doc_id, 'DIALOGUE_COPIED' FROM ca JOIN cb USING (s) UNION SELECT doc_id, 'EVIDENCE_MISSING' FROM labels WHERE quality = 0 UNION SELECT doc_id, 'UNSUPPORTED_CLAIM' FROM documents WHERE doc_id % 4 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels) UNION SELECT doc_id, 'INTERPRETATION_UNQUALIFIED' FROM labels WHERE toxic = 1),
fs AS (SELECT doc_id, list(code) AS told FROM fl GROUP BY doc_id)
SELECT g.doc_id, array_to_string(list_sort(list_filter([CASE WHEN n_sentences > 0 AND length_variance = 0 THEN 'RHYTHM' END, CASE WHEN repeated_openings > 0 OR repeated_sentences > 0 THEN 'TEMPLATE_RISK' END] || coalesce(told, []), lambda x: x IS NOT NULL)), ',') AS codes FROM g LEFT JOIN fs ON g.doc_id = fs.doc_id""")
def agg5_style_warnings(t):
    hype = O.promo_or_hype(t.documents, "doc_id", "(?i)released under|@", ["queen", "***"])
    passages = t.documents.selectExpr("doc_id", "1 as proof").join(t.labels.select(F.col("doc_id").alias("_l")).distinct(), F.col("doc_id") == F.col("_l"), "left").filter("_l is not null or doc_id % 4 = 0")
    claims = I.claim_coverage(t.labels.selectExpr("doc_id", "cast(quality as int) as proof"), passages, "doc_id", "proof")
    return O.style_warnings(O.style_report(t.documents, "doc_id", ["that", "with", "que"]), "doc_id", {
        "GENERIC_HYPE": hype.filter("hype > 0"), "CTA": hype.filter("promo"), "DIALOGUE_COPIED": O.copied_ngram_exists(t.documents, t.benchmark, "doc_id").filter("copied"), "UNSUPPORTED_CLAIM": claims.filter("code = 'UNKNOWN_CLAIM'"),
        "EVIDENCE_MISSING": claims.filter("code in ('NO_OVERLAP', 'INCOMPLETE')"), "INTERPRETATION_UNQUALIFIED": t.labels.filter("toxic = 1"),
    })


@query(f"""WITH a AS ({_grams(5, 'documents', 'doc_id')}), b AS (SELECT DISTINCT s FROM ({_grams(5, 'benchmark', 'item_id')})), c AS (SELECT doc_id, count(*) AS n, count(b.s) AS m FROM a LEFT JOIN b USING (s) GROUP BY doc_id)
SELECT doc_id, n_shingles, n_shared, overlap, CASE WHEN overlap >= 0.5 THEN 'block' WHEN overlap >= 0.25 THEN 'warn' ELSE 'clear' END AS band FROM (SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, 0) AS n_shared, round(coalesce(m / n, 0.0), 6) AS overlap FROM documents LEFT JOIN c USING (doc_id))""")
def joi2_shingle_overlap(t):
    return O.shingle_overlap(t.documents, t.benchmark, "doc_id")


@query(f"""WITH a AS ({_grams(4, 'documents', 'doc_id', LEXICAL)}), b AS (SELECT DISTINCT s FROM ({_grams(4, 'benchmark', 'item_id', LEXICAL)})), c AS (SELECT DISTINCT doc_id FROM a JOIN b USING (s)) SELECT doc_id, c.doc_id IS NOT NULL AS copied FROM documents LEFT JOIN c USING (doc_id)""".replace("SELECT doc_id, c.doc_id", "SELECT documents.doc_id, c.doc_id"))
def joi3_copied_ngram_exists(t):
    return O.copied_ngram_exists(t.documents, t.benchmark, "doc_id")


@query(f"""WITH p AS (SELECT doc_id, source, lower({_DOC}) AS t FROM documents), m AS (SELECT *, list_filter({L.CALL_MARKERS!r}, lambda w: contains(t, w)) AS m, list_filter({L.HYPE_MARKERS!r}, lambda w: contains(t, w)) AS h FROM p),
g AS (SELECT source, len(list_distinct(flatten(list(m)))) AS pm, len(list_distinct(flatten(list(h)))) AS ph FROM m GROUP BY source)
SELECT doc_id, source, regexp_matches(t, '{"|".join(L.CALLS)}') AS calls, len(m) AS markers, len(h) AS hype, ph AS project_hype, pm AS project_markers FROM m JOIN g USING (source)""")
def flt5_viewer_calls(t):
    return O.viewer_calls(t.documents.withColumn("text", said("doc_id")), "doc_id", "source")
