"""Untrusted JSON, candidates and scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.sources.files import scratch_table


def parse_untrusted(df: DataFrame, key: str, payload: str, kinds: list[str], default: str, most: int, longest: int) -> DataFrame:
    """(key, kind, tags, title) of model JSON: lists and strings capped, unknown kinds to default, malformed ones to nulls."""
    r = F.from_json(payload, "kind string, tags array<string>, title string", {"mode": "PERMISSIVE"})
    out = df.select(key, r.alias("r"))
    tags = F.transform(F.slice(F.coalesce("r.tags", F.array().cast("array<string>")), 1, most), lambda x: F.substring(x, 1, longest))
    return out.select(key, F.when(F.col("r.kind").isin(*kinds), F.col("r.kind")).otherwise(default).alias("kind"), F.array_join(tags, ",").alias("tags"), F.substring("r.title", 1, longest).alias("title"))


def validate_observations(df: DataFrame, key: str, payload: str, keys: list[str], expected: str, bounds: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(key, code): wrong key set, order other than expected, no own id among refs, no facts, or a field that is no integer within its bounds."""
    names = F.array_sort(F.json_object_keys(payload))
    get = lambda p: F.get_json_object(payload, f"$.{p}")
    refs = F.from_json(get("refs"), "array<string>")
    rules = {"KEYS": ~names.eqNullSafe(F.array(*map(F.lit, sorted(keys)))), "ORDER": ~get("order").try_cast("long").eqNullSafe(F.col(expected)), "NO_SELF": ~F.coalesce(F.array_contains(refs, F.col(key).cast("string")), F.lit(False)), "NO_FACTS": F.coalesce(get("facts"), F.lit("")) == ""}
    for field, (low, high) in (bounds or {}).items():
        whole = get(field).rlike("^-?[0-9]+$") & get(field).try_cast("long").between(low, high)
        rules[f"BOUNDS_{field.upper()}"] = ~F.coalesce(whole, F.lit(False))
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    return df.select(key, F.explode(codes).alias("code"))


def validate_manifest(actual: DataFrame, expected: DataFrame, project: str, order: str, key: str) -> DataFrame:
    """(project, count_equal, order_equal, ratio, unresolved) of the expected projects.

    Ids are compared place by place; ratio is the share of the expected places that are right, unresolved the number
    that are not.
    """
    placed = lambda df, n: df.select(project, F.expr(f"row_number() over (partition by {project} order by {order}, {key})").alias("_k"), F.col(key).alias(n))
    both = placed(expected, "_e").join(placed(actual, "_a"), [project, "_k"], "full_outer").withColumn("_same", F.coalesce(F.col("_e") == F.col("_a"), F.lit(False)))
    told = both.groupBy(project).agg(F.count("_e").alias("_n"), F.count("_a").alias("_m"), F.count_if("_same").alias("_s")).filter("_n > 0")
    equal = F.col("_n") == F.col("_m")
    return told.select(project, equal.alias("count_equal"), (equal & (F.col("_s") == F.col("_n"))).alias("order_equal"), F.round(F.col("_s") / F.col("_n"), 6).alias("ratio"), (F.col("_n") - F.col("_s")).alias("unresolved"))


def validate_continuity(chunks: DataFrame, project: str, position: str, chunk: str, ids: str, expected: DataFrame, key: str, links: DataFrame | None = None, ends: tuple[str, ...] = ()) -> DataFrame:
    """(project, subject, code) of chunks (project, position, chunk, array of ids) against the expected ids (project, key).

    DUPLICATE_CHUNK for a chunk id used twice, REPEATED_ID for a chunk that names an id twice, NO_OVERLAP for a chunk that
    shares no id with the chunk before, UNKNOWN_ID for an id that is not expected, UNCOVERED for an expected id in no chunk,
    UNKNOWN_LINK for an end (a column of links) that is not expected. An array is one chunk's, never a project's.
    """
    told = lambda df, subject, code: df.select(project, F.col(subject).cast("string").alias("subject"), F.lit(code).alias("code"))
    known = expected.select(project, F.col(key).alias("_id")).distinct()
    named = chunks.select(project, F.explode(ids).alias("_id")).distinct()
    before = F.expr(f"lag({ids}) over (partition by {project} order by {position}, {chunk})")
    alone = chunks.select(project, chunk, ids, before.alias("_b")).filter(F.col("_b").isNotNull() & ~F.coalesce(F.arrays_overlap(ids, "_b"), F.lit(False)))
    parts = [
        told(chunks.groupBy(project, chunk).count().filter("count > 1"), chunk, "DUPLICATE_CHUNK"),
        told(chunks.filter(F.size(F.array_distinct(ids)) < F.size(ids)), chunk, "REPEATED_ID"),
        told(alone, chunk, "NO_OVERLAP"),
        told(named.join(known, [project, "_id"], "left_anti"), "_id", "UNKNOWN_ID"),
        told(known.join(named, [project, "_id"], "left_anti"), "_id", "UNCOVERED"),
    ]
    for end in ends:
        parts.append(told(links.select(project, F.col(end).alias("_id")).join(known, [project, "_id"], "left_anti"), "_id", "UNKNOWN_LINK"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def validate_entities(entities: DataFrame, mentions: DataFrame, expected: DataFrame, project: str, key: str, entity: str = "entity_id", name: str = "name", texts: str = "texts", ids: str = "ids") -> DataFrame:
    """(project, subject, code) of a continuity ledger's entities and of the motives and state changes that mention them.

    entities: project, entity, name, array of ids; mentions: project, entity, array of texts (a motive's, or what a state
    changes from and to), array of ids; expected: project, key. NO_ENTITIES for a project without any, BLANK_ENTITY for one
    without an id or a name, REPEATED_ENTITY for an id used twice, UNKNOWN_ENTITY and BLANK_TEXT for a mention of an id that
    is no entity's or with a blank text, NO_EVIDENCE for either without ids, UNKNOWN_PANEL for an id that is not expected.
    """
    told = lambda df, code, subject=entity: df.select(project, F.col(subject).cast("string").alias("subject"), F.lit(code).alias("code"))
    blank = lambda c: F.coalesce(F.trim(c.cast("string")) == "", F.lit(True))
    known = expected.select(project, F.col(key).alias("_id")).distinct()
    named = entities.select(project, entity).filter(~blank(F.col(entity))).distinct()
    both = entities.select(project, entity, ids).unionByName(mentions.select(project, entity, ids))
    seen = both.select(project, F.explode(ids).alias("_id")).distinct()
    parts = [
        known.select(project).distinct().join(entities.select(project).distinct(), project, "left_anti").select(project, F.lit("").alias("subject"), F.lit("NO_ENTITIES").alias("code")),
        told(entities.filter(blank(F.col(entity)) | blank(F.col(name))), "BLANK_ENTITY"),
        told(entities.filter(~blank(F.col(entity))).groupBy(project, entity).count().filter("count > 1"), "REPEATED_ENTITY"),
        told(mentions.select(project, entity).distinct().join(named, [project, entity], "left_anti"), "UNKNOWN_ENTITY"),
        told(mentions.filter(F.coalesce(F.exists(texts, blank), F.lit(True))), "BLANK_TEXT"),
        told(both.filter(F.coalesce(F.size(ids) < 1, F.lit(True))), "NO_EVIDENCE"),
        told(seen.join(known, [project, "_id"], "left_anti"), "UNKNOWN_PANEL", "_id"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def validate_passages(df: DataFrame, project: str, order: str, role: str, text: str, roles: list[tuple[str, int, int]], total: tuple[int, int], ending: str = "?") -> DataFrame:
    """(project, order, code) of passages that should follow roles (role, fewest words, most words) one by one.

    ROLE for a passage whose role is not that of its place, WORDS outside the limits of its place, OPENING if its first three
    words open an earlier one, SENTENCE if it repeats a sentence of an earlier one. At the last passage of a project: COUNT if
    their number is not that of the roles, TOTAL if all their words are outside total, ENDING if it does not end as it should.
    Words between blanks are counted; openings and sentences go by lower-case letters and digits.
    """
    w = f"partition by {project} order by {order}"
    table = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(a).alias("low"), F.lit(b).alias("high")) for r, a, b in roles])
    lexical = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    whole = F.coalesce(text, F.lit(""))
    rows = df.select(project, order, role, whole.alias("_text"), F.size(F.regexp_extract_all(whole, F.lit(r"\S+"), F.lit(0))).alias("_n"), F.array_join(F.slice(lexical(whole), 1, 3), " ").alias("_open"))
    rows = rows.withColumns({"_k": F.expr(f"row_number() over ({w})"), "_last": F.expr(f"lead({order}) over ({w}) is null"), "_sum": F.expr(f"sum(_n) over ({w} rows unbounded preceding)"), "_again": F.expr(f"row_number() over (partition by {project}, _open order by {order}) > 1")})
    rows = rows.withColumn("_want", F.get(table, F.col("_k") - 1))
    rules = {
        "ROLE": ~F.col(role).eqNullSafe(F.col("_want.role")), "WORDS": ~F.coalesce(F.col("_n").between(F.col("_want.low"), F.col("_want.high")), F.lit(False)), "OPENING": F.col("_again"),
        "COUNT": F.col("_last") & (F.col("_k") != len(roles)), "TOTAL": F.col("_last") & ~F.col("_sum").between(*total), "ENDING": F.col("_last") & ~F.rtrim("_text").endswith(ending),
    }
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))
    said = rows.select(project, order, F.explode(F.array_distinct(F.transform(F.split("_text", "[.!?]+"), lambda s: F.array_join(lexical(s), " ")))).alias("_s")).filter("_s <> ''")
    repeated = said.withColumn("_r", F.expr(f"row_number() over (partition by {project}, _s order by {order})")).filter("_r > 1")
    return rows.select(project, order, F.explode(codes).alias("code")).unionByName(repeated.select(project, order, F.lit("SENTENCE").alias("code")).distinct())


def alias_fields(df: DataFrame, key: str, payload: str, names: list[str]) -> DataFrame:
    """(key, value): the first of several names that a JSON record has."""
    return df.select(key, F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names]).alias("value"))


#: What a place ahead adds and at most, and what a place back takes and at most.
AHEAD, AHEAD_MOST, BACK, BACK_MOST = 0.03, 0.18, 0.25, 2.0
#: Blocks of positions that make a larger one.
FAN = 16


def score_candidates(spans: DataFrame, candidates: DataFrame, project: str, span: str, candidate: str, weights: dict[str, str], top: int = 3, nearby: int = 6, continuity: float = 0.35) -> DataFrame:
    """(project, span, candidate, score, place): the top candidates of each span of one project; ties go to the smaller candidate.

    spans (project, span, tags array, previous position or null), candidates (project, candidate, quality, position, features),
    positions being whole numbers. A candidate's own score is its quality, plus for each tag of the span that weights names
    the expression over features, rounded; to that comes continuity times 1 - distance / nearby (0 at least) from the previous
    position, plus 0.03 a place ahead (0.18 at most), less 0.25 a place back (2 at most); a span without a previous position, or a
    candidate without one, counts as near. A null quality counts as 0.

    Beyond a few places ahead or back of the previous position all candidates get the same for their place, so only the best
    of their own score can win. The best of each position, of FAN positions, of FAN times as many, and so on, are kept, top of
    each; a span looks up the positions around its own and the largest blocks that fill the rest, some dozens whatever the
    project's size. A project with any share of the rows is spread by its blocks.
    """
    known = F.array(*map(F.lit, weights)) if weights else F.array().cast("array<string>")
    asked = spans.select(project, F.array_sort(F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), known)).alias("_tags"), F.col("previous").cast("long").alias("_prev"), span)
    semantic = sum((F.when(F.array_contains("_tags", tag), F.expr(f"({weight})")).otherwise(0.0) for tag, weight in weights.items()), F.lit(0.0))
    limits = candidates.agg(F.min("position").cast("long"), F.max("position").cast("long")).first()
    low, most = (limits[0] or 0), (limits[1] or 0) - (limits[0] or 0)
    widths = [1, FAN]
    while widths[-1] <= most:
        widths.append(widths[-1] * FAN)
    nowhere = len(widths)

    def best(rows: DataFrame, level: int, block: Column) -> DataFrame:
        """The top rows of each block by their own score."""
        told = rows.withColumns({"_level": F.lit(level), "_block": block})
        return told.withColumn("_k", F.expr(f"row_number() over (partition by {project}, _tags, _block order by _base desc, {candidate})")).filter(F.col("_k") <= top).drop("_k")

    kinds = asked.select(project, "_tags").distinct()
    rows = kinds.join(candidates, project).select(project, "_tags", candidate, F.col("position").cast("long").alias("_at"), F.round(F.coalesce("quality", F.lit(0.0)) + F.round(semantic, 3), 6).alias("_base"))
    levels = [scratch_table(best(rows.filter("_at is not null"), 0, F.col("_at") - low), "positions")]
    for level, width in enumerate(widths[1:], 1):
        levels.append(best(levels[-1], level, F.expr(f"(_at - {low}L) div {width}L")))
    tops = reduce(lambda x, y: x.unionByName(y), [*levels, best(rows.filter("_at is null"), nowhere, F.lit(0).cast("long"))])

    ahead, back = max(nearby, math.ceil(AHEAD_MOST / AHEAD)), max(nearby, math.ceil(BACK_MOST / BACK))
    between = lambda level, first, last: f"if({first} <= {last}, transform(sequence({first}, {last}), b -> named_struct('l', {level}, 'b', b)), array())"
    x, y = f"greatest(0L, _prev - {low}L + {ahead})", f"least({most}L, _prev - {low}L - {back})"
    looked = [between(0, f"greatest(0L, _prev - {low}L - {back - 1})", f"least({most}L, _prev - {low}L + {ahead - 1})")]
    for level, (width, wider) in enumerate(zip(widths, widths[1:])):
        looked.append(between(level, x if level == 0 else f"{x} div {width} + 1", f"least(({x} div {wider} + 1) * {FAN} - 1, {most}L div {width})"))
        looked.append(f"if({y} < 0, array(), {between(level, f'{y} div {wider} * {FAN}', y if level == 0 else f'{y} div {width} - 1')})")
    all_of_it = f"array(named_struct('l', {len(widths) - 1}, 'b', 0L))"
    places = F.expr(f"concat(if(_prev is null, {all_of_it}, concat({', '.join(looked)})), array(named_struct('l', {nowhere}, 'b', 0L)))")
    wanted = asked.select(project, "_tags", "_prev").distinct().withColumn("_x", F.explode(places)).select(project, "_tags", "_prev", F.col("_x.l").alias("_level"), F.col("_x.b").alias("_block"))

    step = F.col("_at") - F.col("_prev")
    near = F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.abs(step), F.lit(0)) / F.lit(float(max(1, nearby)))) * continuity
    order = F.when(step < 0, -F.least(F.lit(BACK_MOST), -step * BACK)).when(step >= 0, F.least(F.lit(AHEAD_MOST), step * AHEAD)).otherwise(0.0)
    pairs = wanted.join(tops, [project, "_tags", "_level", "_block"]).withColumn("score", F.round(F.col("_base") + near + order, 6))
    kept = pairs.withColumn("place", F.expr(f"row_number() over (partition by {project}, _tags, _prev order by score desc, {candidate})")).filter(F.col("place") <= top)
    found = kept.select(F.col(project).alias("_p"), F.col("_tags").alias("_t"), F.col("_prev").alias("_v"), candidate, "score", "place")
    return asked.join(found, F.expr(f"{project} = _p and _tags = _t and _prev <=> _v")).select(project, span, candidate, "score", "place")


def selection_reasons(chosen: DataFrame, project: str, order: str, position: str, family: str, score: str) -> DataFrame:
    """(project, order, reasons): why a row was chosen, from the row before and its scores."""
    w = f"over (partition by {project} order by {order})"
    reasons = f"array_compact(array(if({score} > 0.5, 'strong', null), if({position} >= lag({position}) {w}, 'chronological', null), if({family} <> lag({family}) {w}, 'new_family', null), if({score} < 0.2, 'weak', null)))"
    return chosen.select(project, order, F.expr(f"array_join({reasons}, ',')").alias("reasons"))


def beat_score(df: DataFrame, claims: str, changes: str, turns: str, panels: str) -> DataFrame:
    """df with score: 100 for each claim, 5 for each state change, 3 for each turn, and its panels, 16 at most."""
    return df.withColumn("score", F.expr(f"100 * {claims} + 5 * {changes} + 3 * {turns} + least({panels}, 16)"))


#: The picture's sides, how far a ratio may be off, the least height, and seconds: the most, the least, and how
#: many times the target.
OUTPUT_SIZE, OUTPUT_RATIO_SLACK, OUTPUT_HEIGHT = (1080, 1920), 0.02, 1280
OUTPUT_SECONDS, OUTPUT_LEAST_SECONDS, OUTPUT_OVER_TARGET = 90.0, 60.0, 1.15


def output_checks(jobs: DataFrame, key: str, output: str, there: str, width: str, height: str, seconds: str, target: str) -> DataFrame:
    """(key, code, severity, passed): what is against a render job and its file.

    Without an output the job is missing, and without its file (there) the file is, and its picture is not judged: aspect
    and height else, if both sides are told and not 0. The length is judged for every job: unknown if null or not positive,
    else too long, or else over the target, and also too short. What has nothing against it has a row that passed.
    """
    w, h, s, goal = F.col(width), F.col(height), F.col(seconds), F.col(target)
    told = F.coalesce((w != 0) & (h != 0), F.lit(False))
    lost = F.coalesce(F.col(output) == "", F.lit(True))
    gone = ~lost & ~F.coalesce(F.col(there), F.lit(False))
    seen, unknown = ~lost & ~gone, F.coalesce(s <= 0, F.lit(True))
    wrong = seen & told & (F.abs(F.try_divide(w, h) - OUTPUT_SIZE[0] / OUTPUT_SIZE[1]) > OUTPUT_RATIO_SLACK)
    low = seen & told & (h < OUTPUT_HEIGHT)
    long = ~unknown & (s > OUTPUT_SECONDS)
    over, short = ~unknown & ~long & (s > goal * OUTPUT_OVER_TARGET), ~unknown & (s < OUTPUT_LEAST_SECONDS)
    none = lambda *rules: ~reduce(lambda a, b: a | b, [F.coalesce(r, F.lit(False)) for r in rules])
    rules = [
        ("render.missing", "error", lost), ("render.file_missing", "error", gone), ("render.wrong_aspect", "error", wrong), ("render.low_resolution", "warning", low), ("render.ok", "info", none(lost, gone, wrong, low)),
        ("duration.unknown", "error", unknown), ("duration.too_long", "error", long), ("duration.over_target", "warning", over), ("duration.too_short", "warning", short), ("duration.ok", "info", none(unknown, long, over, short)),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(severity == "info").alias("passed"))) for code, severity, rule in rules]))
    return jobs.select(key, F.explode(found).alias("_f")).select(key, "_f.*")
