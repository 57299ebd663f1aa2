"""Operators over ordered rows of many projects. Order always comes from columns, and every window is one project's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.functions.text import wrap_lines
from proofline.sources.files import scratch_table

P, O = "project_id", "pos"


def over(project: str = P, order: str = O, frame: str = "") -> str:
    """An SQL window over the ordered rows of a project."""
    return f"over (partition by {project} order by {order} {frame})"


BEFORE = "rows between unbounded preceding and 1 preceding"
#: A table joined without a key is broadcast up to so many rows.
FEW = 400
#: What placed adds.
PLACED = ["_r", "_n", "_id", "_g"]


def half_up(value: Column, places: int) -> Column:
    """A number rounded half up by its double value times a power of ten, as SQL engines without decimals in between do."""
    scaled = value.cast("double") * 10.0**places
    return F.when(F.abs(scaled) < 2.0**52, F.round(scaled) / 10.0**places).otherwise(value.cast("double"))


def if_small(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, to be broadcast if counting finds at most so many rows; with more, Spark chooses the join. Counting stops beyond rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows that spread gives a task.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """df by keys in one partition for each ROWS_A_TASK of its rows, so that what a task holds does not grow with the table.

    rows is their number where it is known; else they are counted.
    """
    return df.repartition(max(1, -(-(df.count() if rows is None else rows) // ROWS_A_TASK)), *keys)


def lay_out(df: DataFrame, gap: float = 0.0, length: str = "dur", words: str | None = None) -> DataFrame:
    """df with start_s and end_s: items one after the other with a gap between.

    words names an array of (word, start_s, end_s) in the item's own time, which is shifted to the time of all, in milliseconds.
    """
    laid = df.withColumn("start_s", F.expr(f"coalesce(sum({length} + {gap}) {over(frame=BEFORE)}, 0.0D)")).withColumn("end_s", F.expr(f"start_s + {length}"))
    if words is None:
        return laid
    return laid.withColumn(words, F.expr(f"transform({words}, w -> named_struct('word', w.word, 'start_s', round(start_s + w.start_s, 3), 'end_s', round(start_s + w.end_s, 3)))"))


def absorb_gap(df: DataFrame) -> DataFrame:
    """df whose ends reach to the next start if that is later."""
    return df.withColumn("end_s", F.expr(f"greatest(end_s, coalesce(lead(start_s) {over()}, end_s))"))


#: Fixed value: a length that is told by two times is exact to so many digits after the point.
DIGITS = 9


def split_slots(df: DataFrame, least: float, most: int = 4, assets: int = 5) -> DataFrame:
    """(project_id, pos, slot, index, start_s, end_s, asset): 1 to most equal slots a block, none under least; assets in turn."""
    n = f"cast(greatest(1, least({most}, floor(round(end_s - start_s, {DIGITS}) / {least}))) as int)"
    rows = df.withColumn("_n", F.expr(n)).withColumn("slot", F.expr("explode(sequence(0, _n - 1))"))
    rows = rows.withColumn("index", F.expr(f"row_number() over (partition by {P} order by {O}, slot) - 1"))
    return rows.selectExpr(P, O, "slot", "index", "start_s + (end_s - start_s) * slot / _n as start_s", "start_s + (end_s - start_s) * (slot + 1) / _n as end_s", f"pmod(index, {assets}) as asset")


def rescale(df: DataFrame, total: float, length: str = "dur") -> DataFrame:
    """(project_id, pos, start_s, end_s): lengths scaled to total, each rounded to milliseconds and carried; the last end is total.

    The rounded lengths are whole numbers, so their running sums are exact.
    """
    rows = df.withColumn("_l", F.expr(f"cast(bround({length} * {round(total * 1000)} / sum({length}) over (partition by {P})) as bigint)"))
    rows = rows.withColumn("_e", F.expr(f"sum(_l) {over()}")).withColumn("_last", F.expr(f"lead({O}) {over()} is null"))
    return rows.selectExpr(P, O, "(_e - _l) / 1000 as start_s", f"if(_last, {total}D, _e / 1000) as end_s")


def weighted_word_times(words: DataFrame, seconds: str = "seconds", offset: float = 0.0, short: float = 1.5, long: float = 2.5) -> DataFrame:
    """Words (project_id, seg, pos, word, seconds of the segment) with start_s and end_s, in milliseconds from offset on.

    A word weighs its letters and 1, and more before a pause: short behind , ; : and long behind . ! ?. The last word
    ends exactly with the segment; a segment without length has no words.
    """
    pause = f"case when word rlike '[,;:]$' then {short}D when word rlike '[.!?]$' then {long}D else 0.0D end"
    w = words.filter(f"{seconds} > 0").withColumn("_w", F.expr(f"length(regexp_replace(word, '[^\\\\p{{L}}\\\\p{{N}}_]', '')) + 1.0D + {pause}"))
    key = f"{P}, seg"
    w = w.withColumn("_b", F.expr(f"coalesce(sum(_w) {over(key, frame=BEFORE)}, 0.0D)")).withColumn("_t", F.expr(f"sum(_w) over (partition by {key})"))
    w = w.withColumn("_last", F.expr(f"lead(word) {over(key)} is null"))
    end = f"round({offset}D + if(_last, {seconds}, {seconds} * (_b + _w) / _t), 3) as end_s"
    return w.selectExpr(P, "seg", O, "word", f"round({offset}D + {seconds} * _b / _t, 3) as start_s", end)


def uniform_word_times(segments: DataFrame, total: float) -> DataFrame:
    """(project_id, seg, pos, start_s, end_s) of equal word slices; segments (project_id, seg, n_words) share total by words."""
    s = segments.filter("n_words > 0").withColumn("_all", F.expr(f"sum(n_words) over (partition by {P})"))
    s = s.withColumn("_b", F.expr(f"coalesce(sum(n_words) {over(P, 'seg', BEFORE)}, 0)"))
    s = s.withColumn(O, F.expr("explode(sequence(0, cast(n_words as int) - 1))"))
    return s.selectExpr(P, "seg", O, f"round((_b + {O}) * {total}D / _all, 6) as start_s", f"round((_b + {O} + 1) * {total}D / _all, 6) as end_s")


def build_cues(words: DataFrame, least: float, media: float) -> DataFrame:
    """One cue a word (project_id, pos, display, start_s, end_s): short ones reach up to the next start, none beyond media."""
    nxt = f"coalesce(lead(start_s) {over()}, {media}D)"
    w = words.withColumn("end_s", F.expr(f"if(end_s - start_s < {least}, greatest(end_s, least(start_s + {least}, {nxt})), end_s)"))
    return w.withColumn("end_s", F.expr(f"least(end_s, {media}D)"))


def validate_cues(cues: DataFrame, media: float, fastest: float) -> DataFrame:
    """(project_id, pos, code) of every rule that a cue breaks."""
    nxt = f"lead(start_s) {over()}"
    rules = {"EMPTY": "display = ''", "MULTI_WORD": "instr(display, ' ') > 0", "NOT_UPPER": "display rlike '[^A-Z0-9 ]' and display <> upper(display)", "PUNCTUATION": "display rlike '[.,!?;:]'", "TOO_FAST": f"end_s - start_s < {fastest}", "OUT_OF_MEDIA": f"start_s < 0 or end_s > {media}", "OVERLAP": f"end_s > {nxt} + 0.000001"}
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    found = cues.select(P, O, F.expr(f"concat_ws(',', {codes})").alias("_c")).filter("_c <> ''")  # most cues break none
    return found.select(P, O, F.explode(F.split("_c", ",")).alias("code"))


def sentence_of(words: DataFrame, order: str = O) -> DataFrame:
    """Timed words with sentence: the number of end marks before a word; those that have it stay as they are."""
    if {"_e", "sentence"} <= set(words.columns):
        return words
    w = words.withColumn("_e", F.expr("cast(word rlike '[.!?]$' as int)"))
    return w.withColumn("sentence", F.expr(f"coalesce(sum(_e) {over(order=order, frame=BEFORE)}, 0)"))


def sentence_groups(words: DataFrame) -> DataFrame:
    """(project_id, sentence, first_pos, n_words, start_s, end_s, text, closed): timed words up to each end mark; closed is false without one."""
    text = f"array_join(transform(array_sort(collect_list(struct({O}, word))), x -> x.word), ' ')"
    return sentence_of(words).groupBy(P, "sentence").agg(
        F.min(O).alias("first_pos"), F.count("*").alias("n_words"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.expr(text).alias("text"), (F.max("_e") == 1).alias("closed"),
    )


#: Characters of a caption's line, and lines of a caption.
LINE_WIDTH, LINES = 22, 2


def validate_groups(groups: DataFrame, words: DataFrame, media: float, charset: str, least: int = 1, slack: float = 0.01, width: int = LINE_WIDTH, most: int = LINES) -> DataFrame:
    """(project_id, sentence, code) of groups and their words (project_id, sentence, display, start_s, end_s).

    FEW_WORDS below least (also for a group without words), OUT_OF_BOUNDS of the media, OVERLAP with the end of the group
    before or an end not after the start, UNCLOSED, WORD_OUTSIDE if a word is not inside its group, CHARSET if a displayed word
    is not wholly of charset, OVERFLOW if the displayed words, wrapped to lines of width, have more than most lines, or
    several of which one has a single word. Times may be off by slack.
    """
    inside = words.groupBy(P, "sentence").agg(F.count("*").alias("_n"), F.min("start_s").alias("_from"), F.max("end_s").alias("_to"), F.expr(f"bool_and(coalesce(display rlike '^(?:{charset})$', false))").alias("_fine"), F.expr("array_join(transform(array_sort(collect_list(struct(start_s, end_s, display))), x -> x.display), ' ')").alias("_shown"))
    inside = inside.withColumn("_lines", wrap_lines(F.coalesce("_shown", F.lit("")), width))
    before = f"coalesce(lag(end_s) {over(P, 'sentence')}, 0.0D)"
    rules = {
        "FEW_WORDS": f"coalesce(_n, 0) < {least}", "OUT_OF_BOUNDS": f"start_s < -{slack} or end_s > {media} + {slack}", "OVERLAP": f"start_s < {before} - {slack} or end_s <= start_s", "UNCLOSED": "not closed",
        "WORD_OUTSIDE": f"_from < start_s - {slack} or _to > end_s + {slack}", "CHARSET": "not _fine",
        "OVERFLOW": f"size(_lines) > {most} or size(_lines) > 1 and exists(_lines, x -> instr(x, ' ') = 0)",
    }
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    return groups.join(inside, [P, "sentence"], "left").withColumn("_c", F.expr(f"array_compact(array({codes}))")).selectExpr(P, "sentence", "explode(_c) as code")


def repetition_audit(df: DataFrame, asset: str, x: str, y: str, curve: str, still: str = "static", length: str = "dur", near: float = 0.08, longest: float = 2.8, most: float = 0.8) -> DataFrame:
    """One row a project: how often neighbours repeat, and sorted codes of what is against the sequence.

    Neighbours show the same frame if they have one asset and their two focus values differ by less than near. Curves
    repeat if three rows that move have the same one, whatever still rows lie between; assets if three rows in a row do.
    """
    lag = lambda c, k=1: f"lag({c}, {k}) {over()}"
    moved = lambda k: f"lag({curve}, {k}) over (partition by {P}, {curve} <> '{still}' order by {O})"
    same = f"coalesce({asset} = {lag(asset)} and abs({x} - {lag(x)}) < {near} and abs({y} - {lag(y)}) < {near}, false)"
    marked = df.selectExpr(
        P, f"{same} as a", f"{same} and {curve} = '{still}' and {lag(curve)} = '{still}' as s",
        f"coalesce({curve} <> '{still}' and {curve} = {moved(1)} and {curve} = {moved(2)}, false) as b",
        f"coalesce({asset} = {lag(asset)} and {asset} = {lag(asset, 2)}, false) as c", f"coalesce({curve} <> '{still}', true) as m", f"{length} > {longest} as h",
    )
    counts = {"same_frames": "a", "still_frames": "s", "same_curves": "b", "same_assets": "c", "long_holds": "h"}
    out = marked.groupBy(P).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.round(F.avg(F.col("m").cast("double")), 6).alias("moving_share"))
    rules = {"ASSET_COOLDOWN": "same_assets > 0", "LONG_HOLD": "long_holds > 0", "REPEATED_CURVE": "same_curves > 0", "REPEATED_FRAME": "same_frames > 0", "REPEATED_STILL": "still_frames > 0", "RESTLESS": f"moving_share > {most}"}
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    return out.withColumn("codes", F.expr(f"array_join(array_compact(array({codes})), ',')"))


def alternating_pattern(df: DataFrame, signature: str) -> DataFrame:
    """(project_id, first_pos): where the first A-B-A-B run of a project begins; projects without one do not occur."""
    lag = lambda k: f"lag({signature}, {k}) {over()}"
    hit = df.withColumn("_h", F.expr(f"{signature} = {lag(2)} and {lag(1)} = {lag(3)} and {signature} <> {lag(1)}"))
    return hit.filter("_h").groupBy(P).agg((F.min(O) - 3).alias("first_pos"))


def islands(df: DataFrame, key: str, order: str = O, project: str = P) -> DataFrame:
    """df with island: the number of changes of key so far."""
    changed = df.withColumn("_c", F.expr(f"cast(not coalesce({key} <=> lag({key}) {over(project, order)}, false) as int)"))
    return changed.withColumn("island", F.expr(f"sum(_c) {over(project, order)}")).drop("_c")


def longest_same_run(df: DataFrame, key: str, length: str = "dur") -> DataFrame:
    """(project_id, longest_s): the longest total time of one run of equal keys."""
    return islands(df, key).groupBy(P, "island").agg(F.sum(length).alias("_s")).groupBy(P).agg(F.round(F.max("_s"), 6).alias("longest_s"))


def motion_audit(df: DataFrame, mode: str, strong: list[str], forbidden: list[str], dx: str, dy: str, least: float) -> DataFrame:
    """(project_id, codes): sorted codes of adjacent strong effects, repeated modes, forbidden modes and reversals."""
    quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
    lag = lambda c: f"lag({c}) {over()}"
    rules = {"ADJACENT_STRONG": f"{mode} in ({quoted(strong)}) and {lag(mode)} in ({quoted(strong)})", "REPEATED_MODE": f"{mode} = {lag(mode)}", "FORBIDDEN": f"{mode} in ({quoted(forbidden)})", "REVERSAL": f"({dx}) * {lag(dx)} + ({dy}) * {lag(dy)} < -{least}"}
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    found = df.withColumn("_c", F.expr(f"array_compact(array({codes}))")).select(P, F.explode("_c").alias("code"))
    return found.groupBy(P).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def boundary_gap(df: DataFrame, low: float = -0.01, high: float = 0.5) -> DataFrame:
    """(project_id, pos, gap): the first neighbours whose gap is out of bounds."""
    gaps = df.withColumn("gap", F.expr(f"lead(start_s) {over()} - end_s")).filter((F.col("gap") < low) | (F.col("gap") > high))
    return gaps.groupBy(P).agg(F.min_by(F.struct(O, "gap"), O).alias("_m")).select(P, f"_m.{O}", F.round("_m.gap", 6).alias("gap"))


def shot_metrics(df: DataFrame, crop: list[str], length: str = "dur") -> DataFrame:
    """(project_id, mean_s, total_s, crops): lengths, and the different values of the crop columns, rounded to 2 places.

    Lengths are added in the order of the rows, so that a mean that lies on the edge of two roundings is always the same.
    """
    rows = df.withColumn("_s", F.expr(f"sum({length}) {over(frame='rows between unbounded preceding and current row')}"))
    out = rows.groupBy(P).agg(F.max_by("_s", O).alias("_t"), F.count(length).alias("_n"), F.count_distinct(F.struct(*[half_up(F.col(c), 2) for c in crop])).alias("crops"))
    return out.select(P, half_up(F.try_divide("_t", "_n"), 4).alias("mean_s"), half_up(F.col("_t"), 4).alias("total_s"), "crops")


def dominance(df: DataFrame, signature: str, length: str = "dur", most: float = 0.35) -> DataFrame:
    """Largest share of one signature by time and by count; fails above most with two signatures or more."""
    each = df.groupBy(P, signature).agg(F.sum(length).alias("_t"), F.count("*").alias("_n"))
    out = each.groupBy(P).agg(F.round(F.max("_t") / F.sum("_t"), 6).alias("by_time"), F.round(F.max("_n") / F.sum("_n"), 6).alias("by_count"), F.count("*").alias("signatures"))
    return out.withColumn("passed", ~((F.col("by_time") > most) & (F.col("signatures") >= 2)))


def reuse_cap(df: DataFrame, asset: str, share: float = 0.12) -> DataFrame:
    """(project_id, asset, uses, cap) of assets above max(2, floor(share * rows)), where a project has more than one asset."""
    each = df.groupBy(P, asset).agg(F.count("*").alias("uses"))
    each = each.withColumn("cap", F.expr(f"greatest(2, cast(floor({share} * sum(uses) over (partition by {P})) as bigint))")).withColumn("_a", F.expr(f"count(*) over (partition by {P})"))
    return each.filter("_a > 1 and uses > cap").select(P, asset, "uses", "cap")


def static_ratio(df: DataFrame, hold: str, length: str = "dur") -> DataFrame:
    """(project_id, static_ratio): the share of time of the rows for which hold is true."""
    return df.groupBy(P).agg(F.round(F.sum(F.expr(f"if({hold}, {length}, 0.0D)")) / F.sum(length), 6).alias("static_ratio"))


def mode_diversity(df: DataFrame, mode: str, justified: str) -> DataFrame:
    """Distinct modes, the most frequent (smallest name on ties), its share, and whether all of its rows are justified."""
    each = df.groupBy(P, mode).agg(F.count("*").alias("_n"), F.bool_and(F.expr(justified)).alias("_j"))
    top = F.max_by(F.struct(F.col(mode).alias("m"), "_n", "_j"), F.struct("_n", F.expr(f"-ascii({mode})")))
    return each.groupBy(P).agg(F.count("*").alias("modes"), F.sum("_n").alias("_all"), top.alias("t")).select(P, "modes", F.col("t.m").alias("top_mode"), F.round(F.col("t._n") / F.col("_all"), 6).alias("top_share"), F.col("t._j").alias("justified"))


def caption_stats(cues: DataFrame, media: float) -> DataFrame:
    """(project_id, single_word, least_words, most_words, overflow_s): words of cues, and how far they run over the media."""
    n = F.regexp_count("display", F.lit(r"\S+"))
    return cues.groupBy(P).agg(F.round(F.avg((n == 1).cast("double")), 6).alias("single_word"), F.min(n).alias("least_words"), F.max(n).alias("most_words"), F.round(F.greatest(F.lit(0.0), F.max("end_s") - media), 6).alias("overflow_s"))


def cadence_bands(df: DataFrame, profiles: DataFrame, length: str = "dur", transition: str = "transition", first: str = "none", cut: str = "cut") -> DataFrame:
    """Measured cadence of each project against each profile row, and sorted failure codes.

    A profile gives least and most of the duration, the shots, the length in the normal and in the emphasis band, the shares
    of both, the mean length, and the least share of hard cuts: rows whose transition is cut, or first in a project's first
    row. OUT_OF_BAND tells that the counts of both bands do not add up to the shots. profiles is broadcast if it is small.
    """
    rows = df.select(P, F.round(F.greatest(F.lit(0.0), F.col(length)), 3).alias("_d"), F.expr(f"coalesce({transition} = if(row_number() {over()} = 1, '{first}', '{cut}'), false)").alias("_cut"))
    bounds = [c for c in profiles.columns if c != "profile_id"]
    share = lambda e: F.round(F.avg(F.expr(f"cast({e} as double)")), 6)
    m = rows.crossJoin(if_small(profiles)).groupBy(P, "profile_id").agg(
        F.round(F.sum("_d"), 6).alias("total_s"), F.count("*").alias("shots"), share("_d between normal_min and normal_max").alias("normal_share"), share("_d between emphasis_min and emphasis_max").alias("emphasis_share"),
        F.round(F.avg("_d"), 6).alias("mean_s"), share("_cut").alias("hard_cut_share"), F.expr("count_if(_d between normal_min and normal_max) + count_if(_d between emphasis_min and emphasis_max)").alias("_in"), *[F.first(c).alias(f"_{c}") for c in bounds],
    )
    rules = {
        "SHORT": "total_s < _duration_min", "LONG": "total_s > _duration_max", "FEW_SHOTS": "shots < _shot_min", "MANY_SHOTS": "shots > _shot_max", "OUT_OF_BAND": "_in <> shots", "FEW_NORMAL": "normal_share < _normal_ratio_min", "MANY_NORMAL": "normal_share > _normal_ratio_max",
        "FEW_EMPHASIS": "emphasis_share < _emphasis_ratio_min", "MANY_EMPHASIS": "emphasis_share > _emphasis_ratio_max", "MEAN": "not mean_s between _mean_min and _mean_max", "FEW_HARD_CUTS": "hard_cut_share < _hard_cut_min",
    }
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    return m.select(P, "profile_id", "total_s", "shots", "normal_share", "emphasis_share", "mean_s", "hard_cut_share", F.expr(f"array_join(array_sort(array_compact(array({codes}))), ',')").alias("codes"))


def placed(df: DataFrame, project: str, order: str, ranges: int | None = None) -> DataFrame:
    """df with _r, a row's place in its project from 0 on, and _n, the project's rows; _id tells rows apart, _g projects.

    Rows are dealt to ranges of project and order, ordered in them and written with the number that Spark gives them there; a
    row's place is its distance from the first of its project in the range, and the rows of the project in the ranges before. So
    a project may hold most rows, a null project needs no rule of its own, and any columns that can be compared will do as
    order. Of one order rows stand by a hash of their other columns; nulls come first.
    """
    rest = [f.name for f in df.schema.fields if f.name != project and "map<" not in f.dataType.simpleString()]
    keys = [project, *[o.strip() for o in order.split(",")], "_h", "_m"]
    keyed = df.withColumns({"_h": F.xxhash64(*rest), "_m": F.monotonically_increasing_id()})
    sorted_rows = (keyed.repartitionByRange(ranges, *keys) if ranges else keyed.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    rows = scratch_table(sorted_rows.drop("_h", "_m").withColumn("_id", F.monotonically_increasing_id()), "placed").withColumn("_b", F.shiftright("_id", 33))
    counts = rows.groupBy(F.col(project).alias("_p"), F.col("_b").alias("_q")).agg(F.count("*").alias("_c"), F.min("_id").alias("_f"))
    counts = counts.selectExpr("_p", "_q", f"_f - coalesce(sum(_c) over (partition by _p order by _q {BEFORE}), 0) as _o", "sum(_c) over (partition by _p) as _n", "min(_f) over (partition by _p) as _g")
    met = rows[project].eqNullSafe(counts["_p"]) & (rows["_b"] == counts["_q"])
    return rows.join(counts, met).withColumn("_r", F.col("_id") - F.col("_o")).drop("_b", "_p", "_q", "_o")


def overlapping_chunks(df: DataFrame, size: int, overlap: int, project: str = P, order: str = O, unique: str | None = None) -> DataFrame:
    """df with chunk: ordered rows in chunks of size that share overlap rows; the last may be short. Rows in two chunks occur twice.

    With unique, a column of ids, also repeated: whether the id occurs in more than one row of the project.
    """
    step = size - overlap
    rows = placed(df, project, order)
    if unique is not None:
        many = df.groupBy(F.col(project).alias("_p"), F.col(unique).alias("_u")).count().filter("count > 1").select("_p", "_u", F.lit(True).alias("_m"))
        rows = rows.join(many, F.expr(f"{project} <=> _p and {unique} <=> _u"), "left").withColumn("repeated", F.coalesce("_m", F.lit(False))).drop("_p", "_u", "_m")
    last = f"cast(if(_n <= {size}, 0, ceil((_n - {size}) / {step})) as int)"
    first = f"cast(greatest(0, ceil((_r - {size - 1}) / {step})) as int)"
    return rows.withColumn("chunk", F.expr(f"explode(sequence({first}, least({last}, cast(floor(_r / {step}) as int))))")).drop(*PLACED)


def plan_tiles(df: DataFrame, key: str, height: str, size: int, overlap: int) -> DataFrame:
    """(key, tile, y0, y1, above, below, digest): tiles of size rows that share overlap rows; a height of 0 or null has none.

    above and below are the rows shared with the tile before and after; digest is the sha256 of key, height, size, overlap,
    tile, y0 and y1, joined by bars.
    """
    step = size - overlap
    tiles = df.filter(F.col(height) > 0).withColumn("_last", F.expr(f"cast(if({height} <= {size}, 0, ceil(({height} - {size}) / {step})) as int)")).withColumn("tile", F.expr("explode(sequence(0, _last))"))
    tiles = tiles.withColumns({"y0": F.expr(f"cast(tile * {step} as bigint)"), "y1": F.expr(f"least(cast(tile * {step} + {size} as bigint), {height})")})
    digest = f"sha2(concat_ws('|', {key}, {height}, {size}, {overlap}, tile, y0, y1), 256) as digest"
    return tiles.selectExpr(key, "tile", "y0", "y1", f"if(tile > 0, {overlap}, 0) as above", f"if(tile < _last, {overlap}, 0) as below", digest)


def stride_sample(df: DataFrame, limit: int, project: str = P, order: str = O) -> DataFrame:
    """At most limit rows of each project, evenly spread: rows floor(i * n / limit)."""
    rows = placed(df, project, order)
    return rows.filter(f"_n <= {limit} or floor(ceil(_r * {limit} / _n) * _n / {limit}) = _r and ceil(_r * {limit} / _n) < {limit}").drop(*PLACED)


def bucket_best(df: DataFrame, target: int, score: str, key: str, project: str = P, order: str = O) -> DataFrame:
    """n ordered rows in target equal buckets; the best score of each, then the earliest, then the greatest key."""
    rows = placed(df, project, order).withColumn("bucket", F.expr(f"cast(floor(((_r + 1) * least({target}, _n) - 1) / _n) as int)"))
    best = rows.groupBy("_g", "bucket").agg(F.max_by("_id", F.struct(score, -F.col("_r"), key)).alias("_id")).select("_id")
    return rows.join(best, "_id", "left_semi").drop(*PLACED)


def apportion(df: DataFrame, target: int, weight: str, key: str, project: str = P, cap: str | None = None) -> DataFrame:
    """(project, key, share): target dealt by weight with largest remainders, one each at least and cap (a column) at most.

    What the whole parts leave is dealt one by one in the order of the remainders, round after round, to those below
    their cap. A project whose caps, or whose number of rows, do not allow target has null shares.
    """
    w = f"over (partition by {project})"
    rows = df.withColumn("_c", F.expr(f"greatest(1, cast({cap or target} as int))"))
    rows = rows.withColumn("_q", F.expr(f"{weight} * greatest({target} - count(*) {w}, 0) / sum({weight}) {w}")).withColumn("_f", F.expr("least(_c, 1 + cast(floor(_q) as int))"))
    rows = rows.withColumns({"_left": F.expr(f"cast({target} - sum(_f) {w} as int)"), "_fits": F.expr(f"sum(_c) {w} >= {target} and count(*) {w} <= {target}")})
    rows = rows.withColumn("_k", F.expr(f"row_number() over (partition by {project} order by round(_q - floor(_q), 9) desc, {key})"))
    turns = rows.withColumn("_turn", F.expr("explode_outer(if(_left > 0 and _c > _f, sequence(1, least(_c - _f, _left)), null))"))
    turns = turns.withColumn("_n", F.expr(f"row_number() over (partition by {project} order by _turn is null, _turn, _k)"))
    dealt = turns.groupBy(project, key).agg(F.first("_f").alias("_f"), F.first("_fits").alias("_fits"), F.count_if(F.expr("_turn is not null and _n <= _left")).alias("_more"))
    return dealt.selectExpr(project, key, "if(_fits, _f + _more, null) as share")


def emphasis_pick(df: DataFrame, score: str, section: str, key: str, share: float = 0.25, cap: float = 0.4) -> DataFrame:
    """The top share of a project's rows by score, with at most cap of the target from one section."""
    rows = df.withColumn("_t", F.expr(f"cast(ceil({share} * count(*) over (partition by {P})) as int)"))
    rows = rows.withColumn("_s", F.expr(f"row_number() over (partition by {P}, {section} order by {score} desc, {key})")).filter(f"_s <= greatest(1, floor({cap} * _t))")
    return rows.withColumn("_k", F.expr(f"row_number() over (partition by {P} order by {score} desc, {key})")).filter("_k <= _t").drop("_t", "_s", "_k")


def section_share(df: DataFrame, section: str, total: float, length: str = "dur") -> DataFrame:
    """(project_id, island, section, share_s): runs of a section scaled to total; the last takes the correction."""
    runs = islands(df, section).groupBy(P, "island").agg(F.first(section).alias("section"), F.sum(length).alias("_l"))
    runs = runs.withColumn("_r", F.expr(f"round(_l * {total} / sum(_l) over (partition by {P}), 3)"))
    before = f"coalesce(sum(_r) {over(P, 'island', BEFORE)}, 0.0D)"
    return runs.selectExpr(P, "island", "section", f"round(if(lead(island) {over(P, 'island')} is null, {total} - {before}, _r), 6) as share_s")


def current_version(df: DataFrame, project: str, version: str, approved: str) -> DataFrame:
    """The latest approved version of each project, else the latest."""
    return df.withColumn("_k", F.expr(f"row_number() over (partition by {project} order by {approved} is null, {version} desc)")).filter("_k = 1").drop("_k")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l")).select(*keys, "_l.*")


def next_version(new: DataFrame, old: DataFrame, project: str, order: str, version: str = "version") -> DataFrame:
    """new with version: numbers that go on behind the largest old one of its project."""
    top = old.groupBy(project).agg(F.max(version).alias("_top"))
    return new.join(top, project, "left").withColumn(version, F.expr(f"coalesce(_top, 0) + row_number() over (partition by {project} order by {order})")).drop("_top")


def order_contract(df: DataFrame, project: str, order: str, key: str, low: str, high: str) -> DataFrame:
    """(project, order, code): rows out of strict order, with a gap, a repeated key or bounds that make no sense."""
    rules = {"NOT_INCREASING": f"{order} <= lag({order}) over (partition by {project} order by {order}, {key})", "GAP": f"{order} <> row_number() over (partition by {project} order by {order}, {key})", "DUPLICATE_ID": f"count(*) over (partition by {project}, {key}) > 1", "BAD_BOUNDS": f"{low} >= {high}"}
    codes = ", ".join(f"if({rule}, '{code}', null)" for code, rule in rules.items())
    return df.withColumn("_c", F.expr(f"array_compact(array({codes}))")).selectExpr(project, order, key, "explode(_c) as code")


def coalesce_adjacent(df: DataFrame, evidence: str, text: str, claim: str) -> DataFrame:
    """Neighbours with the same evidence as one row: text joined, claims distinct in order, first and last place."""
    g = islands(df, evidence).groupBy(P, "island").agg(F.first(evidence).alias("evidence"), F.min(O).alias("first_pos"), F.max(O).alias("last_pos"), F.expr(f"array_sort(collect_list(struct({O}, {text} as t, {claim} as c)))").alias("_r"))
    return g.selectExpr(P, "island", "evidence", "first_pos", "last_pos", "array_join(transform(_r, x -> x.t), ' ') as text", "array_join(array_distinct(transform(_r, x -> x.c)), ',') as claims")


def override_latest(checks: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """checks (key, severity, passed) with the latest attributed override (key, actor, at, passed); errors keep their verdict."""
    last = latest(overrides.filter("actor <> ''"), [key], ["at"]).select(key, F.col("passed").alias("_p"), "actor")
    joined = checks.join(last, key, "left")
    return joined.select(key, "severity", F.expr("if(severity = 'error' or _p is null, passed, _p)").alias("passed"), F.expr("severity <> 'error' and _p is not null").alias("overridden"))


def identity_change(df: DataFrame, project: str, version: str, approved: str, fields: list[str]) -> DataFrame:
    """(project, version) whose identity differs from an approved one before."""
    w = f"over (partition by {project} order by {version})"
    same = " and ".join(f"{c} <=> lag({c}) {w}" for c in fields)
    return df.withColumn("_x", F.expr(f"coalesce(lag({approved}) {w}, false) and not ({same})")).filter("_x").select(project, version)


def removable(df: DataFrame, project: str, keep: int, place: list[str], order: list[str]) -> DataFrame:
    """The rows that can go by order, so that keep stay; a project's last row by place never goes."""
    by, last = ", ".join(order), ", ".join(f"{c} desc" for c in place)
    rows = spread(df, project).withColumn("_n", F.expr(f"count(*) over (partition by {project})")).withColumn("_last", F.expr(f"row_number() over (partition by {project} order by {last}) = 1"))
    rows = rows.filter("not _last").withColumn("_k", F.expr(f"row_number() over (partition by {project} order by {by})"))
    return rows.filter(f"_k <= _n - {keep}").drop("_k", "_n", "_last")


def adjacent_similarity(df: DataFrame, project: str, order: str, features: str) -> DataFrame:
    """df with similarity: 1 minus the summed feature distance to the row before, 0 at least; null for the first."""
    before = f"lag({features}) over (partition by {project} order by {order})"
    return df.withColumn("_b", F.expr(before)).withColumn("similarity", F.expr(f"if(_b is null, null, round(greatest(0.0D, 1 - aggregate(zip_with({features}, _b, (x, y) -> abs(cast(x as double) - y)), 0.0D, (s, x) -> s + x)), 6))")).drop("_b")


#: The curves that are known, those that stand for a still emphasis, and the scale of each at the start and what it gains.
CURVES = ["static", "slow_push_in", "slow_pull_out", "pan_horizontal", "pan_vertical", "pan_diagonal", "focus_shift", "push_in", "reveal", "atmospheric", "static_emphasis"]
RESTLESS = ["micro_shake", "impact_shake", "shake_zoom", "orbit", "punch_zoom", "whip_transition", "explosion"]
SCALES = {"slow_push_in": (1.0, 0.06), "slow_pull_out": (1.06, -0.06), "push_in": (1.0, 0.08), "reveal": (1.0, 0.08), "static_emphasis": (1.02, 0.0), "atmospheric": (1.03, 0.0), "static": (1.0, 0.0)}


def sample_curve(df: DataFrame, frames: int, curve: str = "curve") -> DataFrame:
    """(project_id, pos, frame, x, y, scale): smoothstep between (x0, y0) and (x1, y1), kept inside 0.05 to 0.95.

    Still curves stay at (x0, y0); an unknown curve is static, a restless one a still emphasis. frames is 2 at least.
    """
    if frames < 2:
        raise ValueError("frames must be at least two")
    listed = lambda names: ", ".join(f"'{n}'" for n in names)
    safe = f"case when trim({curve}) in ({listed(RESTLESS)}) then 'static_emphasis' when trim({curve}) in ({listed(CURVES)}) then trim({curve}) else 'static' end"
    rows = df.withColumn("_safe", F.expr(safe)).withColumns({f"_{c}": F.expr(f"greatest(0.05D, least(0.95D, {c}))") for c in ("x0", "y0", "x1", "y1")})
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("_p", F.expr(f"frame / {frames - 1}D")).withColumn("_u", F.expr("_p * _p * (3.0D - 2.0D * _p)"))
    scale = "case " + " ".join(f"when _safe = '{k}' then {a}D + {b}D * _u" for k, (a, b) in SCALES.items()) + " else 1.04D end"
    at = lambda c: f"round(if(_safe in ('static', 'static_emphasis'), _{c}0, _{c}0 + (_{c}1 - _{c}0) * _u), 9) as {c}"
    return rows.selectExpr(P, O, "frame", at("x"), at("y"), f"round({scale}, 9) as scale")


def stable_choice(df: DataFrame, seed: str, text: str, options: list[str], history: str | None = None) -> DataFrame:
    """df with choice: the first option not in history (an array column), from the one that the first four bytes of sha256 of seed:pos:text name.

    With every option in history, the one that is named.
    """
    listed, n = ", ".join(f"'{o}'" for o in options), len(options)
    named = df.withColumn("_k", F.expr(f"cast(pmod(cast(conv(substr(sha2(concat_ws(':', '{seed}', {O}, {text}), 256), 1, 8), 16, 10) as bigint), {n}) as int)"))
    turned = f"transform(sequence(0, {n - 1}), i -> get(array({listed}), (_k + i) % {n}))"
    fresh = f"get(filter({turned}, o -> not array_contains(coalesce({history}, array()), o)), 0)" if history else f"get({turned}, 0)"
    return named.withColumn("choice", F.expr(f"coalesce({fresh}, get(array({listed}), _k))")).drop("_k")


def nearest_boundary(events: DataFrame, cuts: DataFrame) -> DataFrame:
    """(project_id, at, cut, distance): for each event (project_id, at) the nearest cut (project_id, at), the earlier on ties."""
    both = events.selectExpr(P, "at", "null as c", "1 as e").unionByName(cuts.selectExpr(P, "at", "at as c", "0 as e"))
    w = f"over (partition by {P} order by at, e rows between unbounded preceding and current row)"
    v = f"over (partition by {P} order by at, e rows between current row and unbounded following)"
    near = both.withColumn("_l", F.expr(f"last(c, true) {w}")).withColumn("_r", F.expr(f"first(c, true) {v}")).filter("e = 1")
    return near.selectExpr(P, "at", "case when _r is null or at - _l <= _r - at then _l else _r end as cut").withColumn("distance", F.expr("abs(at - cut)"))


def interval_overlap(beats: DataFrame, slots: DataFrame, width: float) -> DataFrame:
    """(project_id, slot, beat): for each slot the overlapping beat with most priority, then length, then smallest id.

    Both sides go to buckets of width seconds, which makes the range an equality; a pair is kept in the bucket of its later start.
    """
    spread = "explode(sequence(cast(floor(start_s / {w}) as bigint), cast(floor(end_s / {w}) as bigint))) as bucket".format(w=width)
    b = beats.selectExpr(P, "beat", "priority", "start_s as bs", "end_s as be", spread)
    s = slots.selectExpr(P, "slot", "start_s", "end_s", spread)
    hit = b.join(s, [P, "bucket"]).filter(f"be > start_s and bs < end_s and bucket = cast(floor(greatest(bs, start_s) / {width}) as bigint)")
    return hit.groupBy(P, "slot").agg(F.max_by("beat", F.struct("priority", F.round(F.col("be") - F.col("bs"), 6), -F.col("beat"))).alias("beat"))


def window_membership(words: DataFrame, beats: DataFrame, width: float) -> DataFrame:
    """(project_id, beat, pos): words (project_id, pos, at) inside beats [start_s, end_s), by buckets of width seconds."""
    b = beats.selectExpr(P, "beat", "start_s", "end_s", f"explode(sequence(cast(floor(start_s / {width}) as bigint), cast(floor(end_s / {width}) as bigint))) as bucket")
    w = words.selectExpr(P, O, "at", f"cast(floor(at / {width}) as bigint) as bucket")
    return w.join(b, [P, "bucket"]).filter("at >= start_s and at < end_s").select(P, "beat", O)


def contained_in_one(cues: DataFrame, scenes: DataFrame, width: float, slack: float = 1e-9) -> DataFrame:
    """Cues (project_id, pos, start_s, end_s) that lie in no single scene."""
    s = scenes.selectExpr(P, "start_s as ss", "end_s as se", f"explode(sequence(cast(floor((start_s - {slack}) / {width}) as bigint), cast(floor(end_s / {width}) as bigint))) as bucket")
    c = cues.withColumn("bucket", F.expr(f"cast(floor(start_s / {width}) as bigint)"))
    return c.alias("c").join(s.alias("s"), F.expr(f"c.{P} = s.{P} and c.bucket = s.bucket and c.start_s >= s.ss - {slack} and c.end_s <= s.se + {slack}"), "left_anti").drop("bucket")


def export_srt(cues: DataFrame, block: int = 500) -> DataFrame:
    """(project_id, part, srt): numbered captions of the cues that are not empty, with HH:MM:SS,mmm times, so many to a part.

    The parts of a project, in order and with a blank line between them, are its caption file.
    """
    stamp = "printf('%02d:%02d:%02d,%03d', cast({0} div 3600000 as int), cast(({0} div 60000) % 60 as int), cast(({0} div 1000) % 60 as int), cast({0} % 1000 as int))"
    rows = placed(cues.filter("trim(display) <> ''"), P, O).selectExpr("*", "_r + 1 as n", "cast(round(start_s * 1000) as bigint) as a", "cast(round(end_s * 1000) as bigint) as b")
    rows = rows.withColumn("_text", F.expr(f"concat(n, '\\n', {stamp.format('a')}, ' --> ', {stamp.format('b')}, '\\n', display)"))
    return rows.groupBy(P, F.expr(f"_r div {block}").alias("part")).agg(F.expr("array_join(transform(array_sort(collect_list(struct(n, _text))), x -> x._text), '\\n\\n')").alias("srt"))


def caption_files(parts: DataFrame) -> DataFrame:
    """(project_id, srt): the whole caption file of each project, from its parts (project_id, part, srt)."""
    return parts.groupBy(P).agg(F.expr("array_join(transform(array_sort(collect_list(struct(part, srt))), x -> x.srt), '\\n\\n')").alias("srt"))
