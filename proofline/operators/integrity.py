"""Lineage, evidence, manifest and reuse checks: anti joins, coverage and comparisons. No operator collects anything."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofline.operators.sequences import BEFORE, latest, placed, spread
from proofline.sources.files import scratch_table


def orphan_rows(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent id is null, empty or unknown."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct()
    return child.join(known, F.col(key) == F.col("_k"), "left_anti")


def finding(code: str, project: Column, subject: Column, severity: str = "error", passed: Column | None = None, detail: Column | None = None) -> list[Column]:
    """Columns of the one finding schema."""
    return [project.cast("long").alias("project_id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(False) if passed is None else passed).alias("passed"), subject.cast("string").alias("subject_id"), (F.lit("") if detail is None else detail.cast("string")).alias("detail")]


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Findings of many checks as one table."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def lineage_chain_audit(links: list[tuple[str, DataFrame, str, str, DataFrame | None, str]], project: str) -> DataFrame:
    """Findings of each level (name, rows, id, parent id, parents, parents' id): missing parent, repeated id, childless parent."""
    parts = []
    for name, rows, key, up, parents, parent_key in links:
        repeated = rows.groupBy(project, key).count().filter("count > 1")
        parts.append(repeated.select(*finding(f"DUPLICATE_{name}", F.col(project), F.col(key))))
        if parents is not None:
            parts.append(orphan_rows(rows, parents, up, parent_key).select(*finding(f"ORPHAN_{name}", F.col(project), F.col(key))))
            used = rows.select(F.col(up).alias("_u")).distinct()
            childless = parents.join(used, F.col(parent_key) == F.col("_u"), "left_anti")
            parts.append(childless.select(*finding(f"WITHOUT_{name}", F.col(project) if project in parents.columns else F.lit(None), F.col(parent_key))))
    return union_all(parts)


def source_order_findings(name: str, rows: DataFrame, project: str, sequence: str, order: str) -> DataFrame:
    """Findings of a level whose rows, taken by sequence, should have rising source orders.

    MISSING_ORDER for a row without one, DUPLICATE_ORDER for each repeated one, OUT_OF_ORDER for a row below the row before;
    rows without an order are left out of the last two.
    """
    known = rows.filter(F.col(order).isNotNull())
    before = F.expr(f"lag({order}) over (partition by {project} order by {sequence}, {order})")
    falls = known.select(project, sequence, order, before.alias("_b")).filter(F.col(order) < F.col("_b"))
    return union_all([
        rows.filter(F.col(order).isNull()).select(*finding(f"MISSING_ORDER_{name}", F.col(project), F.col(sequence))),
        known.groupBy(project, order).count().filter("count > 1").select(*finding(f"DUPLICATE_ORDER_{name}", F.col(project), F.col(order))),
        falls.select(*finding(f"OUT_OF_ORDER_{name}", F.col(project), F.col(sequence))),
    ])


def evidence_findings(name: str, rows: DataFrame, project: str, key: str, refs: str, known: DataFrame, known_key: str) -> DataFrame:
    """Findings of a level whose rows name evidence in an array: NO_EVIDENCE without any, UNKNOWN_EVIDENCE for each id not in known."""
    empty = rows.filter(F.coalesce(F.size(refs), F.lit(0)) <= 0)
    named = rows.select(project, key, F.explode(refs).alias("_ref"))
    unknown = orphan_rows(named, known, "_ref", known_key)
    return union_all([
        empty.select(*finding(f"NO_EVIDENCE_{name}", F.col(project), F.col(key))),
        unknown.select(*finding(f"UNKNOWN_EVIDENCE_{name}", F.col(project), F.col(key), detail=F.col("_ref"))),
    ])


def manifest_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, state): ids on one side only."""
    e, a = expected.select(key).distinct().withColumn("_e", F.lit(1)), actual.select(key).distinct().withColumn("_a", F.lit(1))
    return e.join(a, key, "full_outer").filter("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("state"))


def claim_coverage(claims: DataFrame, passages: DataFrame, claim: str, evidence: str) -> DataFrame:
    """(claim, required, covered, ratio, code) from claims (claim, evidence) and passages (claim, evidence), one evidence a row.

    code is UNKNOWN_CLAIM for a claim that only passages name, NO_OVERLAP without any covered evidence, else INCOMPLETE or OK.
    """
    side = lambda df, r, h: df.select(claim, evidence, F.lit(r).alias("_r"), F.lit(h).alias("_h"))
    each = spread(side(claims, 1, 0).union(side(passages, 0, 1)), claim, evidence).groupBy(claim, evidence).agg(F.max("_r").alias("_r"), F.max("_h").alias("_h"))
    met = F.expr(f"_r = 1 and _h = 1 and {claim} is not null and {evidence} is not null")
    both = each.groupBy(claim).agg(F.sum("_r").alias("required"), F.count_if(met).alias("covered"))
    code = F.when(F.col("required") == 0, "UNKNOWN_CLAIM").when(F.col("covered") == 0, "NO_OVERLAP").when(F.col("covered") < F.col("required"), "INCOMPLETE").otherwise("OK")
    return both.select(claim, "required", "covered", F.when(F.col("required") > 0, F.round(F.col("covered") / F.col("required"), 6)).alias("ratio"), code.alias("code"))


def eligibility(explicit: DataFrame, cited: DataFrame, section: str, panel: str) -> DataFrame:
    """(section, panel): explicit ids, and for sections without any the cited ones; each once."""
    fallback = cited.join(explicit.select(section).distinct(), section, "left_anti")
    return explicit.select(section, panel).union(fallback.select(section, panel)).distinct()


def unreferenced_files(files: DataFrame, live: DataFrame, references: DataFrame, key: str, parent: str, age: Column, days: int, over_limit: bool = False) -> DataFrame:
    """(key, reason): files of a dead parent, else those that nothing refers to and that are older than days (half of it over the limit)."""
    keep = days // 2 if over_limit else days
    marked = files.join(live.select(parent).distinct().withColumn("_l", F.lit(1)), parent, "left").join(references.select(key).distinct().withColumn("_r", F.lit(1)), key, "left")
    reason = F.when(F.col("_l").isNull(), "orphan").when(F.col("_r").isNull() & (age > keep), "expired")
    return marked.select(key, reason.alias("reason")).filter("reason is not null")


def unshared_blobs(blobs: DataFrame, parent: str, deleted: Column, key: str) -> DataFrame:
    """(key) of the deleted parents that no other parent uses."""
    return blobs.groupBy(key).agg(F.bool_and(deleted).alias("_d")).filter("_d").select(key)


def _set_digests(members: DataFrame, parent: str, member: str) -> DataFrame:
    """(parent, set_hash) of the sets of members: SHA-256 of how many there are and of two sums over halves of their MD5.

    Sums do not hang on order and can be merged, so a parent of any size is summed up before it is shuffled. Null members
    are left out.
    """
    half = lambda i: F.conv(F.substring(F.md5(F.col(member).cast("string").cast("binary")), i, 15), 16, 10).cast("decimal(38,0)")
    distinct = members.filter(F.col(member).isNotNull()).select(parent, member).distinct()
    sums = distinct.groupBy(parent).agg(F.count("*").alias("_n"), F.sum(half(1)).alias("_a"), F.sum(half(16)).alias("_b"))
    return sums.select(parent, "_n", F.sha2(F.concat_ws(":", "_n", "_a", "_b"), 256).alias("set_hash"))


def same_set_match(members: DataFrame, wanted: DataFrame, parent: str, member: str, order: str) -> DataFrame:
    """(set_hash, parent): for each wanted set the earliest parent whose set of members equals it.

    Sets are found by a digest of sums and then compared: a parent stays if it shares as many members as it has with the
    first wanted parent of that digest. No set is gathered.
    """
    sets = _set_digests(members, parent, member)
    asked = _set_digests(wanted, parent, member).groupBy("set_hash").agg(F.min(parent).alias("_w"))
    pairs = sets.join(asked, "set_hash").select("set_hash", parent, "_n", "_w")
    each = lambda df, name: df.filter(F.col(member).isNotNull()).select(F.col(parent).alias(name), F.col(member).alias("_m")).distinct()
    shared = pairs.join(each(members, parent), parent).join(each(wanted, "_w"), ["_w", "_m"])
    equal = shared.groupBy("set_hash", parent).agg(F.count("*").alias("_c"), F.max("_n").alias("_n")).filter("_c = _n").select("set_hash", parent)
    first = members.groupBy(parent).agg(F.min(order).alias("_o"))
    return equal.join(first, parent).groupBy("set_hash").agg(F.min_by(parent, F.struct("_o", parent)).alias(parent))


def resolve_by_checksum(wanted: DataFrame, files: DataFrame, key: str, checksum: str, size: str, path: str) -> DataFrame:
    """(key, path, code): the first file with the checksum; MISSING without one, MISMATCH if its size differs."""
    first = files.groupBy(checksum).agg(F.min(path).alias("path"), F.min_by(size, path).alias("_s"))
    joined = wanted.join(first, checksum, "left")
    return joined.select(key, "path", F.when(F.col("path").isNull(), "MISSING").when(F.col("_s") != F.col(size), "MISMATCH").otherwise("OK").alias("code"))


def reuse_split(inputs: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """inputs with cached: whether all keys stand in the cache."""
    return inputs.join(cache.select(*keys).distinct().withColumn("_c", F.lit(True)), keys, "left").withColumn("cached", F.coalesce("_c", F.lit(False))).drop("_c")


def stale_results(results: DataFrame, current: DataFrame, project: str, stage: str, hashes: list[str]) -> DataFrame:
    """(project, stage, stale): a result whose hashes differ from the current ones, and every stage behind one."""
    now = current.select(project, stage, *[F.col(h).alias(f"_{h}") for h in hashes])
    joined = results.join(now, [project, stage], "left")
    own = ~reduce(lambda a, b: a & b, [F.col(h).eqNullSafe(F.col(f"_{h}")) for h in hashes])
    return joined.withColumn("_own", own).withColumn("stale", F.expr(f"bool_or(_own) over (partition by {project} order by {stage} rows between unbounded preceding and current row)")).select(project, stage, "stale")


_ABSENT = object()


def differing_path(old: object, new: object) -> str | None:
    """The dotted path of the first difference of two JSON values, keys in sorted order; null if they are equal.

    Lists of unequal length differ as a whole, and a key that one side lacks differs at that key.
    """
    left = [((), old, new)]
    while left:
        path, a, b = left.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            left.extend(((*path, k), a.get(k, _ABSENT), b.get(k, _ABSENT)) for k in sorted(a.keys() | b.keys(), reverse=True))
        elif isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
            left.extend(((*path, str(i)), a[i], b[i]) for i in reversed(range(len(a))))
        elif a != b:
            return ".".join(path)
    return None


def _canonical(text: str | None) -> tuple[object, str | None]:
    """A JSON text's value and the sha256 of its canonical form; a text that is no JSON stands for itself as a string."""
    if text is None:
        return None, None
    try:
        value = json.loads(text)
    except ValueError:
        value = text
    return value, hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8", "surrogatepass")).hexdigest()


def _compared(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(old, new):
        (x, hx), (y, hy) = _canonical(a), _canonical(b)
        rows.append((differing_path(x, y), hx, hy))
    return pd.DataFrame(rows, columns=["path", "old_hash", "new_hash"])


def record_diff(old: DataFrame, new: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, old_hash, new_hash) of nested JSON records that differ: the first differing path, and the hashes of both.

    Hashes are of the records with sorted keys and no blanks. Records with equal texts never reach Python; a null record
    equals only a null one, and differs from others at the empty path. The comparison is called nondeterministic, as Spark
    would else make it twice, once for the filter, each time with a Python worker of its own.
    """
    both = old.select(key, F.col(payload).alias("_old")).join(new.select(key, F.col(payload).alias("_new")), key).filter("not (_old <=> _new)")
    compared = F.pandas_udf(_compared, "path string, old_hash string, new_hash string").asNondeterministic()
    return both.select(key, compared("_old", "_new").alias("_d")).select(key, "_d.*").filter("path is not null")


def beat_claim_overlap(beats: DataFrame, claims: DataFrame, beat: str, claim: str, panel: str, rows: int | None = None) -> DataFrame:
    """(beat, claims): distinct claims that share a panel with a beat, from tables of one panel a row.

    rows is how many rows beats has at most, where it is known. Pairs are dealt to four times as many tasks as beats.
    """
    rows = beats.count() if rows is None else rows
    mine, named = (spread(df.select(key, panel), panel, rows=rows).distinct() for df, key in ((beats, beat), (claims, claim)))
    pairs = spread(mine.join(named, panel).select(beat, claim), beat, claim, rows=4 * rows).distinct()
    return pairs.groupBy(beat).agg(F.count(claim).alias("claims"))


def evidence_closure(refs: DataFrame, sections: DataFrame, panels: DataFrame, claim: str, ref: str, section: str, panel: str) -> DataFrame:
    """(claim, panels, unresolved): panels of all sections that contain a claim's refs, and refs in no section.

    Panels that stand in the same sections are counted once, and a claim meets their count, not each panel.
    """
    placed = refs.select(claim, ref).distinct().join(sections.select(ref, section).distinct(), ref, "left")
    held = panels.select(section, panel).dropna().distinct().groupBy(panel).agg(F.array_sort(F.collect_set(section)).alias("_s"))
    alike = held.groupBy("_s").agg(F.min(panel).alias("_k"), F.count("*").alias("_n")).select("_k", "_n", F.explode("_s").alias(section))
    reached = placed.join(alike, section, "left")
    each = reached.groupBy(claim, "_k").agg(F.max("_n").alias("_n"), F.count_distinct(F.when(F.col(section).isNull(), F.col(ref))).alias("_u"))
    return each.groupBy(claim).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("panels"), F.sum("_u").alias("unresolved"))


def resolve_ids(refs: DataFrame, ids: DataFrame, ref: str, key: str) -> DataFrame:
    """(ref, id, code): the id itself, else the only id with that part behind its last __; NONE or SEVERAL otherwise."""
    tails = ids.select(F.substring_index(key, "__", -1).alias("_t"), key).groupBy("_t").agg(F.count("*").alias("_n"), F.min(key).alias("_id"))
    exact = ids.select(F.col(key).alias("_e")).distinct()
    joined = refs.join(exact, F.col(ref) == F.col("_e"), "left").join(tails, F.col(ref) == F.col("_t"), "left")
    found = F.coalesce("_e", F.when(F.col("_n") == 1, F.col("_id")))
    return joined.select(ref, found.alias("id"), F.when(found.isNotNull(), "OK").when(F.col("_n") > 1, "SEVERAL").otherwise("NONE").alias("code"))


def snapshot_parity(snapshots: DataFrame, current: DataFrame, key: str, fields: list[str], attempts: DataFrame | None = None, accepted: str = "accepted") -> DataFrame:
    """(key, code): the first field in which a stored snapshot differs from the current record, MISSING without one, else OK.

    With attempts (key, accepted), a snapshot that agrees but has not exactly one accepted attempt is NO_ACCEPTED or
    MANY_ACCEPTED.
    """
    now = current.select(key, F.lit(True).alias("_here"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = snapshots.join(now, key, "left")
    codes = [F.when(F.col("_here").isNull(), "MISSING"), *[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f.upper()) for f in fields]]
    if attempts is not None:
        joined = joined.join(attempts.groupBy(key).agg(F.count_if(accepted).alias("_won")), key, "left")
        won = F.coalesce("_won", F.lit(0))
        codes += [F.when(won == 0, "NO_ACCEPTED"), F.when(won > 1, "MANY_ACCEPTED")]
    return joined.select(key, F.coalesce(*codes, F.lit("OK")).alias("code"))


def set_fingerprint(df: DataFrame, project: str, order: str, fields: list[str]) -> DataFrame:
    """(project, rows, fingerprint): sha256 over a project's chunks, each of which is the sha256 of its rows' sha256 in order.

    A row's chunk is the first three digits of the md5 of its order value, so that a project is hashed in 4,096 tasks'
    worth of arrays and only their hashes meet.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]).cast("binary"), 256)
    chunk = F.substring(F.md5(F.col(order).cast("string").cast("binary")), 1, 3)
    rows = df.select(project, F.col(order).alias("_o"), row.alias("_h"), chunk.alias("_c"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"])
    chunks = rows.groupBy(project, "_c").agg(F.count("*").alias("_n"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("_d"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("_c", "_d"))), lambda x: F.concat_ws(":", x["_c"], x["_d"]))
    return chunks.groupBy(project).agg(F.sum("_n").alias("rows"), F.sha2(F.array_join(every, ",").cast("binary"), 256).alias("fingerprint"))


def file_manifest(files: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """(folder, name, sha256, size, manifest): each file's hash and bytes, and one hash over its folder's list of them in order of name."""
    rows = files.select(folder, name, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).alias("size"))
    return rows.join(set_fingerprint(rows, folder, name, [name, "sha256", "size"]).select(folder, F.col("fingerprint").alias("manifest")), folder)


def ledger_match(ledger: DataFrame, sources: DataFrame, project: str, order: str, fields: list[str]) -> DataFrame:
    """(project, equal, changed_rows): whether the ordered fingerprints agree, and how many places differ."""
    a, b = (set_fingerprint(x, project, order, fields).select(project, F.col("fingerprint").alias(n)) for x, n in ((ledger, "_a"), (sources, "_b")))
    hashed = lambda df, n: df.select(project, order, F.xxhash64(*fields).alias(n))
    rows = hashed(ledger, "_x").join(hashed(sources, "_y"), [project, order], "full_outer").groupBy(project).agg(F.count_if(~F.col("_x").eqNullSafe(F.col("_y"))).alias("changed_rows"))
    return a.join(b, project, "full_outer").join(rows, project).select(project, F.col("_a").eqNullSafe(F.col("_b")).alias("equal"), "changed_rows")


def check_summary(findings: DataFrame, project: str = "project_id") -> DataFrame:
    """One row a project: its checks, how many failed by severity, and the failed codes, sorted."""
    failed = lambda s: F.array_join(F.array_sort(F.collect_set(F.when((F.col("severity") == s) & ~F.col("passed"), F.col("code")))), ",")
    return findings.groupBy(project).agg(F.count("*").alias("checks"), F.count_if((F.col("severity") == "error") & ~F.col("passed")).alias("errors"), F.count_if((F.col("severity") == "warning") & ~F.col("passed")).alias("warnings"), failed("error").alias("error_codes"), failed("warning").alias("warning_codes"), F.bool_and((F.col("severity") != "error") | F.col("passed")).alias("can_publish"))


def usage_by_area(files: DataFrame, area: str, size: str, limit: int) -> DataFrame:
    """Bytes and over_limit of each area, and of all under the area <all>."""
    return files.rollup(area).agg(F.sum(size).alias("bytes"), F.grouping(area).alias("_g")).select(F.when(F.col("_g") == 1, "<all>").otherwise(F.col(area)).alias("area"), "bytes", (F.col("bytes") > limit).alias("over_limit"))


def single_identity(df: DataFrame, project: str, identity: list[str]) -> DataFrame:
    """(project, identities, empty, passed): exactly one identity and none empty."""
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in identity])
    out = df.groupBy(project).agg(F.count_distinct(F.struct(*identity)).alias("identities"), F.bool_or(empty).alias("empty"))
    return out.withColumn("passed", (F.col("identities") == 1) & ~F.col("empty"))


def missing_sections(sections: DataFrame, allowed: DataFrame, feasible: DataFrame, section: str, beat: str) -> DataFrame:
    """Sections none of whose allowed beats is feasible."""
    ok = allowed.join(feasible.select(beat).distinct(), beat, "left_semi").select(section).distinct()
    return sections.select(section).distinct().join(ok, section, "left_anti")


#: Whole numbers as keys of an inverted index are listed together by all but so many of their low bits.
LOW_BITS = 12


def inverted_index(df: DataFrame, token: str, key: str, block: int = 1024) -> DataFrame:
    """(token, block, n, first, last, ids): the sorted distinct ids of each token in blocks of so many, n of them in the block.

    A token's ids are listed by parts of at most 2 ** LOW_BITS neighbouring ids, so that a token with any share of the rows is
    many tasks' work, and rows meet only once: parts are numbered by their counts and cut at the ends of blocks. first and last
    tell which blocks an id can stand in. Null tokens and ids are left out.
    """
    rows = df.filter(F.col(token).isNotNull() & F.col(key).isNotNull()).select(token, key)
    if rows.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        rows = rows.withColumn("_p", F.shiftright(key, LOW_BITS))
    else:  # other ids are numbered
        numbers = placed(rows.select(F.lit(0).alias("_one"), key).distinct(), "_one", key)
        rows = rows.join(numbers.select(key, F.shiftright("_r", LOW_BITS).alias("_p")), key)
    parts = scratch_table(rows.groupBy(token, "_p").agg(F.array_sort(F.collect_set(key)).alias("_ids")).withColumn("_c", F.size("_ids").cast("long")), "parts")
    starts = parts.select(token, "_p", F.expr(f"coalesce(sum(_c) over (partition by {token} order by _p {BEFORE}), 0) as _o"))
    cut = parts.join(starts, [token, "_p"]).select(token, "_o", "_c", "_ids", F.expr(f"explode(sequence(_o div {block}, (_o + _c - 1) div {block})) as block"))
    cut = cut.select(token, "block", F.expr(f"slice(_ids, cast(greatest(block * {block} - _o, 0) + 1 as int), cast(least((block + 1) * {block} - _o, _c) - greatest(block * {block} - _o, 0) as int)) as _ids"))
    lists = cut.groupBy(token, "block").agg(F.array_sort(F.flatten(F.collect_list("_ids"))).alias("ids"))
    return lists.select(token, "block", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first"), F.array_max("ids").alias("last"), F.array_join("ids", ",").alias("ids"))


def overlap_agreement(df: DataFrame, key: str, chunk: str, payload: str) -> DataFrame:
    """(key, first_chunk, code) of ids seen in several chunks: CONFLICT if payloads differ, SCATTERED if chunks are not consecutive."""
    g = df.groupBy(key).agg(F.min(chunk).alias("first_chunk"), F.max(chunk).alias("_l"), F.count_distinct(chunk).alias("_n"), F.count_distinct(payload).alias("_p")).filter("_n > 1")
    return g.select(key, "first_chunk", F.when(F.col("_p") > 1, "CONFLICT").when(F.col("_l") - F.col("first_chunk") + 1 != F.col("_n"), "SCATTERED").otherwise("OK").alias("code"))


def request_accounting(log: DataFrame, job: str, stage: str, price: float) -> DataFrame:
    """(job, stage, requests, cost) at a price for each request."""
    return log.groupBy(job, stage).agg(F.count("*").alias("requests"), F.round(F.count("*") * price, 6).alias("cost"))


def measured_limits(df: DataFrame, project: str, order: str, value: str, limit: float) -> DataFrame:
    """(project, order, value, largest, n, code): the measured shares of each project in the order of a column.

    largest and n are the project's; code is MISSING if a row has no value, OUT_OF_RANGE if one is below 0 or above limit
    (by more than 1e-9), else OK. The list is one row a value, so that a long project stays in many tasks.
    """
    told = df.groupBy(project).agg(F.max(value).alias("largest"), F.min(value).alias("_least"), F.count(value).alias("n"), F.count("*").alias("_rows"))
    code = F.when(F.col("n") < F.col("_rows"), "MISSING").when((F.col("_least") < 0) | (F.col("largest") > limit + 1e-9), "OUT_OF_RANGE").otherwise("OK")
    return df.select(project, order, value).join(told.select(project, "largest", "n", code.alias("code")), project)


def id_set_compare(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): missing (only in a), extra (only in b) or common."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("common").alias("side"))


def distinct_codes(findings: DataFrame, project: str = "project_id", order: str = "subject_id") -> DataFrame:
    """(project, first_seen, sorted): codes by first sight, and sorted."""
    each = findings.groupBy(project, "code").agg(F.min(order).alias("_o"))
    return each.groupBy(project).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "code"))), lambda x: x["code"]), ",").alias("first_seen"), F.array_join(F.array_sort(F.collect_list("code")), ",").alias("sorted"))


def prefix_merge(df: DataFrame, chunk: str, ids: list[str]) -> DataFrame:
    """Rows of many chunks with their ids, and the ends of their links, prefixed by the chunk."""
    return df.withColumns({i: F.concat(F.lit("c"), F.col(chunk).cast("string"), F.lit("__"), F.col(i).cast("string")) for i in ids})


def remap_best(refs: DataFrame, ledger: DataFrame, beat: str, panel: str, blank: str, order: list[str]) -> DataFrame:
    """(beat, panel, replacement): of another ledger row of the same beat with less blank share the first by order.

    A beat's rows are read once by blank share, with the least of all rows before; a reference to several blank shares counts by
    the largest. Only references whose own panel is that least row are compared with the rows of their beat one by one.
    """
    keys = F.struct(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(order)], F.col(panel).alias("_p"))
    known = ledger.filter(F.col(blank).isNotNull()).select(F.col(beat).alias("_beat"), F.col(blank).alias("_b"), F.lit(1).alias("_side"), F.lit(None).cast(refs.schema[panel].dataType).alias("_ref"), keys.alias("_key"))
    asked = refs.filter(F.col(blank).isNotNull()).groupBy(beat, panel).agg(F.max(blank).alias("_b")).select(F.col(beat).alias("_beat"), "_b", F.lit(0).alias("_side"), F.col(panel).alias("_ref"), F.lit(None).cast(known.schema["_key"].dataType).alias("_key"))
    least = known.unionByName(asked).withColumn("_least", F.expr("min(_key) over (partition by _beat order by _b, _side rows between unbounded preceding and current row)")).filter("_side = 0 and _least is not null")
    own = least.filter("_least._p = _ref").select("_beat", "_ref", F.col("_b").alias("_top"))
    other = own.join(known.select("_beat", "_b", "_key"), "_beat").filter("_b < _top and _key._p <> _ref").groupBy("_beat", "_ref").agg(F.min("_key").alias("_least"))
    found = least.filter("_least._p <> _ref").select("_beat", "_ref", "_least").unionByName(other)
    return found.select(F.col("_beat").alias(beat), F.col("_ref").alias(panel), F.col("_least._p").alias("replacement"))


def job_states(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """Parsed JSON state rows; a malformed one becomes FAILED with a code."""
    parsed = F.from_json(text, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = raw.withColumn("_s", parsed)
    return out.withColumn("status", F.when(F.col("_s._corrupt").isNotNull() | F.col("_s").isNull(), "FAILED").otherwise("READY")).withColumn("error", F.when(F.col("status") == "FAILED", "MALFORMED_STATE"))


def checkpoint_latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key of an append log."""
    return latest(log, keys, order)
