"""Word windows that stand in several documents, found without a pair of documents being formed.

Documents are dealt to groups. Each group sends the hashes that it holds, once each and packed by bucket, to the buckets;
each bucket answers every group with the hashes that other documents hold too. A hash that stands in a third of all
documents so costs a bucket one entry a group, and no answer is larger than what was asked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import Words, bucket_of, cuts, mixed, sliding, split, windows

LAST = np.iinfo(np.int64).max
#: A window's candidates are salted so that this many groups share a salt.
SALT_GROUPS = 16


@dataclass(frozen=True)
class Scheme:
    """Windows of length words. An anchor is a minimiser of gram words, and its key hashes the reach words from it on.

    Each window holds the anchors of its first length - reach + 1 words whole, so that equal windows share an anchor. A window
    is told by two hashes, of 64 and 32 bits; bits says how many of the first are kept, and fewer than all only serve tests.
    """

    length: int
    gram: int
    reach: int
    bits: int = 64

    @property
    def span(self) -> int:
        return self.length - self.reach + 1


def anchors(words: Words, scheme: Scheme) -> np.ndarray:
    """Word places of the anchors, chosen by content alone."""
    if not len(words.hash):
        return np.zeros(0, np.int64)
    top = np.uint64(2**64 - 1)
    hashed = windows(words.hash, scheme.gram)
    lowest = np.where(words.fits(scheme.length), sliding(hashed, scheme.span, True), np.uint64(0))
    back = sliding(lowest[::-1], scheme.span, False)[::-1]
    return np.flatnonzero((back == hashed) & (back != top))


def dealt(docs: DataFrame, groups_each: int = 4) -> tuple[DataFrame, int]:
    """(g, row, id, doc_id, text): documents in groups, a few for each shuffle partition; and the number of buckets.

    row is a hash of the document that equal rows share; a null doc_id counts as the largest.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.xxhash64("doc_id", "text")
    return docs.select(F.pmod(row, F.lit(partitions * groups_each)).cast("int").alias("g"), row.alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "doc_id", "text"), partitions


def texts_of(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """The rows of a group by id, and their texts; null: empty."""
    table = table.sort_by([("id", "ascending"), ("row", "ascending")])
    return table, [t or b"" for t in table["text"].cast(pa.binary()).to_pylist()]


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _anchor_keys(words: Words, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    at = anchors(words, scheme)
    return at, windows(words.hash, scheme.reach)[at] if len(at) else np.zeros(0, np.uint64)


def repeated_anchors(groups: DataFrame, buckets: int, scheme: Scheme) -> DataFrame:
    """(g, bucket, keys): the low halves of the anchor keys of a group that two documents hold or more.

    The halves are compared within a bucket; a chance hit costs a candidate that the exact steps drop.
    """

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        table, texts = texts_of(table)
        words = split(texts)
        at, keys = _anchor_keys(words, scheme)
        doc = words.doc[at]
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        many = np.zeros(len(keys), bool)
        many[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        many = np.add.reduceat(many, np.flatnonzero(new)) > 0 if len(keys) else many
        keys = keys[new]
        at = cuts(keys, buckets)
        rows = [(b, _blob(keys[at[b] : at[b + 1]].astype(np.uint32)), _blob(np.packbits(many[at[b] : at[b + 1]]))) for b in np.flatnonzero(np.diff(at))]
        return pa.table({"g": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "many": pa.array([r[2] for r in rows], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)].astype(bool) for m, k in zip(table["many"].to_pylist(), asked)]
        every = np.concatenate(asked)
        order = np.argsort(every)
        ranked = every[order]
        more = np.zeros(len(every), bool)
        same = ranked[1:] == ranked[:-1]
        more[1:] = same
        more[:-1] |= same
        hit = np.empty(len(every), bool)
        hit[order] = more
        hit |= np.concatenate(many)
        ends = np.cumsum([len(k) for k in asked])
        keys = [_blob(k[hit[e - len(k) : e]]) for k, e in zip(asked, ends)]
        return pa.table({"g": table["g"], "bucket": table["bucket"], "keys": pa.array(keys, pa.binary())}).filter(pa.array([bool(k) for k in keys], pa.bool_()))

    asked = groups.groupBy("g").applyInArrow(ask, "g int, bucket int, keys binary, many binary")
    return asked.groupBy("bucket").applyInArrow(answer, "g int, bucket int, keys binary")


def candidates(words: Words, scheme: Scheme, answers: pa.Table, buckets: int) -> np.ndarray:
    """Flags of the windows that hold a repeated anchor where windows may have one."""
    at, keys = _anchor_keys(words, scheme)
    known = [np.zeros(0, np.uint64)] + [np.frombuffer(k, np.uint32).astype(np.uint64) | (np.uint64(b) << np.uint64(32)) for b, k in zip(answers["bucket"].to_pylist(), answers["keys"].to_pylist())]
    own = (keys & np.uint64(2**32 - 1)) | (bucket_of(keys, buckets) << np.uint64(32))
    hit = np.zeros(len(words.hash) + 1, np.int64)
    hit[at[np.isin(own, np.concatenate(known))]] = 1
    sums = np.concatenate([[0], np.cumsum(hit)])
    place = np.arange(len(words.hash))
    return words.fits(scheme.length) & (sums[np.minimum(place + scheme.span, len(words.hash))] > sums[place])


def _asked(words: Words, scheme: Scheme, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the candidate windows, each with the index of its key among the group's, and these keys, sorted: two hashes each."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    key = windows(words.hash, scheme.length)[at] >> np.uint64(64 - scheme.bits) << np.uint64(64 - scheme.bits)
    first, inverse, _ = distinct_pairs(key, second_hash(words, scheme.length)[at])
    return at, inverse, *(x[first] for x in (key, second_hash(words, scheme.length)[at]))


def second_hash(words: Words, n: int) -> np.ndarray:
    """A hash of the n words from each word on that does not hang on the first one."""
    return (windows(mixed(words.hash ^ np.uint64(0x5851F42D4C957F2D)), n) >> np.uint64(32)).astype(np.uint32)


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: the place of one of each kind, in order, the kind of each pair, and how many there are of each kind."""
    order = np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    kind = np.empty(len(a), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind, np.diff(np.append(np.flatnonzero(new), len(a)))


def repeated_windows(groups: DataFrame, buckets: int, scheme: Scheme, found: DataFrame) -> DataFrame:
    """(g, bucket, mask, least, salts): of a group's candidate windows those in two documents or more.

    mask has a bit for each hash that the group asked for, in order; for each set bit, least has the smallest id of a
    document that holds the window, and salts the number of parts that its candidates are dealt to.
    """

    def ask(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _empty_ask
        table, texts = texts_of(table)
        words = split(texts)
        at, inverse, keys, checks = _asked(words, scheme, candidates(words, scheme, answers, buckets))
        ids = table["id"].to_numpy()[words.doc[at]] if len(at) else np.zeros(0, np.int64)
        low, high = np.full(len(keys), LAST), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        cut = cuts(keys, buckets)
        rows = [(b, slice(cut[b], cut[b + 1])) for b in np.flatnonzero(np.diff(cut))]
        return pa.table({
            "g": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([b for b, _ in rows], pa.int32()), "keys": pa.array([_blob(keys[s]) for _, s in rows], pa.binary()), "checks": pa.array([_blob(checks[s]) for _, s in rows], pa.binary()),
            "low": pa.array([_blob(low[s]) for _, s in rows], pa.binary()), "many": pa.array([_blob(np.packbits(low[s] != high[s])) for _, s in rows], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)] for m, k in zip(table["many"].to_pylist(), asked)]).astype(bool)
        checks = np.concatenate([np.frombuffer(c, np.uint32) for c in table["checks"].to_pylist()])
        first, inverse, count = distinct_pairs(np.concatenate(asked), checks)
        least = np.full(len(first), LAST)
        np.minimum.at(least, inverse, np.concatenate([np.frombuffer(k, np.int64) for k in table["low"].to_pylist()]))
        more = count > 1
        more[inverse[many]] = True
        salts = np.ones(len(first), np.int32)
        hot = count > SALT_GROUPS
        salts[hot] = 4 ** np.ceil(np.log2(count[hot] / SALT_GROUPS) / 2).astype(np.int32)
        out: dict[str, list] = {"mask": [], "least": [], "salts": []}
        end = np.cumsum([len(k) for k in asked])
        for k, e in zip(asked, end):
            mine = inverse[e - len(k) : e]
            set_bits = more[mine]
            out["mask"].append(_blob(np.packbits(set_bits)))
            out["least"].append(_blob(least[mine[set_bits]]))
            out["salts"].append(_blob(salts[mine[set_bits]]))
        full = pa.table({"g": table["g"], "bucket": table["bucket"]} | {k: pa.array(v, pa.binary()) for k, v in out.items()})
        return full.filter(pa.array([bool(x) for x in out["least"]], pa.bool_()))

    asked = groups.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(ask, "g int, bucket int, keys binary, checks binary, low binary, many binary")
    return asked.groupBy("bucket").applyInArrow(answer, "g int, bucket int, mask binary, least binary, salts binary")


_empty_ask = pa.table({"g": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "checks": pa.array([], pa.binary()), "low": pa.array([], pa.binary()), "many": pa.array([], pa.binary())})


def first_holders(words: Words, scheme: Scheme, flags: np.ndarray, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the repeated windows of a group, the smallest id that holds each, and its number of salts.

    answers has the rows of repeated_windows for the group, flags its candidates.
    """
    at, inverse, keys, _ = _asked(words, scheme, flags)
    least, salts = np.full(len(keys), LAST), np.zeros(len(keys), np.int32)
    cut = cuts(keys, buckets)
    for b, mask, low, salt in zip(*(answers[c].to_pylist() for c in ("bucket", "mask", "least", "salts"))):
        where = cut[b] + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))[: cut[b + 1] - cut[b]])
        least[where], salts[where] = np.frombuffer(low, np.int64), np.frombuffer(salt, np.int32)
    seen = salts[inverse] > 0
    return at[seen], least[inverse[seen]], salts[inverse[seen]]


def answered(found: DataFrame, windows_found: DataFrame) -> DataFrame:
    """Both kinds of answers in one table, for one cogroup: (g, bucket, keys, mask, least, salts)."""
    none = F.lit(None).cast("binary")
    return found.select("g", "bucket", "keys", none.alias("mask"), none.alias("least"), none.alias("salts")).union(windows_found.select("g", "bucket", none.alias("keys"), "mask", "least", "salts"))


def held(words: Words, scheme: Scheme, answers: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first_holders from the answers of one group as answered() has them."""
    is_anchor = pa.compute.is_valid(answers["keys"])
    flags = candidates(words, scheme, answers.filter(is_anchor), buckets)
    return first_holders(words, scheme, flags, answers.filter(pa.compute.invert(is_anchor)), buckets)


