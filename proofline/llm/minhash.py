"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from proofline.llm.arrays import Words, cuts, distinct, mixed, split, windows
from proofline.llm.repeats import dealt, texts_of
from proofline.llm.shared import connected, written

#: A signature has PLACES bytes. Of CHUNKS chunks one at least has at most one error if no more than RADIUS places differ.
PLACES, CHUNKS = 128, 23
RADIUS = 2 * CHUNKS - 1
#: The query's shingle length; a link's least percentage of the union, below which RADIUS would lose pairs.
SHINGLE, PERCENT = 4, 80
#: Bits of the sketch of a shingle set: each is the parity of the shingles that fall on it.
BITS = 1_024
#: Bytes of text whose arrays a task makes at a time.
PART = 1 << 20
#: Entries of a key that are compared with each other at a time.
BLOCK = 4_096
#: Pairs of one document that a task joins with its text; a document with more is copied to more tasks.
DEGREE = 1_024
#: Tasks that the rows of one component are dealt to when they are told its name.
SALTS = 32

_rng = np.random.default_rng(20_240_607)
_FACTORS = _rng.integers(0, 2**64, PLACES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _rng.integers(0, 2**64, PLACES, dtype=np.uint64)
_BYTES = _rng.integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
_TAGS = _rng.integers(0, 2**64, PLACES, dtype=np.uint64)
_CHUNK_OF = np.arange(PLACES) * CHUNKS // PLACES
_CHUNK_STARTS = np.searchsorted(_CHUNK_OF, np.arange(CHUNKS))


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and where each text's begin. A text with fewer words is one shingle; without words, none."""
    sizes = np.diff(words.first)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(words.first[:-1] - first[:-1], counts) + np.arange(first[-1])
    out = windows(words.hash, n)[at] if len(at) else np.zeros(0, np.uint64)
    for short in range(1, min(n, int(sizes.max(initial=0)) + 1)):
        docs = np.flatnonzero(sizes == short)
        if len(docs):
            out[first[docs]] = windows(words.hash, short)[words.first[docs]]
    return out, first


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One byte of each of PLACES minimum hashes for every text with shingles; texts without have zeros."""
    out = np.zeros((len(first) - 1, PLACES), np.uint8)
    docs = np.flatnonzero(np.diff(first))
    step = 0
    while step < len(docs):
        end = max(step + 1, int(np.searchsorted(first[docs], first[docs[step]] + 65_536)))
        part, begins = hashes[first[docs[step]] : first[docs[end - 1] + 1]], first[docs[step:end]] - first[docs[step]]
        for place in range(PLACES):
            least = np.minimum.reduceat(part * _FACTORS[place] + _SHIFTS[place], begins)
            out[docs[step:end], place] = mixed(least).astype(np.uint8)
        step = end
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """PLACES keys for each signature: for each place, its chunk without that place.

    Signatures whose chunk is equal but for one place share the key of that place; equal chunks share them all.
    """
    parts = _BYTES[np.arange(PLACES), signature]
    whole = np.add.reduceat(parts, _CHUNK_STARTS, axis=1)
    return mixed(whole[:, _CHUNK_OF] - parts + _TAGS)


def sketch(shingle_set: np.ndarray) -> bytes:
    """Parities of a set. Where two sketches differ, the sets differ by a shingle at least, so the sketches differ in no more bits than the sets in shingles."""
    return np.packbits(np.bincount((mixed(shingle_set) >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _parts(texts: list[bytes], shingle: int, size: int = PART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """shingles() of the texts, about size bytes at a time, so that a group's arrays are never made at once."""
    begin, held = 0, 0
    for end, text in enumerate(texts, 1):
        held += len(text)
        if held >= size or end == len(texts):
            yield shingles(split(texts[begin:end], lower=True), shingle)
            begin, held = end, 0


def _first_texts(texts: list[bytes], ids: list[int]) -> tuple[list[int], list[int]]:
    """Rows that are the first with their text, and for every row that first row's id."""
    first: dict[bytes, int] = {}
    same = [first.setdefault(t, i) for i, t in enumerate(texts)]
    return [i for i, s in enumerate(same) if s == i], [ids[s] for s in same]


def signed(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, id, n_shingles, same, signature, sketch, keys, text) of every row of docs, by shingles of so many words.

    id is a hash of doc_id and text, so that texts under one doc_id, or under none, are rows of their own; same is the first document of the group with the same text in lower case. Rows that are that document and share a
    chunk key with another have signature, sketch, the shared keys and text; the others have none of these.
    """
    groups, buckets = dealt(docs)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        table, texts = texts_of(table)
        firsts, _ = _first_texts([t.lower() for t in texts], table["row"].to_pylist())
        keys = [chunk_keys(signatures(hashes, first)[np.diff(first) > 0]).ravel() for hashes, first in _parts([texts[i] for i in firsts], shingle)]
        keys, count = np.unique(np.sort(np.concatenate([np.zeros(0, np.uint64), *keys])), return_counts=True)
        cut = cuts(keys, buckets)
        full = np.flatnonzero(np.diff(cut))
        return pa.table({
            "g": pa.array([key[0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
            "keys": pa.array([keys[cut[b] : cut[b + 1]].astype(np.uint32).tobytes() for b in full], pa.binary()), "many": pa.array([np.packbits(count[cut[b] : cut[b + 1]] > 1).tobytes() for b in full], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint32) for k in table["keys"].to_pylist()]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[: len(k)] for m, k in zip(table["many"].to_pylist(), asked)]).astype(bool)
        _, inverse, count = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[inverse[many]] = True
        bits = np.split(shared[inverse], np.cumsum([len(k) for k in asked])[:-1])
        return pa.table({"g": table["g"], "bucket": table["bucket"], "mask": pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())}).filter(pa.array([bool(b.any()) for b in bits]))

    def tell(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, texts = texts_of(table)
        ids = table["row"].to_pylist()
        lowered = [t.lower() for t in texts]
        firsts, same = _first_texts(lowered, ids)
        n, sketches, every = [], [], [np.zeros((0, PLACES), np.uint8)]
        for hashes, first in _parts(lowered, shingle):
            sets = [distinct(hashes[b:e]) for b, e in zip(first[:-1], first[1:])]
            n += [len(x) for x in sets]
            sketches += [sketch(x) for x in sets]
            every.append(signatures(hashes, first))
        keep = np.array([i for i in firsts if n[i]], np.int64)
        signature = np.concatenate(every)[keep]
        keys = chunk_keys(signature) if len(keep) else np.zeros((0, PLACES), np.uint64)
        unique = distinct(keys.ravel())
        shared, cut = np.zeros(len(unique), bool), cuts(unique, buckets)
        for b, mask in zip(answers["bucket"].to_pylist(), answers["mask"].to_pylist()):
            shared[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8))[: cut[b + 1] - cut[b]]
        hit = shared[np.searchsorted(unique, keys)] if len(keep) else np.zeros((0, PLACES), bool)
        rows: list = [(None, None, None, None)] * len(ids)
        for k in np.flatnonzero(hit.any(axis=1)):
            rows[keep[k]] = (signature[k].tobytes(), keys[k][hit[k]].view(np.int64), lowered[keep[k]], sketches[keep[k]])
        return pa.table({
            "doc_id": table["doc_id"], "id": table["row"], "n_shingles": pa.array(n, pa.int64()), "same": pa.array(same, pa.int64()),
            "signature": pa.array([r[0] for r in rows], pa.binary()), "sketch": pa.array([r[3] for r in rows], pa.binary()), "keys": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "text": pa.array([r[2] for r in rows], pa.binary()),
        })

    answers = groups.groupBy("g").applyInArrow(ask, "g int, bucket int, keys binary, many binary").groupBy("bucket").applyInArrow(answer, "g int, bucket int, mask binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(tell, f"doc_id {kind}, id long, n_shingles long, same long, signature binary, sketch binary, keys array<long>, text binary")


def beside(pairs: DataFrame, held: DataFrame, end: str, column: str, name: str) -> DataFrame:
    """pairs with column of held for their end (a or b) as name; a document of many pairs is joined in several tasks."""
    other = "b" if end == "a" else "a"
    many = pairs.groupBy(end).agg(F.ceil(F.count("*") / DEGREE).alias("_parts")).filter("_parts > 1")
    many = written(many, "many")
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt_pairs = pairs.join(many, end, "left").withColumn("_part", F.pmod(F.xxhash64(other), parts)).drop("_parts")
    told = held.select(F.col("id").alias(end), F.col(column).alias(name)).join(many, end, "left")
    told = told.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt_pairs.join(told, [end, "_part"]).drop("_part")


def near_signatures(pairs: DataFrame, signatures: DataFrame, radius: int = RADIUS) -> DataFrame:
    """pairs (a, b) with apart, the places in which their signatures differ, where these are radius at most."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, PLACES) for c in ("sa", "sb"))
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array((a != b).sum(axis=1), pa.int32())], ["a", "b", "apart"])
            yield out.filter(pa.compute.less_equal(out["apart"], radius))

    pairs = written(pairs, "pairs")
    both = beside(beside(pairs, signatures, "a", "signature", "sa"), signatures, "b", "signature", "sb")
    return both.select("a", "b", "sa", "sb").mapInArrow(measure, "a long, b long, apart int")


def _first_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of signatures that share a key, the first that they share."""
    differ = a != b
    errors = np.add.reduceat(differ, _CHUNK_STARTS, axis=1, dtype=np.int32)
    chunk = np.argmax(errors <= 1, axis=1)
    rows = np.arange(len(a))
    place = np.where(errors[rows, chunk] == 0, _CHUNK_STARTS[chunk], np.argmax(differ & (_CHUNK_OF == chunk[:, None]), axis=1))
    return chunk_keys(a)[rows, place].view(np.int64)


def pairs_across(entries: DataFrame, signatures: DataFrame, nearest: bool, radius: int = RADIUS, percent: int = PERCENT) -> DataFrame:
    """(a, b, apart, part_a, part_b): all pairs of entries (key, id, part, n_shingles) with one key, other parts and sizes that allow a link.

    Only pairs within radius whose sketches allow a link leave a task, each at the first key that it shares; with nearest, a task tells only the
    nearest pair of each document and part. A key's entries are dealt to blocks of
    BLOCK, and a task compares two blocks, so that no key has to fit into a task.
    """
    buckets = 16 * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed_keys = entries.groupBy("key").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count("*").alias("_n")).filter("_low < _high")
    entries = entries.join(mixed_keys.select("key", F.ceil(F.col("_n") / BLOCK).alias("_blocks")), "key").join(signatures.select("id", "signature", "sketch"), "id")
    entries = entries.withColumn("block", F.pmod(F.xxhash64("id"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    entries = entries.withColumns({"i": F.least("block", "_other"), "j": F.greatest("block", "_other")})
    entries = entries.select(F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)).cast("int").alias("bucket"), "key", "i", "j", "block", "id", "part", "n_shingles", "signature", "sketch")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in ("key", "i", "j", "block", "id", "part", "n_shingles")}
        order = np.lexsort([columns[c] for c in ("block", "j", "i", "key")])
        k, i, j, block, ids, parts, n = (columns[c][order] for c in columns)
        signature = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(-1, PLACES)[order]
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]]))
        found: list[np.ndarray] = []
        for begin, end in zip(edge[:-1], edge[1:]):
            if parts[begin] == parts[begin:end].max() == parts[begin:end].min():
                continue
            split_at = end if i[begin] == j[begin] else begin + int(np.searchsorted(block[begin:end], j[begin]))
            right = slice(begin, end) if i[begin] == j[begin] else slice(split_at, end)
            for row in range(begin, split_at, 512):
                rows = slice(row, min(row + 512, split_at))
                low, high = np.minimum(n[rows, None], n[None, right]), np.maximum(n[rows, None], n[None, right])
                far = (parts[rows, None] != parts[None, right]) & (100 * low >= percent * high)
                if i[begin] == j[begin]:
                    far &= ids[rows, None] < ids[None, right]
                x, y = np.nonzero(far)
                x, y = x + row, y + right.start
                for cut in range(0, len(x), 65_536):
                    u, v = x[cut : cut + 65_536], y[cut : cut + 65_536]
                    apart = (signature[u] != signature[v]).sum(axis=1)
                    near = apart <= radius
                    u, v, apart = u[near], v[near], apart[near]
                    differ = np.bitwise_count(sketches[u] ^ sketches[v]).sum(axis=1, dtype=np.int64)
                    near = differ * (100 + percent) <= (n[u] + n[v]) * (100 - percent)
                    u, v, apart = u[near], v[near], apart[near]
                    if len(u):
                        first = _first_keys(signature[u], signature[v]) == k[begin]
                        u, v, apart = u[first], v[first], apart[first]
                        u, v = np.where(ids[u] < ids[v], [u, v], [v, u])
                        found.append(np.column_stack([ids[u], ids[v], apart, parts[u], parts[v]]))
        out = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
        if nearest and len(out):
            firsts = np.zeros(len(out), bool)
            for of, to in ((0, 4), (1, 3)):
                order = np.lexsort((out[:, 1 - of], out[:, 2], out[:, to], out[:, of]))
                new = (np.diff(out[order][:, [of, to]], axis=0, prepend=-1) != 0).any(axis=1)
                firsts[order[new]] = True
            out = out[firsts]
        return pa.table({c: pa.array(out[:, k], pa.int64()) for k, c in enumerate(("a", "b", "apart", "part_a", "part_b"))})

    return entries.groupBy("bucket").applyInArrow(compare, "a long, b long, apart long, part_a long, part_b long")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets share percent of their union or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for begin in range(0, batch.num_rows, 64):
                part = batch.slice(begin, 64)
                texts: dict[bytes, int] = {}
                at = [[texts.setdefault(t, len(texts)) for t in part[c].to_pylist()] for c in ("ta", "tb")]
                hashes, first = shingles(split(list(texts), lower=True), shingle)
                sets = [distinct(hashes[b:e]) for b, e in zip(first[:-1], first[1:])]
                for i, j in zip(*at):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    good.append(100 * both >= percent * (len(sets[i]) + len(sets[j]) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs.select("a", "b"), "pairs")
    both = beside(beside(pairs, texts, "a", "text", "ta"), texts, "b", "text", "tb")
    return both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, id, first) of every row of docs.

    Texts are lower-cased (A-Z) and linked if their sets of shingles of so many words share percent of their union,
    which is PERCENT at least; the component is named by its smallest doc_id, and kept are the rows of that doc_id.
    Candidates are all pairs whose signatures differ in RADIUS places at most. First every document is compared with
    the nearest first holder of its chunk keys; what is linked so needs no further pair inside. Then the nearest
    candidates between a document and another component are compared, and at last all candidates between the
    components that are left. Texts without words link with nothing.

    id is xxhash64(doc_id, text): texts under one doc_id are compared each, and so are texts without a doc_id. first
    marks one id of each component, with the smallest doc_id, null last. A component without any doc_id has a null
    component_id, and keeps its first. Equal rows get equal results. Empty docs: no rows.
    """
    if percent < PERCENT:
        raise ValueError(f"percent must be {PERCENT} at least")
    told = written(signed(docs, shingle), "signed")
    held = told.filter("signature is not null").dropDuplicates(["id"])
    keys = held.select("id", "doc_id", "n_shingles", F.explode("keys").alias("key"))
    entries = keys.drop("doc_id")
    centres = keys.groupBy("key").agg(F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("a"))
    stars = entries.join(centres, "key").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    stars = near_signatures(stars, held)
    nearest = stars.groupBy("b").agg(F.min_by("a", F.struct("apart", "a")).alias("a"))
    same = told.filter("same <> id and n_shingles > 0").select(F.col("same").alias("a"), F.col("id").alias("b"))
    links = written(confirmed(nearest, held, percent, shingle).union(same), "links")
    labels = connected(links)

    def label_of(df: DataFrame, column: str, name: str, labels: DataFrame) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(column), F.col("label").alias("_l")), column, "left").withColumn(name, F.coalesce("_l", column)).drop("_l")

    for nearest in (True, False):
        across = pairs_across(label_of(entries, "id", "part", labels), held, nearest, percent=percent)
        if nearest:
            rank = [F.row_number().over(Window.partitionBy(x, f"part_{y}").orderBy("apart", y)) for x, y in (("a", "b"), ("b", "a"))]
            across = across.withColumn("_r", F.least(*rank)).filter("_r = 1")
        more = written(confirmed(across, held, percent, shingle), "more")
        if not more.isEmpty():
            links = links.union(more)
            labels = connected(links)
    out = told.select("doc_id", "id", "n_shingles").join(labels, F.col("id") == F.col("node"), "left").drop("node")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    heads = out.filter("label is not null").groupBy("label").agg(lead.alias("_h")).select("label", F.col("_h.doc_id").alias("_doc"), F.col("_h.id").alias("_first"))
    heads = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = out.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS).cast("long"))).join(heads, ["label", "_salt"], "left")
    named = named.withColumn("component_id", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_doc")))
    named = named.withColumn("first", F.coalesce(F.col("id") == F.col("_first"), F.lit(True)))
    kept = F.when(F.col("component_id").isNull(), F.col("first")).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return named.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "id", "first")
