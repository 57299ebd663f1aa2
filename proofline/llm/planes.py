"""Token ids in binary files of bit or byte planes, written and read by Spark."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofline.llm.arrays import mixed, powers
from proofline.llm.shared import new_path, written

VOCABULARY = "word_bpe_49k.json"
#: The id that ends a document.
END = 2
#: Ids of a block, and of a file before the next one begins; a file holds whole documents.
BLOCK, FILE = 65_536, 8_388_608
#: Bytes of text that are encoded at a time, and words that a worker remembers.
SLICE, REMEMBERED = 1 << 19, 1 << 19
#: Words that are encoded in a row.
ROW = 256
LEVEL = 3
MAGIC = 0x31534E4C50  # "PLNS1"

# Kinds of bytes: blanks, ASCII letters, other ASCII signs, and what may belong to either side (beyond ASCII, controls, ').
_BLANK, _LETTER, _SIGN, _ANY = range(4)
_KIND = np.full(256, _ANY, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[33:127] = _SIGN
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _ANY
_BASES = (0x9E3779B97F4A7C15, 0xA0761D6478BD642F)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where an installed vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs without blanks, cut between ASCII letters and ASCII signs.

    A vocabulary whose words end at blanks and at such places gives a text the ids of its pieces, one after another.
    """
    kind = _KIND[buffer]
    here, then = kind[:-1], kind[1:]
    edge = np.ones(len(buffer) + 1, bool)
    edge[1:-1] = (here == _BLANK) | (then == _BLANK) | ((here ^ then) == (_LETTER ^ _SIGN)) & (here != _ANY) & (then != _ANY)
    at = np.flatnonzero(edge)
    kept = kind[at[:-1]] != _BLANK
    return at[:-1][kept], at[1:][kept]


def piece_keys(buffer: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each piece."""
    out = []
    for base in _BASES:
        up, down = powers(base, len(buffer) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        out.append(mixed((sums[end] - sums[begin]) * down[begin]))
    return out


class Encoder:
    """A tokenizer that encodes each piece of text once and finds it again by two hashes.

    Where two pieces share the first hash alone, and where a text has a mark of special tokens, texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def plainly(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts, each encoded whole."""
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, count): ids of short texts without blanks, and where each text's lie; texts of letters are encoded many in a row.

        Such a text is one word, with one id that ends a word; where a row has more of these, its texts are encoded alone.
        """
        plain = np.array([t.isalpha() for t in texts], bool) & self.ends.any()
        begin, count, flat, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [], 0
        rows = [np.flatnonzero(plain)[at : at + ROW] for at in range(0, plain.sum(), ROW)]
        alone = [np.flatnonzero(~plain)]
        for row, ids in zip(rows, self.plainly([" ".join(texts[i] for i in row) for row in rows])):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(row):
                alone.append(row)
                continue
            count[row] = np.diff(cuts, prepend=0)
            begin[row] = size + cuts - count[row]
            flat.append(ids)
            size += len(ids)
        rest = np.concatenate(alone)
        coded = self.plainly([texts[i] for i in rest])
        count[rest] = [len(ids) for ids in coded]
        begin[rest] = size + np.cumsum(count[rest]) - count[rest]
        return np.concatenate([np.zeros(0, np.uint32), *flat, *coded]), begin, count

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if any(mark in text for mark in self.marks for text in texts):
            return self.plainly([t.decode() for t in texts])
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        buffer = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
        begin, end = pieces(buffer)
        if not len(begin):
            return [np.zeros(0, np.uint32) for _ in texts]
        key, check = piece_keys(buffer, begin, end)
        unique, first, at = np.unique(key, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self._forget()
        there = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = there < len(self.keys)
        known[inside] = self.keys[there[inside]] == unique[inside]
        if (check != check[first][at]).any() or (self.checks[there[known]] != check[first[known]]).any():
            return self.plainly([t.decode() for t in texts])
        if not known.all():
            fresh = first[~known]
            coded, start, count = self.words([buffer[begin[i] : end[i]].tobytes().decode() for i in fresh])
            start += len(self.ids)
            self.ids = np.concatenate([self.ids, coded])
            at_place = there[~known]
            self.keys, self.checks, self.begin, self.count = (np.insert(old, at_place, new) for old, new in ((self.keys, unique[~known]), (self.checks, check[fresh]), (self.begin, start), (self.count, count)))
            there = np.searchsorted(self.keys, unique)
        count = self.count[there][at]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.begin[there][at] - upto[:-1], count) + np.arange(upto[-1])]
        return np.split(ids, upto[np.searchsorted(begin, offsets[1:-1])])


def slices(text: bytes, size: int = SLICE - 1) -> Iterator[bytes]:
    """A long text in slices that end before a blank."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(b, at + 1, at + size) for b in (b" ", b"\n", b"\t"))
        if cut < 0:
            found = [c for b in (b" ", b"\n", b"\t") if (c := text.find(b, at + size)) >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def shuffled(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of a block of little-endian unsigned ids: all first bytes, then all second ones, or bits from the lowest."""
    rows = ids.view(np.uint8).reshape(len(ids), ids.itemsize)
    if not bits:
        return [np.ascontiguousarray(rows[:, b]).tobytes() for b in range(ids.itemsize)]
    return [np.packbits((ids >> ids.dtype.type(b)) & ids.dtype.type(1)).tobytes() for b in range(8 * ids.itemsize)]


def unshuffled(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    """The block of n ids whose planes these are."""
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], 1).reshape(-1).view(f"<u{width}")
    out = np.zeros(n, f"<u{width}")
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(out.dtype) << out.dtype.type(b)
    return out


@dataclass
class Writer:
    """One file: blocks of compressed planes, then the documents, the chunk index and a tail of fixed size.

    The tail has eight numbers: the magic one, bytes of an id, 1 for bit planes, ids of a block, ids of the file, documents,
    bytes of the documents' section, and the place of the file among all of them. The chunk index has the bytes of each
    plane of each block, so that any block, or any plane of it, can be read alone; documents have a flag (doc_id is null), a
    doc_id and a count of ids each. All numbers are little-endian and have 64 bits, but for the flags' 8.
    """

    width: int
    bits: bool
    block: int
    place: int
    parts: list[bytes] = field(default_factory=list)
    sizes: list[list[int]] = field(default_factory=list)
    waiting: list[np.ndarray] = field(default_factory=list)
    n_waiting: int = 0
    n_ids: int = 0
    names: list[int | None] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    def add(self, name: int | None, ids: list[np.ndarray]) -> None:
        """A document with its ids, which may come in pieces."""
        self.names.append(name)
        self.counts.append(sum(map(len, ids)))
        self.waiting += ids
        self.n_waiting += self.counts[-1]
        self.n_ids += self.counts[-1]
        if self.n_waiting >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        ids = np.concatenate([np.zeros(0, np.uint32), *self.waiting]).astype(f"<u{self.width}")
        whole = len(ids) if last else len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            planes = [packer.compress(p) for p in shuffled(ids[at : min(at + self.block, whole)], self.bits)]
            self.parts += planes
            self.sizes.append([len(p) for p in planes])
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def content(self) -> bytes:
        """The bytes of the file."""
        import zstandard

        self._flush(last=True)
        flags = np.array([n is None for n in self.names], np.uint8).tobytes()
        docs = flags + np.array([n or 0 for n in self.names], "<i8").tobytes() + np.array(self.counts, "<i8").tobytes()
        docs = zstandard.ZstdCompressor(level=LEVEL).compress(docs)
        index = np.array(self.sizes, "<i8").tobytes()
        tail = np.array([MAGIC, self.width, self.bits, self.block, self.n_ids, len(self.names), len(docs), self.place], "<i8").tobytes()
        return b"".join([*self.parts, docs, index, tail])


class Reader:
    """A file's content: its documents, its chunk index, and the ids of any range, for which only their blocks are opened."""

    TAIL = 64

    def __init__(self, content: bytes) -> None:
        import zstandard

        self.content, self.unpack = content, zstandard.ZstdDecompressor().decompress
        magic, self.width, self.bits, self.block, self.n_ids, self.n_docs, size, self.place = map(int, np.frombuffer(content[-self.TAIL :], "<i8"))
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        blocks, planes = -(-self.n_ids // self.block), self.width * (8 if self.bits else 1)
        index_at = len(content) - self.TAIL - 8 * blocks * planes
        self.sizes = np.frombuffer(content, "<i8", blocks * planes, index_at).reshape(blocks, planes)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes.sum(1))]).astype(np.int64)
        docs = self.unpack(content[index_at - size : index_at])
        self.null = np.frombuffer(docs, np.uint8, self.n_docs).astype(bool)
        self.names, self.counts = np.frombuffer(docs, "<i8", 2 * self.n_docs, self.n_docs).reshape(2, -1)

    def block_ids(self, number: int) -> np.ndarray:
        """The ids of one block."""
        at, planes = int(self.starts[number]), []
        for size in self.sizes[number]:
            planes.append(self.unpack(self.content[at : at + size]))
            at += int(size)
        return unshuffled(planes, min(self.block, self.n_ids - number * self.block), self.width, bool(self.bits))

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end - 1 of the file."""
        first = begin // self.block
        found = [self.block_ids(b) for b in range(first, -(-end // self.block))] if end > begin else []
        return np.concatenate([np.zeros(0, f"<u{self.width}"), *found])[begin - first * self.block : end - first * self.block]


_encoders: dict[str, Encoder] = {}


def write_plane_files(docs: DataFrame, path: str, vocabulary: str | None = None, bits: bool = False, block: int = BLOCK, most: int = FILE, end: int = END) -> None:
    """The ids of all documents (doc_id, text), each with the end id, in ascending doc_id order, as files of byte or bit planes.

    Rows are dealt to ranges of doc_id and ordered in them; of one doc_id (nulls first, or repeated ones) by a hash of the
    text and then by their place in the table, so that a doc_id with any share of the rows is spread too. A task writes one
    file after another, each by the sink's own commit: a task that runs again replaces its files. Null text: no ids but the end.
    """
    vocabulary = vocabulary or vocabulary_path()
    keys = ["doc_id", "_hash", "_row"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.select("*", F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_row")).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encoder, place, last = _encoders[vocabulary], TaskContext.get().partitionId() << 32, np.array([end], np.uint32)
        file = Writer(encoder.width, bits, block, place)
        for name, ids in coded_documents(encoder, batches):
            file.add(name, [*ids, last])
            if file.n_ids >= most:
                yield pa.RecordBatch.from_arrays([pa.array([file.content()], pa.binary())], ["value"])
                place += 1
                file = Writer(encoder.width, bits, block, place)
        if file.names:
            yield pa.RecordBatch.from_arrays([pa.array([file.content()], pa.binary())], ["value"])

    files = dealt.select("doc_id", "text").mapInArrow(encoded, "value binary")
    # the text sink writes a row's bytes as they are; with a file for each row and a tail of known size its line end is in nobody's way
    files.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def coded_documents(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(doc_id, ids in pieces) of the rows, encoded about SLICE bytes at a time."""
    waiting: list[tuple[int | None, list[bytes]]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for name, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                data = text.encode()
                if len(data) + 1 >= SLICE:
                    yield from _coded(encoder, waiting)
                    waiting, size = [], 0
                    yield name, [encoder.encode([s])[0] for s in slices(data, SLICE - 1)] if not any(m in data for m in encoder.marks) else encoder.plainly([text])
                    continue
                if size + len(data) >= SLICE:
                    yield from _coded(encoder, waiting)
                    waiting, size = [], 0
                waiting.append((name, data))
                size += len(data) + 1
    yield from _coded(encoder, waiting)


def _coded(encoder: Encoder, waiting: list[tuple]) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    for (name, _), ids in zip(waiting, encoder.encode([data for _, data in waiting])):
        yield name, [ids]


def read_plane_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under path, and with ids its ids without the end.

    start counts the ids of all documents before it, by the sums of the files before and of the file's own documents.
    ids_crc32 is over all of its ids as little-endian unsigned 32-bit numbers. A task reads its files one by one.
    """

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch["content"]:
                file = Reader(value.as_buffer().to_pybytes()[:-1])  # the sink ends a row by a line feed
                till = np.cumsum(file.counts)
                for at in range(0, file.n_docs, 1024):
                    to = min(at + 1024, file.n_docs)
                    base = int(till[at] - file.counts[at])
                    found = file.ids(base, int(till[to - 1])).astype("<u4")
                    cuts = [(int(e - n) - base, int(e) - base) for e, n in zip(till[at:to], file.counts[at:to])]
                    columns = [
                        pa.array([file.place >> 32] * (to - at), pa.int64()), pa.array([file.place & 0xFFFFFFFF] * (to - at), pa.int64()),
                        pa.array(file.names[at:to], pa.int64(), mask=file.null[at:to]), pa.array(till[at:to] - file.counts[at:to], pa.int64()), pa.array(file.counts[at:to], pa.int64()),
                        pa.array([zlib.crc32(found[b:e].tobytes()) for b, e in cuts], pa.int64()), pa.array([found[b : e - 1] if ids else None for b, e in cuts], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "number", "doc_id", "here", "n_tokens", "ids_crc32", "ids"])

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    found = written(files.mapInArrow(decoded, "part long, number long, doc_id long, here long, n_tokens long, ids_crc32 long, ids array<long>"), "decoded")
    sums = found.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = sums.select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("in_part"))
    parts = sums.groupBy("part").agg(F.sum("size").alias("size")).select("part", before(Window.orderBy("part")).alias("of_parts"))
    starts = inside.join(parts, "part").select("part", "number", (F.col("in_part") + F.col("of_parts")).alias("base"))
    told = found.join(starts, ["part", "number"]).withColumn("start", F.col("base") + F.col("here"))
    return told.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids)


def through_files(docs: DataFrame, vocabulary: str | None = None, bits: bool = False, block: int = BLOCK, most: int = FILE) -> DataFrame:
    """read_plane_files of what write_plane_files wrote of docs to the shared folder."""
    path = new_path(docs.sparkSession, "planes")
    write_plane_files(docs, path, vocabulary, bits, block, most)
    return read_plane_files(docs.sparkSession, path)
