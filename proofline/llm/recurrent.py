"""Scoring of whole documents by a gated recurrent language model that is trained on the corpus itself."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.llm.arrays import cuts, split
from proofline.llm.repeats import dealt, texts_of
from proofline.llm.shared import new_path

ALPHA = 0.1
#: Classes by count: one an octave up to OCTAVES, then SHARP up to the most frequent words, where few share one; then the end.
OCTAVES, SHARP = 10, 24
CLASSES = OCTAVES + SHARP + 1
END = CLASSES - 1
HIDDEN, WINDOW, RATE, LANES, ROUNDS = 16, 16, 2.0, 256, 2
#: Weights of a single code see few tokens of a window, and take larger steps.
FINER = 8
#: Tokens that a task lays out in lanes at a time.
BLOCK = 2_000_000


@dataclass
class Gru:
    """A gated recurrent unit over words. A word's code is its class times parts, and its cell in the class.

    The embedding of a code is the row of its class and its own; it feeds update, reset and candidate. A softmax on the
    state gives the next class, and a softmax of that class, on the state as well, the cell of the next word.
    """

    inputs: np.ndarray  # CLASSES + 1 (start), 3 * HIDDEN
    hidden: np.ndarray  # HIDDEN, 3 * HIDDEN
    output: np.ndarray  # HIDDEN + 1 (bias), CLASSES
    finer: np.ndarray  # CLASSES * parts + 1 (start), 3 * HIDDEN
    within: np.ndarray  # CLASSES, HIDDEN + 1 (bias), parts

    @classmethod
    def new(cls, share: np.ndarray, seed: int = 11) -> Gru:
        """Small random weights, under which each code has about its share of the tokens: (CLASSES, parts)."""
        rng = np.random.default_rng(seed)
        flat = rng.normal(0, 0.15, weights_for(share.shape[1])).astype(np.float32)
        model = cls.of(flat, share.shape[1])
        model.output[-1] = np.log(share.sum(axis=1))
        model.output[:-1] *= 0.1
        model.finer *= 0.3
        model.within[:, :-1] *= 0.1
        model.within[:, -1] = np.log(np.maximum(share / share.sum(axis=1, keepdims=True), 1e-6))
        return model

    @property
    def parts(self) -> int:
        return self.within.shape[2]

    @property
    def start(self) -> int:
        """The code that stands before a document."""
        return CLASSES * self.parts

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.inputs, self.hidden, self.output, self.finer, self.within)])

    @classmethod
    def of(cls, flat: np.ndarray, parts: int) -> Gru:
        shapes = _shapes(parts)
        ends = np.cumsum([math.prod(s) for s in shapes])
        return cls(*(part.reshape(s) for part, s in zip(np.split(flat.astype(np.float32), ends[:-1]), shapes)))

    def embeddings(self) -> np.ndarray:
        """What each code feeds to the gates."""
        both = self.finer.copy()
        both[:-1].reshape(CLASSES, self.parts, -1)[:] += self.inputs[:-1, None]
        both[-1] += self.inputs[-1]
        return both

    def step(self, given: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after reading embeddings from state h, with what the way back needs."""
        back = h @ self.hidden
        gates = 1 / (1 + np.exp(-(given[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])))
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = back[:, 2 * HIDDEN :]
        c = np.tanh(given[:, 2 * HIDDEN :] + r * inner)
        return z * h + (1 - z) * c, z, r, c, inner

    def log_softmax(self, h: np.ndarray) -> np.ndarray:
        return _normal(h @ self.output[:-1] + self.output[-1])

    def cells(self, h: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Rows of h in order of their class kind, but for the end: their places, states with a one, log softmax over the class's cells, and (class, begin, end)."""
        order = np.argsort(kind, kind="stable")
        edge = np.searchsorted(kind[order], np.arange(CLASSES))
        order = order[: edge[END]]
        spans = [(c, edge[c], edge[c + 1]) for c in range(END) if edge[c] < edge[c + 1]]
        states = np.ones((len(order), HIDDEN + 1), np.float32)
        states[:, :-1] = h[order]
        logits = np.empty((len(order), self.parts), np.float32)
        for c, b, e in spans:
            np.matmul(states[b:e], self.within[c], out=logits[b:e])
        return order, states, _normal(logits), spans

    def learn(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, h: np.ndarray, rate: float) -> np.ndarray:
        """One window of back-propagation: codes x, y and live are (steps, lanes). Gives the state to carry into the next window."""
        befores, states, kept, given = [], [], [], self.embeddings()
        for t in range(len(x)):
            before = np.where((x[t] == self.start)[:, None], np.float32(0), h)
            after, *rest = self.step(given[x[t]], before)
            h = np.where(live[t][:, None], after, before)
            befores.append(before)
            states.append(h)
            kept.append(rest)
        flat = np.concatenate(states)
        kind, cell = np.divmod(y.ravel(), self.parts)
        kind = kind.astype(np.uint8)
        wrong = np.exp(self.log_softmax(flat))
        wrong[np.arange(len(wrong)), kind] -= 1
        wrong *= live.reshape(-1, 1)
        d_output = np.vstack([flat.T @ wrong, wrong.sum(axis=0)])
        d_flat = wrong @ self.output[:-1].T
        kind[~live.ravel()] = END  # which has no cells
        order, own, amiss, spans = self.cells(flat, kind)
        np.exp(amiss, out=amiss)
        amiss[np.arange(len(order)), cell[order]] -= 1
        d_within, d_own = np.zeros_like(self.within), np.empty_like(own)
        for c, b, e in spans:
            np.matmul(own[b:e].T, amiss[b:e], out=d_within[c])
            np.matmul(amiss[b:e], self.within[c].T, out=d_own[b:e])
        d_flat[order] += d_own[:, :-1]
        d_flat = d_flat.reshape(len(x), -1, HIDDEN)
        d_given, d_back = (np.empty((*x.shape, 3 * HIDDEN), np.float32) for _ in range(2))
        d_h = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            z, r, c, inner = kept[t]
            on = live[t][:, None]
            d = (d_flat[t] + d_h) * on
            d_c = d * (1 - z) * (1 - c * c)
            d_given[t, :, :HIDDEN] = d_back[t, :, :HIDDEN] = d * (befores[t] - c) * z * (1 - z)
            d_given[t, :, HIDDEN:-HIDDEN] = d_back[t, :, HIDDEN:-HIDDEN] = d_c * inner * r * (1 - r)
            d_given[t, :, -HIDDEN:], d_back[t, :, -HIDDEN:] = d_c, d_c * r
            d_h = d * z + d_back[t] @ self.hidden.T + d_h * ~on
            d_h[x[t] == self.start] = 0
        d_hidden = np.concatenate(befores).T @ d_back.reshape(-1, 3 * HIDDEN)
        order = np.argsort(x, axis=None, kind="stable")
        read, at = np.unique(x.ravel()[order], return_index=True)
        d_in = np.add.reduceat(d_given.reshape(-1, 3 * HIDDEN)[order], at, axis=0)
        kinds, at = np.unique(read // self.parts, return_index=True)
        step = rate / x.shape[1]  # of the lanes that are laid out, so that a few long documents at the end weigh little
        trim = lambda d: np.clip(d, -x.shape[1], x.shape[1]) / len(x)
        self.inputs[kinds] -= step * trim(np.add.reduceat(d_in, at, axis=0))
        self.finer[read] -= FINER * step * trim(d_in)
        self.output -= step * trim(d_output)
        self.hidden -= step * trim(d_hidden)
        self.within -= FINER * step * trim(d_within)
        return h


def _shapes(parts: int) -> list[tuple[int, ...]]:
    return [(CLASSES + 1, 3 * HIDDEN), (HIDDEN, 3 * HIDDEN), (HIDDEN + 1, CLASSES), (CLASSES * parts + 1, 3 * HIDDEN), (CLASSES, HIDDEN + 1, parts)]


def weights_for(parts: int) -> int:
    """The number of weights of a model with so many cells a class."""
    return sum(math.prod(s) for s in _shapes(parts))


def _normal(logits: np.ndarray) -> np.ndarray:
    """logits as logarithms of shares of 1, in place."""
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def parts_for(size: int) -> int:
    """Cells of a class for so many characters of training texts: the power of two from their sixth root on, so that the weights grow with the corpus."""
    return 1 << max(2, math.ceil(math.log2(max(size, 2)) / 6))


def lanes_of(codes: list[np.ndarray], lanes: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid end to end in lanes of about equal length: (steps, lanes) of the code before, the code, and whether there is one; and the order of tokens.

    Each document goes to the lane that is the shortest by then; the longest lane comes first, so that live lanes stay together.
    """
    lanes = max(1, min(lanes, len(codes)))
    heap, place = [(0, k) for k in range(lanes)], [None] * len(codes)
    for i in range(len(codes)):
        length, k = heapq.heappop(heap)
        place[i] = (length, k)
        heapq.heappush(heap, (length + len(codes[i]), k))
    steps = max(length for length, _ in heap)
    rank = {k: i for i, (_, k) in enumerate(sorted(heap, reverse=True))}
    place = [(begin, rank[k]) for begin, k in place]
    y = np.zeros((steps, lanes), np.int64)
    live = np.zeros((steps, lanes), bool)
    new = np.zeros((steps, lanes), bool)
    for i, (begin, k) in enumerate(place):
        y[begin : begin + len(codes[i]), k] = codes[i]
        live[begin : begin + len(codes[i]), k] = True
        new[begin, k] = True
    x = np.full((steps, lanes), start, np.int64)
    x[1:] = y[:-1]
    x[new] = start
    at = np.concatenate([(begin + np.arange(len(c))) * lanes + k for c, (begin, k) in zip(codes, place)])
    return x, y, live, at


def trained(model: Gru, codes: list[np.ndarray], rate: float) -> Gru:
    """model after one pass over documents of codes; the state is carried from window to window and starts anew with each document."""
    x, y, live, _ = lanes_of(codes, LANES, model.start)
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    for t in range(0, len(x), WINDOW):
        part = slice(t, t + WINDOW), slice(0, int(live[t].sum()))
        h = model.learn(x[part], y[part], live[part], h[part[1]], rate * part[1].stop / x.shape[1])
    return model


def scored(model: Gru, codes: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of the code of each token, of all documents in a row; the state runs through a whole document."""
    x, y, live, at = lanes_of(codes, LANES, model.start)
    h, given = np.zeros((x.shape[1], HIDDEN), np.float32), model.embeddings()
    out = np.empty(x.shape, np.float32)
    states = np.empty((WINDOW, *h.shape), np.float32)
    for t in range(0, len(x), WINDOW):
        steps, on = min(WINDOW, len(x) - t), int(live[t].sum())
        h = h[:on]
        for k in range(steps):
            h[x[t + k, :on] == model.start] = 0
            states[k, :on] = h = model.step(given[x[t + k, :on]], h)[0]
        flat = states[:steps, :on].reshape(-1, HIDDEN)
        kind, cell = np.divmod(y[t : t + steps, :on].ravel(), model.parts)
        logs = model.log_softmax(flat)[np.arange(len(flat)), kind]
        order, _, shares, _ = model.cells(flat, kind.astype(np.uint8))
        logs[order] += shares[np.arange(len(order)), cell[order]]
        out[t : t + steps, :on] = logs.reshape(steps, on)
    return out.ravel()[at].astype(np.float64) / math.log(10)


def class_of(counts: np.ndarray, size: int) -> np.ndarray:
    """Class of words by training count; counts of 0 and 1 share class 0. size, the characters of the training texts, sets where the sharp classes end."""
    octave = np.log2(np.maximum(counts, 1))
    sharp = OCTAVES + np.floor(SHARP * (octave - OCTAVES) / max(6.0, math.log2(max(size, 2)) - OCTAVES - 6)).astype(np.int64)
    return np.where(octave < OCTAVES, np.floor(octave).astype(np.int64), np.clip(sharp, OCTAVES, END - 1))


def code_of(counts: np.ndarray, keys: np.ndarray, size: int, parts: int) -> np.ndarray:
    """Code of words by training count and hash; all unknown words share code 0."""
    return np.where(counts > 0, class_of(counts, size) * parts + (keys & np.uint64(parts - 1)).astype(np.int64), 0)


def coded(docs: DataFrame) -> tuple[DataFrame, int]:
    """A written table of docs as codes: (doc_id, row, held_out, half, n_known, log_counts, codes, stats); and the cells of a class.

    codes has two bytes for each token of the document, the end included; log_counts sums log10 of the training counts
    of its words, each with ALPHA added. One more row a bucket (null codes) has stats: words and tokens by code.
    """
    groups, buckets = dealt(docs)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    groups = groups.withColumn("held_out", F.crc32(name.cast("binary")) % 10 == 0)
    size = groups.filter("not held_out").agg(F.sum(F.length("text"))).first()[0] or 0
    parts = parts_for(size)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        table, texts = texts_of(table)
        words = split([t.lower() for t in texts])
        train = ~np.array(table["held_out"].to_pylist(), bool)
        keys, inverse = np.unique(words.hash, return_inverse=True)
        count = np.bincount(inverse, weights=np.repeat(train, np.diff(words.first)), minlength=len(keys)).astype(np.int64)
        cut = cuts(keys, buckets)
        full = np.flatnonzero(np.diff(cut))
        return pa.table({
            "g": pa.array([key[0].as_py()] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()),
            "keys": pa.array([keys[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()), "counts": pa.array([count[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint64) for k in table["keys"].to_pylist()]
        unique, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate([np.frombuffer(c, np.int64) for c in table["counts"].to_pylist()]), minlength=len(unique)).astype(np.int64)
        end, known = np.cumsum([len(k) for k in asked]), count[count > 0]
        codes = code_of(known, unique[count > 0], size, parts)
        kinds = np.bincount(codes, minlength=CLASSES * parts)
        tokens = np.bincount(codes, weights=known, minlength=CLASSES * parts).astype(np.int64)
        bucket = key[0].as_py()
        return pa.table({
            "g": pa.concat_arrays([pa.array([-1 - bucket], pa.int32()), table["g"].combine_chunks()]), "bucket": pa.array([bucket] * (len(asked) + 1), pa.int32()),
            "counts": pa.array([np.concatenate([kinds, tokens]).tobytes(), *(count[inverse[e - len(k) : e]].tobytes() for k, e in zip(asked, end))], pa.binary()),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, row long, held_out boolean, half int, n_known long, log_counts double, codes binary, stats binary"

    def code(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        g = key[0].as_py()
        table, texts = texts_of(table)
        words = split([t.lower() for t in texts])
        keys, inverse = np.unique(words.hash, return_inverse=True)
        counts, cut, stats = np.zeros(len(keys), np.int64), cuts(keys, buckets), []
        for b, c in zip(answers["bucket"].to_pylist(), answers["counts"].to_pylist()):
            if g < 0:
                stats.append(c)
            else:
                counts[cut[b] : cut[b + 1]] = np.frombuffer(c, np.int64)
        codes = code_of(counts, keys, size, parts).astype(np.uint16)[inverse]
        sums = np.concatenate([[0.0], np.cumsum(np.log10(counts + ALPHA)[inverse])])
        known = np.concatenate([[0], np.cumsum(counts[inverse] > 0)])
        n, none = table.num_rows, len(stats)
        ends = np.uint16(END * parts).tobytes()
        rows = [codes[b:e].tobytes() + ends for b, e in zip(words.first[:-1], words.first[1:])] if n else []
        first = words.first if n else np.zeros(1, np.int64)
        pad = lambda values, of: pa.concat_arrays([pa.array(values, of), pa.nulls(none, of)])
        ids = table["doc_id"].combine_chunks()
        return pa.table({
            "doc_id": pa.concat_arrays([ids, pa.nulls(none, ids.type)]), "row": pad(table["row"].to_numpy(), pa.int64()), "held_out": pad(table["held_out"].to_pylist(), pa.bool_()), "half": pad((table["row"].to_numpy() >> 7) % 840, pa.int32()),
            "n_known": pad(known[first[1:]] - known[first[:-1]], pa.int64()), "log_counts": pad(sums[first[1:]] - sums[first[:-1]], pa.float64()), "codes": pad(rows, pa.binary()),
            "stats": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(stats, pa.binary())]),
        })

    answers = groups.groupBy("g").applyInArrow(ask, "g int, bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(answer, "g int, bucket int, counts binary")
    table = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(code, columns)
    path = new_path(docs.sparkSession, "coded")
    table.write.parquet(path)
    return docs.sparkSession.read.schema(table.schema).parquet(path), parts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about BLOCK tokens."""
    held, tokens = [], 0
    for batch in batches:
        held.append(batch)
        tokens += batch["codes"].nbytes // 2
        if tokens >= BLOCK:
            yield pa.Table.from_batches(held)
            held, tokens = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _codes(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(c, np.uint16).astype(np.int64) for c in table["codes"].to_pylist()]


def fitted(table: DataFrame, share: np.ndarray, tokens: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the model after one pass over the training documents of coded(), which are dealt to rounds.

    In a round the documents are dealt to shards of about BLOCK tokens by their row hash, as many as tokens ask for, and
    every shard goes on from the same weights over its documents in the order of the hash; then the shards' weights are
    averaged by their tokens. So the weights do not hang on partitions or cores. Only they, whose number grows with the
    sixth root of the corpus, come to the driver.
    """
    weights, shards = Gru.new(share).flat(), max(1, math.ceil(tokens / (rounds * BLOCK)))
    for k in range(rounds):
        weights = _round(table.filter(f"not held_out and half % {rounds} = {k}"), weights, share.shape[1], RATE / (1 + k), shards)
    return weights


def _round(table: DataFrame, start: np.ndarray, parts: int, rate: float, shards: int) -> np.ndarray:
    def train(key: tuple, table: pa.Table) -> pa.Table:
        model, tokens = Gru.of(start.copy(), parts), 0
        table = table.sort_by("row")
        ends = np.cumsum([len(c) // 2 for c in table["codes"].to_pylist()])
        cut = [0, *np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)), len(ends)]
        for begin, end in zip(cut[:-1], cut[1:]):
            codes = _codes(table.slice(begin, end - begin))
            if codes:
                model = trained(model, codes, rate)
                tokens += sum(map(len, codes))
        flat = model.flat().astype(np.float64)
        return pa.table({"at": pa.array(np.arange(len(flat)), pa.int32()), "weight": pa.array(flat * tokens), "tokens": pa.array(np.full(len(flat), float(tokens)))})

    told = table.select(F.pmod("row", F.lit(shards)).alias("shard"), "row", "codes").groupBy("shard").applyInArrow(train, "at int, weight double, tokens double")
    mean = told.groupBy("at").agg(F.round(F.sum("weight") / F.sum("tokens"), 9).alias("w")).toArrow().sort_by("at")
    return mean["w"].to_numpy().astype(np.float32) if mean.num_rows else start


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Training documents are those whose crc32 of doc_id as text is not 0 modulo 10 (null doc_id: of the empty text).
    Tokens are words in lower case (A-Z) and one end; null and empty texts are one end. A word's probability is that of
    its class and that of its cell within the class, which the recurrent model both gives from all words before it,
    times its share among the words of the cell by training counts with ALPHA added. Frequent words have a cell of their
    own or with few others, rare words share one by hash; unknown words are one more word of the first cell. Counts and training go
    over all training documents. Repeated rows are scored each; without training documents counts are 0. Scores are the
    same for any partitions, up to the rounding of sums.
    """
    table, parts = coded(docs)
    stats, codes = table.filter("stats is not null").select("stats"), CLASSES * parts

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * codes, np.int64)
        for batch in batches:
            for s in batch["stats"].to_pylist():
                total += np.frombuffer(s, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * codes), pa.int32()), pa.array(total)], ["at", "n"])

    sums = np.zeros(2 * codes, np.int64)
    told = stats.mapInArrow(summed, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums[told["at"].to_numpy()] = told["n"].to_numpy()
    ends = table.filter("not held_out").count()
    kinds, tokens = sums[:codes], sums[codes:]
    n, v = int(tokens.sum()) + ends, int(kinds.sum()) + (ends > 0)
    mass = tokens + ALPHA * kinds
    mass[0] += ALPHA
    share = mass.copy().reshape(CLASSES, parts)
    share[END, 0] = ends + ALPHA
    weights = fitted(table, (share + 1e-3) / (share + 1e-3).sum(), n, rounds)
    mass[END * parts] = 1.0
    log_mass, log_total, log_end = np.log10(np.maximum(mass, ALPHA)), math.log10(n + ALPHA * (v + 1)), math.log10(ends + ALPHA)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            codes = _codes(block)
            size = np.array([len(c) for c in codes])
            steps = scored(Gru.of(weights, parts), codes) - log_mass[np.concatenate(codes)]
            cut = np.concatenate([[0], np.cumsum(size)])
            sums = np.concatenate([[0.0], np.cumsum(steps)])
            log_counts = block["log_counts"].to_numpy()
            out = pa.table({
                "doc_id": block["doc_id"], "held_out": block["held_out"], "n_tokens": pa.array(size, pa.int64()), "n_known": pa.array(block["n_known"].to_numpy() + int(ends > 0), pa.int64()), "train_tokens": pa.array(np.full(len(size), n), pa.int64()),
                "base_score": pa.array(log_counts + log_end - size * log_total), "score": pa.array(sums[cut[1:]] - sums[cut[:-1]] + log_counts),
            })
            yield from out.to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return table.filter("codes is not null").mapInArrow(tell, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
