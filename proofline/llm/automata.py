"""Substring deduplication: documents stream through suffix automata of reference shards."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proofline.llm.arrays import covered, mixed, runs, split
from proofline.llm.repeats import LAST, Scheme, answered, dealt, held, repeated_anchors, repeated_windows, texts_of

LENGTH = 13


class SuffixAutomaton:
    """Suffix automaton over word passages; each state knows the smallest document that its words come from."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]
        self.last, self.words = 0, {}

    def add(self, passage: list[bytes], doc: int) -> None:
        """Passages are parted by a word of their own, so that no match runs from one to the next."""
        following, link, length, least, last, codes = self.next, self.link, self.length, self.least, self.last, self.words
        for word in [*[codes.setdefault(w, len(codes)) for w in passage], -len(following)]:
            new = len(following)
            following.append({})
            link.append(0)
            length.append(length[last] + 1)
            least.append(doc if word >= 0 else LAST)
            at, last = last, new
            while at >= 0 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            if at < 0:
                continue
            old = following[at][word]
            if length[old] == length[at] + 1:
                link[new] = old
                continue
            copy = len(following)
            following.append(following[old].copy())
            link.append(link[old])
            length.append(length[at] + 1)
            least.append(least[old])
            while at >= 0 and following[at].get(word) == old:
                following[at][word] = copy
                at = link[at]
            link[old] = link[new] = copy
        self.last = last

    def finish(self) -> None:
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.least[self.link[state]] = min(self.least[self.link[state]], self.least[state])

    def statistics(self, passage: list[bytes], length: int) -> list[tuple[int, int]]:
        """For each word, the longest match that ends there, and the smallest document with its last length words (LAST if shorter)."""
        out, state, matched = [], 0, 0
        for word in passage:
            code = self.words.get(word)
            while state and code not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if code in self.next[state]:
                state, matched = self.next[state][code], matched + 1
            least = LAST
            if matched >= length:
                at = state
                while self.length[self.link[at]] >= length:
                    at = self.link[at]
                least = self.least[at]
            out.append((matched, least))
        return out


def removed_spans(docs: DataFrame, length: int = LENGTH, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The groups of docs, and (g, row, begin, end): maximal word spans covered by windows that a smaller document starts.

    References are the passages of the first document that holds them, so that each distinct repeated window stands in
    one shard; shards hold the first documents by hash. A document visits the shards its repeated windows come from,
    and passages that very many groups ask for are dealt over copies of their shard. The automaton compares words
    themselves, so that a chance equality of hashes removes nothing; windows whose first hash (its upper bits) is equal are
    told apart by a second one, so that each finds its own first holder.
    """
    groups, buckets = dealt(docs)
    scheme = Scheme(length, min(8, length), min(8, length), bits)
    found = repeated_anchors(groups, buckets, scheme)
    answers = answered(found, repeated_windows(groups, buckets, scheme, found))
    shards = 4 * buckets

    def export(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = defaultdict(list)
        if table.num_rows and answers.num_rows:
            table, texts = texts_of(table)
            words = split(texts)
            at, least, salts = held(words, scheme, answers, buckets)
            doc = words.doc[at] if len(at) else at
            ids, rows = table["id"].to_numpy()[doc], table["row"].to_numpy()[doc]
            shard = (mixed(least.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            g = key[0].as_py()
            for ref in (True, False):
                here = np.flatnonzero(least == ids if ref else least < ids)
                if not len(here):
                    continue
                new = np.ones(len(here), bool)
                same = (np.diff(at[here]) == 1) & (np.diff(shard[here]) == 0) & (np.diff(salts[here]) == 0) & (np.diff(doc[here]) == 0)
                new[1:] = ~same
                begins = np.flatnonzero(new)
                ends = np.append(begins[1:], len(here))
                passages: dict[tuple, list[int]] = {}
                for b, e in zip(here[begins], here[ends - 1]):
                    passage = words.joined([(at[b], at[e] + length)])
                    passages.setdefault((passage, int(shard[b]), int(salts[b])), []).append(b)
                for (passage, part, n), at_windows in passages.items():
                    for salt in range(n) if ref else [g % n]:
                        out["shard"].append(part)
                        out["salt"].append(salt)
                        out["ref"].append(ref)
                        out["id"].append(int(ids[at_windows].min()))
                        out["words"].append(passage)
                        out["g"].append(g)
                        out["rows"].append(b"" if ref else rows[at_windows].tobytes())
                        out["begins"].append(b"" if ref else (at[at_windows] - words.first[doc[at_windows]]).astype(np.int64).tobytes())
        kinds = {"shard": pa.int32(), "salt": pa.int32(), "ref": pa.bool_(), "id": pa.int64(), "words": pa.binary(), "g": pa.int32(), "rows": pa.binary(), "begins": pa.binary()}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    def stream(key: tuple, table: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        is_ref = table["ref"]
        for passage, doc in {(w, i) for w, i in zip(*(table.filter(is_ref)[c].to_pylist() for c in ("words", "id")))}:
            automaton.add(passage.split(b" "), doc)
        automaton.finish()
        out: dict[str, list] = defaultdict(list)
        asked = table.filter(pa.compute.invert(is_ref))
        for passage, doc, g, rows, begins in zip(*(asked[c].to_pylist() for c in ("words", "id", "g", "rows", "begins"))):
            statistics = automaton.statistics(passage.split(b" "), length)
            ends = np.flatnonzero(np.array([least < doc for _, least in statistics]))
            span = runs(covered(len(statistics), ends - length + 1, ends + 1))
            for row, begin in zip(np.frombuffer(rows, np.int64), np.frombuffer(begins, np.int64)):
                for b, e in zip(*span):
                    out["g"].append(g)
                    out["row"].append(row)
                    out["begin"].append(begin + b)
                    out["end"].append(begin + e)
        kinds = {"g": pa.int32(), "row": pa.int64(), "begin": pa.int64(), "end": pa.int64()}
        return pa.table({k: pa.array(out[k], t) for k, t in kinds.items()})

    sent = groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(export, "shard int, salt int, ref boolean, id long, words binary, g int, rows binary, begins binary")
    return groups, sent.groupBy("shard", "salt").applyInArrow(stream, "g int, row long, begin long, end long")


def cut(groups: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) of each document of groups, with the words of spans taken out."""

    def keep(key: tuple, table: pa.Table, spans: pa.Table) -> pa.Table:
        table, texts = texts_of(table)
        words = split(texts)
        of_row: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for row, begin, end in zip(*(spans[c].to_pylist() for c in ("row", "begin", "end"))):
            of_row[row].append((begin, end))
        out: dict[str, list] = defaultdict(list)
        for d, row in enumerate(table["row"].to_pylist()):
            first, n = words.first[d], int(words.first[d + 1] - words.first[d])
            gone, text = [], b" ".join(texts[d].split())
            if row in of_row:
                own = np.array(of_row[row], np.int64)
                gone = [(int(b), int(e)) for b, e in zip(*runs(covered(n, own[:, 0], own[:, 1])))]
                edges = [0, *(x for span in gone for x in span), n]
                text = words.joined([(first + b, first + e) for b, e in zip(edges[::2], edges[1::2])])
            out["n_words"].append(n)
            out["n_removed"].append(sum(e - b for b, e in gone))
            out["kept_text"].append(text.decode("utf-8"))
            out["removed"].append([{"begin": b, "end": e} for b, e in gone])
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "removed": pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()}))}
        return pa.table({"doc_id": table["doc_id"]} | {k: pa.array(out[k], t) for k, t in kinds.items()})

    kind = groups.schema["doc_id"].dataType.simpleString()
    return groups.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(keep, f"doc_id {kind}, n_words long, n_removed long, kept_text string, removed array<struct<begin: long, end: long>>")


def without_copied_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) of each row of docs.

    Each word is removed that stands in length consecutive words which also start in a document with a smaller doc_id.
    Null and empty texts have no words; a null doc_id counts as larger than all; repeated rows of one doc_id do not
    copy from each other and get equal results; a text shorter than length loses nothing; empty docs give no rows.
    """
    return cut(*removed_spans(docs, length))
