"""Deduplication of long passages by a hash join of windows at content-selected minimisers, in place of a sparse suffix array."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from proofline.llm.arrays import covered, runs, split
from proofline.llm.automata import cut
from proofline.llm.repeats import Scheme, answered, dealt, held, repeated_anchors, repeated_windows, texts_of

#: A passage repeats from so many words on. Seeds are REACH words from minimisers of GRAM words on.
LENGTH, GRAM, REACH = 50, 8, 35


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """The groups of docs, and (g, row, begin, end): maximal spans of length words or more that a smaller document holds.

    Seeds are the reach words from a minimiser on whose hash two documents share; no suffix is sorted. Every match of
    length words holds a seed in its first length - reach + 1 words, so that the windows around seeds, looked up by hash,
    are all that can match; overlapping ones make a span.
    """
    groups, buckets = dealt(docs)
    scheme = Scheme(length, gram, reach)
    seeds = repeated_anchors(groups, buckets, scheme)
    answers = answered(seeds, repeated_windows(groups, buckets, scheme, seeds))

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = defaultdict(list)
        if table.num_rows and answers.num_rows:
            table, texts = texts_of(table)
            words = split(texts)
            at, least, _ = held(words, scheme, answers, buckets)
            doc = words.doc
            at = at[least < table["id"].to_numpy()[doc[at]]] if len(at) else at
            rows = table["row"].to_numpy()
            for d in np.unique(doc[at]) if len(at) else []:
                first = words.first[d]
                own = at[np.searchsorted(at, first) : np.searchsorted(at, words.first[d + 1])] - first
                for b, e in zip(*runs(covered(int(words.first[d + 1] - first), own, own + length))):
                    out["row"].append(rows[d])
                    out["begin"].append(b)
                    out["end"].append(e)
        kinds = {"row": pa.int64(), "begin": pa.int64(), "end": pa.int64()}
        return pa.table({"g": pa.array([key[0].as_py()] * len(out["row"]), pa.int32())} | {k: pa.array(out[k], t) for k, t in kinds.items()})

    return groups, groups.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(extend, "g int, row long, begin long, end long")


def without_repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, removed) of each row of docs.

    The document with the smallest doc_id keeps a passage; in all others its words are removed. Passages that one
    document alone repeats stay. Null and empty texts have no words; a null doc_id counts as larger than all; repeated
    rows get equal results; a text shorter than length loses nothing; empty docs give no rows.
    """
    return cut(*repeated_passages(docs, length, gram, reach))
