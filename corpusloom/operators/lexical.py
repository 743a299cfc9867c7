"""Scores of many queries against many documents without their pairs: numbered terms, an index a task, the best of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

K1, B = 1.2, 0.75
Batches = Iterator[pa.RecordBatch]


class Vocabulary:
    """Numbers for topics and terms of queries, and for the pairs of both that occur: the keys, in order of topic and term."""

    def __init__(self, topics: pa.ChunkedArray, terms: pa.ChunkedArray):
        topics, terms = topics.combine_chunks(), terms.combine_chunks()
        flat, lengths = terms.flatten(), _ints(pc.list_value_length(terms))
        self.topics, self.terms = topics.unique(), flat.unique()
        self.terms = self.terms.take(pc.sort_indices(self.terms))
        self.topic_of_query = _ints(pc.index_in(topics, value_set=self.topics))
        codes = np.repeat(self.topic_of_query, lengths) * len(self.terms) + _ints(pc.index_in(flat, value_set=self.terms))
        self.pairs, at = np.unique(codes, return_inverse=True)
        self.topic_of_key = self.pairs // max(1, len(self.terms))
        self.keys_of_query = [np.sort(x) for x in np.split(at, np.cumsum(lengths)[:-1])] if len(lengths) else []


def _ints(x: pa.Array) -> np.ndarray:
    return pc.fill_null(x, -1).to_numpy(zero_copy_only=False).astype(np.int64)


#: Columns of numbered documents.
NUMBERED = "topic int, doc_id bigint, dl int, keys array<int>, tfs array<int>"


def numbered(topics: pa.Array, terms: pa.Array, pairs: np.ndarray) -> Callable[[Batches], Batches]:
    """Of (topic, doc_id, words) the documents of asked topics, with the keys of the asked terms and how often each occurs."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            batch = batch.filter(pc.is_in(batch.column(0), value_set=topics))
            topic, lengths = _ints(pc.index_in(batch.column(0), value_set=topics)), _ints(pc.list_value_length(batch.column(2)))
            term = _ints(pc.index_in(batch.column(2).flatten(), value_set=terms))
            doc = np.repeat(np.arange(len(topic)), lengths)[term >= 0]
            code = topic[doc] * len(terms) + term[term >= 0]
            at = np.searchsorted(pairs, code)
            hit = pairs[np.minimum(at, len(pairs) - 1)] == code
            both, tf = np.unique(doc[hit] * len(pairs) + at[hit], return_counts=True)
            doc, at = np.divmod(both, max(1, len(pairs)))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(topic) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (at, tf)]
            yield pa.RecordBatch.from_arrays([pa.array(topic, pa.int32()), batch.column(1), pa.array(lengths, pa.int32()), *lists], ["topic", "doc_id", "dl", "keys", "tfs"])

    return run


def best(ids: np.ndarray, topics: np.ndarray, keys_of: list[np.ndarray], idf: np.ndarray, avgdl: np.ndarray, k: int, at_once: int) -> Callable[[Batches], Batches]:
    """Of numbered documents the ``k`` best of each query, among those that come until they hold ``at_once`` terms, then among the next ones."""

    def scored(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        topic, doc, dl = (np.concatenate([_ints(b.column(c)) for b in batches]) for c in range(3))
        keys, tf = (np.concatenate([_ints(b.column(c).flatten()) for b in batches]) for c in (3, 4))
        counts = np.concatenate([_ints(pc.list_value_length(b.column(3))) for b in batches])
        weight = idf[keys] * tf * (K1 + 1) / (tf + np.repeat(K1 * (1 - B + B * dl / avgdl[topic]), counts))
        # Places count the documents of one topic; weights and places stand by key.
        by = np.argsort(topic, kind="stable")
        starts = np.searchsorted(topic[by], np.arange(len(avgdl) + 1))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - starts[topic[by]]
        order = np.argsort(keys, kind="stable")
        weight, place, ends = weight[order], np.repeat(place, counts)[order], np.searchsorted(keys[order], np.arange(len(idf) + 1))
        doc, totals = doc[by], [np.zeros(n) for n in np.diff(starts)]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query, t, own in zip(ids, topics, keys_of):
            total, spans = totals[t], [slice(a, b) for a, b in zip(ends[own], ends[own + 1]) if a < b]
            for x in spans:
                total[place[x]] += weight[x]
            seen = np.flatnonzero(total) if sum(x.stop - x.start for x in spans) > len(total) // 8 else np.unique(np.concatenate([place[:0], *[place[x] for x in spans]]))
            score = total[seen]
            total[seen] = 0
            if len(seen) > k:
                # What rounding may bring level with the last place stays until the ids have decided.
                few = score >= np.partition(score, -k)[-k] - 2e-4
                seen, score = seen[few], score[few]
            score, found = np.round(score, 4), doc[starts[t] + seen]
            first = np.lexsort((found, -score))[:k]
            out.append((np.full(len(first), query), found[first], score[first]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "doc_id", "score"])

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch) + len(batch.column(3).flatten())
            if n >= at_once:
                yield scored(held)
                held, n = [], 0
        if held:
            yield scored(held)

    return run
