"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds the token suffixes of all templates.  A file's words stream
through it: at each word the state gives the longest template string that ends
there.  Matches of at least ``min_match`` words are chained, template by
template, into spans that cover a template in order with small gaps; a template
whose chain covers ``min_cover`` of its words labels the file.

Templates are one-line notices and whole licence texts; a text that quotes a
notice of another one gets both labels.

The base phrases are counted apart, at all places.  Null and empty texts have no
words, no label and score 0; repeated rows get equal answers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .licence_texts import TEXTS

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: One-line notices as they stand in files, by label.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("reserved", "all rights reserved"),
)
MIN_MATCH, MIN_COVER, MAX_GAP = 2, 0.8, 3
#: A-Z to a-z; ASCII bytes that are neither letter nor digit part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
             for c in range(256))
TEMPLATES = NOTICES + tuple((label, b" ".join(t.encode().translate(FOLD).split()).decode()) for label, t in TEXTS)


class Automaton:
    """Generalised suffix automaton; a state knows the (template, end) places of its strings."""

    def __init__(self, templates: list[list[str]]):
        self.step: list[dict] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for t, tokens in enumerate(templates):
            last = 0
            for k, word in enumerate(tokens):
                last = self._extend(last, word)
                self.ends[last].add((t, k))
        for s in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            self.ends[self.link[s]] |= self.ends[s]

    def _state(self, step, length, link):
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, p, word, q):
        twin = self._state(dict(self.step[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last, word):
        if word in self.step[last]:
            q = self.step[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def matches(self, words: list):
        """(end, length, state) wherever the match cannot be carried on by the next word."""
        state = length = 0
        for k, w in enumerate([*words, None]):
            if w not in self.step[state]:
                if length:
                    yield k, length, state
                while state and w not in self.step[state]:
                    state = self.link[state]
                    length = self.length[state]
            if w in self.step[state]:
                state = self.step[state][w]
                length += 1
            else:
                state = length = 0


def chains(found, sizes: list[int], min_match: int = MIN_MATCH, max_gap: int = MAX_GAP):
    """(template, first word, end word, covered words) of each chain of matches in template order."""
    open_: dict[int, list] = {}
    done = []
    for end, length, places in found:
        if length < min_match:
            continue
        for t, k in sorted(places):
            start, at = end - length, k - length + 1
            chain = open_.get(t)
            if chain and start - chain[2] <= max_gap and at >= chain[4] - (chain[2] - start if start < chain[2] else 0):
                lost = max(0, chain[2] - start)
                chain[2], chain[3], chain[4] = end, chain[3] + length - lost, k + 1
            elif not chain or end > chain[2]:
                if chain:
                    done.append((t, *chain[1:4]))
                open_[t] = [t, start, end, length, k + 1]
    done += [(t, *c[1:4]) for t, c in open_.items()]
    return [(t, a, e, min(n, sizes[t])) for t, a, e, n in done]


def scan(docs: DataFrame, templates=TEMPLATES, text: str = "text", doc_id: str = "doc_id",
         min_cover: float = MIN_COVER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the covered spans."""
    split = [t.split() for _, t in templates]
    names = [label for label, _ in templates]
    phrases = [(p.split(), label) for p, label in BASE]

    def run(batches):
        auto = Automaton([[w.encode() for w in t] for t in split])
        sizes = [len(t) for t in split]
        number = {w: k + 1 for k, w in enumerate(sorted(auto.step[0]))}
        by_number = [None, *sorted(auto.step[0])]
        for w in (w.encode() for p, _ in phrases for w in p):
            if w not in number:
                number[w] = len(number) + 1
                by_number.append(w)
        base = [([number[w.encode()] for w in p], label) for p, label in phrases]
        get = number.get
        for batch in batches:
            rows = [_scan_one(t, get, by_number, base, auto, sizes, names, min_cover)
                    for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.list_(pa.struct(
                [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                       "spans"])
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string,"
             " labels string, score double, spans array<struct<label:string,start:long,end:long>>")


def _scan_one(text, get, by_number, base, auto, sizes, names, min_cover):
    tokens = (text or "").encode().translate(FOLD).split()
    known = np.fromiter((get(w, 0) for w in tokens), np.int32, len(tokens))
    places, base_labels = [], set()
    for phrase, label in base:
        m = len(known) - len(phrase) + 1
        if m > 0:
            hit = known[:m] == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                hit &= known[k:k + m] == w
            at = np.flatnonzero(hit)
            if len(at):
                places.append(at)
                base_labels.add(label)
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    spans, covered, labels, best = [], 0, set(base_labels), 0.0
    # Words that no template has end every match, so only runs of known words are streamed.
    edge = np.flatnonzero(np.diff(np.r_[0, known > 0, 0]))
    long_runs = edge[1::2] - edge[::2] >= MIN_MATCH
    found = []
    for a, e in zip(edge[::2][long_runs].tolist(), edge[1::2][long_runs].tolist()):
        for end, length, state in auto.matches([by_number[k] for k in known[a:e]]):
            found.append((a + end, length, auto.ends[state]))
    for t, a, e, n in chains(found, sizes):
        best = max(best, n / sizes[t])
        if n >= min_cover * sizes[t]:
            labels.add(names[t])
            spans.append({"label": names[t], "start": a, "end": e})
            covered += n
    return (len(tokens), len(at), int(at.min()) if len(at) else None, int(at.max()) if len(at) else None,
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 if base_labels else min(1.0, best),
            sorted(spans, key=lambda s: (s["start"], s["end"], s["label"])))
