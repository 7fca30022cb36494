"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text.
A text is cross-parsed with every automaton: from each place the longest string
that the sample holds is one phrase, and the language whose parse needs the
fewest phrases, relative to what its own held-back text needs, wins.  Automata
are tables over an alphabet of their own language, and many blocks of text are parsed at once,
one step of all blocks at a time.  A block is first parsed as if a phrase began
with it; then the phrase that the block before it left open is carried on until
both parses begin a phrase at the same place, from where they agree.

The sample is ``docs_per_lang`` different texts of each language, of each a
span of ``chars_per_doc`` characters whose place the text's digest gives; half
of it builds the automaton, half sets the rate.  Texts are parsed whole.  Null texts and texts without a letter
are ``und`` with score 0, as is everything when nothing is labelled.  Ties go
to the name that sorts first; repeated rows get equal answers.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import below_share, held_out

DOCS_PER_LANG, CHARS_PER_DOC, BLOCK, LETTERS = 48, 1_500, 256, 62
CODE_POINTS = 0x110000


def codes(text: str, table: np.ndarray) -> np.ndarray:
    """The alphabet's code of each character of a text in lower case."""
    return table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


@cache
def letters() -> np.ndarray:
    """1 for every code point that is a letter."""
    return np.array([chr(c).isalpha() for c in range(CODE_POINTS)], np.uint8)


def alphabet(texts: list[str]) -> np.ndarray:
    """Code 0 for what is no letter, 1 for letters that the texts lack, then their letters, the frequent ones first.

    Beyond ``LETTERS`` they share codes in turn, so that a script of thousands
    of letters keeps most strings apart and no letter seen counts as unseen.
    """
    counts: dict[str, int] = {}
    for t in texts:
        for ch in t.lower():
            if ch.isalpha():
                counts[ch] = counts.get(ch, 0) + 1
    table = letters().copy()
    for k, ch in enumerate(sorted(counts, key=lambda c: (-counts[c], c))):
        table[ord(ch)] = k % LETTERS + 2
    return table


def automaton(sample: np.ndarray) -> np.ndarray:
    """Transitions of the sample's suffix automaton, state * 64 + code.

    Where there is no transition the next phrase starts: the entry is what the
    root gives, with the top bit set.  All entries of the root have that bit, as
    a letter read there begins a phrase; a letter that the sample lacks is a
    phrase of its own and leads back to the root.
    """
    step: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in sample.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    root = np.zeros(64, np.uint32)
    for c, to in step[0].items():
        root[c] = to
    table = np.tile(root | np.uint32(1 << 31), (len(step), 1))
    for state, moves in enumerate(step):
        for c, to in moves.items():
            table[state, c] = to
    table[0] |= np.uint32(1 << 31)
    return table.ravel()


def phrases(columns: np.ndarray, lengths: np.ndarray, table: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block; ``columns`` is code by place and block, blocks by falling length.

    ``first`` is the row of the block before, or -1.
    """
    height, width = columns.shape
    active = np.searchsorted(-lengths, -np.arange(height), side="left")
    low = np.uint32((1 << 31) - 1)
    begins = np.zeros((height, width), bool)
    state = np.zeros(width, np.uint32)
    for k in range(height):
        n = active[k]
        to = table[(state[:n] << np.uint32(6)) | columns[k, :n]]
        begins[k, :n] = to >> np.uint32(31)
        state[:n] = to & low
    count, whole = begins.sum(0), begins.cumsum(0)
    open_ = np.flatnonzero(first >= 0)  # blocks whose predecessor's last state is new to them
    while len(open_):
        at, own, met = state[first[open_]], np.zeros(len(open_), np.int64), np.zeros(len(open_), np.int64)
        live = np.arange(len(open_))
        for k in range(height):
            live = live[lengths[open_[live]] > k]
            if not len(live):
                break
            to = table[(at[live] << np.uint32(6)) | columns[k, open_[live]]]
            new = (to >> np.uint32(31)).astype(bool)
            at[live], own[live] = to & low, own[live] + new
            same = new & begins[k, open_[live]]
            met[live[same]] = whole[-1, open_[live[same]]] - whole[k, open_[live[same]]] + 1
            live = live[~same]
        count[open_] = own + np.maximum(met - 1, 0)
        apart = (met == 0) & (at != state[open_])
        state[open_[apart]] = at[apart]
        open_ = np.flatnonzero(np.isin(first, open_[apart]))
    return count


def parse(encoded: list[np.ndarray], tables: list[np.ndarray]) -> np.ndarray:
    """Phrases of each text in each language."""
    sizes = np.array([len(e) for e in encoded])
    n_blocks = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(encoded)), n_blocks)
    if not len(text):
        return np.zeros((len(encoded), len(tables)))
    padded = np.zeros((len(text), BLOCK), np.uint8)
    at = np.cumsum(n_blocks) - n_blocks
    flat = padded.ravel()
    for e, a in zip(encoded, at):
        flat[a * BLOCK:a * BLOCK + len(e)] = e
    lengths = np.full(len(text), BLOCK)
    ends = np.cumsum(n_blocks)[n_blocks > 0] - 1
    lengths[ends] = (sizes[n_blocks > 0] - 1) % BLOCK + 1
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(text))
    before = np.where(np.r_[-1, text[:-1]] == text, np.r_[-1, place[:-1]], -1)
    columns = np.ascontiguousarray(padded[order].T)
    out = np.empty((len(encoded), len(tables)))
    for k, table in enumerate(tables):
        count = np.empty(len(text))
        count[order] = phrases(columns, lengths[order], table, before[order])
        out[:, k] = np.bincount(text, weights=count, minlength=len(encoded))
    return out


def fit(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_doc: int = CHARS_PER_DOC) -> dict:
    """The model of a bounded sample of ``labelled`` (doc_id, text, lang)."""
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    # Copies count once; they are reduced before the shuffle, as are the texts to what is used of them.
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars_per_doc, F.lit(0)) + 1) + 1
    span = F.substring("text", start.cast("int"), F.lit(chars_per_doc))
    texts = below_share(rows, "lang", F.xxhash64("text"), docs_per_lang).groupBy(
        "lang", F.xxhash64("text").alias("h")).agg(F.min(span).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    sample = texts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= docs_per_lang).select(
        "lang", "r", "text").collect()
    by: dict[str, list] = {}
    for row in sorted(sample, key=lambda x: (x.lang, x.r)):
        by.setdefault(row.lang, []).append(row.text)
    langs = sorted(by)
    alphabets, tables, rates = [], [], []
    for lang in langs:
        texts = by[lang]
        alphabets.append(alphabet(texts))
        tables.append(automaton(np.concatenate([codes(t + "\n", alphabets[-1]) for t in texts[::2]])))
        own = [codes(t, alphabets[-1]) for t in (texts[1::2] or texts)]
        rates.append(parse(own, tables[-1:]).sum() / max(1, sum(map(len, own))) or 1.0)
    return {"langs": langs, "alphabets": alphabets, "tables": tables, "rates": np.array(rates)}


def predict(docs: DataFrame, model: dict, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; the model is a broadcast of bounded size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        langs = m["langs"]
        for batch in batches:
            names, scores = [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in _bounded(texts, 4_000_000):
                points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in part]
                cost, lettered = np.zeros((len(part), len(langs))), np.zeros(len(part), bool)
                for k, (table, automat) in enumerate(zip(m["alphabets"], m["tables"])):
                    encoded = [table[p] for p in points]
                    cost[:, k] = parse(encoded, [automat])[:, 0] / m["rates"][k]
                    if not k:  # what is a letter is the same in all alphabets
                        lettered = np.array([bool(e.any()) for e in encoded])
                for k in range(len(part)):
                    if not langs or not lettered[k]:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    order = np.argsort(cost[k], kind="stable")
                    names.append(langs[order[0]])
                    best, second = cost[k][order[0]], cost[k][order[1]] if len(langs) > 1 else np.inf
                    scores.append(float(1.0 / (1.0 + (best / second) ** 4)) if second else 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang_pred string, score double")


def _bounded(texts: list[str], chars: int):
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out."""
    model = fit(docs.filter(~held_out("doc_id")).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
