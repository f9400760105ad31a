"""Language identification of code-switched text by a linear-chain conditional random field.

Every word (a run of letters; a long one counts as several) gets a label. A word's score for a label is a sum of learned weights of its affixes,
character bigrams and trigrams, the word itself and lexicon membership; neighbouring labels add a learned transition
weight. Forward-backward over the whole text gives each word's label distribution; a document's language is the label
with the largest sum over its words, its score that label's share.

The model is fitted on the driver on at most `max_docs` labelled texts, those with the smallest hash of the id, and at most
`max_words` words of each from a place set by the hash, spliced into sequences that switch language so that transitions are learned.
Every text is then labelled whole.

Texts that are null or have no letters get `und` with score 0. Rows without a language are not learned from; with nothing
to learn from every text is `und`. Repeated rows are labelled each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.llm.common import slices

UNKNOWN = "und"
SLOTS = 1 << 16
WIDTH = 24  # letters of a word at most; longer runs, as scripts without blanks have, are cut into consecutive words
WORD = re.compile(rf"[^\W\d_]{{1,{WIDTH}}}")
CHUNK_CHARS = 2_000_000
RUNS = T.ArrayType(T.StructType().add("label", "string").add("words", T.IntegerType()))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_slots(words: list[str]) -> np.ndarray:
    """Feature slots of each word, one row a word; unused places are SLOTS."""
    codes = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    size = (codes > 0).sum(1)
    rows = np.arange(len(words))

    def mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
        h = np.full(parts[0].shape, kind + 1, np.uint64)
        for p in parts:
            h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h % np.uint64(SLOTS)).astype(np.int64)

    out = []
    whole = np.zeros(len(words), np.uint64)
    for j in range(WIDTH):
        whole = (whole ^ codes[:, j]) * np.uint64(0x100000001B3)
    out.append(mixed(0, whole)[:, None])
    tail = [codes[rows, np.maximum(size - 1 - k, 0)] for k in range(3)]
    for k in range(3):
        has = size > k
        out.append(np.where(has, mixed(1 + k, *[codes[:, j] for j in range(k + 1)]), SLOTS)[:, None])
        out.append(np.where(has, mixed(4 + k, *tail[: k + 1]), SLOTS)[:, None])
    longest = max(int(size.max(initial=0)), 3)
    for n in (2, 3):
        grams = mixed(5 + n, *[codes[:, k : longest - n + 1 + k] for k in range(n)])
        inside = np.arange(longest - n + 1)[None, :] + n <= size[:, None]
        out.append(np.where(inside, grams, SLOTS))
    return np.concatenate(out, axis=1)


class Tagger:
    """Labels, emission weights by slot (the last row is zero), lexicon weights and transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, int], lexicon_weight: np.ndarray, transition: np.ndarray, first: np.ndarray):
        self.labels, self.weights, self.lexicon, self.lexicon_weight, self.transition, self.first = labels, weights, lexicon, lexicon_weight, transition, first

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for a in range(0, len(words), 10_000):
            slots = word_slots(words[a : a + 10_000])
            for j in range(slots.shape[1]):
                out[a : a + 10_000] += self.weights[slots[:, j]]
        known = np.array([self.lexicon.get(w, -1) for w in words])
        out[known >= 0] += self.lexicon_weight[known[known >= 0]]
        return out


def forward_backward(emission: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label distributions of all words of many sequences at once; sequence i has rows starts[i] to starts[i] + lengths[i].

    The sequences advance in step, longest first, so that those still running are always a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    potential = np.exp(emission - emission.max(1, keepdims=True))
    step = np.exp(transition - transition.max()).astype(np.float32)
    alpha = np.empty_like(potential)
    state = None
    for t, k in enumerate(running):
        at = starts[:k] + t
        state = (np.exp(first - first.max()).astype(np.float32) if state is None else state[:k] @ step) * potential[at]
        state /= state.sum(1, keepdims=True)
        alpha[at] = state
    beta = np.ones((len(lengths), emission.shape[1]), np.float32)
    for t in range(len(running) - 1, -1, -1):
        k = running[t]
        at = starts[:k] + t
        alpha[at] *= beta[:k]
        beta[:k] = (potential[at] * beta[:k]) @ step.T
        beta[:k] /= beta[:k].sum(1, keepdims=True)
    return alpha / alpha.sum(1, keepdims=True)


def marginals(tagger: Tagger, texts: list[list[str]]) -> list[np.ndarray]:
    """Per text, the label distribution of each of its words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = [w for t in texts for w in t]
    if not flat:
        return [np.zeros((0, len(tagger.labels)), np.float32) for _ in texts]
    codes, words = pd.factorize(np.array(flat, dtype=object))
    emission = tagger.emissions(list(words))[codes]
    starts = np.cumsum(lengths) - lengths
    some = lengths > 0
    p = forward_backward(emission, starts[some], lengths[some], tagger.transition, tagger.first)
    return [p[a : a + n] for a, n in zip(starts, lengths, strict=True)]


def train(samples: list[tuple[list[str], str]], rounds: int = 12, lexicon_size: int = 400, length: int = 40) -> Tagger | None:
    """Adagrad on the conditional likelihood of sequences spliced from runs of several texts."""
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return None
    index = {x: i for i, x in enumerate(labels)}
    counts = {x: Counter() for x in labels}
    for words, lang in samples:
        counts[lang].update(words)
    lexicon: dict[str, int] = {}
    for lang in labels:
        for w, _ in counts[lang].most_common(lexicon_size):
            best = max(labels, key=lambda x: counts[x][w] / (sum(counts[x].values()) + 1))
            lexicon[w] = index[best]
    rng = np.random.default_rng(11)
    stream: list[str] = []
    marks: list[int] = []
    runs = [(words[a : a + 20], index[lang]) for words, lang in samples for a in range(0, len(words), 20)]
    for i in rng.permutation(len(runs)):
        stream += runs[i][0]
        marks += [runs[i][1]] * len(runs[i][0])
    length = min(length, max(len(stream), 1))
    total = len(stream) // length
    if not total:
        return None
    codes, words = pd.factorize(np.array(stream[: total * length], dtype=object))
    gold = np.array(marks[: total * length])
    slots = word_slots(list(words))
    known = np.array([lexicon.get(w, -1) for w in words])
    k = len(labels)
    weights, lexicon_weight = np.zeros((SLOTS + 1, k), np.float32), np.zeros((k, k), np.float32)
    transition, first = np.zeros((k, k), np.float32), np.zeros(k, np.float32)
    params = [weights, lexicon_weight, transition, first]
    sums = [np.full_like(p, 1e-2) for p in params]
    tagger = Tagger(labels, weights, lexicon, lexicon_weight, transition, first)
    batch = 128
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(total), max(1, total // batch)):
            rows = (part[:, None] * length + np.arange(length)[None, :]).ravel()
            of = codes[rows]
            used, inverse = np.unique(of, return_inverse=True)
            emission = np.zeros((len(used), k), np.float32)
            for j in range(slots.shape[1]):
                emission += weights[slots[used, j]]
            has = known[used] >= 0
            emission[has] += lexicon_weight[known[used][has]]
            local = emission[inverse]
            p = forward_backward(local, np.arange(len(part)) * length, np.full(len(part), length), transition, first)
            truth = np.eye(k, dtype=np.float32)[gold[rows]]
            error = p - truth
            by_word = np.zeros((len(used), k), np.float32)
            for c in range(k):
                by_word[:, c] = np.bincount(inverse, weights=error[:, c], minlength=len(used))
            gw = np.zeros_like(weights)
            for c in range(k):
                gw[:, c] = np.bincount(slots[used].ravel(), weights=np.repeat(by_word[:, c], slots.shape[1]), minlength=SLOTS + 1)
            gl = np.zeros_like(lexicon_weight)
            np.add.at(gl, known[used][has], by_word[has])
            p3, t3 = p.reshape(len(part), length, k), truth.reshape(len(part), length, k)
            pair = expected_pairs(local.reshape(len(part), length, k), transition, first)
            gt = pair - np.einsum("bti,btj->ij", t3[:, :-1], t3[:, 1:])
            gf = (p3[:, 0] - t3[:, 0]).sum(0)
            for value, g, s in zip(params, (gw, gl, gt, gf), sums, strict=True):
                g = g / len(part) + 1e-5 * value
                s += g * g
                value -= (0.3 * g / np.sqrt(s)).astype(np.float32)
            weights[SLOTS] = 0
    return tagger


def expected_pairs(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over sequences of equal length of the expected counts of neighbouring labels."""
    b, n, k = emission.shape
    potential = np.exp(emission - emission.max(2, keepdims=True)).astype(np.float64)
    step = np.exp(transition - transition.max()).astype(np.float64)
    alpha, beta = np.empty((n, b, k)), np.ones((n, b, k))
    alpha[0] = np.exp(first - first.max()) * potential[:, 0]
    alpha[0] /= alpha[0].sum(1, keepdims=True)
    for t in range(1, n):
        alpha[t] = (alpha[t - 1] @ step) * potential[:, t]
        alpha[t] /= alpha[t].sum(1, keepdims=True)
    for t in range(n - 2, -1, -1):
        beta[t] = (potential[:, t + 1] * beta[t + 1]) @ step.T
        beta[t] /= beta[t].sum(1, keepdims=True)
    out = np.zeros((k, k))
    for t in range(n - 1):
        joint = alpha[t][:, :, None] * step[None] * (potential[:, t + 1] * beta[t + 1])[:, None, :]
        out += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return out


def fit(docs: DataFrame, max_docs: int = 3_000, max_words: int = 80, label: str = "lang") -> Tagger | None:
    """docs: doc_id, text and the label column; rows without label or text are left out."""
    sample = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col(label).alias("label"))
    # ids first, so that the top-k moves no text; at most max_docs rows are sent to the tasks
    ids = sample.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, text, lang in zip(f.doc_id, f.text, f.label, strict=True):
                words = words_of(text)
                at = (int(i) * 2654435761 % 2**32) % max(1, len(words) - max_words + 1)
                rows.append((i, " ".join(words[at : at + max_words]), lang))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "label"])

    got = sample.join(F.broadcast(ids), "doc_id").mapInPandas(pieces, "doc_id long, words string, label string").toPandas()
    got = got.sort_values(["doc_id", "label", "words"])
    return train([(w.split(), x) for w, x in zip(got.words, got.label, strict=True) if w])


def chunks(texts: list[str | None]) -> Iterator[list[int]]:
    """Row numbers in chunks of some two million characters, long texts together."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    part, chars = [], 0
    for i in order:
        n = len(texts[i] or "")
        if part and chars + n > CHUNK_CHARS:
            yield part
            part, chars = [], 0
        part.append(i)
        chars += n
    if part:
        yield part


def predict(docs: DataFrame, tagger: Tagger | None, keep: list[str]) -> DataFrame:
    """The columns `keep` and lang_pred, score, runs; runs are the stretches of words of one label: (label, words)."""
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("runs", RUNS)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep), 4 * CHUNK_CHARS):
            texts = batch.column(len(keep)).to_pylist()
            label, score, runs = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            for part in chunks(texts) if tagger else ():
                for i, p in zip(part, marginals(tagger, [words_of(texts[i]) for i in part]), strict=True):
                    if len(p):
                        share = p.sum(0, dtype=np.float64) / len(p)
                        label[i], score[i] = tagger.labels[int(share.argmax())], float(min(share.max(), 1.0))
                        best = p.argmax(1)
                        edges = np.flatnonzero(np.diff(best, prepend=-1))
                        runs[i] = [{"label": tagger.labels[best[a]], "words": int(n)} for a, n in zip(edges, np.diff(edges, append=len(best)), strict=True)]
            added = [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(runs, pa.list_(pa.struct([("label", pa.string()), ("words", pa.int32())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *added], names=schema.names)

    return docs.select(*keep, F.col("text").alias("text")).mapInArrow(tag, schema)
