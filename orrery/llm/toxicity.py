"""Toxic spans by a linear-chain conditional random field.

Words (runs of word bytes, A-Z in lower case) of a line form a chain of two states, clean and toxic. A
word's emission is a constant plus the weights of its own features (the word, its first 3 to 6 bytes, its
last 3 and 4, its shape) and of the words before and after it; transitions and starts have weights of their own.

Training: on whole texts of a bounded sample of labelled rows (``sample`` toxic and twice as many clean ones, by a
hash of the id; texts of TEXT_BYTES at most, SAMPLE_BYTES in all). Near copies are left out by a hash of two smallest
word hashes; features that fewer than MIN_DOCUMENTS of the sample hold have no weight. Labels are of documents, states
of words, so the words' states are latent: in a clean document all words are clean, in a toxic one at least one is
toxic, but for LEAK, the share of toxic labels that nothing in the text explains. With p the exact probability that all words of a document are clean, gradient steps (AdaGrad)
raise the sum of log((1 - LEAK) p) over clean and log(1 - (1 - LEAK) p) over toxic documents; their slopes are exact
forward-backward marginals. DECAY and STEPS were chosen on a part of the training rows. Labels of an id are joined by maximum; ids of one
label row each are expected.

Scoring: forward-backward over every word of every line; the score is 1 - (1 - LEAK) p, in which p is put together
from each word's marginal given that all words before it are clean. Words of a marginal of 0.5 or more form the
offending spans (code points, end exclusive); where a score of 0.5 or more comes from lesser words only, the largest one does. Null and empty texts have no words and the score LEAK.
Without labelled rows of both kinds every score is the share of toxic rows
(0 without any row). Each row is scored by itself, so repeated rows agree.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field as data_field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import WORD_BYTES, field, map_columns

#: Toxic rows in the training sample at most (twice as many clean ones), bytes of one of its texts at most, and of all.
SAMPLE, TEXT_BYTES, SAMPLE_BYTES = 800, 1_000_000, 16_000_000
#: Documents of the sample that hold a feature, at least.
MIN_DOCUMENTS = 3
#: Share of toxic labels that no word explains.
LEAK = 0.02
STEPS, RATE, DECAY = 40, 0.5, 1.0
CHUNK = 150_000  # words that are scored together
VOCABULARY = 200_000  # distinct words that a worker keeps with their weights
LINE_BYTES = WORD_BYTES[:10] + b"\n" + WORD_BYTES[11:]
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")


def lines_of(text: bytes | None) -> list[list[bytes]]:
    return [line.split() for line in text.translate(LINE_BYTES).split(b"\n")] if text else []


def names(word: bytes) -> list[bytes]:
    """The features of a word: itself, its beginnings and ends, and its shape."""
    out = [b"w" + word] + [b"%d" % k + word[:k] for k in (3, 4, 5, 6) if len(word) > k] + [b"-%d" % k + word[-k:] for k in (3, 4) if len(word) > k]
    return [*out, b"s%d%d%d" % (min(len(word), 8) // 3, any(48 <= c <= 57 for c in word), max(word) > 127)]


@dataclass
class Chains:
    """Words of many lines laid out one after another, longest line first in `order`."""

    starts: np.ndarray
    lengths: np.ndarray
    active: list[int] = data_field(default_factory=list)

    def __post_init__(self):
        order = np.argsort(-self.lengths, kind="stable")
        self.starts, self.lengths = self.starts[order], self.lengths[order]
        longest = int(self.lengths[0]) if len(order) else 0
        # active[t]: how many lines have more than t words
        self.active = (len(order) - np.searchsorted(self.lengths[::-1], np.arange(longest), side="right")).tolist()


def forward_backward(emission: np.ndarray, chains: Chains, start: float, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the toxic state from the left (own emission included) and from the right, at each word. move[x, y]: weight from x to y. Emissions beyond 60 are as at 60."""
    emission = np.clip(emission, -60, 60)
    left, right = np.zeros_like(emission), np.zeros_like(emission)
    cc, ct, tc, tt = np.exp(move - move.max()).ravel().tolist()
    for t, n in enumerate(chains.active):
        at = chains.starts[:n] + t
        if t:
            odds = np.exp(left[at - 1])
            left[at] = emission[at] + np.log((ct + tt * odds) / (cc + tc * odds))
        else:
            left[at] = emission[at] + start
    for t in range(len(chains.active) - 2, -1, -1):
        at = chains.starts[: chains.active[t + 1]] + t
        odds = np.exp(emission[at + 1] + right[at + 1])
        right[at] = np.log((tc + tt * odds) / (cc + ct * odds))
    return left, right


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def log_all_clean(emission: np.ndarray, right: np.ndarray, opens: np.ndarray, start: float, move: np.ndarray) -> np.ndarray:
    """For each word the log-probability that it is clean, given that all before it on its line are."""
    return -np.logaddexp(0, emission + right + np.where(opens, start, move[0, 1] - move[0, 0]))


@dataclass
class Model:
    constant: float
    weights: dict[bytes, float]
    before: dict[bytes, float]  # of the word before
    after: dict[bytes, float]  # of the word after
    start: float
    move: np.ndarray
    same: float | None = None  # the score of all rows, if there was nothing to learn from


@dataclass
class Words:
    """The words of many documents, line after line, with marks at the first and last word of each line."""

    ids: np.ndarray
    doc_of: np.ndarray
    opens: np.ndarray
    ends: np.ndarray
    chains: Chains

    @classmethod
    def of(cls, ids: list[int] | np.ndarray, lengths: np.ndarray, doc_of: np.ndarray) -> "Words":
        starts = np.cumsum(lengths) - lengths
        full = lengths > 0
        opens, ends = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        opens[starts[full]] = True
        ends[(starts + lengths - 1)[full]] = True
        return cls(np.array(ids, np.int64), np.repeat(doc_of, lengths), opens, ends, Chains(starts[full], lengths[full]))

    def emissions(self, own: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """From the weights of each word of the vocabulary: by itself, as the one before and as the one after."""
        out = own[self.ids]
        later, earlier = np.flatnonzero(~self.opens), np.flatnonzero(~self.ends)
        out[later] += before[self.ids[later - 1]]
        out[earlier] += after[self.ids[earlier + 1]]
        return out


def without_copies(docs: list[tuple[list[list[bytes]], int]]) -> list[tuple[list[list[bytes]], int]]:
    """One document for each label and pair of smallest word hashes."""
    held = {}
    for lines, label in docs:
        words = {w for line in lines for w in line}
        key = (label, *(min((xxhash.xxh3_64_intdigest(w, seed) for w in words), default=0) for seed in (1, 2)))
        held.setdefault(key, (lines, label))
    return list(held.values())


def _vocabulary_features(words: list[bytes], spots: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Features that enough documents hold, and for each pair of a word and such a feature of it their numbers. spots: distinct document * number of words + word, in order."""
    sizes = np.fromiter((len(names(w)) for w in words), np.int64, len(words))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(f) for w in words for f in names(w)), np.uint64, int(sizes.sum()))
    hashes, first, of_feature = np.unique(hashes, return_index=True, return_inverse=True)
    start, held = np.cumsum(sizes) - sizes, np.zeros(len(hashes), np.int64)
    for at in range(0, len(spots), 50_000):  # distinct pairs of a document and a feature are counted part by part; a document may lie in two parts
        document, word = np.divmod(spots[at : at + 50_000], len(words))
        n = sizes[word]
        own = of_feature[np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        held += np.bincount(np.unique(own * (int(document[-1]) + 1) + np.repeat(document, n)) // (int(document[-1]) + 1), minlength=len(hashes))
    keep = held >= MIN_DOCUMENTS
    new, own = np.cumsum(keep) - 1, keep[of_feature]
    wanted = set(first[keep].tolist())
    named = {k: f for k, f in enumerate(f for w in words for f in names(w)) if k in wanted}
    return [named[k] for k in first[keep].tolist()], np.repeat(np.arange(len(words)), sizes)[own], new[of_feature[own]]


def train(rows: list[tuple[bytes | None, int]], steps: int = STEPS) -> Model:
    """rows: text and label of the sample."""
    docs = [(lines_of(text), int(label > 0)) for text, label in rows]
    toxic = sum(label for _, label in docs)
    if not toxic or toxic == len(docs):
        return Model(0.0, {}, {}, {}, 0.0, np.zeros((2, 2)), toxic / len(docs) if docs else 0.0)
    docs = without_copies(docs)
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for lines, _ in docs for line in lines for w in line), np.int64)
    lengths = np.array([len(line) for lines, _ in docs for line in lines], np.int64)
    there = Words.of(ids, lengths, np.repeat(np.arange(len(docs)), [len(lines) for lines, _ in docs]))
    y, size, words = np.array([label for _, label in docs], float), len(vocabulary), list(vocabulary)
    del docs, vocabulary, ids  # the driver's memory
    spots = np.unique(there.doc_of * size + there.ids)
    features, of_word, of_feature = _vocabulary_features(words, spots)
    known = np.flatnonzero(np.bincount(spots % size, minlength=size) >= MIN_DOCUMENTS)  # words that count as neighbours
    later, earlier = np.flatnonzero(~there.opens), np.flatnonzero(~there.ends)
    # One vector: features, neighbours before and after, constant, start, and move in the order of its rows.
    cuts = np.cumsum([len(features), len(known), len(known), 1, 1])
    theta = np.zeros(cuts[-1] + 4)
    theta[cuts[2]] = -np.log1p(len(there.ids) / len(y))  # about one toxic word a document
    squares, decay = np.full_like(theta, 1e-4), np.full_like(theta, DECAY)
    decay[cuts[2] :] = 0.01

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(size)
        out[known] = values
        return out

    for _ in range(steps):
        own, before, after, constant, start, move = np.split(theta, cuts)
        start, move = float(start[0]), move.reshape(2, 2)
        emission = there.emissions(constant + np.bincount(of_word, own[of_feature], size), spread(before), spread(after)).astype(np.float32)  # for the driver's memory
        left, right = forward_backward(emission, there.chains, start, move)
        p = _sigmoid(left + right)
        clean = (1 - LEAK) * np.exp(np.bincount(there.doc_of, log_all_clean(emission, right, there.opens, start, move), len(y)))
        weight = np.where(y > 0, -clean / (1 - clean), 1.0)[there.doc_of]  # slope by the log-probability of all clean
        slope = -weight * p
        x, z = left[later - 1], emission[later] + right[later]
        most = np.maximum(np.maximum(move[0, 0], move[0, 1] + z), np.maximum(move[1, 0] + x, move[1, 1] + x + z))
        joint = [np.exp(v - most) for v in (move[0, 0], move[0, 1] + z, move[1, 0] + x, move[1, 1] + x + z)]
        share = weight[later] / sum(joint)
        moves = np.array([weight[later].sum() - joint[0] @ share, *(-(j @ share) for j in joint[1:])])
        gradient = np.concatenate([
            np.bincount(of_feature, np.bincount(there.ids, slope, size)[of_word], len(features)),
            np.bincount(there.ids[later - 1], slope[later], size)[known],
            np.bincount(there.ids[earlier + 1], slope[earlier], size)[known],
            [slope.sum(), slope[there.opens].sum()], moves,
        ])
        gradient -= decay * theta
        squares += gradient**2
        theta += RATE * gradient / np.sqrt(squares)
    own, before, after, constant, start, move = np.split(theta, cuts)
    near = [words[k] for k in known.tolist()]
    return Model(float(constant[0]), dict(zip(features, own.tolist())), dict(zip(near, before.tolist())), dict(zip(near, after.tolist())), float(start[0]), move.reshape(2, 2).copy())


class _Vocabulary(dict):
    """Numbers of words, and of each word the weights by itself, as the one before and as the one after."""

    def __init__(self, model: Model):
        self.model, self.values = model, array("d")  # three for each word

    def __missing__(self, word: bytes) -> int:
        m = self.model
        self[word] = k = len(self)
        self.values.extend((m.constant + sum(m.weights.get(f, 0.0) for f in names(word)), m.before.get(word, 0.0), m.after.get(word, 0.0)))
        return k

    def forget(self) -> None:
        self.clear()
        self.values = array("d")


class Scorer:
    def __init__(self, model: Model):
        self.model, self.vocabulary = model, _Vocabulary(model)

    def __call__(self, texts: list[bytes | None]) -> tuple[list[float], list[list[tuple[int, int]]]]:
        scores, spans = [], []
        held: list[tuple[bytes | None, list[int]]] = []
        ids: list[int] = []
        for text in texts:
            lengths = []
            for line in lines_of(text):
                ids.extend(map(self.vocabulary.__getitem__, line))
                lengths.append(len(line))
            held.append((text, lengths))
            if len(ids) >= CHUNK:
                self._score(held, ids, scores, spans)
                held, ids = [], []
        self._score(held, ids, scores, spans)
        return scores, spans

    def _score(self, held: list, ids: list[int], scores: list[float], spans: list) -> None:
        m = self.model
        if m.same is not None or not ids:
            scores.extend([LEAK if m.same is None else m.same] * len(held))
            spans.extend([] for _ in held)
            return
        lengths = np.array([n for _, ns in held for n in ns], np.int64)
        there = Words.of(ids, lengths, np.repeat(np.arange(len(held)), [len(ns) for _, ns in held]))
        emission = there.emissions(*np.frombuffer(self.vocabulary.values).reshape(-1, 3).T)
        if len(self.vocabulary) > VOCABULARY:  # bounded memory
            self.vocabulary.forget()
        left, right = forward_backward(emission, there.chains, m.start, m.move)
        clean = np.exp(np.bincount(there.doc_of, log_all_clean(emission, right, there.opens, m.start, m.move), len(held)))
        scores.extend((1 - (1 - LEAK) * clean).tolist())
        toxic = np.flatnonzero(left + right >= 0)  # a marginal of 0.5
        first = np.searchsorted(there.doc_of, np.arange(len(held)))
        cuts = np.searchsorted(there.doc_of[toxic], np.arange(len(held) + 1)).tolist()
        for k, (text, _) in enumerate(held):
            own = toxic[cuts[k] : cuts[k + 1]]
            if not len(own) and scores[k - len(held)] >= 0.5:
                own = first[k] + np.argmax((left + right)[first[k] : first[k + 1] if k + 1 < len(held) else None], keepdims=True)
            spans.append(_spans(text, own - first[k]) if len(own) else [])


def _spans(text: bytes, words: np.ndarray) -> list[tuple[int, int]]:
    """Code points of these words; neighbours on a line are one span."""
    found, wanted = [], set(words.tolist())
    low, last, at = text.translate(LINE_BYTES), -2, 0
    for k, m in enumerate(TOKEN.finditer(low)):
        if k in wanted:
            if last == k - 1 and b"\n" not in low[found[-1][1] : m.start()]:
                found[-1][1] = m.end()
            else:
                found.append([m.start(), m.end()])
            last = k
    out, points = [], 0
    for a, b in found:
        points += len(text[at:a].decode("utf-8", "replace"))
        begin = points
        points += len(text[a:b].decode("utf-8", "replace"))
        at = b
        out.append((begin, points))
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> list[tuple[bytes | None, int]]:
    """A bounded sample of the labelled rows that may be learnt from, in order of a hash of the id."""
    marks = labels.select(field(doc_id).alias("doc_id"), field(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("label > 0").orderBy(*order).limit(sample).unionByName(marks.where("label <= 0").orderBy(*order).limit(2 * sample))
    texts = docs.select(field(doc_id).alias("doc_id"), field(text).cast("binary").alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("hash")]
    sizes = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "label").where(F.col("size") <= TEXT_BYTES)
    sizes = sizes.distinct().orderBy(*order).limit(3 * sample)  # ids may repeat
    so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over 3 * sample rows at most
    wanted = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= SAMPLE_BYTES).select("doc_id", "hash", "label")
    rows = texts.join(F.broadcast(wanted), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("text", "label").orderBy(*order)
    return [(None if r[0] is None else bytes(r[0]), r[1]) for r in rows.collect()]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **names: str) -> Model:
    return train(training_rows(docs, labels, sample, **names))


def score_rows(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """score, n_spans and spans (begin:end, comma-joined) of every row, beside doc: a struct of the columns to carry (all, if not said)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    carry = df.columns if carry is None else carry
    rows = df.select(F.struct(*[field(c) for c in carry]).alias("doc"), *([] if text in carry else [field(text).alias("text")]))  # a text goes to the workers once
    state: dict = {}

    def run(batch: pa.RecordBatch) -> list:
        scorer = state.get("scorer") or state.setdefault("scorer", Scorer(shared.value))
        texts = batch.column(0).flatten()[carry.index(text)] if text in carry else batch.column(1)
        scores, spans = scorer(texts.cast(pa.large_binary()).to_pylist())
        return [batch.column(0), scores, [len(s) for s in spans], [",".join(f"{a}:{b}" for a, b in s) for s in spans]]

    return map_columns(rows, run, "score double, n_spans bigint, spans string", rows.schema["doc"])


def toxic_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: doc_id, held_out, score, predicted (1 from 0.5 on), n_spans, spans."""
    scored = score_rows(docs, fit(docs, labels, sample, doc_id=doc_id, text=text), text, [doc_id])
    own = F.col("doc").getField(doc_id)
    return scored.select(own.alias("doc_id"), held_out(own).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans")
