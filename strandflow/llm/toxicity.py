"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels."""

from __future__ import annotations

import math
import re
import sys
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text or "") if s.strip()]


def noisy_or(scores: list[float]) -> float:
    return -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for p in scores))


#: Lengths of the word beginnings that are features beside the word, so that unseen forms of a stem count.
PREFIXES = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Weights of words and word beginnings in a logistic sentence score, and its bias.

    The noisy-or over sentences scores a document.  The score reads nothing but the text.
    """

    weights: dict[str, float]
    bias: float
    #: Weights of words met so far, emptied when it holds many; it changes speed only.
    memo: dict[str, float] = field(default_factory=dict)

    def word_weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentence_scores(self, text: str) -> list[tuple[str, float]]:
        found = []
        for s in sentences(text):
            z = self.bias + sum(map(self.word_weight, set(WORD.findall(s.lower()))))
            found.append((s, 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))))
        return found

    def score(self, text: str) -> float:
        """1 - product of (1 - p); an empty text counts as one sentence without known words."""
        return noisy_or([p for _, p in self.sentence_scores(text)] or [1 / (1 + math.exp(-self.bias))])


def train(texts: list[str], labels: list[int], min_df: int = 3, lift: float = 2.0, rounds: int = 300, rate: float = 0.2,
          l1: float = 1e-4, l2: float = 1e-5) -> Model:
    """Adam over whole batches on the likelihood of the document labels under the noisy-or.

    Features occur in at least min_df documents with label 1 and there lift times as often as in all documents.
    The gradient of a sentence's logit z is p for a label 0 and -p (1 - P) / P for a label 1: the sentences of a
    positive document share its label by their scores.
    """
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return Model({}, float(np.log(p / (1 - p))))
    # The texts are read three times, so that never more than one document's words are held.
    df1: Counter[str] = Counter()
    for text, label in zip(texts, labels):
        if label:
            df1.update({f for w in set(WORD.findall(text.lower())) for f in features(w)})
    df1 = Counter({f: n for f, n in df1.items() if n >= min_df})
    df: Counter[str] = Counter()
    for text in texts:
        df.update({f for w in set(WORD.findall(text.lower())) for f in features(w) if f in df1})
    base = y.mean()
    vocab = {f: i for i, f in enumerate(sorted(f for f, n in df1.items() if n >= lift * base * df[f]))}
    cols, sent, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences(text) or [""]:
            ids = [vocab[f] for w in set(WORD.findall(s.lower())) for f in features(w) if f in vocab]
            cols.extend(ids)
            sent.extend([len(doc)] * len(ids))
            doc.append(d)
    cols, sent, doc = (np.array(x, np.int64) for x in (cols, sent, doc))
    w, b = np.zeros(len(vocab)), -5.0
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for t in range(1, rounds + 1):
        z = np.clip(b + np.bincount(sent, w[cols], len(doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        s = np.bincount(doc, np.logaddexp(0, z), len(y))
        back = np.where(y == 1, -np.exp(-s) / np.maximum(-np.expm1(-s), 1e-9), 1.0)
        gz = p * back[doc] / len(y)
        g = np.append(np.bincount(cols, gz[sent], len(vocab)) + l2 * w, gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        scale = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        step = scale * m / (1 - 0.9**t)
        w, b = w - step[:-1], b - 0.3 * step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - l1 * scale[:-1], 0)
    return Model({k: float(w[i]) for k, i in vocab.items() if abs(w[i]) > 1e-3}, float(b))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = 8000, chars: int = 40_000_000) -> tuple[list[str], list[int]]:
    """A bounded sample of labelled rows whose crc32(doc_id as text) mod 5 is not 0, the same on every run.

    rows and chars bound what the driver fetches: rows are taken in the order of a hash of their id, whole texts only.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    ids = labels.where("doc_id is not null and toxic in (0, 1)").where(fold != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sized = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    got = sized.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    budget, texts, y = chars, [], []
    for r in got.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).toLocalIterator():
        if budget - len(r["text"]) < 0:
            continue
        budget -= len(r["text"])
        texts.append(r["text"])
        y.append(int(r["toxic"]))
    return texts, y


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, score, predicted, worst_sentence, worst_score, offending (indexes of sentences of 0.5 or more).

    Null and empty texts score what one sentence without known words scores; rows are independent of each other, so
    ties and repeated rows score alike and no rows give no rows.
    """
    # As plain values, so that executors need not have this module.
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        model = Model(*held.value)
        for batch in batches:
            ids, out = batch.column(0), []
            for text in batch.column(1):
                scored = model.sentence_scores(text.as_py() or "")
                worst = max(scored, key=lambda x: x[1], default=(None, None))
                score = noisy_or([p for _, p in scored]) if scored else model.score("")
                out.append((score, int(score >= 0.5), *worst, [i for i, (_, p) in enumerate(scored) if p >= 0.5]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.list_(pa.int32()))],
                ["doc_id", "score", "predicted", "worst_sentence", "worst_score", "offending"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, score double, predicted int, worst_sentence string, worst_score double, offending array<int>")


def drop_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs, all their columns, without the rows whose score is `least` or more; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches):
        model = Model(*held.value)
        for batch in batches:
            keep = [model.score(t.as_py() or "") < least for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
