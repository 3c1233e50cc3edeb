"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's logit is a bias plus the weights of its distinct words and stems (the first
letters of longer words, as languages inflect their insults); a document's score is the noisy-or of its sentences, ``1 - prod(1 - p)``.  Its likelihood under the document
labels trains the word weights, so the sentences that make a document toxic are found
without ever being labelled.

Learning reads about ``FIT_ROWS`` labelled documents outside the held-out fold, taken by a
hash of the id.  Their word statistics are counted in Spark; the ``VOCABULARY`` words that
tell the labels apart best, and which sentence holds which, are all that reaches the
driver.  Every document is scored over its whole text.

Defined results: a text that is null, empty or without words has no sentence and score 0;
repeated rows repeat their result; rows without a label do not train; without both labels
every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, fold_of, map_arrow, read, sampled

FIT_ROWS = 6_000
VOCABULARY = 1_000
LEAST_DOCS = 3
STEPS, RATE, L1, L2 = 400, 0.1, 2e-4, 1e-4
SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
STEMS = (5, 6, 7)


def terms(sentence: str) -> set[str]:
    """Distinct words and stems (marked by a hyphen) of a text in lower case."""
    words = set(LETTERS.findall(sentence))
    return words.union(*[{w[:k] + "-" for w in words if len(w) > k} for k in STEMS])


def _training_texts(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(fold_of(F.col("doc_id")) != 0).select("doc_id", "toxic")
    chosen = labels.where(sampled(fit_rows / max(1, labels.count()), "toxic"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    return cut(texts.join(chosen, "doc_id").select("text", (F.col("toxic") == 1).alias("toxic")))


def _vocabulary(texts: DataFrame, size: int) -> list[str]:
    """The words whose share of toxic and of other documents differs most, in standard errors."""

    def run(batch):
        words, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = terms(text.lower())
            words += found
            toxic += [int(label)] * len(found)
        return {"word": words, "toxic": toxic}

    totals = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return []
    counted = map_arrow(texts, run, "word string, toxic long").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    p, n = totals[True], totals[False]
    pooled = (F.col("a") + F.col("b") + 1) / (p + n + 2)
    z = (F.col("a") / p - F.col("b") / n) / F.sqrt(pooled * (1 - pooled) * (1 / p + 1 / n))
    best = counted.where(F.col("a") + F.col("b") >= LEAST_DOCS).orderBy(F.desc(F.abs(z)), "word").limit(size)
    return [r.word for r in best.select("word").collect()]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, size: int = VOCABULARY) -> tuple[dict[str, float], float] | None:
    """Word weights and the bias, or None without both labels."""
    texts = _training_texts(docs, labels, fit_rows)
    words = _vocabulary(texts, size)
    if not words:
        return None
    places = {w: i for i, w in enumerate(words)}

    def run(batch):
        out = {"toxic": batch.column("toxic"), "n": [], "at": [], "word": []}
        for text in batch.column("text").to_pylist():
            n, at, word = 0, [], []
            for s in SENTENCE.findall(text.lower()):
                if found := terms(s):
                    known = [places[w] for w in found if w in places]
                    at += [n] * len(known)
                    word += known
                    n += 1
            out["n"].append(n)
            out["at"].append(at)
            out["word"].append(word)
        return out

    rows = map_arrow(texts, run, "toxic boolean, n long, at array<long>, word array<long>").toPandas()
    rows = rows[rows.n > 0]
    y = rows.toxic.to_numpy(float)
    sentences = rows.n.to_numpy()
    first = np.concatenate([[0], np.cumsum(sentences)[:-1]])
    doc = np.repeat(np.arange(len(rows)), sentences)
    word = np.concatenate([*rows.word, []]).astype(int)
    at = np.concatenate([*(a + f for a, f in zip(rows["at"], first, strict=True)), []]).astype(int)
    total, m = len(doc), len(words)
    w, b = np.zeros(m), -4.0
    mean, spread = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(at, w[word], total) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        g = p * (1 - y / np.maximum(1 - none, 1e-9))[doc] / len(y)
        grad = np.append(np.bincount(word, g[at], m) + L2 * w, g.sum())
        mean, spread = 0.9 * mean + 0.1 * grad, 0.999 * spread + 0.001 * grad**2
        change = RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - L1 * RATE, 0)
    return {x: float(v) for x, v in zip(words, w, strict=True) if abs(v) > 1e-3}, float(b)


def sentence_scores(text: str, weights: dict[str, float], bias: float) -> list[tuple[float, int, int]]:
    """Probability, start and end (code points) of each sentence that has a word."""
    out, known = [], weights.keys()
    for m in SENTENCE.finditer(text):
        if found := terms(m[0].lower()):
            z = bias + sum([weights[w] for w in found & known])
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *m.span()))
    return out


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None) -> DataFrame:
    """doc_id, score, sentences (start:end of each sentence of 0.5 or more, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        model, scores, places = shared.value, [], []
        for text in batch.column("text").to_pylist():
            found = sentence_scores(text, *model) if text and model else []
            scores.append(-math.expm1(sum([math.log1p(-min(p, 1 - 1e-12)) for p, _, _ in found])) if found else 0.0)
            places.append(",".join([f"{a}:{b}" for p, a, b in found if p >= 0.5]))
        return {"doc_id": batch.column("doc_id"), "score": scores, "sentences": places}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, sentences string")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    held_out = (fold_of(F.col("doc_id")) == 0).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
