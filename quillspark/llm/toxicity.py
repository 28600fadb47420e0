"""Toxic spans and document scores from a linear-chain conditional random field.

Training (driver, bounded): at most ``max_docs`` toxic and ``CLEAN`` times as many clean labelled
documents, of bounded length together, are drawn by hash order; each id counts once, and a text
over its share of the characters is seen in windows. Their tokens get labels from the document labels: a token of a toxic document
is toxic if its word, or one of its leading n-grams, stands in at least ``min_contexts``
different neighbourhoods of toxic documents and (almost) never in clean ones; all others are
clean. Counting neighbourhoods instead of documents keeps copies from speaking twice. A
two-state linear-chain CRF (hashed word and affix features, transitions) is then fitted to
those sequences by its exact gradient (forward-backward), and a logistic layer turns the
marginals of a document into its score.

Scoring (executors): emissions are looked up word by word, forward-backward runs over many
documents at once, and the marginals give the document score and the offending offsets.
Whole texts, without caps.

Defined results: null texts are empty; texts without words get the score of no evidence;
repeated rows are scored one by one; with no labelled rows, or of one class only, every score
is the share of toxic labels (0 without any) and no span is found; an empty table gives an
empty table; further columns are carried through by ``add_scores``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, unused

TOKEN = re.compile(r"[^\W_]+")
BITS = 18
PREFIXES = (3, 4, 5, 6)
#: Bounds of the training sample: toxic documents and their characters; of clean ones CLEAN times as many.
MAX_DOCS = 900
MAX_CHARS = 1_500_000
CLEAN = 3
#: One document has at most this part of the toxic characters; longer texts show WINDOWS places of theirs.
SHARE, WINDOWS = 50, 4
CHAIN = 256
CACHED_WORDS = 200_000
#: Characters whose tokens are held at once when scoring.
CHUNK_CHARS = 2_000_000


def features(word: str) -> list[str]:
    """The features of a token: bias, word, leading n-grams, ending."""
    return ["b", "w" + word, *("p" + word[:n] for n in PREFIXES if len(word) >= n), "s" + word[-3:]]


@lru_cache(maxsize=400_000)
def hashed(word: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for f in features(word))


def token_labels(docs: list[list[str]], toxic: list[int], min_contexts: int = 5, min_bits: float = 18) -> list[np.ndarray]:
    """Labels of the tokens of each document, from those of the documents."""
    seen: tuple[set, set] = (set(), set())
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for words, label in zip(docs, toxic, strict=True):
        padded = ["", *words, ""]
        for k, w in enumerate(words):
            context = hash((w, padded[k], padded[k + 2]))
            if context not in seen[label]:
                seen[label].add(context)
                counts[label][w] += 1
    sums: tuple[Counter, Counter] = (Counter(), Counter())
    for label in (0, 1):
        for w, n in counts[label].items():
            for f in features(w)[1:-1]:
                sums[label][f] += n
    clean, bad = sums
    # bits of surprise at each toxic neighbourhood, were the word as frequent in clean documents
    bits = float(np.log2(1 + (1 + len(seen[0])) / (1 + len(seen[1]))))
    cues = {f for f, n in bad.items() if n >= min_contexts and clean[f] <= 0.02 * n and n * bits >= min_bits}
    verdict: dict[str, bool] = {}
    out = []
    for words, label in zip(docs, toxic, strict=True):
        y = np.zeros(len(words), np.int8)
        if label:
            for k, w in enumerate(words):
                if w not in verdict:
                    verdict[w] = any(f in cues for f in features(w)[1:-1])
                y[k] = verdict[w]
        out.append(y)
    return out


def forward_backward(emission: np.ndarray, trans: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds forward and backward messages of chains (rows; ``real`` is false behind their ends).

    ``emission`` is the score of state 1 against 0. Their sum is the log-odds of the marginal.
    """
    (a00, a01), (a10, a11) = trans
    f, b = np.empty_like(emission), np.zeros_like(emission)
    f[:, 0] = emission[:, 0]
    for t in range(1, emission.shape[1]):
        r = f[:, t - 1]
        f[:, t] = emission[:, t] + np.logaddexp(a01, a11 + r) - np.logaddexp(a00, a10 + r)
    for t in range(emission.shape[1] - 2, -1, -1):
        s = emission[:, t + 1] + b[:, t + 1]
        b[:, t] = np.where(real[:, t + 1], np.logaddexp(a10, a11 + s) - np.logaddexp(a00, a01 + s), 0.0)
    return f, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Weights of the hashed features, transitions, and the document layer; ``base`` if nothing could be learnt."""

    weights: np.ndarray | None
    trans: np.ndarray | None
    layer: np.ndarray | None
    base: float = 0.0

    def emission(self, word: str, places=hashed) -> float:
        return float(self.weights[list(places(word))].sum())


def evidence(margin: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Document features of marginal log-odds: greatest, log of the expected number of toxic tokens, bias."""
    top = np.where(real, margin, -15).max(axis=1, initial=-15)
    number = (sigmoid(margin) * real).sum(axis=1)
    return np.stack([np.clip(top, -15, 15) / 5, np.log(number + 1e-3), np.ones(len(top))], axis=1)


def train(texts: list[str], toxic: list[int], min_contexts: int = 5, rounds: int = 40) -> Model:
    if not texts or len(set(toxic)) < 2:
        return Model(None, None, None, float(np.mean(toxic)) if toxic else 0.0)
    docs = [TOKEN.findall((t or "").lower()) for t in texts]
    labels = token_labels(docs, toxic, min_contexts)
    chains, golds = [], []
    for words, y in zip(docs, labels, strict=True):
        for at in range(0, len(words), CHAIN):
            chains.append(words[at : at + CHAIN])
            golds.append(y[at : at + CHAIN])
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for c in chains for w in c))}
    used = [hashed(w) for w in vocabulary]
    word_of = np.repeat(np.arange(len(used)), [len(x) for x in used])
    feature_of = np.fromiter((f for x in used for f in x), np.int64, len(word_of))
    order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
    blocks = []
    for at in range(0, len(order), 2048):
        own = order[at : at + 2048]
        steps = max(len(chains[k]) for k in own)
        if not steps:
            continue
        ids, gold, real = np.zeros((len(own), steps), np.int64), np.zeros((len(own), steps), np.int8), np.zeros((len(own), steps), bool)
        for row, k in enumerate(own):
            n = len(chains[k])
            ids[row, :n] = [vocabulary[w] for w in chains[k]]
            gold[row, :n], real[row, :n] = golds[k], True
        blocks.append((ids, gold, real))
    weights, trans = np.zeros(1 << BITS), np.zeros((2, 2))
    m = [np.zeros_like(weights), np.zeros_like(trans)]
    v = [np.zeros_like(weights), np.zeros_like(trans)]
    tokens = max(1, sum(int(b[2].sum()) for b in blocks))
    for step in range(1, rounds + 1):
        scores = np.zeros(len(used))
        np.add.at(scores, word_of, weights[feature_of])
        grad_word, grad_trans = np.zeros(len(used)), np.zeros((2, 2))
        for ids, gold, real in blocks:
            e = np.where(real, scores[ids], 0.0)
            f, b = forward_backward(e, trans, real)
            (a00, a01), (a10, a11) = trans
            p = sigmoid(f + b) * real
            np.add.at(grad_word, ids.ravel(), ((gold - p) * real).ravel())
            both = real[:, 1:] & real[:, :-1]
            left, right = f[:, :-1], e[:, 1:] + b[:, 1:]
            joint = np.stack([a00 + 0 * left, a01 + right, a10 + left, a11 + left + right])
            joint = np.exp(joint - joint.max(axis=0))
            joint = joint / joint.sum(axis=0) * both
            g0, g1 = gold[:, :-1], gold[:, 1:]
            for i in (0, 1):
                for j in (0, 1):
                    grad_trans[i, j] += (((g0 == i) & (g1 == j)) & both).sum() - joint[2 * i + j].sum()
        grad = np.bincount(feature_of, weights=grad_word[word_of], minlength=1 << BITS)
        grads = [grad / tokens * 1e3 - 1e-3 * weights, grad_trans / tokens * 1e3 - 1e-3 * trans]
        for k, (x, g) in enumerate(zip((weights, trans), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += 0.3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-4)
    hashed.cache_clear()  # the driver's memory is that of the sample, not of its words
    del used, word_of, feature_of, blocks, chains, golds
    model = Model(weights, trans, None)
    x = np.concatenate([evidence_of(model, part) for part in (docs[k : k + 256] for k in range(0, len(docs), 256))])
    y = np.asarray(toxic, float)
    # weighted as if both classes were as frequent as in the sample; Newton steps with a ridge
    layer = np.zeros(x.shape[1])
    for _ in range(30):
        p = sigmoid(x @ layer)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        layer += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * layer)
    model.layer = layer
    return model


def margins(model: Model, docs: list[list[str]], look: dict[str, float] | None = None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Places, marginal log-odds and mask of documents, in groups of like length."""
    cache = {} if look is None else look
    order = sorted(range(len(docs)), key=lambda k: len(docs[k]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 512 and (len(docs[order[end]]) + 1) * (end - at + 1) < 500_000:
            end += 1
        own = order[at:end]
        at = end
        steps = max(1, max(len(docs[k]) for k in own))
        e, real = np.full((len(own), steps), 0.0), np.zeros((len(own), steps), bool)
        for row, k in enumerate(own):
            words = docs[k]
            new = [w for w in set(words) if w not in cache]
            if len(cache) + len(new) > CACHED_WORDS:
                cache.clear()
                new = list(set(words))
            for w in new:
                cache[w] = model.emission(w, hashed.__wrapped__)
            e[row, : len(words)] = np.fromiter(map(cache.__getitem__, words), float, len(words))
            real[row, : len(words)] = True
        f, b = forward_backward(e, model.trans, real)
        yield own, f + b, real


def evidence_of(model: Model, docs: list[list[str]], look: dict[str, float] | None = None) -> np.ndarray:
    out = np.zeros((len(docs), 3))
    for own, margin, real in margins(model, docs, look):
        out[own] = evidence(margin, real)
    return out


def score(model: Model, texts: list[str], look: dict[str, float] | None = None, spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores of texts, and the character spans of tokens that are likelier toxic than not (if asked for)."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    if model.weights is None:
        return np.full(len(texts), model.base), found
    docs = [TOKEN.findall(t.lower()) for t in texts]
    x = np.zeros((len(docs), 3))
    for own, margin, real in margins(model, docs, look):
        x[own] = evidence(margin, real)
        if spans:
            for row, k in enumerate(own):
                hot = set(np.flatnonzero((margin[row] > 0) & real[row]).tolist())
                if hot and len(texts[k]) == len(texts[k].lower()):
                    found[k] = [m.span() for i, m in enumerate(TOKEN.finditer(texts[k].lower())) if i in hot]
                elif hot:  # lower case of another length: offsets from the tokens of the text itself
                    found[k] = [m.span() for m in TOKEN.finditer(texts[k]) if margins_of_word(model, m[0].lower()) > 0]
    return sigmoid(x @ model.layer), found


def margins_of_word(model: Model, word: str) -> float:
    return model.emission(word) if word else -1.0


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _windowed(text: Column, most: int) -> Column:
    """The text, or windows at even distances from its start to its end, of ``most`` characters together."""
    size = max(1, (most - WINDOWS + 1) // WINDOWS)
    start = lambda k: F.floor((F.length(text) - size) * k / (WINDOWS - 1)).cast("int") + 1
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", *[F.substr(text, start(k), F.lit(size)) for k in range(WINDOWS)]))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS, text: str = "text") -> Model:
    """The model of a bounded sample of the labelled rows that aren't held out."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = None
    for label in (0, 1):
        own = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs * (1 if label else CLEAN))
        drawn = own if drawn is None else drawn.unionByName(own)
    sample = F.broadcast(drawn)  # at most (1 + CLEAN) * max_docs rows of two numbers
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(sample, "doc_id").withColumn("text", _windowed(F.col("text"), max_chars // SHARE))
    # each id once, whatever copies of it there are
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("doc_id", "toxic", "x.text").withColumn("n", F.length("text"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("n").over(before)).filter(F.col("upto") <= F.when(F.col("toxic") == 1, max_chars).otherwise(CLEAN * max_chars))
    got = rows.select("doc_id", "text", "toxic").collect()
    got.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in got], [int(r["toxic"]) for r in got])


_looks: dict[int, dict[str, float]] = defaultdict(dict)


def add_scores(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """Add score (double) and, if asked for, toxic_spans (array of start and end in characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = id(model)
    kind = "score double" + (", toxic_spans array<struct<start:int,end:int>>" if spans else "")

    @F.pandas_udf(kind)
    def go(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        look = _looks[key]
        for series in texts:
            values = [x or "" for x in series.tolist()]
            scores, found, at = [], [], 0
            while at < len(values):  # as many texts at once as their tokens fit
                end, size = at, 0
                while end < len(values) and (end == at or size + len(values[end]) <= CHUNK_CHARS):
                    size += len(values[end])
                    end += 1
                part, own = score(shared.value, values[at:end], look, spans)
                scores.append(part)
                found += own
                at = end
            out = pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0)})
            if spans:
                out["toxic_spans"] = [[{"start": a, "end": b} for a, b in x] for x in found]
            yield out

    keep = [F.col(c) for c in docs.columns if c != "score" and not (spans and c == "toxic_spans")]
    (own,) = unused(docs, "_s")
    return docs.withColumn(own, go(F.coalesce(F.col(text), F.lit("")))).select(*keep, f"{own}.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = add_scores(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
