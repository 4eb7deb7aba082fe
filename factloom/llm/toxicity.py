"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals make scores and spans.

Labels are those of documents. From a bounded sample of labelled documents (``most`` of each class,
smallest id hashes first) features (words and word beginnings) that mark toxic documents are chosen by a
likelihood-ratio test; tokens of toxic documents with such a feature are labelled toxic, all others clean.
The field (two states, features of the token and of both neighbours) is trained on these tokens by
gradient ascent; forward-backward marginals are added up to three numbers for each document, and a
logistic regression over documents that the field has not seen makes the score, weighted to the classes'
true shares. Every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: The sample's bounds: labelled documents of each class, and characters of all together.
MOST = 1500
MOST_CHARS = 60_000_000
CUE = 25.0
FEATURES = 4000
CHUNK = 128
TOKENS = 400_000
TOKEN = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def tokens_of(text: str) -> list[str]:
    """Words in lower case; word k is that of the k-th match in the text itself, also where lowering changes lengths."""
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [t.lower() for t in TOKEN.findall(text)]


def features(token: str) -> list[str]:
    return [token, *(f"{token[:k]}*" for k in BEGINNINGS if len(token) > k)]


def forward_backward(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token, and the backward ratio; sequences (longest first) lie in ``e`` at starts.

    Step t handles all sequences longer than t at once.
    """
    (a00, a01), (a10, a11) = np.exp(a)
    g = np.exp(np.clip(e, -30, 30))
    f, back = np.empty(len(e)), np.ones(len(e))
    live = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
    p = np.zeros(0)
    for t, n in enumerate(live):
        at = starts[:n] + t
        m0, m1 = ((1 - p[:n]) * a00 + p[:n] * a10, (1 - p[:n]) * a01 + p[:n] * a11) if t else (1.0, 1.0)
        q = m1 * g[at]
        p = q / (q + m0)
        f[at] = p
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        x = g[at + 1] * back[at + 1]
        back[at] = (a10 + a11 * x) / (a00 + a01 * x)
    return f * back / (f * back + 1 - f), back


class Types(dict):
    """Types of tokens, found when a token is first seen."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> int:
        found = self[token] = self.model.type_of(token)
        return found


class Model:
    """Weights of the field and of the document score."""

    def __init__(self, names: list[str], share: float):
        self.names = {f: k + 1 for k, f in enumerate(names)}
        self.w = np.zeros((3, len(names) + 1))
        self.bias, self.a = -4.0, np.zeros((2, 2))
        self.out = np.array([math.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0, 0.0])
        self.types = Types(self)
        self.table = [(0,) * (1 + len(BEGINNINGS))]

    def forget(self) -> None:
        self.types.clear()
        del self.table[1:]

    def type_of(self, token: str) -> int:
        """Tokens without a chosen feature are all of type 0."""
        known = [self.names[f] for f in features(token) if f in self.names]
        if not known:
            return 0
        self.table.append(tuple((known + [0] * len(BEGINNINGS))[: 1 + len(BEGINNINGS)]))
        return len(self.table) - 1

    def ids(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.types.__getitem__, tokens), np.int32, len(tokens))

    def emissions(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        w = self.w[:, np.array(self.table)].sum(axis=2)
        first, last = starts, starts + lengths - 1
        e = self.bias + w[0][ids]
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        before[first], after[last] = 0, 0
        return e + w[1][before] + w[2][after]

    def marginals(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
        lengths = np.array([len(docs[k]) for k in order if len(docs[k])], np.int64)
        if not len(lengths):
            return [np.empty(0)] * len(docs)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        p, _ = forward_backward(self.emissions(np.concatenate([docs[k] for k in order]), starts, lengths), starts, lengths, self.a)
        parts = [*np.split(p, starts[1:]), *[np.empty(0)] * (len(docs) - len(lengths))]
        out: list = [None] * len(docs)
        for k, x in zip(order, parts, strict=True):
            out[k] = x
        return out

    @staticmethod
    def summary(p: np.ndarray) -> list[float]:
        """Of a document's marginals: 1, expected toxic tokens (log), surest token (log odds), toxic at all."""
        if not len(p):
            return [1.0, 0.0, -3.0, 0.0]
        top = min(max(float(p.max()), 1e-6), 1 - 1e-6)
        return [1.0, math.log1p(float(p.sum())), max(-3.0, math.log10(top / (1 - top))), 1 - math.exp(float(np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))]

    def score(self, p: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.out, self.summary(p)), -30, 30))))


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """``rows``: (text, label) in a fixed order; every fourth one is kept for the score. ``share``: of label 1 among all labels."""
    texts = [tokens_of(t) for t, _ in rows]
    labels = [y for _, y in rows]
    seen, of = {0: Counter(), 1: Counter()}, Counter(y for k, y in enumerate(labels) if k % 4)
    for k, (tokens, y) in enumerate(zip(texts, labels, strict=True)):
        if k % 4:
            seen[y].update({f for t in set(tokens) for f in features(t)})

    def ratio(f: str) -> float:
        """Log-likelihood ratio of the feature's document counts, negative where it marks clean ones."""
        k = seen[1][f], seen[0][f]
        n = of[1], of[0]
        p = (k[0] + k[1]) / (n[0] + n[1])
        each = lambda x, m, q: (x * math.log(q) if x else 0) + ((m - x) * math.log(1 - q) if m > x else 0)
        g = 2 * sum(each(x, m, x / m) - each(x, m, p) for x, m in zip(k, n, strict=True))
        return g if k[0] * n[1] > k[1] * n[0] else -g

    if not of[0] or not of[1]:
        return Model([], share)
    scored = {f: ratio(f) for f in seen[1] if seen[1][f] > 3}
    names = sorted(sorted(scored, key=lambda f: (-abs(scored[f]), f))[:FEATURES])
    cues = {f for f in names if scored[f] >= CUE and seen[1][f] * of[0] >= 8 * seen[0][f] * of[1]}
    model = Model(names, share)
    ids = [model.ids(t) for t in texts]
    by_type = np.array([False] + [any(f in cues for f in features(t)) for t, k in model.types.items() if k])
    tags = [by_type[x] & (y == 1) for x, y in zip(ids, labels, strict=True)]
    pieces = [(x[i : i + CHUNK], y[i : i + CHUNK]) for k, (x, y) in enumerate(zip(ids, tags, strict=True)) if k % 4 for i in range(0, len(x), CHUNK)]
    pieces.sort(key=lambda x: -len(x[0]))
    if not pieces:
        return model
    x, y = (np.concatenate(z) for z in zip(*pieces, strict=True))
    y = y.astype(float)
    lengths = np.array([len(p[0]) for p in pieces])
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    inner = np.ones(len(x), bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    before, after = np.roll(x, 1), np.roll(x, -1)
    before[starts], after[starts + lengths - 1] = 0, 0
    types = np.array(model.table)
    real = np.stack([np.bincount((2 * y[inner - 1] + y[inner]).astype(int), minlength=4)]).reshape(2, 2)

    theta = [model.w, np.array([model.bias]), model.a]
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    for step in range(1, 41):
        e = model.emissions(x, starts, lengths)
        p, back = forward_backward(e, starts, lengths, model.a)
        rest = y - p
        grad = np.zeros_like(model.w)
        for k, at in enumerate((x, before, after)):
            one = np.bincount(at, rest, minlength=len(types))
            one[0] = 0
            np.add.at(grad[k], types, one[:, None])
        grad[:, 0] = 0
        # Pairs: P(i, j) is P(i) times the normalised step to j.
        q = np.exp(np.clip(e[inner], -30, 30)) * back[inner]
        ea = np.exp(model.a)
        p0 = p[inner - 1]
        to1 = [ea[i, 1] * q / (ea[i, 0] + ea[i, 1] * q) for i in (0, 1)]
        pair = np.array([[((1 - p0) * (1 - to1[0])).sum(), ((1 - p0) * to1[0]).sum()], [(p0 * (1 - to1[1])).sum(), (p0 * to1[1]).sum()]])
        for t, g, m in zip(theta, (grad - 0.01 * model.w, np.array([rest.sum()]), real - pair - 0.01 * model.a), moments, strict=True):
            m[0] = 0.8 * m[0] + 0.2 * g
            m[1] = 0.95 * m[1] + 0.05 * g * g
            t += 0.4 * (m[0] / (1 - 0.8**step)) / (np.sqrt(m[1] / (1 - 0.95**step)) + 1e-6)
        model.bias = float(theta[1][0])
    kept = [k for k in range(len(rows)) if k % 4 == 0]
    z = np.array([model.summary(p) for p in model.marginals([ids[k] for k in kept])])
    t = np.array([labels[k] for k in kept], float)
    weight = np.where(t == 1, share / max(t.mean(), 1e-9), (1 - share) / max(1 - t.mean(), 1e-9))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ model.out, -30, 30)))
        grad = z.T @ (weight * (t - p)) - 0.1 * np.r_[0, model.out[1:]]
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 0.1, 0.1, 0.1])
        model.out = model.out + np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.forget()
    return model


def sample(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, most: int = MOST, chars: int = MOST_CHARS) -> tuple[list[tuple[str, int]], float]:
    """At most ``most`` labelled texts of each class and ``chars`` characters, and the share of label 1.

    Null labels don't count. Of an id that comes repeatedly the text with the smallest hash is taken, whole;
    texts that would exceed the characters are left out in the order of the ids' hashes.
    """
    spark = docs.sparkSession
    own = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in own.groupBy("_y").count().collect()}
    chosen = [r for y in (0, 1) for r in own.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(most).collect()]
    if not chosen:
        return [], 0.0
    few = F.broadcast(spark.createDataFrame(chosen, own.schema))  # 2 * most rows
    found = docs.select(F.col(id).alias("_id"), text_of(text).alias("_t")).join(few, "_id").withColumns({"_h": F.xxhash64("_t"), "_n": F.length("_t")})
    first = found.groupBy("_id", "_y").agg(F.min(F.struct("_h", "_n")).alias("m")).select("_id", "_y", "m.*").collect()  # 2 * most rows or, under repeated labels, twice that
    left, kept = chars, []
    for r in sorted(first, key=lambda r: (hash_of(r["_id"]), r["_y"])):
        if r["_n"] <= left:
            left -= r["_n"]
            kept.append((r["_id"], r["_y"], r["_h"]))
    chosen = F.broadcast(spark.createDataFrame(kept, f"_id {own.schema['_id'].dataType.simpleString()}, _y int, _h long"))
    rows = found.join(chosen, ["_id", "_y", "_h"]).groupBy("_id", "_y").agg(F.first("_t").alias("_t")).select("_id", "_t", "_y").collect()
    rows = sorted(map(tuple, rows), key=lambda r: (hash_of(r[0]), r[2], r[1]))
    return [(t, y) for _, t, y in rows], counts.get(1, 0) / max(1, sum(counts.values()))


def hash_of(id) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(id))


def scorer(model: Model, text_at: int) -> Callable[[pa.RecordBatch], tuple[list[float], list[str]]]:
    """Scores and spans (start:end of toxic tokens, code points) of a batch, some 400,000 tokens at a time."""

    def of(batch: pa.RecordBatch) -> tuple[list[float], list[str]]:
        scores: list[float] = []
        spans: list[str] = []
        held: list[tuple[str, np.ndarray]] = []

        def flush():
            for (t, _), p in zip(held, model.marginals([x for _, x in held]), strict=True):
                scores.append(model.score(p))
                hot = set(np.flatnonzero(p >= 0.5).tolist()) if len(p) else ()
                spans.append(",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(TOKEN.finditer(t)) if k in hot) if hot else "")
            held.clear()
            if len(model.types) > 100_000:
                model.forget()

        total = 0
        for t in batch.column(text_at):
            t = t.as_py() or ""
            x = model.ids(tokens_of(t))
            held.append((t, x))
            total += len(x)
            if total >= TOKENS or len(model.types) > 100_000:
                flush()
                total = 0
        flush()
        return scores, spans

    return of


def score(docs: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST) -> DataFrame:
    """(id, score, spans) of every row of ``docs``, learnt from the labels that ``train`` (a condition on them) lets in.

    Null texts are empty; texts without words get the score of no evidence; without labels of both classes
    every score is the share of label 1 (0 without any). Repeated rows are scored alike; an empty table
    gives no rows; other columns are ignored.
    """
    rows, share = sample(docs, labels.where(train), id, text, label, most)
    model = fit(rows, share)  # captured: it travels by value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model, 1)
        for batch in batches:
            scores, spans = of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], [id, "score", "spans"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text_of(text).alias("_text")).mapInArrow(run, f"`{id}` {kind}, score double, spans string")


def without_toxic(docs: DataFrame, corpus: DataFrame, labels: DataFrame, train: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", least: float = 0.5, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``least``; the model is learnt from ``corpus``."""
    rows, share = sample(corpus, labels.where(train), id, text, label, most)
    model, at = fit(rows, share), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model, at)
        for batch in batches:
            yield batch.filter(pa.array([s < least for s in of(batch)[0]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id: str = "doc_id") -> Column:
    """Whether a row is kept from learning; a null id is not, as it has no label."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
