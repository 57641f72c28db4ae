"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Labels are given per document, so tokens are labelled by evidence first: word counts over all
labelled training documents give the words that stand mostly in toxic documents, and a greedy
cover of the sampled toxic documents picks those that explain them (the other words of copies of
one toxic document explain nothing more). Picked words in toxic documents are the toxic tokens,
all others are clean. The random field has two labels; its emissions see the evidence class of the
word and of its neighbours, its transitions tie neighbours together. It is fitted by gradient
ascent on at most ``SAMPLE_DOCUMENTS`` labelled documents (a documented bound); the word counts
cover all of them.

Scoring is one map over the documents: forward-backward over every whole text, some
megabytes of texts at once. Marginals of 0.5 or more are offending spans; a logistic function of the
largest marginal and the expected number of toxic tokens is the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.llm.annotate import annotate, fresh_name
from squelch.llm.hashing import ALNUM, Words, slices
from squelch.llm.shared import cut, with_small

FOLDS = 5
SAMPLE_DOCUMENTS = 2000
LEXICON = 20_000
MIN_DOCUMENTS = 3
CHUNK = 64
STEPS = 80
MOST_CHUNKS = 4000
#: Evidence classes of words: clean, none, toxic but not needed to explain a sampled document, and
#: picked, by share of toxic documents among those with the word.
CLEAN, NEUTRAL, UNPICKED, PICKED = 0, 1, 2, 3
SHARES = np.array([0.8, 0.95])
CLASSES = PICKED + len(SHARES) + 1
LEAST_SHARE = 0.5
LEAST_GAIN = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KIND = "struct<score: double, spans: array<struct<first: int, end: int, marginal: double>>>"


def held_out(doc_id: Column) -> Column:
    """Documents that no label is learned from; a null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


@dataclass
class Model:
    """Word classes by sorted word hash, weights of the random field, and of the document score."""

    keys: np.ndarray
    classes: np.ndarray
    bias: float
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    moves: np.ndarray  # log potentials from label to label, [clean, toxic]
    score: np.ndarray  # constant, weight of the largest marginal's log odds, of log1p(expected)

    def emissions(self, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log potential of the toxic label per word; ``first`` are the words that begin texts."""
        before = np.full(len(classes), NEUTRAL)
        after = before.copy()
        before[1:], after[:-1] = classes[:-1], classes[1:]
        begins = first[first < len(classes)]
        before[begins] = NEUTRAL
        ends = first[(first > 0) & (first <= len(classes))] - 1
        after[ends] = NEUTRAL
        return self.bias + self.here[classes] + self.before[before] + self.after[after]

    def word_places(self, text: bytes) -> np.ndarray:
        """Places in ``keys`` of the words of a text that are there."""
        hashes = np.unique(Words(text, np.array([0, len(text)]), ALNUM).hashes())
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at[self.keys[at] == hashes]

    def word_classes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), NEUTRAL)
        low = np.zeros(1 << 20, bool)
        low[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = np.flatnonzero(low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        out = np.full(len(hashes), NEUTRAL)
        out[maybe[same]] = self.classes[at[same]]
        return out


def marginals(emission: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """P(toxic) of every word; text i owns words first[i] to first[i + 1]. Forward and backward
    log ratios of the two labels, for all texts at once, the longest first.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    forward, backward = np.zeros(len(emission)), np.zeros(len(emission))
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), "left")  # texts with more than t words
    a, b, c, d = np.exp(moves[0, 0]), np.exp(moves[1, 0]), np.exp(moves[0, 1]), np.exp(moves[1, 1])
    odds = np.exp(np.clip(emission, -30, 30))
    ratio = np.ones(0)
    for t in range(steps):
        at = begin[: alive[t]] + t
        if t == 0:
            ratio = odds[at]
        else:
            r = ratio[: alive[t]]
            ratio = odds[at] * (c + r * d) / (a + r * b)
        forward[at] = ratio
    for t in range(steps - 1, -1, -1):
        n, longer = alive[t], alive[t + 1] if t + 1 < steps else 0
        now = np.ones(n)
        if longer:
            at = begin[:longer] + t + 1
            r = backward[at] * odds[at]
            now[:longer] = (b + r * d) / (a + r * c)
        backward[begin[:n] + t] = now
    both = forward * backward
    return both / (1.0 + both)


def _learn_field(classes: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weights from chunks of ``CHUNK`` words (rows) by gradient ascent on the likelihood."""
    n, length = classes.shape
    padded = np.pad(classes, ((0, 0), (1, 1)), constant_values=NEUTRAL)
    width = 1 + 3 * CLASSES + 4
    theta, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    theta[0] = -2.0
    views = [padded[:, 1:-1], padded[:, :-2], padded[:, 2:]]
    truth = np.concatenate(
        [[labels.sum()], *[np.bincount(v[labels == 1], minlength=CLASSES) for v in views],
         np.bincount((labels[:, :-1] * 2 + labels[:, 1:]).ravel(), minlength=4)]
    ).astype(float)
    for step in range(1, STEPS + 1):
        w = [theta[1 + i * CLASSES : 1 + (i + 1) * CLASSES] for i in range(3)]
        moves = theta[-4:].reshape(2, 2)
        e = theta[0] + w[0][views[0]] + w[1][views[1]] + w[2][views[2]]
        e = np.clip(e, -30, 30)
        pot, k = np.exp(e), np.exp(moves)
        f, g = np.ones((length, n, 2)), np.ones((length, n, 2))
        f[0] = np.stack([np.ones(n), pot[:, 0]], 1)
        f[0] /= f[0].sum(1, keepdims=True)
        for t in range(1, length):
            f[t] = f[t - 1] @ k
            f[t, :, 1] *= pot[:, t]
            f[t] /= f[t].sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            after = g[t + 1].copy()
            after[:, 1] *= pot[:, t + 1]
            g[t] = after @ k.T
            g[t] /= g[t].sum(1, keepdims=True)
        p = f * g
        p = (p[:, :, 1] / p.sum(2)).T
        pair = np.zeros((2, 2))
        for t in range(length - 1):
            after = g[t + 1].copy()
            after[:, 1] *= pot[:, t + 1]
            joint = f[t][:, :, None] * k * after[:, None, :]
            pair += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        expected = np.concatenate(
            [[p.sum()], *[np.bincount(v.ravel(), p.ravel(), CLASSES) for v in views], pair.ravel()]
        )
        slope = (truth - expected) / n - 1e-3 * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta += 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    parts = [theta[1 + i * CLASSES : 1 + (i + 1) * CLASSES] for i in range(3)]
    return float(theta[0]), parts[0], parts[1], parts[2], theta[-4:].reshape(2, 2)


def _cover(texts: list[np.ndarray], allowed: np.ndarray) -> list[int]:
    """Words (places) picked one by one, each for the most texts that no picked word is in yet."""
    open_, picked = [t[allowed[t]] for t in texts], []
    while True:
        counts = np.bincount(np.concatenate(open_), minlength=len(allowed)) if open_ else np.zeros(1)
        best = int(counts.argmax())
        if counts[best] < max(LEAST_GAIN, len(texts) // 300):
            return picked
        picked.append(best)
        open_ = [t for t in open_ if best not in t]


def _features(model: Model, texts: list[bytes]) -> np.ndarray:
    """Evidence of each text; all texts go through the recursions together."""
    emissions, sizes = [], []
    for text in texts:
        words = Words(text, np.array([0, len(text)]), ALNUM)
        emissions.append(model.emissions(model.word_classes(words.hashes()), words.first))
        sizes.append(len(words))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    p = marginals(np.concatenate(emissions), first, model.moves)
    return np.array([_evidence(p[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])


def _evidence(p: np.ndarray) -> tuple[float, float]:
    top = float(np.clip(p.max(initial=1e-6), 1e-6, 1 - 1e-6))
    return np.log(top / (1 - top)), np.log1p(float(p[p >= 0.5].sum()))


def train(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label: str = "toxic",
    sample_documents: int = SAMPLE_DOCUMENTS,
) -> Model:
    """Learn from the labelled documents that are not held out. Null labels, null ids and held-out
    rows teach nothing; a document with several labels counts as toxic if one says so. Without
    both labels every score is the share of toxic documents.
    """
    marks = cut(
        labels.select(F.col(label_id).alias("_id"), F.col(label).cast("int").alias("_toxic"))
        .filter(F.col("_toxic").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
    )
    taught = with_small(
        documents.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")),
        marks.withColumn("_id", F.col("_id").cast("long")),
        ["_id"],
        "inner",
    )
    totals = {r["_toxic"]: r["n"] for r in marks.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    rate = (bad + 0.5) / (bad + good + 1)
    empty = Model(
        np.zeros(0, np.uint64), np.zeros(0, int), -9.0, *[np.zeros(CLASSES)] * 3, np.zeros((2, 2)),
        np.array([np.log(rate / (1 - rate)), 0.0, 0.0]),
    )
    if not bad or not good:
        return empty
    words = F.array_distinct(F.regexp_extract_all(F.translate("_text", UPPER, LOWER), F.lit(WORD), F.lit(0)))
    t, n = F.col("_t"), F.col("_n")
    share = t / n
    # likelihood ratio of the word's share of toxic documents against that of all documents
    gain = F.when(t > 0, t * F.log(share * (bad + good) / bad)).otherwise(0.0) + F.when(
        t < n, (n - t) * F.log((1 - share) * (bad + good) / good)
    ).otherwise(0.0)
    lexicon = (
        taught.select("_toxic", F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.sum("_toxic").alias("_t"), F.count("*").alias("_n"))
        .filter(n >= MIN_DOCUMENTS)
        .select("word", share.alias("share"), gain.alias("gain"))
        .filter(F.col("gain") >= 2.0)
        .orderBy(F.desc("gain"), "word")
        .limit(LEXICON)
        .collect()
    )
    if not lexicon:
        return empty

    def some(toxic: int) -> list[bytes]:
        rows = taught.filter(F.col("_toxic") == toxic).orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text"))
        return [r["_text"].encode() for r in rows.select("_text").limit(sample_documents // 2).collect()]

    raw = [r["word"].encode() for r in lexicon]
    known = Words(b" ".join(raw), np.array([0, sum(map(len, raw)) + len(raw) - 1]), ALNUM).hashes()
    by_key = np.argsort(known)
    known, shares = known[by_key], np.array([r["share"] for r in lexicon])[by_key]
    classes = np.where(shares >= max(LEAST_SHARE, 2 * bad / (bad + good)), UNPICKED, np.where(shares * (bad + good) < bad, CLEAN, NEUTRAL))
    model = Model(known, classes, empty.bias, empty.here, empty.before, empty.after, empty.moves, empty.score)
    texts, chunks, marks_ = {k: some(k) for k in (0, 1)}, [], []
    picked = _cover([model.word_places(t) for t in texts[1]], classes == UNPICKED)
    classes[picked] = PICKED + np.searchsorted(SHARES, shares[picked], "right")
    for toxic, found in texts.items():
        for text in found:
            w = Words(text, np.array([0, len(text)]), ALNUM)
            k = model.word_classes(w.hashes())
            y = ((k >= PICKED) & bool(toxic)).astype(int)
            for at in range(0, len(k), CHUNK):
                part = np.full(CHUNK, NEUTRAL)
                part[: len(k[at : at + CHUNK])] = k[at : at + CHUNK]
                mark = np.zeros(CHUNK, int)
                mark[: len(y[at : at + CHUNK])] = y[at : at + CHUNK]
                chunks.append(part)
                marks_.append(mark)
    k, y = np.array(chunks), np.array(marks_)
    told = np.flatnonzero(y.any(1) | (k >= UNPICKED).any(1))
    rest = np.setdiff1d(np.arange(len(k)), told)[:: max(1, (len(k) - len(told)) // max(500, len(told)))]
    use = np.concatenate([told, rest])
    use = use[np.argsort(np.random.default_rng(5).random(len(use)))][:MOST_CHUNKS]
    model.bias, model.here, model.before, model.after, model.moves = _learn_field(k[use], y[use])
    x = np.column_stack([np.ones(sum(map(len, texts.values()))), _features(model, texts[0] + texts[1])])
    label_ = np.repeat([0.0, 1.0], [len(texts[0]), len(texts[1])])
    # the sample is balanced by label; weights bring back the share of each label
    weight = np.where(label_ == 1, bad / max(1, len(texts[1])), good / max(1, len(texts[0])))
    weight /= weight.sum()
    beta = np.zeros(3)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (label_ - p)) - 1e-4 * beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        beta += np.clip(np.linalg.solve(bend, slope), -2, 2)
    model.score = beta
    return model


def _scorer(model: Model):
    def score(column: pa.Array) -> list[dict]:
        emissions, firsts, made, base = [], [np.zeros(1, np.int64)], [], 0
        for _, _, raw, offsets in slices(column):
            words = Words(raw, offsets, ALNUM)
            emissions.append(model.emissions(model.word_classes(words.hashes()), words.first))
            made.append((words.start.astype(np.int32), words.end.astype(np.int32), offsets, raw))
            firsts.append(words.first[1:] + base)
            base += len(words)
        first = np.concatenate(firsts)
        p = marginals(np.concatenate(emissions) if emissions else np.zeros(0), first, model.moves)
        out, doc, base = [], 0, 0
        for start, end, offsets, raw in made:
            for row in range(len(offsets) - 1):
                lo, hi = first[doc], first[doc + 1]
                mine = p[lo:hi]
                top, expected = _evidence(mine)
                logit = float(model.score @ np.array([1.0, top, expected]))
                spans = []
                if len(mine) and (mine >= 0.5).any():
                    hit = np.flatnonzero(mine >= 0.5)
                    text = raw[offsets[row] : offsets[row + 1]]
                    for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                        a = int(start[lo - base + run[0]] - offsets[row])
                        b = int(end[lo - base + run[-1]] - offsets[row])
                        before = len(text[:a].decode())
                        spans.append(
                            {"first": before, "end": before + len(text[a:b].decode()), "marginal": float(mine[run].max())}
                        )
                out.append({"score": float(1 / (1 + np.exp(-np.clip(logit, -30, 30)))), "spans": spans})
                doc += 1
            base += len(start)
        return out

    return score


def score_documents(documents: DataFrame, model: Model, name: str, text: str = "text") -> DataFrame:
    """``documents`` with a struct ``name``: score (0 to 1) and spans (code points from first to
    end, with their largest marginal). Null and empty texts get the score of no evidence.
    """
    return annotate(documents, text, _scorer(model), name, KIND)


def reject_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below ``limit``, with their own columns."""
    name = fresh_name(documents, "toxicity")
    scored = score_documents(documents, train(documents, labels, id_col, text), name, text)
    return scored.filter(F.col(name)["score"] < limit).drop(name)
