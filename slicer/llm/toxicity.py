"""Toxic passages as maximum-scoring segments of token log-odds.

Fit (on a bounded sample of labelled rows, ``fit_rows_per_class`` of each class, near copies once; nothing
else is bounded): log-odds of tokens, toxic against clean, by numbers of documents. The prior of a
word is Dirichlet with the rates of the word's beginnings (4 to 6 characters), so
inflected and unseen words inherit from their stem. Words whose log-odds are significant either way keep their
score, so that clean words break passages; stems count for toxicity only. All other tokens pool into one background token,
whose score is the log ratio of its shares in toxic and clean texts, below 0 by as much as makes the mean score of clean words negative.

Score: a linear scan finds all maximal scoring segments of a text. Extreme-value
calibration: chance segments of score S or more occur K n exp(-lambda S) times in n clean
words. Lambda solves: the mean of exp(lambda score) over clean words is 1; where the segments of the sample's clean texts
have a heavier tail than that, as words are not independent, theirs is taken. K comes from their number. Segments
of which fewer than ``LEVEL`` are expected at the text's own length are its passages. Each is
worth lambda S - log(K n); the sum over passages, mapped to a probability by a logistic
fit, is the score. For the calibration every text is scored without its own part in the counts.

Defined results: null and empty texts have no passages and get the score of such
texts, which is never a toxic one; without labels of both classes every score is 0; a null doc_id is never
held out and never trained on; repeated rows are scored each; labels that contradict
each other count as toxic; texts of any length are read whole; the fit is the same however rows are dealt out; an empty table
gives no rows; further columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicer.llm.session import bound_batches, checkpointed

PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
TOKEN = re.compile(r"[^\W\d_]+")
STEMS = (6, 5, 4)
LEVEL = 0.05
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_passages int, passages array<struct<start:int,end:int,score:double>>"


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    background: float = -0.01
    scale: float = 1.0  # lambda
    chance: float = 1.0  # K
    offset: float = -40.0
    slope: float = 0.0


class Scores(dict):
    """Score of each token; stems are looked up once for each new word."""

    def __init__(self, model: Model, most: int = 400_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        got = self.model.words.get(word)
        if got is None:
            got = next((s for k in STEMS if len(word) >= k and (s := self.model.stems.get(word[:k])) is not None), self.model.background)
        if len(self) >= self.most:
            self.clear()
        self[word] = got
        return got


def maximal_segments(positions: list[int], scores: list[float], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in linear time.

    Tokens at ``positions`` have ``scores``; all other tokens score ``background`` < 0,
    so only the given ones can begin or end a segment.
    """
    out: list[list[float]] = []  # [start, end, sum before, sum after]
    total, at = 0.0, 0
    for p, s in zip(positions, scores, strict=True):
        total += background * (p - at)
        at = p + 1
        if s <= 0:
            total += s
            continue
        seg = [p, p + 1, total, total + s]
        total += s
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= seg[2]:
                j -= 1
            if j < 0 or out[j][3] >= seg[3]:
                out.append(seg)
                break
            seg = [out[j][0], seg[1], out[j][2], seg[3]]
            del out[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in out]


def hits(text: str | None, scores: Scores) -> tuple[int, list[int], list[float]]:
    """The number of tokens of a text, and positions and scores of those that are not background."""
    tokens = TOKEN.findall((text or "").lower())
    background = scores.model.background
    values = [scores[t] for t in tokens]
    at = [i for i, v in enumerate(values) if v != background]
    return len(tokens), at, [values[i] for i in at]


def passages(n: int, at: list[int], values: list[float], model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """The extreme-value evidence of a text of ``n`` tokens and its passages."""
    if not at:
        return 0.0, []
    length = math.log(model.chance * n)
    strong = [x for x in maximal_segments(at, values, model.background) if model.scale * x[2] - length > -math.log(LEVEL)]
    return sum(model.scale * x[2] - length for x in strong), strong


def evidence(text: str | None, scores: Scores) -> tuple[float, list[tuple[int, int, float]]]:
    """The extreme-value evidence of a text and its passages."""
    return passages(*hits(text, scores), scores.model)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, documents) of a part of the sample; feature '' counts documents."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            words = set(TOKEN.findall((text or "").lower()))
            seen[toxic].update(words)
            seen[toxic].update({f"^{w[:k]}" for w in words for k in STEMS if len(w) >= k})
            seen[toxic][""] += 1
    rows = [(k, t, n) for t, c in seen.items() for k, n in c.items()]
    for i in range(0, len(rows), 50_000):
        part = rows[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int32()), pa.array([r[2] for r in part], pa.int64())], ["feature", "toxic", "n"])


def _sample(documents: DataFrame, labels: DataFrame, rows_per_class: int) -> DataFrame:
    """Texts and labels of at most ``rows_per_class`` training rows of each class, near copies once."""
    train = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [train.where(F.col("toxic") == c).withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id").limit(rows_per_class).drop("rank") for c in (0, 1)]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = texts.join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")  # at most 2 * rows_per_class ids
    # near copies share the least hash of their word triples with high probability
    few = few.withColumn("w", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))
    least = F.expr("array_min(transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(w[i], try_element_at(w, i + 2), try_element_at(w, i + 3))))")
    # at most 2 * rows_per_class rows: the least document of each group, so that the fit does not depend on the order of rows
    return few.withColumn("least", least).groupBy("least", "toxic").agg(F.min(F.struct("doc_id", "text"))["text"].alias("text")).select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame, *, fit_rows_per_class: int = 6000, prior: float = 0.5, min_z: float = 2.7, min_odds: float = 1.5) -> Model:
    """Fit on a bounded, hash-ordered sample of the labelled rows (documented bound: ``fit_rows_per_class``)."""
    spark = documents.sparkSession
    bound_batches(spark)
    sample = _sample(documents, labels, fit_rows_per_class)
    sample = checkpointed(sample)
    counts = sample.mapInArrow(_features, "feature string, toxic int, n bigint").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0"))
    total = counts.where("feature = ''").collect()
    if not total or not total[0].n1 or not total[0].n0:
        return Model()
    t1, t0 = total[0].n1, total[0].n0
    # also what is significant once a text is left out of the other class; leaving one out of its own adds nothing
    tests = [_significance(F.col("n1"), F.col("n0"), t1, t0, prior), _significance(F.col("n1"), F.greatest(F.col("n0") - 1, F.lit(0)), t1, t0 - 1, prior), _significance(F.greatest(F.col("n1") - 1, F.lit(0)), F.col("n0"), t1 - 1, t0, prior)]
    strong = [(z >= min_z) & (odds >= min_odds) for z, odds in tests] + [(z <= -min_z) & (odds <= -min_odds) & ~F.startswith("feature", F.lit("^")) for z, odds in tests]
    chosen = strong[0]
    for c in strong[1:]:
        chosen = chosen | c
    rows = counts.where("feature <> ''").where(chosen).orderBy("feature").collect()  # some of the sample's words
    features = [(r.feature, r.n1, r.n0) for r in rows]
    limits = (prior, min_z, min_odds)
    model = _model(features, t1, t0, *limits)
    others = (_model([(f, n1, max(n0 - 1, 0)) for f, n1, n0 in features], t1, t0 - 1, *limits), _model([(f, max(n1 - 1, 0), n0) for f, n1, n0 in features], t1 - 1, t0, *limits))
    found = sample.mapInArrow(_hits(others), "n int, at array<int>, scores array<double>, toxic int").collect()
    _calibrate(model, *([(r.n, r["at"], r.scores) for r in found if r.toxic == y] for y in (0, 1)))
    x = [passages(r.n, r["at"], r.scores, model)[0] for r in found]
    model.offset, model.slope = _logistic(np.array(x), np.array([r.toxic for r in found], float))
    model.offset = min(model.offset, -0.01)  # a text without passages is not toxic, whatever the share of toxic labels
    return model


def _significance(n1, n0, t1: int, t0: int, prior: float, log=F.log, sqrt=F.sqrt):
    """z and log-odds of a feature in n1 of t1 toxic and n0 of t0 clean documents."""
    odds = log((n1 + prior) / (t1 + 2 * prior)) - log((n0 + prior) / (t0 + 2 * prior))
    return odds / sqrt(1 / (n1 + prior) + 1 / (n0 + prior)), odds


def _model(features: list[tuple[str, int, int]], t1: int, t0: int, prior: float, min_z: float, min_odds: float) -> Model:
    """Scores of the significant ones of ``features`` (feature, toxic documents, clean documents)."""
    kept = []
    for feature, n1, n0 in features:
        z, odds = _significance(n1, n0, t1, t0, prior, math.log, math.sqrt)
        if z >= min_z and odds >= min_odds or feature[0] != "^" and z <= -min_z and odds <= -min_odds:
            kept.append((feature, n1, n0))
    model = Model(stems={f[1:]: _log_odds(n1, n0, t1, t0, prior, 0.0, 0.0) for f, n1, n0 in kept if f[0] == "^"})
    for f, n1, n0 in kept:
        if f[0] != "^":
            stem = next((model.stems[f[:k]] for k in STEMS if f[:k] in model.stems), 0.0)
            model.words[f] = _log_odds(n1, n0, t1, t0, prior, stem, 4.0)
    return model


def _calibrate(model: Model, clean: list[tuple[int, list[int], list[float]]], toxic: list[tuple[int, list[int], list[float]]]) -> None:
    """Set background, lambda and K from the tokens of texts (see ``hits``)."""
    n, found = sum(c[0] for c in clean), sum(len(c[1]) for c in clean)
    n1, found1 = sum(c[0] for c in toxic), sum(len(c[1]) for c in toxic)
    values = np.sort(np.array([v for c in clean for v in c[2]]))  # sorted, so that sums do not depend on the order of texts
    rest = max(1, n - found)
    ratio = math.log(max(1, n1 - found1) / max(1, n1)) - math.log(rest / max(1, n))
    model.background = min(ratio, -0.01, -0.01 - max(0.0, float(values.sum())) / rest)
    # lambda: sum of p0 * exp(lambda * score) = 1, between 0 and where the sum is over 1 for good
    excess = lambda x: (float(np.exp(x * values).sum()) + rest * math.exp(x * model.background)) / max(1, rest + len(values)) - 1
    low, high = 0.0, 1.0
    if len(values) and values[-1] > 0:
        while excess(high) < 0:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if excess(mid) < 0 else (low, mid)
        model.scale = max(low, 1e-3)
    s = np.array([x[2] for c in clean for x in maximal_segments(c[1], c[2], model.background)])
    least = float(np.median(s)) if len(s) else 0.0
    over = s[s > least] - least
    # quantiles, because some labels are wrong; the widest of them, because clean texts differ
    if len(over) >= 20:
        model.scale = min(model.scale, *(-math.log(1 - q) / float(np.quantile(over, q)) for q in (0.5, 0.75, 0.9)))
    model.chance = (len(over) + 1) * math.exp(model.scale * least) / max(1, n)


def _log_odds(n1: int, n0: int, t1: int, t0: int, prior: float, stem: float, strength: float) -> float:
    """Log-odds of a token in toxic documents, with a Dirichlet prior of ``strength`` at the stem's odds."""
    share = 1 / (1 + math.exp(-stem))
    return math.log((n1 + prior + strength * share) / (t1 + 2 * prior + strength)) - math.log((n0 + prior + strength * (1 - share)) / (t0 + 2 * prior + strength))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope of P(toxic) by Newton steps."""
    w = np.ones_like(y)
    a = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (y - p)) - ridge * beta
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), g)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _hits(models: tuple[Model, Model]):
    """The ``hits`` of each text by the model for its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [Scores(m) for m in models]
        for batch in batches:
            found = [hits(t, scores[y]) for t, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True)]
            n, at, values = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), batch["toxic"]], ["n", "at", "scores", "toxic"])

    return run


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            found = [evidence(t, scores) for t in batch["text"].to_pylist()]
            z = np.clip(model.offset + model.slope * np.array([x for x, _ in found], float), -700, 700)
            p = 1 / (1 + np.exp(-z))
            every = [[{"start": x, "end": y, "score": v} for x, y, v in segments] for _, segments in found]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(s) for s in every], pa.int32()), pa.array(every, PASSAGES)],
                ["doc_id", "held_out", "score", "predicted", "n_passages", "passages"],
            )

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``documents``: its score and all its passages (in tokens)."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model), SCHEMA)


def _clean(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            z = [model.offset + model.slope * evidence(t, scores)[0] for t in batch["text"].to_pylist()]
            yield batch.select(["row"]).filter(pa.array([x < 0 for x in z], pa.bool_()))

    return run


def clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with all their columns and without a shuffle."""
    bound_batches(documents.sparkSession)
    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_clean(model), StructType([rows.schema["row"]])).select("row.*")


def toxicity(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(documents, fit(documents, labels, **options))
