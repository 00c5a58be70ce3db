"""Mixing to target weights: soft domain membership from a classifier, document rates by projected gradient."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import same, stored, utf8, without
from .decontam import words_of

DOMAINS = ("good", "poor", "toxic")
#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
VOCABULARY = 512
LEAST_DOCS = 5
#: A word must be this unevenly spread over the domains (a term of the chi-squared statistic) to become a feature.
UNEVEN = 30.0
ROUNDS = 500
#: Ridge on the weights, as of so many rows.
DECAY = 2.0
SEED = 7
#: Pull of every rate towards 1. It makes the rates unique, keeps those of documents that are hardly of a domain in
#: excess, and leaves a relative residual of RIDGE times how far a domain's rates are from 1.
RIDGE = 0.05
TOLERANCE = 1e-5
#: Where domains are to keep their tokens, documents whose rate is at most so far from 1 stay as they are.
STEADY = 0.25
OWN = ("n_tokens", "posteriors", "rate", "copies", "_key", "_f")
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"-()")
_STYLE = 8


def style(text: bytes, words: list[bytes]) -> list[float]:
    """Features of a text's form, whatever its vocabulary."""
    n = max(1, len(words))
    raw = text.split()
    kinds = set(words)
    odd = len(text) - len(text.translate(None, _SYMBOLS))
    same = sum(a == b for a, b in zip(raw, raw[1:]))
    return [
        np.log1p(len(words)),
        len(text) / n / 10,
        odd / max(1, len(text)) * 10,
        text.count(b"|") / n,
        len(kinds) / n,
        same / n,
        sum(c < 58 and c > 47 for c in text) / max(1, len(text)) * 10,
        len(text.split(b"\n")) / n,
    ]


class Classifier:
    """Two logistic regressions, of low quality and of toxicity, over word presence and style.

    Toxic texts are toxic whatever their quality. Without rows there are no weights, and all texts are good.
    """

    def __init__(self, words: list[bytes], rows: list[tuple[list[int], list[float], list[int]]]):
        self.code = {w: i for i, w in enumerate(words)}
        self.weights = None
        if not rows:
            return
        goal = np.array([r[2] for r in rows], np.float32)
        form = np.array([r[1] for r in rows])
        self.mean, self.spread = form.mean(axis=0), form.std(axis=0) + 1e-6
        x = np.zeros((len(rows), len(words) + _STYLE + 1), np.float32)
        for i, (present, _, _) in enumerate(rows):
            x[i, present] = 1
        x[:, len(words) : -1] = (form - self.mean) / self.spread
        x[:, -1] = 1
        top = np.ones(x.shape[1], np.float32)
        for _ in range(30):  # the largest eigenvalue of the second moments bounds the curvature
            top = x.T @ (x @ top) / len(rows)
            bound = float(np.linalg.norm(top))
            top /= bound
        decay = DECAY / len(rows)
        step = 1.0 / (0.25 * bound + decay)
        # Nesterov's accelerated gradient. A label that no row has keeps no probability. Style tells nothing of toxicity.
        free = np.ones((x.shape[1], 2), np.float32)
        free[len(words) : -1, 1] = 0
        w = before = np.zeros((x.shape[1], 2), np.float32)
        for t in range(ROUNDS):
            ahead = w + t / (t + 3) * (w - before)
            slope = x.T @ (_sigmoid(x @ ahead) - goal) / len(rows) + decay * ahead
            before, w = w, ahead - step * free * slope
        w[-1, goal.max(axis=0) == 0] = -1e9
        self.weights = w

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Probabilities of DOMAINS and token counts (words between white space)."""
        tokens = [len(t.split()) for t in texts]
        odds = np.zeros((len(texts), 2))
        if self.weights is not None:
            forms = np.zeros((len(texts), _STYLE))
            for i, text in enumerate(texts):
                words = words_of(text)
                forms[i] = style(text, words)
                present = [self.code[w] for w in self.code.keys() & set(words)]
                odds[i] = self.weights[present].sum(axis=0)
            odds = _sigmoid(odds + (forms - self.mean) / self.spread @ self.weights[len(self.code) : -1] + self.weights[-1])
        poor, toxic = odds[:, 0], odds[:, 1]
        return np.stack([(1 - toxic) * (1 - poor), (1 - toxic) * poor, toxic], axis=1), tokens


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, poor, toxic (0 or 1) of at most `rows` labelled documents.

    Rows without an id, quality or toxicity are not labelled. Of several labels of a document the worst count.
    """
    full = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    told = full.groupBy("doc_id").agg(
        F.max((F.col("quality") <= 0).cast("int")).alias("poor"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    # The draw moves ids only; what it leaves has `rows` rows at most.
    drawn = (
        docs.where("text IS NOT NULL").select("doc_id").join(told, "doc_id").dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(rows)
    )
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by(F.struct("text", "poor", "toxic"), F.md5("text")).alias("x")).select("x.*")


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Fit the classifier on the bounded sample of `labelled`. Words are chosen by how unevenly domains use them."""
    sample = stored(labelled(docs, labels), "mixing-sample")
    kinds = F.arrow_udf(lambda texts: pa.array([sorted(set(words_of(t))) for t in texts.to_pylist()], pa.list_(pa.binary())), "array<binary>")
    told = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("poor").alias("poor"), F.sum("toxic").alias("toxic")).first()
    counts = sample.select("poor", "toxic", F.explode(kinds(utf8("text"))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("poor").alias("poor"), F.sum("toxic").alias("toxic")
    )
    uneven = F.lit(0.0)
    for kind in ("poor", "toxic"):
        if told[kind]:
            expected = F.col("n") * (told[kind] / told["n"])
            uneven = F.greatest(uneven, F.pow(F.col(kind) - expected, 2) / expected)
    chosen = counts.where((F.col("n") >= LEAST_DOCS) & (uneven >= UNEVEN)).orderBy(uneven.desc(), "word").limit(VOCABULARY)
    words = [bytes(r["word"]) for r in chosen.select("word").collect()]
    code = {w: i for i, w in enumerate(words)}

    def features(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            found = words_of(text)
            out.append({"present": sorted(code[w] for w in code.keys() & set(found)), "form": style(text, found)})
        return pa.array(out, pa.struct([("present", pa.list_(pa.int32())), ("form", pa.list_(pa.float64()))]))

    made = F.arrow_udf(features, "struct<present:array<int>, form:array<double>>")
    # At most FIT_ROWS short lists of numbers.
    rows = [
        (r["f"]["present"], r["f"]["form"], [r["poor"], r["toxic"]])
        for r in sample.select("poor", "toxic", made(utf8("text")).alias("f")).collect()
    ]
    return Classifier(words, rows)


def _score(shared) -> Callable[[pa.Array], pa.Array]:
    def score(texts: pa.Array) -> pa.Array:
        p, n = shared.value.posteriors([t or b"" for t in texts.to_pylist()])
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["n", "p"]
        )

    return score


def _rates(p: np.ndarray, history: list[list[float]]) -> np.ndarray:
    """Rates after the gradient steps so far: each moves a rate by what the domains' residuals say, never below 0."""
    rate = np.ones(len(p))
    for slope in history:
        rate = np.maximum(0.0, rate - (p @ slope + RIDGE * (rate - 1)) / (1 + RIDGE))
    return rate


def _matrix(part: pa.RecordBatch) -> np.ndarray:
    return part.column("p").flatten().to_numpy().reshape(part.num_rows, -1)


def _totals(history: list[list[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def totals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(DOMAINS))
        for part in parts:
            if part.num_rows:
                p = _matrix(part)
                total += (part.column("n").to_numpy() * _rates(p, history)) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in total], names=list(DOMAINS))

    return totals


def _expected(members: DataFrame, history: list[list[float]]) -> np.ndarray:
    kinds = ", ".join(f"{d} double" for d in DOMAINS)
    sums = members.select("n", "p").mapInArrow(_totals(history), kinds).agg(*[F.sum(d).alias(d) for d in DOMAINS]).first()
    return np.array([sums[d] or 0.0 for d in DOMAINS])


def fit_rates(members: DataFrame, totals: np.ndarray, natural: np.ndarray) -> list[list[float]]:
    """The steps of a projected gradient descent from rate 1 for the rates r >= 0 of all rows (n, p) of `members`.

    It minimises the sum over domains of (sum of n p r less the total)^2 over the domain's natural total, plus RIDGE
    times the sum of n (r - 1)^2. Rows are weighted by their tokens, in which metric steps of size 1 / (1 + RIDGE) are
    safe: the second moments of p, so weighted, have no eigenvalue over 1. The rates themselves never leave the executors: a step is a few numbers for all rows, and a row's
    rate follows from its p and the steps so far. Each step costs one pass over the compact members.
    """
    history: list[list[float]] = []
    own = np.where(natural > 0, natural, 1.0)
    now, settled = natural, False
    # Strongly convex, so the steps settle; how soon depends on RIDGE and on the domains, not on the number of rows.
    while not settled:
        history.append(((now - totals) / own).tolist())
        after = _expected(members, history)
        settled = np.abs(after - now).max() <= TOLERANCE * max(1.0, natural.sum())
        now = after
    return history


def mix(
    docs: DataFrame,
    labels: DataFrame,
    shares: Mapping[str, float] | None = None,
    multiples: Mapping[str, float] | None = None,
    steady: float | None = None,
) -> DataFrame:
    """All rows of `docs` with n_tokens, posteriors (of DOMAINS), rate and copies.

    The labels train a classifier on a bounded sample of labelled documents; its posteriors are soft memberships in the
    domains good, poor and toxic, for every document. Rates are fitted so that the expected tokens of each domain match
    its target: `shares` of all tokens, or `multiples` of the tokens that the domain has. copies is the rate's whole part,
    and one more if a seeded hash of doc_id and text lies below the rest: repeatable, and as many tokens as the rates ask
    for in expectation. A rate at most `steady` from 1 gives one copy: STEADY where `multiples` are asked for, else 0.

    Targets that no rates reach are met in the least-squares sense. A domain that no document belongs to stays empty.
    Without any labelled document all are good. Null and empty texts have no tokens, and posteriors like any text.
    Equal texts get equal rates. An empty table gives an empty one. Input columns named like a result column are
    replaced by it.
    """
    steady = (0.0 if multiples is None else STEADY) if steady is None else steady
    key = F.md5(F.coalesce(utf8("text"), F.lit(b"")))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    scored = F.arrow_udf(_score(shared), "struct<n:bigint, p:array<double>>")
    members = stored(
        docs.select(key.alias("_key"), scored(utf8("text")).alias("f")).select("_key", "f.*"), "mixing-members"
    )
    natural = _expected(members, [])
    if multiples is not None:
        totals = natural * np.array([multiples[d] for d in DOMAINS])
    else:
        totals = natural.sum() * np.array([(shares or {})[d] for d in DOMAINS])
    history = fit_rates(members, totals, natural)

    def rates(p: pa.Array) -> pa.Array:
        return pa.array(_rates(p.flatten().to_numpy().reshape(len(p), -1), history), pa.float64())

    rate = F.arrow_udf(rates, "double")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "_key"), 11) / float(1 << 53)
    whole = F.floor("rate")
    drawn = whole + (draw < F.col("rate") - whole).cast("long")
    # Stored first, so that both sides of the join have an exchange and Spark can split a text that many rows repeat.
    known = stored(
        members.groupBy("_key").agg(F.first("n").alias("n_tokens"), F.first("p").alias("posteriors")), "mixing-known"
    )
    return (
        without(docs, OWN)
        .withColumn("_key", key)
        .join(known.withColumn("rate", rate("posteriors")), "_key")
        .withColumn("copies", F.when(F.abs(F.col("rate") - 1) <= steady, F.lit(1).cast("long")).otherwise(drawn))
        .drop("_key")
    )


def mixed(docs: DataFrame, labels: DataFrame, multiples: Mapping[str, float], repeat: bool = True) -> DataFrame:
    """The documents as often as their copies say (without `repeat` once at most), in the columns of `docs`."""
    found = mix(docs, labels, multiples=multiples).where("copies > 0")
    if repeat:
        found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(*same(docs))
