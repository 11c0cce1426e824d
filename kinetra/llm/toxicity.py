"""Toxicity by weak supervision.

Voters, each of which votes for `toxic` or abstains on a document:

* lexicon voters: SEEDS, a short list of insults, and words and word beginnings of PREFIXES bytes that a bounded
  sample of labelled training rows shows almost only in toxic documents (at most MINED of them);
* pattern voters: mostly capitals, runs of exclamation marks, many symbols.

A generative label model (two classes; how often each voter votes in either, by expectation maximisation) is fitted on
bounded samples of labelled and of unlabelled documents (SAMPLE and UNLABELLED of them). Within the classes, correlations
of voters are estimated in each round: a voter's weight is divided by one plus its correlations above CORRELATED. Labels
anchor the rates and calibrate the odds (two numbers, by logistic regression); the posterior of a document is a function
of its votes alone, so it may well differ from its label. The posteriors, those of unlabelled documents among them, train
a linear (logistic) classifier on votes, hits and hit density, which scores every whole text; it never sees labels, lang,
source or doc_id. Held-out documents take no part in fitting, with or without label.

Defined results: a null or empty text has no votes and the score of such a document; without labelled rows (or of one
class only) the label model starts from the votes of seeds alone; without any row a fixed model of the seeds scores;
repeated rows are scored row by row, a document without doc_id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm import labelled
from kinetra.llm.words import Words, chunks, utf8, words_of
from kinetra.llm.workers import lean, trim

#: Common English insults.
SEEDS = ["clown", "disgusting", "dumb", "freak", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]

FOLDS = 5
PREFIXES = (5, 6)
MINED = 400
LEAST = 3
ODDS = 3.0
PATTERNS = 3
CHUNK_BYTES = 2 << 20
#: How far a label is trusted as the class of its document.
ANNOTATOR = 0.98
#: At most so many unlabelled documents fit the label model: those with the least hash of doc_id.
UNLABELLED = 12000
CORRELATED = 0.5
#: Rows that the driver's sums take at once.
ROWS = 2048


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all words and of their beginnings."""
    row = words.row()
    yield row, words.hash
    for size in PREFIXES:
        long, h = words.prefix(size)
        yield row[long], h


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either class with each feature; the whole partition's share of the bounded sample."""
    seen: list[np.ndarray] = []
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        y = batch.column("y").to_numpy()
        for a, b in chunks(offsets, CHUNK_BYTES):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for row, h in _features(words):
                pairs = np.unique(np.stack([h, row.astype(np.uint64)], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                keys, which = np.unique(pairs[:, 0], return_inverse=True)
                toxic = y[a:b][pairs[:, 1].astype(np.int64)] == 1
                seen.append(np.stack([keys.view(np.int64), np.bincount(which, toxic, len(keys)).astype(np.int64), np.bincount(which, ~toxic, len(keys)).astype(np.int64)]))
    if seen:
        all_ = np.concatenate(seen, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(all_[0]), pa.array(all_[1]), pa.array(all_[2])], names=["feature", "toxic", "clean"])


@dataclass
class Voters:
    """Sorted feature hashes and the voter of each; patterns are the last PATTERNS voters."""

    hashes: np.ndarray
    voter: np.ndarray
    count: int

    @classmethod
    def of(cls, mined: list[int]) -> Voters:
        seeds = words_of(SEEDS).hash
        hashes = np.concatenate([seeds, np.array(mined, np.int64).view(np.uint64)])
        hashes, first = np.unique(hashes, return_index=True)
        return cls(hashes, first, len(seeds) + len(mined) + PATTERNS)

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(votes, features for the classifier) of some documents."""
        n = len(offsets) - 1
        words = Words(data, offsets)
        votes = np.zeros((n, self.count), bool)
        hits = np.zeros(n)
        for row, h in _features(words):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            found = self.hashes[at] == h
            votes[row[found], self.voter[at[found]]] = True
            hits += np.bincount(row[found], minlength=n)
        sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        size = np.maximum(np.diff(offsets), 1)
        upper, lower = sums((data >= 65) & (data <= 90)), sums((data >= 97) & (data <= 122))
        votes[:, -3] = upper > lower
        votes[:, -2] = sums(data == 33) > size / 50
        votes[:, -1] = sums((data >= 35) & (data <= 38) | (data == 42)) > size / 50
        dense = hits / np.maximum(np.diff(words.first), 1)
        lexicon = votes[:, : self.count - PATTERNS].sum(1)
        return votes, np.column_stack([votes, lexicon > 0, np.log1p(lexicon), np.log1p(hits), np.minimum(dense * 20, 1)]).astype(np.float64)


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 12, first: np.ndarray | None = None) -> tuple[np.ndarray, dict]:
    """Posterior of `toxic` for each row by its votes, and the model: rates of votes in either class, shares, calibration.

    gold: 1, 0 or -1 (no label); first: where there is no gold, the beliefs to start from. Votes and absent votes count;
    a voter's share of its weight falls with its correlations within the classes.
    """
    v, known = votes.astype(np.float32), gold >= 0
    trusted = np.where(gold == 1, ANNOTATOR, 1 - ANNOTATOR)
    belief = np.where(known, trusted, 0.0) if known.any() else np.asarray(first, np.float64)
    weight = known.astype(np.float64) if known.any() else np.ones(len(v))
    slope, base = 1.0, 0.0
    for _ in range(rounds):
        b, c = belief * weight, (1 - belief) * weight
        yes = np.clip((b @ v + 0.1) / (b.sum() + 1), 1e-5, 1 - 1e-5)
        no = np.clip((c @ v + 0.1) / (c.sum() + 1), 1e-5, 1 - 1e-5)
        together = np.zeros((v.shape[1], v.shape[1]))
        for a in range(0, len(v), ROWS):
            some = slice(a, a + ROWS)
            left = (v[some] - np.outer(belief[some], yes) - np.outer(1 - belief[some], no)) * np.sqrt(weight[some])[:, None]
            together += left.T @ left
        scale = np.sqrt(np.diag(together)) + 1e-9
        together /= np.outer(scale, scale)
        np.fill_diagonal(together, 0)
        share = 1 / (1 + np.where(together > CORRELATED, together, 0).sum(1))
        absent = share * np.log((1 - yes) / (1 - no))
        odds = v @ (share * np.log(yes / no) - absent) + absent.sum()
        if known.any():
            w, base = logistic(odds[known][:, None], (gold[known] == 1).astype(np.float64), ridge=1e-3)
            slope = float(w[0])
        else:
            base = float(np.log(np.clip(b.sum() / len(v), 1e-4, 0.5)) - np.log1p(-np.clip(b.sum() / len(v), 1e-4, 0.5)))
        posterior = 1 / (1 + np.exp(-np.clip(slope * odds + base, -30, 30)))
        belief, weight = np.where(known, trusted, posterior), np.ones(len(v))
    return posterior, {"yes": yes, "no": no, "share": share, "slope": slope, "base": base}


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft targets, by Newton's method."""
    k = x.shape[1]
    penalty = np.full(k + 1, ridge)
    penalty[-1] = 1e-3
    w = np.zeros(k + 1)
    for _ in range(rounds):
        curve, slope = np.diag(penalty), -penalty * w
        for a in range(0, len(x), ROWS):
            some = np.column_stack([x[a : a + ROWS], np.ones(len(x[a : a + ROWS]))]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            curve += (some.T * (p * (1 - p))) @ some
            slope += some.T @ (target[a : a + ROWS] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _voted(voters: Voters):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, CHUNK_BYTES):
                votes, x = voters.votes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                packed = [np.packbits(r).tobytes() for r in votes]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("y").slice(a, b - a), pa.array(packed, pa.binary()), pa.array([r.tobytes() for r in x[:, -4:]], pa.binary())], names=["doc_id", "y", "votes", "more"])

    return run


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    intercept: float
    label_model: dict

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = self.voters.votes(data, offsets)[1]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.intercept, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE, folds: int = FOLDS, unlabelled: int = UNLABELLED) -> Model:
    held_out = labelled.fold(folds) == 0
    rows = labelled.training(docs, labels, "toxic", held_out, sample)
    counts = rows.mapInArrow(_counted, "feature bigint, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.25) / (F.col("clean") + 0.25))
    totals = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    base = np.log(max(totals.get(1, 0), 1) / max(totals.get(0, 0), 1))
    least = max(LEAST, totals.get(1, 0) // 100)
    top = counts.filter((F.col("toxic") >= least) & (odds - F.lit(float(base)) >= ODDS)).orderBy(F.desc("toxic"), "clean", "feature").limit(MINED)
    voters = Voters.of([r.feature for r in top.collect()] if len(totals) == 2 else [])
    voted = rows.unionByName(labelled.unlabelled(docs, labels, "toxic", held_out, unlabelled))
    got = voted.mapInArrow(_voted(voters), "doc_id bigint, y int, votes binary, more binary").collect()
    if not got:
        weights = np.zeros(voters.count + 4)
        weights[: len(SEEDS)] = 4.0
        return Model(voters, weights, -2.0, {})
    got.sort(key=lambda r: (r.doc_id, r.y))
    votes = np.stack([np.unpackbits(np.frombuffer(bytes(r.votes), np.uint8), count=voters.count) for r in got]).astype(bool)
    x = np.column_stack([votes, np.stack([np.frombuffer(bytes(r.more)) for r in got]).astype(np.float32)])
    gold = np.array([r.y for r in got])
    if len(totals) < 2:
        gold[:] = -1
    seeds = np.where(votes[:, : len(SEEDS)].any(1), 0.9, 0.02)
    posterior, model = label_model(votes, gold, first=seeds)
    weights, intercept = logistic(x, posterior)
    del got, votes, x
    trim()  # of the driver
    return Model(voters, weights, intercept, model)


def _scored(model: Model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            scores = [model.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets, CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "_toxicity"])

    return run


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, text and _toxicity (0 to 1) of every row."""
    df = docs.select(*carry, "text")
    return df.mapInArrow(_scored(model), ", ".join(f"`{k}` {t}" for k, t in df.dtypes) + ", _toxicity double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model fitted on the training folds."""
    s = F.col("_toxicity")
    return score(docs, fit(docs, labels)).select("doc_id", (labelled.fold(FOLDS) == 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))
