"""Toxicity by weak supervision.

Many voters look at a text: a lexicon of common insults, lexicons of words and of word beginnings, induced from
labelled rows and split by kind and strength, and patterns such as shouting. Each votes toxic, clean or abstains. A
generative label model, fitted by expectation maximisation over the counts of vote patterns, estimates every voter's
accuracy and which voters depend on each other within the classes. Its posteriors, not the labels themselves, are
what a linear classifier over words, word beginnings and votes is trained on. The given label is one voter more,
with an accuracy to estimate like all others.

The lexicons and the classifier are fitted on a bounded sample of the labelled rows, ``max_rows`` by a hash of the
id, which bounds what reaches the driver: the sample's vote patterns, and those of its features whose likelihood
ratio exceeds what chance leaves among so many. Every document is scored over its whole text from the text alone.

Defined cases: a null or empty text has no features and gets a score from the votes alone; without labelled rows of
both classes no voter speaks and every score is the prior; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import pieces, slices, stored, texts, tidy

_TRIM = ".,;:!?|\"'()[]{}<>*%-_"
_LONG_RUN = re.compile(r"(\w)\1{3,}")
BEGINNINGS = (4, 5, 6, 7, 8)
#: Common insults in the languages served, a voter that owes nothing to the labels.
INSULTS = (
    "asshole", "bastard", "bitch", "cretin", "dickhead", "disgusting", "dumbass", "filth", "freak", "garbage", "hate", "idiot", "imbecile", "loser", "lowlife", "moron", "pathetic", "scum", "shithead", "stupid", "trash", "vermin", "worthless",
    "abschaum", "arschloch", "blödmann", "depp", "dummkopf", "dreckskerl", "hurensohn", "trottel", "vollidiot",
    "basura", "cabrón", "cretino", "escoria", "estúpido", "gilipollas", "idiota", "imbécil", "pendejo",
    "abruti", "connard", "crétin", "débile", "enfoiré", "ordure", "salaud", "stupide",
)
PATTERNS = ("shouted", "exclaimed", "stretched", "digits", "lines")


def features(text: str) -> set[str]:
    """Words (w), and beginnings of longer words, of each length in ``BEGINNINGS``."""
    out = set()
    for word in set(text.lower().split()):
        if word := word.strip(_TRIM):
            out.add("w" + word)
            for k in BEGINNINGS:
                if len(word) <= k:
                    break
                out.add(f"{k}{word[:k]}")
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _changed(codes: np.ndarray, other: str) -> int:
    """How many characters a change of case changes; a length that changes too counts by the shorter."""
    mapped = _codes(other)
    n = min(len(codes), len(mapped))
    return int((codes[:n] != mapped[:n]).sum())


def pattern_votes(text: str) -> list[int]:
    """One vote of each of ``PATTERNS`` over the whole text: 1 toxic, 0 abstains."""
    n, codes = max(len(text), 1), _codes(text)
    upper, lower = _changed(codes, text.lower()), _changed(codes, text.upper())
    return [
        int(upper > lower and n > 20),
        int(text.count("!") > 0.02 * n),
        int(bool(_LONG_RUN.search(text))),
        int(((codes >= 48) & (codes <= 57)).sum() > 0.2 * n),
        int(text.count("\n") > 0.1 * n),
    ]


@dataclass
class Model:
    lexicons: list[set[str]] = field(default_factory=list)
    lexicon_of: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    vote_weights: list[float] = field(default_factory=list)
    bias: float = -3.0

    def known(self, text: str) -> set[str]:
        """The text's features that the lexicons or the classifier know; most words need one look-up."""
        if not hasattr(self, "heads"):
            self.terms = self.lexicon_of.keys() | self.weights.keys()
            self.heads = {x[1 : BEGINNINGS[0] + 1] for x in self.terms if x[0] != "w"}
            self.whole = {x[1:] for x in self.terms if x[0] == "w"}
        out = set()
        for word in set(text.lower().split()):
            word = word.strip(_TRIM)
            if word in self.whole:
                out.add("w" + word)
            if word[: BEGINNINGS[0]] in self.heads:
                out.update(x for k in BEGINNINGS if len(word) > k and (x := f"{k}{word[:k]}") in self.terms)
        return out

    def votes(self, text: str, found: set[str]) -> list[int]:
        """Lexicons vote toxic on a hit; where none of them hits, the last voter votes clean."""
        hit = [0] * len(self.lexicons)
        for x in found & self.lexicon_of.keys():
            hit[self.lexicon_of[x]] = 1
        return [*hit, *pattern_votes(text), 0 if any(hit) else -1]

    def score(self, text: str) -> float:
        found = self.known(text)
        z = self.bias + sum([self.weights[x] for x in found & self.weights.keys()])
        z += sum(w * v for w, v in zip(self.vote_weights, self.votes(text, found), strict=False))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _tree(information: np.ndarray) -> np.ndarray:
    """Parent of each voter in the tree of the greatest total information, -1 for the root, the last voter."""
    m = len(information)
    parent, best = np.full(m, m - 1), information[m - 1].copy()
    inside = np.zeros(m, bool)
    inside[m - 1], parent[m - 1] = True, -1
    for _ in range(m - 1):
        i = int(np.where(inside, -np.inf, best).argmax())
        inside[i] = True
        nearer = ~inside & (information[i] > best)
        best[nearer], parent[nearer] = information[i][nearer], i
    return parent


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Posterior of toxic for each row of ``votes`` (-1, 0, 1; the last is the given label), and the estimates.

    A generative model with correlations: given the class, voters form a tree in which each vote depends on one
    other voter's, the one that tells most about it within the classes. Expectation maximisation estimates the
    tree, its tables and the class share together; the given label only says where it begins. A voter that
    repeats another is certain once that one is known, and so adds no evidence.
    """
    n, m = votes.shape
    post = np.clip((votes[:, -1] + 1) / 2, 0.02, 0.98)
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float).reshape(n, 3 * m)
    level, voter = votes.astype(int) + 1, np.arange(m)
    parent = np.full(m, -1)
    for k in range(rounds):
        shares, pairs, information = [], [], np.zeros((m, m))
        for q in (1 - post, post):
            c = q * counts
            joint = (hot.T @ (hot * c[:, None])).reshape(m, 3, m, 3) + 0.5 / 3
            joint /= joint.sum((1, 3), keepdims=True)
            alone = np.einsum("iaia->ia", joint)
            alone = (alone + 1e-9) / (alone + 1e-9).sum(1, keepdims=True)
            gain = joint * np.log(joint / (joint.sum(3)[:, :, :, None] * joint.sum(1)[:, None, :, :]))
            information += c.sum() / counts.sum() * gain.sum((1, 3))
            shares.append(np.stack([((votes == v) * c[:, None]).sum(0) + 0.5 for v in (-1, 0, 1)], axis=1))
            pairs.append(joint)
        if k < 20:  # then the tree stays, and the estimates settle
            parent = _tree((information + information.T) / 2)
        logs = []
        for share, joint in zip(shares, pairs, strict=True):
            own = np.log(share / share.sum(1, keepdims=True))[voter, level]
            given = joint[voter, :, parent, :]
            given = np.log(given / given.sum(1, keepdims=True))[voter, level, level[:, parent]]
            logs.append(np.where(parent >= 0, given, own))
        prior = np.clip((post * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4)
        odds = np.log(prior / (1 - prior)) + (logs[1] - logs[0]).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        moved = np.abs(new - post).max()
        post = new
        if k >= 20 and moved < 1e-6:
            break
    evidence = (np.abs(logs[1] - logs[0]) * counts[:, None]).sum(0) / counts.sum()
    centred = np.zeros((m, m))
    for q in (1 - post, post):
        c = q * counts
        d = votes - (votes * c[:, None]).sum(0) / max(c.sum(), 1e-9)
        centred += (d * c[:, None]).T @ d
    spread = np.sqrt(np.diag(centred)) + 1e-9
    right = [((votes == s) * (q * counts)[:, None]).sum(0) for s, q in ((1, post), (-1, 1 - post))]
    spoken = ((votes != 0) * counts[:, None]).sum(0)
    return post, {"accuracy": (right[0] + right[1]) / np.maximum(spoken, 1e-9), "correlation": centred / np.outer(spread, spread), "parent": parent, "evidence": evidence}


def _feature_rows(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            labels = batch.column("label").to_pylist()
            found = [sorted(features(x)) for x in texts(batch, text_col)]
            yield pa.RecordBatch.from_pydict({"feature": pa.array([x for own in found for x in own], pa.string()), "label": pa.array([y for y, own in zip(labels, found, strict=True) for _ in own], pa.int32())})

    return run


def _vote_rows(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            rows = [model.value.votes(x, model.value.known(x)) + [2 * y - 1] for x, y in zip(texts(batch, text_col), batch.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"votes": pa.array([",".join(map(str, r)) for r in rows], pa.string())})

    return run


def _training_rows(model, posterior, index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, size = index.value, len(index.value)
        for batch in pieces(batches, text_col):
            out: dict[str, list] = {"label": [], "weight": [], "at": [], "values": []}
            for x, y in zip(texts(batch, text_col), batch.column("label").to_pylist(), strict=True):
                found = model.value.known(x)
                votes = model.value.votes(x, found)
                p = posterior.value[",".join(map(str, [*votes, 2 * y - 1]))]
                own = [(place[f], 1.0) for f in found & place.keys()] + [(size + k, float(v)) for k, v in enumerate(votes) if v]
                own.sort()
                for label, weight in ((1.0, p), (0.0, 1 - p)):
                    if weight > 1e-3:
                        out["label"].append(label)
                        out["weight"].append(weight)
                        out["at"].append([a for a, _ in own])
                        out["values"].append([v for _, v in own])
            yield pa.RecordBatch.from_pydict({"label": pa.array(out["label"], pa.float64()), "weight": pa.array(out["weight"], pa.float64()), "at": pa.array(out["at"], pa.list_(pa.int32())), "values": pa.array(out["values"], pa.list_(pa.float64()))})

    return run


def fit(labelled: DataFrame, *, max_rows: int = 20_000, least_odds: float = 2.0, least_ratio: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from rows (id, text, label 0/1), at most about ``max_rows`` of them by a hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import VectorUDT

    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    n = rows.select("id").count()
    share = min(1.0, max_rows / max(n, 1))
    sample = stored(rows.where(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1_000_000)) < share * 1_000_000).drop("id"), "labelled")
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = total.get(0, 0), total.get(1, 0)
    if not good or not bad:
        share = (bad + 0.5) / (good + bad + 1)
        return Model(bias=math.log(share / (1 - share)))
    seen = sample.mapInArrow(tidy(_feature_rows("text")), "feature string, label int").groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    # toxic features: much commoner in toxic rows, by more than chance leaves among so many (likelihood ratio)
    seen = stored(seen, "features")
    least_ratio = 2 * math.log(max(seen.count(), 2)) if least_ratio is None else least_ratio
    base = bad / (good + bad)
    k, n_k = F.col("k"), F.col("n") - F.col("k")
    odds = F.log((k + 0.5) / (bad + 1)) - F.log((n_k + 0.5) / (good + 1))
    ratio = 2 * (k * F.log(F.greatest(k, F.lit(1)) / (F.col("n") * base)) + n_k * F.log(F.greatest(n_k, F.lit(1)) / (F.col("n") * (1 - base))))
    strong = seen.select("feature", odds.alias("odds"), ratio.alias("ratio")).where(f"odds > {least_odds} AND ratio > {least_ratio}")
    strong = strong.collect()

    # lexicons: toxic features by kind and by strength, each strength dealt to two voters
    strong.sort(key=lambda r: (-r["odds"], r["feature"]))
    common = {"w" + x for x in INSULTS}
    model = Model(lexicons=[common], lexicon_of=dict.fromkeys(common, 0))
    for kind in ("w", *map(str, BEGINNINGS)):
        own = [r["feature"] for r in strong if r["feature"][0] == kind and r["feature"] not in common]
        third = -(-len(own) // 3) or 1
        for begin in range(0, len(own), third):
            for parity in (0, 1):
                if part := set(own[begin : begin + third][parity::2]):
                    model.lexicon_of |= dict.fromkeys(part, len(model.lexicons))
                    model.lexicons.append(part)
    shared = spark.sparkContext.broadcast(model)
    patterns = sample.mapInArrow(tidy(_vote_rows(shared, "text")), "votes string").groupBy("votes").count().collect()
    votes = np.array([[int(x) for x in r["votes"].split(",")] for r in patterns])
    post, _ = label_model(votes, np.array([r["count"] for r in patterns], float))
    posterior = spark.sparkContext.broadcast({r["votes"]: float(p) for r, p in zip(patterns, post, strict=True)})

    names = sorted(r["feature"] for r in strong)
    index = spark.sparkContext.broadcast({x: k for k, x in enumerate(names)})
    width = len(names) + votes.shape[1] - 1
    training = sample.mapInArrow(tidy(_training_rows(shared, posterior, index, "text")), "label double, weight double, at array<int>, values array<double>")
    # sparse vectors as Spark keeps them in files, read back as such: a function for them would take a second Python worker beside each of the first, and all live on
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), F.col("at").alias("indices"), "values")
    training = stored(training.select("label", "weight", sparse.alias("features")), "training")
    training = spark.read.schema(StructType([*training.schema.fields[:2], StructField("features", VectorUDT())])).parquet(training.scratch_path)
    fitted = LogisticRegression(weightCol="weight", regParam=3e-5, maxIter=100, standardization=False).fit(training)
    c = fitted.coefficients.toArray()
    model.weights = {x: float(w) for x, w in zip(names, c[: len(names)], strict=True) if w}
    model.vote_weights = [float(w) for w in c[len(names) :]]
    model.bias = float(fitted.intercept)
    return model


def _scores(model, place: int):
    """``place`` is where the text stands in the struct ``row``: it travels once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            rows = batch.column("row")
            own = rows.field(place)
            for a, b in slices(batch, own):
                scores = [m.score(x or "") for x in own.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.slice(a, b - a), pa.array(scores, pa.float64())], names=["row", "score"])

    return run


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Rows (row, score): all columns of ``docs`` in a struct, and 0 to 1, the higher the likelier toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return rows.mapInArrow(tidy(_scores(shared, docs.columns.index(text_col))), StructType([rows.schema["row"], StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out; a document's label counts once."""
    known = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(docs.select("doc_id", "text").join(known, "doc_id"), **options)
