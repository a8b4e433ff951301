"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are mined from training labels: whole words (lexicon) and word beginnings of three to six letters (patterns) that
toxic documents have far more often than others (a likelihood ratio test, its level set by the number of candidates).
What counts for a voter are the different contexts (words before and after) in which toxic documents have it, so that
copies of one document, exact or near, are no evidence for all of its words. Of voters with the same first letters the
one with the best ratio stands for the others.
The label model is a two-class latent model, fitted by expectation maximisation on the votes of all documents that are
not held out, labelled or not (equal texts once), with the counts of labelled ones held fixed: the share of either class,
its chance that any voter fires, for each voter its rate in either class (its accuracy). Correlations of voters are
estimated pair by pair inside the toxic class: of the pairs that fire together more often than two independent voters
would (a likelihood ratio test, its level set by the number of pairs), how much likelier the one is where the other
fires. Correlated voters share a voice. Rounds and correlations follow each other until the last rounds.
Its posteriors are the labels of a logistic regression over votes and hashed word frequencies of the text, trained on
the labelled sample and on a bounded sample of texts without a label, on the posteriors of both.

Scale: two passes over texts, without a shuffle of them. Votes leave the first as patterns (numbers of the voters that
fired) with counts; a round of the label model is one pass over the table of patterns, summed in two levels in vectors
of one number a voter; pairs are counted on executors, and only one number a voter comes back. The samples that train the
classifier have bounds; nothing else has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .importance import labelled_sample
from .kernels import hash_words, text_buffer

#: Labelled rows used at most, and beginnings of words tried as patterns.
LABELLED, BEGINNINGS = 20_000, (3, 4, 5, 6)
#: Texts without a label that the classifier is trained on at most, besides the labelled sample (the smallest hashes of doc_id).
UNLABELLED = 10_000
#: Toxic training documents that a voter has at least, and the least share of toxic ones among the documents that have it.
SUPPORT, PRECISION = 3, 0.9
#: Rounds of the label model, hashed word features, tasks added up in one group.
ROUNDS, HASHED, _TASKS = 12, 512, 256
#: Times that correlations are estimated, pairs of voters that are counted at once, and rows of the classifier in one block.
STRUCTURES, _PAIRS, _BLOCK = 2, 1 << 21, 2048


def marks(text: str) -> set[str]:
    """Candidate voters in a text: "=word" and "^beginning" of its words (letters, lower case)."""
    words = set("".join(c if c.isalpha() else " " for c in text.lower()).split())
    return {f"={w}" for w in words} | {f"^{w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and in how many other texts each mark is."""
    bad: Counter[str] = Counter()
    good: Counter[str] = Counter()
    for b in batches:
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            (bad if label == 1 else good).update(marks(text or ""))
    every = list({**bad, **good})
    yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([bad[x] for x in every], pa.int64()), pa.array([good[x] for x in every], pa.int64())], names=["mark", "a", "b"])


@lru_cache(2)
def _automaton(voters: tuple[str, ...]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    by_text: dict[str, list[int]] = {}
    for i, v in enumerate(voters):
        by_text.setdefault(v[1:], []).append(i)
    for text, which in by_text.items():
        out.add_word(text, (len(text), [(i, voters[i][0] == "=") for i in which]))
    out.make_automaton()
    return out


def votes(texts: list[str | None], voters: tuple[str, ...]) -> list[list[int]]:
    """For each text the numbers of the voters that fire, ascending."""
    if not voters:
        return [[] for _ in texts]
    machine, out = _automaton(voters), []
    for text in texts:
        low, fired = (text or "").lower(), set()
        for end, (size, which) in machine.iter(low):
            at = end - size + 1
            if at and low[at - 1].isalpha():
                continue
            more = end + 1 < len(low) and low[end + 1].isalpha()
            fired.update(i for i, whole in which if more != whole)
        out.append(sorted(fired))
    return out


def _contexts(batches: Iterator[pa.RecordBatch], voters: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """(voter, context) for each place where a voter fires: a hash of the word before and the word after it."""
    number = {v: i for i, v in enumerate(voters)}
    for b in batches:
        found = set()
        for text in b.column("text").to_pylist():
            words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
            for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                for i in (number.get(f"={w}"), *(number.get(f"^{w[:k]}") for k in BEGINNINGS if len(w) > k)):
                    if i is not None:
                        found.add((i, xxhash.xxh3_64_intdigest(f"{before} {after}") >> 1))
        voter, context = zip(*sorted(found), strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(voter, pa.int32()), pa.array(context, pa.int64())], names=["voter", "context"])


def _distinct(mined: list[tuple[str, int, int]], share: float) -> list[tuple[str, int, int]]:
    """Of marks (mark, a, b) that begin alike, the one with the best ratio (then the most toxic documents, the shortest, whole words first)."""
    best: dict[str, None] = {}
    out = []
    for mark, a, b in sorted(mined, key=lambda x: (-ratio(x[1], x[2], share), -x[1], len(x[0]), x[0][0] == "^", x[0])):
        text = mark[1:]
        if not any(text[:k] in best for k in range(1, len(text) + 1)) and not any(x.startswith(text) for x in best):
            best[text] = None
            out.append((mark, a, b))
    return sorted(out)


def ratio(a: float, b: float, share: float) -> float:
    """Twice the log likelihood ratio of a mark in a toxic and b other documents, where a share of documents is toxic."""
    return 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0.0)) if a else 0.0


@dataclass
class LabelModel:
    """For either class (other, toxic): its share, the chance that any voter fires, and each voter's rate where some do; and voters' voices.

    Which of several languages' voters are silent says nothing, so silence counts only where all are.
    """

    share: np.ndarray
    some: np.ndarray
    rate: np.ndarray
    voice: np.ndarray

    def logits(self, voter: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Log odds of toxic for n rows, voter[i] having fired in row[i]; what fires counts as one voice at least."""
        voices = np.bincount(row, weights=self.voice[voter], minlength=n)
        heard = np.bincount(row, weights=(self.voice * np.log(self.rate[1] / self.rate[0]))[voter], minlength=n) / np.where(voices > 0, np.minimum(1, voices), 1)
        some, none = (np.log(x[1] / x[0]) for x in (self.some, 1 - self.some))
        return np.log(self.share[1] / self.share[0]) + np.where(voices > 0, some + heard, none)

    def posterior(self, voter: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(voter, row, n), -30, 30)))


def _flat(patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Voters of all patterns in one array, and the row of each."""
    voter = np.frombuffer(b"".join(patterns), "<u4").astype(np.int64)
    return voter, np.repeat(np.arange(len(patterns)), [len(x) // 4 for x in patterns])


def expected(post: np.ndarray, voter: np.ndarray, row: np.ndarray, n: np.ndarray, m: int) -> np.ndarray:
    """Sums over documents (row i stands for n[i] of them, toxic with chance post[i]) that the next model needs.

    All, toxic, those with a vote, toxic ones with a vote, toxic x votes; then for each of m voters fired, fired and
    toxic, fired x toxic x votes.
    """
    toxic, cast = n * post, np.bincount(row, minlength=len(n))
    each = [np.bincount(voter, weights=w[row], minlength=m) for w in (n.astype(float), toxic, toxic * cast)]
    return np.concatenate([[n.sum(), toxic.sum(), n[cast > 0].sum(), toxic[cast > 0].sum(), (toxic * cast).sum()], *each])


def improved(sums: np.ndarray, voice: np.ndarray | None = None) -> LabelModel:
    """The model of expected counts; without given voices, one over one more than the votes that come with a voter beyond the usual."""
    n, toxic, some, some_toxic, cast = sums[:5]
    fired, fired_toxic, fired_cast = sums[5:].reshape(3, -1)
    usual = (fired + 1e-3) / (some + 1)
    rate = np.stack([(fired - fired_toxic + 2 * usual) / (some - some_toxic + 2), (fired_toxic + 2 * usual) / (some_toxic + 2)]).clip(1e-9, 1)
    any_ = np.array([(some - some_toxic + 0.5) / (n - toxic + 1), (some_toxic + 0.5) / (toxic + 1)]).clip(1e-9, 1 - 1e-6)
    share = float(np.clip(toxic / max(n, 1), 1e-5, 0.9))
    more = fired_cast / np.maximum(fired_toxic, 1e-9) - 1 - (cast - fired_toxic) / max(some_toxic, 1e-9)
    return LabelModel(np.array([1 - share, share]), any_, rate, 1 / (1 + np.maximum(0, more)) if voice is None else voice)


def _expected(batches: Iterator[pa.RecordBatch], model: LabelModel) -> Iterator[pa.RecordBatch]:
    m = len(model.voice)
    total = np.zeros(5 + 3 * m)
    for b in batches:
        for k in range(0, b.num_rows, 4096):
            some = b.slice(k, 4096)
            voter, row = _flat(some.column("votes").to_pylist())
            total += expected(model.posterior(voter, row, some.num_rows), voter, row, some.column("n").to_numpy(), m)
    yield _sums(TaskContext.get().partitionId() // _TASKS, total)


def _sums(tasks: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([tasks], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())], names=["tasks", "sums"])


def _add(rows: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x, "<f8") for x in rows.column("sums").to_pylist()], axis=0)
    return pa.Table.from_batches([_sums(rows.column("tasks")[0].as_py(), total)])


def label_model(patterns: DataFrame, known: np.ndarray, rounds: int = ROUNDS, start: LabelModel | None = None) -> LabelModel:
    """The label model fitted to patterns(votes binary, n long), a written table, and to the expected counts `known` of labelled documents.

    Without the known ones the two classes could become those of two languages' voters. start: the model to go on from,
    whose voices stay.
    """
    model, kind, voice = start or improved(known), "tasks int, sums binary", start.voice if start else None
    for _ in range(rounds):
        parts = patterns.mapInArrow(partial(_expected, model=model), kind).groupBy("tasks").applyInArrow(lambda x: _add(x), kind)
        got = [np.frombuffer(r["sums"], "<f8") for r in parts.sort("tasks").collect()]  # a row for 256 tasks
        model = improved(np.sum([known, *got], axis=0), voice)
    return model


def paired(voter: np.ndarray, size: np.ndarray, weight: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys a * m + b of voters a <= b, summed weights) of all pairs inside rows; row i has the next size[i] of voter, ascending."""
    first = np.repeat(np.cumsum(size) - size, size)
    left = np.arange(len(voter))
    count = first + np.repeat(size, size) - left  # partners from the voter itself to the row's last
    right = np.repeat(left - (np.cumsum(count) - count), count) + np.arange(count.sum())
    key, at = np.unique(np.repeat(voter, count) * m + voter[right], return_inverse=True)
    return key, np.bincount(at, weights=np.repeat(np.repeat(weight, size), count), minlength=len(key))


def _pair_sums(batches: Iterator[pa.RecordBatch], model: LabelModel) -> Iterator[pa.RecordBatch]:
    """(a, b, n): toxic documents expected to have voters a and b; a = b: one voter, -1: any."""
    m, some = len(model.voice), 0.0
    keys, sums = np.zeros(0, np.int64), np.zeros(0)
    for b in batches:
        patterns = b.column("votes").to_pylist()
        cost = np.cumsum([(len(x) // 4) ** 2 for x in patterns])
        cuts = [0, *(np.flatnonzero(np.diff(cost // _PAIRS)) + 1), len(patterns)]
        for i, j in zip(cuts, cuts[1:], strict=False):  # a few million pairs at once
            voter, row = _flat(patterns[i:j])
            size = np.bincount(row, minlength=j - i)
            toxic = model.posterior(voter, row, j - i) * b.column("n").to_numpy()[i:j]
            some += toxic[size > 0].sum()
            key, n = paired(voter, size, toxic, m)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([sums, n]), minlength=len(keys))
    a, b = np.append(keys // max(m, 1), -1), np.append(keys % max(m, 1), -1)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(np.append(sums, some), pa.float64())], names=["a", "b", "n"])


def correlations(patterns: DataFrame, model: LabelModel) -> DataFrame:
    """(a, b, given_a, given_b) of voters a < b that depend on each other where a document is toxic: how much likelier b is where a fires, and a where b does.

    Only pairs that fire together more than independent ones would, by the test; nulls and empty patterns have no pair.
    """
    sums = patterns.mapInArrow(partial(_pair_sums, model=model), "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "toxic-pairs")
    some = (sums.where("a = -1").agg(F.sum("n")).first()[0] or 0.0) + 1e-9
    own = F.broadcast(sums.where("a = b and a >= 0").select(F.col("a").alias("v"), F.col("n").alias("own")))  # a row a voter
    pairs = sums.where("a < b and a >= 0")
    level = 2 * float(np.log(max(2, pairs.count())))
    pairs = pairs.join(own.withColumnsRenamed({"v": "a", "own": "n_a"}), "a").join(own.withColumnsRenamed({"v": "b", "own": "n_b"}), "b")
    due = F.col("n_a") * F.col("n_b") / F.lit(some)
    excess = 2 * (F.col("n") * F.log(F.col("n") / due) - (F.col("n") - due))
    dependent = pairs.where((F.col("n") > due) & (due > 0) & (excess >= level))
    return dependent.select("a", "b", (F.col("n") / F.col("n_a") - F.col("n_b") / F.lit(some)).alias("given_a"), (F.col("n") / F.col("n_b") - F.col("n_a") / F.lit(some)).alias("given_b"))


def voices(dependent: DataFrame, m: int) -> np.ndarray:
    """Each voter's voice: one over one more than what its correlated voters are likelier where it fires."""
    each = dependent.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("given_a").alias("more")), F.struct(F.col("b").alias("v"), F.col("given_b").alias("more")))).alias("x"))
    out = np.ones(m)
    for r in each.groupBy("x.v").agg(F.sum("x.more").alias("more")).collect():  # at most a row a voter
        out[r["v"]] = 1 / (1 + max(0.0, r["more"]))
    return out


def correlated_model(patterns: DataFrame, known: np.ndarray, rounds: int = ROUNDS, structures: int = STRUCTURES) -> LabelModel:
    """The label model with pairwise correlations: half of the rounds with voices by all votes, the rest with those of correlated pairs."""
    model = label_model(patterns, known, rounds - rounds // 2)
    for _ in range(structures):
        found = voices(correlations(patterns, model), len(model.voice))
        model = label_model(patterns, known, max(1, rounds // 2 // structures), LabelModel(model.share, model.some, model.rate, found))
    return model


def linear_classifier(x: np.ndarray, target: np.ndarray, n_votes: int, decay: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the first n_votes features (votes) only add to the score."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), decay * len(x))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        grad, curve = ridge * w, np.diag(ridge)
        for k in range(0, len(x), _BLOCK):
            some = np.column_stack([x[k : k + _BLOCK], np.ones(len(x[k : k + _BLOCK]))]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(some @ w, -30, 30)))
            grad += some.T @ (p - target[k : k + _BLOCK])
            curve += (some * (p * (1 - p) + 1e-6)[:, None]).T @ some
        step = np.linalg.solve(curve, grad)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        w = w - step
        w[:n_votes] = np.maximum(w[:n_votes], 0)
        if np.abs(step).max() < 1e-5:
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    """Voters, and the linear classifier over their votes, whether any fired, and hashed word frequencies."""

    voters: tuple[str, ...]
    weights: np.ndarray
    bias: float

    def logits(self, column: pa.Array) -> np.ndarray:
        m, n = len(self.voters), len(column)
        patterns = votes(column.to_pylist(), self.voters)
        z = np.array([self.weights[p].sum() + (self.weights[m] if p else 0) for p in patterns], float)
        bucket, own, size = _hashed(column)
        return z + self.bias + np.bincount(own, weights=self.weights[m + 1 :][bucket], minlength=n) / np.maximum(1, size)


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text's index) of each word (A-Z as a-z), and the words of each text."""
    w = hash_words(*text_buffer(column), lower=True)
    return (w.hash % np.uint64(HASHED)).astype(np.int64), w.owner, np.diff(w.first)


def training(doc_id: Column) -> Column:
    """Rows from which labels may be learnt: crc32 of doc_id as text modulo 5 is not 0."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 5 != 0


def _vote(batches: Iterator[pa.RecordBatch], voters: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            fired = [np.array(x, "<u4").tobytes() for x in votes(b.column("text").slice(k, 512).to_pylist(), voters)]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.binary()), b.column("key").slice(k, 512)], names=["votes", "key"])


def _train(batches: Iterator[pa.RecordBatch], voters: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Label, votes and word frequencies (32-bit floats) of the rows that train the classifier."""
    for b in batches:
        for k in range(0, b.num_rows, 512):
            texts = b.column("text").slice(k, 512)
            fired = [np.array(x, "<u4").tobytes() for x in votes(texts.to_pylist(), voters)]
            bucket, own, size = _hashed(texts)
            words = np.zeros((len(texts), HASHED), "<f4")
            np.add.at(words, (own, bucket), 1)
            words /= np.maximum(1, size)[:, None]
            out = [b.column("label").slice(k, 512), pa.array(fired, pa.binary()), pa.array([x.tobytes() for x in words], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["label", "votes", "words"])


def _mined(rows: DataFrame, bad: int, good: int) -> list[tuple[str, int, int]]:
    """Marks that pass the tests, with their toxic and other documents; counted and tested on executors."""
    found = rows.mapInArrow(_mine, "mark string, a long, b long").groupBy("mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") >= SUPPORT)
    found = materialize(found, "toxic-marks")
    a, b, share = F.col("a"), F.col("b"), bad / (bad + good)
    level = 2 * float(np.log(max(2, found.count())))
    each = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0))
    fine = found.where((a >= PRECISION * (a + b)) & (a / bad > b / good) & (each >= level))
    able = [tuple(r) for r in fine.select("mark", "a", "b").sort("mark").collect()]  # what the tests leave of the labelled sample's words
    places = rows.where("label = 1").select("text").mapInArrow(partial(_contexts, voters=tuple(x[0] for x in able)), "voter int, context long")
    seen = {r["voter"]: r["n"] for r in places.groupBy("voter").agg(F.countDistinct("context").alias("n")).collect()}
    able = [(m, min(x, seen.get(i, 0)), y) for i, (m, x, y) in enumerate(able)]
    return _distinct([x for x in able if x[1] >= max(SUPPORT, PRECISION * (x[1] + x[2])) and ratio(x[1], x[2], share) >= level], share)


def _unlabelled(plain: DataFrame, sample: DataFrame, most: int) -> DataFrame:
    """(label null, text) of at most `most` different texts of plain(doc_id, text) whose doc_id is not in the sample, by the hash of their smallest doc_id."""
    ids = plain.groupBy(F.xxhash64("text").alias("key")).agg(F.min("doc_id").alias("doc_id")).join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti")
    ids = materialize(ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "toxic-unlabelled")
    rows = plain.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    return rows.select(F.lit(None).cast("int").alias("label"), "text")


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED, unlabelled: int = UNLABELLED) -> Model:
    """Learn from labels(doc_id, toxic) of training rows, at most `most` (the smallest hashes), and from the votes of all training rows.

    The classifier learns the label model's posteriors of the labelled sample and of at most `unlabelled` other texts.

    Without labels of both kinds no voter is found.
    """
    ship(docs.sparkSession)
    sample = materialize(labelled_sample(labels, "toxic", most, training(F.col("doc_id"))), "toxic-sample")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.coalesce(training(F.col("doc_id")), F.lit(False)))
    rows = plain.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.max("text").alias("text"))  # a repeated doc_id counts once
    rows = materialize(rows.select("label", "text"), "toxic-training")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    mined = _mined(rows, bad, good) if bad and good else []
    if not mined:
        return Model((), np.zeros(1 + HASHED), -5.0)
    voters, m = tuple(x[0] for x in mined), len(mined)
    taught = rows.unionByName(_unlabelled(plain, sample, unlabelled))
    seen = taught.mapInArrow(partial(_train, voters=voters), "label int, votes binary, words binary").toArrow()  # at most `most` + `unlabelled` rows
    n, label = seen.num_rows, seen.column("label").to_numpy()
    patterns = seen.column("votes").to_pylist()
    x = np.zeros((n, m + 1 + HASHED), "<f4")
    at = 0
    for words in seen.column("words").chunks:  # no copy of the sample's largest column
        x[at : at + len(words), m + 1 :] = [np.frombuffer(w.as_buffer(), "<f4") for w in words]
        at += len(words)
    del seen
    told = np.flatnonzero(~np.isnan(label))
    voter, row = _flat([patterns[i] for i in told])
    known = expected(label[told].astype(float), voter, row, np.ones(len(told)), m)
    fired = plain.select("text", F.xxhash64("text").alias("key")).mapInArrow(partial(_vote, voters=voters), "votes binary, key long")
    table = fired.groupBy("key").agg(F.first("votes").alias("votes")).groupBy("votes").agg(F.count("*").alias("n"))  # equal texts, equal votes
    model = correlated_model(materialize(table, "toxic-votes"), known)
    voter, row = _flat(patterns)
    x[row, voter] = 1
    x[:, m] = x[:, :m].any(axis=1)
    weights, bias = linear_classifier(x, model.posterior(voter, row, n), m + 1)
    return Model(voters, weights, bias)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            some = b.slice(k, 512)
            z = model.logits(some.column("text"))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9))], names=["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id long, text string, ...).

    Null or empty text: no vote and no word, the score of the bias alone. Repeated rows: equal scores; in the labelled
    sample a doc_id counts once. A null doc_id stays null, is held out from nothing (false), and teaches nothing. Labels
    twice: the larger one. No labels of one kind: all scores low. Other columns are not read. An empty table gives no row;
    a text of any length is scored whole.
    """
    model = fit(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(partial(_score, model=model), "doc_id long, score double")
    held = F.coalesce(~training(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
