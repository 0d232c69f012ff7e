"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and the beginnings of its longer words, hashed.
The machine adds to the weight of each term the products of the terms'
factor vectors, so that pairs such as an insult and the mention of a group
count beyond what both count alone.

It is fitted on the driver to a bounded sample of labelled rows
(``max_train_docs``, chosen by a hash of the id) with full-batch Adam.  A term
takes part if the G statistic finds it tied to the label by itself
(``least_g``), or, of terms in at least ``pair_share`` of the rows, together
with another one (``least_pair_g``: what the two tell beyond what each tells
alone), so that pure interactions are learned too.  Scoring reads whole texts.

Defined results: null and empty texts get the score of no terms; without
labelled rows, or with one label only, every score is the share of label 1
(0 without rows); rows with equal ids are each scored; labels that are null
or contradict each other for one id are resolved to the larger one; a very long
text is scored by all its terms; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, frugal, give_back, of_worker, slices, texts

#: So wide that a clean term hardly ever shares the hash of a telling one.
BITS = 31
_WORD = re.compile(r"[^\W_]+")


def terms_of(word: str) -> list[int]:
    """Hashes of a word and of its first five characters."""
    made = [f"w {word}"] + ([f"p {word[:5]}"] if len(word) > 5 else [])
    return [zlib.crc32(t.encode()) >> (32 - BITS) for t in made]


def terms(text: str) -> set[int]:
    return {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)}


@dataclass
class Machine:
    bias: float
    index: dict[int, int]
    weights: list[float]
    factors: list[list[float]]

    def score(self, rows: list[int]) -> float:
        """Of the indices of a text's terms."""
        z = self.bias + sum(self.weights[i] for i in rows)
        if len(rows) > 1:
            for f in self.factors:
                total = squares = 0.0
                for i in rows:
                    total += f[i]
                    squares += f[i] * f[i]
                z += 0.5 * (total * total - squares)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _g(n, with_1, rows: int, ones: float):
    """The G statistic of a split of ``rows`` rows, ``ones`` of label 1, by groups: n rows and with_1 of label 1 in each, groups along the first axis."""
    import numpy as np

    share, total = ones / rows, 0.0
    for seen, expected in ((with_1, n * share), (n - with_1, n * (1 - share))):
        with np.errstate(divide="ignore", invalid="ignore"):
            total = total + np.where(seen > 0.5, 2 * seen * np.log(seen / expected), 0).sum(axis=0)
    return total


def _in_pairs(row, col, y, width: int, alone, least: float, strip: int = 128, block: int = 1024):
    """Which of ``width`` terms tell of the label together with another one: 4 groups of rows by the presence of two, less what both tell alone.

    All pairs are looked at, ``strip`` terms by ``block`` others at a time.
    """
    import numpy as np

    held = np.zeros((len(y), width), np.uint8)
    held[row, col] = 1
    n, with_1, ones = np.bincount(col, minlength=width).astype(float), np.bincount(col, weights=y[row], minlength=width), y.sum()
    chosen = np.zeros(width, bool)
    for start in range(0, width, block):
        right = slice(start, min(start + block, width))
        others = held[:, right].astype(np.float32)
        for first in range(0, right.stop, strip):  # the pairs are symmetric
            left = slice(first, min(first + strip, right.stop))
            own = held[:, left].astype(np.float32)
            both, both_1 = (own.T @ others).astype(float), ((own * y[:, None].astype(np.float32)).T @ others).astype(float)
            a, a_1, b, b_1 = n[left, None], with_1[left, None], n[right], with_1[right]
            cells = np.stack([both, a - both, b - both, len(y) - a - b + both])
            cells_1 = np.stack([both_1, a_1 - both_1, b_1 - both_1, ones - a_1 - b_1 + both_1])
            hit = _g(cells, cells_1, len(y), ones) - alone[left, None] - alone[right] >= least
            hit &= np.arange(left.start, left.stop)[:, None] != np.arange(right.start, right.stop)
            chosen[left] |= hit.any(axis=1)
            chosen[right] |= hit.any(axis=0)
    return chosen


def telling(found: list, y, least_g: float, pair_share: float, least_pair_g: float):
    """The sorted terms that the machine is fitted over."""
    import numpy as np

    every, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    ids, col, n = np.unique(every, return_inverse=True, return_counts=True)
    with_1 = np.bincount(col, weights=y[owner], minlength=len(ids))
    ones = y.sum()
    g = _g(np.stack([n, len(y) - n]), np.stack([with_1, ones - with_1]), len(y), ones)
    kept = g >= least_g
    often = np.flatnonzero((n >= max(3, pair_share * len(y))) & (n <= len(y) - 3))
    place = np.full(len(ids), -1)
    place[often] = np.arange(len(often))
    inside = place[col] >= 0
    row, col = owner[inside], place[col[inside]]
    del every, owner, inside
    kept[often[_in_pairs(row, col, y, len(often), g[often], least_pair_g)]] = True
    return ids[kept]


def fit(
    found: list, labels: list[int], factors: int = 4, least_g: float = 15.0, pair_share: float = 0.02, least_pair_g: float = 60.0, steps: int = 300, penalty: float = 1e-6
) -> Machine:
    """From an array of distinct terms for each row and its label, 0 or 1."""
    import numpy as np

    y = np.array(labels, float)
    share = float(y.mean()) if len(y) else 0.0
    none = Machine(math.log(share / (1 - share)) if 0 < share < 1 else 60.0 if share else -60.0, {}, [], [])
    if not 0 < share < 1:
        return none
    kept = telling(found, y, least_g, pair_share, least_pair_g)
    if not len(kept):
        return none
    rows, cols = [], []
    for r, f in enumerate(found):
        at = np.searchsorted(kept, f)
        hit = kept[np.minimum(at, len(kept) - 1)] == f
        cols.append(at[hit])
        rows.append(np.full(int(hit.sum()), r))
    row, col = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(col, kind="stable")
    row_by_col, edges = row[order], np.searchsorted(col[order], np.arange(len(kept)))
    width = len(kept)
    rng = np.random.default_rng(7)
    w = np.concatenate([np.zeros(width), [none.bias]])
    v = rng.normal(0, 0.05, (factors, width))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(row, weights=w[col], minlength=len(y))
        sums = [np.bincount(row, weights=f[col], minlength=len(y)) for f in v]
        for f, s in zip(v, sums, strict=True):
            z += 0.5 * (s * s - np.bincount(row, weights=f[col] ** 2, minlength=len(y)))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        of_col = np.add.reduceat(error[row_by_col], edges)
        grad_w = np.concatenate([of_col + penalty * w[:-1], [error.sum()]])
        grad_v = np.stack([np.add.reduceat((error * s)[row_by_col], edges) - of_col * f for f, s in zip(v, sums, strict=True)]) + penalty * v
        for p, grad, m in ((w, grad_w, moments[0]), (v, grad_v, moments[1])):
            m[0] = 0.9 * m[0] + 0.1 * grad
            m[1] = 0.999 * m[1] + 0.001 * grad * grad
            p -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(w[-1]), {int(t): i for i, t in enumerate(kept)}, w[:-1].tolist(), v.tolist())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for part in (p for b in batches for p in slices(b)):
        made = [np.fromiter(sorted(terms(t)), np.uint32).tobytes() for t in texts(part)]
        yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(made, pa.binary())], names=["label", "terms"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train_docs: int = 8_000) -> Machine:
    """From the texts of a bounded sample of the rows in labels(doc_id, label)."""
    import numpy as np

    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = bounded_sample(marked.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", max_train_docs)
    bodies = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    # the sample's bound makes this side small whatever the input
    rows = bodies.join(F.broadcast(marked), "doc_id").select("text", "label").mapInArrow(frugal(_terms), "label int, terms binary").collect()
    found, marks = [np.frombuffer(r["terms"], np.uint32) for r in rows], [r["label"] for r in rows]
    del rows
    made = fit(found, marks)
    del found
    give_back()
    return made


class Scorer:
    """Scores texts in one worker; remembers up to ``most`` words."""

    def __init__(self, machine: Machine, most: int = 100_000):
        self._machine, self._most = machine, most
        self._known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        known, index = self._known, self._machine.index
        if len(known) > self._most:
            known.clear()
        rows: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            found = known.get(word)
            if found is None:
                found = tuple(index[t] for t in terms_of(word) if t in index)
                if len(word) <= 64:
                    known[word] = found
            if found:
                rows.update(found)
        return self._machine.score(sorted(rows))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on) for each row, by its text alone."""
    scores = _scores(docs, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            found = scores(part)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), "doc_id long, score double, predicted int")


def _scores(docs: DataFrame, machine: Machine) -> Callable[[pa.RecordBatch], list[float]]:
    shared, key = docs.sparkSession.sparkContext.broadcast(machine), uuid.uuid4().hex

    def of(batch: pa.RecordBatch) -> list[float]:
        scorer = of_worker(("toxicity", key), lambda: Scorer(shared.value))
        return [scorer.score(t) for t in texts(batch)]

    return of


def drop(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below ``threshold``."""
    scores = _scores(docs, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b)):
            yield part.filter(pa.array([x < threshold for x in scores(part)], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
