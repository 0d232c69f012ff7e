"""Word-first language identification with backoff to character n-grams.

A word seen in training gives its log frequency in each language.  An unseen
word is scored by its longest character n-grams that training knows: n is
shortened until at least one n-gram of that length is known.

Training reads a bounded sample (``max_train_docs``, chosen by a hash of the
id) of the labelled rows; counting is done by Spark, and every word and
n-gram whose count in a language reaches ``min_count`` is kept, so what the
sample's bound allows is all that the broadcast model can hold.

Defined results: null text or text without a letter gives ``und`` and score
0; without any training rows every row gives ``und``.  Repeated rows are
each predicted; ties go to the language that sorts first; null languages are
never learned; a very long text is counted whole; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, frugal, of_worker, slices, texts

UNKNOWN = "und"
LONGEST = 4
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (size 0) and of n-grams; n-grams are counted once for each distinct word of a flush."""
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        counts: Counter = Counter()
        for (lang, word), n in found.items():
            counts[0, lang, word] += n
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    counts[size, lang, g] += n
        found.clear()
        rows = list(counts.items())
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
            names=["size", "lang", "item", "n"],
        )

    for part in (p for b in batches for p in slices(b)):
        for text, lang in zip(texts(part), part.column("lang").to_pylist(), strict=True):
            for word, n in Counter(words(text)).items():
                found[lang, word] += n
        if len(found) > 100_000:
            yield flush()
    if found:
        yield flush()


class Model:
    """Log frequencies by language of words (size 0) and n-grams: ``rows[size][item]`` is a row of ``tables[size]``."""

    def __init__(self, rows: list[tuple[int, str, str, int]]):
        import numpy as np

        self.langs = sorted({lang for _, lang, _, _ in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.rows: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for size, _, item, _ in rows:
            self.rows[size].setdefault(item, len(self.rows[size]))
        counts = [np.zeros((len(found), len(self.langs))) for found in self.rows]
        for size, lang, item, n in rows:
            counts[size][self.rows[size][item], at[lang]] += n
        self.tables = [np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n) + 1)) for n in counts]
        for edge in "<>":  # the edge of a word alone tells nothing
            self.rows[1].pop(edge, None)

    @property
    def items(self) -> list[dict[str, list[float]]]:
        """By size, the log frequencies of each item."""
        return [{item: table[row].tolist() for item, row in found.items()} for found, table in zip(self.rows, self.tables, strict=True)]

    def evidence(self, words: list[str]):
        """A row of scores by language for each word, and whether even one of its characters is known."""
        import numpy as np

        scores, known = np.zeros((len(words), len(self.langs))), np.zeros(len(words), bool)
        left = range(len(words))
        for size in (0, *range(LONGEST, 0, -1)):
            rows, of, sizes, at, still = self.rows[size], [], [], [], []
            for i in left:
                found = [r for g in (grams(words[i], size) if size else (words[i],)) if (r := rows.get(g)) is not None]
                if found:
                    of.append(i)
                    sizes.append(len(found))
                    at += found
                else:
                    still.append(i)
            if of:
                begins = np.cumsum([0, *sizes[:-1]])
                scores[of] = np.add.reduceat(self.tables[size][at], begins) / np.array(sizes)[:, None]
                known[of] = True
            left = still
        return scores, known

    def word_scores(self, word: str) -> list[float] | None:
        """By language; None if not even one of its characters is known."""
        scores, known = self.evidence([word])
        return scores[0].tolist() if known[0] else None


def train(labelled: DataFrame, max_train_docs: int = 12_000, min_count: int = 3) -> Model:
    """From text and lang of a bounded sample; rows with a null in either are left out."""
    usable = labelled.where("text is not null and lang is not null").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    sample = bounded_sample(usable, "doc_id", max_train_docs)
    counts = sample.mapInArrow(frugal(_count), "size int, lang string, item string, n long").groupBy("size", "lang", "item").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counts.where(F.col("n") >= min_count).collect()])


class Predictor:
    """Predicts in one Python worker; remembers up to about ``most`` words of up to 64 characters as rows of a table."""

    def __init__(self, model: Model, most: int = 600_000):
        self._model, self._most = model, most
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self._row: dict[str, int] = {}
        self._table = np.zeros((1, len(self._model.langs)))  # row 0: none of its characters is known

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and its posterior for each text, by the mean evidence of a word and at most as if of 20 words."""
        import numpy as np

        if not self._model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self._row) > self._most:
            self._forget()
        split = [words(t) for t in texts]
        new = sorted(set().union(*split).difference(self._row), key=lambda w: len(w) > 64)
        scores, known = self._model.evidence(new)
        first = len(self._table)
        self._table = np.concatenate([self._table, scores])
        self._row.update(zip(new, np.where(known, np.arange(first, first + len(new)), 0).tolist(), strict=True))
        out = [self._judge(text, own) for text, own in zip(texts, split, strict=True)]
        short = len(new)
        while short and len(new[short - 1]) > 64:
            short -= 1
            del self._row[new[short]]
        self._table = self._table[: first + short]
        return out

    def _judge(self, text: str, own: list[str]) -> tuple[str, float]:
        import numpy as np

        if not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        total, n = np.zeros(self._table.shape[1]), 0
        for start in range(0, len(own), 1 << 14):
            rows = np.array(list(map(self._row.__getitem__, own[start : start + (1 << 14)])))
            total += self._table[rows].sum(axis=0)
            n += np.count_nonzero(rows)
        best = int(total.argmax())
        scale = min(n, 20) / n if n else 0.0
        return self._model.langs[best], float(1 / np.exp(np.maximum(-700.0, scale * (total - total[best]))).sum())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row, by its text alone."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = of_worker(("language", key), lambda: Predictor(shared.value))
        for part in (p for b in batches for p in slices(b)):
            found = predictor.predict(texts(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")
