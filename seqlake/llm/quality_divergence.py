"""Quality rules by distribution divergence.

Histograms of character classes and of common words of a document are
compared to the references of every language by Jensen-Shannon distance; the
nearest language counts, so that a wrong or missing language label does not
condemn a document.  Documents too short for a stable histogram pass (the
minimum-length guards).  The allowed distance of the word histogram at
a length is ``max_word_distance`` together with the sampling error there (the
root of the sum of their squares), the ``word_quantile`` of the distances of
as many words drawn from the reference itself, but always less than the
distance of a text without any common word.

References hold the counts of all documents with a known language, however
few: Spark sums per-task counts, and common words are those with at least
``common`` of a language's words, so at most 1/common of each language.  More
than ``max_langs`` languages are refused, since references are broadcast.

Defined results: null text has no words and fails the base rules; rows with
a null language take part in no reference but get a verdict; ties and
repeated rows are judged alike; a very long text is measured whole, in one
piece; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, of_worker, slices, texts, write_shared

SYMBOLS = b"#*$%&|<>"
CLASSES = ("lower", "upper", "other_letter", "digit", "space", "punctuation", "symbol", "other")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    common: float = 0.002
    max_langs: int = 1_000
    min_chars_for_classes: int = 80
    min_words_for_words: int = 40
    max_class_distance: float = 0.25
    max_word_distance: float = 0.20
    word_quantile: float = 0.8


@dataclass
class References:
    langs: list[str] = field(default_factory=list)
    classes: list[list[float]] = field(default_factory=list)
    words: list[dict[str, float]] = field(default_factory=list)
    limits: list[list[float]] = field(default_factory=list)  # the allowed word distance at each of sizes(rules)


def sizes(rules: Rules) -> list[int]:
    """Word counts at which the sampling error of a reference is drawn; in between it is interpolated."""
    return [round(max(rules.min_words_for_words, 1) * 2 ** (k / 2)) for k in range(15)]


def _histogram(found: dict[str, float]):
    """The shares of the common words in sorted order, then that of all others."""
    import numpy as np

    return np.array([*(found[w] for w in sorted(found)), max(0.0, 1 - sum(found.values()))])


def limits(found: dict[str, float], rules: Rules, draws: int = 4000) -> list[float]:
    """The allowed word distance to a reference at each of sizes(rules)."""
    import numpy as np

    p, rng = _histogram(found), np.random.default_rng(7)
    none = distances(np.eye(len(p))[-1:], p[None, :])[0]  # of a text without a common word
    drawn = [np.quantile(distances(rng.multinomial(n, p / p.sum(), draws) / n, p[None, :]), rules.word_quantile) for n in sizes(rules)]
    return [float(min((d * d + rules.max_word_distance**2) ** 0.5, none * (1 - 1e-6))) for d in drawn]


@functools.cache
def class_table():
    """The class of every code point; made once on the driver."""
    import numpy as np

    table = np.full(0x110000, 7, np.uint8)
    for c in range(len(table)):
        kind = unicodedata.category(chr(c))
        table[c] = 4 if chr(c).isspace() else 0 if kind == "Ll" else 1 if kind in ("Lu", "Lt") else 2 if kind[0] in "LM" else 3 if kind[0] == "N" else 6 if kind[0] == "S" or chr(c) in SYMBOLS.decode() else 5 if kind[0] == "P" else 7
    return table


def _plain(token: bytes) -> str:
    """A word in lower case without what surrounds its letters."""
    return token.decode(errors="ignore").lower().strip(".,;:!?\"'()[]{}#*$%&|<>-_/\\")


class _Slots(dict):
    """Numbers the tokens of a worker as they come; ``plain`` has their words."""

    def __init__(self) -> None:
        super().__init__()
        self.plain: list[str] = []

    def __missing__(self, token: bytes) -> int:
        self[token] = slot = len(self.plain)
        self.plain.append(_plain(token))
        return slot


@dataclass
class Measures:
    """Of a run of texts, one row each: the base metrics, class counts, and the slots of their words."""

    n_words: object
    word_chars: object
    n_symbols: object
    n_dup_lines: object
    n_repeat_words: object
    classes: object
    slots: object
    owner: object


def measure(bodies: list[str], slots: _Slots, table, window: int = 5) -> Measures:
    """``table``: class_table()."""
    import numpy as np

    n = len(bodies)
    data = [t.encode() for t in bodies]
    found = [d.split() for d in data]  # of bytes: ASCII white space only
    n_words = np.array([len(f) for f in found], np.int64)
    every = np.fromiter((x for f in found for x in map(slots.__getitem__, f)), np.int64, int(n_words.sum()))
    owner = np.repeat(np.arange(n), n_words)
    codes = np.frombuffer("".join(bodies).encode("utf-32-le"), "<u4")
    chars = np.array([len(t) for t in bodies], np.int64)
    of_char = np.repeat(np.arange(n), chars)
    classes = np.bincount(of_char * len(CLASSES) + table[codes], minlength=n * len(CLASSES)).reshape(n, len(CLASSES))
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    n_symbols = np.array([len(d) - len(d.translate(None, SYMBOLS)) for d in data], np.int64)
    lines = [[x for x in d.split(b"\n") if x.strip()] for d in data]
    n_dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    return Measures(n_words, chars - np.bincount(of_char[blank], minlength=n), n_symbols, n_dup, _repeated(every, owner, n, window), classes, every, owner)


def _repeated(words, owner, n: int, window: int):
    """Words of each text within windows that occur twice or more in it."""
    import numpy as np

    if len(words) < window:
        return np.zeros(n, np.int64)
    last = len(words) - window + 1
    key = (owner[:last].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(window):  # a 64-bit hash of the text's number and the words of the window
        word = words[k : k + last].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        word = (word ^ (word >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (key ^ word ^ (word >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(31)
    starts = np.flatnonzero(owner[:last] == owner[window - 1 :])
    order = np.argsort(key[starts], kind="stable")
    held = key[starts][order]
    twice = np.zeros(len(held), bool)
    twice[1:] = held[1:] == held[:-1]
    twice[:-1] |= twice[1:]
    starts = starts[order[twice]]
    edge = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + window, minlength=len(words) + 1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=n)


def base_metrics(text: str, window: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    m = measure([text], _Slots(), class_table(), window)
    return tuple(int(x[0]) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words))


def _count(table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts by language: of each word (class -2), all words (-1) and each character class. ``table``: class_table(), broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        of_worker("quality counts", lambda: None)
        slots = _Slots()
        by_slot: dict[str, object] = {}
        by_class: dict[str, object] = {}

        def flush() -> pa.RecordBatch:
            rows: list[tuple] = []
            for lang, counts in by_slot.items():
                words: Counter = Counter()
                for slot in np.flatnonzero(counts).tolist():
                    words[slots.plain[slot]] += int(counts[slot])
                words.pop("", None)
                rows += [(lang, None, -1, sum(words.values())), *((lang, w, -2, k) for w, k in words.items())]
                rows += [(lang, None, c, k) for c, k in enumerate(by_class[lang].tolist()) if k]
            by_slot.clear(), by_class.clear(), slots.clear(), slots.plain.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "word", "class", "n"])

        for part in (p for b in batches for p in slices(b, limit=1 << 20)):
            m = measure(texts(part), slots, table.value)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                own = langs == lang
                counts = np.bincount(m.slots[own[m.owner]], minlength=len(slots.plain))
                if (old := by_slot.get(lang)) is not None:
                    counts[: len(old)] += old
                by_slot[lang] = counts
                by_class[lang] = by_class.get(lang, 0) + m.classes[own].sum(axis=0)
            if len(slots) > 100_000:
                yield flush()
        if by_slot:
            yield flush()

    return frugal(run)


def learn_references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """From all rows whose text and lang are not null."""
    table = docs.sparkSession.sparkContext.broadcast(class_table())
    usable = docs.where("text is not null and lang is not null").selectExpr("cast(text as string) text", "cast(lang as string) lang")
    counts = usable.mapInArrow(_count(table), "lang string, word string, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    counts = write_shared(counts, "quality-counts")
    sizes = counts.where("class = -1 and n > 0").selectExpr("lang as of_lang", "n as all_words")
    if len(sizes.limit(rules.max_langs + 1).collect()) > rules.max_langs:
        raise ValueError(f"more than {rules.max_langs} languages")
    kept = counts.join(F.broadcast(sizes), F.col("lang") == F.col("of_lang"))  # a row for each language, so no more than max_langs
    rows = kept.where((F.col("class") > -2) | (F.col("n") >= F.col("all_words") * rules.common)).select("lang", "word", "class", "n", "all_words").collect()
    langs = sorted({r["lang"] for r in rows})
    out = References(langs, [[0.0] * len(CLASSES) for _ in langs], [{} for _ in langs])
    for r in rows:
        i = langs.index(r["lang"])
        if r["class"] >= 0:
            out.classes[i][r["class"]] = float(r["n"])
        elif r["word"] is not None:
            out.words[i][r["word"]] = r["n"] / r["all_words"]
    for i, c in enumerate(out.classes):
        out.classes[i] = [x / (sum(c) or 1) for x in c]
    out.limits = [limits(found, rules) for found in out.words]
    return out


def distances(p, q):
    """Jensen-Shannon distance, to base 2, of each row of p to q: 0 to 1."""
    import numpy as np

    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, each / 2))


class Judge:
    """Judges texts in one worker; remembers up to ``most`` tokens."""

    def __init__(self, references: References, rules: Rules, table, most: int = 100_000):
        import numpy as np

        self.rules, self._table, self._most = rules, table, most
        self._classes = [np.array(c) for c in references.classes]
        self._index, self._words = [], []
        for found in references.words:
            order = sorted(found)
            self._index.append({w: k for k, w in enumerate(order)})
            self._words.append(_histogram(found))
        self._limits = references.limits or [limits(found, rules) for found in references.words]
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self._slots = _Slots()
        self._common = np.zeros((len(self._index) + 1, 0), np.int32)  # the common word of each slot by language; last, whether it is a word

    def _known(self):
        import numpy as np

        fresh = self._slots.plain[self._common.shape[1] :]
        if fresh:
            more = [[index.get(w, -1) for w in fresh] for index in self._index] + [[bool(w) for w in fresh]]
            self._common = np.concatenate([self._common, np.array(more, np.int32)], axis=1)
        return self._common

    def judge(self, bodies: list[str]) -> tuple:
        """measures, base_failed, class and word distance (nan: too short or no reference), kept: arrays."""
        import numpy as np

        if len(self._slots) > self._most:
            self._forget()
        r, n = self.rules, len(bodies)
        m = measure(bodies, self._slots, self._table, r.window)
        failed = (m.n_words < r.min_words) | (100 * m.n_repeat_words > r.repeat_percent * m.n_words)
        chars = m.classes.sum(axis=1)
        by_class, by_word = np.full(n, np.nan), np.full(n, np.nan)
        if self._classes:
            share = m.classes / np.maximum(chars, 1)[:, None]
            by_class = np.min([distances(share, c[None, :]) for c in self._classes], axis=0)
            by_class[chars < r.min_chars_for_classes] = np.nan
        common = self._known()[:, m.slots]
        words = np.bincount(m.owner[common[-1] > 0], minlength=n)
        strange = np.zeros(n, bool)
        if self._words:
            each, over = [], []
            at = np.log(np.maximum(words, 1))
            for own, reference, limit in zip(common[:-1], self._words, self._limits, strict=True):
                width, hit = len(reference), own >= 0
                hist = np.bincount(m.owner[hit] * width + own[hit], minlength=n * width).reshape(n, width)
                hist[:, -1] = words - hist[:, :-1].sum(axis=1)
                each.append(distances(hist / np.maximum(words, 1)[:, None], reference[None, :]))
                over.append(each[-1] > np.interp(at, np.log(sizes(r)), limit))
            by_word, strange = np.min(each, axis=0), np.all(over, axis=0) & (words >= r.min_words_for_words)
            by_word[words < r.min_words_for_words] = np.nan
        near = ~(by_class > r.max_class_distance) & ~strange
        return m, failed, by_class, by_word, ~failed & near


def judge(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """doc_id, the base metrics, base_failed, both distances, kept."""
    shared, key = docs.sparkSession.sparkContext.broadcast((references, rules, class_table())), uuid.uuid4().hex
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        by = of_worker(("quality", key), lambda: Judge(*shared.value))
        for part in (p for b in batches for p in slices(b, limit=1 << 20)):
            m, failed, by_class, by_word, kept = by.judge(texts(part))
            counts = [pa.array(np.asarray(x, np.int64)) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
            far = [pa.array(x, pa.float64(), from_pandas=True) for x in (by_class, by_word)]  # nan becomes null
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(failed), *far, pa.array(kept)], names=names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), schema)


def keep(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs, with all their columns, that ``judge`` keeps."""
    shared, key = docs.sparkSession.sparkContext.broadcast((references, rules, class_table())), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = of_worker(("quality", key), lambda: Judge(*shared.value))
        for part in (p for b in batches for p in slices(b, limit=1 << 20)):
            yield part.filter(pa.array(by.judge(texts(part))[-1]))

    return docs.mapInArrow(frugal(run), docs.schema)
