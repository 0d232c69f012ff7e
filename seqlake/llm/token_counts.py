"""Counts the tokens of a sentencepiece BPE model by heap-and-linked-list merging, without making ids.

The symbols of a text start as its characters; the adjacent pair of lowest
rank is popped from a heap and joined in a linked list until no pair is
left.  Every merge takes one symbol away, so the count is the number of
initial symbols (a character outside the vocabulary counts once for each of
its UTF-8 bytes) minus the number of merges.

Texts are cut where no piece of the vocabulary could reach across, so that
each distinct unit is merged once in a worker.  The model file is read on
the driver and broadcast as a rank table, whose size the vocabulary fixes.

Null text counts as empty (0 tokens).  Rows with equal ids stay apart; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import frugal, of_worker, slices, texts

_BLANK = "▁"


class PieceModel:
    """The pieces of a sentencepiece BPE model by rank, and how it normalizes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.proto = sp.serialized_model_proto()
        every = range(sp.get_piece_size())
        plain = [i for i in every if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        self.ranks = {sp.id_to_piece(i): n for n, i in enumerate(order)}
        self.byte_fallback = any(sp.is_byte(i) for i in every)
        #: Characters that may follow one another inside a piece.
        self.joined = {p[i : i + 2] for p in self.ranks for i in range(len(p) - 1)}


def count_symbols(unit: str, ranks: dict[str, int], byte_fallback: bool = True) -> int:
    """The symbols that are left of one unit after all merges."""
    n = len(unit)
    sym: list[str | None] = list(unit)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, sym[i] + sym[i + 1]) for i in range(n - 1) if (r := ranks.get(sym[i] + sym[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, made = heapq.heappop(heap)
        j = right[i] if sym[i] is not None else -1
        if j < 0 or len(sym[i]) + len(sym[j]) != len(made) or sym[i] + sym[j] != made:
            continue  # one of the two has been merged since
        sym[i], sym[j] = made, None
        merges += 1
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            if (r := ranks.get(made + sym[k])) is not None:
                heapq.heappush(heap, (r, i, made + sym[k]))
        if (h := left[i]) >= 0 and (r := ranks.get(sym[h] + made)) is not None:
            heapq.heappush(heap, (r, h, sym[h] + made))
    unknown = sum(len(c.encode()) - 1 for c in unit if c not in ranks) if byte_fallback else 0
    return n - merges + unknown


class Counter:
    """Counts in one Python worker; remembers up to ``most`` units."""

    def __init__(self, ranks: dict[str, int], byte_fallback: bool, joined: set[str], proto: bytes, most: int = 1_000_000):
        import sentencepiece

        self._normalize = sentencepiece.SentencePieceProcessor(model_proto=proto).normalize
        self._ranks, self._fallback, self._most = ranks, byte_fallback, most
        # a piece with a blank after another character would make these cuts unsafe
        self._cut = not any(x[1] == _BLANK and x[0] != _BLANK for x in joined)
        self._feed = not any("\n" in x for x in joined)
        self._slow = re.compile(f"(?<=[^{_BLANK}])(?={_BLANK})")
        self._known: dict[str, int] = {"": 0}

    def _units(self, text: str) -> list[str]:
        if not self._cut:
            return [text]
        if "\0" in text or _BLANK * 2 in text:
            units = self._slow.split(text)
            return [x for u in units for x in re.split("(\n)", u)] if self._feed else units
        text = text.replace(_BLANK, "\0" + _BLANK)
        return (text.replace("\n", "\0\n\0") if self._feed else text).split("\0")

    def count(self, text: str) -> int:
        if len(self._known) > self._most:
            self._known = {"": 0}
        known, units = self._known, self._units(self._normalize(text))
        try:
            return sum(map(known.__getitem__, units))
        except KeyError:
            total = 0
            for u in units:
                n = known.get(u)
                if n is None:
                    n = count_symbols(u, self._ranks, self._fallback)
                    if len(u) <= 64:
                        known[u] = n
                total += n
            return total


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for each row."""
    model = PieceModel(model_path)
    shared = docs.sparkSession.sparkContext.broadcast((model.ranks, model.byte_fallback, model.joined, model.proto))

    key = hash(model.proto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = of_worker(("piece counts", key), lambda: Counter(*shared.value))
        for part in (p for b in batches for p in slices(b)):
            body = texts(part)
            n = [counter.count(t) for t in body]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t.encode()) for t in body], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
