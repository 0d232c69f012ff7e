"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the merges; the library's tokenizer is built from it once
on the driver (a few MB, fixed by the vocabulary) and broadcast as JSON.
Tasks split texts into units that no match of the pattern crosses, let the
library encode each new unit once, and join the ids; or Arrow tells the
distinct units of a whole column apart.  Offsets come from the
byte length of each id and the text's byte-to-character map; decoding
reverses the byte table and keeps split characters as the bytes they are.

Null text counts as empty: no ids, no bytes.  Rows with equal ids stay
apart, an empty table gives an empty result, and other columns of the input
are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .common import frugal, slices, texts, workers_quiet
from .units import UnitCache, unit_starts


#: Fixed value: how byte-level tokenizers split a text before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts whose only white space is single blanks, and line feeds that each stand alone; without a look ahead it takes two thirds of the time.
PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n"""

#: A blank or line feed at most, then characters that are no white space by any definition.
_PLAIN_UNIT = r"^[ \n]?[^\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"


def byte_table() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the
    characters from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(0x100 + n)
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens whose merge makes ``token``: what merging by lower ranks leaves of it."""
    parts, most = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], most)) < most]
        if not found:
            return None
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizers-library tokenizer that gives the ids of a rank file, as JSON."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    table = byte_table()
    name = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [(name[a], name[b]) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1 and (pair := merge_pair(t, ranks)) for a, b in [pair]]
    made = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    made.decoder = decoders.ByteLevel()
    return made.to_str()


def _splits_by_pattern(made: dict) -> bool:
    """Whether a tokenizer of the library, as parsed JSON, splits texts by ``PATTERN`` and does nothing else to them."""
    first = made.get("pre_tokenizer") or {}
    parts = first.get("pretokenizers") or [first]
    if made.get("normalizer") or parts[-1].get("type") != "ByteLevel" or parts[-1].get("add_prefix_space"):
        return False
    if len(parts) == 1:
        return parts[0].get("use_regex", True)
    split = {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Isolated", "invert": False}
    return parts[:-1] == [split] and not parts[-1].get("use_regex", True)


class ByteBPE:
    """Encodes and decodes in one Python worker.

    Where the tokenizer splits by ``PATTERN``, new units are encoded many at a
    time as one text.  ``by_ranks`` merges them by rank with tiktoken where
    that gives the same ids, at half of the time.
    """

    def __init__(self, tokenizer: str, by_ranks: bool = False):
        import numpy as np
        from tokenizers import Tokenizer

        workers_quiet()
        self._tokenizer = Tokenizer.from_str(tokenizer)
        byte_of = {c: b for b, c in byte_table().items()}
        made = json.loads(tokenizer)
        added = {x["id"]: x["content"] for x in made.get("added_tokens") or ()}
        vocab = self._tokenizer.get_vocab()
        self.pieces: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self._added = list(added.values())
        self._merges = self._ranks(made) if by_ranks else None
        self._encode_text = self._by_rank if self._merges else self._by_library
        feed = self._tokenizer.encode("\n", add_special_tokens=False).ids
        self._feed = feed[0] if len(feed) == 1 else None
        self._cache = UnitCache(self._encode_joined if len(feed) == 1 and _splits_by_pattern(made) else self._encode_units)

    @functools.cached_property
    def _ranked(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self._merges, special_tokens={})

    @functools.cached_property
    def _plain(self):
        import tiktoken

        return tiktoken.Encoding("plain", pat_str=PLAIN_PATTERN, mergeable_ranks=self._merges, special_tokens={})

    def _by_rank(self, text: str):
        return self._ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def _by_library(self, text: str):
        import numpy as np

        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode_units(self, units: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _encode_joined(self, units: list[str]) -> list[bytes]:
        """Units many at a time, a line feed between them, and told apart by its id.

        A line feed that starts a unit is a token of its own.
        """
        import numpy as np

        out: list[bytes] = []
        feed = np.array([self._feed], "<u4").tobytes()
        for start in range(0, len(units), 500):
            run = units[start : start + 500]
            bodies = [u[1:] if u[:1] == "\n" else u for u in run]
            joined = "\n".join(bodies)
            if joined.count("\n") == len(run) - 1 and all(bodies) and not any(b[-1].isspace() for b in bodies) and not any(a in joined for a in self._added):
                ids = self._encode_text(joined)
                data, edges = ids.tobytes(), (4 * np.flatnonzero(ids == self._feed)).tolist()
                if len(edges) == len(run) - 1:
                    parts = [data[a:b] for a, b in zip([0, *(e + 4 for e in edges)], [*edges, len(data)], strict=True)]
                    out += [feed + p if u[0] == "\n" else p for u, p in zip(run, parts, strict=True)]
                    continue
            out += self._encode_units(run)
        return out

    def _ranks(self, made: dict) -> dict[bytes, int] | None:
        """The vocabulary as ranks, if the tokenizer splits by the byte-level pattern and merges in the order of its ids."""
        model = made["model"]
        if not _splits_by_pattern(made) or model.get("dropout") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            return None
        vocab = model["vocab"]
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if order != sorted(order):
            return None
        return {self.pieces[i]: i for token, i in vocab.items() if token not in self._added}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return self._cache.encode(texts)

    def encode_column(self, column: pa.Array, separator: int | None = None) -> tuple:
        """The ids of a column of texts one after the other (null: none), with the separator after those of each text, and where they end.

        Where ``by_ranks`` holds, Arrow tells the distinct units of the column
        apart, each is encoded once, and Arrow puts their ids together.
        """
        import numpy as np

        ids, ends = self._encode_column(column)
        return (ids, ends) if separator is None else (np.insert(ids, ends, separator), ends + np.arange(1, len(ends) + 1))

    def _encode_column(self, column: pa.Array) -> tuple:
        import numpy as np
        import pyarrow.compute as pc

        if not self._merges or self._feed is None:
            codes = self.encode(["" if x is None else x for x in column.to_pylist()])
            return np.frombuffer(b"".join(codes), "<u4"), np.cumsum([len(c) // 4 for c in codes], dtype=np.int64)
        column = pc.fill_null(column, "").cast(pa.large_string())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
        if edges[0] == edges[-1]:
            return np.zeros(0, "<u4"), np.zeros(len(column), np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        ends = edges[1:] - edges[0]
        starts = unit_starts(data, ends)
        units = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
        known, places = self._encode_distinct(units.dictionary)
        coded = known.take(pa.array(places[units.indices.to_numpy()]))
        at = np.frombuffer(coded.buffers()[1], np.int64)[: len(coded) + 1] // 4
        return np.frombuffer(coded.buffers()[2], "<u4", at[-1]), at[np.searchsorted(starts, ends)]

    def _encode_distinct(self, units: pa.Array) -> tuple:
        """The ids of each unit as binary, in an order of their own, and the place of each unit there.

        Plain units are encoded many at a time as one text, a line feed before
        each but the first; all others by the library.
        """
        import numpy as np
        import pyarrow.compute as pc

        plain = pc.match_substring_regex(units, _PLAIN_UNIT)
        for content in self._added:
            plain = pc.and_not(plain, pc.match_substring(units, content))
        plain, own = plain.to_numpy(zero_copy_only=False), units.filter(plain)
        flat, sizes = [], []
        for start in range(0, len(own), 20_000):
            run = own.slice(start, 20_000)
            joined = pc.binary_join(pa.ListArray.from_arrays([0, len(run)], run.cast(pa.string())), "\n")[0].as_py()
            ids = np.array(self._plain.encode_ordinary(joined), "<u4")
            feeds, leads = np.flatnonzero(ids == self._feed), pc.starts_with(run, "\n").to_numpy(zero_copy_only=False)
            between = feeds[np.arange(len(run) - 1) + np.cumsum(leads[:-1])]  # those that start a unit stand among the others
            sizes.append(np.diff(between, prepend=-1, append=len(ids)) - 1)
            flat.append(np.delete(ids, between))
        for code in self._encode_units(units.filter(pa.array(~plain)).to_pylist()):
            sizes.append([len(code) // 4])
            flat.append(np.frombuffer(code, "<u4"))
        edges = 4 * np.r_[0, np.cumsum(np.concatenate(sizes))].astype(np.int64)
        places = np.empty(len(units), np.int64)
        places[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(units))
        return pa.Array.from_buffers(pa.large_binary(), len(units), [None, pa.py_buffer(edges), pa.py_buffer(np.concatenate(flat))]), places

    def decode(self, ids: bytes) -> bytes:
        """The bytes that ids stand for; not valid UTF-8 where ids end within a character."""
        import numpy as np

        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: str, ids: bytes):
        """Start and end characters of each id; one that holds part of a character spans all of it."""
        import numpy as np

        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.lengths[np.frombuffer(ids, "<u4")])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        return (char[begins], char[ends - 1] + 1) if len(ends) else (begins, ends)


def of_worker(tokenizer: str, by_ranks: bool = False) -> ByteBPE:
    """The encoder of this Python worker, kept between tasks."""
    return common.of_worker(("bpe", hash(tokenizer), by_ranks), lambda: ByteBPE(tokenizer, by_ranks))


def encode(docs: DataFrame, tokenizer: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids (array of int), and with_offsets also the arrays starts and ends, in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = of_worker(shared.value)
        for part in (p for b in batches for p in slices(b)):
            body = texts(part)
            coded = bpe.encode(body)
            columns = [part.column("doc_id"), pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32()))]
            if with_offsets:
                spans = [bpe.offsets(t, c) for t, c in zip(body, coded, strict=True)]
                columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, data (binary), text (null where the bytes are not UTF-8) from doc_id and ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = of_worker(shared.value)
        for b in batches:
            data = [bpe.decode(np.asarray(x or (), "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary()), pa.array([_utf8(x) for x in data], pa.string())], names=["doc_id", "data", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, data binary, text string")


def _utf8(data: bytes) -> str | None:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return None


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, offsets_sha256: digests of the ids, of their decoding and of their character offsets, without moving any.

    The last is that of the start and end characters of each id in turn, as
    little-endian unsigned 32-bit integers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = of_worker(shared.value)
        for part in (p for b in batches for p in slices(b)):
            body = texts(part)
            coded = bpe.encode(body)
            spans = (np.stack(bpe.offsets(t, c), axis=1).astype("<u4").tobytes() for t, c in zip(body, coded, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(c) // 4 for c in coded], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in spans], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string")
