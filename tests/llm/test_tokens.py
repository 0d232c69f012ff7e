"""Encoding, counting and packing of tokens."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from seqlake.llm import binary_output, bpe, retrieval_packing, token_counts
from seqlake.llm.queries import json_tokenizer
from seqlake.llm.units import split_units

from .fixtures import corpus, empty, frame

ROWS = corpus()


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def tokenizer(ranks):
    return bpe.tokenizer_json(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("ab \n\t'0,é漢 \x1c\0<|▁") for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_bytes_have_their_characters():
    table = bpe.byte_table()
    assert sorted(table) == list(range(256)) and len(set(table.values())) == 256
    assert table[ord("A")] == "A" and table[0] == "Ā" and table[ord(" ")] == "Ġ"


def test_units_join_to_the_text():
    for text in [*noise(300, 1), *(t or "" for _, t, _ in ROWS)]:
        assert "".join(split_units(text)) == text


def test_encoder_equals_the_library(tokenizer, library):
    coder, texts = bpe.ByteBPE(tokenizer), [*noise(2000, 2), *(t or "" for _, t, _ in ROWS)]
    for text, code in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(code) == text.encode()


def test_units_are_joined_only_for_the_known_pattern(tokenizer, ranks):
    coder, other = bpe.ByteBPE(tokenizer), bpe.ByteBPE(bpe.tokenizer_json(ranks, r"\S+\n*|\s+"))
    assert coder._cache._encode_many == coder._encode_joined and other._cache._encode_many == other._encode_units
    units = [" and", "\nnew", "\u3000\u3000x", "x\u3000\u3000y", " 漢字!", "a'll", " '", "\n\u2028b", "\x1cz", *noise(300, 6)]
    assert coder._encode_joined(units) == coder._encode_units(units)
    for unit in units:
        assert coder._encode_joined([" a", unit, "\nb"]) == coder._encode_units([" a", unit, "\nb"])


def test_ids_by_ranks_equal_the_library():
    texts = [*noise(2000, 4), *(t or "" for _, t, _ in ROWS), " <|endoftext|>\n\n<|endoftext|> a"]
    library, coder = Tokenizer.from_str(json_tokenizer()), bpe.ByteBPE(json_tokenizer(), by_ranks=True)
    assert coder._cache._encode_many == coder._encode_joined
    for text, code in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert bpe.PATTERN == P.PATTERN


def test_offsets_and_split_characters(tokenizer):
    coder, text = bpe.ByteBPE(tokenizer), "a漢😀 é<x"
    code = coder.encode([text])[0]
    start, end = coder.offsets(text, code)
    for i, s, e in zip(np.frombuffer(code, "<u4").tolist(), start.tolist(), end.tolist(), strict=True):
        piece = coder.pieces[i]
        assert piece in text[s:e].encode()
    assert start[0] == 0 and end[-1] == len(text)


def test_round_trip(spark, tokenizer, library):
    found = Counter(tuple(r) for r in bpe.round_trip(frame(spark, ROWS), tokenizer).collect())
    want = Counter()
    for i, t, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        char = [k for k, c in enumerate(t or "") for _ in c.encode()]  # of each byte
        spans, at = [], 0
        for x in ids:
            size = len(library.decode_single_token_bytes(x))
            spans += [char[at], char[at + size - 1] + 1]
            at += size
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (t or "").encode(), np.array(spans, "<u4").tobytes())]
        want[i, len(ids), *digests] += 1
    assert found == want
    assert bpe.round_trip(empty(spark), tokenizer).collect() == []


def test_encode_and_decode(spark, tokenizer):
    rows = [r for r in ROWS if r[0] is not None][:40]
    coded = bpe.encode(frame(spark, rows), tokenizer, with_offsets=True)
    first = coded.collect()
    assert all(len(r.ids) == len(r.starts) == len(r.ends) for r in first)
    back = {r.doc_id: (bytes(r["data"]), r.text) for r in bpe.decode(coded, tokenizer).collect()}
    assert back == {i: ((t or "").encode(), t or "") for i, t, _ in rows}
    cut = spark.createDataFrame([(1, bpe_ids(tokenizer, "😀")[:1])], "doc_id long, ids array<int>")
    assert bpe.decode(cut, tokenizer).collect()[0].text is None


def bpe_ids(tokenizer, text):
    return np.frombuffer(bpe.ByteBPE(tokenizer).encode([text])[0], "<i4").tolist()


def test_counts_equal_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = token_counts.PieceModel(path)
    counter = token_counts.Counter(model.ranks, model.byte_fallback, model.joined, model.proto, most=500)
    for text in noise(2000, 3):
        assert counter.count(text) == len(sp.encode(text))
    found = Counter(tuple(r) for r in token_counts.count_tokens(frame(spark, ROWS), path).collect())
    want = Counter((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t, _ in ROWS)
    assert found == want and any(k[3] for k in want)
    assert token_counts.count_tokens(empty(spark), path).collect() == []


def ids_of(rows):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, _ in rows]


def test_retrieval_packing(spark):
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(ROWS)]
    ids = ids_of(rows)
    found = retrieval_packing.packed(frame(spark, rows), json_tokenizer(), with_ids=True).collect()
    seen = {k: [] for k in range(len(rows))}
    sequences: dict = {}
    for r in found:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tolist() and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(ids[k])
    full = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        full += at == 1024
    assert full >= len(sequences) - 4  # one open window for each partition
    assert retrieval_packing.packed(empty(spark), json_tokenizer()).collect() == []


def test_null_ids_and_repeated_rows_are_packed(spark):
    found = retrieval_packing.packed(frame(spark, [(None, "a b", "en"), (3, "same", "en"), (3, "same", "en"), (4, None, None)]), json_tokenizer()).collect()
    assert Counter(r.doc_id for r in found) == Counter([None, 3, 3, 4])


def test_index_ranks_as_bm25_by_definition():
    rnd = np.random.default_rng(5)
    docs = [rnd.zipf(1.4, rnd.integers(5, 60)) % 200 for _ in range(30)]
    shard = retrieval_packing.Shard(docs)
    mean = np.mean([len(d) for d in docs])
    for seed in range(5):
        scores = []
        for d in docs:
            total = 0.0
            for term in set(docs[seed].tolist()):
                df, tf = sum(term in x for x in docs), int((d == term).sum())
                idf = np.log((30 - df + 0.5) / (df + 0.5))
                if idf > 0:
                    total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            scores.append(total)
        got = shard.neighbours(seed).tolist()
        assert sorted(got) == list(range(30))
        by_rank = [scores[k] for k in got if k != seed]
        assert all(a >= b - 1e-9 for a, b in zip(by_rank, by_rank[1:]))  # noqa: B905
    shard.used[:7] = True
    assert min(shard.neighbours(3).tolist()) == 7


@pytest.mark.parametrize("window", [8, 16, 100])
def test_best_fit_equals_a_plain_search(window):
    rnd = random.Random(window)
    lengths = [rnd.randint(1, 3 * window) for _ in range(200)]
    pieces = sorted(((d, s, min(window, n - s)) for d, n in enumerate(lengths) for s in range(0, n, window)), key=lambda p: -p[2])
    rooms: list[int] = []
    for _, _, n in pieces:
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(window - n)
    got = binary_output.best_fit(lengths, window)
    assert sorted(window - sum(p[2] for p in s) for s in got) == sorted(rooms)
    assert sorted(p for s in got for p in s) == sorted(pieces)


def test_capacities():
    tree = binary_output.Capacities(10)
    assert tree.least(1) is None
    for room in (3, 7, 10):
        tree.add(room)
    assert [tree.least(n) for n in (1, 3, 4, 7, 8, 10)] == [3, 3, 7, 7, 10, 10]
    tree.add(7, -1)
    assert tree.least(4) == 10


def test_matrices(spark):
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(ROWS)]
    ids = ids_of(rows)
    found = binary_output.matrices(frame(spark, rows), json_tokenizer()).collect()
    got: dict = {}
    for r in found:
        row, places = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(row) == len(places) == 1024 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            got.setdefault(doc, []).append((start, row[a:b].tolist()))
            assert places[a:b].tolist() == list(range(b - a))
    assert {k: [x for _, part in sorted(v) for x in part] for k, v in got.items()} == {k: x.tolist() for k, x in enumerate(ids)}
    digests = {r.sequence_id: r.ids_crc32 for r in binary_output.matrices(frame(spark, rows), json_tokenizer(), digests=True).collect()}
    assert digests == {r.sequence_id: zlib.crc32(r.ids) for r in found}
    assert binary_output.matrices(empty(spark), json_tokenizer()).collect() == []


def test_write_matrices(spark, tmp_path):
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(ROWS)]
    path = str(tmp_path / "packed")
    binary_output.write_matrices(frame(spark, rows), json_tokenizer(), path, window=256)
    written = spark.read.parquet(path).collect()
    assert {len(r.ids) for r in written} == {1024} == {len(r.positions) for r in written}
    assert sum(r.n_tokens for r in written) == sum(map(len, ids_of(rows)))


def rare_families(n, seed=3):
    """Documents of frequent words in families of eight that share a few rare ones; ids deal the families apart."""
    rnd = random.Random(seed)
    names = [a + b + c for a in ("zor", "quib", "plaf", "drum", "wesk") for b in ("ax", "ill", "ond", "urp", "ech", "ism") for c in ("ona", "iff", "yst", "ube", "arl", "oct", "eng")]
    families = [rnd.sample(names, 6) for _ in range(n // 8)]
    rows = []
    for k in range(n):
        words = [rnd.choice(("the", "of", "and", "to", "in", "was", "for")) for _ in range(40)] + rnd.sample(families[k % len(families)], 5)
        rnd.shuffle(words)
        rows.append((k, " ".join(words), "en"))
    return rows


@pytest.mark.parametrize(("n", "least"), [(1600, 0.5), (4800, 0.5)])
def test_best_neighbours_of_all_documents_meet_in_a_shard(spark, monkeypatch, n, least):
    """The share of documents whose best BM25 neighbour over the whole table is dealt next to them."""
    rows = rare_families(n)
    monkeypatch.setattr(retrieval_packing, "SHARD_DOCS", 64)
    every = retrieval_packing.Shard(ids_of(rows))
    place = {r.doc_id: (r.sequence_id >> 40, i) for i, r in enumerate(retrieval_packing.packed(frame(spark, rows), json_tokenizer()).collect())}
    at = {d: i // 64 for i, d in enumerate(sorted(place, key=place.get))}
    best = [next(x for x in every.neighbours(k).tolist() if x != k) for k in range(0, n, 7)]
    found = np.mean([abs(at[k] - at[b]) <= 1 for k, b in zip(range(0, n, 7), best, strict=True)])
    print(n, found)
    assert found >= least


def test_columns_of_texts_are_encoded_as_by_the_library():
    library, coder = Tokenizer.from_str(json_tokenizer()), bpe.ByteBPE(json_tokenizer(), by_ranks=True)
    odd = [None, "", " ", "\n", "a ", " a", "a\n\nb", "a \n b", "x<|endoftext|> y\n<|endoftext|>", "a\u00a0 b", "a\u3000\nb", "\u0440 \u0440", "\u201cq\u201d \u201cq", "it's 'll\t\t\tz"]
    column = pa.array([*odd, *noise(3000, 4), *(t for _, t, _ in ROWS)], pa.string())
    for part in (column, column.slice(2), column.slice(5, 4), column.slice(0, 2), column.slice(0, 0)):
        ids, ends = coder.encode_column(part)
        edges = [0, *ends.tolist()]
        want = [library.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == want
        ids, ends = coder.encode_column(part, 7)
        assert ids.tolist() == [x for w in want for x in [*w, 7]] and np.diff(ends, prepend=0).tolist() == [len(w) + 1 for w in want]


def test_a_column_encodes_each_distinct_unit_once():
    coder, handed = bpe.ByteBPE(json_tokenizer(), by_ranks=True), []

    class Counting:
        def __init__(self, inner):
            self._inner = inner

        def encode_ordinary(self, text):
            handed.append(text)
            return self._inner.encode_ordinary(text)

    coder._plain = Counting(coder._plain)
    words = [f"w{k % 500}" for k in range(100_000)]
    ids, ends = coder.encode_column(pa.array([" ".join(words[k : k + 100]) for k in range(0, len(words), 100)], pa.string()))
    assert len(ends) == 1000 and len(ids) == ends[-1]
    assert sum(len(t.split()) for t in handed) <= 2 * 500


@pytest.mark.parametrize(("most", "n"), [(500, 40), (1 << 20, 40), (500, 70_000)])
def test_distinct_ids_of_many_documents_at_once(most, n):
    rnd = np.random.default_rng(n)
    docs = [rnd.integers(0, most, rnd.integers(0, 5)).astype("<u4") for _ in range(n)]
    doc, ids, counts = retrieval_packing.distinct(np.concatenate(docs), np.array([len(d) for d in docs]))
    want = [(k, int(i), int(c)) for k, d in enumerate(docs) for i, c in zip(*np.unique(d, return_counts=True), strict=True)]
    assert list(zip(doc.tolist(), ids.tolist(), counts.tolist(), strict=True)) == want
