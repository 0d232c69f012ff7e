"""Near-duplicates, repeated passages, fingerprints and components against brute force."""

import hashlib
import random

import numpy as np
import pytest

from seqlake.llm import fingerprints, minhash, suffix_dedup
from seqlake.llm.components import components

from .fixtures import corpus, empty, frame, prose

ROWS = corpus(140, 2)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows, percent=85):
    """By row: rows with one id are one document; a row without an id counts by its links."""
    sets = [shingle_set(t) for _, t, _ in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for n, (i, _, _) in enumerate(rows):
        for m in range(n):
            both = len(sets[n] & sets[m])
            if both and 100 * both >= percent * len(sets[n] | sets[m]) or i is not None and sets[n] and sets[m] and i == rows[m][0]:
                at[root(n)] = root(m)
    least = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    out = {}
    for n, (i, _, _) in enumerate(rows):
        component = least.get(root(n)) if sets[n] else i
        out[i] = (len(sets[n]), component, component is None or i == component)
    return out


def near_rows(rows, spark):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}


def test_near_duplicates(spark):
    want = brute_components(ROWS)
    assert near_rows(ROWS, spark) == want
    assert len({v[1] for v in want.values()}) < len(want) - 20


def test_large_family(spark):
    """More near copies than a bucket yields pairs for, most of them not linked to each other."""
    rnd = random.Random(4)
    base = prose(rnd, "en", 150).split(" ")
    rows = [(0, " ".join(base), "en")]
    for i in range(1, 330):
        words = list(base)
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(9)}"
        rows.append((i, " ".join(words), "en"))
    rows += [(400 + i, prose(rnd, "de", 60), "de") for i in range(40)]
    assert near_rows(rows, spark) == brute_components(rows)


def test_repeated_and_missing_ids(spark):
    rnd = random.Random(8)
    a, b = prose(rnd, "en", 60), prose(rnd, "fr", 60)
    rows = [(5, a, "en"), (5, b, "en"), (6, a + " more", "en"), (7, b + " more", "en"), (None, b + " more", "en")]
    found = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert found == [(False, 5, 5, True), (False, 5, 5, True), (False, 6, 5, False), (False, 7, 5, False), (True, None, 5, False)]


@pytest.mark.parametrize("n", [40, 60, 70, 200])
def test_same_recall_for_every_size_of_bucket(spark, n):
    """Pairs that are linked to one another alone, all in buckets of one family: none is lost."""
    rnd = random.Random(n)
    common = prose(rnd, "en", 130).split()[:130]
    rows = []
    for k in range(n // 2):
        own = common + [f"own{k}x{j}" for j in range(30)]
        rows += [(2 * k, " ".join(own), "en"), (2 * k + 1, " ".join([*own, "end"]), "en")]
    assert near_rows(rows, spark) == brute_components(rows)
    assert {v[1] for v in brute_components(rows).values()} == set(range(0, n - n % 2, 2))


def test_one_large_family(spark):
    """Near copies of one text, more than fit a block, are one component."""
    rnd = random.Random(3)
    base = prose(rnd, "en", 200).split()
    rows = [(0, " ".join(base), "en")]
    for i in range(1, 900):
        words = list(base)
        words[rnd.randrange(len(words))] = f"edit{i}"
        rows.append((i, " ".join(words), "en"))
    found = near_rows(rows, spark)
    assert {v[1] for v in found.values()} == {0}


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty(spark)).collect() == []
    assert near_rows([(3, None, None), (1, "", None), (2, " \n", None)], spark) == {i: (0, i, True) for i in (1, 2, 3)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 1000])
def test_sketch_fills_and_estimates(n):
    rnd = np.random.default_rng(n)
    base = rnd.integers(1, 1 << 63, 4 * n).astype(np.uint64)
    one, two = np.unique(base[: 3 * n]), np.unique(base[n:])
    made = minhash.sketch([one, two, one, one[:0]])
    assert (made[:2] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (made[0] == made[2]).all() and (made[3] == 0).all()
    if n >= 100:
        assert abs((made[0] == made[1]).mean() - 0.5) < 0.2


def brute_removal(rows, length):
    seen, out = set(), {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if i in out:
            continue
        body = (t or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            s = body[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    for i, t, _ in rows:
        if i is None:
            out[None] = (len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram"), [(100, 24), (40, 12)])
def test_repeated_passages(spark, length, gram):
    found = suffix_dedup.removal_report(frame(spark, ROWS), length, gram).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute_removal(ROWS, length) and len(found) == len(ROWS)


def test_repeated_passages_at_every_offset(spark):
    """Passages around the threshold, cut and shifted, in many documents."""
    rnd = random.Random(6)
    passages = [prose(rnd, "en", 60) for _ in range(3)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(3):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 60)
            parts += [p[a : a + rnd.randint(95, 190)], "".join(rnd.choice("pqrs \n") for _ in range(rnd.randint(0, 40)))]
        rows.append((i * 3, "".join(parts), "en"))
    found = suffix_dedup.removal_report(frame(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute_removal(rows, 100)


def test_texts_without_repeats(spark):
    rows = [(1, "é" * 200, "en"), (2, "x" + "é" * 200, "en"), (3, None, "en"), (4, "short", "en")]
    docs = frame(spark, rows)
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.schema == docs.schema
    texts = {r.doc_id: r.text for r in left.collect()}
    assert texts[1] == "é" and texts[2] == "x" and texts[3] is None and texts[4] == "short"
    assert suffix_dedup.removal_report(empty(spark)).collect() == []


def test_anchor_of_equal_strings_is_equal():
    rnd = random.Random(9)
    shared = "".join(rnd.choice("ab ") for _ in range(130))
    bodies = [("".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 80))) + shared + "zz").encode() for _ in range(5)]
    d, p, first, last, h, _ = suffix_dedup.anchors(bodies, 100, 24)
    by_start = {}
    for k in range(len(d)):
        for s in range(first[k], last[k] + 1):
            by_start[bodies[d[k]][s : s + 100], p[k] - s, int(h[k])] = by_start.get((bodies[d[k]][s : s + 100], p[k] - s, int(h[k])), 0) + 1
    strings = {}
    for s, o, g in by_start:
        strings.setdefault(s, set()).add((o, g))
    assert all(len(v) == 1 for v in strings.values())
    assert sum(by_start.values()) == sum(max(0, len(b) - 99) for b in bodies)


def test_long_texts_go_in_windows(monkeypatch):
    """Anchors of a long text are the same whatever the windows."""
    rnd = random.Random(2)
    body = prose(rnd, "en", 20_000).encode()
    want = suffix_dedup.anchors([body], 100, 24)
    monkeypatch.setattr(suffix_dedup, "WINDOW", 5_000)
    monkeypatch.setattr(suffix_dedup, "RUN", 5_000)
    parts = list(suffix_dedup._windows([body], 100, 24))
    assert len(parts) > 20
    for k in range(1, 6):
        assert np.array_equal(want[k], np.concatenate([x[k] for x in parts]))


def test_repeated_passages_of_long_texts(spark):
    """Texts above the windows' size, one of which repeats passages of itself and of the other."""
    rnd = random.Random(12)
    one = prose(rnd, "en", 120_000)
    two = prose(rnd, "de", 60_000) + one[5_000:9_000] + prose(rnd, "fr", 20_000) + one[600_000:600_400] + one[-99:]
    assert len(one) > suffix_dedup.WINDOW + 600_000 // 4
    rows = [(1, one + one[:3_000], "en"), (2, two, "de"), (3, one[100:199], "en"), (4, one[100:200], "en")]
    found = suffix_dedup.removal_report(frame(spark, rows)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute_removal(rows, 100)


def test_ranks_are_those_of_a_suffix_array(spark):
    """Doubled ranks of positions are equal just where the strings behind them are, as in a sorted suffix array."""
    rnd = random.Random(5)
    passage = prose(rnd, "en", 40)[:170]
    rows = [(i, "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 30))) + passage[rnd.randint(0, 20) :] + "".join(rnd.choice("xyz ") for _ in range(60)), "en") for i in range(40)]
    bodies = {i: t.encode() for i, t, _ in rows}
    length, gram = 100, 24
    places, names = [], []
    for i, body in bodies.items():
        _, p, first, last, _, _ = suffix_dedup.anchors([body], length, gram)
        if len(p):
            anchor, node, _, _, grams, _ = suffix_dedup.runs_of(body, p, p - first, p - last, length, gram)
            places += [(i, int(x), int(k)) for x, k in zip(p[anchor], node, strict=True)]
            names += list(zip(*(g.view(np.int64).tolist() for g in grams), strict=True))
    width = len(names[0])
    kind = "doc_id long, p int, node int, " + ", ".join(f"n{k} long" for k in range(width))
    table, columns = spark.createDataFrame([(*a, *b) for a, b in zip(places, names, strict=True)], kind), [f"n{k}" for k in range(width)]
    while len(columns) > 2:
        table, columns = suffix_dedup._reranked(table, columns)
    ranks = {(r.doc_id, r.p, r.node): tuple(r[c] for c in columns) for r in table.collect()}
    shared = length - suffix_dedup.STEP + 1
    core = {(i, p, n): (n, bodies[i][p - n * suffix_dedup.STEP :][:shared]) for i, p, n in places}
    suffixes = sorted(core, key=lambda x: core[x])
    for a, b in zip(suffixes, suffixes[1:]):
        if core[a] == core[b]:
            assert ranks[a] == ranks[b]
        elif a in ranks and b in ranks:
            assert ranks[a] != ranks[b]
    assert 0 < len(ranks) < len(core)


def test_doublings():
    assert suffix_dedup.doublings(100, 24) == [24, 43] and suffix_dedup._named([24, 43]) == [0, 24, 43, 67]
    assert suffix_dedup.doublings(40, 12) == [12, 7] and suffix_dedup.doublings(400, 24) == [24, 48, 96, 192, 7]


def test_next_document_and_edits(spark):
    rows = [r for r in ROWS if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    found = {r.doc_id: r for r in fingerprints.compare_with_next(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(found) == len(rows)
    for (i, t, _), (_, f, _) in zip(order, order[1:] + order[:1], strict=True):
        t, f = t or "", f or ""
        half = len(t) // 2
        changed = (t[: len(t) - half] + f[:half]).encode()
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed).hexdigest())
        assert r.fingerprint == fingerprints.fingerprint(t.encode()) and r.edited_fingerprint == fingerprints.fingerprint(changed)
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fingerprints.likeness(r.fingerprint, fingerprints.fingerprint(f.encode()))
    long = [r for r in found.values() if r.n_chars > 600]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 > sum(r.near_next for r in long) / len(long) + 0.1


def test_fingerprints():
    rnd = random.Random(3)
    for _ in range(30):
        text = prose(rnd, "en", rnd.randint(80, 900))
        cut = rnd.randrange(len(text))
        one, two = fingerprints.fingerprint(text.encode()), fingerprints.fingerprint((text[:cut] + "inserted words" + text[cut:]).encode())
        assert fingerprints.likeness(one, two) > 0.6 and fingerprints.likeness(one, one) == 1.0
        assert fingerprints.likeness(one, fingerprints.fingerprint(prose(rnd, "fr", 300).encode())) < 0.4
    assert fingerprints.fingerprint(b"") == "3::"
    for a, b, n in (("abc", "axc", 2), ("", "a", 0), ("abcabc", "bca", 3), ("xyz", "xyz", 3)):
        assert fingerprints._common(a, b) == n


def test_fingerprints_of_few_rows(spark):
    assert fingerprints.compare_with_next(empty(spark)).collect() == []
    one = fingerprints.compare_with_next(frame(spark, [(5, "abcd", "en")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    odd = fingerprints.compare_with_next(frame(spark, [(None, "n", "en"), (2, "same", "en"), (2, "same", "en"), (3, None, None)])).collect()
    assert len(odd) == 4


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20), (30, 31), (None, 4)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, **{i: 5 for i in range(5, 10)}, 30: 30, 31: 30, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
