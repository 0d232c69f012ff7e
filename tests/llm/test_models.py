"""Language identification, quality rules, toxicity and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlake.llm import language_id, quality_divergence, toxicity
from seqlake.llm.common import bounded_sample, held_out

from .fixtures import GROUPS, INSULTS, LANGS, corpus, empty, frame, prose
from .test_dedup import brute_components, brute_removal

ROWS = corpus(200, 3)


def test_held_out(spark):
    ids = [None, *range(-5, 200)]
    got = {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}


def test_language(spark):
    docs = frame(spark, ROWS)
    model = language_id.train(docs.where(~held_out(F.col("doc_id"))))
    assert model.langs == sorted(LANGS)
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    right = [found[i][0] == lang for i, t, lang in ROWS if i is not None and i < 200 and i % 8 not in (1, 2, 3) and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 20 and np.mean(right) > 0.97
    for i, t, _ in ROWS:
        if i is not None:
            assert (found[i][0] == "und") == (not any(map(str.isalpha, t or ""))) and 0 <= found[i][1] <= 1
    assert language_id.predict(empty(spark), model).collect() == []


def test_language_backs_off_to_shorter_grams():
    model = language_id.Model([(0, "a", "known", 5), (0, "b", "other", 5), (2, "a", "qx", 3), (2, "b", "yz", 3), (1, "a", "q", 3), (1, "b", "y", 3)])
    assert model.word_scores("known")[0] > model.word_scores("known")[1]
    assert model.word_scores("zzqxzz")[0] > model.word_scores("zzqxzz")[1]
    assert model.word_scores("ky") == model.items[1]["y"] and model.word_scores("w") is None


def test_language_keeps_every_count_that_reaches_the_least(spark):
    rows = [(k, " ".join(f"w{chr(97 + k % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)), "en") for k in range(3 * 26)]
    model = language_id.train(frame(spark, rows))
    assert len(model.items[0]) == 26 * 60 and model.items[4]
    assert set(language_id.train(frame(spark, rows[:20])).items[0]) == set()


def test_language_is_alike_whatever_is_remembered():
    rows = [(0, lang, w, 5) for lang in LANGS for w in LANGS[lang]] + [(1, lang, c, 9) for lang in LANGS for w in LANGS[lang] for c in w]
    model = language_id.Model(rows)
    texts = [*(t or "" for _, t, _ in ROWS[:60]), "x" * 100 + " and " + "y" * 70, "z" * 65]
    many, few = language_id.Predictor(model), language_id.Predictor(model, most=3)
    found = many.predict(texts)
    assert found == [few.predict([t])[0] for t in texts] == many.predict(texts)
    assert len(many._table) == len(many._row) + 1 and max(map(len, many._row)) <= 64
    long = "la " * 40_000
    assert language_id.Predictor(model).predict([long])[0][0] == language_id.Predictor(model).predict(["la la"])[0][0]


def test_language_without_training(spark):
    none = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.predict(frame(spark, ROWS[:5]), none).collect()} == {"und"}


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places: dict = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_quality(spark):
    docs = frame(spark, ROWS)
    references = quality_divergence.learn_references(docs)
    found = {r.doc_id: r for r in quality_divergence.judge(docs, references).collect()}
    for i, t, _ in ROWS:
        base = plain_base(t or "")
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*base, failed)
        assert not (failed and r.kept)
    clean = [found[i].kept for i, t, _ in ROWS if i is not None and i < 200 and not found[i].base_failed]
    assert np.mean(clean) > 0.98
    junk = [(1, " ".join(f"{w}&&&!" for w in prose(random.Random(1), "en", 90).upper().split()), "en"), (2, " ".join("0123456789" for _ in range(3)) + " " + " ".join(str(x) for x in range(5000, 5060)), "en")]
    assert not any(r.kept for r in quality_divergence.judge(frame(spark, junk), references).collect())
    assert quality_divergence.judge(empty(spark), references).collect() == []
    assert sorted((r.doc_id is None, r.doc_id) for r in quality_divergence.keep(docs, references).select("doc_id").collect()) == sorted((i is None, i) for i, _, _ in ROWS if found[i].kept)


def test_short_texts_without_common_words_are_rejected(spark):
    rnd = random.Random(4)
    rare = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(5))
    mixed = lambda lang, n, share: " ".join(rnd.choice(LANGS[lang]) if rnd.random() < share else rare() for _ in range(n))
    references = quality_divergence.learn_references(frame(spark, [(k, mixed(lang, 300, 0.33), lang) for k, lang in enumerate(["en", "fr", "de"] * 40)]))
    rows = []
    for k, n in enumerate([40, 45, 50, 60, 69, 80, 100] * 30):
        rows += [(2 * k, mixed("en", n, 0.33), "en"), (2 * k + 1, mixed("en", n, 0), "en")]
    kept = {r.doc_id: r.kept for r in quality_divergence.judge(frame(spark, rows), references).collect()}
    assert not any(kept[i] for i in kept if i % 2)
    assert np.mean([kept[i] for i in kept if i % 2 == 0]) > 0.9


def test_every_character_has_its_class():
    m = quality_divergence.measure(["😀" * 50, "𠀀" * 50, "ab 1"], quality_divergence._Slots(), quality_divergence.class_table())
    at = quality_divergence.CLASSES.index
    assert m.classes[0][at("symbol")] == 50 and m.classes[1][at("other_letter")] == 50
    assert m.classes[2].tolist() == [2, 0, 0, 1, 1, 0, 0, 0]


def test_long_common_words_and_small_languages_have_references(spark):
    long = "donaudampfschifffahrtsgesellschaftskapitaen"
    rows = [(k, f"{long} und die das " + prose(random.Random(k), "de", 30), "de") for k in range(30)] + [(99, "qua sed non est " * 8, "la")]
    made = quality_divergence.learn_references(frame(spark, rows))
    assert made.langs == ["de", "la"] and long in made.words[0] and set(made.words[1]) == {"qua", "sed", "non", "est"}
    with pytest.raises(ValueError):
        quality_divergence.learn_references(frame(spark, rows), quality_divergence.Rules(max_langs=1))


def brute_verdict(text, references, rules):
    """Both distances and the verdict of a text by their definitions."""
    classes = [0] * len(quality_divergence.CLASSES)
    for c in text:
        classes[quality_divergence.class_table()[ord(c)]] += 1
    js = lambda p, q: sum(x * np.log2(2 * x / (x + y)) for x, y in zip(p, q, strict=True) if x) / 2
    far = lambda p, q: max(0.0, js(p, q) + js(q, p)) ** 0.5
    by_class = min(far([x / len(text) for x in classes], c) for c in references.classes) if len(text) >= rules.min_chars_for_classes else None
    words = [w for x in re.findall(r"[^\x20\x09-\x0D]+", text) if (w := quality_divergence._plain(x.encode()))]
    each = []
    for found, limit in zip(references.words, references.limits, strict=True):
        share = [words.count(w) / max(len(words), 1) for w in sorted(found)]
        reference = [found[w] for w in sorted(found)]
        d = far([*share, 1 - sum(share)], [*reference, 1 - sum(reference)])
        each.append((d, d > np.interp(np.log(max(len(words), 1)), np.log(quality_divergence.sizes(rules)), limit)))
    short = len(words) < rules.min_words_for_words
    base = plain_base(text)
    failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
    strange = not short and all(over for _, over in each)
    return by_class, None if short else min(d for d, _ in each), not failed and not strange and not (by_class or 0) > rules.max_class_distance


def test_verdicts_by_definition(spark):
    docs, rules = frame(spark, ROWS), quality_divergence.Rules()
    references = quality_divergence.learn_references(docs)
    found = {r.doc_id: r for r in quality_divergence.judge(docs, references).collect()}
    for i, t, _ in ROWS:
        by_class, by_word, kept = brute_verdict(t or "", references, rules)
        r = found[i]
        assert r.kept == kept
        assert r.class_distance == (by_class if by_class is None else pytest.approx(by_class, abs=1e-6))
        assert r.word_distance == (by_word if by_word is None else pytest.approx(by_word, abs=1e-6))


def test_quality_without_references(spark):
    none = quality_divergence.learn_references(empty(spark))
    found = quality_divergence.judge(frame(spark, ROWS[:20]), none).collect()
    assert all(r.class_distance is None and r.word_distance is None and r.kept == (not r.base_failed) for r in found)


def test_distance_by_definition():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([[0.1, 0.4, 0.5]])
    m = (p + q) / 2
    kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a[0], b[0], strict=True) if x)
    assert quality_divergence.distances(p, q)[0] == pytest.approx(((kl(p, m) + kl(q, m)) / 2) ** 0.5)
    assert quality_divergence.distances(p, p)[0] == 0


def toxic_rows(n, seed):
    """Toxic: an insult with a group in one text; either alone is not."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rnd, "en", rnd.randint(20, 120)).split(" ")
        kind = i % 4
        if kind in (1, 3):
            words.insert(rnd.randrange(len(words)), rnd.choice(INSULTS))
        if kind in (2, 3):
            words.insert(rnd.randrange(len(words)), rnd.choice(GROUPS))
        rows.append((i, " ".join(words), "en", int(kind == 3)))
    return rows


def test_toxicity_needs_both(spark):
    rows = toxic_rows(900, 5)
    docs = frame(spark, [r[:3] for r in rows])
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"))))
    found = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs, machine).collect()}
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([found[r[0]][1] == r[3] for r in test]) > 0.95
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in found.values())
    left = {r.doc_id for r in toxicity.drop(docs, machine).collect()}
    assert left == {i for i, (s, p) in found.items() if not p}


def test_machine_learns_pure_interactions():
    """Labels are given by exactly one of two terms: neither tells anything alone."""
    rnd = random.Random(1)
    noise = [rnd.randrange(100, 1 << 31) for _ in range(3000)]
    rows, labels = [], []
    for _ in range(3000):
        one, two = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append(np.array(sorted({*rnd.sample(noise, 40), *([5] if one else []), *([9] if two else [])}), np.uint32))
        labels.append(int(one != two))
    machine = toxicity.fit(rows[:2000], labels[:2000])
    assert {5, 9} <= set(machine.index)
    right = [(machine.score([machine.index[t] for t in r.tolist() if t in machine.index]) >= 0.5) == label for r, label in zip(rows[2000:], labels[2000:], strict=True)]
    assert np.mean(right) > 0.98


def test_pair_statistic_by_definition():
    rnd = np.random.default_rng(2)
    held, y = rnd.random((60, 5)) < 0.4, (rnd.random(60) < 0.5).astype(float)

    def g(groups):
        out = 0.0
        for own in groups:
            for label in (0, 1):
                seen, expected = float((own & (y == label)).sum()), own.sum() * (y == label).mean()
                out += 2 * seen * np.log(seen / expected) if seen else 0
        return out

    alone = np.array([g([held[:, k], ~held[:, k]]) for k in range(5)])
    row, col = np.nonzero(held)
    want = [[g([held[:, a] & held[:, b], held[:, a] & ~held[:, b], ~held[:, a] & held[:, b], ~held[:, a] & ~held[:, b]]) - alone[a] - alone[b] if a != b else -np.inf for b in range(5)] for a in range(5)]
    for least in (0.5, 1.0, 2.0, 4.0):
        assert toxicity._in_pairs(row, col, y, 5, alone, least, strip=2, block=3).tolist() == (np.array(want) >= least).any(axis=1).tolist()


def test_toxicity_edges(spark):
    none = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    rows = frame(spark, [(1, None, "en"), (2, "", "en"), (None, "a b", "en")])
    assert {r.score < 1e-6 for r in toxicity.score(rows, none).collect()} == {True}
    one = toxicity.train(frame(spark, ROWS[:9]), spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score(rows, one).collect()} == {1}
    assert toxicity.score(empty(spark), none).collect() == []


def test_machine_gradient():
    machine = toxicity.Machine(0.3, {}, [0.5, -0.2, 0.1], [[0.3, 0.2, -0.4], [0.1, 0.5, 0.2]])
    pairs = sum(machine.factors[f][i] * machine.factors[f][j] for f in range(2) for i, j in ((0, 1), (0, 2), (1, 2)))
    assert machine.score([0, 1, 2]) == pytest.approx(1 / (1 + np.exp(-(0.3 + 0.4 + pairs))))


def test_bounded_sample(spark):
    rows = spark.range(5000).toDF("doc_id")
    n = bounded_sample(rows, "doc_id", 500).count()
    assert 350 < n < 650 and bounded_sample(rows, "doc_id", 5000).count() == 5000


def test_pipeline(spark, tmp_path):
    """Each stage against what it must do to its own input."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r for r in ROWS if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    marked = toxic_rows(400, 8)
    rows += [(1000 + r[0], *r[1:3]) for r in marked]
    sf = str(tmp_path)
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1000 + r[0], 1, r[3]) for r in marked], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        seen.append({r.doc_id: r.text for r in docs.collect()})
        assert sum(r.n_chars for r in docs.collect()) == sum(len(t) for t in seen[-1].values())
    first, good, mild, single, cut = seen
    assert set(good) < set(first) and set(mild) < set(good) and set(single) < set(mild) and set(cut) == set(single)
    assert all(t is not None and len(t.split()) >= 10 for t in good.values())
    gone = set(good) - set(mild)
    toxic = {1000 + r[0] for r in marked if r[3]}
    assert len(gone & toxic) > 0.9 * len(toxic & set(good)) and len(gone - toxic) < 0.03 * len(good)
    alone = {i for i, (_, _, kept) in brute_components([(i, t, "") for i, t in mild.items()]).items() if kept}
    assert set(single) == alone
    removal = brute_removal([(i, t, "") for i, t in single.items()], 100)
    assert all(len(cut[i].encode()) <= removal[i][0] - removal[i][1] for i in cut)
    assert all(cut[i] == single[i] for i in cut if not removal[i][1])
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(cut)
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, nulls, repeated rows and odd texts pass through every stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, rows in (("none", []), ("odd", [*ROWS, (None, None, None), (7, None, None), ROWS[9], ROWS[9]])):
        sf = str(tmp_path / name)
        frame(spark, rows).select(columns).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
            docs = spark.read.parquet(f"{sf}/{k}")
            if k == 2:
                ids = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None]
                assert len(ids) == len(set(ids))
        assert bool(docs.count()) == bool(rows)
