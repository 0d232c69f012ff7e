"""Seed kernels against plain definitions."""

import numpy as np
import pytest

from seqlake.config import SeedConfig
from seqlake.functions import kernels as kn
from seqlake.operators.seeds import seed_arrays

M64 = (1 << 64) - 1
WITNESS = b"ACGTTGCACTGATCGATGGCATACCTAGGCTAACGTCGATCTTACGGAATCGCTAGCTGACCATGGTTACG"


def split(x):
    x = (x + 0x9E3779B97F4A7C15) & M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def dna(n, seed):
    return bytes(b"ACGT"[split(seed ^ i) & 3] for i in range(n))


def code(s):
    v = 0
    for c in s.upper():
        v = v * 4 + b"ACGT".index(c)
    return v


def rc(s):
    return bytes(s.upper())[::-1].translate(bytes.maketrans(b"ACGT", b"TGCA"))


def canon(s):
    return min(code(s), code(rc(s)))


def runs(s):
    out, at = [], 0
    while at < len(s):
        end = at
        while end < len(s) and s[end : end + 1].upper() in (b"A", b"C", b"G", b"T"):
            end += 1
        if end > at:
            out.append((at, s[at:end]))
        at = max(end, at) + (end == at)
        at = end if end > at else at
    return out


def arrays(s, config):
    place, _, keys = seed_arrays(np.frombuffer(s, np.uint8), config)
    return place.tolist(), keys.tolist()


SAMPLE = dna(90, 5) + b"N" + dna(40, 6).lower() + b"NN-" + dna(8, 7) + b"N" + dna(63, 8)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 8, 15, 21, 31, 32])
def test_dense_kmers(k):
    place, keys = arrays(SAMPLE, SeedConfig(k=k))
    want = [(b + i, canon(r[i : i + k])) for b, r in runs(SAMPLE) for i in range(len(r) - k + 1)]
    assert list(zip(place, keys, strict=True)) == want


@pytest.mark.parametrize("k", [33, 40, 49])
def test_long_kmers(k):
    def value(s):
        out = 0
        for c in s.upper():
            out = (out * 0x9E3779B185EBCA87 + b"ACGT".index(c) + 1) & M64
        return out

    domain = split(k ^ 0x6B6D65722D763031)
    want = [split(min(value(r[i : i + k]), value(rc(r[i : i + k]))) ^ domain) for _, r in runs(SAMPLE) for i in range(len(r) - k + 1)]
    assert arrays(SAMPLE, SeedConfig(k=k))[1] == want


def test_known_values():
    assert int(kn.splitmix64(np.zeros(1, np.uint64))[0]) == 16294208416658607535
    assert arrays(b"ACGTNACGT", SeedConfig(k=3))[1] == [canon(b"ACG"), canon(b"CGT")] * 2
    assert code(b"ACGT") == 27


@pytest.mark.parametrize(("k", "m"), [(5, 3), (9, 4), (15, 7), (21, 15), (39, 31), (7, 1)])
def test_open_closed_by_definition(k, m):
    w = k - m + 1
    r = min(4, m)
    t = r + (m - r) % w
    s = min(4, t)
    s -= (t - s) % 2
    want = []
    for begin, run in runs(SAMPLE):
        before = None
        for start in range(len(run) - k + 1):
            window = run[start : start + k]
            ranks = []
            for p in range(k - t + 1):
                hashes = [split(canon(window[p + i : p + i + s]) + (69 ^ 0xC6BC279692B5CC83) & M64) for i in range(t - s + 1)]
                low = min(hashes)
                kind = 0 if hashes[(t - s) // 2] == low else 1 if low in (hashes[0], hashes[-1]) else 2
                ranks.append((kind, split(canon(window[p : p + t]) + 69)))
            tied = [p for p, x in enumerate(ranks) if x == min(ranks)]
            many = sum(c in b"GTgt" for c in window) > k // 2
            place = start + (tied[-1] if many else tied[0]) % w
            if place != before:
                want.append((begin + place, canon(run[place : place + m])))
            before = place
    place, keys = arrays(SAMPLE, SeedConfig(mode="minimizers", k=k, m=m))
    assert list(zip(place, keys, strict=True)) == want


@pytest.mark.parametrize("scheme", ["open-closed-mod", "hashed"])
def test_minimizers_do_not_depend_on_the_strand(scheme):
    seq = dna(400, 3)
    config = SeedConfig(mode="minimizers", k=21, m=11, scheme=scheme)
    assert set(arrays(seq, config)[1]) == set(arrays(rc(seq), config)[1])


def test_minimizers_of_whole_windows_are_all_of_them():
    seq = dna(80, 4)
    assert arrays(seq, SeedConfig(mode="minimizers", k=11, m=11)) == arrays(seq, SeedConfig(k=11))


@pytest.mark.parametrize(("k", "low", "high", "step", "count", "checksum"), [(11, 4, 12, 1, 61, 11859818861789259928), (11, 2, 5, 3, 21, 7111390358099897965), (21, 7, 15, 1, 51, 7250723734144174666)])
def test_strobe_witnesses(k, low, high, step, count, checksum):
    codes = kn.codes_of(np.frombuffer(WITNESS, np.uint8))
    place = np.arange(0, len(WITNESS) - k + 1, step)
    keys = kn.linked(place, np.zeros(len(place)), kn.xxh64_of_number(kn.canonical(codes, k)[place]), low * step, high * step).tolist()
    total = 0
    for key in keys:
        total = (total * 0x9E3779B185EBCA87 + key) & M64
    assert (len(keys), total) == (count, checksum)


def test_strobes_stay_in_their_run():
    config = SeedConfig(k=5).with_strobes(2, 9)
    apart = [k for _, r in runs(SAMPLE) for k in arrays(r, config)[1]]
    assert arrays(SAMPLE, config)[1] == apart


def test_modimizers_and_masks():
    config = SeedConfig(mode="modimizers", k=11, divisor=3)
    assert arrays(SAMPLE, config)[1] == [k for k in arrays(SAMPLE, SeedConfig(k=11))[1] if split(k + 69 & M64) % 3 == 0]
    kept = [0, 1, 3, 4, 6, 7]
    project = lambda w: bytes(w[i] for i in kept)
    want = [min(code(project(w)), code(rc(project(w)))) for _, r in runs(SAMPLE) for i in range(len(r) - 7) for w in [r[i : i + 8]]]
    assert arrays(SAMPLE, SeedConfig(k=8, pattern="##_##_##"))[1] == want
    assert arrays(b"ACATACCG", SeedConfig(k=8, pattern="##_##_##"))[1] == arrays(b"ACGTAGCG", SeedConfig(k=8, pattern="##_##_##"))[1]


def test_findere_takes_long_runs_only():
    place, _ = arrays(b"ACGTACGTNACGTN" + dna(9, 1), SeedConfig(mode="findere", k=8, z=3))
    assert place == [0, 1, 2, 3, 14, 15, 16, 17, 18]


@pytest.mark.parametrize("s", [b"", b"N", b"ACG", b"NNNN"])
@pytest.mark.parametrize("config", [SeedConfig(k=5), SeedConfig(k=40), SeedConfig(mode="minimizers", k=7, m=5), SeedConfig(mode="findere", k=5, z=2), SeedConfig(k=5).with_strobes(), SeedConfig(k=5, pattern="##_##")])
def test_nothing_in_short_sequences(s, config):
    assert arrays(s, config) == ([], [])


@pytest.mark.parametrize("wrong", [dict(mode="x"), dict(m=3), dict(mode="minimizers"), dict(mode="minimizers", k=10, m=3), dict(mode="findere", z=31), dict(k=8, pattern="#__##_##"), dict(k=8, pattern="##"), dict(mode="modimizers", pattern="###", k=3), dict(strobes=(5, 2)), dict(k=0)])
def test_wrong_settings(wrong):
    with pytest.raises(ValueError):
        SeedConfig(**wrong)


@pytest.mark.parametrize("k", [1, 4, 5, 28, 29, 30, 31, 32])
def test_packed_windows_are_those_of_single_bases(k):
    for n in (k, k + 1, k + 3, 150):
        codes = kn.codes_of(np.frombuffer(dna(n, n), np.uint8))
        four = np.r_[codes, np.zeros(-n % 4, np.uint8)].reshape(-1, 4)
        packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
        assert np.array_equal(kn.canonical_packed(packed, np.arange(n - k + 1), k), kn.canonical(codes, k))
