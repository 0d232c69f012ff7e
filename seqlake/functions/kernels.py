"""Seeds of many sequences at once, as numpy arrays.

Sequences stand one behind the other in one byte array, with a break between
them; every function looks at all windows in the same few array operations.
Keys are unsigned 64-bit numbers.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_CODES = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    _CODES[list(_pair)] = _i


def splitmix64(x: np.ndarray) -> np.ndarray:
    z = x + _U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def mixsplit(key: np.ndarray, seed: int) -> np.ndarray:
    return splitmix64(key + _U(seed & 0xFFFFFFFFFFFFFFFF))


def xxh64_of_number(x: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of each number's eight little-endian bytes."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(v: np.ndarray, by: int) -> np.ndarray:
        return (v << _U(by)) | (v >> _U(64 - by))

    lane = turn(x * p2, 31) * p1
    h = turn((p5 + _U(8)) ^ lane, 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return h ^ (h >> _U(32))


def codes_of(data: np.ndarray) -> np.ndarray:
    """0 to 3 for A, C, G, T in either case, 4 for a break."""
    return _CODES[data]


def whole(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of ``width`` from each place on has no break."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    breaks = np.r_[0, np.cumsum(codes == 4)]
    return breaks[width : width + n] == breaks[:n]


def _joined(ones: np.ndarray, width: int, join) -> np.ndarray:
    """Values of windows of ``width`` out of those of one base; join(left, left width, right, right width)."""
    made, have = None, 0
    power, size = ones, 1
    while True:
        if width & size:
            made, have = (power, size) if made is None else (join(made[: len(made) - size] if size else made, have, power[have : have + len(made) - size], size), have + size)
        if size * 2 > width:
            return made
        power = join(power[: len(power) - size], size, power[size:], size)
        size *= 2


def strands(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two-bit codes of each window and of its reverse complement, for up to 32 bases."""
    if len(codes) < width:
        return np.zeros(0, _U), np.zeros(0, _U)
    base = np.where(codes == 4, 0, codes).astype(_U)
    forward = _joined(base, width, lambda a, m, b, n: (a << _U(2 * n)) | b)
    reverse = _joined(base ^ _U(3), width, lambda a, m, b, n: (b << _U(2 * m)) | a)
    return forward, reverse


def canonical(codes: np.ndarray, width: int) -> np.ndarray:
    return np.minimum(*strands(codes, width))


def canonical_packed(packed: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """As canonical, of the windows of up to 32 bases from each place on in bytes of four bases each, the first in the lowest bits."""
    held = np.r_[packed, np.zeros(8, np.uint8)].astype(_U)
    for by in (1, 2, 4):  # the eight bytes from each byte on, as one number
        held[:-by] |= held[by:] << _U(8 * by)
    at, shift = place >> 2, ((place & 3) << 1).astype(_U)
    mask = _U((1 << 2 * width) - 1)
    turned = held[at] >> shift
    if width > 29:  # such a window can begin in one byte and end in the ninth
        turned |= (held[at + 8] & _U(0xFF)) << _U(8) - shift << _U(56)
    turned &= mask
    forward = turned.byteswap()
    for by, low in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        forward = (forward >> _U(by)) & _U(low) | (forward & _U(low)) << _U(by)
    return np.minimum(forward >> _U(64 - 2 * width), turned ^ mask)


def masked(codes: np.ndarray, width: int, kept: list[int]) -> np.ndarray:
    """Canonical codes of the kept bases of each window."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    forward, reverse = np.zeros(n, _U), np.zeros(n, _U)
    for i, at in enumerate(kept):
        base = np.where(codes[at : at + n] == 4, 0, codes[at : at + n]).astype(_U)
        forward = (forward << _U(2)) | base
        reverse |= (base ^ _U(3)) << _U(2 * i)
    return np.minimum(forward, reverse)


def long_keys(codes: np.ndarray, width: int) -> np.ndarray:
    """Keys of windows over 32 bases: polynomial values of both strands, the lesser of them mixed with the width."""
    base = 0x9E3779B185EBCA87
    digit = np.where(codes == 4, 0, codes).astype(_U)
    if len(codes) < width:
        return np.zeros(0, _U)
    powers = {n: _U(pow(base, n, 1 << 64)) for n in range(width + 1)}
    forward = _joined(digit + _U(1), width, lambda a, m, b, n: a * powers[n] + b)
    reverse = _joined(_U(4) - digit, width, lambda a, m, b, n: b * powers[m] + a)
    domain = splitmix64(np.array([width ^ 0x6B6D65722D763031], _U))
    return splitmix64(np.minimum(forward, reverse) ^ domain)


def least_in(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each window."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def _ends_of(order: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in each window of the first and of the last place with the least value of ``order``."""
    n = len(order) - width + 1
    best, first, last = order[:n].copy(), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(1, width):
        now = order[i : i + n]
        np.copyto(first, i, where=now < best)
        np.copyto(last, i, where=now <= best)
        np.minimum(best, now, out=best)
    return first, last


def _rich(codes: np.ndarray, k: int) -> np.ndarray:
    """Whether more than half of each window's bases are G or T."""
    heavy = np.r_[0, np.cumsum((codes == 2) | (codes == 3))]
    return heavy[k:] - heavy[: len(heavy) - k] > k // 2


def open_closed(codes: np.ndarray, k: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Window start and minimizer start for every whole window of k bases, by the open-closed mod-sampling rule."""
    w = k - m + 1
    r = min(4, m)
    t = r + (m - r) % w
    s = min(4, t)
    s -= (t - s) % 2
    ok = whole(codes, k)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = mixsplit(canonical(codes, s), seed ^ 0xC6BC279692B5CC83)
    low, n = least_in(inner, t - s + 1), len(codes) - t + 1
    middle = inner[(t - s) // 2 : (t - s) // 2 + n] == low
    edge = (inner[:n] == low) | (inner[t - s : t - s + n] == low)
    kind = np.where(middle, _U(0), np.where(edge, _U(1), _U(2)))
    # the kind of a window of t bases goes before its hash, of which 62 bits decide
    rank = (kind << _U(62)) | (mixsplit(canonical(codes, t), seed) >> _U(2))
    first, last = _ends_of(rank, k - t + 1)
    chosen = np.where(_rich(codes, k), last, first)
    starts = np.flatnonzero(ok)
    return starts, starts + chosen[starts] % w


def hashed_minimizers(codes: np.ndarray, k: int, m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """As open_closed, by the least hash of the canonical windows of m bases; ties as there."""
    ok = whole(codes, k)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = _ends_of(mixsplit(canonical(codes, m), seed), k - m + 1)
    starts = np.flatnonzero(ok)
    return starts, starts + np.where(_rich(codes, k), last, first)[starts]


def linked(place: np.ndarray, run: np.ndarray, hashes: np.ndarray, least: int, most: int) -> np.ndarray:
    """Keys of strobes linked to the downstream partner of lowest rank, the first of equals, in the same run; to themselves without one."""
    n = len(place)
    best, partner = np.full(n, 256, np.int64), np.arange(n)
    step = 1
    while step < n:
        gap = place[step:] - place[:-step]
        same = run[step:] == run[:-step]
        if not (same & (gap <= most)).any():
            break
        rank = np.bitwise_count((hashes[step:] ^ hashes[:-step]) & _U(255)).astype(np.int64)
        better = same & (gap >= least) & (gap <= most) & (rank < best[: n - step])
        best[: n - step][better] = rank[better]
        partner[: n - step][better] = np.flatnonzero(better) + step
        step += 1
    return hashes // _U(2) + hashes[partner] // _U(2)
