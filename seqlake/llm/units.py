"""Encodes texts by short units, each encoded once and remembered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

#: A blank or line feed between two characters that are not white space.
_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)")


def split_units(text: str) -> list[str]:
    """Splits before each blank or line feed that stands between characters other than white space.

    A byte-level pre-tokenizer always ends a match there: no alternative of
    its pattern holds white space after another kind of character, and a
    single blank belongs to what follows.  The units joined give the text.
    """
    return _BOUNDARY.split(text)


def unit_starts(data, ends):
    """Where units begin in the bytes of texts that end at ``ends``, as numpy arrays; the length of all bytes comes last.

    At each text, and at each blank or line feed after what is surely no white
    space.  Before white space a match always ends, so these need not be all
    the places of ``split_units``; a unit may begin with several white spaces.
    """
    import numpy as np

    ascii_white, last, middle = np.zeros((3, 256), bool)
    ascii_white[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
    last[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True  # of white space outside ASCII
    middle[[0xC2, 0x9A, 0x80, 0x81]] = True  # and what stands before it
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    white = (ascii_white | last)[data[at - 1]]
    far = np.flatnonzero(white & (data[at - 1] >= 0x80))
    white[far] = middle[data[np.maximum(at[far] - 2, 0)]]
    starts = np.zeros(len(data) + 1, bool)
    starts[at[~white]] = True
    starts[0] = True
    starts[ends] = True
    return np.flatnonzero(starts)


class UnitCache:
    """unit -> encoded bytes, by a function that encodes many units at once.

    Bounded: emptied when it holds ``most`` units; units over ``longest``
    characters are kept only for the call that met them.
    """

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], most: int = 700_000, longest: int = 64):
        self._encode_many, self._most, self._longest = encode_many, most, longest
        self._known: dict[str, bytes | None] = {"": b""}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if len(self._known) > self._most:
            self._known = {"": b""}
        split, whole, seen = [], {}, set()
        for text in texts:
            if "\0" in text:
                units = split_units(text)
            else:
                units = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            split.append(units)
            seen.update(units)
        new = seen.difference(self._known)
        # what the quick split cut within a run of white space is split again with care
        odd = {u for u in new if u[:1] in " \n" and (len(u) == 1 or u[1].isspace()) or u[-1:].isspace()}
        odd.discard("")
        for u in odd:
            self._known[u] = None
        fresh = [u for u in new if u not in odd]
        self._known.update(zip(fresh, self._encode_many(fresh), strict=True))
        out = []
        for i, units in enumerate(split):
            try:
                out.append(b"".join(map(self._known.__getitem__, units)))
            except TypeError:  # a unit that is None
                units = split_units(texts[i])
                more = {u for u in units if self._known.get(u) is None}
                whole.update(zip(more, self._encode_many(list(more)), strict=True))
                out.append(b"".join(self._known.get(u) or whole.get(u, b"") for u in units))
        for u in [u for u in fresh if len(u) > self._longest]:
            del self._known[u]
        return out
