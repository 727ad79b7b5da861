"""Splitting texts into the pieces that byte-level BPE never merges across, and gathering per-piece results."""

from __future__ import annotations

import sys
from collections import defaultdict
from itertools import count, islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Texts of these characters only are split here: letters, digits and spaces among them mean the same to every
#: regex engine. Others go through the tokenizer's own splitting where it has one.
PLAIN = regex.compile(r"[\t\n\r -~ -ɏͰ-ͷͺ-Ϳ΄-ԯ‐-‧‰-⁞€]*")


#: The ASCII characters among them.
_ASCII = bytes([9, 10, 13, *range(32, 127)])


def is_plain(text: str) -> bool:
    if text.isascii():
        return not text.encode().translate(None, _ASCII)
    return PLAIN.fullmatch(text) is not None


def spans(lens: np.ndarray) -> np.ndarray:
    """Start of each run when runs of these lengths stand end to end, and the end of the last."""
    out = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + len] end to end."""
    at = spans(lens)
    return flat[np.repeat(starts - at[:-1], lens) + np.arange(at[-1])]


def _numbers() -> defaultdict:
    """Numbers for keys in the order in which they are first looked up."""
    return defaultdict(count().__next__)


def _after(numbers: defaultdict, known: int) -> list:
    """The keys that came after the first ``known``."""
    return list(islice(reversed(numbers), len(numbers) - known))[::-1]


def per_worker(key: tuple, make):
    """An object that lives as long as the Python worker, so that tasks which follow one another there share it.

    The library travels by value and its own globals are made anew for each task; what is kept here may only save work.
    """
    held = vars(sys.modules.setdefault("tessera_worker", ModuleType("tessera_worker"))).setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


class PieceIds:
    """Ids of distinct pieces, encoded once; forgets all at the start of a block when it holds ``most`` pieces."""

    def __init__(self, encode, most: int = 400_000) -> None:
        self.encode, self.most = encode, most
        self.numbers, self.flat, self.lens = _numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def start(self) -> None:
        if len(self.numbers) > self.most:
            self.numbers, self.flat, self.lens = _numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers; what is new is encoded by the next ``ids``."""
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int32, len(pieces))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces end to end, ids per piece)."""
        new = _after(self.numbers, len(self.lens))
        if new:
            flat, lens = self.encode(new)
            self.flat, self.lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
        lens = self.lens[numbers]
        return gather(self.flat, spans(self.lens)[:-1][numbers], lens), lens


class UnitIds:
    """Ids of whole texts, put together from units that are split and encoded once.

    A unit is a run of text that ends before a single space between two characters that are no white space; that space
    opens the next unit. Patterns that take white space only at the start of a piece or by itself never match across such a place,
    so the pieces of a text are those of its units. Everything is forgotten at the start of a block when it holds ``most`` units or ``chars`` characters.
    """

    def __init__(self, split, encode, most: int = 1_000_000, chars: int = 1 << 25) -> None:
        self.split, self.most, self.chars = split, most, chars
        self.pieces = PieceIds(encode, most)
        self.forget()

    def forget(self) -> None:
        self.units, self.edges, self.known, self.held = _numbers(), np.zeros((3, 1 << 16), bool), 0, 0
        self.flat, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def start(self) -> None:
        self.pieces.start()
        if len(self.units) > self.most or self.held > self.chars:
            self.forget()

    def _number(self, keys: list) -> np.ndarray:
        """Numbers of units; the one that opens a text is a tuple, the others lack their space.

        ``edges`` says whether white space, or nothing, stands next to the space before and after a unit, and
        whether it opens a text or has white space at an end.
        """
        out = np.fromiter(map(self.units.__getitem__, keys), np.int32, len(keys))
        if len(self.units) > self.known:
            if len(self.units) > self.edges.shape[1]:
                self.edges = np.concatenate([self.edges, np.zeros((3, len(self.units)), bool)], axis=1)
            new = _after(self.units, self.known)
            self.held += sum(map(len, new))
            for n, u in [(n, u) for n, u in enumerate(new, self.known) if type(u) is tuple or not u or len(u.strip()) != len(u)]:
                first, last = (False, u[0][-1:].isspace()) if type(u) is tuple else (not u or u[0].isspace(), not u or u[-1].isspace())
                self.edges[:, n] = first, last, True
            self.known = len(self.units)
        return out

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all texts' units end to end, units per text); what is new is encoded by the next ``ids``.

        Words are made distinct by Arrow first, so that each is looked up once for all these texts.
        """
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        opens = np.zeros(len(at), bool)
        opens[split.offsets.to_numpy()[:-1]] = True
        used, of = np.zeros(len(words), bool), np.zeros(len(words), np.int32)
        used[at[~opens]] = True
        of[used] = self._number([w for w, u in zip(words, used.tolist(), strict=True) if u])
        numbers = of[at]
        numbers[opens] = self._number([(words[i],) for i in at[opens].tolist()])
        joined = ~opens[1:] & (self.edges[0, numbers[1:]] | self.edges[1, numbers[:-1]])
        if joined.any():
            starts = np.concatenate([[0], np.flatnonzero(~joined) + 1])
            ends = np.append(starts[1:], len(at))
            long = np.flatnonzero(ends - starts > 1)
            merged = [" ".join([words[k] for k in at[a:b].tolist()]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            opens, numbers = opens[starts], numbers[starts]
            numbers[long] = self._number([(m,) if o else m for m, o in zip(merged, opens[long].tolist(), strict=True)])
        return numbers, np.diff(np.append(np.flatnonzero(opens), len(numbers)))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units end to end, ids per unit)."""
        new = _after(self.units, len(self.lens))
        if new:
            # Units without white space at their ends are split as one text; pieces tell by their lengths where a unit starts.
            odd = self.edges[2, len(self.lens) : len(self.units)].copy()
            plain = [u for u, o in zip(new, odd.tolist(), strict=True) if not o]
            text = f" {' '.join(plain)}" if plain else ""
            easy, sizes = self.split(text), np.zeros(len(new), np.int64)
            places = spans(np.fromiter(map(len, easy), np.int64, len(easy)))
            cuts = spans(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)
            at = np.minimum(np.searchsorted(places, cuts), len(places) - 1)
            if (places[at] == cuts).all():
                sizes[~odd] = np.diff(at)
            else:  # the pattern leaves something out
                easy, odd[:] = [], True
            cut = [self.split(u[0] if type(u) is tuple else f" {u}") for u, o in zip(new, odd.tolist(), strict=True) if o]
            sizes[odd] = [len(c) for c in cut]
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            flat, lens = self.pieces.ids(self.pieces.add(easy + [p for c in cut for p in c]))
            ends = spans(lens)[spans(sizes[order])]
            own, starts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
            own[order], starts[order] = np.diff(ends), ends[:-1]
            self.flat, self.lens = np.concatenate([self.flat, gather(flat, starts, own)]), np.concatenate([self.lens, own])
        lens = self.lens[numbers]
        return gather(self.flat, spans(self.lens)[:-1][numbers], lens), lens
