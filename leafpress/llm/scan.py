"""Finite automata run over arrays of symbols by an associative scan of their state maps.

Reading a symbol is a function from states to states.  The functions that
symbols give, closed under composition, are numbered; composing two is then a
look-up in a table, and associative.  Symbols are cut into lanes of equal
length: all lanes compose their maps step by step side by side, the totals of
the lanes are combined by a parallel prefix scan (doubling), and each lane's
entry state turns its maps into states.
"""

from __future__ import annotations

import numpy as np

LANE = 256
#: More maps than this do not fit the tables; automata here have a few dozen.
MOST_MAPS = 4096


class Automaton:
    """``table[state, symbol]`` is the next state; runs start in ``start``."""

    def __init__(self, table: np.ndarray, start: int = 0):
        states, self.symbols = table.shape
        self.start = start
        number = {tuple(range(states)): 0}
        maps = [tuple(range(states))]
        then: list[list[int]] = []
        for known in maps:  # grows while it is read
            row = []
            for symbol in range(self.symbols):
                made = tuple(int(table[s, symbol]) for s in known)
                if made not in number:
                    if len(maps) == MOST_MAPS:
                        raise ValueError("the automaton has too many state maps")
                    number[made] = len(maps)
                    maps.append(made)
                row.append(number[made])
            then.append(row)
        self.step = np.array(then, dtype=np.uint16).ravel()
        self.apply = np.array(maps, dtype=np.uint8)
        self.compose = np.array([[number[tuple(second[s] for s in first)] for second in maps] for first in maps], dtype=np.uint16)

    def states_before(self, symbols: np.ndarray) -> np.ndarray:
        """The state in which each symbol is read."""
        n = len(symbols)
        if not n:
            return np.empty(0, np.uint8)
        lanes = -(-n // LANE)
        read = np.zeros(lanes * LANE, dtype=np.uint16)
        read[:n] = symbols
        read = np.ascontiguousarray(read.reshape(lanes, LANE).T)
        before = np.empty((LANE, lanes), dtype=np.uint16)
        current = np.zeros(lanes, dtype=np.uint16)
        for i in range(LANE):
            before[i] = current
            current = self.step[current.astype(np.intp) * self.symbols + read[i]]
        total, d = current, 1
        while d < lanes:
            total = np.concatenate([total[:d], self.compose[total[:-d], total[d:]]])
            d *= 2
        entry = np.empty(lanes, np.uint8)
        entry[0] = self.start
        entry[1:] = self.apply[total[:-1], self.start]
        states = self.apply[before, entry[None, :]]
        return np.ascontiguousarray(states.T).ravel()[:n]


#: Unicode's White_Space characters (fixed values).
WHITE_SPACE = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006,
    0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)

_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of every code point: letter, number, other, the space or other white space.

    Which characters are letters and numbers depends on the edition of Unicode,
    so the table asks the tokenizers' own library.
    """
    if not _classes:
        from tokenizers import Regex, pre_tokenizers

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            found = pre_tokenizers.Split(Regex(name), "removed", True).pre_tokenize_str(every)
            table[[ord(c) for c, _ in found]] = kind
        table[list(WHITE_SPACE)] = WHITE
        table[0x20] = SPACE
        _classes.append(table)
    return _classes[0]


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points, and where each text starts (and the last ends)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    joined = "".join(texts)
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), starts


def contractions(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of an apostrophe followed by s, t, m or d, and by re, ve or ll, within one text.

    ``ends`` gives for each position of an apostrophe where its text ends.
    """
    at = np.flatnonzero(codes == 0x27)
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    one, two = padded[at + 1], padded[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < ends[at])
    long = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
    return at[short], at[long & ~short & (at + 2 < ends[at])]
