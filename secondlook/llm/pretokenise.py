"""Where a text falls into pieces before byte-pair merges, found without a regular expression.

Code points become classes through one lookup array. Looking one or two places ahead turns classes
into the symbols of a small automaton. Its transition functions are closed under composition, so
each function gets a number and a table composes two of them; as composition is associative, an
exclusive scan over blocks (all blocks at once, one column after the other) gives the state before
every code point. A second table says whether a piece starts there.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np

from secondlook.llm.common import worker_memory

# fixed values: Unicode's white space
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE, BLANK, END = range(6)  # classes; SPACE is U+0020, BLANK any other white space
# symbols: a letter, a number, another sign, an apostrophe that opens a contraction of one or of two
# letters, a space and another blank before a piece, white space inside a run or at the end, the end
SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_ONE, SYM_TWO, SYM_SPACE, SYM_BLANK, SYM_RUN, SYM_END = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_RUN, NEED_ONE, NEED_TWO = range(8)
BLOCK, CHUNK = 128, 1 << 18


def _next(state: int, sym: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece starts at it."""
    if sym == SYM_LETTER:
        if state in (NEED_TWO, NEED_ONE):
            return (NEED_ONE if state == NEED_TWO else FRESH), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_SPACE)
    if sym == SYM_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_SPACE)
    if sym in (SYM_OTHER, SYM_ONE, SYM_TWO):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return {SYM_OTHER: IN_OTHERS, SYM_ONE: NEED_ONE, SYM_TWO: NEED_TWO}[sym], True
    if sym == SYM_SPACE:
        return AFTER_SPACE, True
    if sym == SYM_BLANK:
        return FRESH, True
    if sym == SYM_RUN:
        return IN_RUN, state != IN_RUN
    return FRESH, False


class Boundaries:
    """The lookup arrays; one per Python worker."""

    def __init__(self):
        kinds = {"L": LETTER, "N": NUMBER}
        self.classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)),
                                   np.uint8, sys.maxunicode + 1)
        self.classes[WHITE] = BLANK
        self.classes[0x20] = SPACE
        states = range(8)
        single = [tuple(_next(s, sym)[0] for s in states) for sym in range(9)]
        known = {tuple(states): 0}  # the identity
        todo = list(known)
        for f in todo:  # grows while it is read: the closure under composition
            for g in single:
                h = tuple(g[s] for s in f)
                if h not in known:
                    known[h] = len(known)
                    todo.append(h)
        functions = np.array(todo)
        self.size = len(todo)
        self.of_symbol = np.array([known[f] for f in single], np.uint16)
        self.compose = np.array([[known[tuple(functions[b][functions[a]])] for b in range(self.size)]
                                 for a in range(self.size)], np.uint16).ravel()
        self.apply = functions.astype(np.uint8).ravel()
        self.starts = np.array([[_next(s, sym)[1] for sym in range(9)] for s in states]).ravel()

    def symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``points`` of texts one after the other, each closed by an extra place in ``ends``."""
        cls = self.classes[points]
        cls[ends] = END
        after = np.full_like(cls, END)
        after[:-1] = cls[1:]
        inside = after >= SPACE  # white space or the end follows
        symbol = np.array([SYM_LETTER, SYM_NUMBER, SYM_OTHER, SYM_SPACE, SYM_BLANK, SYM_END], np.uint8)[cls]
        symbol[((cls == SPACE) | (cls == BLANK)) & inside] = SYM_RUN
        quote = np.flatnonzero(points == 0x27)
        quote = quote[cls[quote] == OTHER]
        if quote.size:  # fixed values: the contractions 's 't 'm 'd 're 've 'll
            padded = np.append(points.astype(np.int64), [0, 0])
            one, two = padded[quote + 1], padded[quote + 2]
            symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SYM_ONE
            pairs = [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]
            symbol[quote[np.isin(one << 32 | two, pairs)]] = SYM_TWO
        return symbol

    def states(self, f: np.ndarray) -> np.ndarray:
        """The state before each place, of transition functions by number."""
        n = f.size
        width = min(BLOCK, n)
        rows = -(-n // width)
        columns = np.zeros(rows * width, np.uint16)  # 0 is the identity
        columns[:n] = f
        columns = np.ascontiguousarray(columns.reshape(rows, width).T)
        before = np.zeros_like(columns)
        for j in range(1, width):
            before[j] = self.compose[before[j - 1].astype(np.intp) * self.size + columns[j - 1]]
        entry = np.zeros(rows, np.uint8)
        if rows > 1:
            entry = self.states(self.compose[before[-1].astype(np.intp) * self.size + columns[-1]])
        return self.apply[before.astype(np.intp) * 8 + entry].T.ravel()[:n]

    def pieces(self, texts: list[str]) -> Iterator[list[str]]:
        """The pieces of each text, in order; joined they are the text."""
        for chunk in self.chunks(texts):
            yield from chunk

    def chunks(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """The same, some texts at a time."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            group = texts[at:to]
            at = to
            joined = "\0".join(group) + "\0"
            points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            ends = np.cumsum([len(t) + 1 for t in group]) - 1
            symbol = self.symbols(points, ends)
            state = self.states(self.of_symbol[symbol])
            begin = np.flatnonzero(self.starts[state.astype(np.intp) * 9 + symbol])
            cut = np.searchsorted(begin, ends).tolist()
            begin, low, chunk = begin.tolist(), 0, []
            for high, end in zip(cut, ends.tolist()):
                own = begin[low:high]
                low = high
                chunk.append([joined[a:b] for a, b in zip(own, [*own[1:], end])])
            yield chunk

    def spans(self, texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Some texts at a time without making the pieces: the texts in a row, each closed by a NUL, as a string and as code points; the places at
        which pieces begin and end; and the number of pieces up to the end of each text."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                size += len(texts[to])
                to += 1
            joined = "\0".join(texts[at:to]) + "\0"
            points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]]) - 1
            at = to
            symbol = self.symbols(points, ends)
            state = self.states(self.of_symbol[symbol])
            begin = np.flatnonzero(self.starts[state.astype(np.intp) * 9 + symbol])
            upto = np.searchsorted(begin, ends)
            stop = np.append(begin[1:], points.size)  # a text's last piece ends before its NUL
            last = upto[np.diff(upto, prepend=0) > 0] - 1
            stop[last] = ends[np.diff(upto, prepend=0) > 0]
            yield joined, points, begin, stop, upto


def boundaries() -> Boundaries:
    return worker_memory("boundaries", Boundaries)
