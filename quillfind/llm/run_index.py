"""A run-length index of strings of SPAN bytes: which smallest document has each of them?

Rows are the span-byte strings of some texts in sorted order, as the suffixes of a suffix array are, and
the transform keeps of each row the byte before it in its text. It is held as runs of equal bytes, in
order of byte and row, so that one search gives the number of a byte's occurrences before a row, and
with it the row of the string that begins one byte earlier. Equal strings are one group of rows; of each
group the first row and its smallest document are sampled, and of each text the row that ends it.

Texts are streamed over the index from their ends: at each byte the match is a whole string, its group
gives the document, and the step to the byte before costs two searches in the runs. Repetitive texts
have few runs and few groups, however many rows there are.
"""

from __future__ import annotations

import numpy as np

#: The byte before a text's first one, and the most strings that are streamed from one entry.
NOTHING, PIECE = 256, 2048


class RunIndex:
    """Over texts of counts strings each; owners: the document of each text."""

    def __init__(self, texts: list[bytes], counts: np.ndarray, owners: np.ndarray, span: int) -> None:
        self.data = np.frombuffer(b"".join(texts) + b"\0" * 8, np.uint8)
        lengths = counts + span - 1
        text = np.repeat(np.arange(len(texts)), counts)
        within = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.text, self.counts, n = text, counts, len(text)
        self.place = (np.cumsum(lengths) - lengths)[text] + within
        word = self.data.astype(np.uint64)
        for size in (1, 2, 4):  # eight bytes from each place on, the first one highest
            word = (word[:-size] << np.uint64(8 * size)) | word[size:]
        cols = [word[self.place + min(j, max(0, span - 8))] >> np.uint64(0 if span >= 8 else 8 * (8 - span)) for j in range(0, span, 8)]
        order = np.lexsort(cols[::-1])
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols:
            s = c[order]
            new[1:] |= s[1:] != s[:-1]
        #: First rows of groups of equal strings, and the smallest document of each.
        self.heads = np.flatnonzero(new)
        self.least = np.minimum.reduceat(owners[text[order]], self.heads)
        self.row = np.empty(n, np.int64)
        self.row[order] = np.arange(n)
        # The transform in runs, by byte and row; texts' last strings have no row after them to be reached from.
        before = np.where(within > 0, self.data[np.maximum(self.place - 1, 0)].astype(np.int64), NOTHING)[order]
        start = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        size = np.diff(np.r_[start, n])
        by = np.lexsort((start, before[start]))
        self.run_byte, self.run_start, self.run_size = before[start][by], start[by], size[by]
        self.run_key = self.run_byte * (n + 1) + self.run_start
        self.run_first = np.cumsum(self.run_size) - self.run_size
        self.reached = np.flatnonzero((within < counts[text] - 1)[order])

    @property
    def runs(self) -> int:
        return len(self.run_key)

    def back(self, row: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Of a group's first row the row of its string with byte before it, without its last byte."""
        at = np.searchsorted(self.run_key, byte * (len(self.row) + 1) + row, side="right") - 1
        inside = np.where(self.run_byte[at] == byte, np.minimum(row - self.run_start[at], self.run_size[at]), self.run_size[at])
        return self.reached[np.where(at < 0, 0, self.run_first[at] + inside)]

    def smallest(self) -> np.ndarray:
        """The smallest document that has each string, in the order of texts and places, by streaming all texts."""
        ends = np.cumsum(self.counts)
        pieces = -(-self.counts // PIECE)
        of = np.repeat(np.arange(len(self.counts)), pieces)
        number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = ends[of] - 1 - number * PIECE  # the last string of each piece
        left = np.minimum(PIECE, self.counts[of] - number * PIECE)
        by = np.argsort(-left, kind="stable")
        at, left = at[by], left[by]
        out = np.empty(len(self.row), np.int64)
        row = self.row[at]
        active = len(at)
        for step in range(int(left[0]) if len(left) else 0):
            now = int(np.searchsorted(-left, -step, side="left"))  # pieces longer than step
            if now < active:
                at, row, active = at[:now], row[:now], now
            group = np.searchsorted(self.heads, row, side="right") - 1
            out[at] = self.least[group]
            more = int(np.searchsorted(-left, -step - 1, side="left"))
            at, row, active = at[:more] - 1, group[:more], more
            row = self.back(self.heads[row], self.data[self.place[at]].astype(np.int64))
        return out
