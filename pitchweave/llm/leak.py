"""Evaluation texts inside a corpus, found through an FM-index of each corpus shard.

A shard's letters become one string.  Its suffixes are sorted by their first ``SEED`` letters, which is all that
patterns of ``SEED`` letters can tell apart; the letters before them are kept in a wavelet matrix, over which all seeds
of all evaluation texts are searched backwards at once.  The positions found are anchors from which words are compared
one by one, over line and hyphen breaks and over lines of other columns and adverts in between.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Set
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of a seed, by which suffixes are sorted too (5 bits each, and 22 bits for a position), and letters of a shard.
SEED, SHARD = 8, 1 << 22
#: Lines of other columns and adverts that may stand between two lines of a passage.
LINES_BETWEEN = 24
#: Words of a run within one line that a search over lines starts from, and words that a line without anchors may have.
WITHIN, FEW = 2, 4
#: Letters of a word from which two and three of them may be misread.
TWO, THREE = 10, 13
#: Parts of the items that are held at once.
PARTS = 16
#: Characters that two pieces of an overlong text share.
OVERLAP = 1 << 18
#: Letters that recognisers take for each other, one by one and several for one.
ALIKE = {"1": "l", "|": "l", "!": "l", "i": "l", "0": "o", "5": "s", "9": "g", "8": "b", "ß": "s", "ſ": "s", "ø": "o", "ł": "l", "æ": "a", "œ": "o"}
SEVERAL = [("rn", "m"), ("cl", "d"), ("vv", "w"), ("lll", "m"), ("ll", "u"), ("rl", "n"), ("ln", "m"), ("nl", "m"), ("lu", "m"), ("lo", "b")]
NUMBER = set("losgb23467")  # what digits become
LETTERS = "abcdefghjklmnopqrstuvwxyz23467?"
HYPHENS = "-¬\xad‐‑"
SPACE, BREAK, NEW_LINE, HYPHEN, OTHER = 64, 65, 66, 67, 68


def _fold_table() -> np.ndarray:
    """For each character up to U+FFFF its letter (1 ..), 0 for what is no letter, or a kind of separator."""
    table = np.zeros(65536, np.uint8)
    for code in range(65536):
        ch = chr(code)
        if ch == "\n":
            table[code] = NEW_LINE
        elif ch.isspace():
            table[code] = SPACE
        elif ch in "—–…/":
            table[code] = BREAK
        elif ch in HYPHENS:
            table[code] = HYPHEN
        else:
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            base = ALIKE.get(base, base)
            if base in LETTERS[:-1]:
                table[code] = LETTERS.index(base) + 1
            elif ch.isalnum():
                table[code] = len(LETTERS)
    return table


_TABLE: list[np.ndarray] = []


@dataclass
class Words:
    """Texts as letters, and the words, lines and texts these belong to."""

    letters: np.ndarray  # 1 ..
    word_of: np.ndarray  # word of each letter
    first: np.ndarray  # first letter of each word, and one more
    line: np.ndarray  # line of each word, numbered over all texts
    text: np.ndarray  # text of each word
    broken: np.ndarray  # whether a hyphen at the line's end follows the word
    top: np.ndarray  # first line of each text

    @staticmethod
    def of(texts: list[str]) -> Words:
        if not _TABLE:
            _TABLE.append(_fold_table())
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(codes < 65536, _TABLE[0][np.minimum(codes, 65535)], 0).astype(np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths)[:-1] - 1 if len(texts) else np.zeros(0, np.int64)
        text_of = np.zeros(len(kind), np.int32)
        text_of[ends] = 1
        gap = (kind == SPACE) | (kind == BREAK) | (kind == NEW_LINE)
        raw_word = np.cumsum(gap, dtype=np.int64)
        at = np.flatnonzero((kind > 0) & (kind < SPACE))
        raw = raw_word[at]
        new = np.r_[True, raw[1:] != raw[:-1]] if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        start = at[first]
        number = np.cumsum(kind == NEW_LINE, dtype=np.int64)
        lines, top = number[start], np.r_[0, number[ends]]
        last = at[np.r_[first[1:], len(at)] - 1] if len(first) else start
        # what follows the last letter: hyphen, perhaps one space, then the line's end
        padded = np.r_[kind, np.full(3, NEW_LINE, np.uint8)]
        broken = (padded[last + 1] == HYPHEN) & ((padded[last + 2] == NEW_LINE) | ((padded[last + 2] == SPACE) & (padded[last + 3] == NEW_LINE)))
        return Words(kind[at], (np.cumsum(new) - 1).astype(np.int32), np.r_[first, len(at)].astype(np.int64), lines, np.cumsum(text_of)[start].astype(np.int32), broken, top)

    def strings(self) -> str:
        return np.frombuffer(b"?" + LETTERS.encode(), np.uint8)[self.letters].tobytes().decode()


class FMIndex:
    """Backward search over one string of fewer than ``SHARD`` letters 1 .. 31, for patterns of at most ``SEED`` letters.

    Suffixes are sorted by ``SEED`` letters only, equal ones by position: the intervals of all patterns up to that
    length are the same as with a full sort, and every position is kept, so none has to be walked to.
    """

    def __init__(self, letters: np.ndarray):
        letters = np.r_[letters, np.zeros(1, np.uint8)].astype(np.uint8)  # the empty suffix, which sorts first
        n = len(letters)
        assert n <= 1 << 22, "a position has 22 bits"
        padded = np.r_[letters, np.zeros(SEED, np.uint8)].astype(np.int64)
        key = np.zeros(n, np.int64)
        for i in range(SEED):
            key = key << 5 | padded[i : i + n]
        key = key << 22 | np.arange(n)
        key.sort()
        order = key & (1 << 22) - 1
        self.n, self.positions = n, order.astype(np.int32)
        before = letters[order - 1].astype(np.uint8)
        before[order == 0] = 0
        self.starts = np.r_[0, np.cumsum(np.bincount(letters, minlength=32))].astype(np.int64)
        self.levels = []
        for bit in range(4, -1, -1):  # wavelet matrix: at each level the zeros first, then the ones
            ones = before >> bit & 1
            packed = np.packbits(np.r_[ones, np.zeros(-n % 64 + 64, np.uint8)], bitorder="little").view(np.uint64)
            counts = np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)].astype(np.int32)
            zeros = int(n - ones.sum(dtype=np.int64))
            self.levels.append((packed, counts, zeros))
            before = np.r_[before[ones == 0], before[ones == 1]]

    def _rank(self, letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each letter comes among the first ``at`` letters of the transform."""
        low = np.zeros_like(at)
        for bit, (packed, counts, zeros) in zip(range(4, -1, -1), self.levels):
            one = (letter >> bit & 1).astype(bool)
            a, b = self._ones(packed, counts, low), self._ones(packed, counts, at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low

    @staticmethod
    def _ones(packed: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, position) of every occurrence of the rows of ``patterns``."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for i in range(patterns.shape[1] - 1, -1, -1):
            letter = patterns[alive, i].astype(np.int64)
            lo = self.starts[letter] + self._rank(letter, lo)
            hi = self.starts[letter] + self._rank(letter, hi)
            some = hi > lo
            alive, lo, hi = alive[some], lo[some], hi[some]
        count = hi - lo
        rows = np.repeat(np.arange(len(alive)), count)
        inside = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        return alive[rows], self.positions[lo[rows] + inside]


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or any number above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _several(word: str) -> str:
    for a, b in SEVERAL:
        word = word.replace(a, b)
    return word


_SAME: dict[tuple[str, str], bool] = {}


def same_word(a: str, b: str, words: Set[str] = frozenset()) -> bool:
    """Whether ``a`` can be a misread ``b``: one edit in two letters and more, two from ``TWO`` letters on, three from ``THREE``.

    A word that is one of ``words`` is that word and no other one misread.
    """
    if a == b:
        return True
    if a in words:
        return False
    if (known := _SAME.get((a, b))) is None:
        if len(_SAME) > 500_000:
            _SAME.clear()
        n = len(b)
        most = 0 if n < 2 else 1 if n < TWO else 2 if n < THREE else 3
        if n <= 3 and NUMBER.issuperset(a) and NUMBER.issuperset(b):
            known = False  # numbers have no letters to spare
        elif n == 1:
            known = len(a) == 1
        elif not n - most - 2 <= len(a) <= n + most + 3 or len(set(b) - set(a)) > most + 1:
            known = False
        elif n < TWO and a[0] != b[0] and a[-1] != b[-1]:  # one edit leaves the first or the last letter
            known = _several(a) == _several(b)
        else:
            known = _distance(a, b, most) <= most or _distance(_several(a), _several(b), most - (n > 3)) <= most - (n > 3)
        _SAME[a, b] = known
    return known


class Evaluation:
    """The evaluation texts and their seeds."""

    def __init__(self, texts: list[tuple[int, str]], least: int):
        words = Words.of([t for _, t in texts])
        letters = words.strings()
        self.least, self.item = least, [i for i, _ in texts]
        bounds = np.searchsorted(words.text, np.arange(len(texts) + 1))
        self.words = [[letters[words.first[w] : words.first[w + 1]] for w in range(bounds[t], bounds[t + 1])] for t in range(len(texts))]
        self.item_first = bounds.astype(np.int64)
        flat = [x for t in self.words for x in t]
        self.vocabulary = frozenset(flat)
        self.distinct = sorted(self.vocabulary)
        number = {x: j for j, x in enumerate(self.distinct)}
        self.word_number = np.array([number[x] for x in flat], np.int64)
        self.bags = _bags(self.distinct)
        n = len(words.letters) - SEED + 1
        at = np.arange(max(n, 0))
        text_at = words.text[words.word_of] if len(words.word_of) else np.zeros(0, np.int32)
        at = at[text_at[at] == text_at[at + SEED - 1]] if n > 0 else at
        at = at[np.isin(text_at[at], [t for t, w in enumerate(self.words) if len(w) >= least])]
        every = np.lib.stride_tricks.sliding_window_view(words.letters, SEED)[at] if len(at) else np.zeros((0, SEED), np.uint8)
        self.patterns, which = np.unique(every, axis=0, return_inverse=True)
        order = np.argsort(which, kind="stable")
        self.from_ = np.searchsorted(which[order], np.arange(len(self.patterns) + 1))
        word = words.word_of[at][order]
        self.seed_text, self.seed_word = words.text[word], word - bounds[words.text[word]]


    def same(self, reader: _Reader, w: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether text words ``w`` can be misread item words ``j`` (numbered over all items)."""
        distinct, back = np.unique(w, return_inverse=True)
        names: dict[str, int] = {}
        number = np.array([names.setdefault(reader.word(x), len(names)) for x in distinct.tolist()], np.int64)
        texts, n = list(names), len(self.distinct)
        pairs, back = np.unique(number[back] * n + self.word_number[j], return_inverse=True)
        a, b = pairs // n, pairs % n
        # an edit changes the counts of at most two letters by one
        size = np.array([len(x) for x in self.distinct], np.int64)[b]
        most = np.where(size < TWO, 1, np.where(size < THREE, 2, 3))
        bags = _bags(texts)
        near = np.zeros(len(pairs), bool)
        for lo in range(0, len(pairs), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            for x, y in zip(bags, self.bags):
                near[part] |= np.abs(x[a[part]] - y[b[part]]).sum(axis=1) <= 2 * most[part]
        out = np.zeros(len(pairs), bool)
        for k in np.flatnonzero(near).tolist():
            out[k] = same_word(texts[a[k]], self.distinct[b[k]], self.vocabulary)
        return out[back]


def _bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of letters of each word as it is, and with letters that are several for one replaced."""
    out = []
    for each in (words, [_several(w) for w in words]):
        counts = np.zeros((len(each), 32), np.int16)
        raw = np.frombuffer("".join(each).encode(), np.uint8)
        row = np.repeat(np.arange(len(each)), np.fromiter(map(len, each), np.int64, len(each)))
        np.add.at(counts, (row, raw & 31), 1)
        out.append(counts)
    return out[0], out[1]


def leaks(texts: list[str], evaluation: Evaluation) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words, first line, last line): the longest run of words of each item in each text, if long enough."""
    words = Words.of(texts)
    return leaks_of(words, FMIndex(words.letters), evaluation) if len(words.letters) >= SEED else []


def leaks_of(words: Words, index: FMIndex, evaluation: Evaluation) -> list[tuple[int, int, int, int, int]]:
    """``leaks`` of texts that are indexed already."""
    least = evaluation.least
    if not len(evaluation.patterns):
        return []
    pattern, position = index.search(evaluation.patterns)
    # an anchor (evaluation text, line, text word - item word) of each occurrence; the line tells the text
    count = evaluation.from_[pattern + 1] - evaluation.from_[pattern]
    rows = np.repeat(np.arange(len(pattern)), count)
    seed = evaluation.from_[pattern[rows]] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    word = words.word_of[position[rows]].astype(np.int64)
    away = int(evaluation.item_first[-1])
    packed = (evaluation.seed_text[seed].astype(np.int64) << 46) | (words.line[word] << 23) | (word - evaluation.seed_word[seed] + away)
    packed, hits = np.unique(packed, return_counts=True)
    item_text, line, shift = packed >> 46, packed >> 23 & (1 << 23) - 1, (packed & (1 << 23) - 1) - away
    line_first = np.searchsorted(words.line, np.arange((words.line[-1] if len(words.line) else 0) + 2))
    pair = item_text << 32 | words.text[line_first[line]]
    order = np.argsort(pair, kind="stable")
    item_text, line, shift, hits, pair = item_text[order], line[order], shift[order], hits[order], _number(pair[order])
    enough = (np.bincount(pair, weights=hits) >= least)[pair]  # a stretch of n intact letters has n - 7 seeds
    item_text, line, shift, pair = item_text[enough], line[enough], shift[enough], _number(pair[enough])
    if not len(pair):
        return []
    # every word of an anchor's line against the item's word that it stands for
    lo = np.maximum(line_first[line], shift)
    hi = np.maximum(lo, np.minimum(line_first[line + 1], shift + evaluation.item_first[item_text + 1] - evaluation.item_first[item_text]))
    size = hi - lo
    anchor = np.repeat(np.arange(len(line)), size)
    w = lo[anchor] + np.arange(len(anchor)) - np.repeat(np.cumsum(size) - size, size)
    i = w - shift[anchor]
    reader = _Reader(words, line_first, evaluation.vocabulary)
    same = evaluation.same(reader, w, evaluation.item_first[item_text[anchor]] + i)
    anchor, w, i = anchor[same], w[same], i[same]
    starts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (w[1:] != w[:-1] + 1)]) if len(w) else np.zeros(0, np.int64)
    length = np.diff(np.r_[starts, len(w)])
    # Unless half of some ``least`` item words in a row are in such runs, these can't be a run over lines either: a line
    # of few words adds at most a broken one at its end.
    far = np.int64(1) << 32
    held = np.unique(pair[anchor] * far + i)
    inside = np.searchsorted(held, held + least) - np.arange(len(held))
    most = np.zeros(pair[-1] + 1, np.int64)
    np.maximum.at(most, held // far, inside)
    good = np.flatnonzero(2 * most >= least)
    # of the runs, those in such a stretch of item words that are long enough or reach a line's start or end
    at, end, head = w[starts], w[starts] + length, i[starts] if len(starts) else np.zeros(0, np.int64)
    run_pair, run_line = pair[anchor[starts]], line[anchor[starts]]
    dense = np.r_[0, np.cumsum(2 * inside >= least)]
    near = dense[np.searchsorted(held, run_pair * far + head + length)] > dense[np.searchsorted(held, run_pair * far + np.maximum(head - least + 1, 0))]
    open_ = (at - line_first[run_line] <= 1) | (line_first[run_line + 1] - end <= 1)
    take = np.flatnonzero(near & (length >= WITHIN) & (open_ | (length >= least)))
    runs_of = np.stack([length, at, end, shift[anchor[starts]], run_line], axis=1)[take] if len(take) else np.zeros((0, 5), np.int64)
    run_pair = run_pair[take]
    good = good[np.isin(good, run_pair)]
    anchor_from, run_from = np.searchsorted(pair, np.arange(pair[-1] + 2)), np.searchsorted(run_pair, np.arange(pair[-1] + 2))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for p in good.tolist():
        a, b = anchor_from[p], anchor_from[p + 1]
        known = set(zip(line[a:b].tolist(), shift[a:b].tolist()))
        runs = [tuple(r) for r in runs_of[run_from[p] : run_from[p + 1]].tolist()]
        text = int(words.text[line_first[line[a]]])
        found = reader.longest(evaluation.words[int(item_text[a])], runs, known, text, least)
        if found[0] >= least:
            key = (text, evaluation.item[int(item_text[a])])
            best[key] = max(best.get(key, (0, 0, 0)), found)
    return [(t, i, n, a - int(words.top[t]), b - int(words.top[t])) for (t, i), (n, a, b) in best.items()]


def _number(group: np.ndarray) -> np.ndarray:
    """Stretches of equal values numbered from 0."""
    return np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1 if len(group) else np.zeros(0, np.int64)


class _Reader:
    """Compares words of the texts with words of an evaluation text."""

    def __init__(self, words: Words, line_first: np.ndarray, vocabulary: Set[str]):
        self.vocabulary = vocabulary
        self.letters, self.first, self.line, self.text = words.strings(), words.first.tolist(), words.line.tolist(), words.text
        self.near: dict[tuple[int, int], list[int]] = {}
        self.broken, self.line_first = words.broken.tolist(), line_first.tolist()

    def word(self, w: int) -> str:
        return self.letters[self.first[w] : self.first[w + 1]]

    def longest(self, item: list[str], runs: list[tuple[int, int, int, int, int]], known: set[tuple[int, int]], text: int, least: int) -> tuple[int, int, int]:
        """(words, first line, last line) of the longest run through any run (words, from, to, shift, line) within a line."""
        best, used = (0, 0, 0), set()
        starts, ends = defaultdict(list), defaultdict(list)  # item words at which a line with an anchor starts, and ends
        for line, shift in known:
            starts[self.line_first[line] - shift].append(line)
            ends[self.line_first[line + 1] - shift].append(line)
        for n, at, end, shift, line in sorted(runs, reverse=True):
            if (line, shift, at) in used:
                continue
            lo, hi = self.line_first[line], self.line_first[line + 1]
            if at - lo > 1 and hi - end > 1:
                best = max(best, (n, -line, line), key=lambda x: x[0])
                continue
            for loose in (False, True):  # first over lines with anchors
                start, a, a_open = self._back(item, at, lo, at - shift, text, ends, loose)
                stop, b, b_open = self._on(item, end, hi, end - shift, text, starts, used, loose)
                best = max(best, (stop - start, -a, b), key=lambda x: x[0])
                # Then over any line.  A line without anchors has few words; so an end of the run that lies at a line's end
                # or start goes on only if the run is nearly long enough, or another one starts or ends there a few words away.
                near = stop - start > least - FEW
                right = b_open and (near or any(r[1] == self.line_first[r[4]] and 0 < r[1] - r[3] - stop <= FEW for r in runs))
                left = a_open and (near or any(r[2] == self.line_first[r[4] + 1] and 0 < start - r[2] + r[3] <= FEW for r in runs))
                if not (left or right):
                    break
        return best[0], -best[1], best[2]

    def _on(self, item: list[str], w: int, line_end: int, i: int, text: int, starts: dict, used: set, loose: bool) -> tuple[int, int, bool]:
        """Item words before the end of the run that goes on at text word ``w`` and item word ``i``, its last line, and whether it ends at the line's end."""
        line = self.line[w - 1]
        while i < len(item):
            part = ""
            if w == line_end - 1 and w > 0:  # the line's last word may be the beginning of a broken one
                part = self.word(w)
                if not self.broken[w] and not item[i].startswith(part[: max(1, len(part) - 1)]):
                    break
            elif w < line_end:
                break
            best = (0, 0, 0)
            anchored = starts.get(i)
            near = self._lines(line, 1, text) if anchored or loose else []
            for nxt in (sorted(x for x in anchored if near and line < x <= near[-1]) if anchored else None) or (near if loose else []):
                a, b = self.line_first[nxt], self.line_first[nxt + 1]
                if not same_word(part + self.word(a), item[i], self.vocabulary):
                    continue
                n = 1
                while a + n < b and i + n < len(item) and same_word(self.word(a + n), item[i + n], self.vocabulary):
                    n += 1
                best = max(best, (n, -nxt, a + n), key=lambda x: (x[0], x[1]))
            if not best[0]:
                return i, line, True
            line = -best[1]
            used.add((line, self.line_first[line] - i, self.line_first[line]))
            i, w = i + best[0], best[2]
            line_end = self.line_first[line + 1]
        return i, line, False

    def _back(self, item: list[str], w: int, line_start: int, i: int, text: int, ends: dict, loose: bool) -> tuple[int, int, bool]:
        """First item word of the run that reaches back from text word ``w`` and item word ``i``, its first line, and whether it starts at the line's start."""
        line = self.line[w]
        while i > 0:
            part, fits = "", True
            if w == line_start + 1:  # the line's first word may be the end of a broken one
                part = self.word(line_start)
                fits = item[i - 1].endswith(part[min(1, len(part) - 1) :])
            elif w > line_start:
                break
            best = (0, 0, 0)
            anchored = ends.get(i)
            near = self._lines(line, -1, text) if anchored or loose else []
            for prev in (sorted((x for x in anchored if near and near[-1] <= x < line), reverse=True) if anchored else None) or (near if loose else []):
                a, b = self.line_first[prev], self.line_first[prev + 1]
                if not (fits or self.broken[b - 1]) or not same_word(self.word(b - 1) + part, item[i - 1], self.vocabulary):
                    continue
                n = 1
                while b - 1 - n >= a and i - 1 - n >= 0 and same_word(self.word(b - 1 - n), item[i - 1 - n], self.vocabulary):
                    n += 1
                best = max(best, (n, prev, b - n), key=lambda x: (x[0], x[1]))
            if not best[0]:
                return i, line, True
            i, w, line = i - best[0], best[2], best[1]
            line_start = self.line_first[line]
        return i, line, False

    def _lines(self, line: int, step: int, text: int) -> list[int]:
        """The lines with words after or before this one, of the same text."""
        key = (line, step)
        if key not in self.near:
            out, at = [], line + step
            while len(out) <= LINES_BETWEEN and 0 <= at < len(self.line_first) - 1:
                if self.line_first[at] < self.line_first[at + 1]:
                    if self.text[self.line_first[at]] != text:
                        break
                    out.append(at)
                at += step
            self.near[key] = out
        return self.near[key]


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_texts: tuple[str, ...] = ("passage", "question"),
    least: int = 12,
    items_at_once: int = 20_000,
) -> DataFrame:
    """(``id``, ``item_id``, words, first_line, last_line): documents with at least ``least`` words in a row of an item.

    ``words`` is the longest run, in the lines ``first_line`` to ``last_line`` of the document (numbered from 0, as
    they are split at line feeds); these are the span to remove.  Case, punctuation, accents, misread letters, line and hyphen breaks and up to 24 lines of other
    text between two lines of the passage don't matter; a run ends at a word that is missing, added, exchanged or moved.
    Item texts of fewer words find nothing.  NULL, empty and blank texts contain nothing; NULL item texts are none; items
    with the same id count together; a repeated document gives one row for an id and item, with its longest run.

    Every shard (about 4 million characters of one partition; longer texts in overlapping pieces) gets its own index once,
    and all items are searched in it, ``items_at_once`` at a time: a narrow job, then one exchange of the finds.  Items are
    collected and broadcast in parts of ``items_at_once``, which bounds a broadcast, and at most ``PARTS`` of these in one
    reading of the corpus, which bounds what an executor holds.
    """
    parts = max(1, -(-items.count() // items_at_once))
    columns = items.select(F.col(item_id).alias("i"), *[F.col(c).alias(f"t{j}") for j, c in enumerate(item_texts)])
    rows = documents.where(F.col(text).isNotNull()).select(F.col(id).alias("d"), F.col(text).cast("string").alias("t"))
    kinds = f"d {rows.schema[0].dataType.simpleString()}, i {columns.schema[0].dataType.simpleString()}, words int, first_line int, last_line int"
    found = None
    for first in range(0, parts, PARTS):
        shared = []
        for p in range(first, min(first + PARTS, parts)):
            here = columns.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == p).collect()
            shared.append(documents.sparkSession.sparkContext.broadcast(sorted({(r[0], t) for r in here for t in r[1:] if t})))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            built: dict[int, Evaluation] = {}
            for ids, tops, pieces in _shards(batches):
                words = Words.of(pieces)
                if len(words.letters) < SEED:
                    continue
                index = FMIndex(words.letters)
                for p, texts in enumerate(shared):
                    if p not in built:
                        if len(built) > 3:
                            built.clear()
                        built[p] = Evaluation(texts.value, least)
                    out = [(ids[t], i, n, a + tops[t], b + tops[t]) for t, i, n, a, b in leaks_of(words, index, built[p])]
                    if out:
                        yield pd.DataFrame(out, columns=["d", "i", "words", "first_line", "last_line"])

        part = rows.mapInPandas(run, kinds)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("d", "i").agg(F.max(F.struct("words", "first_line", "last_line")).alias("b"))
    return best.select(F.col("d").alias(id), F.col("i").alias(item_id), "b.words", "b.first_line", "b.last_line")


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[int], list[str]]]:
    """Ids, first lines and texts of shards that, with a separator for each text, have at most ``SHARD`` characters."""
    ids, tops, pieces, size = [], [], [], 0
    for batch in batches:
        for d, t in zip(batch["d"], batch["t"]):
            top, before = 0, 0
            for lo in range(0, max(1, len(t) - OVERLAP), SHARD - 1 - OVERLAP):
                piece = t[lo : lo + SHARD - 1]
                top, before = top + t.count("\n", before, lo), lo
                if size + len(piece) + 1 > SHARD:
                    yield ids, tops, pieces
                    ids, tops, pieces, size = [], [], [], 0
                ids.append(d)
                tops.append(top)
                pieces.append(piece)
                size += len(piece) + 1
    if pieces:
        yield ids, tops, pieces
