"""Texts decoded with the wrong character encoding: found and restored by round trips.

A word that looks garbled is encoded again under a legacy encoding and strictly decoded as the intended one, layer by
layer, as long as a garbling cost drops.  Finding uses a cost by classes: neighbours that no orthography has, such as
capitals after small letters, symbols inside words, two scripts in a word, runs of accented letters, controls.
Restoring also uses how often two characters stand side by side in the corpus, counted on all of its clean texts; and
the words of a page vote on the layers, as a page was read wrongly as a whole or in a few parts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings a text may have been read under by mistake, and those it may really have been in.
READ_AS = ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r", "cp866", "iso8859-2", "iso8859-15", "cp1254", "iso8859-5", "mac-cyrillic"]
MEANT = ["utf-8", "cp1252", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-2", "mac-roman", "cp437", "cp850", "iso8859-5"]
#: Characters that ordinary text has as quotes and dashes, at units and numbers, as apostrophe.
QUOTES, UNITS, APOSTROPHE = "“”„‘‚«»‹›—–…¿¡•·", "£½¼¾°§€№¢¥²³ªº", "’´ʼ"
#: A repair must lower the cost by this much, and to less than this share.
DROP, SHARE, LINE_DROP = 2.0, 0.6, 1.0
REMEMBERED = 300_000
#: What a page's words must gain together for each layer, and more for one in which all bytes are valid.
LAYER, LOOSE = 2.0, 3.0
#: Layers of a word followed at once.
BEAM = 4


class _Classes(dict):
    """Class letter of each character, found on first use."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if code < 128:
            kind = "a" if "a" <= ch <= "z" else "A" if "A" <= ch <= "Z" else "0" if ch.isdigit() else "." if code > 32 else " "
        elif 0x80 <= code <= 0x9F or code == 0xFFFD or 0xE000 <= code <= 0xF8FF:
            kind = "x"
        elif ch == "¬":  # some recognisers' hyphen at a line's end
            kind = "h"
        elif ch in QUOTES:
            kind = "p"
        elif ch in UNITS:
            kind = "u"
        elif ch in APOSTROPHE:
            kind = "q"
        elif ch == "\xad" or ch.isspace() or 0x2000 <= code <= 0x200F:
            kind = "n"
        elif 0x2500 <= code <= 0x259F:
            kind = "b"
        elif unicodedata.category(ch).startswith("M"):
            kind = "m"
        elif unicodedata.category(ch).startswith("L"):
            name = unicodedata.name(ch, "")
            upper = ch.isupper()
            kind = ("L" if upper else "l") if name.startswith("LATIN") else ("C" if upper else "c") if name.startswith("CYRILLIC") else "g" if name.startswith("GREEK") else "o"
        else:
            kind = "s" if code < 0x2400 else "z"
        self[code] = kind
        return kind


CLASSES = _Classes()
BASE = {"l": 0.3, "L": 0.3, "c": 0.1, "C": 0.1, "p": 0.5, "u": 0.5, "q": 0.3, "n": 0.2, "h": 0.3, "b": 1.0, "m": 0.3, "s": 0.8, "z": 1.0, "g": 1.5, "o": 3.0, "x": 5.0}
ODD = [
    (re.compile(p), w)
    for p, w in (
        ("(?<=[alc])[LC](?!$)|(?<=[al])L|(?<=[c])C", 3.0),  # a capital after a small letter
        ("(?<=[aAlL])[cCg]|(?<=[cCg])[aAlL]|(?<=[cC])g|(?<=g)[cC]", 4.0),  # two scripts in a word
        ("(?<=[lL])[lL]", 1.5),
        ("(?<=[aAlLcCg])[su](?=[aAlLcCgsupq])|(?<=[lLsup])[su]|s(?=[aAlLcC])|u(?=[lL])", 3.0),  # symbols inside a word or beside accents
        ("(?<=[aAlLcC])[pb](?=[aAlLcCsu])|(?<=[lLsu])p(?=[aAlLcCsup])", 2.0),
        ("(?<=[aAlLcCg])b|b(?=[aAlLcCgbpsuq])", 3.0),
        ("(?<=[lLsu])q", 2.0),
        ("(?<=[aAlL])n(?=[aAlL])", 0.0),
    )
]


def garbling_cost(text: str) -> float:
    """How unlike correctly decoded text it looks; ASCII costs nothing."""
    kinds = text.translate(CLASSES)
    cost = sum(BASE.get(k, 0.0) for k in kinds)
    for pattern, weight in ODD:
        if weight:
            cost += weight * len(pattern.findall(kinds))
    return cost


def _encode(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in ("cp1252", "cp1250", "cp1251", "cp1254"):
            return None
    try:  # decoders that let undefined bytes through leave them as controls
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) <= 0x9F else c.encode(encoding) for c in text)
    except UnicodeEncodeError:
        return None


def round_trips(text: str) -> Iterator[tuple[str, str, str]]:
    """(read as, meant, text) of each strict round trip that changes the text."""
    for wrong in READ_AS:
        raw = _encode(text, wrong)
        if raw is None:
            continue
        for right in MEANT:
            if right == wrong:
                continue
            try:
                fresh = raw.decode(right)
            except UnicodeDecodeError:
                continue
            if fresh != text:
                yield wrong, right, fresh


def repair_word(word: str) -> tuple[str, tuple[tuple[str, str], ...]]:
    """The word with as many layers undone as lower its class cost, and the layers; the word itself where none does.

    Each layer lowers the cost by ``DROP`` at least, so they come to an end.
    """
    layers: list[tuple[str, str]] = []
    cost = garbling_cost(word)
    while cost >= DROP:
        # a strict decode as UTF-8 is far stronger evidence than one in which every byte is valid
        best = min(((garbling_cost(t) + (right != "utf-8"), right != "utf-8", READ_AS.index(wrong), wrong, right, t) for wrong, right, t in round_trips(word)), default=None)
        if best is None or best[0] > cost - DROP or best[0] > SHARE * cost:
            break
        word, cost = best[5], garbling_cost(best[5])
        layers.append((best[3], best[4]))
    return word, tuple(layers)


_WORDS: dict[str, tuple[tuple[str, str], ...]] = {}
NOT_ASCII = re.compile("[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")


def _layers(word: str) -> tuple[tuple[str, str], ...]:
    """The layers that the class cost finds in a word."""
    if (found := _WORDS.get(word)) is None:
        if len(_WORDS) > REMEMBERED:
            _WORDS.clear()
        found = _WORDS[word] = repair_word(word)[1]
    return found


#: What stays garbled though no trip restores it: lost characters, C1 controls, and a lead byte after a small letter whose
#: second byte (a no-break space, for one) is gone.  After capitals "Ã" and "Â" end true words ("IRMÃ").
LEFT = re.compile("[\ufffd\x80-\x9f]|[a-zß-öø-ÿ][ÃÂ](?![^\\W_])")


def is_garbled(text: str) -> bool:
    """Whether the text holds characters that come from a wrong decoding, restorable or not."""
    return not text.isascii() and (any(map(_layers, NOT_ASCII.findall(text))) or LEFT.search(text) is not None)


def letter_pairs(text: str) -> Counter:
    """Counts of neighbouring characters of which at least one is not ASCII; white space is one character."""
    pairs: Counter = Counter()
    for word, n in Counter(NOT_ASCII.findall(text)).items():
        word = f" {word} "
        for p in map("".join, zip(word, word[1:])):
            if not p.isascii():
                pairs[p] += n
    return pairs


class Letters:
    """How unlikely a word's neighbouring characters are in a corpus, by counts of pairs; empty counts leave the class cost."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values())
        self.pair = {p: math.log((total + 1) / n) for p, n in counts.items()}
        single: Counter = Counter()
        for p, n in counts.items():
            for c in p:
                single[c] += n
        self.new = math.log((total + 1) / 0.1)
        self.single = set(single)
        self.told: dict[str, tuple[float, int]] = {}

    def cost(self, word: str) -> tuple[float, int]:
        """(cost, pairs never seen) of a word; a pair of which a character was never seen costs more."""
        if (found := self.told.get(word)) is None:
            if len(self.told) > REMEMBERED:
                self.told.clear()
            padded, cost, new = f" {word} ", garbling_cost(word), 0
            for p, n in Counter(zip(padded, padded[1:])).items():
                p = "".join(p)
                if p.isascii():
                    continue
                known = self.pair.get(p)
                if known is None:
                    new += n if self.pair else 0  # without counts none is stranger than another
                    known = self.new + sum(2.0 for c in p if not c.isascii() and c not in self.single)
                cost += n * known
            found = self.told[word] = (cost, new)
        return found

    def chains(self, word: str) -> dict[tuple[tuple[str, str], ...], float]:
        """How much each chain of layers lowers the word's cost, of those in which each layer lowers it."""
        out: dict[tuple[tuple[str, str], ...], float] = {}
        first = self.cost(word)[0]
        todo, met = [((), word, first)], {word}
        while todo:
            fresh: dict[str, tuple] = {}
            for layers, text, cost in todo:
                for wrong, right, t in round_trips(text):
                    if t in fresh:  # another way to the same text
                        if fresh[t][3] == (text, right):
                            out[(*layers, (wrong, right))] = first - fresh[t][2]
                    elif t not in met and (now := self.cost(t)[0]) < cost:
                        fresh[t] = ((*layers, (wrong, right)), t, now, (text, right))
                        out[(*layers, (wrong, right))] = first - now
            met.update(fresh)
            todo = [f[:3] for f in sorted(fresh.values(), key=lambda f: f[2])[:BEAM]]
        return out


def _undo(text: str, layers: tuple[tuple[str, str], ...]) -> str | None:
    """The text with these layers strictly undone, None where that is impossible."""
    for wrong, right in layers:
        raw = _encode(text, wrong)
        try:
            text = raw.decode(right) if raw is not None else None
        except UnicodeDecodeError:
            text = None
        if text is None:
            return None
    return text


def _strict(chain: tuple[tuple[str, str], ...]) -> bool:
    """Whether each layer is UTF-8 that was misread, which hardly any other text passes for."""
    return all(right == "utf-8" for _, right in chain)


def _gain(word: str, chain: tuple[tuple[str, str], ...], letters: Letters) -> float:
    fresh = _undo(word, chain)
    if fresh is None or fresh == word:
        return 0.0
    gain = letters.cost(word)[0] - letters.cost(fresh)[0]
    return max(gain, 0.0) if _strict(chain) else gain


def repair_text(text: str, letters: Letters | None = None) -> tuple[bool, str, bool]:
    """(garbled, text with every repair made, whether nothing suspicious is left) of one whole text.

    The words vote: the chain of layers that lowers the cost of all words together the most is undone in every line it
    makes likelier, short words included; then, for words it does not fit, the next one.  A text is ``whole`` if none of its
    pairs of characters is unknown to the corpus and no other chain explains a word of it about as well with another result.
    """
    if not is_garbled(text):
        return False, text, True
    letters = letters or Letters({})
    counts = Counter(NOT_ASCII.findall(text))
    gains = {w: letters.chains(w) for w in counts}
    open_ = {w for w, g in gains.items() if g}
    order: list[tuple[tuple[str, str], ...]] = []
    while any(map(_layers, open_)):
        # a chain counts with what it costs other words too, unless it says by itself which words it fits
        votes = {c: sum(_gain(w, c, letters) for w in counts if w in open_ or not gains[w]) for c in {c for w in open_ if _layers(w) for c in gains[w]}}
        # and the simpler explanation is the likelier one
        votes = {c: v - LAYER * len(c) - LOOSE * sum(right != "utf-8" for _, right in c) for c, v in votes.items()}
        best = min(votes, key=lambda c: (-round(votes[c], 6), len(c), c[-1][1] != "utf-8", [READ_AS.index(wrong) for wrong, _ in c], c), default=None)
        if best is None or votes[best] <= 0:
            break
        order.append(best)
        open_ -= {w for w in open_ if _gain(w, best, letters) > 0}

    doubtful = False
    single = {c for c in order if not _strict(c)}

    def line(old: str) -> str:
        nonlocal doubtful
        if old.isascii():
            return old
        words = NOT_ASCII.findall(old)
        fixed: dict[str, str] = {}
        for chain in order:
            rest = [w for w in dict.fromkeys(words) if w not in fixed]
            fresh = {w: t for w in rest if (t := _undo(w, chain)) is not None and t != w}
            gain = {w: letters.cost(w)[0] - letters.cost(t)[0] for w, t in fresh.items()}
            # bytes that are valid under any encoding prove nothing: a line is changed as a whole, or only where it gains much
            if chain in single and sum(gain.values()) <= LINE_DROP:
                gain = {w: g for w, g in gain.items() if g > DROP and _layers(w)}
            elif chain not in single:
                gain = {w: g for w, g in gain.items() if g > 0}
            fixed |= {w: fresh[w] for w in gain}
        for w, t in fixed.items():
            now = letters.cost(t)[0]
            if letters.cost(t)[1]:
                doubtful = True
            for chain in order:  # a rival of the page's own chains that gives another text
                other = _undo(w, chain)
                if other not in (None, t) and letters.cost(other)[0] < now + LINE_DROP:
                    doubtful = True
        if any(letters.cost(w)[1] and (_layers(w) or gains[w]) for w in words if w not in fixed):
            doubtful = True
        return NOT_ASCII.sub(lambda m: fixed.get(m.group(), m.group()), old)

    fixed = "\n".join(map(line, text.split("\n")))
    return True, fixed, not doubtful and fixed != text and not is_garbled(fixed)


def letter_statistics(df: DataFrame, *, text: str = "text") -> Letters:
    """Pairs of neighbouring characters in all texts but those found garbled; the driver gets one row for each pair."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not is_garbled(t):
                    pairs.update(letter_pairs(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], names=["p", "n"])

    counts = rows.mapInArrow(count, "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n"))
    return Letters({r[0]: r[1] for r in counts.collect()})


def _texts(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(F.col(id), F.col(text).cast("string").alias("text_"))


def find_garbled(df: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``): the rows that ``repair_encoding`` finds garbled, without restoring them."""
    rows = _texts(df, id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array([t is not None and is_garbled(t) for t in batch.column(1).to_pylist()], pa.bool_()))], names=[id])

    return rows.mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}")


def repair_encoding(df: DataFrame, *, id: str = "doc_id", text: str = "text", letters: Letters | None = None) -> DataFrame:
    """(``id``, garbled BOOLEAN, repaired STRING, whole BOOLEAN): one row per row of ``df``.

    ``garbled``: the text holds characters that come from a wrong decoding, restorable or not.  ``repaired``: the text
    with every layer undone that could be; the text itself where nothing is garbled.  ``whole``: nothing suspicious is
    left.  Replacement characters U+FFFD, and C1 controls and cut-off lead bytes that no trip restores, are garbled.
    NULL texts give (false, NULL, true), empty ones (false, '', true); NULL and repeated ids are kept.  ``letters`` is
    counted on ``df`` where it is not given; for the rest a narrow job without any exchange.  Words are never cut.  Other
    columns are not read.
    """
    rows = _texts(df, id, text)
    schema = f"`{id}` {rows.schema[0].dataType.simpleString()}, garbled boolean, repaired string, whole boolean"
    shared = df.sparkSession.sparkContext.broadcast((letters or letter_statistics(df, text=text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(False, None, True) if t is None else repair_text(t, shared.value) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.bool_())],
                names=[id, "garbled", "repaired", "whole"],
            )

    return rows.mapInArrow(run, schema)
