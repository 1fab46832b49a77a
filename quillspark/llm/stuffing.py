"""Keyword-stuffed and link-list pages (problem 9).

A page is cut into units (lines, and sentences within lines), and each unit is reduced to its shape: how many
links, prices, tags and figures it has, how many phrases and how many words each of them, which capitals and
separators, and whether it ends like a sentence. Units of a page are grouped by shape. A page is dominated by
non-sentence shapes if few of them hold more than half of its characters. Of those, links, tags and goods with
prices are stuffing as they stand; other shapes (phrases, lines, lists whose figures count nothing, sentences of
several phrases) only where an exact check finds that the group's letters repeat within the page, since contents,
indexes, glossaries, cast lists, verse and scripts have the same shapes. The page is flagged if the stuffed groups
hold more than half of it.

Everything works on batches of pages: patterns run over Arrow arrays of lines, shapes and repetitions over
code-point arrays; there is no call per page but for the last check on pages made of few repeated phrases.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from .text import chunks, codepoints, strings

SHARE = 0.5
#: So many shapes are few.
FEW = 12
#: A phrase or a sequence of letters occurring so often within a page is repeated.
REPEATED = 3
#: Share of a group's letters that must be repeated for it to be keywords.
COVERED = 0.2
#: Sentences are keywords if so many phrases make up this share of theirs.
PHRASES = 8
MONOTONOUS = 0.8
#: Thai has no sentence ends; words written together that are longer than this on average are clauses.
CLAUSE = 20
#: A list's figures count something unless more than this many of its lines have them and half of them are others'.
FIGURES = 4

_S = r"[\s\p{Z}]"
_L = r"\p{L}"
_STOPS = r".!?。！？।؟…"
_CLOSERS = r"\"'”’»」』）)\]"
URL = r"(?i)(?:https?://|www\.)[^\s\p{Z}]+|\b(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s\p{Z}\])|]*)?"
PRICE = rf"[€$¥₽£₩₹฿]{_S}?\p{{Nd}}[\p{{Nd}}.,]*|\p{{Nd}}[\p{{Nd}}.,]*{_S}?[€$¥₽£₩₹฿]"
TAG = r"^#[^\s\p{Z}]"
LABELLED = rf"^{_L}{{2,12}}{_S}?[:：]"
LABEL = rf"{LABELLED}{_S}*(?:[^,，、;；]{{1,40}}[,，、;；]{_S}*){{2,}}[^,，、;；]{{1,40}}$"
NUMBER_FIRST = rf"^(?:{_L}{{1,12}}[ .]?)?[(\[（]?\p{{Nd}}{{1,5}}{_S}?(?:{_L}{{1,9}})?{_S}?[.、:：)\]）—–　 -]"
NUMBER_LAST = rf"(?:[\t ,，…．.·]|^){_S}*\p{{Nd}}{{1,5}}(?:{_S}?[–—-]{_S}?\p{{Nd}}{{1,5}})?$"
PAIR = rf"^[^—–:：=]{{1,60}}?{_S}?(?:——|—|–|：|:|=){_S}?[^\s\p{{Z}}]"
ENDED = rf"[{_STOPS}][{_CLOSERS}]*$"
SENTENCE = rf"([{_STOPS}]+[{_CLOSERS}]*)"
SEPARATORS = ",，、;；|/·•_~*+<>→♪★☆●■◆"

ALNUM, UPPER, SEPARATOR, BLANK, DASH, WIDE, THAI, TAB = (1 << k for k in range(8))


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its classes, and its lower-case form."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x30000):
        ch = chr(cp)
        if ch.isalnum():
            kind[cp] |= ALNUM
        if ch.isupper():
            kind[cp] |= UPPER
            if len(ch.lower()) == 1:
                lower[cp] = ord(ch.lower())
        elif unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\r\v\f":
            kind[cp] |= BLANK
    for ch in SEPARATORS:
        kind[ord(ch)] |= SEPARATOR
    kind[[ord(c) for c in "-–—"]] |= DASH
    kind[9] |= TAB
    for low, high in ((0x2E80, 0x9FFF), (0x3040, 0x30FF), (0xAC00, 0xD7A3), (0x0E00, 0x0E7F), (0xF900, 0xFAFF)):
        kind[low : high + 1] |= WIDE
    kind[0x0E00:0x0E80] |= THAI
    return kind, lower


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flags(units: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(units, pattern).to_numpy(zero_copy_only=False)


def _counts(units: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(units, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(texts: pa.Array, page: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The trimmed, non-empty lines of the texts, and each one's page."""
    lists = pc.split_pattern(texts, "\n")
    owner = np.repeat(page, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = pc.utf8_trim_whitespace(lists.flatten())
    keep = pc.not_equal(flat, "")
    return flat.filter(keep), owner[keep.to_numpy(zero_copy_only=False)]


class Units:
    """The units of a batch of pages and what their shapes are made of, as aligned arrays."""

    def __init__(self, texts: pa.Array):
        lines, page = _parts(texts, np.arange(len(texts)))
        size = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        links = _counts(lines, URL)
        bare = np.zeros(len(lines), np.int64)
        linked = np.flatnonzero(links)
        if len(linked):
            bare[linked] = pc.utf8_length(pc.replace_substring_regex(lines.take(pa.array(linked)), URL, "")).to_numpy(zero_copy_only=False)
        links[bare > 60 * links] = 0
        prices = _counts(lines, PRICE)
        prices[(links > 0) | (size > 90 * prices)] = 0
        ended = _flags(lines, ENDED)
        tags = _flags(lines, TAG) & (links == 0) & (prices == 0)
        maybe = np.flatnonzero(_flags(lines, LABELLED) & ~ended & (links == 0) & (prices == 0) & ~tags)
        if len(maybe):
            tags[maybe] = _flags(lines.take(pa.array(maybe)), LABEL)
        free = (links == 0) & (prices == 0) & ~tags
        short = free & ~ended & (size < 160)
        numbered, paired = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
        spots = np.flatnonzero(short)
        if len(spots):
            some = lines.take(pa.array(spots))
            numbered[spots] = _flags(some, NUMBER_LAST) | _flags(some, NUMBER_FIRST)
            paired[spots] = _flags(some, PAIR) & ~numbered[spots]
        rest = np.flatnonzero(free & ~numbered & ~paired)
        whole = np.flatnonzero(~(free & ~numbered & ~paired))
        parts, owner = _parts(pc.replace_substring_regex(lines.take(pa.array(rest)), SENTENCE, "\\1\n"), rest)
        self.text = pa.concat_arrays([lines.take(pa.array(whole)), parts])
        line = np.concatenate([whole, owner])
        self.page = page[line]
        self.links, self.prices, self.tags, self.numbered, self.paired = links[line], prices[line], tags[line], numbered[line], paired[line]
        self.ended = np.concatenate([ended[whole], _flags(parts, ENDED)])
        self._measure()

    def _measure(self) -> None:
        kind, lower = _classes()
        cps, starts = codepoints(self.text)
        n = len(self.text)
        self.size = np.diff(starts)
        unit = np.repeat(np.arange(n), self.size)
        k = kind[cps]
        begins = np.zeros(len(cps), bool)
        begins[starts[:-1]] = True
        before, after = np.concatenate([[0], k[:-1]]), np.concatenate([k[1:], [0]])
        before[begins] = 0
        blank, dash, alnum = k & BLANK > 0, k & DASH > 0, k & ALNUM > 0
        part = (k & (SEPARATOR | TAB) > 0) | (blank & ((before | after) & BLANK > 0)) | (dash & (before & BLANK > 0) & (after & BLANK > 0))
        where = np.flatnonzero(alnum)
        piece = np.cumsum(part | begins)[where]
        first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]])) if len(where) else where
        letters = lower[cps[where]]
        within = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
        self.piece_unit = unit[where[first]]
        self.piece_hash = np.add.reduceat(_mix(letters.astype(np.uint64) | (within.astype(np.uint64) << np.uint64(32))), first) if len(first) else np.zeros(0, np.uint64)
        self.pieces = np.bincount(self.piece_unit, minlength=n)
        self.letters, self.letter_unit = letters, unit[where]
        count = functools.partial(np.bincount, minlength=n)
        begin = alnum & (before & ALNUM == 0)
        self.wide = count(unit[k & WIDE > 0])
        runs = count(unit[begin & (k & WIDE == 0)])
        self.words = runs + -(-self.wide // 2)
        self.capitals = count(unit[begin & (k & UPPER > 0)])
        self.caseful = runs
        self.upper = count(unit[k & UPPER > 0])
        self.cased = count(unit[(k & UPPER > 0) | (lower[cps] != cps) | ((cps >= 0x61) & (cps <= 0x7A))])
        self.separator = np.zeros(n, np.int64)
        spots = np.flatnonzero(part & ~blank)
        self.separator[unit[spots][::-1]] = cps[spots][::-1]  # the first one
        # clauses of Thai: words by blanks, the longer the more they weigh
        self.thai = count(unit[k & THAI > 0]) > 0
        run = np.cumsum(blank | begins)
        length = np.bincount(run, ~blank) if len(cps) else np.zeros(1)
        self.clause = np.bincount(unit, length[run] * ~blank, n) > CLAUSE * np.maximum(self.size, 1)

    def shapes(self) -> np.ndarray:
        """The shape of each unit: a number in which each part of it has its place."""
        each = self.words / np.maximum(self.pieces, 1)
        parts = (
            np.minimum(self.links, 2), np.minimum(self.prices, 2), self.tags, self.numbered, self.paired, self.sentences(), self.ended,
            np.searchsorted([1.5, 3.5], self.pieces), np.searchsorted([1.5, 2.5, 5.5, 10.5], each),
            np.where(self.capitals == 0, 0, np.where(self.upper == self.cased, 3, np.where(2 * self.capitals > self.caseful, 2, 1))), np.minimum(self.separator, 0xFFFF),
        )
        out = np.zeros(len(self.page), np.int64)
        for p, width in zip(parts, PARTS.values(), strict=True):
            out = (out << width) | p.astype(np.int64)
        return out

    def sentences(self) -> np.ndarray:
        """Which units are built like sentences: one phrase with an end, or clauses of Thai."""
        plain = (self.links == 0) & (self.prices == 0) & ~self.tags & ~self.numbered & ~self.paired
        return plain & ((self.ended & (self.pieces < 2)) | (~self.ended & self.thai & self.clause))


#: Bits of a shape's parts, from the highest.
PARTS = {"links": 2, "prices": 2, "tags": 1, "numbered": 1, "paired": 1, "sentence": 1, "ended": 1, "pieces": 2, "words": 3, "capitals": 2, "separator": 16}


def shape_parts(code: np.ndarray) -> dict[str, np.ndarray]:
    """The parts of shapes by name."""
    out = {}
    for name, width in reversed(PARTS.items()):
        out[name] = code & ((1 << width) - 1)
        code = code >> width
    return out


def shape_name(code: int) -> str:
    """A shape in words."""
    x = {k: int(v) for k, v in shape_parts(np.array(code)).items()}
    names = [n for n, on in (("links" if x["links"] > 1 else "link", x["links"]), ("prices" if x["prices"] > 1 else "price", x["prices"]), *((k, x[k]) for k in ("tags", "numbered", "paired", "sentence", "ended"))) if on]
    build = f"{('1', '2-3', '4+')[x['pieces']]}x{('1', '2', '3-5', '6-10', '11+')[x['words']]}{('a', 'Aa', 'A', 'X')[x['capitals']]}"
    return " ".join([*names, build + (chr(x["separator"]) if x["separator"] else "")])


def _repeated(u: Units, chosen: np.ndarray) -> np.ndarray:
    """For each unit how many of its letters stand in sequences that the ``chosen`` units of its page hold at least
    ``REPEATED`` times. Sequences are shorter where a sign is a syllable or a word."""
    n = len(u.page)
    pages = int(u.page.max()) + 1 if n else 0
    wide = np.bincount(u.page[chosen], u.wide[chosen], pages) * 2 > np.bincount(u.page[chosen], u.size[chosen], pages)
    thai = np.bincount(u.page[chosen], u.thai[chosen], pages) > 0
    gram = np.where(wide, np.where(thai, 4, 2), 5)
    use = chosen[u.letter_unit]
    letters, unit = u.letters[use].astype(np.uint64), u.letter_unit[use]
    page = u.page[unit]
    out = np.zeros(n, np.int64)
    for size in (2, 4, 5):
        spots = np.flatnonzero(gram[page] == size)
        if len(spots) < size:
            continue
        x, owner, leaf = letters[spots], unit[spots], page[spots]
        m = len(x) - size + 1
        key = _mix(leaf[:m].astype(np.uint64))
        for j in range(size):
            key = _mix(key ^ (x[j : m + j] + np.uint64(j << 40)))
        ok = np.flatnonzero(owner[:m] == owner[size - 1 :])
        _, inverse, count = np.unique(key[ok], return_inverse=True, return_counts=True)
        often = ok[count[inverse] >= REPEATED]
        change = np.zeros(len(x) + 1, np.int64)
        np.add.at(change, often, 1)
        np.add.at(change, often + size, -1)
        out += np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=n)
    return out


def _strung(u: Units, chosen: np.ndarray) -> np.ndarray:
    """Pages whose ``chosen`` sentences are strung together from the same few phrases, in any order; a drill keeps
    the order."""
    pages = int(u.page.max()) + 1 if len(u.page) else 0
    use = np.flatnonzero(chosen[u.piece_unit])
    page, phrase, unit = u.page[u.piece_unit[use]], u.piece_hash[use], u.piece_unit[use]
    out = np.zeros(pages, bool)
    if not len(use):
        return out
    _, first, inverse, count = np.unique(_mix(phrase ^ _mix(page.astype(np.uint64))), return_index=True, return_inverse=True, return_counts=True)
    owner = page[first]
    order = np.lexsort((-count, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    top = order[(rank < PHRASES) & (count[order] >= REPEATED)]
    total = np.bincount(page, minlength=pages)
    few = (total >= 4) & (np.bincount(owner[top], count[top], pages) >= MONOTONOUS * total)
    kinds = np.bincount(owner, minlength=pages)
    # phrases that follow each other within a sentence
    near = np.flatnonzero((unit[1:] == unit[:-1]) & few[page[1:]])
    pairs = np.unique(np.stack([page[near], inverse[near], inverse[near + 1]]), axis=1)
    many = np.bincount(pairs[0], minlength=pages) >= 1.5 * kinds
    there = {(a, b) for a, b in zip(pairs[1].tolist(), pairs[2].tolist(), strict=True)}
    back = np.array([(b, a) in there for a, b in zip(pairs[1].tolist(), pairs[2].tolist(), strict=True)], bool)
    turned = np.bincount(pairs[0][back], minlength=pages) > 0 if len(back) else out
    return few & (many | turned)


def _idle_lists(u: Units, numbered: np.ndarray) -> np.ndarray:
    """Pages whose ``numbered`` lines don't count anything: fewer than half as many figures as lines."""
    pages = int(u.page.max()) + 1 if len(u.page) else 0
    spots = np.flatnonzero(numbered)
    if not len(spots):
        return np.zeros(pages, bool)
    some = u.text.take(pa.array(spots))
    ends = [pc.struct_field(pc.extract_regex(some, p), "n") for p in (r"(?s)^\P{Nd}*(?P<n>\p{Nd}+)", r"(?s)(?P<n>\p{Nd}+)\P{Nd}*$")]
    both = pa.concat_arrays([e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e for e in ends]).dictionary_encode()
    code = both.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.concatenate([u.page[spots]] * 2)
    different = np.unique(np.stack([page, code]), axis=1)[0]
    lines = np.bincount(u.page[spots], minlength=pages)
    return (lines > FIGURES) & (np.bincount(different, minlength=pages) < lines / 2)


def judge_batch(texts: pa.Array, shape_of=Units.shapes) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(share of each page in stuffed shapes, the groups); groups are page, shape, units, characters, stuffed."""
    u = Units(texts)
    n = len(texts)
    share = np.zeros(n)
    if not len(u.page):
        none = np.zeros(0, np.int64)
        return share, (none, none, none, none, none.astype(bool))
    # groups of a page by shape
    shape = shape_of(u)
    keys = np.stack([u.page, shape])
    order = np.lexsort(keys[::-1])
    edge = np.concatenate([[True], (np.diff(keys[:, order]) != 0).any(0)])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(edge) - 1
    page, code = u.page[order[edge]], shape[order[edge]]
    groups = len(page)
    chars, total = np.bincount(group, u.size, groups), np.bincount(u.page, u.size, n)
    x = shape_parts(code)
    idle = (x["numbered"] > 0) & _idle_lists(u, x["numbered"][group] > 0)[page]
    odd = (x["sentence"] == 0) & (x["paired"] == 0) & ((x["numbered"] == 0) | idle)
    # few non-sentence shapes over half of the page
    by_size = np.lexsort((-chars * odd, page))
    rank = np.empty(groups, np.int64)
    rank[by_size] = np.arange(groups) - np.searchsorted(page[by_size], page[by_size])
    leading = odd & (rank < FEW)
    dominated = np.bincount(page[leading], chars[leading], n) > SHARE * total
    # of these, what is stuffed as it stands, and what repeats
    plain = leading & ((x["links"] > 0) | (x["prices"] > 0) | (x["tags"] > 0))
    open_ = leading & ~plain & dominated[page]
    soft, posed = open_ & (x["ended"] == 0), open_ & (x["ended"] > 0)
    letters = np.bincount(group[u.letter_unit], minlength=groups)
    covered = np.bincount(group, _repeated(u, soft[group]), groups) >= COVERED * np.maximum(1, letters)
    stuffed = plain | (soft & covered) | (posed & _strung(u, posed[group])[page])
    share = np.bincount(page[stuffed], chars[stuffed], n) / np.maximum(total, 1)
    return np.where(dominated, share, 0.0), (page, code, np.bincount(group, minlength=groups), chars, stuffed)


SHAPES = ArrayType(StructType().add("shape", "string").add("n_units", "integer").add("share", "double").add("stuffed", "boolean"))


def judge_pages(df: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, share, shapes, stuffed) for every row: the share of characters in stuffed shapes, all shapes of the page
    with their units and shares, and whether the first is over half.

    Null, empty and blank texts have share 0 and no shapes. Rows of equal text get equal results, each its row. Whole
    texts are read, however long; nothing is shuffled, a page is judged where it is read.
    """
    schema = df.select(doc).schema.add("share", "double").add("shapes", SHAPES).add("stuffed", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, text):
                texts = pc.fill_null(strings(batch.column(text)), "")
                share, (page, code, units, chars, bad) = judge_batch(texts)
                names, at = np.unique(code, return_inverse=True)
                total = np.bincount(page, chars, len(texts))
                shapes = pa.StructArray.from_arrays(
                    [pa.array([shape_name(c) for c in names.tolist()], pa.string()).take(pa.array(at)), pa.array(units, pa.int32()), pa.array(chars / np.maximum(total[page], 1)), pa.array(bad)],
                    names=["shape", "n_units", "share", "stuffed"],
                )
                ends = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=len(texts)))]).astype(np.int32)
                arrays = [batch.column(doc), pa.array(share, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), shapes), pa.array(share > SHARE)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(doc, text).mapInArrow(run, schema)
