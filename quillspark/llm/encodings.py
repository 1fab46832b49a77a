"""Garbled text from a wrong character encoding (problem 1).

A chain (right, wrong) says that a text was written in the encoding ``right`` and read as ``wrong``; chains can
follow each other. Which chain a record went through is latent. The evidence for a chain is the gain in
log-likelihood, under a character model of the corpus, of undoing it over the best stretch of the text. The
evidence of all records of a source and field is pooled by expectation-maximization: the share of each chain in
a source is re-estimated from the posteriors and is the prior of the next round, so that weak evidence counts in
a source where the chain is known and a lucky gain does not where it isn't. Each record is then repaired by its
posterior.

Everything works on batches: texts are code-point arrays, encoders and single-byte decoders are table gathers,
and the best stretch of every text is a running minimum over the whole batch.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from ..session import cut
from .lookalike import shape_table
from .text import chunks, codepoints, exploded, strings

BUCKETS = 1 << 21
UNIGRAMS = 0x20000
#: Weight of the unigram distribution, as a share of the corpus: a context seen less often is not trusted, and so
#: damage that is regular in itself doesn't look natural.
TRUST = 1e-3
#: A text is examined where four bigrams in a row are less likely than this, in nats; a shorter one where all of its
#: bigrams together are less likely than their share of it.
STRANGE = -26.0
#: ... or where a letter is followed by a sign beyond ASCII less likely than this.
ALIEN = -9.0
#: No character of the text as it stands counts as less likely than this: it may be rare for other reasons.
FLOOR = -8.0
ESCAPE = -11.0
LOST = 0xFFFD
#: A lost character says nothing about which chain it was.
NEUTRAL = -4.0
#: The chain of texts that lost characters and show nothing else.
UNKNOWN = "lost"
#: Cost of a stretch that ends next to a letter which the wrong encoding has as well and which makes no sense.
RAGGED = 14.0
#: Gains below this many nats aren't evidence.
LEAST = 1.0
#: Log-ratio of a lost character under any chain to one in a sound text. It is the same for all chains, the unknown
#: one ("lost") among them, so what can be told from the rest of the text decides between them.
LOST_GAIN = 11.0
#: What a further stretch of the same chain must gain in the same text.
PRICE = 5.0
#: Texts that went through a chain twice are undone again while that gains so much; a repair beside lost characters
#: must gain the first.
AGAIN = 7.0
KNOWN = 3.0
#: A chain so many nats behind another of the same text weighs nothing: priors differ by less than half of that.
BEHIND = 40.0
#: Prior: share of damaged texts, and how many texts' weight the whole corpus has in each source's prior.
DAMAGED = 0.01
WEIGHT = 100.0
#: EM ends once a round moves less than this share of the damaged texts between chains, at the latest after so many.
MOVED = 0.002
ITERATIONS = 30

SINGLE = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "cp874")
FOREIGN = ("cp1251", "koi8-r", "cp866", "cp874", "cp1256")
DOUBLE = ("gbk", "big5", "cp932", "euc-jp", "cp949")
CHAINS = tuple(
    [("utf-8", d) for d in ("latin-1", "cp1252", "cp1250", "cp1251", "koi8-r", "cp866", "cp437", "cp850", "mac-roman", "cp874", *DOUBLE)]
    + [("gbk", d) for d in ("latin-1", "cp1252", "cp1251", "cp437", "big5", "cp949", "cp932")]
    + [("big5", d) for d in ("latin-1", "cp1252", "gbk", "cp932")]
    + [("cp932", d) for d in ("latin-1", "cp1252", "cp437", "mac-roman", "gbk", "cp949")]
    + [("euc-jp", d) for d in ("latin-1", "cp1252", "cp932", "gbk")]
    + [("cp949", d) for d in ("latin-1", "cp1252", "cp932", "gbk")]
    + [("cp1251", d) for d in ("latin-1", "cp1252", "koi8-r", "cp866", "mac-roman")]
    + [("koi8-r", d) for d in ("latin-1", "cp1251", "cp866")]
    + [("cp866", d) for d in ("latin-1", "cp1251", "koi8-r")]
    + [("cp1252", d) for d in ("cp1251", "cp437", "cp850", "mac-roman", "gbk")]
    + [("cp437", "cp1252"), ("cp850", "cp1252"), ("mac-roman", "cp1252"), ("cp874", "latin-1"), ("cp1256", "latin-1"), ("cp1256", "cp1252")]
)


def decode_single(name: str) -> np.ndarray:
    """Code point of each byte; bytes without a character are control characters, as browsers have it."""
    return np.array([ord(bytes([b]).decode(name)) if _has(bytes([b]), name) else b for b in range(256)], np.uint32)


def _has(raw: bytes, name: str) -> bool:
    try:
        raw.decode(name)
    except UnicodeDecodeError:
        return False
    return True


@functools.cache
def encoder(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point below 65,536: how many bytes it has in the encoding (0: none), and the first two."""
    size, one, two = np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint8)
    if name in SINGLE:
        table = decode_single(name)
        for b in range(255, -1, -1):
            size[table[b]], one[table[b]] = 1, b
        return size, one, two
    size[:0x80], one[:0x80] = 1, np.arange(0x80)
    for cp, raw in _encoded(name, 0xA0):
        if len(raw) <= 2:
            size[cp], one[cp], two[cp] = len(raw), raw[0], raw[-1]
    return size, one, two


def _encoded(name: str, low: int) -> list[tuple[int, bytes]]:
    """Each code point from ``low`` to 65,535 that the encoding has, and its bytes; all are encoded in one call."""
    cps = (*range(low, 0xD800), *range(0xE000, 0x10000))
    parts = "\n".join(map(chr, cps)).encode(name, "replace").split(b"\n")
    known = [(cp, raw) for cp, raw in zip(cps, parts, strict=True) if raw != b"?"]
    return known + _private() if name == "gbk" else known


def _private() -> list[tuple[int, bytes]]:
    """The user-defined characters of GBK: its free rows in order, which decoders take for private code points."""
    rows = [(lead, trail) for leads in (range(0xAA, 0xB0), range(0xF8, 0xFF)) for lead in leads for trail in range(0xA1, 0xFF)]
    rows += [(lead, trail) for lead in range(0xA1, 0xA8) for trail in range(0x40, 0xA1) if trail != 0x7F]
    return [(0xE000 + i, bytes(pair)) for i, pair in enumerate(rows)]


@dataclass(frozen=True)
class Model:
    """Counts of characters and hashed character pairs over the whole corpus."""

    pairs: np.ndarray
    single: np.ndarray

    @functools.cached_property
    def logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = max(1.0, float(self.single.sum()))
        alpha = TRUST * total
        back = alpha * (self.single + 0.2) / (total + 0.2 * len(self.single))
        # a pair seen once is as good as unseen: it may be the very text that is judged
        return np.maximum(self.pairs - 1, 0).astype(np.float32), back.astype(np.float32), np.log(self.single + alpha).astype(np.float32)

    def likelihood(self, cps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probability of each character after the one before it; the first of a text follows a line feed.

        The model knows shapes: width, look-alikes and case make no difference, invisible characters are neutral.
        """
        pairs, back, norm = self.logs
        shapes, before, seen = shaped(cps, starts)
        out = np.log(pairs[bucket(before, shapes)] + back[shapes & (UNIGRAMS - 1)]) - norm[before & (UNIGRAMS - 1)]
        if seen is not None:
            out[~seen] = -2.0
        return out


def shaped(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Shapes, the shape before each (a line feed at a text's start), and which are visible (None: all)."""
    shapes = shape_table()[np.minimum(cps, 0x10FFFF)]
    seen = shapes != 0xFFFFFFFF
    before = np.empty_like(shapes)
    if seen.all():
        seen = None
        before[1:] = shapes[:-1]
    else:
        last = np.maximum.accumulate(np.where(seen, np.arange(len(shapes)), 0))
        shapes = np.where(seen, shapes, np.uint32(0x200B))
        before[1:] = shapes[last[:-1]]
    before[starts[:-1][starts[:-1] < len(cps)]] = 10
    return shapes, before, seen


def bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (a >> np.uint32(3))) >> np.uint32(11)


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point below 65,536: 1 Latin beyond ASCII and its symbols, 2 boxes and blocks, 4 letters, 8 other signs."""
    kind = np.zeros(0x10000, np.uint8)
    kind[0x80:0x180] = 1
    kind[[0x192, 0x2C6, 0x2DC]] = 1
    kind[0x2500:0x25A0] = 2
    for cp in range(0x41, 0x600):
        if chr(cp).isalpha():
            kind[cp] |= 4
    kind[0x2010:0x2123] |= 8
    kind[[*range(0xA1, 0xC0), 0xD7, 0xF7]] |= 8
    kind[0x370:0x400] |= 8
    return kind


def signed(cps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Characters that show a wrong encoding by themselves: lost ones, stray controls, three signs in a row of
    which one is beyond ASCII Latin, boxes next to letters. Such texts teach the model nothing."""
    odd = (cps == LOST) | ((cps >= 0x80) & (cps < 0xA0) & (cps != 0x85))
    if len(cps) > 2:
        kind = _kinds()[np.minimum(cps, 0xFFFF)]
        sign = (kind & 9) > 0
        latin = (kind & 1) > 0
        three = sign[2:] & sign[1:-1] & sign[:-2] & (latin[2:] | latin[1:-1] | latin[:-2]) & (row[2:] == row[:-2])
        odd[:-2] |= three
        box, letter = (kind & 2) > 0, (kind & 4) > 0
        odd[:-1] |= ((box[1:] & letter[:-1]) | (box[:-1] & letter[1:])) & (row[1:] == row[:-1])
    return odd


def count(cps: np.ndarray, starts: np.ndarray, pairs: np.ndarray, single: np.ndarray) -> None:
    """Add the texts to the counts, but for those that show damage by themselves."""
    shapes, before, seen = shaped(cps, starts)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    odd = signed(cps, row)
    if odd.any():
        bad = np.zeros(len(starts) - 1, bool)
        bad[row[odd]] = True
        seen = ~bad[row] if seen is None else seen & ~bad[row]
    if seen is not None:
        shapes, before = shapes[seen], before[seen]
    pairs += np.bincount(bucket(before, shapes), minlength=BUCKETS)
    single += np.bincount(shapes & np.uint32(UNIGRAMS - 1), minlength=UNIGRAMS)


def strange(cps: np.ndarray, starts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Which characters begin an unlikely stretch, are lost or stray control characters; and each one's text."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    each = model.likelihood(cps, starts)
    score = np.concatenate([[0], np.cumsum(each, dtype=np.float64)])
    window = np.full(len(cps), 0.0)
    window[: max(0, len(cps) - 3)] = score[4:] - score[:-4]
    window[: max(0, len(cps) - 3)][row[3:] != row[:-3]] = 0
    odd = (window < STRANGE) | signed(cps, row)
    # a text too short for a window is one itself; a line feed that ends it doesn't count
    size = np.diff(starts)
    size[size > 0] -= cps[starts[1:][size > 0] - 1] == 10
    brief = np.flatnonzero((size > 0) & (size < 4))
    brief = brief[score[(starts[:-1] + size)[brief]] - score[starts[:-1][brief]] < STRANGE / 4 * size[brief]]
    if len(brief):
        short = np.zeros(n, bool)
        short[brief] = True
        odd |= short[row] & (cps > 0x7F)
    # a letter and a sign that never go together, within a word
    rare = (each < ALIEN) & (cps >= 0x80) & (cps < 0x2600)
    rare[1:] &= (_kinds()[np.minimum(cps[:-1], 0xFFFF)] & 4) > 0
    odd |= rare
    return odd, row


@functools.cache
def _size_table(right: str) -> np.ndarray:
    """Bytes of each character below 65,536 in a double-byte encoding."""
    size = np.ones(0x10000, np.int64)
    size[0x80:] = 2
    for cp, raw in _encoded(right, 0x80):
        size[cp] = len(raw)
    return size


def _sizes(cps: np.ndarray, right: str) -> np.ndarray:
    """Bytes that each decoded character came from."""
    if right == "utf-8":
        size = np.ones(len(cps), np.int64) + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF)
    else:
        size = _size_table(right)[np.minimum(cps, 0xFFFF)]
    size[(cps >= 0xDC80) & (cps <= 0xDCFF)] = 1
    return size


def _sizes_exactly(raw: bytes, right: str) -> np.ndarray:
    """As ``_sizes`` where an encoding has several byte sequences for a character: byte by byte."""
    decoder = codecs.getincrementaldecoder(right)("surrogateescape")
    sizes, begun = [], 0
    for k in range(len(raw)):
        got = decoder.decode(raw[k : k + 1], k == len(raw) - 1)
        if got:
            # of several characters at once all but the last are single escaped bytes
            sizes += [1] * (len(got) - 1) + [k + 1 - begun - (len(got) - 1)]
            begun = k + 1
    return np.array(sizes, np.int64)


@dataclass(frozen=True)
class Undone:
    """A chain undone over a batch. Spots are where characters begin both before and after; for each spot ``before``
    and ``after`` are the positions and ``gain`` is the likelihood gained up to it. Text k has spots
    first[k] to first[k + 1]; ``best`` is its best single stretch's gain, from spot ``begin`` to ``end``."""

    best: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    gain: np.ndarray
    before: np.ndarray
    after: np.ndarray
    first: np.ndarray
    out: np.ndarray


@dataclass(frozen=True)
class Bytes:
    """Texts as the wrong encoding writes them: where each character begins, the bytes, and which it doesn't have."""

    at: np.ndarray
    raw: np.ndarray
    none: np.ndarray


def bytes_of(cps: np.ndarray, wrong: str) -> Bytes:
    """Characters that the encoding doesn't have are a byte that begins none in any encoding."""
    size, one, two = encoder(wrong)
    small = np.minimum(cps, 0xFFFF)
    length = size[small].astype(np.int64)
    none = (length == 0) | (cps == LOST) | (cps > 0xFFFF)
    length[none] = 1
    at = np.concatenate([[0], np.cumsum(length)])
    raw = np.zeros(at[-1], np.uint8)
    raw[at[:-1]] = np.where(none, 0xFF, one[small])
    pair = length == 2
    raw[at[:-1][pair] + 1] = two[small[pair]]
    return Bytes(at, raw, none)


def undo(cps: np.ndarray, starts: np.ndarray, own: np.ndarray, right: str, written: Bytes, model: Model) -> Undone:
    """Undo a chain everywhere.

    ``own`` is the cumulated likelihood of the texts as they are, ``written`` their bytes in the wrong encoding. The
    texts must not hold line feeds but end with one each. What the wrong encoding doesn't have, and bytes that don't
    decode, come out as 0xDC80-0xDCFF.
    """
    at, raw, none = written.at, written.raw, written.none
    if right in SINGLE:
        out = decode_single_cached(right)[raw]
        out[at[:-1][none]] = 0xDCFF
        at2 = np.arange(len(raw) + 1)
    else:
        text = raw.tobytes().decode(right, "surrogateescape")
        out = np.array([text], f"<U{max(1, len(text))}").view(np.uint32)[: len(text)].copy()  # surrogates as they are
        sizes = _sizes(out, right)
        if sizes.sum() != len(raw):
            sizes = _sizes_exactly(raw.tobytes(), right)
        at2 = np.concatenate([[0], np.cumsum(sizes)])
        out[out == 0xF8F3] = 0xDCFF  # what one of the decoders makes of the byte 0xFF
    starts2 = np.searchsorted(at2, at[starts])
    ll = model.likelihood(out, starts2)
    ll[(out >= 0xDC80) & (out <= 0xDCFF)] = ESCAPE
    ll[(out >= 0x80) & (out < 0xA0)] = ESCAPE
    ll[(out >= 0xE000) & (out < 0xF900)] = ESCAPE
    if right in FOREIGN and len(out) > 1:  # words of two scripts
        plain, other = (out < 0x80) & ((out | 0x20) >= 0x61) & ((out | 0x20) <= 0x7A), out >= 0x370
        ll[1:][(plain[:-1] & other[1:]) | (other[:-1] & plain[1:])] = ESCAPE
    lost = np.flatnonzero(cps == LOST)
    ll[np.searchsorted(at2, at[lost])] = NEUTRAL
    new = np.concatenate([[0], np.cumsum(ll, dtype=np.float64)])
    place = np.full(len(raw) + 1, -1, np.int64)
    place[at2] = np.arange(len(at2))
    after = place[at]
    before = np.flatnonzero(after >= 0)
    after = after[before]
    # the end of a text is the start of the next
    first = np.searchsorted(before, starts)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    gain = new[after] - own[before]
    each = gain[:-1] - 1e6 * owner
    low = np.minimum.accumulate(each)
    here = np.maximum.accumulate(np.where(each <= low, np.arange(len(each)), 0))
    rise = each - low
    best = np.maximum.reduceat(rise, first[:-1])
    top = np.flatnonzero(rise == best[owner])[::-1]
    end = np.zeros(len(starts) - 1, np.int64)
    end[owner[top]] = top
    return Undone(best, here[end], end, gain, before, after, first, out)


def stretches(gain: list[float], price: float) -> list[tuple[int, int]]:
    """The disjoint stretches (from, to) with the greatest sum of gains, each of which costs ``price``.

    ``gain`` is cumulated. One opens where the gain has risen by more than the price since its low, and closes at
    its high once it has fallen by more than that.
    """
    out: list[tuple[int, int]] = []
    low = high = 0
    inside = False
    for k, g in enumerate(gain):
        if inside:
            if g > gain[high]:
                high = k
            elif gain[high] - g > price:
                out.append((low, high))
                inside, low = False, k
        elif g < gain[low]:
            low = k
        elif g - gain[low] > price:
            inside, high = True, k
    if inside:
        out.append((low, high))
    return out


def _written(u: Undone, a: int, b: int, cps: np.ndarray) -> np.ndarray:
    """The stretch from spot ``a`` to ``b`` undone. Where bytes make no character the text stays as it was, but next
    to characters lost before: there a run of such bytes is one lost character."""
    new = u.out[u.after[a] : u.after[b]]
    bad = (new >= 0xDC80) & (new <= 0xDCFF)
    if not bad.any():
        return new
    broken = np.add.reduceat(bad, u.after[a:b] - u.after[a]) > 0
    edges = np.flatnonzero(np.diff(broken)) + 1
    parts = []
    for x, y in zip([0, *edges.tolist()], [*edges.tolist(), b - a], strict=True):
        if not broken[x]:
            parts.append(u.out[u.after[a + x] : u.after[a + y]])
            continue
        old = cps[u.before[a + x] : u.before[a + y]]
        if (old == LOST).any():
            part = u.out[u.after[a + x] : u.after[a + y]]
            part = np.where((part >= 0xDC80) & (part <= 0xDCFF), LOST, part).astype(np.uint32)
            old = part[np.concatenate([[True], (part[1:] != LOST) | (part[:-1] != LOST)])]
        parts.append(old)
    return np.concatenate(parts)


@functools.cache
def decode_single_cached(name: str) -> np.ndarray:
    return decode_single(name)


def text_of(cps: np.ndarray) -> str:
    """Code points as a string."""
    return cps.astype("<u4").tobytes().decode("utf-32-le")


def _marked(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one array, each ended by a line feed; line feeds within become another control character."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    out = np.concatenate([x for t in texts for x in (t, _FEED)])
    out[out == 10] = 0x1C
    out[ends - 1] = 10
    return out, np.concatenate([[0], ends])


_FEED = np.array([10], np.uint32)
Found = tuple[float, str, np.ndarray]


def explain(texts: list[np.ndarray], model: Model, rights: list[set[str]] | None = None) -> list[list[Found]]:
    """For each text every chain with evidence for it, best first: (gain, chain, text with its stretches undone).

    Every wrong encoding is tried that has two neighbouring characters of an unlikely stretch, one beyond ASCII.
    ``rights`` restricts the right encodings tried for each text. Lost characters are neutral here.
    """
    found: list[list[Found]] = [[] for _ in texts]
    cps, starts = _marked(texts)
    likely = np.maximum(model.likelihood(cps, starts), FLOOR)
    likely[cps == LOST] = NEUTRAL
    odd, row = strange(cps, starts, model)
    # an unlikely stretch is four characters long
    wide = odd.copy()
    for k in (1, 2, 3):
        wide[k:] |= odd[:-k] & (row[k:] == row[:-k])
    beyond = (cps > 0x7F) & (cps != LOST)
    small = np.minimum(cps, 0xFFFF)
    top = np.zeros(len(texts))
    for wrong in dict.fromkeys(d for _, d in CHAINS):
        has = encoder(wrong)[0][small] > 0
        two = wide[:-1] & wide[1:] & (has[:-1] | (cps[:-1] == LOST)) & (has[1:] | (cps[1:] == LOST)) & ((has & beyond)[:-1] | (has & beyond)[1:])
        ids = np.flatnonzero(np.bincount(row[:-1][two], minlength=len(texts)) > 0)
        if not len(ids):
            continue
        fine = has & (cps >= 0xC0)
        single = wrong in SINGLE

        def subset(ids: np.ndarray, wrong=wrong, fine=fine) -> tuple:
            """What is needed to undo chains over these texts, whatever the right encoding."""
            use = np.zeros(len(texts), bool)
            use[ids] = True
            part = use[row]
            own_starts = np.concatenate([[0], np.cumsum(np.diff(starts)[ids])])
            return ids, cps[part], fine[part], own_starts, np.concatenate([[0], np.cumsum(likely[part], dtype=np.float64)]), bytes_of(cps[part], wrong)

        every = subset(ids)
        # nothing decodes as UTF-8 without a lead byte before a continuation byte
        raw, at = every[5].raw, every[5].at
        lead = np.flatnonzero((raw[:-1] >= 0xC2) & (raw[:-1] <= 0xF4) & (raw[1:] >= 0x80) & (raw[1:] <= 0xBF))
        some = np.unique(np.searchsorted(at[every[3]], lead, "right") - 1)
        for right in (e for e, d in CHAINS if d == wrong):
            if right == "utf-8" and not len(some):
                continue
            own_ids, own_cps, own_fine, own_starts, own, written = subset(ids[some]) if right == "utf-8" and len(some) < len(ids) else every

            def ragged(a: int, b: int, k: int, own_fine=own_fine, own_starts=own_starts) -> bool:
                return bool((a > own_starts[k] and own_fine[a - 1]) or own_fine[min(b, len(own_fine) - 1)])

            u = undo(own_cps, own_starts, own, right, written, model)
            for k in np.flatnonzero(u.best > LEAST).tolist():
                if rights is not None and right not in rights[own_ids[k]]:
                    continue
                # the best stretch, and all others that gain more than their price
                a, b, base = int(u.begin[k]), int(u.end[k]), int(u.first[k])
                gain = float(u.best[k]) - (RAGGED if single and ragged(int(u.before[a]), int(u.before[b]), k) else 0.0)
                if gain <= LEAST:
                    continue
                parts = [(a, b)]
                for lo, hi in ((base, a), (b, int(u.first[k + 1]) - 1)):
                    if hi - lo > 1:
                        for x, y in stretches(u.gain[lo : hi + 1].tolist(), PRICE):
                            more = float(u.gain[lo + y] - u.gain[lo + x]) - PRICE
                            if not (single and more <= RAGGED and ragged(int(u.before[lo + x]), int(u.before[lo + y]), k)):
                                parts.append((lo + x, lo + y))
                                gain += more
                if gain < top[own_ids[k]] - BEHIND:
                    continue  # as below, before anything is put together
                top[own_ids[k]] = max(top[own_ids[k]], gain)
                parts.sort()
                pieces, at = [], int(own_starts[k])
                for x, y in parts:
                    pieces += [own_cps[at : u.before[x]], _written(u, x, y, own_cps)]
                    at = int(u.before[y])
                whole = np.concatenate([*pieces, own_cps[at : own_starts[k + 1]]])
                found[own_ids[k]].append((gain, f"{right}>{wrong}", whole[whole != 10]))
    for own_found in found:
        own_found.sort(key=lambda x: (-x[0], x[1]))
        while own_found and own_found[-1][0] < own_found[0][0] - BEHIND:
            own_found.pop()
    return found


def evidence_of(texts: list[np.ndarray], model: Model) -> list[list[tuple[float, str, str]]]:
    """Evidence (gain, chain, repaired text) of each strange text; the best chain's remains are undone as well.

    A text that was read wrongly twice was written once: a further chain must have the right encoding of the
    first. Lost characters add the same to every chain, and are the evidence of the unknown one.
    """
    first = explain(texts, model)
    again = [i for i, f in enumerate(first) if f and f[0][0] > AGAIN]
    state = {i: first[i][0] for i in again}
    while again:  # it ends: every round adds more than KNOWN to the text's likelihood, which is bounded
        odd, row = strange(*_marked([state[i][2] for i in again]), model)
        again = [again[k] for k in np.flatnonzero(np.bincount(row[odd], minlength=len(again)))]
        more = explain([state[i][2] for i in again], model, [{c.partition(">")[0] for c in state[i][1].split("|")} for i in again]) if again else []
        left = []
        for i, m in zip(again, more, strict=True):
            gain, chain, _ = state[i]
            names = chain.split("|")
            # the chain that the rest of the text went through, else the best one
            best = next((x for x in m if x[1] in names and x[0] > KNOWN), m[0] if m and m[0][0] > AGAIN else None)
            if best and not np.array_equal(best[2], state[i][2]):
                state[i] = (gain + best[0], chain if best[1] in names else "|".join([*names, best[1]]), best[2])
                left.append(i)
        again = left
    out = []
    for i, (t, f) in enumerate(zip(texts, first, strict=True)):
        rows = [state[i], *f[1:]] if i in state else f
        lost = LOST_GAIN * int((t == LOST).sum())
        known = [(g + lost, c, text_of(x if not lost or g > AGAIN else t)) for g, c, x in rows]
        if lost:
            known.append((lost, UNKNOWN, text_of(t)))
        out.append([(g, c, x.replace("\x1c", "\n")) for g, c, x in known])
    return out


#: Parts of the model that are summed apart, and tables that one task sums at most on the first level.
PARTS = 16
FAN = 512


def corpus_model(items: DataFrame, texts: str = "texts") -> Model:
    """The character model of all texts in the array column.

    Every task adds up its own counts in a table of fixed size, mostly zeros, of which the compressed shuffle carries
    a hundredth of the text read. The tables are summed part by part in streams, in two levels beyond ``FAN``
    tasks, so nothing that grows with the corpus comes together in one place. The model has 17 MB.
    """
    step, step1 = BUCKETS // PARTS, UNIGRAMS // PARTS

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, single = np.zeros(BUCKETS, np.int64), np.zeros(UNIGRAMS, np.int64)
        for big in batches:
            for batch in chunks(big, texts):
                count(*codepoints(exploded(strings(batch.column(texts)))[2]), pairs, single)
        if single.any():
            for k in range(PARTS):
                blob = np.concatenate([pairs[k * step : (k + 1) * step], single[k * step1 : (k + 1) * step1]])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob.tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(blob.as_buffer(), np.int64)
                sums[k] = sums[k] + one if k in sums else one.copy()
        for k, blob in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob.tobytes()], pa.binary())], names=["part", "counts"])

    schema = "part int, counts binary"
    rows = items.select(texts).mapInArrow(tally, schema)
    groups = -(-items.rdd.getNumPartitions() // FAN)
    if groups > 1:  # so that no task adds up more than FAN tables
        rows = rows.withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(min(groups * PARTS, 20_000), "_g", "part").drop("_g").mapInArrow(add, schema)
    rows = rows.repartition(PARTS, "part").mapInArrow(add, schema).collect()
    pairs, single = np.zeros(BUCKETS, np.float32), np.zeros(UNIGRAMS, np.float64)
    for k, blob in rows:
        one = np.frombuffer(blob, np.int64)
        pairs[k * step : (k + 1) * step], single[k * step1 : (k + 1) * step1] = one[:step], one[step:]
    return Model(pairs, single)


EVIDENCE = "chains array<struct<chain:string,gain:double,repaired:string>>"


def evidence(items: DataFrame, model: Model) -> DataFrame:
    """Evidence for chains in the texts of ``items`` (place, source, row_id, texts array<string>).

    Returns place, source, row_id, pos, and ``chains``, an array of chain, gain, repaired with every chain that
    there is evidence for. Texts without any have no row; null and empty texts never have.
    """
    shared = items.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]] = []

        def flush() -> pa.RecordBatch:
            done = iter(evidence_of([t for w in waiting for t in w[3]], shared.value))
            keys, cols, ends = [], [[], [], []], [0]
            for batch, row, pos, _ in waiting:
                with_evidence = []
                for k in range(len(row)):
                    found = next(done)
                    if found:
                        with_evidence.append(k)
                        for gain, chain, fixed in found:
                            for col, v in zip(cols, (chain, gain, fixed), strict=True):
                                col.append(v)
                        ends.append(len(cols[0]))
                take = pa.array(row[with_evidence], pa.int64())
                keys.append([*(batch.column(c).take(take) for c in ("place", "source", "row_id")), pa.array(pos[with_evidence], pa.int32())])
            waiting.clear()
            structs = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True)], names=["chain", "gain", "repaired"])
            whole = [pa.concat_arrays(c) for c in zip(*keys, strict=True)]
            return pa.RecordBatch.from_arrays([*whole, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)], names=["place", "source", "row_id", "pos", "chains"])

        size = 0
        for big in batches:
            for batch in chunks(big, "texts"):
                row, pos, flat = exploded(strings(batch.column("texts")))
                cps, starts = codepoints(flat)
                odd, text = strange(cps, starts, shared.value)
                ids = np.flatnonzero(np.bincount(text[odd], minlength=len(flat)))
                if len(ids):
                    picked = [cps[starts[i] : starts[i + 1]].copy() for i in ids.tolist()]
                    size += sum(map(len, picked))
                    waiting.append((batch, row[ids], pos[ids], picked))
                if size > 150_000:
                    yield flush()
                    size = 0
        if waiting:
            yield flush()

    return items.select("place", "source", "row_id", "texts").mapInArrow(run, f"place string, source string, row_id bigint, pos int, {EVIDENCE}")


def posterior(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Expectation-maximization over the evidence: ``found`` with ``posterior``, an array along ``chains``.

    ``totals`` (place, source, n) has the number of texts of each field and source: those without evidence count
    as undamaged. A null source is a source like any other. A round joins each text to the chain priors of its
    source, a map of as many entries as there are chains, and adds the posteriors up by source and chain; it is the
    last once the shares have settled. Only sums by chain come to the driver.
    """
    key = F.concat_ws("\x00", "place", F.coalesce("source", F.lit("\x01")))
    rows = found.withColumn("_key", key)
    sizes = cut(totals.groupBy(key.alias("_key")).agg(F.sum("n").alias("n")), "em")
    whole = float(sizes.agg(F.sum("n")).first()[0] or 1)
    kinds = len(CHAINS) + 1
    start = DAMAGED / kinds
    gains = rows.select("_key", F.transform("chains", lambda c: F.struct(c["chain"].alias("chain"), c["gain"].alias("gain"))).alias("chains"))

    def judged(df: DataFrame, prior: DataFrame | None) -> DataFrame:
        """With ``posterior``: prior times likelihood over their sum, the undamaged text's among them."""
        df = df.withColumn("_prior", F.lit(None).cast("map<string,double>")) if prior is None else join_small(df, prior, ["_key"], "left")
        known = F.lit(start) if prior is None else F.lit(start / 10)
        top = F.greatest(F.array_max(F.transform("chains", lambda c: c["gain"])), F.lit(0.0))
        weigh = F.transform("chains", lambda c: F.coalesce(F.try_element_at("_prior", c["chain"]), known) * F.exp(c["gain"] - F.col("_top")))
        df = df.withColumn("_top", top).withColumn("_w", weigh)
        every = F.aggregate("_w", (1 - DAMAGED) * F.exp(-F.col("_top")), lambda a, w: a + w)
        return df.withColumn("_all", every).withColumn("posterior", F.transform("_w", lambda w: w / F.col("_all"))).drop("_prior", "_top", "_w", "_all")

    prior, before = None, {}
    for _ in range(ITERATIONS):
        each = F.explode(F.arrays_zip(F.col("chains.chain").alias("chain"), F.col("posterior").alias("p"))).alias("e")
        mass = cut(judged(gains, prior).select("_key", each).groupBy("_key", F.col("e.chain").alias("chain")).agg(F.sum("e.p").alias("m")), "em")
        sums = {r[0]: r[1] for r in mass.groupBy("chain").agg(F.sum("m")).collect()}
        common = F.create_map(*(F.lit(x) for c, m in sums.items() for x in (c, (m + start) / (whole + kinds)))) if sums else F.create_map().cast("map<string,double>")
        shares = join_small(mass, sizes, ["_key"], "left")
        share = (F.col("m") + WEIGHT * F.try_element_at(common, F.col("chain"))) / (F.coalesce("n", F.lit(0)) + WEIGHT)
        prior = shares.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("chain", share.alias("p")))).alias("_prior"))
        moved = sum(abs(sums.get(c, 0.0) - before.get(c, 0.0)) for c in {*sums, *before})
        before = sums
        if moved <= MOVED * sum(sums.values()):
            break
    return judged(rows, prior).drop("_key")


def repaired_texts(found: DataFrame) -> DataFrame:
    """One row per damaged text: place, source, row_id, pos, chain, posterior, repaired.

    A text is damaged if its chains together have a posterior of one half or more; ``chain`` and ``repaired``
    are those of the most likely one, ties by name. Characters that can't be told any more are U+FFFD.
    """
    each = F.zip_with("posterior", "chains", lambda p, c: F.struct(p.alias("p"), c["chain"].alias("chain"), c["repaired"].alias("repaired")))
    total = F.aggregate("posterior", F.lit(0.0), lambda a, p: a + p)
    rows = found.select("place", "source", "row_id", "pos", F.array_max(each).alias("b"), total.alias("posterior")).where("posterior >= 0.5")
    return rows.select("place", "source", "row_id", "pos", "b.chain", "posterior", "b.repaired").dropDuplicates(["place", "source", "row_id", "pos"])


def repair(items: DataFrame, model: Model | None = None, totals: DataFrame | None = None, pools: DataFrame | None = None) -> DataFrame:
    """Damaged texts of ``items`` (place, source, row_id, texts) and their repair, see ``repaired_texts``.

    ``pools`` (source, pool) names the pool of each source, where evidence is put together by something that the
    items don't have; it joins the evidence, never the texts. Repeated rows are judged each (equal row_id and pos
    count as one text). Empty tables give an empty result.
    """
    if totals is None:
        totals = items.groupBy("place", "source").agg(F.sum(F.size(F.coalesce("texts", F.array().cast("array<string>")))).alias("n"))
    found = evidence(items, model or corpus_model(items))
    if pools is not None:
        named = pools.select("source", F.col("pool").alias("_pool"))
        found, totals = (join_small(df, named, ["source"], "left").withColumn("source", F.col("_pool")).drop("_pool") for df in (found, totals))
    return repaired_texts(posterior(cut(found, "evidence"), totals))
