"""Sentence boundaries across languages and scripts (problem 6).

A terminator ends a sentence unless it stands within a pair of quotation marks, brackets or title marks. Speech
that opens a sentence goes on with the clause after it; speech led in by a colon or comma ends its sentence.
Whether a full stop belongs to an abbreviation is decided from the document: from what follows the same word and
full stop where that is unambiguous (a small letter, a figure, the end of a paragraph), with the whole corpus as
fallback for words the document says too little about. Words that are never at an end are titles and initials,
after which a capital begins a name, unless the document has the word that follows in small letters and nowhere
capitalised within a sentence: then it is no name, and a sentence begins with it. Scripts have their own
terminators; Thai parts sentences by single blanks.

Texts are compared by shape (width, look-alikes, kinds of blanks, invisible characters make no difference), and
positions are those of the stored text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks, exploded, strings

#: Weight of the document's own occurrences against the corpus'.
OWN = 8
#: Occurrences needed before a word counts as one that never ends a sentence, and the share of ends allowed.
SEEN = 8
ENDS = 0.01

# Pairs that nothing is cut within; those of the first line hold speech.
SPEECH = {"“": "”", "„": "“", "「": "」", "『": "』", "«": "»", "‹": "›", '"': '"', "‟": "”", "〝": "〞"}
BRACKETS = {"(": ")", "[": "]", "《": "》", "〈": "〉", "【": "】", "〔": "〕", "{": "}", "『": "』"}
STOPS = "。！？!?.।॥؟۔｡"
CLOSERS = "”“’»›」』)]》〉】〕}〞\""
_OPEN_AT = set("“„「『«‹‟〝") | set(BRACKETS)
_END = re.compile(r"[。！？!?.।॥؟۔]+|…+")
_IN_WORD = re.compile(r"[\w’'\-]")
_DOT = re.compile(r"(?<=[^\W\d_])\.(?:(?=[,;:])|(?=[\"”»’)\]]*\s*$)|(?=\s))")
# Marks around speech whose words aren't counted.
_QUOTES = {"“": "”", "„": "“", "«": "»", '"': '"', "「": "」"}
_QUOTE = re.compile("[" + "".join(_QUOTES) + "]")
_TAIL = re.compile(r"[ \t\"”»’)\]]*$")
_INK = re.compile(r"\S")
_BLANKS = re.compile(r" +")
_SMALL = re.compile(r"(?<![\w’'\-])[^\W\d_]+(?![\w’'\-])")
_NEXT = re.compile(r"\s+[^\w\s]*(\w)(\w?)")
_THAI = re.compile(r"[฀-๿]")
_MAYBE = re.compile(r"[^\W\d_][.．](?!\d)")
_LETTER = re.compile(r"\w")
_CASED = re.compile(r"[^\W\d_]+")
#: A word within a sentence: after a small letter or comma and one blank.
_INSIDE = re.compile(r"(?<=[^\W\d_A-Z,] )[^\W\d_]+")


class Shapes:
    """Folding of texts character by character, with the place of each character left."""

    def __init__(self) -> None:
        from .lookalike import _DROP, _tables

        t = _tables()
        fold = t.fold.copy()
        self.table, self.drop = fold, _DROP

    def __call__(self, text: str) -> tuple[str, np.ndarray | None]:
        if text.isascii():
            return text, None
        cps = np.frombuffer(text.encode("utf-32-le"), "<u4")
        out = self.table[cps]
        keep = np.flatnonzero(out != self.drop)
        return out[keep].astype("<u4").tobytes().decode("utf-32-le"), keep if len(keep) != len(cps) else None


_SHAPES: list[Shapes] = []


def shapes() -> Shapes:
    if not _SHAPES:
        _SHAPES.append(Shapes())
    return _SHAPES[0]


def occurrences(text: str) -> Iterator[tuple[str, str]]:
    """(word, what follows) of each word with a full stop outside speech.

    What follows is l, a small letter; d, a figure; c, a capital; e, the end; p, a mark within the sentence.
    """
    text = _without_speech(text)
    for m in _DOT.finditer(text):
        stop = m.start()
        at = stop - 1
        while at >= 0 and (text[at].isalpha() or text[at] in ".’'-"):
            at -= 1
        word = text[at + 1 : stop].strip(".’'-").lower()
        if not word:
            continue
        nxt = text[stop + 1 : stop + 2]
        if nxt and nxt in ",;:":
            yield word, "p"
            continue
        k = _NEXT.match(text, stop + 1)
        if not k:
            if _TAIL.match(text, stop + 1):
                yield word, "e"
        elif k[1].isdigit():
            yield word, "d"
        else:
            # letters of swapped case count as capitals
            yield word, "l" if k[1].islower() and not k[2].isupper() else "c"


def _without_speech(text: str) -> str:
    """The text with two marks instead of what stands between quotation marks."""
    out, at, closed = [], 0, dict.fromkeys(_QUOTES, True)
    for m in _QUOTE.finditer(text):
        i, mark = m.start(), m[0]
        if i < at or not closed[mark]:
            continue
        end = text.find(_QUOTES[mark], i + 1)
        if end < 0:
            closed[mark] = False
            continue
        out += (text[at:i], '""')
        at = end + 1
    return "".join([*out, text[at:]]) if out else text


Counts = dict[str, tuple[int, ...]]


def judge(word: str, own: Counter | None, corpus: tuple[int, ...] | None) -> tuple[bool, bool, bool]:
    """Whether a full stop after ``word`` ends nothing before (a capital, a small letter, a figure).

    ``corpus`` has how often c, l, d, p and e follow, see ``occurrences``.
    """
    n = Counter(dict(zip("cldpe", corpus or (), strict=False)))
    for k, v in (own or {}).items():
        n[k] += OWN * v
    capital, small, figure, end = n["c"], n["l"] + n["p"], n["d"], n["e"]
    total = capital + small + figure + end
    single = len(word) == 1
    # the corpus lists words that end less often than others; a word that it doesn't list ends sentences
    never_ends = bool(corpus) and sum(corpus) >= SEEN and end <= ENDS * total and (len(word) <= 5 or small + figure > capital)
    return (single and end <= max(1, 0.05 * total)) or never_ends, single or small > 0.2 * total or never_ends, figure > 0.3 * total or (single and figure > 0)


class Splitter:
    """Splits the paragraphs of one document."""

    def __init__(self, paragraphs: list[str], corpus: Counts):
        self.corpus = corpus
        self.own: dict[str, Counter] = {}
        self.folded = [shapes()(p) for p in paragraphs]
        for text, _ in self.folded:
            for word, what in occurrences(text):
                self.own.setdefault(word, Counter())[what] += 1
        self.known: dict[str, tuple[bool, bool, bool]] = {}
        self.words: set[str] | None = None
        self.names: set[str] = set()

    def ends(self, no: int) -> list[int]:
        """Ends of the sentences of paragraph ``no``, in characters of the stored text."""
        text, places = self.folded[no]
        return [int(places[e - 1]) + 1 if places is not None else e for e in self._ends(text)]

    def _word_before(self, text: str, stop: int) -> str:
        """The word that ends at ``stop``, single full stops within included."""
        at = stop
        while at and (_IN_WORD.match(text, at - 1) or (text[at - 1] == "." and at < stop and text[at] != "." and at > 1 and _IN_WORD.match(text, at - 2))):
            at -= 1
        return text[at:stop].strip("’'-").lower()

    def _no_name(self, word: str) -> bool:
        """Whether the document knows the word in small letters and never capitalised within a sentence; never an initial."""
        if self.words is None:
            self.words = {w for t, _ in self.folded for w in _SMALL.findall(t) if w.islower()}
            self.names = {w.lower() for t, _ in self.folded for w in _INSIDE.findall(t) if not w.islower()}
        return len(word) > 1 and word.lower() in self.words and word.lower() not in self.names

    def _abbreviation(self, text: str, stop: int, at: int, n: int) -> bool:
        """Whether the full stop at ``stop`` ends nothing although what stands at ``at``, after the blanks, follows."""
        first = self._letter(text, at, n)
        word = self._word_before(text, stop)
        if not word or first < 0:
            return False
        ch = text[first]
        if word.isdigit():
            return len(word) <= 2 and ch.isalpha() and first == at
        if word not in self.known:
            self.known[word] = judge(word, self.own.get(word), self.corpus.get(word))
        capital, small, figure = self.known[word]
        if ch.isdigit():
            return figure
        if ch.islower() and not text[first + 1 : first + 2].isupper():
            return small
        if first > at and text[at] in _OPEN_AT and not capital:
            return False
        return capital and not (ch.isupper() and self._no_name(_CASED.match(text, first)[0]))

    def _letter(self, text: str, at: int, n: int) -> int:
        """Where the first letter or figure from ``at`` on is, -1 if there is none; asked for in order."""
        if not at <= self.letter:
            m = _LETTER.search(text, at, n)
            self.letter = m.start() if m else n
        return self.letter if self.letter < n else -1

    def _ends(self, text: str) -> list[int]:
        n = len(text.rstrip())
        if not n:
            return []
        spans = _spans(text)
        self.letter, self.stop = -1, None
        cuts = set()
        begin = 0
        at = 0
        order = sorted(spans.items())
        nxt_span = 0
        thai = bool(_THAI.search(text))
        while at < n:
            while nxt_span < len(order) and order[nxt_span][0] < at:
                nxt_span += 1
            span = order[nxt_span] if nxt_span < len(order) else None
            stop = self._next_stop(text, at, span[0] if span else n, thai, n)
            if stop:
                start, end = stop
                if self._is_end(text, start, end, n):
                    end = _closers(text, end, spans)
                    cuts.add(end)
                    begin = end
                at = max(end, at + 1)
                continue
            if not span:
                break
            opened, closed = span
            after = closed + 1
            if text[opened] in SPEECH and _speech_ends(text, opened, closed, begin):
                after = _closers(text, after, spans)
                cuts.add(after)
                begin = after
            at = after
        return _tidy(text, cuts, n)

    def _next_stop(self, text: str, at: int, limit: int, thai: bool, n: int) -> tuple[int, int] | None:
        # the last search is kept until it is passed, so that no stretch is searched twice
        if self.stop is None or self.stop[0] < at:
            m = _END.search(text, at, n)
            self.stop = (m.start(), m.end()) if m else (n, n)
        start = min(self.stop[0], limit)
        if thai:
            for b in _BLANKS.finditer(text, at, start):
                i, j = b.start(), b.end()
                if 0 < i and j < n and j - i == 1 and _parts_thai(text[i - 1], text[j]):
                    return i, i
        return self.stop if self.stop[0] < limit else None

    def _is_end(self, text: str, start: int, end: int, n: int) -> bool:
        if start == end:
            return True  # a blank between Thai clauses
        if end >= n:
            return True
        at = _INK.search(text, end).start()
        blank = at > end
        mark = text[start:end]
        if mark[0] == "…" or (len(mark) > 1 and set(mark) == {"."}):
            if not blank:
                return False
            first = self._letter(text, at, n)
            ch = text[first] if first >= 0 else ""
            return bool(ch) and (ch.isdigit() or ch.isupper() or (not ch.islower() and not _cjk(ch)))
        if mark == ".":
            before = text[start - 1 : start]
            if not blank:
                return text[at] in CLOSERS
            if before and "ऀ" <= before <= "ॿ":
                return False
            if before and _THAI.match(before):
                return False
            return not self._abbreviation(text, start, at, n)
        if mark[-1] in "!?" and not blank and text[at] in ",;:，；：":
            return False
        return True


def _cjk(ch: str) -> bool:
    return "⺀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "぀" <= ch <= "ヿ"


def _parts_thai(a: str, b: str) -> bool:
    """Whether a single blank between these characters parts sentences."""
    if a.isdigit() or b.isdigit() or a == "ๆ" or b == "ๆ":
        return False
    return bool(_THAI.match(a) or a in CLOSERS) and bool(_THAI.match(b) or b in _OPEN_AT)


def _spans(text: str) -> dict[int, int]:
    """Where each outermost pair opens and closes; marks without a partner count for nothing."""
    pairs: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # where in the stack what each closing mark closes is
    straight = -1
    for m in _MARKS.finditer(text):
        ch, i = m[0], m.start()
        if ch == '"':
            if straight >= 0:
                pairs.append((straight, i))
                straight = -1
            else:
                straight = i
            continue
        if waiting.get(ch):
            to = waiting[ch][-1]
            pairs.append((stack[to][1], i))
            while len(stack) > to:
                waiting[stack.pop()[0]].pop()
        elif (closing := SPEECH.get(ch) or BRACKETS.get(ch)) is not None:
            waiting.setdefault(closing, []).append(len(stack))
            stack.append((closing, i))
    out: dict[int, int] = {}
    reach = -1
    for a, b in sorted(pairs):
        if a > reach:
            out[a] = b
            reach = b
    return out


_MARKS = re.compile("[" + re.escape("".join({*SPEECH, *SPEECH.values(), *BRACKETS, *BRACKETS.values()})) + "]")


def _speech_ends(text: str, opened: int, closed: int, begin: int) -> bool:
    """Whether a sentence ends with the speech between these marks."""
    said = _last_ink(text, opened + 1, closed)
    if not said or said not in STOPS + "…":
        return False
    lead = _last_ink(text, begin, opened)
    if not lead:
        rest = _INK.search(text, closed + 1)
        return bool(rest) and rest[0] in SPEECH and rest[0] != '"'
    return lead in ":：,，、"


def _last_ink(text: str, low: int, high: int) -> str:
    """The last character between that isn't blank; none gives an empty string."""
    while high > low and text[high - 1].isspace():
        high -= 1
    return text[high - 1] if high > low else ""


def _closers(text: str, end: int, spans: dict[int, int]) -> int:
    """``end`` beyond closing marks and further stops that belong to the sentence."""
    while end < len(text) and ((text[end] in CLOSERS and end not in spans) or text[end] in "。！？!?…।"):
        end += 1
    return end


def _tidy(text: str, cuts: set[int], n: int) -> list[int]:
    """Ends at the last visible character; a stretch without letters or figures belongs to the sentence before."""
    out: list[int] = []
    begin = 0
    for cut in [*sorted(c for c in cuts if c < n), n]:
        part = text[begin:cut]
        if _LETTER.search(part) or not out:
            out.append(begin + len(part.rstrip()))
        else:
            out[-1] = begin + len(part.rstrip())
        begin = cut
    if len(out) > 1 and not _LETTER.search(text[: out[0]]):
        del out[0]
    return out


def abbreviation_counts(df: DataFrame, paragraphs: str) -> DataFrame:
    """(word, c, l, d, p, e) over the whole corpus: how often a word with full stop is followed by what.

    Counted per task and added up by word, so a frequent word sends one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        fold = shapes()
        for big in batches:
            for batch in chunks(big, paragraphs):
                for text in exploded(strings(batch.column(0)))[2].to_pylist():
                    if text and _MAYBE.search(text):
                        seen.update(occurrences(fold(text)[0]))
        words = sorted({w for w, _ in seen})
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([seen[w, k] for w in words], pa.int64()) for k in "cldpe")], names=["word", *"cldpe"])

    rows = df.select(paragraphs).mapInArrow(run, "word string, c long, l long, d long, p long, e long")
    return rows.groupBy("word").agg(*(F.sum(k).alias(k) for k in "cldpe"))


#: Words up to which the fallback is a table on every worker; beyond, each document is joined to its words.
MAX_WORDS = 100_000


def abbreviations(counts: DataFrame) -> DataFrame:
    """The words that may be abbreviations: those rarely or never at an end, or often before a small letter or figure.

    Words that behave as any last word of a sentence need no entry, see ``judge``.
    """
    every = "(c + l + d + p + e)"
    return counts.where(f"(e <= 0.02 * {every} and (length(word) <= 6 or l + p + d > c)) or l + p > 0.2 * {every} or d > 0.3 * {every} or length(word) <= 2")


def _dotted(paragraphs: list[str | None] | None) -> set[str]:
    fold = shapes()
    return {w for t in paragraphs or () if t and _MAYBE.search(t) for w, _ in occurrences(fold(t)[0])}


def _with_words(df: DataFrame, key: str, paragraphs: str, words: DataFrame) -> DataFrame:
    """``key``, ``paragraphs`` and ``_words``, the fallback of each document's own words."""
    schema = df.select(key).schema.add("word", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, paragraphs):
                row, word = [], []
                for i, texts in enumerate(batch.column(1).to_pylist()):
                    for w in sorted(_dotted(texts)):
                        row.append(i)
                        word.append(w)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(word, pa.string())], names=schema.names)

    rows = df.select(key, paragraphs)
    own = rows.mapInArrow(run, schema).distinct().join(words, "word").groupBy(key).agg(F.collect_list(F.struct("word", *"cldpe")).alias("_words"))
    own = own.withColumnRenamed(key, "_key")
    return rows.join(own, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, paragraphs, "_words")


def sentence_ends(df: DataFrame, key: str, paragraphs: str, words: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """(key, para_no, sentence_no, end_pos) for every sentence of every paragraph.

    ``words`` is what ``abbreviations`` gives for the corpus. Up to ``max_words`` of them go to every worker, else
    each document is joined to those it has. A document is a row of ``df``; repeated rows are documents of their own. Null and blank paragraphs and empty
    arrays have no sentence; a paragraph without a terminator is one. Other columns are dropped.
    """
    schema = df.select(key).schema.add("para_no", "integer").add("sentence_no", "integer").add("end_pos", "integer")
    listed = words.select("word", *"cldpe").limit(max_words + 1).collect()
    beyond = len(listed) > max_words
    shared = df.sparkSession.sparkContext.broadcast({} if beyond else {r[0]: tuple(r[1:]) for r in listed})
    rows = _with_words(df, key, paragraphs, words) if beyond else df.select(key, paragraphs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, paragraphs):
                row, para, sent, end = [], [], [], []
                own = ({w["word"]: tuple(w[k] for k in "cldpe") for w in ws or ()} for ws in batch.column(2).to_pylist()) if beyond else None
                for i, texts in enumerate(batch.column(1).to_pylist()):
                    splitter = Splitter([t or "" for t in texts or ()], shared.value if own is None else next(own))
                    for p in range(len(splitter.folded)):
                        for k, e in enumerate(splitter.ends(p)):
                            row.append(i)
                            para.append(p)
                            sent.append(k)
                            end.append(e)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (para, sent, end))], names=schema.names)

    return rows.mapInArrow(run, schema)
