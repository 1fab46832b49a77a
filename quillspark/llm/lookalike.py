"""Visually identical text with different characters (problem 4).

Text is handled as numpy arrays of Unicode code points. One table gather replaces width forms, spaces, radicals
and look-alike letters and drops what is invisible; texts that hold combining marks (or characters that must be
expanded) are decomposed through offset tables, their marks brought into canonical order and composed again, all
over whole arrays. The result is NFC but for the folding; there is no call per row or per character.

What a reader can tell apart stays apart: letter case, accents, raised and enclosed figures, dashes of other
length, words.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_small
from .text import chunks, codepoints, exploded, strings, to_strings

# Letters of one script or block that look like a letter of another, and that letter.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԝ": "w", "ѵ": "v", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    # Greek
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "ρ": "p", "υ": "u", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "Ϲ": "C", "ϲ": "c",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O", "Տ": "S", "Լ": "L",
    # Latin letters of other blocks
    "ı": "i", "ɑ": "a", "ɡ": "g", "ǃ": "!", "ɩ": "i", "ʏ": "y",
    # hyphens
    "‐": "-", "‑": "-",
}
# Kana that look like an ideograph or another kana. They are replaced after the marks are composed,
# as a voiced kana is another letter.
KANA = {"ロ": "口", "ニ": "二", "ハ": "八", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ノ": "丿", "オ": "才", "ム": "厶", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}
# Radicals of the supplement block whose ideograph the character data doesn't give.
RADICALS = {"⺀": "冫", "⺁": "厂", "⺄": "乙", "⺅": "亻", "⺈": "刀", "⺉": "刂", "⺊": "卜", "⺋": "卩", "⺍": "小", "⺎": "兀", "⺏": "尣", "⺒": "巳", "⺓": "幺", "⺕": "彐", "⺖": "忄", "⺘": "扌", "⺙": "攵", "⺛": "旡", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺤": "爫", "⺨": "犭", "⺩": "王", "⺫": "罒", "⺬": "示", "⺭": "礻", "⺮": "竹", "⺯": "糸", "⺰": "纟", "⺲": "罒", "⺶": "羊", "⺹": "耂", "⺻": "聿", "⺼": "月", "⺽": "臼", "⺾": "艹", "⺿": "艹", "⻀": "艹", "⻁": "虎", "⻂": "衤", "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻊": "足", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅", "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻕": "阝", "⻖": "阝", "⻗": "雨", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠", "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻮": "齿", "⻰": "龙", "⻲": "龟"}

_SIZE = 0x110000
#: The planes that have characters of their own.
ASSIGNED = (*range(0x34000), *range(0xE0000, 0xE1000))
_DROP = 0xFFFFFFFF
_L, _V, _T, _S = 0x1100, 0x1161, 0x11A7, 0xAC00


class _Tables:
    """Everything that is looked up, derived from the character data by rule."""

    def __init__(self) -> None:
        fold = np.arange(_SIZE, dtype=np.uint32)
        ccc = np.zeros(_SIZE, np.uint8)
        canonical: dict[int, str] = {}
        wide: dict[int, str] = {}
        alike = {ord(a): ord(b) for a, b in (LOOKALIKES | RADICALS).items()}
        for cp in ASSIGNED:
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Co", "Cs") and not 0xE0000 <= cp <= 0xE0FFF:
                continue
            if kind in ("Zs", "Zl", "Zp") or cp in (9, 10, 11, 12, 13, 0x85):
                fold[cp] = 0x20
                continue
            if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
                fold[cp] = _DROP
                continue
            ccc[cp] = unicodedata.combining(ch)
            form = unicodedata.decomposition(ch)
            if not form:
                continue
            if form[0] != "<":
                canonical[cp] = unicodedata.normalize("NFD", ch)
                continue
            tag, *codes = form.split()
            target = "".join(chr(int(x, 16)) for x in codes)
            radical = 0x2E80 <= cp <= 0x2FDF
            if tag in ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>") or radical or cp in (0x0E33, 0x0EB3):
                wide[cp] = target
            elif 0x2160 <= cp <= 0x217F or 0xFB00 <= cp <= 0xFB06 or 0x01C7 <= cp <= 0x01CC or 0x01F1 <= cp <= 0x01F3 or cp in (0x0132, 0x0133):
                wide[cp] = target  # letters run together: roman numerals, ligatures, digraphs
        expand: dict[int, str] = {}

        def settle(text: str) -> str:
            """Width, then decomposition, then look-alikes, then composition."""
            text = "".join(wide.get(ord(c), c) for c in text)
            text = unicodedata.normalize("NFD", "".join(wide.get(ord(c), c) for c in text))
            return "".join(chr(alike.get(ord(c), ord(c))) for c in text)

        for cp in {*wide, *canonical, *alike}:
            if 0xAC00 <= cp <= 0xD7A3:
                continue
            apart = settle(chr(cp))
            whole = unicodedata.normalize("NFC", apart)
            if len(whole) == 1:
                fold[cp] = ord(whole)
            else:
                expand[cp] = apart
        pairs = {}
        self.decompose: dict[int, str] = {}
        for cp, apart in canonical.items():
            if 0xAC00 <= cp <= 0xD7A3:
                continue
            two = [int(x, 16) for x in unicodedata.decomposition(chr(cp)).split()]
            if len(two) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
                pairs[two[0] << 21 | two[1]] = cp
            if fold[cp] == cp:
                self.decompose[cp] = apart
        self.fold, self.ccc = fold, ccc
        self.last = np.arange(_SIZE, dtype=np.uint32)
        for a, b in KANA.items():
            self.last[ord(a)] = ord(b)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_values = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        # expansion by offsets: a character's replacement is flat[first[cp] : first[cp] + length[cp]]
        every = expand | self.decompose
        self.length = np.ones(_SIZE, np.int16)
        self.first = np.zeros(_SIZE, np.int32)
        flat: list[int] = []
        for cp, text in every.items():
            self.first[cp], self.length[cp] = len(flat), len(text)
            flat += map(ord, text)
        self.flat = np.array(flat or [0], np.uint32)
        self.special = np.zeros(_SIZE, bool)
        for cp in every:
            self.special[cp] = True
        self.slow = ccc > 0
        self.slow[list(expand)] = True
        self.slow[_V : _V + 21] = True
        self.slow[_T + 1 : _T + 28] = True
        seconds = {k & 0x1FFFFF for k in pairs}
        self.slow[list(seconds)] = True


@functools.cache
def _tables() -> _Tables:
    return _Tables()


@functools.cache
def shape_table() -> np.ndarray:
    """For each code point the lower-case form of what it looks like, and 0xFFFFFFFF for what is invisible.

    Raised and enclosed figures and letters count as plain ones here, voiced kana as unvoiced ones.
    """
    t = _tables()
    out = t.last[np.where(t.fold == _DROP, 0, t.fold)]
    for cp in (*range(0xB2, 0xBB), *range(0x2070, 0x209D), *range(0x2460, 0x24EB), *range(0x3280, 0x32BF)):
        plain = unicodedata.normalize("NFKC", chr(cp))
        if len(plain) == 1:
            out[cp] = ord(plain)
    for cp in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)):
        out[cp] = t.last[ord(unicodedata.normalize("NFD", chr(cp))[0])]
    out[[0x3099, 0x309A, 0xFF9E, 0xFF9F]] = 0
    lower = np.arange(_SIZE, dtype=np.uint32)
    for cp in ASSIGNED:
        low = chr(cp).lower() if not 0xD800 <= cp < 0xE000 else ""
        if len(low) == 1:
            lower[cp] = ord(low)
    out = out[lower[out]]
    return np.where((t.fold == _DROP) | ((out == 0) & (np.arange(_SIZE) > 0)), _DROP, out).astype(np.uint32)


def _compose(cps: np.ndarray, row: np.ndarray, t: _Tables) -> tuple[np.ndarray, np.ndarray]:
    """Decompose, order the marks, compose; ``row`` tells which text each code point belongs to."""
    special = t.special[cps]
    length = np.where(special, t.length[cps], 1)
    source = np.repeat(np.arange(len(cps)), length)
    within = np.arange(len(source)) - (np.cumsum(length) - length)[source]
    out = np.where(special[source], t.flat[np.minimum(t.first[cps][source] + within, len(t.flat) - 1)], cps[source])
    row = row[source]
    first = np.ones(len(out), bool)
    first[1:] = row[1:] != row[:-1]
    ccc = t.ccc[out]
    order = np.lexsort((ccc, np.cumsum((ccc == 0) | first)))
    out, row = out[order], row[order]
    while len(out) > 1:
        # each character with its base: a mark with the last one that isn't a mark, another with the one before it. The
        # marks are in order, so one is cut off from its base only by one of the same class right before it.
        ccc = t.ccc[out]
        at = np.arange(len(out))
        start = (ccc == 0) | np.concatenate([[True], row[1:] != row[:-1]])
        last = np.maximum.accumulate(np.where(start, at, 0))
        base = np.where(start, at - 1, last)
        clear = np.concatenate([[False], np.where(start[1:], ccc[:-1] == 0, (last[1:] == at[:-1]) | (ccc[:-1] < ccc[1:]))])
        ok = clear & (row[base] == row) & (ccc[base] == 0)
        a, b = out[base].astype(np.int64), out.astype(np.int64)
        key = a << 21 | b
        where = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = ok & (t.pair_keys[where] == key)
        made = t.pair_values[where].astype(np.int64)
        lv = ok & start & (a >= _L) & (a < _L + 19) & (b >= _V) & (b < _V + 21)
        made = np.where(lv, _S + ((a - _L) * 21 + (b - _V)) * 28, made)
        lvt = ok & start & (a >= _S) & (a < _S + 11172) & ((a - _S) % 28 == 0) & (b > _T) & (b < _T + 28)
        made = np.where(lvt, a + (b - _T), made)
        spots = np.flatnonzero(hit | lv | lvt)
        if not len(spots):
            break
        # of characters that would join one after the other, every second one waits; so does a mark of one that joins
        whole = spots[start[spots]]
        if len(whole):
            fresh = np.concatenate([[True], np.diff(whole) > 1])
            begun = np.maximum.accumulate(np.where(fresh, whole, 0))
            whole = whole[(whole - begun) % 2 == 0]
        marks = spots[~start[spots]]
        marks = marks[~np.isin(base[marks], whole)]
        marks = marks[np.concatenate([[True], base[marks][1:] != base[marks][:-1]])] if len(marks) else marks
        marks = marks[~np.isin(base[marks], base[whole])]
        spots = np.concatenate([whole, marks])
        out[base[spots]] = made[spots]
        stay = np.ones(len(out), bool)
        stay[spots] = False
        out, row = out[stay], row[stay]
    return out, row


def fold_codepoints(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one form of every text: blanks at either end dropped, the rest as the module says."""
    t = _tables()
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    out = t.fold[cps]
    stay = out != _DROP
    out, row = out[stay], row[stay]
    slow = t.slow[out]
    if slow.any():
        rows = np.zeros(n, bool)
        rows[row[slow]] = True
        part = rows[row]
        done, done_row = _compose(out[part], row[part], t)
        out, row = np.concatenate([out[~part], done]), np.concatenate([row[~part], done_row])
        order = np.argsort(row, kind="stable")
        out, row = out[order], row[order]
    out = t.last[out]
    ink = out != 0x20
    spots = np.flatnonzero(ink)
    keep = np.zeros(len(out), bool)
    if len(spots):
        low, high = np.full(n, len(out)), np.full(n, -1)
        change = np.flatnonzero(np.diff(row[spots])) + 1
        low[row[spots[np.concatenate([[0], change])]]] = spots[np.concatenate([[0], change])]
        high[row[spots[np.concatenate([change - 1, [len(spots) - 1]])]]] = spots[np.concatenate([change - 1, [len(spots) - 1]])]
        at = np.arange(len(out))
        keep = (at >= low[row]) & (at <= high[row])
    out, row = out[keep], row[keep]
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n), dtype=np.int64)])


def fold_texts(texts: pa.Array) -> pa.Array:
    """The one form of each text; nulls stay null."""
    done = to_strings(*fold_codepoints(*codepoints(texts)))
    return pc.if_else(texts.is_null(), pa.scalar(None, pa.string()), done) if texts.null_count else done


def fold_column(df: DataFrame, keys: list[str], text: str, out: str = "form") -> DataFrame:
    """``keys`` and the one form of ``text``, a string or an array of strings; other columns are dropped."""
    schema = df.select(*keys, text).schema
    schema = type(schema)([*schema.fields[:-1], type(schema.fields[-1])(out, schema.fields[-1].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in chunks(big, text):
                col = strings(batch.column(text))
                if pa.types.is_list(col.type):
                    row, _, flat = exploded(col)
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(col)))]).astype(np.int32)
                    mask = col.is_null() if col.null_count else None
                    col = pa.ListArray.from_arrays(pa.array(offsets), fold_texts(flat), mask=mask)
                else:
                    col = fold_texts(col)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), col], names=[*keys, out])

    return df.select(*keys, text).mapInArrow(run, schema)


def form_keys(df: DataFrame, keys: list[str], texts: str = "texts") -> DataFrame:
    """``keys``, pos, form, raw of every text in the array column ``texts``.

    ``form`` is the 128-bit hash of the text's one form, ``raw`` that of the text itself; texts without anything
    visible have no row. Texts never leave the map stage.
    """
    from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

    schema = StructType([*df.select(*keys).schema.fields, StructField("pos", IntegerType()), StructField("form", BinaryType()), StructField("raw", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for big in batches:
            for batch in chunks(big, texts):
                row, pos, flat = exploded(strings(batch.column(texts)))
                cps, starts = codepoints(flat)
                folded, ends = fold_codepoints(cps, starts)
                seen = np.flatnonzero(np.diff(ends) > 0)
                whole, raw = memoryview(np.ascontiguousarray(folded, "<u4")).cast("B"), memoryview(np.ascontiguousarray(cps)).cast("B")
                a, b = (ends * 4).tolist(), (starts * 4).tolist()
                forms = [digest(whole[a[i] : a[i + 1]]) for i in seen.tolist()]
                raws = [digest(raw[b[i] : b[i + 1]]) for i in seen.tolist()]
                take = pa.array(row[seen])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(take) for k in keys), pa.array(pos[seen], pa.int32()), pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], names=schema.names
                )

    return df.select(*keys, texts).mapInArrow(run, schema)


#: Rows of one spelling that one task pairs at a time.
BLOCK = 2000


def _spellings(items: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """``items`` with ``_g``, the group as one value that equals itself also where it is null, and the spellings
    (_g, form, raw, n) of forms that have several. Counts are combined before the shuffle."""
    rows = items.withColumn("_g", F.struct(*group))
    sizes = rows.groupBy("_g", "form", "raw").agg(F.count("*").alias("n"))
    several = sizes.groupBy("_g", "form").agg(F.min("raw").alias("r0"), F.max("raw").alias("r1"), F.sum("n").alias("n_form")).where("r0 <> r1").select("_g", "form", "n_form")
    return rows, sizes.join(several, ["_g", "form"])


def alike(items: DataFrame, group: list[str]) -> DataFrame:
    """The rows of ``items`` whose form stands in their group in more than one spelling.

    Only hashes of 64 bits are counted over all rows: those of a form in its group, and the least and greatest of its
    spellings'. What has several is joined by checked broadcast, else salted, so a form that a third of all rows have
    makes even tasks. Forms whose hashes collide come along; ``equal_looking_pairs`` compares the whole of them.
    """
    rows = items.withColumn("_k", F.xxhash64(*(F.coalesce(F.col(g).cast("string"), F.lit("\x00")) for g in group), F.col("form")))
    spelled = rows.select("_k", F.xxhash64("raw").alias("_s")).groupBy("_k").agg(F.min("_s").alias("a"), F.max("_s").alias("b")).where("a <> b").select("_k")
    return join_small(rows, spelled, ["_k"], "left_semi").drop("_k")


def classes(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """One row for each row of ``items`` that has a look-alike: ``group``, ``order``, its class' least ``order`` as
    ``first`` and n_links, the number of rows in the class spelled otherwise. The compact form of all pairs."""
    rows, spelled = _spellings(items, group)
    first = join_small(rows, spelled.select("_g", "form").distinct(), ["_g", "form"], "left_semi").groupBy("_g", "form").agg(F.min(F.struct(*order)).alias("first"))
    known = join_small(rows, spelled.select("_g", "form", "raw", (F.col("n_form") - F.col("n")).alias("n_links")), ["_g", "form", "raw"])
    return join_small(known, first, ["_g", "form"]).select(*group, *order, "first", "n_links")


def equal_looking_pairs(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Pairs of rows within a group with the same ``form`` and another ``raw``, the smaller ``order`` first.

    Returns ``group`` and, for each of ``order``, it with _a and _b. Rows are never paired with those of equal
    ``raw``: the join runs over pairs of spellings, whose number is what differs. Both sides of each are cut into
    blocks of ``BLOCK`` rows, and a task pairs a block with a block, so a line standing in a third of all rows makes
    even tasks and no pair more than the result has. Repeated rows pair each; null group values are a group like
    any other.
    """
    rows, spelled = _spellings(items, group)
    a = spelled.select("_g", "form", F.col("raw").alias("raw_1"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks_1"))
    b = spelled.select("_g", "form", F.col("raw").alias("raw_2"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks_2"))
    both = a.join(b, ["_g", "form"]).where("raw_1 < raw_2")
    plain = rows.select("_g", "form", "raw", F.struct(*order).alias("o"))

    def side(own: int, other: int) -> DataFrame:
        mine = both.select("_g", "form", F.col(f"raw_{own}").alias("raw"), F.col(f"raw_{other}").alias("_raw"), F.col(f"blocks_{own}").alias("_own"), F.col(f"blocks_{other}").alias("_other"))
        met = join_small(plain, mine, ["_g", "form", "raw"]).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_other") - 1)))
        block = F.pmod(F.xxhash64("o"), F.col("_own")).cast("int")
        return met.select("_g", "form", F.col("raw").alias(f"raw_{own}"), F.col("_raw").alias(f"raw_{other}"), block.alias(f"block_{own}"), F.col("_other").alias(f"block_{other}"), F.col("o").alias(f"o{own}"))

    out = side(1, 2).join(side(2, 1), ["_g", "form", "raw_1", "raw_2", "block_1", "block_2"])
    low, high = F.least("o1", "o2"), F.greatest("o1", "o2")
    return out.select("_g.*", low.alias("_l"), high.alias("_h")).select(*group, *[F.col(f"_l.{o}").alias(f"{o}_a") for o in order], *[F.col(f"_h.{o}").alias(f"{o}_b") for o in order])
