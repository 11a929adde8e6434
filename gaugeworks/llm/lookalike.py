"""Visually identical text with different characters (problem 8)."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, ship

# Letters drawn as a Latin letter, in pairs of look-alike and Latin letter, of the scripts whose running text is
# common: the public table of confusable characters, made for identifiers, has more of them, which a reader tells apart.
LOOKALIKES = {
    "Cyrillic": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT ХX ҮY ӀI ԚQ ԜW ԌG аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ѵv ӏl",
    "Greek": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϳj ϹC ϲc ͿJ",
    "Armenian": "ՍU ՏS ՕO օo սu ոn հh",
    "Latin": "ɡg ɑa",
}
#: Scripts of which only LOOKALIKES count, as their letters' names begin.
LISTED = ("GREEK", "CYRILLIC", "ARMENIAN", "LATIN", "HEBREW", "ARABIC")
# Dashes drawn as the hyphen-minus.
HYPHENS = "‐‑"
# Code points of the Unicode property Default_Ignorable_Code_Point, as ranges.
IGNORABLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]
#: Kinds of compatibility decomposition that a reader does not see. Raised, lowered and circled characters and fractions
#: are seen, so theirs are left alone.
UNSEEN = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>")


@lru_cache(maxsize=1)
def _confusable(spark: SparkSession) -> dict[str, str]:
    """Letters of all other scripts that look like a Latin one, from the public table of confusable characters (Unicode
    Technical Standard 39), which ICU carries and Spark ships: a letter goes to the ASCII letter of the same case with the
    same skeleton, a letter without case to the ASCII letter that is its skeleton."""
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeleton = lambda letters: dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n")))
    latin: dict[str, list[str]] = {}
    for ch, form in skeleton([chr(c) for c in (*range(65, 91), *range(97, 123))]).items():
        latin.setdefault(form, []).append(ch)
    ideographs = lambda c: 0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xDFFF or c >= 0x20000
    others = [chr(c) for c in range(0x370, 0x20000) if not ideographs(c) and unicodedata.category(chr(c)).startswith("L")]
    others = [ch for ch in others if not unicodedata.name(ch, "LATIN").startswith(LISTED) and not unicodedata.decomposition(ch)]
    out = {}
    for ch, form in skeleton(others).items():
        case = unicodedata.category(ch)
        same = [a for a in latin.get(form, []) if unicodedata.category(a) == case or (case == "Lo" and a == form)]
        if same:
            out[ch] = same[0]
    return out


def character_table(confusable: dict[str, str]) -> dict[str, str]:
    """What each character that is not its own visible form becomes, made from the Unicode data by rule."""
    letters = confusable | {pair[0]: pair[1] for pairs in LOOKALIKES.values() for pair in pairs.split()}

    def plain(ch: str) -> str:
        parts = unicodedata.decomposition(ch).split()
        if parts and parts[0] in UNSEEN:
            whole = "".join(chr(int(x, 16)) for x in parts[1:])
            accent = len(whole) > 1 and whole[0] == " "  # a spacing accent
            if not accent and ch not in "ſ№" and len(whole) <= 4:
                return "".join(plain(x) for x in whole)
        elif parts and parts[0][0] != "<":
            return "".join(plain(chr(int(x, 16))) for x in parts)
        if unicodedata.category(ch) == "Zs" or ch == "\t":
            return " "
        if ch in "\x0b\x0c\x85\u2028\u2029":
            return "\n"
        if ch in HYPHENS:
            return "-"
        return letters.get(ch, ch)

    table = {}
    for code in range(0x110000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF or 0x20000 <= code <= 0xDFFFF or code >= 0xE1000:
            continue  # Hangul, surrogates, private use, ideographs: nothing to map
        ch = chr(code)
        if ch in letters or unicodedata.decomposition(ch) or not ch.isalnum():
            if (to := unicodedata.normalize("NFC", plain(ch))) != ch:
                table[ch] = to
    return table | dict.fromkeys((chr(c) for a, b in IGNORABLE for c in range(a, b + 1)), "")


class VisibleForm:
    """Text to its visible form: composed compatibility normalisation without the decompositions that a reader sees, one
    kind of white space and line end, look-alike letters as Latin ones, no default-ignorable characters.

    One compiled pattern finds whether a text holds any character to be mapped; only then is it taken apart. fold_case
    folds letter case as well, for comparisons in which case is no difference.
    """

    def __init__(self, table: dict[str, str], fold_case: bool = False):
        self.table, self.fold_case = table, fold_case
        # the pattern engine keeps a set of the basic plane as a bitmap, but not a larger one
        self.mapped = re.compile("[" + "".join(re.escape(c) for c in sorted(table) if c < "\U00010000") + "]|[\U00010000-\U0010ffff]")

    def __call__(self, text: str) -> str:
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        if self.mapped.search(text):
            text = self.mapped.sub(lambda m: self.table.get(m[0], m[0]), text)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return unicodedata.normalize("NFC", text.casefold()) if self.fold_case else text


@lru_cache(maxsize=4)
def _form_of(spark: SparkSession, fold_case: bool) -> VisibleForm:
    return VisibleForm(character_table(_confusable(spark)), fold_case)


def visible_form(spark: SparkSession, text: str, fold_case: bool = False) -> str:
    """One form for all texts that look the same (VisibleForm)."""
    return _form_of(spark, fold_case)(text)


def _forms(form_of: VisibleForm, digest: bool):
    short = lambda s: blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches):
        for b in batches:
            coded = b.column(1).combine_chunks().dictionary_encode() if isinstance(b.column(1), pa.ChunkedArray) else b.column(1).dictionary_encode()
            values = coded.dictionary.to_pylist()  # the distinct texts of the batch
            made = [form_of(v) for v in values]
            if digest:
                raw = [short(v) for v in values]
                cols = [pa.array(raw, pa.binary()), pa.array([r if f == v else short(f) for v, f, r in zip(values, made, raw)], pa.binary())]
            else:
                cols = [pa.array(made, pa.string()), pa.array([v != f for v, f in zip(values, made)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(c.take(coded.indices) for c in cols)], names=["item", "a", "b"])

    return run


def forms(texts: DataFrame, fold_case: bool = False) -> DataFrame:
    """(item bigint, text) to (item, form, changed), every distinct text of a batch normalised once. A null text has a null form and null changed."""
    return texts.select(F.col("item").cast("long").alias("item"), "text").mapInArrow(_forms(_form_of(texts.sparkSession, fold_case), False), "item bigint, form string, changed boolean").select("item", "form", "changed")


def digests(texts: DataFrame, fold_case: bool = False) -> DataFrame:
    """(item bigint, text) to (item, raw, form): 128-bit digests of the text as it is and of its form. Null texts are left out."""
    rows = texts.filter("text is not null").select(F.col("item").cast("long").alias("item"), "text")
    return rows.mapInArrow(_forms(_form_of(texts.sparkSession, fold_case), True), "item bigint, raw binary, form binary")


def look_alike_classes(texts: DataFrame, fold_case: bool = False) -> DataFrame:
    """One row for each item with a text: (item, class_id, items, spellings). class_id is the smallest item of those that look the same."""
    d = save(digests(texts, fold_case).distinct(), "forms")
    spelt = d.groupBy("form", "raw").agg(F.min("item").alias("first"), F.count(F.lit(1)).alias("n"))
    per = spelt.groupBy("form").agg(F.min("first").alias("class_id"), F.sum("n").alias("items"), F.count(F.lit(1)).alias("spellings"))
    return d.join(per, "form").select("item", "class_id", "items", "spellings")


def look_alike_pairs(texts: DataFrame, fold_case: bool = False) -> DataFrame:
    """All pairs (a, b), a < b, of items whose texts are different strings of one visible form.

    Items are first reduced to spellings (distinct texts) and only forms of two or more spellings go on, so that a text
    with a million exact copies and no other spelling costs one row. Pairs of spellings are then expanded to their
    items. Null texts take no part; empty texts are one spelling. Repeated rows count once.
    """
    d = save(digests(texts, fold_case).distinct(), "forms")
    spelt = d.select("form", "raw").distinct()
    several = spelt.groupBy("form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("form")
    spelt = spelt.join(several, "form")
    two = spelt.select("form", F.col("raw").alias("raw_a")).join(spelt.select("form", F.col("raw").alias("raw_b")), "form").filter("raw_a < raw_b").select("raw_a", "raw_b")
    left = d.select(F.col("item").alias("x"), F.col("raw").alias("raw_a")).join(two, "raw_a").select("x", "raw_b")
    both = left.join(d.select(F.col("item").alias("y"), F.col("raw").alias("raw_b")), "raw_b")
    return both.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


ship(sys.modules[__name__])
