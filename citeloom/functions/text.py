"""Column functions over text: whitespace, lines, quality, tokens, matching.

Character classes are spelled out because the engines disagree on what
``\\s`` and ``trim`` cover.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Unicode white space, as characters and as a regex class body.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_WS_CLASS = r"\t\x1f\x20\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"
# Control characters that count against a text (tab, LF and CR do not).
CONTROL_CLASS = r"\x00-\x08\x0b\x0c\x0e-\x1f"
# Character pairs that show UTF-8 read as a single-byte code page.
MOJIBAKE = r"Ã[^\n]|Â[^\n]|ã[^\n]|â[^\n]|ð[^\n]|\ufffd"
MOJIBAKE_LEADS = "[ÃÂãâð\ufffd]"
# Ordinary text: white space, ASCII, CJK punctuation, kana, kanji, full-width forms.
ALLOWED_CLASS = WS_CLASS + r"\x20-\x7e\u3000-\u303f\u3040-\u309f\u30a0-\u30ff\u4e00-\u9fff\uff01-\uff5e"
# IPA, Greek, Hebrew/Arabic, Indic: scripts that bad extraction produces.
SUSPICIOUS_CLASS = r"\u0250-\u02af\u0370-\u03ff\u0590-\u06ff\u0900-\u0d7f"
# Characters kept when names and queries are matched.
MATCH_CLASS = "0-9a-zぁ-んァ-ヶ一-龠"
FILLER_PHRASES = ["について", "教えて", "ください", "流れ", "手順", "方法", "確認", "とは", "ですか"]
PARTICLES = "のをはがにへと"
STOP_WORDS = ["について", "ください", "教えて", "流れ", "手順", "方法", "確認", "こと"]
# Full-text tokens: runs of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"
# ----------------------------------------------------------------------------


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WS_CHARS))


def lines(text: Column) -> Column:
    """All lines of a text, unstripped."""
    return F.split(text, LINE_BREAK)


def collapse_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS_CLASS}]+", " ")


def snippet(text: Column, size: int = 300) -> Column:
    return F.substring(collapse_ws(text), 1, size)


def count_class(text: Column, char_class: str) -> Column:
    """Characters of ``text`` in a class: one replace, no array of matches."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def _rare(text: Column) -> Column:
    """What is left of a text without its printable ASCII: usually little, so later passes are short."""
    return F.regexp_replace(text, r"[\t\n\r\x20-\x7e]+", "")


def mojibake_hits(text: Column) -> Column:
    return F.when(text.rlike(MOJIBAKE_LEADS), F.regexp_count(text, F.lit(MOJIBAKE))).otherwise(F.lit(0))


def decode_quality(text: Column) -> Column:
    """Penalty of a decoded text; lower is better."""
    odd = bind(_rare(text), lambda r: count_class(r, CONTROL_CLASS) * 20 + count_class(r, r"\x00") * 30)
    return odd + mojibake_hits(text) * 8


def looks_like_mojibake(text: Column) -> Column:
    size = F.greatest(F.length(text), F.lit(1))
    return bind(mojibake_hits(text), lambda hits: (hits >= 8) | ((hits >= 3) & (hits / size >= 0.03)))


def _odd_characters(rare: Column, size: Column) -> Column:
    allowed = (size - F.length(rare) + count_class(rare, ALLOWED_CLASS)) / size
    rates = F.struct(allowed.alias("allowed"), count_class(rare, SUSPICIOUS_CLASS).alias("suspicious"))
    return bind(
        rates,
        lambda r: (r["allowed"] < 0.45)
        | ((r["suspicious"] >= 4) & (r["suspicious"] / size >= 0.05))
        | ((r["allowed"] < 0.85) & (count_class(rare, CONTROL_CLASS) > 0)),
    )


def is_garbled(text: Column) -> Column:
    """Text that decoding or extraction has damaged; never true for an empty text."""

    def judge(t: Column) -> Column:
        size = F.greatest(F.length(t), F.lit(1))
        odd = bind(_rare(t), lambda r: F.when(r == "", False).otherwise(_odd_characters(r, size)))
        return F.when(F.coalesce(t, F.lit("")) == "", False).when(looks_like_mojibake(t), True).otherwise(odd)

    return bind(text, judge)


def tokens(text: Column) -> Column:
    """Lower-cased letter/digit runs in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def normalize_match(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{MATCH_CLASS}]+", "")


def query_fragments(query: Column) -> Column:
    """Fragments a file name may contain: the trimmed query, then the whole one."""

    def pair(whole: Column) -> Column:
        core = whole
        for phrase in FILLER_PHRASES:
            core = F.replace(core, F.lit(phrase), F.lit(""))
        return F.array(F.trim(core, F.lit(PARTICLES)), whole)

    both = bind(normalize_match(query), pair)
    return F.array_distinct(F.filter(both, lambda f: F.length(f) >= 2))


def significant_tokens(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"[{MATCH_CLASS}]{{2,}}"), F.lit(0))
    return F.array_except(runs, F.array(*[F.lit(w) for w in STOP_WORDS]))


def soft_fragments(text: Column) -> Column:
    """Distinct words of two characters or more, sentence marks read as spaces."""
    words = F.split(F.translate(text, "。、？?！!", "      "), f"[{WS_CLASS}]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def grams(text: Column, size: int) -> Column:
    """Distinct substrings of exactly ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(
        F.length(text) >= size,
        F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))),
    ).otherwise(F.array().cast("array<string>"))


def merge_tags(*tags: Column) -> Column:
    """Sorted distinct union of tag arrays."""
    none = F.array().cast("array<string>")
    return F.sort_array(F.array_distinct(F.concat(*[F.coalesce(t, none) for t in tags])))


def tag_list(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def decode_tags(replaced: Column, mojibake: Column) -> Column:
    return tag_list((replaced, "DECODE_REPLACED"), (mojibake, "POSSIBLE_MOJIBAKE"))
