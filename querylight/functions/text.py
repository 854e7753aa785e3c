"""Basic text clean-up and splitting, whole texts at a time."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from querylight.functions.strings import strip_blank

# Character classes of the basic tokenizer.
CONTROL = r"[\p{Cc}\p{Cf}\x{FFFD}&&[^\t\n\r]]"
BLANK = r"[ \t\n\r\p{Zs}]"
CJK = (
    r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
    r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"
)
PUNCTUATION = r"[\x{21}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}\p{P}]"
# A basic token: a run of anything but blanks, ideographs and punctuation, or one of the latter; and the same for ASCII texts.
# The first range holds letters and no punctuation, which is quicker to see than what the other classes leave.
BASIC_TOKEN = rf"(?U)(?:[A-Za-z0-9\x{{C0}}-\x{{24F}}]|[\x{{80}}-\x{{10FFFF}}&&[^\s{CJK[1:-1]}{PUNCTUATION[1:-1]}]])++|[^\s]"
ASCII_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ASCII_TOKEN = r"[A-Za-z0-9]++|[^\s]"


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def _ranges(chars: list[str]) -> str:
    """Characters as the ranges of a character class."""
    points = sorted(map(ord, chars))
    starts = [p for i, p in enumerate(points) if i == 0 or points[i - 1] != p - 1]
    ends = [p for i, p in enumerate(points) if i == len(points) - 1 or points[i + 1] != p + 1]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends))


# Characters that decompose to one character and marks, and those characters. The odd rest makes several characters or
# none (Hangul syllables, two-part vowel signs), or is put in another order by the decomposition and may be no mark to
# an older Unicode table, such as Java's.
_decomposed = {c: _without_marks(c) for c in map(chr, range(0x80, 0x110000)) if unicodedata.decomposition(c)[:1] not in ("", "<")}
_single = {c: bare for c, bare in _decomposed.items() if len(bare) == 1}
MARKED, BARE = "".join(_single), "".join(_single.values())
_moved = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.combining(c) and unicodedata.ucd_3_2_0.category(c) != "Mn"]
_odd = [*map(chr, range(0xAC00, 0xD7A4)), *(c for c in {*_decomposed, *_moved} if c not in _single)]
# Most characters fail the first range, which is quicker than to try all.
ODD = rf"[\x{{{min(map(ord, _odd)):X}}}-\x{{10FFFF}}&&[{_ranges(_odd)}]]"

# Pre-token patterns.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRETOKEN_DIGITS = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)
# Unified ideographs by block, twelve of them among the compatibility ones; two more signs; variation selectors.
IDEOGRAPH = (
    r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FA0E}\x{FA0F}\x{FA11}\x{FA13}\x{FA14}\x{FA1F}\x{FA21}\x{FA23}\x{FA24}"
    r"\x{FA27}-\x{FA29}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B739}\x{2B740}-\x{2B81D}\x{2B820}-\x{2CEA1}\x{2CEB0}-\x{2EBE0}"
    r"\x{2EBF0}-\x{2EE5D}\x{30000}-\x{3134A}\x{31350}-\x{323AF}\x{3006}\x{3007}][\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]?"
)


def clean(text: Column) -> Column:
    """Drop control characters, turn every kind of blank into a space."""
    return F.regexp_replace(F.regexp_replace(text, CONTROL, ""), BLANK, " ")


def isolate_cjk(text: Column) -> Column:
    """Put a space on both sides of every ideograph."""
    return F.regexp_replace(text, f"({CJK})", " $1 ")


@F.pandas_udf(StringType())
def decompose(text: pd.Series) -> pd.Series:
    """Canonical decomposition; Spark has no such function."""
    return text.map(lambda t: unicodedata.normalize("NFD", t), na_action="ignore")


def strip_accents(text: Column | str) -> Column:
    """Decompose and drop the combining marks. Only texts with odd characters pass through Python."""
    plain = F.col(text) if isinstance(text, str) else text
    return F.when(is_ascii(plain), plain).otherwise(_bare(plain, plain))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _bare(plain: Column, source: Column) -> Column:
    """A text without its marks; odd characters have no case, so they are looked for in the text that `plain` came from."""
    decomposed = F.coalesce(decompose(F.when(source.rlike(ODD), plain)), F.translate(plain, MARKED, BARE))
    return F.regexp_replace(decomposed, r"\p{Mn}+", "")


def space_punctuation(text: Column) -> Column:
    """Put a space on both sides of every punctuation character."""
    return F.regexp_replace(text, f"({PUNCTUATION})", " $1 ")


def words(text: Column) -> Column:
    """Split at blanks; an empty text has no words."""
    return F.filter(F.split(strip_blank(text), r"(?U)\s+"), lambda w: w != "")


def basic_text(text: Column) -> Column:
    """The text with its basic tokens separated by blanks."""
    return space_punctuation(strip_accents(F.lower(isolate_cjk(clean(text)))))


def basic_tokens(text: Column) -> Column:
    """The words of `basic_text`, found in one pass: blanks part tokens of their own accord, and so do ideographs."""
    plain = F.lower(F.regexp_replace(text, CONTROL, ""))
    narrow = F.regexp_extract_all(F.lower(F.regexp_replace(text, ASCII_CONTROL, "")), F.lit(ASCII_TOKEN), F.lit(0))
    return F.when(is_ascii(text), narrow).otherwise(F.regexp_extract_all(_bare(plain, text), F.lit(BASIC_TOKEN), F.lit(0)))


def pretokens(text: Column, single_digits: bool = False) -> Column:
    """Contractions, letter runs, digit runs (or single digits), symbol runs and blanks, in order."""
    # The flag makes the blank class cover every Unicode blank.
    return F.regexp_extract_all(text, F.lit("(?U)" + (PRETOKEN_DIGITS if single_digits else PRETOKEN)), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Split at empty lines; every paragraph but the last keeps its two line ends."""
    parts = F.split(text, "\n\n")
    return F.transform(
        parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit("\n\n"))).otherwise(p)
    )


def paragraph_tokens(text: Column) -> Column:
    """Ideographs one by one and the pre-tokens of what stands between them, paragraph by paragraph."""
    # The blank at the end of a stretch sees the paragraph's end, not the next ideograph's text.
    stretches = F.flatten(
        F.transform(paragraphs(text), lambda p: F.split(F.regexp_replace(p, f"({IDEOGRAPH})", "\x00$1\x00"), "\x00"))
    )
    whole = F.filter(stretches, lambda t: t != "")
    return F.flatten(F.transform(whole, lambda t: F.when(t.rlike(f"^{IDEOGRAPH}$"), F.array(t)).otherwise(pretokens(t))))


def mark_ideographs(text: Column, mark: str = "¦") -> Column:
    """Set every ideograph (with its variation selector) apart from its neighbours."""
    return F.regexp_replace(text, f"({IDEOGRAPH})", f"{mark}$1{mark}")
