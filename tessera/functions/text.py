"""Text cleaning and tokenising as native column expressions.

Python's ``\\w`` is Unicode; it is spelled ``[\\p{L}\\p{N}_]`` so that Java's
regex and any RE2-based SQL engine agree.  Whitespace classes are written out
for the same reason.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the standard cleaning rule.
URL_PATTERN = r"http\S+|www\S+|https\S+"
MENTION_PATTERN = r"@[\p{L}\p{N}_]+|#"
WS = r"[ \t\n\r\f\x0B]"
KEEP_STANDARD = r"[^a-z \t\n\r\f\x0B]"
KEEP_GOD_MODE = r"[^a-z \t\n\r\f\x0B!?]"
REPEAT_PATTERN = r"(.)\1+"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(col, mode: str = "standard") -> Column:
    """Lower, drop URLs, @mentions and '#', keep a-z (and '!?' in
    god mode, after collapsing character runs to two), squeeze whitespace.
    Null becomes '' (deliberately, instead of the word 'nan')."""
    t = F.lower(F.coalesce(_c(col).cast("string"), F.lit("")))
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, MENTION_PATTERN, "")
    if mode == "god_mode":
        t = F.regexp_replace(t, REPEAT_PATTERN, "$1$1")
        t = F.regexp_replace(t, KEEP_GOD_MODE, "")
    else:
        t = F.regexp_replace(t, KEEP_STANDARD, "")
    t = F.regexp_replace(t, WS + "+", " ")
    return F.trim(t)


def tokens(col, pattern: str = TOKEN_PATTERN) -> Column:
    """Words of two or more word characters."""
    return F.regexp_extract_all(_c(col), F.lit(f"({pattern})"), 1)


def remove_stop_words(tok: Column, stop_words) -> Column:
    """Drop stop words, keeping order and repeats."""
    if not stop_words:
        return tok
    return F.filter(tok, lambda t: ~t.isin(*stop_words))  # the optimiser looks literals up in a hash set


def for_splitter(col) -> Column:
    """What ``word_splitter`` takes: texts in lower case, those with an @ cleaned and in capitals.
    What ends a mention is left to one engine, as others know letters of other Unicode versions."""
    t = F.lower(F.coalesce(_c(col).cast("string"), F.lit("")))
    return F.when(F.contains(t, F.lit("@")), F.upper(clean_text(col))).otherwise(t)


def word_splitter():
    """Arrow function: texts by ``for_splitter`` to the words that ``tokens`` finds in
    ``clean_text`` of them (standard mode).  White space need not be squeezed for that, and
    in capitals no address is found a second time."""
    white = WS[1:-1]
    url, others = URL_PATTERN.replace(r"\S", f"[^{white}]"), f"[^A-Za-z{white}]+"

    def split(text):
        text = pc.replace_substring_regex(text, pattern=url, replacement="")
        text = pc.ascii_lower(pc.replace_substring_regex(text, pattern=others, replacement=""))
        words = pc.ascii_split_whitespace(text)
        long = pc.greater_equal(pc.binary_length(words.values), 2)
        ends = np.concatenate([[0], np.cumsum(long.to_numpy(zero_copy_only=False))])[words.offsets.to_numpy()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.values.filter(long))

    return split  # a closure travels to the tasks by value


def default_stop_words(language: str = "english") -> list[str]:
    """Spark's built-in list for a language (I05); unknown languages -> none."""
    from pyspark.ml.feature import StopWordsRemover
    try:
        return list(StopWordsRemover.loadDefaultStopWords(language.lower()))
    except Exception:
        return []


def ngrams(tok: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """All n-grams for n in [n_min, n_max], words joined by one space.

    The n-grams of length n are the (n-1)-grams zipped with the token array
    shifted by n-1: one linear pass per n.  ``tok`` should be a column
    reference (materialise the token array first)."""
    size = F.size(tok)
    grams = {1: tok}
    for n in range(2, n_max + 1):
        m = F.greatest(size - F.lit(n - 1), F.lit(0))
        grams[n] = F.zip_with(F.slice(grams[n - 1], 1, m), F.slice(tok, n, m),
                              lambda a, b: F.concat(a, F.lit(" "), b))
    parts = [grams[n] for n in range(n_min, n_max + 1)]
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def _accent_table() -> tuple[str, str]:
    """Accent folding table built by rule: every letter in U+00C0..U+024F
    whose canonical decomposition starts with an ASCII letter."""
    src, dst = [], []
    for cp in range(0xC0, 0x250):
        ch = chr(cp)
        d = unicodedata.normalize("NFKD", ch)
        if d and d[0].isascii() and d[0].isalpha() and d != ch and len(d.encode("ascii", "ignore")) == 1:
            src.append(ch)
            dst.append(d[0])
    return "".join(src), "".join(dst)


_ACCENT_SRC, _ACCENT_DST = _accent_table()


def strip_accents(col) -> Column:
    """Fold accented Latin letters to their base letter."""
    return F.translate(_c(col), _ACCENT_SRC, _ACCENT_DST)
