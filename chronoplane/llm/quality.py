"""Per-document text statistics, and which documents are not natural prose.

Counts and ratios (words, symbols, digits, punctuated lines, frequent words) are built-in expressions. What is prose is
judged from the layout of the lines first and from ratios of what the layout leaves open:

* vertical delimiter alignment: neighbouring lines with the same number of delimiters are rows of a table;
* indentation periodicity: marked lines whose indents and markers repeat are a list, if they end like items, not sentences;
* line-length autocorrelation: a block of lines whose lengths repeat at a short lag, without sentence ends, is a
  fixed-width table or a dump;
* the other lines join into paragraphs, which are prose unless their symbols, letters, frequent words, sentence marks or
  repetitions are those of no sentence.

A document is not prose if most of its visible characters lie in parts that are not.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 0.5
#: A block of so many lines shows its layout; what is shorter is judged by ratios alone.
BLOCK = 4

# --- fixed values -----------------------------------------------------------------------------------------------------
#: Frequent words beside those of the given table (Italian, Portuguese, Dutch).
MORE_COMMON = frozenset("il che di è non per una del della dei le gli con come più ma se nel alla dal questo sono ha ogni della o os da em um uma não com het een van ik dat niet op te".split())
BULLET = re.compile(r"\s*(?:[-*•·–—+‣◦▪]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\]|\(\w{1,3}\))\s+(?=\S)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: Separators that are no line ends, and tokenizers' special tokens.
NOISE = re.compile(r"<\|[a-z_]+\|>|\[UNK\]|</?s>|[­​-‏  ⁠﻿]")
INNER_END = re.compile(r"[.!?…]['\"”’»)\]]*(?=\s|$)")
LINE_END = re.compile(r"[.!?…:]['\"”’»)\]]*\Z")
HEADING = re.compile(r"\s*#+\s")
QUOTED = re.compile(r"\s*(?:>\s*)+")
NON_ASCII = re.compile(r"[^\x00-\x7f]+")
BLANKS = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
DIGITS = b"0123456789"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
PUNCTUATION = b".,;:!?'\"()-"
WIDE_PUNCTUATION = frozenset("“”‘’…«»–—¿¡„‚‹›。、，！？：；（）")
NO_VOWELS = str.maketrans("", "", "aeiouyAEIOUY")
CLUSTER = re.compile(r"[^aeiouy]{6}")
MIXED_CASE = re.compile(r"[a-z][A-Z].*[a-z][A-Z]|[A-Z]{2,}[a-z]+[A-Z]")
# ----------------------------------------------------------------------------------------------------------------------


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def characters(text: str) -> tuple[int, int, int, int]:
    """Visible characters, letters (beyond ASCII also digits), plain punctuation and other symbols of a text."""
    seen = letters = plain = marks = 0
    if not text.isascii():
        wide = "".join("".join(NON_ASCII.findall(text)).split())
        text = NON_ASCII.sub("", text)
        seen, letters = len(wide), sum(map(str.isalnum, wide))
        plain = sum(map(WIDE_PUNCTUATION.__contains__, wide))
        marks = seen - letters - plain
    b = text.encode()
    shown = len(b.translate(None, BLANKS))
    no_letters = len(b.translate(None, BLANKS + LETTERS))
    symbols = len(b.translate(None, BLANKS + LETTERS + DIGITS))
    odd = len(b.translate(None, BLANKS + LETTERS + DIGITS + PUNCTUATION))
    return seen + shown, letters + shown - no_letters, plain + symbols - odd, marks + odd


def _delimiters(line: str) -> tuple[int, int, int, int, int]:
    """Tabs between cells, bars, semicolons and commas without a blank after them, equals signs."""
    s = line.strip()
    return s.count("\t"), s.count("|"), s.count(";") - s.count("; ") - s.endswith(";"), s.count(",") if "," in s[:-1] and ", " not in s else 0, s.count("=")


def alignment(lines: list[str]) -> list[bool]:
    """Vertical delimiter alignment: which lines have as many delimiters of a kind as a neighbour."""
    out = [False] * len(lines)
    before = None
    for i, line in enumerate(lines):
        here = _delimiters(line) if line.strip() else None
        if here and before and any(a == b >= least for a, b, least in zip(before, here, (1, 1, 2, 1, 2))):
            out[i - 1] = out[i] = True
        before = here
    return out


def periodicity(lines: list[str]) -> float:
    """Share of lines whose indent and marker are those of the line one to four before, at the best such lag."""
    kinds = [(len(x) - len(x.lstrip()), BULLET.match(x) is not None) for x in lines if x.strip()]
    if len(kinds) < 3 or not any(indent or marked for indent, marked in kinds):
        return 0.0
    return max(sum(map(tuple.__eq__, kinds[lag:], kinds)) / (len(kinds) - lag) for lag in range(1, min(5, len(kinds))))


def length_autocorrelation(lines: list[str], slack: int = 2) -> float:
    """How far line lengths repeat at the best lag of one to four, in lines that are not blank.

    The greater of the autocorrelation and the share of lengths that are within ``slack`` of the one before at that lag:
    where all lengths are nearly equal, there is no variance left to correlate.
    """
    n = [len(x.rstrip()) for x in lines if x.strip()]
    if len(n) < BLOCK:
        return 0.0
    mean = sum(n) / len(n)
    d = [x - mean for x in n]
    spread = sum(x * x for x in d)
    best = 0.0
    for lag in range(1, min(5, len(n))):
        near = sum(abs(x - y) <= slack for x, y in zip(n[lag:], n)) / (len(n) - lag)
        best = max(best, near, sum(x * y for x, y in zip(d[lag:], d)) / spread if spread else 1.0)
    return best


def _fixed_width(block: list[str]) -> bool:
    """Whether the lines of a block have lengths that repeat and hardly a sentence end."""
    return len(block) >= BLOCK and sum(len(INNER_END.findall(x)) for x in block) < len(block) / 4 and length_autocorrelation(block) >= 0.7


def _repeats(words: list[str]) -> float:
    """Share of windows of 60 words in which few triples of words differ."""
    if len(words) < 8:
        return 1.0 if len(words) >= 4 and len(set(words)) == 1 else 0.0
    bad = whole = 0
    for i in range(0, len(words), 60):
        w = words[i : i + 60] if len(words) - i >= 20 or i == 0 else words[-20:]
        whole += 1
        bad += len(set(zip(w, w[1:], w[2:]))) <= 0.4 * (len(w) - 2)
    return bad / whole


def _side_by_side(words: list[str], common: frozenset) -> float:
    """Share of neighbouring words that are both frequent: sentences put other words between them."""
    frequent = [w in common for w in words]
    return sum(map(bool.__and__, frequent, frequent[1:])) / max(1, len(words) - 1)


def _odd_words(words: list[str]) -> float:
    """Share of Latin words that can't be pronounced: hardly a vowel, a long run of consonants, or letter case mixed."""
    long = [w for w in words if len(w) >= 4 and w.isascii()]
    return sum(map(_odd_word, long)) / len(long) if long else 0.0


@lru_cache(maxsize=200_000)
def _odd_word(w: str) -> bool:
    return len(w) - len(w.translate(NO_VOWELS)) <= len(w) / 6 or CLUSTER.search(w.lower()) is not None or MIXED_CASE.search(w) is not None


def natural(lines: list[str], common: frozenset) -> tuple[bool, int]:
    """Whether a paragraph is running sentences, and its visible characters."""
    text = " ".join(" ".join(lines).split())
    seen, letters, _, marks = characters(text)
    if not seen:
        return True, 0
    if marks > 0.10 * seen or (letters < 0.5 * seen and len(lines) < BLOCK):
        return False, seen
    words = WORD.findall(text)
    if not words:
        return False, seen
    low = [w.lower() for w in words]
    share = sum(map(common.__contains__, low)) / len(low)
    ends = len(INNER_END.findall(text))
    if _repeats(low) > 0.5 or (len(words) >= 4 and _odd_words(words) > 0.35):
        return False, seen
    if len(words) >= 6 and ends < len(words) / 25 and not any(x in text for x in (", ", "; ", ": ")):
        # words without order: too many frequent ones, too near one another, or more words without any mark than a sentence has
        if not ends and (len(words) >= 32 or share + _side_by_side(low, common) >= 0.82):
            return False, seen
        if text.count("_") > 0.15 * len(words):
            return False, seen
    # bare names in a column: short lines that are no sentences
    if len(lines) >= 3 and len(words) <= 4.5 * len(lines) and sum(LINE_END.search(x.rstrip()) is not None for x in lines) < len(lines) / 3:
        return False, seen
    return not (len(words) >= 6 and share < 0.08 and not ends), seen


def assess(text: str | None, common: frozenset) -> dict | None:
    """``aligned_lines``, ``indent_period``, ``length_autocorrelation`` (of the whole text) and the visible characters of its prose and of its other parts; None for null and blank texts."""
    if text is None or not text.strip():
        return None
    lines = lines_of(NOISE.sub("", text) if "<" in text or "[" in text or not text.isascii() else text)
    aligned = alignment(lines)
    period = periodicity(lines)
    bullets = [BULLET.match(x) for x in lines]
    listed = period >= 0.5 and len(lines) - bullets.count(None) >= 2
    several = sum(bool(x.strip()) for x in lines) > 1
    other = list(aligned)
    start = 0
    for end in range(len(lines) + 1):
        if end == len(lines) or not lines[end].strip():
            if _fixed_width(lines[start:end]):
                other[start:end] = [True] * (end - start)
            start = end + 1
    prose = rest = 0
    paragraph: list[str] = []

    def close() -> None:
        nonlocal prose, rest
        if paragraph:
            first = paragraph[0].strip()
            heading = len(paragraph) == 1 and several and first.count(" ") < 6 and first[0].isupper() and not LINE_END.search(first)
            ok, seen = natural(paragraph, common)
            if not heading:
                prose, rest = prose + seen * ok, rest + seen * (not ok)
            paragraph.clear()

    for line, odd, bullet in zip(lines, other, bullets):
        s = line.strip()
        if not s or HEADING.match(line):
            close()
            continue
        seen, letters, plain, marks = characters(s)
        if not odd:
            odd = marks > 0.10 * seen or plain + marks > 0.22 * seen
            # the rest of a wrapped sentence may be a date or a number
            odd = odd and not (paragraph and len(s) < 30 and LINE_END.search(s))
        if not odd and listed and bullet:
            body = line[bullet.end() :].rstrip()
            odd = body.count(" ") < 2 or not LINE_END.search(body)
        if odd:
            close()
            rest += seen
        else:
            paragraph.append(QUOTED.sub("", line, count=1) if s[0] == ">" else line)
    close()
    if not prose + rest:  # headings only
        rest = characters(text)[0]
    return {
        "aligned_lines": sum(aligned) / max(1, len(lines)), "indent_period": period, "length_autocorrelation": length_autocorrelation(lines),
        "prose_chars": prose, "other_chars": rest,
    }


LAYOUT = "aligned_lines double, indent_period double, length_autocorrelation double, prose_chars long, other_chars long"


BLANK, FILLED = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"


def statistics(text: Column, common_words: frozenset) -> dict[str, Column]:
    """Built-in expressions for the counts and ratios of a text; null where it is null or has nothing but ASCII blanks.

    A word is a run of letters with inner apostrophes. Symbols are visible characters that are no letters or numbers.
    Lines end at line feeds, carriage returns or both; of those that aren't blank, a line counts as punctuated if only
    closing quotes and brackets follow its last sentence mark. The frequent words are those of the given table.
    """
    filled = F.when(F.regexp_like(text, F.lit(FILLED)), text)
    words = F.regexp_extract_all(filled, F.lit(r"\p{L}+(?:['’]\p{L}+)*"), 0)
    low = F.transform(words, F.lower)
    n, seen = F.size(words), F.length(F.regexp_replace(filled, BLANK, ""))
    lines = F.filter(F.split(F.regexp_replace(filled, "\r\n?", "\n"), "\n"), lambda x: F.regexp_like(x, F.lit(FILLED)))
    ended = F.filter(lines, lambda x: F.regexp_like(x, F.lit(rf"[.!?…]['\"”’»)\]]*{BLANK}*$")))
    frequent = sorted(common_words)
    share = lambda part, whole: F.when(filled.isNotNull(), F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)))
    return {
        "words": F.when(filled.isNotNull(), n.cast("long")),
        "mean_word_length": share(F.length(F.array_join(words, "")), n),
        "symbol_ratio": share(seen - F.length(F.regexp_replace(filled, r"[^\p{L}\p{N}]", "")), seen),
        "digit_ratio": share(F.length(F.regexp_replace(filled, "[^0-9]", "")), seen),
        "punctuated_lines": share(F.size(ended), F.size(lines)),
        "common_words": share(F.size(F.filter(low, lambda w: w.isin(frequent))), n),
        "distinct_words": share(F.size(F.array_distinct(low)), n),
    }


def layout(text: Column, common_words: frozenset) -> Column:
    """Struct of ``LAYOUT`` per text, null for null and blank texts, judged in Arrow batches."""
    common = frozenset(common_words) | MORE_COMMON
    names = [x.split()[0] for x in LAYOUT.split(", ")]

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [assess(t if isinstance(t, str) else None, common) or dict.fromkeys(names) for t in texts]
        return pd.DataFrame(rows, columns=names, dtype=object)

    # not moved below a repartitioning that spreads the work
    return F.pandas_udf(run, LAYOUT).asNondeterministic()(text)


def text_quality(documents: DataFrame, key: str, text: str, common_words: frozenset) -> DataFrame:
    """Key, the statistics, ``LAYOUT`` and ``is_prose``, one row per input row; what a query doesn't read isn't computed.

    Null, empty and blank texts have null statistics and null ``is_prose``: there is nothing to judge. Each text is judged
    whole and by itself, so the work is spread as the rows are and nothing is shuffled. Other columns are ignored.
    """
    stats = statistics(F.col("text"), common_words)
    rows = documents.selectExpr(f"`{key}` as key", f"`{text}` as text").withColumn("layout", layout(F.col("text"), common_words))
    names = [x.split()[0] for x in LAYOUT.split(", ")]
    prose, other = F.col("layout.prose_chars"), F.col("layout.other_chars")
    return rows.select(F.col("key").alias(key), *[c.alias(n) for n, c in stats.items()], *[F.col(f"layout.{n}") for n in names], (prose >= MOST * (prose + other)).alias("is_prose"))
