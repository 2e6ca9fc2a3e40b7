"""Text rules as Spark column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

# The characters that ECMAScript counts as white space.
BLANKS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
BLANK = f"[{BLANKS}]"
BLANK_CHARS = "".join(chr(c) for c in range(1 << 16) if re.match(BLANK, chr(c)))
# Blocks of Chinese characters that are segmented.
CJK = "[\\u4E00-\\u9FFF\\u3400-\\u4DBF]"
# ASCII letters, which alone fold in LIKE, and the pattern of an entry line.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Most characters are printable ASCII, which one comparison tells from white space; the set's own test is a dozen.
AT_BLANK = "(?![!-~])"
# What may follow the fact of an entry line, from the first blank on.
SOURCE, DATE = "_\\(source:[^\\n\\r]*?\\)_", f"—{BLANK}+[0-9]{{4}}[^\\n\\r]*"
TAIL = f"{AT_BLANK}(?<!{BLANK}){BLANK}++(?:\\[ref:[^\\n\\r]*?\\](?:{BLANK}+{SOURCE})?(?:{BLANK}+{DATE})?|{SOURCE}(?:{BLANK}+{DATE})?|{DATE})\\z"
BREAK = "[\\n\\r\\u2028\\u2029]"
# Runs of white space that aren't one space already.
RUN = f"{AT_BLANK}(?: {BLANK}+|[{BLANKS.replace(' ', '')}]{BLANK}*)"


def _marked_letters() -> tuple[str, str]:
    """Letters that are one base letter and one combining mark, and their bases."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and unicodedata.category(parts[1]) == "Mn":
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BASES = _marked_letters()


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.length(F.regexp_replace(text, "[\\x{0}-\\x{FFFF}]", ""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def like_contains(text: Column, query: Column) -> Column:
    """SQL's LIKE %query%: only A-Z fold, wildcards and backslashes of the query are literal."""
    return F.contains(ascii_lower(text), ascii_lower(query))


def normalized(text: Column) -> Column:
    return trim(F.regexp_replace(F.lower(text), RUN, " "))


def content_words(text: Column) -> Column:
    """Distinct words of two characters or more for comparing facts."""
    kept = F.regexp_replace(F.lower(text), f"[^a-z0-9\\u4E00-\\u9FFF{BLANKS}-]", " ")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(kept, f"{BLANK}+", " "), " "), lambda w: F.length(w) > 1))


def overlap(a: Column, b: Column) -> Column:
    """Shared words by the smaller set's size; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def entry_fact(line: Column) -> Column:
    """The fact of an entry line `- fact [ref:..] _(source: ..)_ — date`; null for other lines.

    The fact is one character at least and ends before the first blanks whose rest of the line is all metadata, so that
    rest is looked for once; an array of one makes Spark work it out once, too.
    """
    fact = F.concat(F.substring(line, 3, 1), F.regexp_replace(F.substring(line, 4, 1 << 30), TAIL, ""))
    return F.when(line.startswith("- ") & (F.length(line) > 2), F.get(F.filter(F.array(fact), lambda x: ~x.rlike(BREAK)), F.lit(0)))


def entry_ref(line: Column) -> Column:
    found = F.regexp_extract(line, "\\[ref:([^\\]\\n]*)\\]", 1)
    return F.when(found != "", found)


def slug(category: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(category, F.lit("general"))), "[^a-z0-9_-]", "-")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)\\z", 1))


def segmented(text: Column) -> Column:
    """Runs of Chinese characters as overlapping pairs between blanks (an approximation of dictionary segmentation)."""
    pairs = F.regexp_replace(F.regexp_replace(text, f"({CJK}+)", " $1 "), f"({CJK})(?=({CJK}))", "$1$2\u0001 ")
    return F.when(text.rlike(CJK), F.regexp_replace(F.regexp_replace(pairs, f"\u0001 {CJK}(?!{CJK})", ""), "\u0001", "")).otherwise(text)


def folded(text: Column) -> Column:
    return F.lower(F.translate(F.regexp_replace(text, "\\p{Mn}", ""), MARKED, BASES))


def tokens(text: Column) -> Column:
    """The index's tokens in order: runs of letters and digits, without case or single diacritics."""
    every = F.regexp_extract_all(folded(segmented(text)), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), 0)
    # most texts have nothing to fold or segment
    return F.when(text.rlike("[^\\x00-\\x7F]"), every).otherwise(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0))


def query_tokens(query: Column) -> Column:
    """A query's tokens, each an array of index terms that must follow one another."""
    plain = F.regexp_extract_all(query, F.lit("[A-Za-z0-9_]+"), 0)
    chinese = F.filter(F.split(segmented(query), f"{BLANK}+"), lambda t: t != "")
    words = F.when(query.rlike(CJK), chinese).otherwise(plain)
    parts = F.transform(words, lambda w: F.regexp_extract_all(folded(w), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), 0))
    return F.filter(parts, lambda p: F.size(p) > 0)


def compact_snippet(text: Column, source: Column) -> Column:
    """Facts without their metadata (memory only), at most one empty line in a row, trimmed."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.coalesce(entry_fact(x), x))
    kept = F.when(source == "memory", F.array_join(lines, "\n")).otherwise(text)
    return trim(F.regexp_replace(kept, "\n{3,}", "\n\n"))


def line_range(text: Column, first: int | None, count: int | None) -> Column:
    """Lines first .. first + count - 1 (from 1); the whole text where neither is given."""
    if not first and not count:
        return text
    start = max(1, int(first or 1))
    lines = F.split(text, "\n", -1)
    n = F.lit(max(1, int(count))) if count else F.greatest(F.size(lines), F.lit(1))
    return F.array_join(F.slice(lines, start, n), "\n")
