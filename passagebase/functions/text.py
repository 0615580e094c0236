"""Text rules as column expressions: units, headings, tokens, sentences, normalisation, refusals, broad questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
PAGE_NUMBER = r"^\s*\d{1,4}\s*$"
HEADING = r"^((\d+(\.\d+)*\.?|[A-Z]\.\d+(\.\d+)*\.?)\s+[A-Z][^.!?]{1,80}|CHAPTER\s+\d+.{0,60}|APPENDIX\s+[A-Z].{0,60})$"
SENTENCE_GAP = "(?<=[.!?])\\s+(?=[A-Z0-9\"“(])"
SENTENCE_CLOSE = "[.!?:;\"”)]\\s*$"
TOKEN = "[a-z0-9]+"
STRICT_REFUSAL = r"(?i)(don't|do not|does not) have enough information|not enough information|(cannot|can't|unable to) answer"
SOFT_REFUSAL = (
    r"(?i)(does|do|did) not (mention|specify|provide|state|report|include|contain|say|discuss|give)"
    r"|(doesn't|don't|didn't) (mention|specify|provide|state|report|include|contain|say|discuss|give)"
    r"|not (mentioned|specified|stated|provided|reported|included|given|available|discussed)"
    r"|no (information|mention|details)"
)
ABSTAIN_PHRASES = ("i don't have enough information", "i do not have enough information", "not enough information", "cannot answer", "the provided documents do not")
BROAD = (
    r"\b(summarize|summarise|summary|overview|synopsis)\b",
    r"\bwhat\s+is\s+(this|this\s+\w+|the\s+doc\w*|the\s+paper|the\s+file)(\s+about)?\s*\??\s*$",
    r"\bwhat\s+does\s+(this|the|it)(\s+\w+)?\s+(say|contain|cover|discuss|talk\s+about)\b",
    r"\b(title|topic|gist|main\s+point|key\s+points?)\b",
    r"\btl\s*;?\s*dr\b",
    r"\b(describe|explain|outline)\s+(this|the)\s+(document|doc|paper|file|text)\b",
    r"\btell\s+me\s+about\s+(this|the)\s+(document|doc|paper|file)\b",
    r"\b(what\s+is\s+the\s+(main|general|overall)\s+(idea|theme|content|subject))\b",
    r"\bgive\s+me\s+(a\s+)?(summary|overview|gist|rundown|brief)\b",
)
STOP_WORDS = tuple("what is the this that does about tell me give can you how when where which who are was were has have been will would could should do did a an of in on for to my it its".split())
SOURCES_HEAD = r"(?i)\bsources\s*:\s*"

#: Where words of ASCII letters, digits and _ begin or end; a plain \b goes by Unicode letters on some Java versions.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def edged(pattern: str) -> str:
    """The pattern with ASCII word edges for each \\b, as other engines read it."""
    return pattern.replace(r"\b", EDGE)


def collapse(c: Column) -> Column:
    """White space folded to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, r"\R", -1)


def dehyphenate(c: Column) -> Column:
    """Line feeds only; a soft break (U+FFFE and a line feed) joins the word, a stray mark goes."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    return F.replace(F.replace(c, F.lit("￾\n"), F.lit("")), F.lit("￾"), F.lit(""))


def is_page_number(c: Column) -> Column:
    return c.rlike(PAGE_NUMBER)


def is_heading(c: Column) -> Column:
    return c.rlike(HEADING)


def row_text(cells: Column) -> Column:
    """Cells of a table row joined by a bar; empty cells and repeats of the cell kept last are dropped."""
    clean = F.filter(F.transform(cells, collapse), lambda x: x != "")
    kept = F.aggregate(clean, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == x), acc).otherwise(F.array_append(acc, x)))
    return F.array_join(kept, " | ")


def estimated_tokens(c: Column) -> Column:
    return (F.size(words(c)) * F.lit(1.4)).cast("int") + 1


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_GAP, -1)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def normalised(c: Column) -> Column:
    """Canonical form for matching; the input is compatibility-composed (NFKC) already."""
    c = F.lower(c)
    for old, new in (("’", "'"), ("c#", "csharp"), ("c++", "cplusplus")):
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, "[‐-―−]", "-")
    c = F.regexp_replace(c, r"(\d)\s*[x×]\s*(\d)", "$1 x $2")
    for _ in range(7):
        c = F.regexp_replace(c, r"(\d),(\d{3})(?!\d)", "$1$2")
    c = F.regexp_replace(c, r"(\d+)(?:\.0+|(\.\d*[1-9])0*)(?!\d)", "$1$2")
    c = F.regexp_replace(c, r"[^a-z0-9.]+", " ")
    c = F.regexp_replace(c, r"(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def straight(c: Column) -> Column:
    return F.replace(c, F.lit("’"), F.lit("'"))


def is_strict_refusal(c: Column) -> Column:
    return straight(c).rlike(STRICT_REFUSAL)


def is_abstention(c: Column) -> Column:
    return straight(c).rlike(STRICT_REFUSAL) | straight(c).rlike(SOFT_REFUSAL)


def says_abstain(c: Column, phrases: tuple = ABSTAIN_PHRASES) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.lower(c), F.lit(p))
    return out


def is_broad(c: Column) -> Column:
    """Overview questions: a known phrase, or few words of which at most one carries content."""
    q = F.trim(c)
    hit = F.lit(False)
    for p in BROAD:
        hit = hit | q.rlike("(?i)" + edged(p))
    w = words(q)
    content = F.filter(w, lambda x: ~F.btrim(F.lower(x), F.lit("?.,!")).isin(*STOP_WORDS) & (F.length(x) > 3))
    return hit | ((F.size(w) <= 8) & (F.size(content) <= 1))


def file_name(title: Column) -> Column:
    return F.concat(F.substring(F.replace(F.trim(F.regexp_replace(title, r"(?U)[^\w\- ]+", "")), F.lit(" "), F.lit("_")), 1, 60), F.lit(".pdf"))


def sentence_around(text: Column, start: Column, length: Column) -> Column:
    """The sentence around characters [start, start + length); null unless it has 4 to 60 words."""
    before = F.substring(text, F.lit(1), start)
    after = text.substr(start + length + 1, F.length(text))
    # A mark ends a sentence before white space, and right before the span.
    head = F.regexp_extract(before, r"(?s)^(.*[.!?](?=\s|\z))", 1)
    tail = F.regexp_extract(after, r"(?s)^(.*?[.!?])(?=\s|\z)", 1)
    end = F.when(tail == "", after).otherwise(tail)
    s = strip(F.concat(text.substr(F.length(head) + 1, start - F.length(head)), text.substr(start + 1, length), end))
    return F.when(F.size(words(s)).between(4, 60), s)


def tier(confidence: Column) -> Column:
    pct = (confidence * 100).cast("int")
    return F.when(pct >= 70, "high").when(pct >= 50, "medium").otherwise("low")
