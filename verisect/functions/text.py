"""Text normalisers and small text functions as Column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as one.
APOSTROPHES = "’‘`ʼ"
CURLY = "‘’"
DASHES = "\u2010\u2011‒–—―−"


def words_of(text: Column) -> Column:
    """The parts between single spaces, without empty ones."""
    return F.array_remove(F.split(text, " "), "")


def strip_markdown(text: Column) -> Column:
    """Without heading, quotation and list marks, emphasis and code marks; a star before a digit stays."""
    t = F.regexp_replace(text, r"(?m)^[ \t]{0,3}(?:#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+)", "")
    t = F.regexp_replace(t, r"\*(?![0-9])", "")
    t = F.regexp_replace(t, r"(?<![A-Za-z0-9])_{1,3}(?=\S)(.+?)(?<=\S)_{1,3}(?![A-Za-z0-9])", "$1")
    return F.regexp_replace(t, "`", "")


def norm_words(text: Column, brackets: bool = True) -> Column:
    """Lower-case words of ASCII letters and digits; one letter in brackets joins its word ([T]he)."""
    return words_of(_normal(text, brackets))


def _normal(text: Column, brackets: bool) -> Column:
    """The words between single spaces, with one before and after."""
    t = F.lower(text)  # quotation marks of every kind become spaces below
    if brackets:
        t = F.when(F.contains(t, F.lit("[")), F.regexp_replace(t, r"\[([a-z])\]", "$1")).otherwise(t)
    return F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), "[^a-z0-9]+", " ")


def match_words(text: Column) -> Column:
    """norm_words without those of digits only: page numbers and note marks never break a run."""
    return words_of(F.regexp_replace(_normal(text, True), " [0-9]+(?= )", ""))


def padded(words: Column) -> Column:
    """The words as one text with a space on either side of each, in which runs of whole words can be found."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def fold_print(text: Column) -> Column:
    """Folds what printing varies: zero-width marks, hyphens, spaces, quotation marks, words broken at a line's end."""
    t = F.regexp_replace(text, "[\u00ad\u200b-\u200d\u2060\ufeff]", "")
    t = F.regexp_replace(t, "[\u2010\u2011]", "-")
    t = F.regexp_replace(t, "[\u00a0\u2000-\u200a\u202f\u205f\u3000]", " ")
    t = F.regexp_replace(t, "[‘’ʼ]", "'")
    t = F.regexp_replace(t, "[“”]", '"')
    return F.regexp_replace(t, r"(?<=[a-z])-(?:[ \t]*\r?\n[ \t]*|[ \t]+)(?=[a-z])", "")


def fold_answer(text: Column) -> Column:
    """One apostrophe, one dash without spaces around it, one space, lower case.

    Compatibility forms (ligatures, full-width letters) need functions.udfs.fold_answer.
    """
    t = F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))
    t = F.regexp_replace(F.regexp_replace(t, "\u00a0", " "), f"[{DASHES}]|--+", "-")
    t = F.regexp_replace(t, r"\s*-\s*", "-")
    return F.trim(F.lower(F.regexp_replace(t, r"\s+", " ")))


def fold_span(text: Column) -> Column:
    return F.lower(F.trim(text))


def reporter_key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def ends_sentence(text: Column) -> Column:
    """Trimmed, and with a full stop unless it ends in a mark."""
    t = F.trim(text)
    return F.when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def capitalised(text: Column) -> Column:
    t = F.trim(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))


def json_snippet(text: Column, key: str, limit: int = 240) -> Column:
    """The first string under `key` in broken JSON, with its escapes and spaces folded, at most `limit` characters."""
    raw = F.regexp_extract(text, f'"{key}"\\s*:\\s*"((?:[^"\\\\]|\\\\.)*)', 1)
    t = F.regexp_replace(F.regexp_replace(raw, r"\\[nrt]", " "), r'\\(["\\/])', "$1")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, r"\\.?", ""), r"\s+", " ")), 1, limit)


def segments(quote: Column, least: int = 4) -> Column:
    """Word lists of the parts between ellipses, of those with at least `least` words."""
    parts = F.split(quote, r"\.\s*\.\s*\.|…|\[\s*\.\.\.\s*\]")
    return F.filter(F.transform(parts, match_words), lambda w: F.size(w) >= least)


def run_length(n: Column) -> Column:
    """Words that a near match needs: four fifths, rounded up, and four at least."""
    return F.greatest(F.lit(4), F.floor(F.lit(0.8) * n + 0.999).cast("int"))


def segment_match(words: Column, hay: Column) -> Column:
    """`verbatim` if the words run through the padded text, `near` if enough of them do in one run, else null."""
    need = run_length(F.size(words))
    last = F.size(words) - need + 1
    near = F.when(last >= 1, F.exists(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda p: F.contains(hay, padded(F.slice(words, p, need)))))
    return F.when(F.contains(hay, padded(words)), "verbatim").when(F.coalesce(near, F.lit(False)), "near")


def bracket_variants(quote: Column) -> Column:
    """As written, without free-standing brackets of 1 to 60 characters, without any of at most 60; a space stands for each."""
    free = F.regexp_replace(quote, r"(?<![A-Za-z0-9])\[[^\[\]]{1,60}\](?![A-Za-z0-9])", " ")
    return F.array_distinct(F.array(quote, free, F.regexp_replace(quote, r"\[[^\[\]]{0,60}\]", " ")))


def grams(words: Column, k: int) -> Column:
    """All runs of k words, joined by spaces; the whole if there are fewer, nothing for none."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))
    return F.when(n > 0, F.transform(starts, lambda p: F.array_join(F.slice(words, p, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))


def answer_line(answer: Column) -> Column:
    """line and found: the last line that opens with ANSWER:, without that, else the last line that isn't empty."""
    lines = F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    marked = F.filter(lines, lambda x: x.rlike(r"(?i)^\W*answer\s*:"))
    last = F.try_element_at(marked, F.lit(-1))
    body = F.trim(F.regexp_replace(last, r"(?i)^\W*answer\s*:\s*", ""))
    line = F.when(last.isNotNull(), F.when(body != "", body).otherwise(last)).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))
    return F.struct(line.alias("line"), last.isNotNull().alias("found"))


def vendor_cite(line: Column) -> Column:
    """Whether a folded line cites a vendor's database."""
    return line.rlike(r"\bwl\b") | F.contains(line, F.lit("lexis")) | F.contains(line, F.lit("westlaw"))


def fragments_in_order(needle: Column, hay: Column, ellipsis: str) -> Column:
    """Whether the needle's parts around an ellipsis follow each other in the text."""
    parts = F.filter(F.transform(F.split(needle, F.lit("\\Q" + ellipsis + "\\E")), lambda x: F.trim(x)), lambda x: x != "")
    return F.contains(needle, F.lit(ellipsis)) & (_follow(parts, hay) > 0)


def _follow(parts: Column, hay: Column) -> Column:
    """The place after the last part, 0 if one is missing; 1-based."""

    def step(pos: Column, part: Column) -> Column:
        found = F.position(part, hay, F.greatest(pos, F.lit(1)))
        return F.when((pos > 0) & (found > 0), found + F.length(part)).otherwise(F.lit(0))

    return F.aggregate(parts, F.lit(1), step)


def span_match(gold: Column, predicted: Column) -> Column:
    """Whether two spans are the same finding: one holds the other, or the parts of one around an ellipsis follow in the other."""
    g, p = fold_span(gold), fold_span(predicted)
    either = F.contains(p, g) | F.contains(g, p)
    for mark in ("...", "…"):
        either = either | fragments_in_order(p, g, mark) | fragments_in_order(g, p, mark)
    return F.coalesce((g != "") & (p != "") & either, F.lit(False))


# Words of which every phrase that withdraws a citation, or doubts one, holds one; `not` does before a number.
SLIPS = ("wrong", "error", "typo", "initially", "originally", "first", "earlier", "mistakenly", "miscited", "mis-cited", "mistyped", "miscopied", "incorrect", "mistaken", "erroneous")
DOUBTS = ("verify", "exist", "confirm", "locate", "rely")

# Phrases of an answer that declines.
ABSTENTION = (
    r"not (?:certain|sure|confident|able to (?:verify|confirm|locate|find))|cannot (?:verify|confirm|locate|find|identify|provide)|"
    r"can(?:'|no)t (?:verify|confirm|locate|find|identify)|unable to (?:verify|confirm|locate|find|identify)|"
    r"(?:do|did) not (?:know|have (?:a|access))|don't know|could not (?:verify|find|locate|confirm)|uncertain|will not guess|won't guess|"
    r"rather than guess|no (?:verified|reliable) (?:citation|authority)"
)


def abstains(answer: Column, cites: Column) -> Column:
    """1 if the answer cites nothing and says that it doesn't know."""
    return ((cites == 0) & F.coalesce(answer.rlike(f"(?i){ABSTENTION}"), F.lit(False))).cast("int")
