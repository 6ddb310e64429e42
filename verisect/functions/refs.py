"""References to authorities in an answer, and which of them it credits a quotation to."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from functools import lru_cache

from verisect.functions.udfs import FULL_CITE, Layout, arrow, name_before, quote_place, sentence_starts, sides

# How references other than full citations are written, and words that no supra clause names a case by.
SHORT = re.compile(r"\b(\d{1,4})\s+([A-Z][A-Za-z.'’]*(?:\s+(?:[A-Z][A-Za-z.'’]*|\d[a-z]{1,2}))*)\s+at\s+\*?\d+(?:\s*[-–—]\s*\d+)?")
ID = re.compile(r"(?<![A-Za-z])(?:[Ii]d|[Ii]bid)\.(?:,?\s+at\s+\*?\d+(?:\s*[-–—]\s*\d+)?(?:\s*(?:n|&)\.?\s*\d+)?)?")
SUPRA = re.compile(r"\bsupra\b(?:,?\s+at\s+\*?\d+)?")
# Each form opens with its letter, told to open a word right after it: the scan then skips to such letters.
NONCASE = re.compile(
    r"§|F(?<!\wF)ed\.\s*R\.|R(?<!\wR)(?:ule\s+\d|estatement\b)|A(?<!\wA)m\.\s*Jur\.|C(?<!\wC)(?:orbin\b|\.F\.R\.)|W(?<!\wW)illiston\b|U(?<!\wU)\.S\.C\.|S(?<!\wS)tat\.\s"
)
SIGNAL_WORDS = {"see", "cf", "also", "accord", "but", "compare", "contra", "the", "in", "e.g", "and", "with", "v", "vs"}
# Words that are no party's own.
NOBODY = {
    "state", "states", "people", "united", "commonwealth", "city", "county", "department", "dept",
    "estate", "matter", "parte", "the", "commissioner", "comm", "board", "town", "village", "district",
    "school", "florida", "government", "secretary", "director", "company", "corporation", "insurance",
    "bank", "national", "american", "first", "general", "court", "inc", "corp", "division", "office",
    "unknown", "john", "doe", "roe", "jane", "fla", "rel",
}
# What may stand between a citation and a quotation in its parentheses, a sentence's end, words of a case name's lead.
PAREN_GAP = re.compile(r"[\s,;\d–—\-n.&]*(?:\([^()\n]{0,80}\)[\s,]*){0,2}\(\s*(?:[a-z][a-z ,]{0,40}?\s*:?\s*)?[\"“‘']?\s*")
SENTENCE_END = re.compile(r"[.!?][\"”’')\]]*\s+(?=[A-Z\"“])")
LEADING = {
    "v.", "vs.", "of", "the", "and", "&", "ex", "rel.", "in", "re", "for", "de", "la", "on", "to", "by", "a",
    "an", "at", "e.g.,", "see", "see,", "also", "cf.", "accord", "but", "compare",
}
#: What the forms of other references hold, each at least one; words up to which a text is searched for one after another.
HOLDS = {"short": ("at",), "id": ("id.", "Id.", "bid."), "noncase": ("§", "Fed.", "Rule", "Restatement", "Am.", "Corbin", "C.F.R.", "Williston", "U.S.C.", "Stat.")}
FEW = 4
#: Characters before a supra in which its clause is sought, and before a full citation in which its name is.
CLAUSE, NAMED = 60, 120


def lowered(text: str) -> str:
    """Lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def word_hits(low: str, words: set[str]) -> dict[str, list[int]]:
    """Where each of many words begins in a text, in one pass."""
    import ahocorasick

    found: dict[str, list[int]] = defaultdict(list)
    if len(words) <= FEW:
        for w in words:
            at = low.find(w)
            while at >= 0:
                found[w].append(at)
                at = low.find(w, at + 1)
    else:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for last, w in automaton.iter(low):
            found[w].append(last + 1 - len(w))
    return found


def party_key(name: str | None) -> str | None:
    """The first word of a case name, of four letters at least, that is a party's own."""
    words = (w for side in sides(name) for w in re.findall(r"[A-Z][A-Za-z'’-]{3,}", side or ""))
    return next((w for w in words if w.lower() not in NOBODY), None)


def find_references(text: str) -> list[dict]:
    """Every reference in order: kind (full, short, id, supra, noncase, name), start, end, text, target and between.

    target: the start of the full citation that it stands for.  between: of an id, whether a statute, rule or treatise
    stands between it and its antecedent.  One pass for each kind; names and supra words are sought all at once.
    """
    low = lowered(text)
    fulls = [m for m in FULL_CITE.finditer(text) if " at " not in m[0]]
    starts, ends = [m.start() for m in fulls], [m.end() for m in fulls]

    def inside(a: int, b: int) -> bool:
        i, j = bisect_right(starts, a) - 1, bisect_left(starts, b) - 1
        return (i >= 0 and a < ends[i]) or (j >= 0 and b <= ends[j])

    refs = [{"kind": "full", "start": m.start(), "end": m.end()} for m in fulls]
    for kind, pattern in (("short", SHORT), ("id", ID), ("noncase", NONCASE)):
        if any(part in text for part in HOLDS[kind]):
            refs += [{"kind": kind, "start": m.start(), "end": m.end(), "match": m} for m in pattern.finditer(text) if not inside(m.start(), m.end())]
    for m in SUPRA.finditer(text) if "supra" in text else ():
        clause = re.split(r"[.;:!?(]\s|\n", text[max(0, m.start() - CLAUSE) : m.start()])[-1]
        words = [w for w in re.finditer(r"[A-Z][A-Za-z'’&-]+", clause) if w[0].lower() not in SIGNAL_WORDS]
        if words and not inside(m.start(), m.end()):
            refs.append({"kind": "supra", "start": m.start() - len(clause) + words[0].start(), "end": m.end(), "words": [lowered(w[0]) for w in words]})
    # Parties whose names the answer writes before its full citations, wherever it names them again.
    owners: dict[str, list[int]] = defaultdict(list)
    for at in starts:
        if key := party_key(name_before(text, at)):
            owners[lowered(key)].append(at)
    letter = lambda k: 0 <= k < len(text) and text[k].isascii() and text[k].isalpha()
    for key, places in word_hits(low, set(owners)).items():
        whole = (p for p in places if text[p].isupper() and not letter(p - 1) and not letter(p + len(key)))
        refs += [{"kind": "name", "start": p, "end": p + len(key), "key": key} for p in whole]
    refs.sort(key=lambda r: (r["start"], r["kind"] != "full", r["kind"], r["end"]))

    # For a supra's words: the full citations in whose name or in the text before whom they stand.
    near: dict[str, list[int]] = {}
    for w, places in word_hits(low, {w for r in refs if r["kind"] == "supra" for w in r["words"]}).items():
        near[w] = sorted({at for p in places for at in starts[bisect_left(starts, p + len(w)) : bisect_right(starts, p + NAMED)]})
    key = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    by_volume: dict[tuple[str, str], int] = {}
    last, last_at, noncase_at = None, -1, -1
    for r in refs:
        r |= {"text": text[r["start"] : r["end"]], "target": None, "between": None}
        if r["kind"] == "full":
            r["target"] = r["start"]
            parts = r["text"].split()
            by_volume[parts[0], key("".join(parts[1:-1]))] = r["start"]
        elif r["kind"] == "short":
            r["target"] = by_volume.get((r["match"][1], key(r["match"][2])))
        elif r["kind"] == "supra":
            earlier = [s[k - 1] for w in r["words"] if (s := near.get(w)) and (k := bisect_left(s, r["start"]))]
            r["target"] = max(earlier, default=None)
        elif r["kind"] == "id":
            r["target"], r["between"] = last, last is not None and noncase_at > last_at
        elif r["kind"] == "name":
            mine = owners[r["key"]]
            k = bisect_right(mine, r["start"])
            r["target"] = mine[k - 1] if k else mine[0]
        else:
            noncase_at = r["start"]
        if r["kind"] in ("full", "short", "supra", "id") and r["target"] is not None:
            last, last_at = r["target"], r["start"]
    return [{k: r[k] for k in ("kind", "start", "end", "text", "target", "between")} for r in refs]


@lru_cache(8)
def read(text: str) -> tuple[list[dict], list[int], Layout]:
    """References, starts of sentences and layout of an answer, once for all its quotations in a batch."""
    return find_references(text), sentence_starts(text), Layout(text)


def references(answer: str | None) -> list[dict]:
    return find_references(answer or "")


def abbreviates(text: str, at: int, starts: list[int], end: int) -> bool:
    """Whether the mark at a place ends no sentence: none begins right after it."""
    k = bisect_right(starts, at)
    return not (k < len(starts) and starts[k] <= end)


def leads_name(tail: str) -> bool:
    """Whether what stands before a citation is just a case name, with or without a signal."""
    words = tail.split()
    return bool(re.search(r",\s*$", tail)) and all(w[0].isupper() or not w[0].isalpha() or w.lower() in LEADING for w in words)


def attribution(answer: str | None, quote: str | None) -> dict | None:
    """The reference that an answer credits a quotation to, by which rule, and the sentence that shows it.

    rule: parenthetical, right_after, closest_before, earlier, first_after or none.  sentence holds the quotation at
    [quote_start, quote_end), and the reference at [ref_start, ref_end) unless it stands in a sentence elsewhere
    (cite_sentence).  note: why the reference after the quotation was passed over, or what stands before an id.
    """
    spot = quote_place(answer, quote)
    if not spot:
        return None
    text, a, b = answer, spot["start"], spot["end"]
    all_refs, starts, layout = read(text)
    refs = [r for r in all_refs if r["kind"] != "noncase" and not a <= r["start"] < b]
    cited = [r for r in refs if r["kind"] != "name"]
    before, following = [r for r in cited if r["end"] <= a], [r for r in cited if r["start"] >= b]
    para = layout.paragraph(a, b)[0]
    chosen, rule, note = None, "none", None
    if before and PAREN_GAP.fullmatch(text, before[-1]["end"], a):
        chosen, rule = before[-1], "parenthetical"
    elif following:
        r = following[0]
        gap = text[b : r["start"]]
        if "\n" not in gap and len(gap) <= 250:
            ends = [m for m in SENTENCE_END.finditer(text, max(0, b - 1), min(len(text), r["start"] + 1)) if m.start() < r["start"] and not abbreviates(text, m.start(), starts, m.end())]
            tail = text[ends[-1].end() : r["start"]] if ends else gap
            if not ends or len(ends) == 1 and (not tail.strip() or leads_name(tail)):
                if passed := re.search(r"\b(?:citing|quoting)\b", gap, re.I):
                    note = f"{passed[0].lower()} {r['text']}"
                else:
                    chosen, rule = r, "right_after"
    if chosen is None and (earlier := [r for r in refs if r["end"] <= a]):
        chosen, rule = earlier[-1], "closest_before" if earlier[-1]["start"] >= para else "earlier"
    if chosen is None and following:
        chosen, rule = following[0], "first_after"
    if chosen is not None and chosen["between"]:
        note = note or "a non-case authority stands before it"
    begin = lambda at: starts[bisect_right(starts, at) - 1]

    def finish(at: int) -> int:
        k = bisect_right(starts, at)
        return len(text[: starts[k] if k < len(starts) else len(text)].rstrip())

    lo, hi, own = begin(a), finish(b), None
    if chosen is not None:
        if chosen["start"] >= b:
            hi = max(hi, finish(chosen["end"] - 1))
        elif chosen["start"] >= para and a - chosen["start"] <= 900:
            lo = min(lo, begin(chosen["start"]))
        else:
            own = text[begin(chosen["start"]) : finish(chosen["end"] - 1)]
    marked = chosen is not None and own is None
    return {
        "rule": rule, "ref": chosen and chosen["text"], "kind": chosen and chosen["kind"], "target": chosen and chosen["target"], "note": note, "sentence": text[lo:hi], "quote_start": a - lo, "quote_end": b - lo,
        "ref_start": chosen["start"] - lo if marked else None, "ref_end": chosen["end"] - lo if marked else None, "cite_sentence": own,
    }


citation_refs = arrow("array<struct<kind:string,start:int,end:int,text:string,target:int,between:boolean>>")(references)
attribute_quote = arrow("struct<rule:string,ref:string,kind:string,target:int,note:string,sentence:string,quote_start:int,quote_end:int,ref_start:int,ref_end:int,cite_sentence:string>")(attribution)
