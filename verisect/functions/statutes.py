"""Texts of rules that briefs quote, and how answers name rules."""

from __future__ import annotations

import re

from verisect.functions.udfs import arrow, follows, hinted, padded, plain_words, printed, quote_parts, variants

# Rule texts that are often quoted, with the rules that have or had them.
FIXED_RULES = (
    ("Fed. R. Civ. P. 56(a) (2010-); Fla. R. Civ. P. 1.510(a) (2021-)", "The court shall grant summary judgment if the movant shows that there is no genuine dispute as to any material fact and the movant is entitled to judgment as a matter of law."),
    ("Fed. R. Civ. P. 56(c) (before 2007); Fla. R. Civ. P. 1.510(c) (before 2021)", "The judgment sought shall be rendered forthwith if the pleadings, depositions, answers to interrogatories, and admissions on file, together with the affidavits, if any, show that there is no genuine issue as to any material fact and that the moving party is entitled to a judgment as a matter of law."),
    ("Fed. R. Civ. P. 56(c)(2) (2007-2010)", "The judgment sought should be rendered if the pleadings, the discovery and disclosure materials on file, and any affidavits show that there is no genuine issue as to any material fact and that the movant is entitled to judgment as a matter of law."),
    ("Fed. R. Civ. P. 12(b)(6)", "failure to state a claim upon which relief can be granted"),
    ("Fed. R. Civ. P. 12(d)", "If, on a motion under Rule 12(b)(6) or 12(c), matters outside the pleadings are presented to and not excluded by the court, the motion must be treated as one for summary judgment under Rule 56."),
    ("Fed. R. Civ. P. 8(a)(2)", "a short and plain statement of the claim showing that the pleader is entitled to relief"),
    ("Fed. R. Civ. P. 15(a)(2)", "The court should freely give leave when justice so requires."),
    ("Fed. R. Evid. 403 (2011-); MRE 403 (2024-)", "The court may exclude relevant evidence if its probative value is substantially outweighed by a danger of one or more of the following: unfair prejudice, confusing the issues, misleading the jury, undue delay, wasting time, or needlessly presenting cumulative evidence."),
    ("Fed. R. Evid. 403 (before 2011); MRE 403 (before 2024)", "Although relevant, evidence may be excluded if its probative value is substantially outweighed by the danger of unfair prejudice, confusion of the issues, or misleading the jury, or by considerations of undue delay, waste of time, or needless presentation of cumulative evidence."),
    ("Fla. Stat. § 90.403", "Relevant evidence is inadmissible if its probative value is substantially outweighed by the danger of unfair prejudice, confusion of issues, misleading the jury, or needless presentation of cumulative evidence."),
    ("Fed. R. Evid. 401 (2011-)", "Evidence is relevant if: (a) it has any tendency to make a fact more or less probable than it would be without the evidence; and (b) the fact is of consequence in determining the action."),
    ("Fed. R. Evid. 401 (before 2011)", "\"Relevant evidence\" means evidence having any tendency to make the existence of any fact that is of consequence to the determination of the action more probable or less probable than it would be without the evidence."),
)
# How an answer names a rule, whose it is, and its key there; a bare rule counts where no other is named.
NAMED_RULES = (
    (re.compile(r"\bFed\.?\s*R\.?\s*Civ\.?\s*P\.?\s*(\d+)|\bFRCP\s*(\d+)", re.I), "fedrule", "Fed. R. Civ. P. {}"),
    (re.compile(r"\bFed\.?\s*R\.?\s*Evid\.?\s*(\d+)|\bFRE\s*(\d+)"), "fedrule", "Fed. R. Evid. {}"),
    (re.compile(r"\bFed\.?\s*R\.?\s*Crim\.?\s*P\.?\s*(\d+)", re.I), "fedrule", "Fed. R. Crim. P. {}"),
    (re.compile(r"\bFed\.?\s*R\.?\s*App\.?\s*P\.?\s*(\d+)", re.I), "fedrule", "Fed. R. App. P. {}"),
    (re.compile(r"\bMRE\s*(\d+)|\bMich\.?\s*R\.?\s*Evid\.?\s*(\d+)"), "mi", "MRE {}"),
    (re.compile(r"\bMCR\s*(\d+\.\d+)"), "mi", "MCR {}"),
    (re.compile(r"\bFla\.?\s*R\.?\s*(?:Civ|Crim|App|Jud|Gen)\.?\s*(?:P\.?|Admin\.?)?\s*(\d\.\d+)"), "fl_rule", "{}"),
    (re.compile(r"§\s*(\d+\.\d+)[^.;]{0,12}Fla\.\s*Stat|Fla\.\s*Stat\.\s*§\s*(\d+\.\d+)"), "fl_statute", "{}"),
)
BARE_RULE = (re.compile(r"\bRule\s+(\d+)\s*\(", re.I), "fedrule", "Fed. R. Civ. P. {}")


def rule_hay(text: str | None) -> str:
    return padded(plain_words(printed(text)))


FIXED_HAYS = tuple((name, rule_hay(text)) for name, text in FIXED_RULES)


def follows_rule(quote: str | None, text: str | None) -> bool:
    """Whether any variant of a quotation follows through a rule's text."""
    hay = rule_hay(text)
    return any(follows(quote_parts(v), hay) for v in variants(quote or ""))


def fixed_rule(quote: str | None) -> str | None:
    """The first rule of the fixed list through which a quotation follows."""
    parts = [quote_parts(v) for v in variants(quote or "")]
    return next((name for name, hay in FIXED_HAYS if any(follows(p, hay) for p in parts)), None)


def rule_mentions(text: str | None) -> list[dict]:
    """Every place where a text names a rule: start, end, place of its form in the order of forms, jurisdiction and key."""
    if not hinted(text or "", "fed", "frcp", "fre", "mre", "mich", "mcr", "fla", "§", "rule"):
        return []
    found = [(m, form, *kind) for form, (pattern, *kind) in enumerate((*NAMED_RULES, BARE_RULE)) for m in pattern.finditer(text or "")]
    return [{"start": m.start(), "end": m.end(), "form": form, "jurisdiction": whose, "rule": key.format(next(g for g in m.groups() if g))} for m, form, whose, key in found]


in_rule = arrow("boolean")(follows_rule)
fixed_rule_of = arrow("string")(fixed_rule)
rules_named = arrow("array<struct<start:int,end:int,form:int,jurisdiction:string,rule:string>>")(rule_mentions)
