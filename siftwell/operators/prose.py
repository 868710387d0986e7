"""Names of persons and postal addresses in running text, by their form and by what stands beside them."""

from __future__ import annotations

import calendar
import math
import re
from typing import NamedTuple

from siftwell.operators.namemodel import NameModel

UPPER, LETTER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩА-ЯЁԱ-Ֆ", r"[^\W\d_]"
CAPITAL = rf"[{UPPER}](?:{LETTER}|['’-](?={LETTER}))+"
RUN = re.compile(rf"\b{CAPITAL}(?:[ -]{CAPITAL}){{0,9}}")
TOKEN = re.compile(CAPITAL)

#: Common given names of several countries: a token that is one is taken for a name at first sight.
GIVEN = frozenset("""
Aaron Abdul Adam Aditi Aditya Ahmed Aisha Alan Albert Alejandro Alex Alexander Alice Amanda Amit Amy Ana Ananya Andrea Andrew Angela Anita Anjali Ann Anna Anthony Antonio Arjun Arthur Arun
Barbara Ben Benjamin Brian Carlos Carol Catherine Charles Charlotte Chen Chris Christine Christopher Claire Daniel David Deepak Diana Diego Divya Edward Elena Elizabeth Emily Emma Eric Ethan Eva
Fatima Fernando Francesca Francisco Frank Gabriel Gary George Giulia Grace Hannah Hans Harry Hassan Heather Helen Henry Hiroshi Ian Ibrahim Ingrid Isabel Isabella Ivan
Jack Jacob James Jane Jason Javier Jean Jennifer Jessica Joan John Jonathan Jose Joseph Joshua Juan Julia Julie Karan Karen Kate Kavita Kenji Kevin Kiran Klaus Laura Lauren Leo Liam Linda Lisa Luca Lucas Lucy Luis
Manuel Marco Marcus Maria Marie Mario Mark Martin Mary Matthew Meera Mei Michael Michelle Miguel Mohammed Mohan Monica Nancy Natalie Neha Nicholas Nikhil Nina Noah Oliver Olivia Omar Oscar Pablo Patricia Patrick Paul Pedro Peter Philip Pierre Pooja Priya
Rachel Rahul Raj Rajesh Ravi Rebecca Richard Robert Rohan Rosa Ryan Samantha Samuel Sandra Sanjay Sara Sarah Scott Sergei Sofia Sophie Stefan Stephen Steven Sunita Suresh Susan Tanya Thomas Timothy Victoria Vikram Vincent Walter Wei William Yuki Yusuf Zoe
""".split())
#: Capitalised words that are no persons, and nouns of headings, which are cut off a run's ends.
NEVER = frozenset([*calendar.month_name, *calendar.day_name, *calendar.month_abbr, *calendar.day_abbr]) | frozenset("""
Sept Tues Thur Thurs Today Tomorrow Yesterday
The An And Or But If Then Else When While For In On At To From With Without By Of As Is Are Was Were Be Been This That These Those There Here It Its We Our You Your They Their He She His Her My Me Us Them Not No Yes
Please Thanks Thank Regards Best Hi Hello Dear Hey Good Morning Afternoon Evening Night Azure Google Microsoft Amazon Apple Meta Slack Notion Figma Linear Stripe React Node Python Java Ruby Rust Docker Kubernetes Linux Windows Android Chrome Firefox Safari Edge
Inc Ltd Pvt Plc Corp Corporation Company Limited Group Holdings Ventures Partners Capital North South East West Central Street Road Avenue Lane Drive Boulevard Block Sector Phase Floor Suite Unit
Note Error Warning Info Debug Fatal Exception Traceback Stack Request Response Status Mr Mrs Ms Mx Dr Prof Professor Sir Madam Shri Smt Sri Kum Capt Col Maj Lt Rev Hon Fr
Confidential Privileged Internal Restricted Proprietary Draft Final Version Revision Update Summary Report
""".split())
HEADING = re.compile(
    "(?i)(?:agreement|services?|review|reports?|summary|memo|memorandum|minutes|proposal|statement|policy|overview|plan|update|notes?|deck|agenda|invoice|receipt|contract|addendum|annexure|annex|appendix|schedule|exhibit|terms?|conditions|disclosure|confidential|privileged|draft|final|version|roadmap|strategy|budget|forecast|analysis|assessment|audit|charter|guidelines?|handbook|manual|specification|requirements|template|checklist|register|ledger|balance|sheet|board|committee|meeting|quarter|quarterly|annual|monthly|weekly|master|standard|framework|process|procedure|protocol|records?|room|letter|intent|offer|quote|quotation|purchase|payroll|expenses?|reimbursement|onboarding|offboarding|incident|postmortem|retrospective|runbook|playbook|dashboard|metrics|objectives|targets|confidentiality|amendment|renewal|termination|invoicing|remittance|advice|slip|form|application|declaration|undertaking|affidavit|deed|title|clause|section|article)"
)
#: What stands before or after persons, jobs, places and products.
HONORIFIC = re.compile(r"(?i)\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Professor|Sir|Madam|Shri|Smt|Sri|Kum|Capt|Col|Maj|Lt|Rev|Hon|Fr|Sr|Jr)\.?\s*$")
INTRODUCED = re.compile(r"(?i)\b(?:name is|named|called|contact|spoke (?:to|with)|met|met with|according to|signed by|reported by|assigned to|owner|manager|lead|from|cc|to|attn|attention|regards|sincerely|thanks|thank you|hi|hello|dear|hey|mr|mrs|ms|dr|prof|shri|smt|sri)\b[\s,:]*$")
ACTS = re.compile(r"(?i)[\s,]*(?:(?:said|says|wrote|asked|replied|confirmed|reported|mentioned|added|noted|resigned|joined|left|is|was|has|had|will|can)\b|'s|’s|\(|<|@)")
JOB = re.compile(r"(?i)[\s,(]*(?:CEO|CTO|CFO|COO|CIO|CISO|VP|Director|Manager|Head|Lead|Engineer|Designer|Analyst|Consultant|Partner|Founder|President|Chair|Officer|Advisor|Counsel|Attorney|Doctor|Nurse|Professor)\b")
#: Within a sentence (a letter's head begins with a capital), such a word and a comma introduce no single word that is no given name.
APART = re.compile(r"\b(?:from|to),\s*$")
PLACE_BEFORE = re.compile(r"(?i)\b(?:the|in|at|from|to|near|across|within|our|their)\s+$")
PLACE_AFTER = re.compile(r"(?i)[\s,]*(?:region|regions|office|offices|branch|branches|team|cluster|clusters|server|servers|datacent(?:re|er)|data cent(?:re|er)|timezone|time zone|market|markets|store|stores|warehouse|campus|airport|zone|instance|node|endpoint|environment|deployment|release|version|API|SDK|repo|repository|pipeline|build)\b")
ABBREVIATED = re.compile(r"(?i)\b(?:Mr|Mrs|Ms|Mx|Dr|Prof|Sr|Jr|St|Ave|Rd|No|vs|etc|eg|ie|approx|Inc|Ltd|Co|Corp|Capt|Col|Maj|Lt|Rev|Hon|Fr|Shri|Smt|Sri)\.\s*$")
SENTENCE = re.compile(r"[.!?:;\n•\-*]\s*$")

#: Log odds of a token that is a given name and of another one; fixed values: of what speaks for or against a person.
KNOWN, UNKNOWN, LEAST_SCORE = math.log(0.85 / 0.15), math.log(0.3 / 0.7), 0.72
EVIDENCE = {"honorific": 3.4, "introduced": 1.9, "acts": 1.2, "job title": 1.6, "full name": 1.5, "further name": 0.4, "possessive": 0.9, "matching email": 1.4}
AGAINST = {"sentence-initial": 2.2, "alone": 1.9, "place after": 4.6, "place before": 2.6}
STRETCH = 64
STRONG = {"honorific", "introduced", "full name", "job title"}


#: Last words before a name that ``HONORIFIC`` or ``INTRODUCED`` may fit; all else need not be searched.
CUES = frozenset("mr mrs ms mx dr prof professor sir madam shri smt sri kum capt col maj lt rev hon fr sr jr is named called contact to with met by owner manager lead from cc attn attention regards sincerely thanks you hi hello dear hey".split())


class Span(NamedTuple):
    start: int
    end: int
    text: str
    score: float
    evidence: tuple[str, ...]


def _in_blob(text: str, start: int, end: int) -> bool:
    """Within 44 and more characters without a space, up to 48 on either side."""
    left, right = re.search(r"\S*$", text[max(0, start - 48) : start]), re.match(r"\S*", text[end : end + 48])
    return end - start + len(left[0]) + len(right[0]) >= 44


def _runs(run: re.Match) -> list[list[tuple[int, str]]]:
    """Up to four neighbouring tokens each, parted at words that are no names, without headings' nouns at the ends."""
    if " " not in run[0] and "-" not in run[0]:
        return [] if run[0] in NEVER or run[0].isupper() else [[(run.start(), run[0])]]
    out, now = [], []
    for m in TOKEN.finditer(run[0]):
        no_name = m[0] in NEVER or m[0].isupper()  # capitals throughout say nothing
        if no_name or len(now) == 4:
            out.append(now)
            now = []
        if not no_name:
            now.append((run.start() + m.start(), m[0]))
    out.append(now)
    for tokens in out:
        while tokens and HEADING.fullmatch(tokens[-1][1]):
            tokens.pop()
        while tokens and HEADING.fullmatch(tokens[0][1]):
            tokens.pop(0)
    return [tokens for tokens in out if tokens]


class Emails:
    """First letters of names that the addresses of a line could be made from, found once a line."""

    def __init__(self, text: str):
        self.text, self.line, self.heads = text, (0, -1), set()

    def match(self, head: str, start: int, end: int) -> bool:
        """Whether the line has an address with these letters, and nothing but an address's characters between them and the @."""
        if not self.line[0] <= start < self.line[1]:
            stop = self.text.find("\n", end)
            self.line = self.text.rfind("\n", 0, start) + 1, len(self.text) + 1 if stop < 0 else stop
            self.heads = set()
            for local in re.findall(r"([^\s@]{1,64})@", self.text[self.line[0] : self.line[1]].lower()):
                plain = len(local) - len(re.search("[a-z0-9._%-]*$", local)[0])
                self.heads |= {local[k : k + n] for n in (3, 4) for k in range(max(0, plain - n), len(local) - n + 1)}
        return len(head) >= 3 and head in self.heads


class Claimed:
    """Spans that belong to something already found, looked up by the stretch of text where they lie."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.by: dict[int, list[tuple[int, int]]] = {}
        for a, b in spans:
            for k in range(a // STRETCH, max(a, b - 1) // STRETCH + 1):
                self.by.setdefault(k, []).append((a, b))

    def holds(self, start: int, end: int) -> bool:
        return any(a <= start and end <= b for a, b in self.by.get(start // STRETCH, ()))

    def touches(self, start: int, end: int) -> bool:
        return any(a < end and start < b for k in range(start // STRETCH, (end - 1) // STRETCH + 1) for a, b in self.by.get(k, ()))


#: How family names of several languages end, of six letters and more.
FAMILY = re.compile(r"\w{2,}(?:sen|sson|ov|ova|eva|ski|sky|ska|wicz|enko|shvili|adze|oglu|escu|opoulos|nathan|swamy|murthy|appa|alves|quez|guez|ndez|nguez|mann|stein|ström|strom|quist|qvist|berger|hofer|shima|moto|zawa|yama|gawa)")


def _prior(tokens: list[tuple[int, str]], model: NameModel | None) -> tuple[float, bool]:
    """(log odds, whether it is a name at first sight): by the model, or by the list of given names and the end of a family name."""
    known = any(t in GIVEN for _, t in tokens) or (len(tokens) > 1 and len(tokens[-1][1]) > 5 and FAMILY.fullmatch(tokens[-1][1]) is not None)
    if model is None or known:
        return KNOWN if known else UNKNOWN, known
    best = min(max(model.score(t) for _, t in tokens), 1 - 1e-6)
    return math.log(max(best, 1e-6) / (1 - best)), best >= model.threshold


def _score(text: str, tokens: list[tuple[int, str]], emails: Emails | None, model: NameModel | None) -> tuple[float, list[str]]:
    """(likelihood, what speaks for it); 0 where nothing can make it a name."""
    start, end = tokens[0][0], tokens[-1][0] + len(tokens[-1][1])
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    (prior, known), single = _prior(tokens, model), len(tokens) == 1
    words, said = before.split(), []
    if words and words[-1].strip(".,:").rpartition("(")[2].lower() in CUES:
        if HONORIFIC.search(before):
            said.append("honorific")
        elif INTRODUCED.search(before) and (known or not single or not APART.search(before)):
            said.append("introduced")
    said += ["job title"] * bool(JOB.match(after))
    said += ["matching email"] * (emails is not None and emails.match(tokens[0][1].lower()[:4], start, end))
    acts = ACTS.match(after) is not None
    if not known and not said and (single or not acts):
        return 0.0, said  # neither two capitals nor a verb alone make a name of any word
    said += ["acts"] * acts + ["full name"] * (not single)
    opens = start == 0 or (SENTENCE.search(before[-12:]) and not ABBREVIATED.search(before[-12:]))
    against = ["sentence-initial"] * bool(single and opens and "honorific" not in said)
    against += ["alone"] * (single and not STRONG & set(said))
    if PLACE_AFTER.match(after):
        against.append("place after")
    elif single and PLACE_BEFORE.search(before):
        against.append("place before")
    said += ["possessive"] * bool(re.match(r"['’]s\b", after))
    z = prior + sum(EVIDENCE[s] for s in said) - sum(AGAINST[s] for s in against) + EVIDENCE["further name"] * max(0, len(tokens) - 2)
    return 1 / (1 + math.exp(-z)), said


def names(text: str, claimed: list[tuple[int, int]] = (), model: NameModel | None = None, uncased: frozenset[str] | None = None) -> list[Span]:
    """Names that are likely enough, and not part of a claimed span; ``uncased`` are names known in scripts without capitals.

    Without a given name (or a model's word), a title or a job's name, one word over and over, words that the text also has in small
    letters, and what ends like a street, are no name.
    """
    taken, out, small, emails = Claimed(claimed), [], None, Emails(text) if "@" in text else None
    for run in RUN.finditer(text):
        for tokens in _runs(run):
            score, said = _score(text, tokens, emails, model)
            start, end = tokens[0][0], tokens[-1][0] + len(tokens[-1][1])
            if score < LEAST_SCORE or taken.holds(start, end) or _in_blob(text, start, end):
                continue
            if len(tokens) == 1 and HEADING.fullmatch(tokens[0][1]):
                continue
            if not any(t in GIVEN for _, t in tokens) and "honorific" not in said:
                small = set(re.findall(rf"\b[^\W\d_{UPPER}]{LETTER}+", text)) if small is None else small
                if all(t.lower() in small for _, t in tokens) or len({t for _, t in tokens}) < len(tokens) or STREET_WORD.fullmatch(tokens[-1][1]):
                    continue
            out.append(Span(start, end, text[start:end], score, tuple(said)))
    if not text.isascii():
        found = Claimed([(s.start, s.end) for s in out])
        out += [s for s in uncased_names(text, UNCASED if uncased is None else uncased) if not found.touches(s.start, s.end) and not taken.holds(s.start, s.end)]
        out.sort(key=lambda s: s.start)
    return out


#: Common names in scripts without capitals, by which names there are found; a longer list is a parameter.
UNCASED = frozenset(
    "محمد أحمد علي فاطمة حسن حسين عمر خالد مريم يوسف דוד משה שרה יוסף רחל אברהם राम सीता राहुल प्रिया अमित सुनीता शर्मा वर्मा सिंह कुमार गुप्ता পটেল রহমান হাসান முருகன் குமார் 김민준 이서연 박지훈 최수빈"
    " 王伟 李娜 张伟 王芳 刘洋 陈静 佐藤 鈴木 高橋 田中 渡辺 山本 สมชาย สมหญิง ประเสริฐ".split()
)
#: Scripts with spaces between words (Arabic, Hebrew, Devanagari to Telugu, Hangul) and without (Thai, kana, Han).
SPACED = re.compile("[\u0590-\u05ff\u0600-\u06ff\u0900-\u0c7f\uac00-\ud7af\u1100-\u11ff\u200c\u200d]+")
DENSE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]+")
LONGEST_DENSE, LONGEST_RUN = 14, 80


def _told(text: str, start: int, end: int) -> list[str]:
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    if HONORIFIC.search(before):
        return ["honorific"]
    return ["introduced"] * bool(INTRODUCED.search(before) or ACTS.match(after) or JOB.match(after))


def uncased_names(text: str, known: frozenset[str]) -> list[Span]:
    """Known names in scripts without capitals.

    Between spaces a word that is one counts, and neighbours are one span.  Within a run without spaces the longest one at each place does, if
    what stands around speaks of a person.
    """
    out: list[Span] = []
    open_ = None
    for m in SPACED.finditer(text):
        if len(m[0]) < 2 or m[0] not in known:
            open_ = None
            continue
        if open_ is not None and not text[out[open_].end : m.start()].strip():
            first = out[open_]
            out[open_] = Span(first.start, m.end(), text[first.start : m.end()], 0.97, ("known name", *_told(text, first.start, m.end()), "full name"))
            continue
        told = _told(text, *m.span())
        open_ = len(out)
        out.append(Span(*m.span(), m[0], 0.95 if told else 0.88, ("known name", *told)))
    for m in DENSE.finditer(text):
        k, run = 0, m[0]
        while 2 <= len(run) <= LONGEST_RUN and k < len(run) - 1:
            size = next((n for n in range(min(LONGEST_DENSE, len(run) - k), 1, -1) if run[k : k + n] in known), 0)
            start = m.start() + k
            if size and (told := _told(text, start, start + size)):
                out.append(Span(start, start + size, run[k : k + size], 0.8, ("known name", *told)))
            k += size or 1
    return sorted(out, key=lambda s: s.start)


#: Words of streets and of parts of houses, and forms of post codes.
STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Place|Pl|Terrace|Way|Close|Crescent|Parade|Square|Sq|Highway|Hwy|Parkway|Pkwy|Circle|Cir|Trail|Marg|Nagar|Colony|Vihar|Puram|Layout|Cross|Main|Sector|Enclave|Extension|Chowk|Gali|Pura|Bagh|Garden|Gardens|Park|Estate|Township|Society|Complex|Heights|Residency|Apartments|Towers"
UNIT = "Flat|Apt|Apartment|Suite|Unit|Plot|House|Door|Room|Block|Tower|Wing|Floor|Shop|Villa|Bungalow"
HINT = re.compile(rf"(?i)\b(?:{STREET}|{UNIT})\b")
STREET_WORD, UNIT_WORD = re.compile(f"(?i)(?:{STREET})"), re.compile(f"(?i)(?:{UNIT}|No|PO)")
POSTCODES = [
    (re.compile("[1-9][0-9]{5}"), "PIN code"), (re.compile("[0-9]{5}(?:-[0-9]{4})?"), "ZIP code"), (re.compile("(?i)[A-Z]{1,2}[0-9][A-Z0-9]? ?[0-9][A-Z]{2}"), "postcode"),
    (re.compile("(?i)[A-Z][0-9][A-Z] ?[0-9][A-Z][0-9]"), "postal code"), (re.compile("[0-9]{4}"), "postcode"), (re.compile("[0-9]{5}-?[0-9]{3}"), "CEP"),
]
PART = re.compile(rf"{LETTER}(?:{LETTER}|['’-])*|[0-9][\w-]*")
#: Addresses of networks, dates, versions, and numbers at the end of names (those of placeholders too), which are none of houses or post codes.
PARTIAL = re.compile(r"[0-9]+(?:\.[0-9]+){2,}|(?<=_)[0-9]+")
DIGIT = re.compile("[0-9]")


def _capitalised(t: str) -> bool:
    return t[0].isupper() and any(c.islower() for c in t)


def _address(line: str) -> tuple[int, int, list[str]] | None:
    """(start, end, parts) of a line's address: streets, units, post codes after another part, house numbers."""
    partial = [m.span() for m in PARTIAL.finditer(line)]
    tokens = [(m.start(), m.end(), "" if m[0][0].isdigit() and any(a <= m.start() < b for a, b in partial) else m[0]) for m in PART.finditer(line)]
    parts, begin, stop = [], len(line), 0

    def take(what: str, *of: int) -> None:
        nonlocal begin, stop
        parts.append(what)
        begin, stop = min([begin, *(tokens[k][0] for k in of)]), max([stop, *(tokens[k][1] for k in of)])

    for k, (_, _, t) in enumerate(tokens):
        previous, following = tokens[k - 1][2] if k else "", tokens[k + 1][2] if k + 1 < len(tokens) else ""
        if STREET_WORD.fullmatch(t):
            if previous and (previous[0].isdigit() or _capitalised(previous)):
                take("street", k - 1, k)
            continue
        if UNIT_WORD.fullmatch(t) and following[:1].isdigit():
            take("unit", k, k + 1)
            continue
        code = next((label for form, label in POSTCODES if form.fullmatch(t)), None)
        if code and parts:
            take(code, k)
        if re.fullmatch("[0-9]{1,5}[A-Za-z]?", t) and following and (STREET_WORD.fullmatch(following) or _capitalised(following)):
            take("house number", k, k + 1)
    anchored = any(p in ("house number", "unit", "CEP") or p.endswith("code") for p in parts)
    return (begin, stop, parts) if len(parts) >= 2 and anchored else None


def addresses(text: str) -> list[Span]:
    """Addresses of lines of 8 to 300 characters with a digit and a word of streets or houses; the score is the number of parts."""
    out, at = [], 0
    if not DIGIT.search(text):
        return out
    for line in text.split("\n"):
        if 8 <= len(line) <= 300 and DIGIT.search(line) and HINT.search(line) and (found := _address(line)):
            begin, end, parts = found
            out.append(Span(at + begin, at + end, line[begin:end], float(len(parts)), tuple(dict.fromkeys(parts))))
        at += len(line) + 1
    return out
