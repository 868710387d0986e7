"""A text that as a whole is a table: its shape, what its columns hold, and the cells of personal columns."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

DELIMITERS = {"\t": "tab-separated", ",": "comma-separated", "|": "pipe-separated", ";": "semicolon-separated"}
#: Smallest table, share of lines of one width, columns and values that are looked at to tell what a column holds.
LEAST_CHARS, LEAST_LINES, CONSISTENT, SAMPLE, AGREE = 40, 4, 0.7, 40, 0.6

#: Headers that say what a column holds.
HEADERS = [
    (re.compile(pattern, re.IGNORECASE), kind)
    for pattern, kind in (
        (r"e[-_ ]?mail|email[-_ ]?address|mail", "email"),
        (r"phone|mobile|cell|telephone|tel|contact[-_ ]?(?:no|number)|msisdn", "phone"),
        (r"ssn|social[-_ ]?security(?:[-_ ]?number)?", "ssn"),
        (r"aadhaar|aadhar|uid|uidai", "aadhaar"),
        (r"pan|pan[-_ ]?(?:no|number|card)", "pan"),
        (r"gstin|gst[-_ ]?(?:no|number)", "gstin"),
        (r"card|card[-_ ]?(?:no|number)|pan[-_ ]?number|cc[-_ ]?num", "card"),
        (r"iban|account[-_ ]?(?:no|number)|acct|bank[-_ ]?account", "account"),
        (r"dob|date[-_ ]?of[-_ ]?birth|birth[-_ ]?date|birthday", "dob"),
        (r"salary|ctc|compensation|pay|annual[-_ ]?pay|base[-_ ]?pay|wage", "salary"),
        (r"address|addr|street|address[-_ ]?line[-_ ]?1|residence", "address"),
        (r"passport|passport[-_ ]?(?:no|number)", "passport"),
        (r"password|passwd|pwd|secret|token|api[-_ ]?key", "secret"),
        (r"name|full[-_ ]?name|first[-_ ]?name|last[-_ ]?name|surname|customer[-_ ]?name|employee[-_ ]?name", "name"),
        (r"diagnosis|condition|icd|medication|prescription|treatment", "health"),
        (r"ip|ip[-_ ]?address|device[-_ ]?id|imei|mac", "device"),
    )
]
#: What kinds are called, the rule whose name a cell's finding has, and the kinds that detectors stand for.
LABELS = {
    "email": "Email address", "phone": "Phone number", "ssn": "National identity number", "aadhaar": "Aadhaar number", "pan": "PAN", "gstin": "GSTIN",
    "card": "Payment card", "account": "Bank or payment account", "dob": "Date of birth", "salary": "Compensation", "address": "Postal address",
    "passport": "Passport number", "secret": "Credential", "name": "Person name", "health": "Health information", "device": "Device identifier",
}
HEADER_LABELS = {**LABELS, "ssn": "Social Security number", "account": "Bank account"}
RULE_OF = {
    "email": "email", "phone": "phone_india", "ssn": "us_ssn", "aadhaar": "aadhaar", "pan": "pan_india", "gstin": "gstin", "card": "payment_card", "account": "iban",
    "passport": "indian_passport", "name": "person_name", "address": "postal_address", "dob": "date_of_birth", "salary": "compensation_data",
    "health": "health_information", "device": "imei", "secret": "high_entropy_assignment",
}
KIND_OF = {
    "email": "email", "phone_india": "phone", "us_ssn": "ssn", "aadhaar": "aadhaar", "pan_india": "pan", "gstin": "gstin", "payment_card": "card", "iban": "account",
    "brazil_cpf": "ssn", "canada_sin": "ssn", "uk_nino": "ssn", "upi_vpa": "account", "indian_passport": "passport", "imei": "device", "indian_dl": "passport",
}
IMPERSONAL = {"gstin", "secret"}
WORDY, NUMERIC = re.compile("[A-Za-z][A-Za-z0-9 _-]{0,40}"), re.compile("[0-9.,-]+")
PIPED, RULED = re.compile(r"\s*\|.*\|\s*"), re.compile(r"\s*\|[\s:|-]+\|\s*")


@dataclass(frozen=True)
class Column:
    index: int
    name: str | None
    kind: str | None
    label: str | None
    filled: int

    @property
    def personal(self) -> bool:
        return self.kind is not None and self.kind not in IMPERSONAL


@dataclass(frozen=True)
class Cell:
    start: int
    end: int
    value: str
    kind: str
    label: str


@dataclass(frozen=True)
class Table:
    rows: int
    cols: int
    layout: str
    has_header: bool
    columns: list[Column]
    cells: list[Cell]
    personal_values: int

    @property
    def severity(self) -> str:
        return "critical" if self.rows >= 100 else "high" if self.rows >= 20 else "medium"

    @property
    def kinds(self) -> list[str]:
        return [c.kind for c in self.columns if c.personal]

    @property
    def fully_redactable(self) -> bool:
        return len(self.cells) == self.personal_values

    def describe(self) -> str:
        names = list(dict.fromkeys(c.label.lower() for c in self.columns if c.personal))
        said = names[0] if len(names) == 1 else f"{', '.join(names[:-1])} and {names[-1]}"
        form = "a markdown table" if self.layout == "markdown table" else f"{self.layout} values"
        return f"{self.rows:,} {'records' if self.rows >= 20 else 'rows'} of personal data ({said}) as {form}"


def split(line: str, delimiter: str) -> list[tuple[int, str]]:
    """(place, text) of each cell; between commas, double quotes hold a cell together and are left out, doubled ones stand for one."""
    if delimiter != "," or '"' not in line:
        out, at = [], 0
        for part in line.split(delimiter):
            out.append((at, part))
            at += len(part) + 1
        return out
    out, begin, part, quoted, k = [], 0, [], False, 0
    while k < len(line):
        c = line[k]
        if c == '"' and quoted and line[k + 1 : k + 2] == '"':
            part.append(c)
            k += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append((begin, "".join(part)))
            begin, part = k + 1, []
        else:
            part.append(c)
        k += 1
    return [*out, (begin, "".join(part))]


def bare(cell: str) -> str:
    s = cell.strip()
    s = s[1:] if s[:1] in ('"', "'") else s
    return s[:-1] if s[-1:] in ('"', "'") else s


def _lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        if line.strip():
            yield at, line
        at += len(line) + 1


def _layout(lines: list[tuple[int, str]]) -> tuple[str, int] | None:
    """(delimiter, columns) of the most consistent reading; of equal ones the first."""
    best, found = 0.0, None
    for delimiter in DELIMITERS:
        if sum(delimiter in line for _, line in lines) < CONSISTENT * len(lines):
            continue
        widths = Counter(n for _, line in lines if (n := len(split(line, delimiter))) >= 2)
        if not widths:
            continue
        cols, rows = widths.most_common(1)[0]
        share = rows / len(lines)
        score = share * min(cols, 12) * math.log2(rows + 1)
        if share >= CONSISTENT and rows >= 3 and score > best:
            best, found = score, (delimiter, cols)
    return found


def _kind(header: str | None, values: list[str], probe: Callable[[str], list[str]]) -> tuple[str | None, str | None]:
    """(kind, label) by the header, or by what most of a sample of values are."""
    for pattern, kind in HEADERS if header else ():
        if pattern.fullmatch(header):
            return kind, HEADER_LABELS[kind]
    sample = values[:: max(1, len(values) // SAMPLE)][:SAMPLE]
    votes = Counter(KIND_OF[rule] for v in sample if v for rule in probe(v) if rule in KIND_OF)
    if votes:
        kind, n = votes.most_common(1)[0]
        if n >= max(2, int(AGREE * len(sample))):
            return kind, LABELS[kind]
    return None, None


def find_table(text: str, probe: Callable[[str], list[str]]) -> Table | None:
    """The table that the text is, if it has a personal column; ``probe`` names the rules that a value fits."""
    if len(text) < LEAST_CHARS:
        return None
    lines = list(_lines(text))
    if len(lines) < LEAST_LINES:
        return None
    markdown = sum(PIPED.fullmatch(line) is not None for _, line in lines) >= CONSISTENT * len(lines)
    if markdown:
        kept = [(at + len(line) - len(line.lstrip()), line.strip()) for at, line in lines if not RULED.fullmatch(line)]
        lines = [(at + line.startswith("|"), line.removeprefix("|").removesuffix("|")) for at, line in kept]
        if len(lines) < 3:
            return None
    layout = _layout(lines)
    if layout is None:
        return None
    delimiter, cols = layout
    rows = [(at, line, cells) for at, line in lines if len(cells := split(line, delimiter)) == cols]
    if len(rows) < 3:
        return None
    head = [bare(c) for _, c in rows[0][2]]
    has_header = sum(WORDY.fullmatch(c) is not None for c in head) >= math.ceil(0.6 * cols) and not any(NUMERIC.fullmatch(c) for c in head)
    body = rows[has_header:]
    if len(body) < 2:
        return None
    columns = []
    for k in range(cols):
        values = [bare(cells[k][1]) for _, _, cells in body]
        name = head[k] if has_header else None
        kind, label = _kind(name, values, probe)
        columns.append(Column(k, name or None, kind, label, sum(map(bool, values))))
    personal = [c for c in columns if c.personal]
    if not personal:
        return None
    found, n = [], 0
    for at, line, cells in body:
        for c in personal:
            place, raw = cells[c.index]
            value = bare(raw)
            if len(value) < 3:
                continue
            n += 1
            begin = line.find(value, place)
            if begin >= 0:
                found.append(Cell(at + begin, at + begin + len(value), value, c.kind, c.label))
    return Table(len(body), cols, "markdown table" if markdown else DELIMITERS[delimiter], has_header, columns, found, n)
