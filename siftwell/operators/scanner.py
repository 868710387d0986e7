"""Inspection of one text: which rules may match, what they find, what hides in encodings, tables and prose, and what of it counts."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace


from siftwell.operators import encoded, injection, prose, tables
from siftwell.operators.policy import Policy
from siftwell.operators.rule import CONFIDENCES, SEVERITIES, Place, Rule

#: Share of a bounded text that is read from its head, and the line feeds put between head and tail.
HEAD, SEAM = 0.7, "\n" * 8
#: Width of the stretches of text by which kept findings are looked up; longest cell that is compared with the rules.
STRETCH, LONGEST_CELL = 64, 400
TOUCHES = ("critical", "high")


@dataclass(slots=True)
class Finding:
    rule: Rule
    start: int
    end: int
    match: str
    severity: str
    confidence: str
    note: str | None = None
    label: str | None = None
    how: str | None = None
    value: str | None = None  # what was decoded from ``match``
    line: int = 0

    def rank(self) -> tuple:
        return SEVERITIES.index(self.severity), CONFIDENCES.index(self.confidence), self.start - self.end, self.start


@dataclass(slots=True)
class Result:
    findings: list[Finding]
    verdict: str
    table: tables.Table | None
    errors: list[tuple[str, str, str]]
    capped: list[str]
    skipped: int


class Compiled:
    """A rule with its patterns compiled."""

    def __init__(self, rule: Rule):
        ready = lambda p: re.compile(p, re.ASCII) if p else None
        self.rule, self.pattern, self.shapes = rule, re.compile(rule.pattern, re.ASCII), [(s, ready(s)) for s in rule.shape]
        self.refuse, self.near_if, self.never_if = ready(rule.refuse), ready(rule.near_if), ready(rule.never_if)
        self.near = [(n, ready(n.pattern)) for n in rule.near]
        self.never = (rule.never, ready(rule.never.pattern)) if rule.never else None

    def may_match(self, text: str, literals: set[str], shapes: dict[str, bool]) -> bool:
        if self.rule.literals and literals.isdisjoint(self.rule.literals):
            return False
        for key, shape in self.shapes:
            if key not in shapes:
                shapes[key] = shape.search(text) is not None
            if not shapes[key]:
                return False
        return True

    def counts(self, value: str, at: Place) -> bool:
        """Whether a value that the pattern found is one."""
        around = lambda n, p: p.search(at.text[max(0, at.start - n.before) : at.start + n.after]) is not None
        if self.refuse and self.refuse.search(value):
            return False
        if self.near and not (self.near_if and not self.near_if.search(value)) and not any(around(n, p) for n, p in self.near):
            return False
        if self.never and (self.never_if is None or self.never_if.search(value)) and around(*self.never):
            return False
        return self.rule.check is None or self.rule.check(value, at)

    def values(self, text: str) -> Iterator[tuple[str, Place]]:
        group = self.rule.group
        for m in self.pattern.finditer(text):
            value = m[group]
            if value:
                start = m.start() + m[0].index(value)
                yield value, Place(text, start, start + len(value), m[0])


class Literals:
    """Which of the rules' literals a text holds: all longer ones in one pass if the automaton's library is there, else each by itself."""

    def __init__(self, literals: set[str]):
        self.each, self.automaton = sorted(literals), None
        try:
            import ahocorasick
        except ImportError:
            return
        long = [x for x in literals if len(x) > 2]
        if long:
            self.each, self.automaton = sorted(x for x in literals if len(x) <= 2), ahocorasick.Automaton()
            for x in long:
                self.automaton.add_word(x, x)
            self.automaton.make_automaton()

    def held(self, low: str) -> set[str]:
        return {x for x in self.each if x in low} | ({x for _, x in self.automaton.iter(low)} if self.automaton else set())


def resolve(found: list[Finding]) -> list[Finding]:
    """Gravest, surest, longest, earliest first; what touches a kept one goes; the rest by place."""
    kept: list[Finding] = []
    by_place: dict[int, list[Finding]] = {}
    for f in sorted(found, key=Finding.rank):
        stretches = range(f.start // STRETCH, (f.end - 1) // STRETCH + 1)
        if not any(f.start < k.end and k.start < f.end for s in stretches for k in by_place.get(s, ())):
            kept.append(f)
            for s in stretches:
                by_place.setdefault(s, []).append(f)
    return sorted(kept, key=lambda f: f.start)


class Scanner:
    """All that a policy looks for, ready to be applied to text after text."""

    def __init__(self, policy: Policy | None = None):
        self.policy = policy = policy or Policy()
        active = policy.active()
        self.compiled = [Compiled(r) for r in active if not r.synthetic]
        self.literals = Literals({x for c in self.compiled for x in c.rule.literals})
        self.cell_rules = [c for c in self.compiled if not c.rule.advisory and c.rule.id != "org_codename"]
        self.synthetic = {r.id: r for r in active if r.synthetic}
        self.by_id = {r.id: r for r in policy.rules}
        self.inner: Scanner | None = None

    def scan(self, text: str | None) -> Result:
        if not text:
            return Result([], "clean", None, [], [], 0)
        whole, joined = text, self.policy.longest is not None and len(text) > self.policy.longest
        if joined:
            head, tail = int(self.policy.longest * HEAD), self.policy.longest - int(self.policy.longest * HEAD)
            text = whole[:head] + SEAM + whole[len(whole) - tail :]
        errors: list[tuple[str, str, str]] = []
        capped: list[str] = []
        low = text.lower()
        raw = self._patterns(text, low, errors, capped)
        raw += self._guarded("prompt_injection", "detect", errors, lambda: self._injection(text, low))
        raw += self._guarded("ner", "detect", errors, lambda: self._prose(text, raw, capped))
        found = resolve(raw) + (self._guarded("decode", "detect", errors, lambda: self._decoded(text, capped)) if self.policy.decode else [])
        table = None
        if self.policy.tables:
            got = self._guarded("table", "detect", errors, lambda: [tables.find_table(text, self._probe)])
            table = got[0] if got else None
        if joined:
            found = [moved for f in found if (moved := self._back(f, head, len(whole) - tail - head - len(SEAM)))]
            text = whole
        if table and not joined:
            found += self._cell_findings(table, found)
        found.sort(key=lambda f: f.start)
        feeds = [m.start() for m in re.finditer("\n", text)] if found else []
        for f in found:
            f.line = bisect.bisect_left(feeds, f.start) + 1
        return Result(found, self._verdict(found, table), table, errors, capped, len(whole) - self.policy.longest if joined else 0)

    def _guarded(self, who: str, stage: str, errors: list, call) -> list:
        """What the call gives; if it fails, nothing, and the error is noted: one detector's fault is not the scan's."""
        try:
            return call()
        except Exception as e:
            errors.append((who, stage, f"{type(e).__name__}: {e}"))
            return []

    def _patterns(self, text: str, low: str, errors: list, capped: list[str]) -> list[Finding]:
        raw: list[Finding] = []
        shapes: dict[str, bool] = {}
        literals = self.literals.held(low)
        for c in self.compiled:
            if not c.may_match(text, literals, shapes):
                continue
            if self.policy.total is not None and len(raw) >= self.policy.total:
                capped.append(c.rule.id)
                continue
            raw += self._guarded(c.rule.id, "match", errors, lambda c=c: self._matches(c, text, errors, capped))
        return raw

    def _matches(self, c: Compiled, text: str, errors: list, capped: list[str]) -> list[Finding]:
        out = []
        for n, (value, at) in enumerate(c.values(text)):
            if self.policy.most is not None and n >= self.policy.most:
                capped.append(c.rule.id)
                break
            if value in self.policy.allow:
                continue
            try:
                if not c.counts(value, at):
                    continue
                more = c.rule.enrich(value, at) if c.rule.enrich else {}
            except Exception as e:
                errors.append((c.rule.id, "validate", f"{type(e).__name__}: {e}"))
                continue
            out.append(Finding(c.rule, at.start, at.end, value, more.get("severity", c.rule.severity), more.get("confidence", c.rule.confidence), more.get("note")))
        return out

    def _injection(self, text: str, low: str) -> list[Finding]:
        rule = self.synthetic.get("prompt_injection")
        signs = injection.injection(text, low) if rule and self.policy.injection else []
        return [Finding(rule, 0, min(len(text), 64), text[:64], rule.severity, rule.confidence, ", ".join(signs), value=",".join(signs))] if signs else []

    def _prose(self, text: str, raw: list[Finding], capped: list[str]) -> list[Finding]:
        name, address = self.synthetic.get("person_name"), self.synthetic.get("postal_address")
        if not (self.policy.prose and name and address):
            return []
        places = prose.addresses(text)
        out = [Finding(address, a.start, a.end, a.text, address.severity, "likely" if a.score >= 3 else "possible", ", ".join(a.evidence)) for a in places]
        claimed = [(f.start, f.end) for f in raw] + [(a.start, a.end) for a in places]
        out += [Finding(name, n.start, n.end, n.text, name.severity, "likely" if n.score >= 0.95 else "possible", ", ".join(n.evidence) or None) for n in prose.names(text, claimed, self.policy.name_model, self.policy.known_names)]
        room = None if self.policy.total is None else max(0, self.policy.total - len(raw))
        if room is not None and len(out) > room:
            capped.append("ner")
        return [f for f in out[:room] if f.match not in self.policy.allow]

    def _decoded(self, text: str, capped: list[str]) -> list[Finding]:
        """Grave findings in decoded runs, at the run's place."""
        if self.inner is None:
            self.inner = Scanner(replace(self.policy, decode=False, tables=False, prose=False))
        out: list[Finding] = []
        for run in encoded.decoded_runs(text):
            for f in self.inner.scan(run.text).findings:
                if f.rule.advisory or f.severity not in TOUCHES:
                    continue
                if self.policy.most_decoded is not None and len(out) >= self.policy.most_decoded:
                    capped.append("decode")
                    return out
                how = f"{run.how}, {run.depth + 1} layers" if run.depth else run.how
                out.append(replace(f, start=run.start, end=run.end, match=text[run.start : run.end], how=how, value=f.match))
        return out

    def _probe(self, cell: str) -> list[str]:
        """Ids of the rules that a table's cell fits."""
        if not cell or len(cell) > LONGEST_CELL:
            return []
        out, low = [], cell.lower()
        for c in self.cell_rules:
            if c.rule.literals and not any(x in low for x in c.rule.literals):
                continue
            first = next(c.values(cell), None)
            if first and first[0] not in self.policy.allow and c.counts(*first):
                out.append(c.rule.id)
        return out

    def _cell_findings(self, table: tables.Table, found: list[Finding]) -> list[Finding]:
        """Cells of personal columns that touch no other finding."""
        claimed = sorted((f.start, f.end) for f in found)
        starts = [a for a, _ in claimed]
        severity, out = "high" if table.severity == "critical" else "medium", []
        for cell in table.cells:
            k = bisect.bisect_left(starts, cell.start)
            if not (k < len(claimed) and claimed[k][0] < cell.end or k and claimed[k - 1][1] > cell.start) and cell.value not in self.policy.allow:
                id_ = tables.RULE_OF[cell.kind]
                rule = self.by_id.get(id_) or Rule(id_, "global", severity, "likely")
                # A column says what its values are, whatever the rule itself is for.
                out.append(Finding(replace(rule, advisory=False), cell.start, cell.end, cell.value, severity, "likely", label=cell.label))
        return out

    @staticmethod
    def _back(f: Finding, seam: int, shift: int) -> Finding | None:
        """A finding of the joined head and tail at its place in the whole text; none if it touches the seam."""
        if f.end <= seam:
            return f
        return replace(f, start=f.start + shift, end=f.end + shift) if f.start >= seam + len(SEAM) else None

    def _verdict(self, found: list[Finding], table: tables.Table | None) -> str:
        grades = {f.severity for f in found} | ({table.severity} if table else set())
        return "block" if grades & self.policy.block else "warn" if grades & self.policy.warn else "clean"


