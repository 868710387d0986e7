"""What a scan looks for, and what its findings lead to."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from siftwell.operators.namemodel import NameModel
from siftwell.operators.registry import RULES
from siftwell.operators.rule import SEVERITIES, Rule

#: Names of settings that are lists of severities, ids or words.
LISTS = ("block", "warn", "disabled", "allow", "codenames")
MANAGED_LISTS = ("required", "never_allow")
SWITCHES = ("decode", "injection", "prose", "tables")
MODES = ("off", "warn", "block")


@dataclass(frozen=True)
class Policy:
    """``most`` matches of a rule, ``total`` findings before the next rule, and ``longest`` characters read (seven tenths from the head, the
    rest from the tail) bound what one text may cost; without them, as by default, all is read and found.  What a bound leaves out is
    reported with the text.  ``name_model`` judges words by their letters, ``known_names`` are names in scripts without capitals.
    """

    block: frozenset[str] = frozenset({"critical"})
    warn: frozenset[str] = frozenset({"high", "medium"})
    disabled: frozenset[str] = frozenset()
    allow: frozenset[str] = frozenset()
    codenames: tuple[str, ...] = ()
    salt: str = ""
    mode: str = "warn"
    decode: bool = True
    injection: bool = True
    prose: bool = True
    tables: bool = True
    most: int | None = None
    total: int | None = None
    longest: int | None = None
    most_decoded: int | None = None
    name_model: NameModel | None = None
    known_names: frozenset[str] | None = None
    rules: tuple[Rule, ...] = field(default_factory=lambda: tuple(RULES))

    def active(self) -> list[Rule]:
        own = codename_rule(self.codenames)
        return [r for r in (*self.rules, *([own] if own else [])) if r.id not in self.disabled]

    def bounded(self) -> Policy:
        """With the bounds of an interactive check: 500 matches a rule, 2,000 findings, 2,000,000 characters, 200 decoded findings."""
        return replace(self, most=500, total=2000, longest=2_000_000, most_decoded=200)

    @classmethod
    def only(cls, *rules: Rule, **more) -> Policy:
        """A policy of a few pattern rules, without decoding, tables, names and signs of injection."""
        return cls(rules=rules, **{s: False for s in SWITCHES} | more)


def codename_rule(names: Iterable[str]) -> Rule | None:
    """An organisation's own words of 3 to 64 characters, whole and in any case; none, no rule."""
    words = [w for n in names if 3 <= len(w := str(n).strip()) <= 64]
    if not words:
        return None
    return Rule("org_codename", "context", "high", "certain", rf"(?i)\b(?:{'|'.join(map(re.escape, words))})\b", tuple(w.lower() for w in words), advisory=True)


def coerce(settings: Mapping) -> dict:
    """The settings that are known and well-formed: one word where a list is due is a list of one, and what has the wrong type is left out."""
    out: dict = {}
    for name in (*LISTS, *MANAGED_LISTS):
        value = settings.get(name)
        value = [value] if isinstance(value, str) else value
        if isinstance(value, list | tuple | set | frozenset):
            out[name] = tuple(v for v in value if isinstance(v, str) and v and (name not in ("block", "warn") or v in SEVERITIES))
    out |= {name: settings[name] for name in (*SWITCHES, "lock_allow", "lock_mode") if isinstance(settings.get(name), bool)}
    if isinstance(settings.get("salt"), str):
        out["salt"] = settings["salt"]
    if settings.get("mode") in MODES:
        out["mode"] = settings["mode"]
    return out


def merge(own: Mapping, managed: Mapping | None) -> Policy:
    """A person's settings under an organisation's.

    What either disables is disabled, but never what the organisation requires.  Allowed values of both count; with ``lock_allow`` only
    the organisation's; none of ``never_allow`` ever.  Codenames are the organisation's.  ``mode`` is the person's unless
    ``lock_mode`` is set.
    """
    mine, theirs = coerce(own), coerce(managed or {})
    disabled = {*mine.get("disabled", ()), *theirs.get("disabled", ())} - set(theirs.get("required", ()))
    allow = {*theirs.get("allow", ()), *(() if theirs.get("lock_allow") else mine.get("allow", ()))} - set(theirs.get("never_allow", ()))
    modes = [theirs.get("mode") if theirs.get("lock_mode") else None, mine.get("mode"), theirs.get("mode"), "warn"]
    rest = {k: frozenset(mine[k]) for k in ("block", "warn") if k in mine} | {k: mine[k] for k in (*SWITCHES, "salt") if k in mine}
    return Policy(disabled=frozenset(disabled), allow=frozenset(allow), codenames=tuple(theirs.get("codenames", ())), mode=next(filter(None, modes)), **rest)
