"""What a detector is."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

SEVERITIES, CONFIDENCES = ["critical", "high", "medium", "low"], ["certain", "likely", "possible"]


class Place(NamedTuple):
    """Where a value was found: the whole text, the value's offsets, and all that the pattern took."""

    text: str
    start: int
    end: int
    full: str

    def before(self, n: int) -> str:
        return self.text[max(0, self.start - n) : self.start]

    def after(self, n: int) -> str:
        return self.text[self.end : self.end + n]


#: Shapes that several rules share: nine digits with one sign at most between two, two capitals, capitals or digits, a long run.
NINE_DIGITS, CAPITALS, LONG_RUN = "[0-9](?:[ ./-]?[0-9]){8}", "[A-Z]{2}", "[A-Za-z0-9+/=_-]{32}"


@dataclass(frozen=True)
class Near:
    """``pattern`` is found in the text from ``before`` characters ahead of a match's start to ``after`` behind it."""

    pattern: str
    before: int
    after: int


@dataclass(frozen=True)
class Rule:
    """``pattern`` is Python's, with ASCII classes; ``group`` holds the value.  A text is searched only if it holds one of ``literals``
    (lower case) and a match of each ``shape``, cheap patterns that every value fits; rules share them, so that each is tried once a text.

    A value like ``refuse`` goes.  One like ``near_if`` needs one of ``near``; one like ``never_if`` must not have ``never`` around it.
    ``check`` has the last word; ``enrich`` gives a note, and a severity or confidence of its own.  A ``synthetic`` rule's findings are
    made by code of its own.
    """

    id: str
    category: str
    severity: str
    confidence: str
    pattern: str = ""
    literals: tuple[str, ...] = ()
    group: int = 0
    check: Callable[[str, Place], bool] | None = None
    enrich: Callable[[str, Place], dict] | None = None
    advisory: bool = False
    synthetic: bool = False
    shape: tuple[str, ...] = ()
    sample: str = ""
    refuse: str = ""
    near_if: str = ""
    near: tuple[Near, ...] = ()
    never_if: str = ""
    never: Near | None = None

    @property
    def tier(self) -> str:
        if self.advisory:
            return "context"
        return "personal" if self.id in PERSONAL else "dangerous"

    @property
    def label(self) -> str:
        return self.id.replace("_", " ").capitalize()


#: Identifiers of persons and businesses that are not dangerous by themselves.
PERSONAL = {"gstin", "ifsc", "upi_vpa", "voter_id", "indian_dl", "phone_india", "brazil_cnpj", "australia_abn", "eu_vat", "isin", "imei", "email", "person_name", "postal_address"}
