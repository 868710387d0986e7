"""Replacement of found values by placeholders or pseudonyms, and back."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from siftwell import prepare
from siftwell.operators.policy import Policy
from siftwell.operators.scan import dealt_out, pieces
from siftwell.operators.scanner import Scanner


class Value(NamedTuple):
    """A found value to replace, as a text's findings give it."""

    rule_id: str
    start: int
    end: int
    match: str


def placeholder(rule_id: str, n: int) -> str:
    return f"<{rule_id.upper()}_{n}>"


def letters(n: int) -> str:
    """1 is A, 26 Z, 27 AA."""
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(65 + k) + out
    return out


#: Stand-ins of the shape of what they replace that can be nobody's; what isn't here gets a placeholder.
PSEUDONYMS: dict[str, Callable[[int], str]] = {
    "person_name": lambda n: f"Person_{letters(n)}",
    "postal_address": lambda n: f"{7 * n + 10} Example Street, Placeholder City",
    "email": lambda n: f"person_{letters(n).lower()}@example.invalid",
    "phone_india": lambda n: f"+91 90000 {n:05d}",
}


def pseudonym(rule_id: str, n: int) -> str:
    return PSEUDONYMS[rule_id](n) if rule_id in PSEUDONYMS else placeholder(rule_id, n)


NAMERS = {"placeholder": placeholder, "pseudonym": pseudonym}


def replace_values(text: str, values: Iterable[Value], name: Callable[[str, int], str] = placeholder) -> tuple[str, dict[str, str]]:
    """(text with the values replaced, what each replacement stands for).

    In order of place; a value has one replacement wherever it stands, numbered within its rule.  What begins inside an earlier value, or
    after the end of the text, is passed over.
    """
    given: dict[str, str] = {}
    count: dict[str, int] = {}
    out, at = [], 0
    ordered = sorted(values, key=lambda v: v.start)
    for v in ordered:
        if v.match not in given:
            count[v.rule_id] = count.get(v.rule_id, 0) + 1
            given[v.match] = name(v.rule_id, count[v.rule_id])
    for v in ordered:
        if at <= v.start <= len(text):
            out += [text[at : v.start], given[v.match]]
            at = v.end
    return "".join([*out, text[at:]]), {token: value for value, token in given.items()}


def restore(text: str, table: Mapping[str, str]) -> str:
    """Values back where their replacements stand, longer replacements first."""
    for token in sorted(table, key=len, reverse=True):
        text = text.replace(token, table[token])
    return text


def visible_only(values: Iterable[Value], length: int) -> list[Value]:
    """Values within the part of a text that its reader sees."""
    return [v for v in values if v.end <= length]


REDACTED = "redacted string, changed int, replacements array<struct<token: string,rule_id: string>>, reversal map<string,string>"


def redact(df: DataFrame, text_col: str = "text", policy: Policy | None = None, style: str = "placeholder", reversible: bool = False) -> DataFrame:
    """Adds ``redacted``, ``changed`` (values replaced) and ``replacements``; with ``reversible`` also ``reversal``, which holds the values themselves.

    Advisory findings stay, as they are what a text is about.  Null stays null.
    """
    policy, name = policy or Policy(), NAMERS[style]
    added = T._parse_datatype_string(REDACTED if reversible else REDACTED.rsplit(", reversal", 1)[0])
    kept = df.drop(*added.names)
    schema = T.StructType([*kept.schema.fields, *added.fields])
    arrow, width = to_arrow_schema(schema), len(kept.columns)

    def one(scanner: Scanner, text: str | None) -> tuple:
        found = [Value(f.rule.id, f.start, f.end, f.match) for f in scanner.scan(text).findings if not f.rule.advisory]
        out, table = replace_values(text, found, name) if found else (text, {})
        rule = {f.match: f.rule_id for f in reversed(sorted(found, key=lambda v: v.start))}
        return (out, len(found), [{"token": t, "rule_id": rule[v]} for t, v in table.items()], list(table.items()))[: len(added)]

    def run(batches):
        scanner = Scanner(policy)
        for b in pieces(batches, text_col):
            rows = [one(scanner, t) for t in b.column(text_col).to_pylist()]
            new = [pa.array(list(c), arrow.field(width + k).type) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], schema=arrow)

    prepare(df.sparkSession)
    return dealt_out(kept).mapInArrow(run, schema)


def restored(df: DataFrame, text_col: str = "redacted", table_col: str = "reversal") -> DataFrame:
    """Adds ``restored``: the text with its values back."""
    schema = T.StructType([*df.schema.fields, T.StructField("restored", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            texts, tables = b.column(text_col).to_pylist(), b.column(table_col).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t if t is None else restore(t, dict(m or {})) for t, m in zip(texts, tables, strict=True)], pa.string())], schema=arrow)

    return df.mapInArrow(run, schema)


def unsafe(df: DataFrame, text_col: str = "redacted", policy: Policy | None = None) -> DataFrame:
    """Rows whose text is not free to go: scanned again, something in it that isn't advisory would still block."""
    from pyspark.sql import functions as F

    from siftwell.operators.scan import scan

    policy = policy or Policy()
    grave = F.exists("findings", lambda f: ~f["advisory"] & f["severity"].isin(*sorted(policy.block)))
    return scan(df, text_col, policy).where(grave).select(*df.columns)
