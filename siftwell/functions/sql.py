"""Functions for SQL: scans of a text, checks of a value; and rules of one's own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwell import prepare
from siftwell.functions import checks
from siftwell.operators import registry
from siftwell.operators.policy import Policy
from siftwell.operators.rule import CONFIDENCES, SEVERITIES, Rule
from siftwell.operators.scan import FINDING, row_of
from siftwell.operators.scanner import Compiled, Scanner


def register_rule(rule: Rule) -> Rule:
    """Add a rule, or replace that of the same id, for policies made from now on."""
    if rule.severity not in SEVERITIES or rule.confidence not in CONFIDENCES:
        raise ValueError("a rule's severity and confidence are from the known lists")
    Compiled(rule)
    registry.RULES[:] = [r for r in registry.RULES if r.id != rule.id] + [rule]
    registry.BY_ID[rule.id] = rule
    return rule


def register(spark: SparkSession, policy: Policy | None = None) -> None:
    """Make ``scan_verdict(text)``, ``redact_text(text)``, ``mask_value(text)``, ``value_fingerprint(text)``, the checks, and the table function ``scan_findings(text)`` known to SQL."""
    chosen = policy or Policy()
    prepare(spark)

    @F.pandas_udf("string")
    def scan_verdict(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(chosen)
        for t in texts:
            yield t.map(lambda x: scanner.scan(x).verdict)

    @F.pandas_udf("string")
    def redact_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from siftwell.operators.redaction import Value, replace_values

        scanner = Scanner(chosen)
        for t in texts:
            yield t.map(lambda x: x if x is None else replace_values(x, [Value(f.rule.id, f.start, f.end, f.match) for f in scanner.scan(x).findings if not f.rule.advisory])[0])

    class ScanFindings:
        def __init__(self):
            self.scanner = Scanner(chosen)

        def eval(self, text: str):
            for f in self.scanner.scan(text).findings:
                yield tuple(row_of(f, chosen.salt).values())

    spark.udf.register("scan_verdict", scan_verdict)
    spark.udf.register("redact_text", redact_text)
    spark.udtf.register("scan_findings", F.udtf(ScanFindings, returnType=FINDING))
    for name, check in {"is_luhn": checks.luhn, "is_aadhaar": checks.aadhaar, "is_isin": checks.isin, "is_eu_vat": checks.eu_vat}.items():
        spark.udf.register(name, F.pandas_udf(lambda s, check=check: s.map(lambda v: None if v is None else check(v)), "boolean"))
    for name, change in {"mask_value": checks.mask, "value_fingerprint": checks.fingerprint}.items():
        spark.udf.register(name, F.pandas_udf(lambda s, change=change: s.map(lambda v: None if v is None else change(v)), "string"))
