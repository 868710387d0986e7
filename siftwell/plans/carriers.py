"""Texts that carry a detector's sample, made by the same SQL on either engine from the customers' keys."""

from __future__ import annotations

import re

from siftwell.operators.registry import Rule


def sample_sql(sample: str) -> str:
    """SQL for a sample; {hN} stands for N hexadecimal digits derived from the key."""
    parts = []
    for piece in re.split(r"(\{h\d+\})", sample):
        if m := re.fullmatch(r"\{h(\d+)\}", piece):
            n = int(m[1])
            parts.append("substr(concat(" + ", ".join(f"md5(concat(CAST(c_custkey AS STRING), '{k}'))" for k in range(-(-n // 32))) + f"), 1, {n})")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return f"concat({', '.join(parts)})"


def body_sql(rule: Rule) -> str:
    """Of three customers one has the sample, one the sample with its last character replaced by the key's last digit, one with its head cut off."""
    s = sample_sql(rule.sample)
    return f"CASE c_custkey % 3 WHEN 0 THEN {s} WHEN 1 THEN concat(substr({s}, 1, CAST(length({s}) - 1 AS INT)), CAST(c_custkey % 10 AS STRING)) ELSE substr({s}, 3) END"


def carrier_sql(rule: Rule) -> str:
    return f"concat('note for ', c_name, ': ', {body_sql(rule)}, ' (end)')"


def prefix_length() -> str:
    """Characters before what is carried."""
    return "length(concat('note for ', c_name, ': '))"


#: Exports of 5, 25 and 220 customers of each 250, so that none grows with the table; header and row as SQL that both engines read.
EXPORT_ID = "CAST(floor(c_custkey / 250) AS BIGINT) * 3 + CASE WHEN c_custkey % 250 < 5 THEN 0 WHEN c_custkey % 250 < 30 THEN 1 ELSE 2 END"
EXPORT = "customer_id,full_name,email,balance"
EXPORT_ROW = "concat(CAST(c_custkey AS STRING), ',', c_name, ',u', CAST(c_custkey AS STRING), '@mail.org,', CAST(c_custkey * 7 AS STRING))"
#: Files of 100 customers.
FILE_ID = "CAST(floor(c_custkey / 100) AS BIGINT)"
