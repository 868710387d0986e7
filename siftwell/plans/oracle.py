"""The same detections in DuckDB's SQL, written on their own for comparison."""

from __future__ import annotations

from siftwell.operators.registry import BY_ID, Rule
from siftwell.plans.carriers import body_sql, carrier_sql, prefix_length

DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"


def _list(c: str) -> str:
    return f"list_transform(string_split({DIGITS.format(c)}, ''), lambda x: CAST(x AS INT))"


def luhn(c: str, lengths: str = "BETWEEN 12 AND 19") -> str:
    d = DIGITS.format(c)
    return f"(length({d}) {lengths} AND list_sum(list_transform(string_split(reverse({d}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0)"


def issuer(c: str) -> str:
    """Whether a network issues such numbers, by the published ranges of prefixes for each length."""
    d = DIGITS.format(c)
    head = lambda n: f"CAST(left({d}, {n}) AS INT)"
    short = f"""CASE length({d}) WHEN 13 THEN {head(1)} = 4 WHEN 14 THEN {head(3)} BETWEEN 300 AND 305 OR {head(4)} = 3095 OR {head(2)} IN (36, 38, 39) WHEN 15 THEN {head(2)} IN (34, 37)"""
    ranges = [(1, 4, 4), (2, 51, 55), (4, 2221, 2720), (4, 6011, 6011), (2, 65, 65), (3, 644, 649), (6, 622126, 622925), (4, 3528, 3589), (3, 508, 508), (2, 60, 60), (2, 81, 82), (2, 62, 62), (2, 50, 50), (2, 56, 69)]
    return f"({short} ELSE length({d}) BETWEEN 16 AND 19 AND ({' OR '.join(f'{head(n)} BETWEEN {x} AND {y}' for n, x, y in ranges)}) END)"


def weighted(c: str, weights: list[int]) -> str:
    return f"list_sum(list_transform({_list(c)}[1:{len(weights)}], lambda x, i: x * {weights}[i]))"


def cpf(c: str) -> str:
    check = lambda n: f"CAST(substr(CAST({weighted(c, list(range(n + 1, 1, -1)))} * 10 % 11 AS VARCHAR), -1) AS INT) = CAST(substr({DIGITS.format(c)}, {n + 1}, 1) AS INT)"
    return f"(length({DIGITS.format(c)}) = 11 AND len(list_distinct({_list(c)})) > 1 AND {check(9)} AND {check(10)})"


def verhoeff(c: str) -> str:
    from siftwell.functions.text import VERHOEFF_D, VERHOEFF_P

    step = f"list_transform(string_split(reverse({DIGITS.format(c)}), ''), lambda x, i: {VERHOEFF_P}[CAST((i - 1) % 8 AS INT) + 1][CAST(x AS INT) + 1])"
    return f"(list_reduce(list_prepend(0, {step}), lambda a, x: {VERHOEFF_D}[a + 1][x + 1]) = 0)"


def cnpj(c: str) -> str:
    d, tail = DIGITS.format(c), [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    check = lambda w, at: f"(CASE WHEN {weighted(c, w)} % 11 < 2 THEN 0 ELSE 11 - {weighted(c, w)} % 11 END) = CAST(substr({d}, {at}, 1) AS INT)"
    return f"(len(list_distinct({_list(c)})) > 1 AND {check(tail, 13)} AND {check([6, *tail], 14)})"


#: A number's neighbours: neither digits nor a decimal point with digits.
WHOLE = "NOT regexp_matches(substr(whole, greatest(p - 4, 0) + 1, least(p, 4)), '[0-9][ .-]?$') AND NOT regexp_matches(substr(whole, p + length(m) + 1, 4), '^(?:[ -]?[0-9]|[.][0-9])')"
VALID = {
    "canada_sin": lambda c: f"({luhn(c, '= 9')} AND left({c}, 1) NOT IN ('0', '8'))",
    "imei": lambda c: f"({luhn(c, '= 15')} AND len(list_distinct({_list(c)})) > 1)",
    "payment_card": lambda c: f"{luhn(c)} AND {issuer(c)} AND {WHOLE}",
    "australia_abn": lambda c: f"(({weighted(c, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0)",
    "australia_tfn": lambda c: f"({weighted(c, [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0)",
}


def mask(c: str) -> str:
    keep = f"CASE WHEN length({c}) > 24 THEN 6 ELSE 3 END"
    return f"CASE WHEN length({c}) <= 8 THEN repeat('*', length({c})) ELSE concat(substr({c}, 1, {keep}), repeat('*', least(length({c}) - 2 * ({keep}), 12)), right({c}, {keep})) END"


def fingerprint(c: str) -> str:
    return f"substr(sha256(concat(chr(0), {c})), 1, 32)"


def quoted(pattern: str) -> str:
    """A pattern inside an SQL string."""
    return pattern.replace("'", "''")


def matches(rule: Rule, source: str, key: str, text: str = "text") -> str:
    """SELECT of key, rule_id, severity, confidence, start, match of one rule."""
    pattern = quoted(rule.pattern)
    tests = ["m <> ''", *([VALID[rule.id]("m")] if rule.id in VALID else []), *([f"NOT regexp_matches(m, '{quoted(rule.refuse)}')"] if rule.refuse else [])]
    return f"""SELECT {key}, '{rule.id}' AS rule_id, '{rule.severity}' AS severity, '{rule.confidence}' AS confidence, p::INT AS start, m AS "match"
      FROM (SELECT {key}, whole, f AS m, s::BIGINT AS p FROM (
        SELECT {key}, whole, unnest(fs) AS f, unnest(list_transform(range(1, len(fs) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(fs[1:i - 1], lambda g: length(g))), 0))) AS s
        FROM (SELECT {key}, {text} AS whole, regexp_extract_all({text}, '{pattern}') AS fs, string_split_regex({text}, '{pattern}') AS gs FROM {source})))
      WHERE {" AND ".join(tests)}"""


def preview(rule_id: str) -> str:
    return 'substr("match", 1, 64)' if BY_ID[rule_id].advisory else mask(chr(34) + "match" + chr(34))


#: What is to be found in the carriers, said without the rules' patterns.  A value is the whole sample but for the characters before and
#: after it; with its last character replaced it still counts where that digit is one of these (a check digit, or any), and with its head
#: cut off it counts only for the rules that say so.
ANY = "0123456789"
BESIDE = {
    "bearer_header": (22, 0), "aws_secret_access_key": (8, 0), "high_entropy_assignment": (8, 0), "unlabelled_secret": (9, 1), "cloudflare_token": (0, 11), "okta_token": (0, 5), "indian_passport": (9, 0),
    "voter_id": (11, 0), "phone_india": (7, 0), "canada_sin": (4, 0), "australia_abn": (4, 0), "australia_tfn": (4, 0), "imei": (5, 0), "credential_in_prose": (12, 0), "financial_disclosure": (0, 8),
    "compensation_data": (0, 8), "health_information": (0, 4), "unannounced_transaction": (0, 9), "internal_pricing": (0, 3),
}
LAST_DIGIT = {
    "aws_access_key_id": "234567", "payment_card": "1", "iban": "2", "brazil_cpf": "5", "eu_vat": "6", "isin": "5", "aadhaar": "4", "canada_sin": "4", "brazil_cnpj": "1", "australia_abn": "6",
    "australia_tfn": "2", "imei": "8",
}
ENDS_IN_WORDS = """
google_oauth_client private_key_block unlabelled_secret email pan_india gcp_service_account cloudflare_token okta_token gstin upi_vpa uk_nino classification_marking legal_privilege deal_material mnpi
unreleased_information security_incident negotiation_position trade_secret workforce_action legal_hold customer_list
""".split()
CUT = {"google_oauth_client": 0, "email": 0, "upi_vpa": 0, "unlabelled_secret": 7}
#: The padding of this key is its last character; a digit there is not part of it.
PADDED = ("azure_storage_key",)
LAST = "CAST(c_custkey % 10 AS STRING)"
PROSE = {
    "person_name": [("c_custkey % 3 < 2", 4, "'Priya Nair'"), ("c_custkey % 3 = 2", 2, "'Priya Nair'")],
    "postal_address": [("c_custkey % 3 = 0", 1, "'221 Baker Street, Flat 4'"), ("c_custkey % 3 = 1", 1, f"concat('221 Baker Street, Flat 4', {LAST})"), ("c_custkey % 3 = 2", 0, "'21 Baker Street, Flat 4'")],
}


def expected(rule: Rule) -> list[tuple[str, int, str]]:
    """(which customers, characters before the value, value) of a rule's carriers."""
    before, after = BESIDE.get(rule.id, (0, 0))
    part = lambda a, b: f"substr({body_sql(rule)}, {a + 1}, CAST(length({body_sql(rule)}) - {a + b} AS INT))"
    out = [("c_custkey % 3 = 0", before, part(before, after))]
    if last := LAST_DIGIT.get(rule.id, "" if rule.id in ENDS_IN_WORDS else ANY):
        out.append((f"c_custkey % 3 = 1 AND {LAST} IN ({', '.join(map(repr, last))})", before, part(before, after + (rule.id in PADDED))))
    if rule.id in CUT:
        out.append(("c_custkey % 3 = 2", CUT[rule.id], part(CUT[rule.id], after)))
    return out


def rule_sql(rule: Rule) -> str:
    columns = f'c_custkey, start, "match", {preview(rule.id)} AS preview, {fingerprint(chr(34) + "match" + chr(34))} AS fingerprint'
    if rule.id == "prompt_injection":
        return f"""SELECT c_custkey, 0::INT AS start, left({carrier_sql(rule)}, 64) AS "match", 'override' AS preview, {fingerprint("'override'")} AS fingerprint FROM customer"""
    rows = " UNION ALL ".join(f'SELECT c_custkey, ({prefix_length()} + {at})::INT AS start, {value} AS "match" FROM customer WHERE {where}' for where, at, value in PROSE.get(rule.id) or expected(rule))
    return f"SELECT {columns} FROM ({rows})"


#: What the documents hold, said here on its own.
IN_DOCUMENTS = [
    Rule("email", "global", "low", "certain", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", refuse="(?i)@(?:example|test|localhost|invalid|domain|email|yourcompany|acme)[.](?:com|org|net|co)$"),
    Rule("payment_card", "global", "critical", "certain", r"\b(?:[0-9][ -]?){12,18}[0-9]\b"),
]


def found_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return " UNION ALL ".join(matches(r, source, key, text) for r in IN_DOCUMENTS)
