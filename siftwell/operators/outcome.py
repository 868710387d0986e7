"""What findings lead to: exposure score, regulations, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = {"critical": 34.0, "high": 18.0, "medium": 8.0, "low": 2.0}
TRUST = {"certain": 1.0, "likely": 0.85, "possible": 0.6}

#: Regulations by rule, and the place in each; rules that are not in yet included.
REGIMES = [
    ("email", "GDPR", "Art. 4(1)"), ("email", "DPDP", "S. 2(t)"),
    ("phone_india", "GDPR", "Art. 4(1)"), ("phone_india", "DPDP", "S. 2(t)"),
    ("aadhaar", "DPDP", "S. 2(t) + Aadhaar Act S. 29"), ("aadhaar", "GDPR", "Art. 87"),
    ("pan_india", "DPDP", "S. 2(t)"), ("pan_india", "Income Tax Act", "S. 139A"),
    ("gstin", "GST Act", "S. 25"),
    ("us_ssn", "US state breach laws", "e.g. CA Civ. Code 1798.82"), ("us_ssn", "GLBA", "Safeguards Rule"),
    ("uk_nino", "GDPR", "Art. 87"),
    ("canada_sin", "PIPEDA", "Sch. 1 4.3"),
    ("brazil_cpf", "LGPD", "Art. 5(I)"),
    ("indian_passport", "DPDP", "S. 2(t)"),
    ("voter_id", "DPDP", "S. 2(t)"),
    ("indian_dl", "DPDP", "S. 2(t)"),
    ("person_name", "GDPR", "Art. 4(1)"), ("person_name", "DPDP", "S. 2(t)"),
    ("date_of_birth", "GDPR", "Art. 4(1)"), ("date_of_birth", "DPDP", "S. 2(t)"),
    ("postal_address", "GDPR", "Art. 4(1)"), ("postal_address", "DPDP", "S. 2(t)"),
    ("payment_card", "PCI DSS", "Req. 3.3"), ("payment_card", "GDPR", "Art. 4(1)"),
    ("iban", "GDPR", "Art. 4(1)"),
    ("upi_vpa", "DPDP", "S. 2(t)"), ("upi_vpa", "RBI", "Master Direction on Digital Payment Security"),
    ("health_information", "GDPR", "Art. 9(1)"), ("health_information", "HIPAA", "45 CFR 164.502"), ("health_information", "DPDP", "S. 2(t)"),
    ("mnpi", "SEC", "Reg FD / Rule 10b5-1"), ("mnpi", "SEBI", "PIT Regulations 2015, Reg. 3"), ("mnpi", "UK MAR", "Art. 10"),
    ("legal_privilege", "Legal privilege", "common law"),
    ("compensation_data", "GDPR", "Art. 4(1)"), ("compensation_data", "DPDP", "S. 2(t)"),
    ("deal_material", "Contract", "NDA / confidentiality undertaking"),
    ("unannounced_transaction", "SEC", "Reg FD / Rule 10b5-1"), ("unannounced_transaction", "SEBI", "PIT Regulations 2015, Reg. 3"), ("unannounced_transaction", "UK MAR", "Art. 10"), ("unannounced_transaction", "Contract", "NDA / confidentiality undertaking"),
    ("negotiation_position", "Contract", "NDA / confidentiality undertaking"),
    ("trade_secret", "EU Trade Secrets Directive", "2016/943 Art. 2"), ("trade_secret", "US DTSA", "18 U.S.C. 1839(3)"),
    ("workforce_action", "GDPR", "Art. 4(1)"), ("workforce_action", "DPDP", "S. 2(t)"), ("workforce_action", "Employment law", "consultation duties vary by jurisdiction"),
    ("legal_hold", "Legal privilege", "common law"), ("legal_hold", "Discovery / disclosure", "e.g. FRCP 26, CPR 31"),
    ("internal_pricing", "Contract", "NDA / confidentiality undertaking"),
    ("prompt_injection", "OWASP GenAI", "LLM01 Prompt Injection"),
    ("aws_access_key_id", "SOC 2 / ISO 27001", "A.9 access control"),
    ("private_key_block", "SOC 2 / ISO 27001", "A.10 cryptography"),
    ("db_connection_string", "SOC 2 / ISO 27001", "A.9 access control"),
    ("stripe_live_key", "PCI DSS", "Req. 8"),
    ("credential_in_prose", "SOC 2 / ISO 27001", "A.9 access control"),
    ("security_incident", "SOC 2 / ISO 27001", "A.16 incident management"), ("security_incident", "GDPR", "Art. 33"),
]


#: What a table of personal records adds from 25 rows on: such a breach is to be notified.
BULK_ROWS = 25
BULK = [("GDPR", "Art. 33"), ("DPDP", "S. 8(6)")]


def _pick(column: Column, values: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def exposure(found: DataFrame, id_col: str, tables: DataFrame | None = None) -> DataFrame:
    """(id, score 0 to 100, band, headline, drivers): per rule its first finding's weight and trust, growing with the logarithm of its number.

    ``tables`` (id, rows, columns: of personal columns) adds the volume of tables.  Drivers are in order of points; the headline names two.
    """
    rules = found.groupBy(id_col, "rule_id").agg(
        F.count("*").alias("n"), F.min("start").alias("first"), F.min_by(F.struct("severity", "confidence", "label"), "start").alias("f")
    )
    points = _pick(F.col("f.severity"), WEIGHT, 4.0) * _pick(F.col("f.confidence"), TRUST, 0.7) * (1 + F.least(F.lit(0.6), 0.18 * F.log2(F.col("n").cast("double"))))
    label = F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit("× "), F.col("f.label"))).otherwise(F.col("f.label"))
    parts = rules.select(id_col, points.alias("points"), F.col("first").cast("long").alias("place"), label.alias("label"))
    if tables is not None:
        breadth = F.least(F.lit(1.5), 1 + 0.12 * (F.col("columns") - 1))
        volume = F.least(F.lit(72.0), (18 + 20 * F.log10(F.greatest(F.lit(10.0), F.col("rows").cast("double")))) * breadth)
        named = F.concat(F.format_number("rows", 0), F.lit(" records in a table"))
        parts = parts.unionByName(tables.select(id_col, volume.alias("points"), F.lit((1 << 62)).alias("place"), named.alias("label")))
    drivers = F.array_sort(F.collect_list(F.struct((-F.round("points")).cast("long").alias("order"), "place", "label")))
    scored = parts.groupBy(id_col).agg(F.round(100 * (1 - F.exp(-F.sum("points") / 45))).cast("long").alias("score"), drivers.alias("d"))
    band = F.when(F.col("score") >= 70, "severe").when(F.col("score") >= 40, "elevated").when(F.col("score") >= 15, "low").otherwise("minimal")
    top = F.transform(F.slice("d", 1, 2), lambda d: F.lower(d["label"]))
    headline = F.when(F.size("d") == 1, F.concat(F.lit("Driven by "), top[0], F.lit("."))).otherwise(F.concat(F.lit("Driven mainly by "), F.array_join(top, " and "), F.lit(".")))
    return scored.select(id_col, "score", band.alias("band"), headline.alias("headline"), F.transform("d", lambda d: F.struct(d["label"].alias("label"), (-d["order"]).alias("points"))).alias("drivers"))


def regimes(found: DataFrame, id_col: str, tables: DataFrame | None = None) -> DataFrame:
    """(id, regime, first_start, refs): regulations that the findings concern and their places; the table of rules is a few rows.

    ``tables`` (id, rows) adds the duties that a breach of many records brings; their first_start is null.
    """
    known = found.sparkSession.createDataFrame(REGIMES, "rule_id string, regime string, ref string")
    places = found.join(F.broadcast(known), "rule_id").select(id_col, "regime", "ref", "start")
    if tables is not None:
        bulk = F.explode(F.array(*(F.struct(F.lit(r).alias("regime"), F.lit(x).alias("ref")) for r, x in BULK)))
        many = tables.where(F.col("rows") >= BULK_ROWS).select(id_col, bulk.alias("b"))
        places = places.unionByName(many.select(id_col, "b.regime", "b.ref", F.lit(None).cast("int").alias("start")))
    return places.groupBy(id_col, "regime").agg(F.min("start").alias("first_start"), F.array_sort(F.collect_set("ref")).alias("refs"))


#: Events that a log of findings keeps.
LOG_MOST = 120


def log_of(events: DataFrame, most: int = LOG_MOST) -> DataFrame:
    """The newest events (columns ``at`` and others); a report of fixed size, for which each task sends ``most`` rows at most."""
    return events.orderBy(F.desc("at"), *(F.asc(c) for c in events.columns if c != "at")).limit(most)


def breakdown(events: DataFrame, most: int = 4) -> DataFrame:
    """The rules with most events."""
    return events.groupBy("rule_id").agg(F.count("*").alias("n"), F.countDistinct("fingerprint").alias("secrets")).orderBy(F.desc("n"), "rule_id").limit(most)
