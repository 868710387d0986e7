"""Detectors that weigh what stands around a match, and phrases of confidential business."""

from __future__ import annotations

import re

from siftwell.functions import checks
from siftwell.operators.rule import CAPITALS, NINE_DIGITS, Near, Place, Rule

#: Amounts of money, and what else settles whether a phrase matters.
MONEY = r"(?i)(?:[$£€₹¥]\s?[0-9,.]+|\b[0-9,.]+\s?(?:k|m|bn|mn|cr|crore|lakh|lakhs|million|billion)\b)"
STILL_OPEN = r"(?i)\b(?:unpatched|unfixed|unresolved|not yet (?:patched|fixed|public|disclosed)|still (?:open|vulnerable)|active(?:ly)? exploit|in the wild|embargo|pre[- ]disclosure|zero[- ]day)\b"
SECRECY = r"(?i)\b(?:confidential|not yet public|unannounced|do not (?:share|forward)|under NDA)\b"
ADVISORIES = r"(?i)\b(?:vulnerabilit|advisor|CVE-|disclosure|security|patch|researcher|report)"
OBJECT_STORES = r"(?i)\b(?:s3|object[_ ]lock|bucket|retention[_ ]mode|governance mode|compliance mode|version_?id)\b"
PHONE_WORDS = r"(?i)\b(?:phone|mobile|cell|contact|call|whats ?app|tel|number|reach|sms)\b"
DOSE = r"(?i)^prescribed\s+[^.\n]{0,60}\b(?:mg|ml|mcg|iu|tablets?|capsules?|dose|dosage|daily|twice|bd|od|tds|course)\b"
CONDITION = r"(?i)^symptoms? of\s+[^.\n]{0,40}\b(?:covid|influenza|flu|diabetes|cancer|depression|anxiety|asthma|infection|disease|disorder|syndrome|illness|condition|the patient)\b"


def _phrase(id_: str, severity: str, confidence: str, pattern: str, literals: tuple[str, ...], sample: str, **more) -> Rule:
    return Rule(id_, "context", severity, confidence, pattern, literals, advisory=True, sample=sample, **more)


#: Words after "password is" that are no password.
NO_PASSWORD = frozenset("is the a an to for and reset change manager policy protected field less hash hashing expired incorrect invalid required strength rule rules here above below attached shared same new old your my our their".split())


def _password(value: str, at: Place) -> bool:
    """More than small letters, and neither an example, a template nor code."""
    plain = value.lower() in NO_PASSWORD or value[0] in "<{[@" or re.fullmatch("[a-z]+", value)
    return not plain and not checks.is_benign(value, placeholder=True) and not checks.is_code_identifier(value)


#: Shapes of credentials and identifiers that need a check or a word beside them.
CREDENTIALS = [
    Rule("gcp_service_account", "cloud", "critical", "certain", r'"type"\s*:\s*"service_account"', ("service_account",), sample='"type": "service_account"'),
    Rule("cloudflare_token", "cloud", "high", "likely", r"(?i)\b([A-Za-z0-9_-]{40})\b[^A-Za-z0-9_-]*(?:cloudflare|CF_API)", ("cloudflare", "cf_api"), group=1, sample="{h40} cloudflare"),
    Rule("jfrog_token", "source", "critical", "certain", r"\bcmVmdGtuOjAxO[A-Za-z0-9+/=]{20,}\b", ("cmvmdgtuojaxo",), sample="cmVmdGtuOjAxO{h40}"),
    Rule("openai_key", "ai", "critical", "certain", r"\bsk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_-]{32,}\b", ("sk-",), refuse="^sk-(?:ant|or)-", sample="sk-proj-{h48}"),
    Rule("anthropic_key", "ai", "critical", "certain", r"\bsk-ant-(?:api|admin)[0-9]{2}-[A-Za-z0-9_-]{24,}\b", ("sk-ant-",), sample="sk-ant-api03-{h32}"),
    Rule("discord_bot_token", "comms", "high", "likely", r"\b[MNO][A-Za-z0-9_-]{23,25}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,38}\b", (".",), shape=("[A-Za-z0-9_-]{24}",), sample="M{h24}.abcdef.{h32}"),
    Rule("okta_token", "platform", "critical", "likely", r"\b(00[A-Za-z0-9_-]{40})\b[^A-Za-z0-9_-]*(?:okta|OKTA)", ("okta",), group=1, sample="00{h40} okta"),
    Rule("db_connection_string", "generic", "critical", "certain", r"\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|rediss|amqps?|mssql|clickhouse|cassandra|neo4j|snowflake)://[^\s:/@]+:[^\s@]+@[^\s/?#]+(?:/[^\s?#]*)?(?:\?[^\s#]*)?", ("://",), refuse=r"(?i):(?:password|pass|pwd|secret|xxx+|\*+|<[^>]*>|\$\{[^}]*\})@", sample="postgres://app:{h12}@db.internal:5432/main"),
]
IDENTIFIERS = [
    Rule("gstin", "india", "medium", "certain", r"\b[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]\b", (), check=lambda v, _: checks.gstin(v), shape=(CAPITALS,), sample="27AAPFU0939F1ZV"),
    Rule("upi_vpa", "india", "medium", "certain", r"\b[a-zA-Z0-9._-]{2,64}@[a-zA-Z]{2,32}\b", ("@",), check=lambda v, _: checks.upi_vpa(v), sample="u{h8}@ybl"),
    Rule("indian_passport", "india", "high", "possible", r"\b[A-PR-WY][0-9]{7}\b", (), near=(Near("(?i)passport", 40, 40),), shape=("[0-9]{7}",), sample="passport K1234567"),
    Rule("voter_id", "india", "medium", "possible", r"\b[A-Z]{3}[0-9]{7}\b", (), near=(Near("(?i)(?:voter|epic|election)", 40, 40),), shape=(CAPITALS, "[0-9]{7}"), sample="voter card ABC1234567"),
    Rule("indian_dl", "india", "medium", "likely", r"\b[A-Z]{2}[0-9]{2}[ -]?[0-9]{4}[0-9]{7}\b", (), check=lambda v, _: checks.indian_licence(v), shape=(CAPITALS, NINE_DIGITS), sample="MH12 20110012345"),
    Rule("phone_india", "india", "low", "likely", r"\b[6-9][0-9]{4}[ -]?[0-9]{5}\b", (), check=lambda v, _: not checks.is_benign(v, hex_digest=False), near=(Near("91[ -]$", 3, 0), Near("^[0-9]{5}[ -]", 0, 11), Near(PHONE_WORDS, 48, 34)), shape=(NINE_DIGITS,), sample="mobile 9812345670"),
    Rule("canada_sin", "global", "critical", "likely", r"\b[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}\b", (), check=lambda v, _: checks.sin(v), near=(Near(r"(?i)(?:\bsin\b|social insurance)", 40, 20),), shape=(NINE_DIGITS,), sample="SIN 130 692 544"),
    Rule("uk_nino", "global", "critical", "likely", r"\b[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b", (), refuse="^(?:.O|BG|GB|NK|KN|TN|NT|ZZ)", shape=(CAPITALS,), sample="AB 12 34 56 C"),
    Rule("brazil_cnpj", "global", "medium", "certain", r"\b[0-9]{2}\.?[0-9]{3}\.?[0-9]{3}/?[0-9]{4}-?[0-9]{2}\b", (), check=lambda v, _: checks.cnpj(v), shape=(NINE_DIGITS,), sample="11.222.333/0001-81"),
    Rule("australia_abn", "global", "low", "certain", r"\b[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", (), check=lambda v, _: checks.abn(v), near=(Near("(?i)abn", 30, 10),), shape=(NINE_DIGITS,), sample="ABN 51 824 753 556"),
    Rule("australia_tfn", "global", "critical", "likely", r"\b[0-9]{3} ?[0-9]{3} ?[0-9]{3}\b", (), check=lambda v, _: checks.tfn(v), near=(Near(r"(?i)(?:\btfn\b|tax file)", 30, 10),), shape=(NINE_DIGITS,), sample="TFN 123 456 782"),
    Rule("imei", "global", "medium", "likely", r"\b[0-9]{15}\b", (), check=lambda v, _: checks.imei(v), near=(Near("(?i)imei", 30, 10),), shape=(NINE_DIGITS,), sample="IMEI 490154203237518"),
]
#: Phrases, with the words that must occur in a text for it to be searched.
PHRASES = [
    Rule("credential_in_prose", "context", "critical", "likely", r"""(?i)\b(?:pass(?:word|code)?|pwd|login|log ?in|credentials?|PIN)\s*(?:is|are|=|:)\s*["'`]?([^\s"'`,;]{6,64})["'`]?""", ("password", "passcode", "login is", "log in with", "credentials are", "pin is"), group=1, check=_password, sample="password is Tr0ub4dor&{h4}"),
    _phrase("classification_marking", "high", "certain", r"(?i)\b(?:strictly confidential|company confidential|confidential (?:and proprietary|information)|proprietary and confidential|internal use only|internal only|for internal (?:use|distribution)|do not (?:distribute|forward|share|circulate)|commercially sensitive|restricted[- ]confidential|confidential)\b", ("confidential", "internal", "proprietary", "restricted", "do not"),
            "strictly confidential", near_if="(?i)^(?:confidential|internal use only|internal only|for internal use|for internal distribution)$", near=(Near(r"(?:^|\n)[\s*_#>|-]*$", 24, 0), Near("^(?:CONFIDENTIAL|INTERNAL USE ONLY|INTERNAL ONLY|FOR INTERNAL USE|FOR INTERNAL DISTRIBUTION)", 0, 25))),
    _phrase("legal_privilege", "critical", "certain", r"(?i)\b(?:attorney[- ]client privileged?|privileged and confidential|legally privileged|solicitor[- ]client privilege|attorney work[- ]product|litigation privilege|without prejudice(?: save as to costs)?|subject to contract)\b", ("privileg", "without prejudice", "work product"), "privileged and confidential"),
    _phrase("deal_material", "high", "likely", r"(?i)\b(?:term sheet|letter of intent|heads of terms|due diligence (?:report|findings|checklist|request)|virtual data room|data room|definitive agreement|share purchase agreement|merger agreement|cap(?:italisation|italization)? table|pre[- ]money valuation|post[- ]money valuation|exclusivity period)\b", ("term sheet", "letter of intent", "due diligence", "data room", "definitive agreement", "project ", "cap table"), "term sheet"),
    _phrase("mnpi", "critical", "likely", r"(?i)\b(?:material non[- ]?public information|MNPI|inside information|insider (?:list|trading|information)|blackout period|closed period|pre[- ]announcement|earnings (?:release|call) draft|unannounced (?:results|acquisition|merger))\b", ("non-public", "nonpublic", "non public", "blackout", "insider", "embargo"), "insider list"),
    _phrase("unreleased_information", "medium", "possible", r"(?i)\b(?:unreleased (?:product|feature|pricing|results)|not yet (?:announced|public|launched)|ahead of (?:the )?announcement|confidential roadmap|internal roadmap|pre[- ]launch pricing)\b", ("unreleased", "unannounced", "not yet announced", "launch date", "roadmap"), "internal roadmap"),
    _phrase("financial_disclosure", "high", "likely", r"\b(?:ARR|MRR|EBITDA|run[- ]?rate revenue|gross margin|net margin|burn rate|cash runway|runway|churn rate|CAC|LTV|unit economics)\b", ("arr", "mrr", "ebitda", "runway", "burn rate", "gross margin", "churn"), "EBITDA of $12m", near=(Near(MONEY, 90, 90), Near(r"\b[0-9]+(?:\.[0-9]+)?\s?%", 60, 60))),
    _phrase("compensation_data", "high", "likely", r"(?i)\b(?:salary|annual salary|base (?:pay|salary)|total compensation|CTC|bonus|equity grant|RSUs?|stock options|severance|notice pay|pay band|comp(?:ensation)? band)\b", ("salary", "ctc", "compensation", "base pay", "bonus", "rsu", "equity grant", "severance"), "base pay $90,000", near=(Near(MONEY, 90, 90),)),
    _phrase("health_information", "critical", "likely", r"(?i)\b(?:diagnos(?:ed with|is of|is is|is was)|patient (?:record|history|id|name|chart)|medical (?:record|history|report)|prescription for|prescribed\s|ICD-1[01][ -]?[A-Z][0-9]{2}|treatment plan|clinical notes?|lab results?|blood (?:test|report)|symptoms? of\s)", ("diagnos", "patient", "prescri", "medical record", "icd-", "mg ", "treatment", "symptom"), "diagnosed with flu", near_if="(?i)^(?:prescribed|symptom)", near=(Near(DOSE, 0, 100), Near(CONDITION, 0, 80))),
    _phrase("security_incident", "high", "likely", r"(?i)\b(?:CVE-[0-9]{4}-[0-9]{4,7}|data breach|security incident|incident report|zero[- ]day|ransomware|indicators? of compromise|IOCs?|unpatched vulnerability|active exploit)\b", ("cve-", "breach", "zero-day", "zero day", "ransom", "incident report", "compromise"), "data breach", near_if="(?i)^CVE-", near=(Near(STILL_OPEN, 140, 140),)),
    _phrase("unannounced_transaction", "critical", "likely", r"\b(?:(?:acquir(?:e|es|ed|ing)|merg(?:e|es|ed|ing)\s+with|purchas(?:e|es|ed|ing)|buy(?:s|ing)?|divest(?:s|ed|ing)?|tak(?:e|es|ing)\s+over)\s+(?:[A-Z][A-Za-z0-9_&'.-]*(?:\s+[A-Z][A-Za-z0-9_&'.-]*){0,3})|announcement\s+is\s+(?:scheduled|planned|set)\s+for|(?:before|ahead of|prior to)\s+the\s+announcement|embargoed until|under embargo|signing\s+(?:is|happens)\s+on)\b", ("acquir", "announcement", "embargo", "merger", "divest", "takeover"),
            "acquire Acme for $20m", near_if="^(?:acquir|merg|purchas|buy|divest|tak)", near=(Near(MONEY, 160, 200), Near(SECRECY, 160, 200)), never_if="(?i)embargo", never=Near(ADVISORIES, 160, 200)),
    _phrase("negotiation_position", "high", "likely", r"(?i)\b(?:walk[- ]away (?:price|point|number)|BATNA|best and final (?:offer|price)|reservation price|(?:our|the) floor (?:is|price)|price floor of|we (?:can|could) go as low as|we(?:'| a)?re (?:prepared|willing) to (?:accept|go to|pay)|internal (?:target|ceiling|budget) (?:is|of)|counter[- ]?offer of)\b", ("walk away", "walk-away", "batna", "best and final", "reservation price", "floor price", "our floor", "counteroffer", "counter-offer", "as low as", "bottom line is"), "reservation price"),
    _phrase("trade_secret", "high", "possible", r"(?i)\b(?:trade secrets?|invention disclosure|provisional patent|patent application (?:number|draft|for)|(?:before|prior to) filing|unpatented|not (?:yet )?patented|proprietary (?:algorithm|model|method|process|formula|weights|dataset))\b", ("trade secret", "proprietary", "invention disclosure", "provisional patent", "patent application", "not patented", "unpatented"), "trade secret"),
    _phrase("workforce_action", "high", "likely", r"(?i)\b(?:reduction in force|RIF(?:ed|s)?|layoffs?\s+(?:planned|scheduled|list|of [0-9]+)|redundanc(?:y|ies)\s+(?:consultation|list|process)|severance (?:package|terms|offer)|performance improvement plan|termination list|exit list|being (?:let go|managed out))\b", ("reduction in force", "redundanc", "layoff", "severance", "performance improvement plan", "termination list", "let go"), "termination list"),
    _phrase("legal_hold", "high", "likely", r"(?i)\b(?:litigation hold|legal hold|preservation notice|cease and desist|subpoena(?:ed)?|without prejudice|settlement (?:agreement|discussions?|negotiations?)|statement of claim|letter before action|arbitration (?:notice|demand))\b", ("litigation hold", "legal hold", "preservation notice", "cease and desist", "subpoena", "without prejudice", "settlement agreement"), "litigation hold", never_if="(?i)legal hold", never=Near(OBJECT_STORES, 120, 120)),
    _phrase("internal_pricing", "medium", "possible", r"(?i)\b(?:rate card|gross margin(?:s)? (?:of|on|is|are)|cost of goods(?: sold)?|COGS|(?:our|unit|landed|wholesale) cost (?:is|of|per)|discount (?:floor|ceiling|authority)|internal pricing|markup (?:of|is))\b", ("rate card", "gross margin", "cost of goods", "our cost", "unit cost", "discount floor", "internal pricing", "landed cost", "markup"), "unit cost is $4", near=(Near(MONEY, 160, 160), Near("%", 0, 80))),
    _phrase("customer_list", "high", "possible", r"(?i)\b(?:customer list|client list|account list|target list|prospect list|pipeline review|churn risk|at[- ]risk accounts?|renewal forecast)\b", ("customer list", "account list", "pipeline", "churn risk", "renewal"), "customer list"),
]
