"""Column functions on strings: check digits, statistics, masks, fingerprints.  All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def digit_array(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: x.cast("int"))


def luhn_sum(d: Column) -> Column:
    """Sum of digits, each second one from the right doubled and its digits added."""
    doubled = F.transform(digit_array(F.reverse(d)), lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def luhn(c: Column) -> Column:
    """12 to 19 digits, other characters left out, with a valid Luhn check digit."""
    d = digits(c)
    return F.length(d).between(12, 19) & (luhn_sum(d) % 10 == 0)


def sin(c: Column) -> Column:
    """Canadian social insurance number: nine digits by Luhn, the first neither 0 nor 8."""
    d = digits(c)
    return d.rlike("^[1-79][0-9]{8}$") & (luhn_sum(d) % 10 == 0)


def imei(c: Column) -> Column:
    """15 digits by Luhn, not all the same."""
    return c.rlike("^[0-9]{15}$") & (c != F.repeat(F.substring(c, 1, 1), F.lit(15))) & (luhn_sum(c) % 10 == 0)


ALPHABET_36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def gstin(c: Column) -> Column:
    """Indian tax number: state 1 to 38, 97 or 99, and a check character by 36 over products' quotients and remainders."""
    code = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.instr(F.lit(ALPHABET_36), x) - 1)
    products = F.transform(F.slice(code, 1, 14), lambda x, i: x * (i % 2 + 1))
    total = F.aggregate(products, F.lit(0), lambda a, x: a + F.floor(x / 36).cast("int") + x % 36)
    state = F.substring(c, 1, 2).try_cast("int")
    return (state.between(1, 38) | state.isin(97, 99)) & ((36 - total % 36) % 36 == F.try_element_at(code, F.lit(15)))


#: Handles of payment addresses.
UPI_HANDLES = ["okhdfcbank", "okicici", "oksbi", "okaxis", "paytm", "ybl", "ibl", "axl", "upi", "apl", "yapl", "abfspay", "freecharge", "airtel", "jupieraxis", "fam", "naviaxis", "superyes", "slc", "timecosmos", "waicici", "waaxis", "wahdfcbank", "wasbi", "idfcbank", "kotak", "indus", "rbl", "federal"]


def upi_vpa(c: Column) -> Column:
    return F.lower(F.substring_index(c, "@", -1)).isin(*UPI_HANDLES)


def indian_licence(c: Column) -> Column:
    """Year of issue from 1950 to now."""
    return F.substring(F.regexp_replace(c, "[ -]", ""), 5, 4).try_cast("int").between(F.lit(1950), F.year(F.current_date()))


def indian_mobile(c: Column) -> Column:
    """Not one or two digits over and over, and not a run down."""
    return ~c.isin("9876543210") & (c != F.repeat(F.substring(c, 1, 1), F.lit(10))) & (c != F.repeat(F.substring(c, 1, 2), F.lit(5)))


def cnpj(c: Column) -> Column:
    """Brazilian company number: two check digits by 11, not all digits the same."""
    d = digits(c)
    weights = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    check = lambda w: F.when(weighted_sum(d, w) % 11 < 2, 0).otherwise(11 - weighted_sum(d, w) % 11)
    same = d == F.repeat(F.substring(d, 1, 1), F.lit(14))
    return (F.length(d) == 14) & ~same & (check(weights) == F.substring(d, 13, 1).try_cast("int")) & (check([6, *weights]) == F.substring(d, 14, 1).try_cast("int"))


def mod97(c: Column) -> Column:
    """Remainder by 97 of an IBAN-like string: first four characters last, letters as 10 to 35."""
    s = F.upper(F.regexp_replace(c, "[ -]", ""))
    turned = F.filter(F.split(F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4)), ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("[0-9]"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, x: (a * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97)


def weighted_sum(c: Column, weights: list[int]) -> Column:
    """Sum of the first digits times the weights."""
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(F.slice(digit_array(digits(c)), 1, len(weights)), w, lambda x, y: x * y), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def cpf(c: Column) -> Column:
    """Brazilian CPF: two check digits by 11, not all digits the same."""
    d = digits(c)
    check = lambda n: F.when(weighted_sum(c, list(range(n + 1, 1, -1))) * 10 % 11 == 10, 0).otherwise(weighted_sum(c, list(range(n + 1, 1, -1))) * 10 % 11)
    return (F.length(d) == 11) & ~d.rlike(r"^(\d)\1*$") & (check(9) == F.substring(d, 10, 1).cast("int")) & (check(10) == F.substring(d, 11, 1).cast("int"))


def abn(c: Column) -> Column:
    """Australian business number: first digit less one, weights 10 1 3 5 ... 19, by 89."""
    d = digits(c)
    return (F.length(d) == 11) & ((weighted_sum(d, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) - 10) % 89 == 0)


def tfn(c: Column) -> Column:
    """Australian tax file number: weights by 11."""
    d = digits(c)
    return (F.length(d) == 9) & (weighted_sum(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)


def ssn(c: Column) -> Column:
    """US social security number: areas, groups and serials that are never issued."""
    d = digits(c)
    return (F.length(d) == 9) & ~F.substring(d, 1, 3).isin("000", "666") & (F.substring(d, 1, 1) != "9") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")


#: Multiplication and permutation of the dihedral group of the Verhoeff scheme.
VERHOEFF_D = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]]
VERHOEFF_P = [[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8]]


def verhoeff(c: Column) -> Column:
    table = lambda rows: F.array(*(F.lit(x) for r in rows for x in r))
    step = F.transform(digit_array(F.reverse(digits(c))), lambda x, i: F.element_at(table(VERHOEFF_P), (i % 8) * 10 + x + 1))
    return F.aggregate(step, F.lit(0), lambda a, x: F.element_at(table(VERHOEFF_D), a * 10 + x + 1)) == 0


def aadhaar(c: Column) -> Column:
    d = digits(c)
    return (F.length(d) == 12) & d.rlike("^[2-9]") & ~d.rlike(r"^(\d)\1*$") & verhoeff(d)


def entropy(c: Column) -> Column:
    """Shannon bits a character."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars).cast("double")
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, x: a - (F.size(F.filter(chars, lambda y: y == x)) / n) * F.log2(F.size(F.filter(chars, lambda y: y == x)) / n))


def mask(c: Column) -> Column:
    """All stars up to 8 characters; else 3 (of more than 24: 6) stay at either end, with at most 12 stars between."""
    n, keep = F.length(c), F.when(F.length(c) > 24, 6).otherwise(3)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, F.lit(1), keep), F.repeat(F.lit("*"), F.least(n - 2 * keep, F.lit(12))), F.substring(c, n - keep + 1, keep)))


def fingerprint(c: Column, salt: str = "") -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + "\0"), c), 256), 1, 32)


def card_issuer(c: Column) -> Column:
    """Brand by prefix and length; null if none."""
    d, n = digits(c), F.length(digits(c))
    head = lambda k: F.substring(d, 1, k).try_cast("int")
    long = n.between(16, 19)
    return (
        F.when((n == 13) & (head(1) == 4), "Visa").when((n == 14) & (head(3).between(300, 305) | (head(4) == 3095) | head(2).isin(36, 38, 39)), "Diners")
        .when((n == 15) & head(2).isin(34, 37), "Amex").when(long & (head(1) == 4), "Visa").when(long & (head(2).between(51, 55) | head(4).between(2221, 2720)), "Mastercard")
        .when(long & ((head(4) == 6011) | (head(2) == 65) | head(3).between(644, 649) | head(6).between(622126, 622925)), "Discover").when(long & head(4).between(3528, 3589), "JCB")
        .when(long & ((head(3) == 508) | head(2).isin(60, 81, 82)), "RuPay").when(long & (head(2) == 62), "UnionPay").when(long & ((head(2) == 50) | head(2).between(56, 69)), "Maestro")
    )


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def isin(c: Column) -> Column:
    """Luhn over the characters, letters as 10 to 35."""
    return luhn_sum(F.array_join(F.transform(_chars(F.upper(c)), lambda x: F.instr(F.lit(ALPHABET_36), x) - 1), "")) % 10 == 0


def eu_vat(c: Column) -> Column:
    """Germany, the Netherlands and Italy by their check digits; others are not known."""
    body = F.substring(c, 3, 20)
    step = lambda a, x: F.when((x + a) % 10 == 0, 20).otherwise((x + a) % 10 * 2) % 11
    german = (11 - F.aggregate(F.slice(digit_array(body), 1, 8), F.lit(10), step)) % 10
    return (
        F.when(c.rlike("^DE[0-9]{9}$"), german == F.substring(body, 9, 1).try_cast("int"))
        .when(c.rlike("^NL[0-9]{9}B[0-9]{2}$"), weighted_sum(body, [9, 8, 7, 6, 5, 4, 3, 2]) % 11 == F.substring(body, 9, 1).try_cast("int"))
        .when(c.rlike("^IT[0-9]{11}$"), luhn_sum(body) % 10 == 0).otherwise(False)
    )


BASE_62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def github_checksum(c: Column) -> Column:
    """valid, invalid or unknown: the last six characters are the CRC-32 of the 30 before them, to base 62."""
    n = F.crc32(F.substring(c, 5, 30).cast("binary"))
    place = F.array(*(F.lit(62**k) for k in range(5, -1, -1)))
    want = F.array_join(F.transform(place, lambda p: F.substring(F.lit(BASE_62), (F.floor(n / p) % 62).cast("int") + 1, F.lit(1))), "")
    return F.when(~c.rlike("^gh[pousr]_[A-Za-z0-9]{36}$"), "unknown").when(want == F.substring(c, 35, 6), "valid").otherwise("invalid")


def aws_account(c: Column) -> Column:
    """The account of a key id: bits 2 to 41 of its base-32 body; null if it has none."""
    bits = F.aggregate(F.slice(_chars(F.substring(c, 5, 16)), 1, 10), F.lit(0).cast("long"), lambda a, x: a * 32 + F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), x) - 1)
    account = F.shiftright(F.shiftright(bits, 2).bitwiseAND(F.lit(0x7FFFFFFFFF80)), 7)
    return F.when(c.rlike("^[A-Z]{4}[A-Z2-7]{16}$") & account.between(1, 999_999_999_999), F.lpad(account.cast("string"), 12, "0"))


def looks_random(c: Column, least: float = 3.6) -> Column:
    kinds = F.size(F.array_distinct(_chars(c)))
    return (F.length(c) >= 16) & (kinds > 1) & (kinds >= F.least(F.lit(10.0), F.length(c) / 3)) & c.rlike("[0-9]") & c.rlike("[A-Za-z]") & (entropy(c) >= least)


def is_benign(c: Column) -> Column:
    """A UUID, a digest, one unit over and over, a run up or down, or a time since 1970."""
    codes = F.transform(_chars(c), F.ascii)
    steps = F.array_distinct(F.zip_with(F.slice(codes, 2, 10_000), codes, lambda b, a: b - a))
    run = (F.length(c) >= 5) & F.transform(F.filter(steps, lambda x: x.isNotNull()), F.abs).isin([F.array(F.lit(1))])
    d, unit = digits(c).try_cast("decimal(38,0)"), F.when(F.length(digits(c)) == 13, F.lit(1000).cast("long")).when(F.length(digits(c)) == 16, F.lit(1_000_000).cast("long"))
    time = d.between(F.lit(946_684_800) * unit + 1, F.lit(4_102_444_800) * unit - 1) & ~F.regexp_extract(c, "(?s)[0-9].*[0-9]", 0).rlike("[A-Za-z]")
    shapes = c.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") | c.rlike("(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{128})$") | c.rlike(r"^(.{1,4})\1+$")
    return shapes | run | F.coalesce(time, F.lit(False))


def is_code_identifier(c: Column) -> Column:
    words = F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+"), F.lit(0))
    whole = (F.size(words) < 5) | (F.length(F.array_join(words, "")) >= 3 * F.size(words))
    return c.rlike(r"[.(){}\[\]<>;]") | whole & c.rlike("^(?:[a-z]+(?:[A-Z][a-z]+)+[0-9]{0,2}|[A-Z][a-z]+(?:[A-Z][a-z]+)+[0-9]{0,2}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)$")
