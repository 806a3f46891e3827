"""Format-preserving pseudonyms for personal data (operator 2), built-in functions only.

One pattern finds e-mail addresses, IP addresses, phone, card, social-security and
bank account numbers and dates; numbers and dates count only if they are valid
(check digits, ranges, calendar). Card and account numbers are looked for at every
place and in every grouping first, and only those of right check digits go into the
text's pattern, so an invalid run never hides a valid number in it. Each is replaced within its format by a keyed
permutation, a Feistel network over its digits or its place in the range of
valid values, so equal values get equal pseudonyms in every document and
different ones never meet. Separators stay; check digits are computed anew.
An e-mail address has no number to permute: its name becomes a keyed digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Round count of the networks; even, so that both halves return to their places.
ROUNDS = 8
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: Kinds and their patterns, in the order in which they are tried.
KINDS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[\p{L}0-9-]{1,63}+(?:\.[\p{L}0-9-]{1,63}+){1,8}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": rf"(?<![0-9/.-])(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}/{_MONTH}/{_YEAR}|{_DAY}\.{_MONTH}\.{_YEAR})(?![0-9]|[/.-][0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9(-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9]|-[0-9])",
}
PATTERN = "|".join(KINDS.values())


def _groups(*sizes: int) -> str:
    return "[ -]".join(f"[0-9]{{{n}}}" for n in sizes)


#: Groupings of cards. Those of one line never fit at one place together; any other grouping counts where no digit is beside.
CARDS = (
    "|".join((_groups(4, 4, 4, 4), _groups(4, 6, 5), _groups(4, 6, 4), _groups(8, 8), _groups(6, 13), "[0-9]{13,19}")),
    "|".join((_groups(4, 4, 4, 4, 3), _groups(4, 4, 5))),
)
ANY_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
#: Length of an account code by country.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int, lands: str) -> str:
    whole, rest = divmod(length - 4, 4)
    tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return f"(?:{lands.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{whole}}}{tail}"


#: Codes of the countries known, and of others as long as they go.
ACCOUNTS = (
    "(?<![A-Za-z0-9])(?=((?:" + "|".join(_account(n, c) for n, c in LENGTHS.items()) + ")(?![A-Za-z0-9])))",
    "(?<![A-Za-z0-9])(?!" + "|".join(" ".join(LENGTHS.values()).split()) + ")(?=("
    + KINDS["iban"].removeprefix("(?<![A-Za-z0-9])") + "))",
)
NEVER = "(?!)"
#: Days from 1900-01-01 to 2099-12-31: 17 x 4297.
_DAYS, _PARTS = 73049, (17, 4297)
#: Valid areas times valid rests of social-security numbers and of local phone numbers.
_SSNS, _PHONES = (898, 99 * 9999), (800, 8_000_000)


def _round(key: str, kind: str, i: Column, width: Column, half: Column) -> Column:
    """Keyed 48-bit digest of one half."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), width.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def permute(a: Column, b: Column, size_a: Column, size_b: Column, key: str, kind: str) -> Column:
    """Feistel network: a keyed permutation of pairs below (size_a, size_b), as ``(a, b)``."""

    def step(s: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, size_a).otherwise(size_b)
        moved = F.pmod(s["a"] + _round(key, kind, i, size_a * 7 + size_b, s["b"]), size)
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of digit strings of one length, 2 to 30 digits.

    The halves of strings over 18 digits still fit a whole number."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    out = permute(F.substring(digits, F.lit(1), u).cast("long"), F.substring(digits, u + 1, n).cast("long"),
                  ten(u), ten(n - u), key, kind)
    return F.concat(F.lpad(out["a"].cast("string"), u, "0"), F.lpad(out["b"].cast("string"), n - u, "0"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _put_back(text: Column, new: Column) -> Column:
    """The characters of ``new`` in the places of the letters and digits of ``text``."""
    filled = F.aggregate(
        F.split(text, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct(F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return filled["out"]


def _luhn(digits: Column) -> Column:
    """Sum of the check; the last digit stands at weight one."""
    places = F.split(F.reverse(digits), "")
    worth = F.transform(
        F.filter(places, lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(worth, F.lit(0), lambda s, x: s + x)


def _card(text: Column, key: str) -> Column:
    digits = _digits(text)
    body = permute_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(_luhn(digits) % 10 == 0, _put_back(text, F.concat(body, check.cast("string")))).otherwise(text)


def _mod97(code: Column) -> Column:
    """Remainder of an account code, its first four characters moved to the end."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    values = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(
        values, F.lit(0),
        lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97),
    )


def _iban(text: Column, key: str) -> Column:
    """Country and bank letters stay; the account's digits are permuted, then the check digits set."""
    code = F.replace(text, F.lit(" "), F.lit(""))
    body = F.substring(code, F.lit(5), F.length(code))
    digits = _digits(body)
    mixed = F.aggregate(
        F.filter(F.split(body, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), permute_digits(digits, key, "iban").alias("new")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substring(s["new"], s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + c.rlike("[0-9]").cast("int")).alias("at"),
            s["new"].alias("new"),
        ),
    )["out"]
    land = F.substring(code, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(land, F.lit("00"), mixed))).cast("string"), 2, "0")
    whole = F.length(code).between(15, 34) & (_mod97(code) == 1) & (F.length(digits) >= 2)
    return F.when(whole, _put_back(text, F.concat(land, check, mixed))).otherwise(text)


def _ip(text: Column, key: str) -> Column:
    parts = F.split(text, r"\.")
    half = lambda i: parts[i].cast("long") * 256 + parts[i + 1].cast("long")
    size = F.lit(65536).cast("long")
    out = permute(half(0), half(2), size, size, key, "ip")
    return F.transform(
        F.array(out),
        lambda s: F.concat_ws(".", *(x.cast("string") for x in (
            F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256))),
    )[0]


_DATES = (("-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), (".", "dd.MM.yyyy"))


def _date(text: Column, key: str) -> Column:
    """Days that no calendar has stay as they are."""
    out = text
    for mark, pattern in _DATES:
        day = F.datediff(F.try_to_date(text, pattern), F.lit("1900-01-01").cast("date"))
        moved = permute(F.floor(day / _PARTS[1]), day % _PARTS[1], F.lit(_PARTS[0]).cast("long"),
                        F.lit(_PARTS[1]).cast("long"), key, "date")
        back = F.transform(F.array(moved), lambda s: F.date_format(
            F.date_add(F.lit("1900-01-01").cast("date"), (s["a"] * _PARTS[1] + s["b"]).cast("int")), pattern))[0]  # noqa: B023
        out = F.when(F.contains(text, F.lit(mark)) & day.between(0, _DAYS - 1), back).otherwise(out)
    return out


def _phone(text: Column, key: str) -> Column:
    """The country's number stays; the digits after it are permuted."""
    land = F.regexp_extract(text, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]", 0)
    rest = F.substring(text, F.length(land) + 1, F.length(text))
    digits = _digits(rest)
    enough = F.length(digits).between(7, 15)
    abroad = F.when(enough, F.concat(land, _put_back(rest, permute_digits(digits, key, "phone")))).otherwise(text)
    return F.when(text.startswith("+"), abroad).otherwise(_local_phone(text, key))


def _number(digits: Column, at: int, length: int) -> Column:
    return F.substring(digits, at, length).cast("long")


def _padded(c: Column, length: int) -> Column:
    return F.lpad(c.cast("string"), length, "0")


def _local_phone(text: Column, key: str) -> Column:
    """Area and exchange stay between 200 and 999: each number is permuted by its rank among the valid ones."""
    digits, size = _digits(text), _PHONES
    moved = permute(_number(digits, 1, 3) - 200, _number(digits, 4, 7) - 2_000_000,
                    F.lit(size[0]).cast("long"), F.lit(size[1]).cast("long"), key, "local")
    back = lambda s: F.concat(_padded(s["a"] + 200, 3), _padded(s["b"] + 2_000_000, 7))
    return _put_back(text, F.transform(F.array(moved), back)[0])


def _ssn(text: Column, key: str) -> Column:
    """Permuted by rank among the valid ones: no area 000, 666 or 9xx, no group 00, no serial 0000."""
    digits, size = _digits(text), _SSNS
    area = _number(digits, 1, 3)
    rank = area - F.when(area > 666, 2).otherwise(1)
    low = (_number(digits, 4, 2) - 1) * 9999 + _number(digits, 6, 4) - 1
    moved = permute(rank, low, F.lit(size[0]).cast("long"), F.lit(size[1]).cast("long"), key, "ssn")
    back = lambda s: F.concat(
        _padded(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3),
        _padded(F.floor(s["b"] / 9999) + 1, 2), _padded(s["b"] % 9999 + 1, 4))
    return _put_back(text, F.transform(F.array(moved), back)[0])


def _email(text: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(key + "|email|"), F.lower(text)), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@example.org"))


_MAKERS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone,
}


def kind_of(hit: Column) -> Column:
    """Which kind a hit of ``PATTERN`` is: the first whose pattern is the whole of it."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        bare = f"^(?:{pattern})$"
        out = F.when(hit.rlike(bare), F.lit(kind)).otherwise(out)
    return out


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of a hit; hits that are not valid stay as they are."""
    out = hit
    for kind, make in reversed(_MAKERS.items()):
        out = F.when(hit.rlike(f"^(?:{KINDS[kind]})$"), make(hit, key)).otherwise(out)
    return out


def _valid(text: Column, patterns: tuple[str, ...], group: int, good: Callable[[Column], Column]) -> Column:
    """The different hits that are good, those of the first patterns first."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in patterns]
    return F.filter(F.array_distinct(F.concat(*found)), good)


def _card_numbers(text: Column) -> Column:
    good = lambda c: _luhn(_digits(c)) % 10 == 0
    grouped = _valid(text, tuple(f"(?<![0-9])(?=((?:{p})(?![0-9])))" for p in CARDS), 1, good)
    return F.concat(grouped, _valid(text, (ANY_CARD,), 0, good))


def _accounts(text: Column) -> Column:
    def good(c: Column) -> Column:
        code = F.replace(c, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & (_mod97(code) == 1)

    return _valid(text, ACCOUNTS, 1, good)


#: Up to 15 digits follow a plus; none of them begins a card number, a date or a social-security number.
_PLUS = (
    r"(?<![0-9+])\+1[ .-]?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![0-9+])\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?(?!",
    "|" + KINDS["date"] + "|" + KINDS["ssn"] + "|" + KINDS["ip"]
    + r")[0-9]{2,4}){2,4}(?![0-9])(?<!" + 15 * "[0-9][ .()-]{0,2}" + "[0-9])",
)
_LOCAL = KINDS["phone"].split("|(?<!", 1)[1]


def _pattern(cards: Column, accounts: Column) -> Column:
    """The pattern of one text, given its valid card and account numbers."""
    either = lambda a, before, after: F.when(F.size(a) > 0, F.concat(
        F.lit(before + "(?:"), F.array_join(a, "|"), F.lit(")" + after))).otherwise(F.lit(NEVER))
    card = either(cards, "(?<![0-9])", "(?![0-9])")
    return F.concat(
        F.lit(KINDS["email"] + "|"), either(accounts, "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"),
        F.lit("|" + "|".join(KINDS[k] for k in ("ip", "date", "ssn")) + "|" + _PLUS[0] + "|" + _PLUS[1]), card,
        F.lit(_PLUS[2] + "|(?<!" + _LOCAL + "|"), card,
    )


def _replaced(text: Column, pattern: Column, key: str) -> Column:
    # split() wants its pattern as text or column, the same one as for the hits.
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    mixed = F.zip_with(F.split(text, pattern, -1), hits, lambda a, h: F.concat(a, F.coalesce(pseudonym(h, key), F.lit(""))))
    return F.array_join(mixed, "")


def pseudonymise(text: Column, key: str) -> Column:
    """The text with pseudonyms in place of personal data; all else stays byte for byte."""
    # Arrays of one, so that the numbers are looked for once.
    long = text.rlike("[0-9](?:[ -]?[0-9]){12}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")
    pattern = F.when(long, _pattern(_card_numbers(text), _accounts(text))).otherwise(
        _pattern(F.array().cast("array<string>"), F.array().cast("array<string>")))
    out = F.transform(F.array(pattern), lambda p: _replaced(text, p, key))[0]
    # A digit is in all but e-mail addresses, which have their own sign.
    return F.when(text.rlike("[0-9@]"), out).otherwise(text)


def mask_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The given rows and columns with ``text_col`` pseudonymised.

    Null and empty texts stay; every row is worked on by itself, so ties, repeated
    rows, null ids and extra columns pass through; an empty table stays empty.
    """
    name = "`" + text_col.replace("`", "``") + "`"
    columns = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    return docs.select(*(
        pseudonymise(F.col(c), key).alias(text_col) if c == name else F.col(c) for c in columns
    ))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, hit``: each hit of the pattern, valid or not."""
    hit = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0)))
    return docs.select(F.col(id_col).alias("doc_id"), hit.alias("hit")).select("doc_id", kind_of(F.col("hit")).alias("kind"), "hit")
