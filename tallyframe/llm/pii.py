"""Format-preserving pseudonyms for personal data. DataFrame functions only.

Numbers and dates that pass validation are permuted within their own format by a keyed Feistel network, so a value gets the
same pseudonym in every document and two values of a format never get the same one: card numbers (Luhn; the check digit is made anew),
phone numbers, social security numbers (no area, group or serial that is never issued), IPv4 addresses (without leading zeros) and dates.
Days are permuted among those of 1900 to 2099 where every day can be told from the format's usual order (yyyy-MM-dd, MM/dd/yyyy, dd.MM.yyyy); what can only be
read the other way round (dd/MM/yyyy and MM.dd.yyyy of a day above 12) is permuted among the days above 12 of 1900 to April 2099, which can only be read so as well. A value is a
pair (l, r) below (a, b); each round adds a hash of the key and one half to the other half, modulo its bound, which is a bijection for any bounds and
needs no cycle walking. Mail names, which are no numbers, get a keyed name that links but isn't a permutation; their domain stays.

A text is split at what the one pattern finds, and put together again with the pseudonyms between: whole texts, one pass
each, no shuffle and no Python. A lost executor costs its running tasks.

Defined results: null text stays null, empty text empty; text without personal data is returned byte for byte; digits that fail validation
stay; adjacent and repeated values are each replaced; texts are read whole, and no pattern recurs by length, so a value of any length is found;
repeated rows each get a row; an empty table gives an empty result; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Stands in for the secret that a user passes.
KEY = "pseudonyms-1"

MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
#: With an area code in brackets; +1; 1 or none before groups parted by dots, dashes and spaces; by spaces only (an area and an office that are issued); + and another country's code, 8 to 15 digits.
PHONE = "|".join((
    r"(?:\+1[ .-]?|(?<![0-9]|[0-9][.-])1[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9-]|[0-9]\.)(?:1[ .-])?[0-9]{3}(?:[.-][0-9]{3}[ .-]| [0-9]{3}[.-])[0-9]{4}(?![0-9-]|\.[0-9])",
    r"(?<![0-9]|[0-9][ .-])(?:1 )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9]|[ .-][0-9])",
    r"(?<![0-9A-Za-z_+])\+[2-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])",
))
#: Codes of one and two digits; the others have three.
COUNTRY = "^(7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
DATE = "|".join(rf"(?<![0-9{s}])(?:[0-9]{{4}}{s}[0-9]{{2}}{s}[0-9]{{2}}|[0-9]{{2}}{s}[0-9]{{2}}{s}[0-9]{{4}})(?!{s}?[0-9]{end})" for s, end in (("-", "|-"), ("/", "|/"), (r"\.", "")))
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9]{13,19}(?![0-9])|(?<![0-9])(?:[0-9]{4} ){3}[0-9]{4}(?![0-9])|(?<![0-9])(?:[0-9]{4}-){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{4} [0-9]{6} [0-9]{4,5}(?![0-9])|(?<![0-9])[0-9]{4}-[0-9]{6}-[0-9]{4,5}(?![0-9])"
FOUND = "|".join((MAIL, IP, PHONE, DATE, SSN, CARD))
#: Nothing is found in a text without one of these.
HINT = "[0-9]{3}|@|[0-9]\\.|\\+[0-9]"
#: Days, and days above 12, are numbered from FIRST_DAY; (a, b) of their pairs.
FIRST_DAY, DAYS, LATE_DAYS = "1900-01-01", (150, 487), (210, 210)


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """The pair (l, r) below (a, b) that stands for (left, right)."""

    def step(at: Column, n: Column) -> Column:
        mask = lambda half: F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), half.cast("string"), a.cast("string"), b.cast("string")), 256), 1, 15), 16, 10).cast("long")
        l, r = at["l"], at["r"]  # noqa: E741
        return F.when(n % 2 == 1, F.struct(F.pmod(l + mask(r), a).alias("l"), r.alias("r"))).otherwise(F.struct(l.alias("l"), F.pmod(r + mask(l), b).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _padded(value: Column, n: Column | int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _with(value: Column, then) -> Column:
    """then(value), evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _filled(m: Column, digits: Column) -> Column:
    """The value with other digits in the places of its own."""
    at = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9]", ""))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)).between("0", "9"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(m, i, F.lit(1)))), "")


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    n = F.length(digits) - 1
    low = F.floor(n / 2).cast("int")
    high = n - low
    new = lambda y: F.concat(_padded(y["l"], high), _padded(y["r"], low))
    y = feistel(F.substring(digits, F.lit(1), high).cast("long"), F.substring(digits, high + 1, low).cast("long"), _power(high), _power(low), key, "card")
    check = lambda body: F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda c: F.call_function("luhn_check", c)), 1)
    made = _with(_with(_with(y, new), check), lambda c: _filled(m, c))
    return F.when(F.call_function("luhn_check", digits), made).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    given = F.regexp_replace(m, "[^0-9]", "")
    digits = F.substring(given, -10, 10)
    area, office, line = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 3), (7, 4)))
    issued = (area >= 200) & (office >= 200)
    # numbers that are never issued are permuted among themselves: no area code below 200, or else no office
    unissued = F.when(area < 200, area * 1000 + office).otherwise(200_000 + (area - 200) * 200 + office)
    y = feistel(F.when(issued, (area - 200) * 800 + office - 200).otherwise(unissued), line, F.when(issued, F.lit(640_000)).otherwise(F.lit(360_000)), F.lit(10_000), key, "phone")

    def parts(y: Column) -> Column:
        at = y["l"] - 200_000
        upper = F.when(issued, (F.floor(y["l"] / 800) + 200) * 1000 + y["l"] % 800 + 200).when(at < 0, y["l"]).otherwise((F.floor(at / 200) + 200) * 1000 + at % 200)
        return F.concat(_padded(upper, 6), _padded(y["r"], 4))

    own = _with(_with(y, parts), lambda d: _filled(m, F.concat(F.substring(given, F.lit(1), F.length(given) - 10), d)))
    return F.when(m.rlike("^\\+[2-9]"), _phone_abroad(m, given, key)).otherwise(own)


def _phone_abroad(m: Column, given: Column, key: str) -> Column:
    """The country's code stays."""
    code = F.regexp_extract(given, COUNTRY, 1)
    national = F.substring(given, F.length(code) + 1, F.length(given))
    low = F.floor(F.length(national) / 2).cast("int")
    high = F.length(national) - low
    y = feistel(F.substring(national, F.lit(1), high).cast("long"), F.substring(national, high + 1, low).cast("long"), _power(high), _power(low), key, "phone")
    return _with(_with(y, lambda y: F.concat(code, _padded(y["l"], high), _padded(y["r"], low))), lambda d: _filled(m, d))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda x: x.cast("long"))
    y = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], F.lit(65536), F.lit(65536), key, "ip")
    made = _with(y, lambda y: F.concat_ws(".", *(x.cast("string") for h in (y["l"], y["r"]) for x in (F.floor(h / 256), h % 256))))
    return F.when(F.forall(octets, lambda x: x <= 255) & ~m.rlike("(^|[.])0[0-9]"), made).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    y = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def parts(y: Column) -> Column:
        at = F.floor(y["l"] / 99)
        return F.concat_ws("-", _padded(F.when(at >= 665, at + 2).otherwise(at + 1), 3), _padded(y["l"] % 99 + 1, 2), _padded(y["r"] + 1, 4))

    return F.when(valid, _with(y, parts)).otherwise(m)


def _late_day(at: Column) -> Column:
    """The date of a number that counts the days above 12 only: months have 16 to 19 of them, so the month is near at / 18.44."""
    first = F.to_date(F.lit(FIRST_DAY))
    before = lambda k: F.datediff(F.add_months(first, k), first) - 12 * k
    guess = F.floor(at / 18.4375).cast("int")
    month = F.array_max(F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), guess + 2), lambda k: before(k) <= at))
    return _with(month, lambda k: F.date_add(F.add_months(first, k), (at - before(k) + 12).cast("int")))


def _date(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    year_first, dotted, by_month, by_day = F.substring(m, 5, 1).rlike("[^0-9]"), m.contains("."), F.try_to_date(digits, "MMddyyyy"), F.try_to_date(digits, "ddMMyyyy")
    usual = F.when(year_first, F.try_to_date(digits, "yyyyMMdd")).when(dotted, by_day).otherwise(by_month)
    first = F.to_date(F.lit(FIRST_DAY))
    written = lambda day, turned: F.when(year_first, F.date_format(day, "yyyyMMdd")).when(dotted == F.lit(turned), F.date_format(day, "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy"))

    def made(at: Column, bounds: tuple[int, int], day_of, turned: bool) -> Column:
        a, b = bounds
        y = _with(feistel(F.floor(at / b), at % b, F.lit(a), F.lit(b), key, "late day" if turned else "date"), lambda y: y["l"] * b + y["r"])
        return F.when((at >= 0) & (at < a * b), _with(_with(y, day_of), lambda day: _filled(m, written(day, turned)))).otherwise(m)

    late = F.when(dotted, by_month).otherwise(by_day)
    months = (F.year(late) - 1900) * 12 + F.month(late)
    out = F.when(usual.isNotNull(), made(F.datediff(usual, first).cast("long"), DAYS, lambda y: F.date_add(first, y.cast("int")), False))
    out = out.when(~year_first & late.isNotNull(), made((F.datediff(late, first) - 12 * months).cast("long"), LATE_DAYS, _late_day, True))
    return F.coalesce(out, m)


def _mail(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(m)), 256), 1, 12), F.lit("@"), F.substring_index(m, "@", -1))


KINDS = (("mail", MAIL, _mail), ("ip", IP, _ip), ("phone", PHONE, _phone), ("date", DATE, _date), ("ssn", SSN, _ssn), ("card", CARD, _card))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """What stands for one value that the pattern found."""
    out = m
    for _, pattern, made in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{pattern})$"), made(m, key)).otherwise(out)
    return out


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """The text with pseudonyms."""
    values = F.transform(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda m: pseudonym(m, key))
    joined = F.array_join(F.zip_with(F.split(text, FOUND, -1), values, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit("")))), "")
    return F.when(text.rlike(HINT), joined).otherwise(text)


def with_pseudonyms(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with the text column pseudonymised."""
    return docs.withColumn(text_col, pseudonymised(F.col(text_col), key))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data."""
    return with_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))
