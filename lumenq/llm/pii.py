"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Numbers and dates that pass their validation are permuted within their own format under a key: a card number becomes
another card number of the same length with a right check digit, a date another date of the same form. A permutation
is one to one, so equal values stay linked over all documents and different ones stay apart; it depends on the digits
and not on their separators. Texts are cut at the matches, the matches replaced, and the parts put together again, all
in one projection without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import modest_batches, read_table, text_of

#: The key of the registered query; a real run passes its own.
KEY = "demonstration key"
ROUNDS = 8
#: The formats, tried in this order at each place.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
EMAIL = r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24}"
SECRET = r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]{32})[0-9a-fA-F]{32,128}+(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
ISO_DATE = r"(?<![0-9\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
DAY_DATE = r"(?<![0-9./])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9/]|\.[0-9])"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
#: A whole run of groups of digits; cards of 13 to 19 digits are looked for from group to group.
CARD = r"(?<![0-9A-Za-z])(?=[0-9](?:[ \-]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ \-][0-9]++(?![A-Za-z]))*+"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+[0-9]{7,15}(?![0-9A-Za-z])|\+[0-9](?:[ .\-]?[0-9]){6,14}(?![0-9A-Za-z])|\+[0-9]{1,3}[ .\-]?\([0-9]\)(?:[ .\-]?[0-9]){5,11}(?![0-9A-Za-z])"
    r"|0[0-9]{1,4}[ .\-/][0-9]{5,9}(?![0-9A-Za-z])"
    r"|(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{1,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{2,4}(?:[ .\-][0-9]{2,4}){1,3}(?![0-9A-Za-z]))"
)
#: The last six begin with a digit, + or (, so that most places of a text are passed by one look.
PATTERN = f"(?:{EMAIL})|(?:{SECRET})|(?:{IBAN})|(?=[0-9+(])(?:" + "|".join(f"(?:{p})" for p in (ISO_DATE, DAY_DATE, IP, SSN, CARD, PHONE)) + ")"
#: What may stand in a run beside cards.
BESIDE = "|".join(f"(?:{p})" for p in (ISO_DATE, SSN, PHONE))
_RUN = r"[0-9][0-9 \-]*"

#: Days that dates are permuted over: 300 x 245, from 1900-01-01 to 2101-03-27.
_FIRST_DAY, _DAYS_A, _DAYS_B = "1900-01-01", 300, 245
#: Turns at most after which a day-first date has come to a day after the 12th, but for a chance below 1e-15.
_WALK = 40


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: by name the expression would be copied to every place that has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hash(key: str, tweak: Column, round_: Column, value: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: Column) -> Column:
    """struct(a, b) permuted within size_a x size_b: the halves take turns, each adding a keyed hash of the other."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 1, F.struct(F.pmod(s.a + _hash(key, tweak, r, s.b) % size_a, size_a).alias("a"), s.b.alias("b"))).otherwise(
            F.struct(s.a.alias("a"), F.pmod(s.b + _hash(key, tweak, r, s.a) % size_b, size_b).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of 2 to 36 digits permuted among the strings of its length; one digit is shifted."""
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("bigint")

    def whole(d: Column, mark: Column) -> Column:
        left = F.floor(F.length(d) / 2).cast("int")
        return _let(F.struct(d.alias("d"), left.alias("left"), (F.length(d) - left).alias("right"), F.concat(mark, F.lit(":"), F.length(d).cast("string")).alias("mark")), halves)

    def halves(x: Column) -> Column:
        first = F.coalesce(F.when(x["left"] > 0, x["d"].substr(F.lit(1), x["left"])).cast("bigint"), F.lit(0))
        out = feistel(first, x["d"].substr(x["left"] + 1, x["right"]).cast("bigint"), power(x["left"]), power(x["right"]), key, x["mark"])
        return _let(out, lambda s: F.concat(F.when(x["left"] > 0, F.lpad(s.a.cast("string"), x["left"], "0")).otherwise(F.lit("")), F.lpad(s.b.cast("string"), x["right"], "0")))

    def permuted(d: Column) -> Column:
        # over 18 digits: the first part is permuted under the second, then the second under the permuted first; else the second is empty
        return _let(whole(d.substr(1, 18), F.concat(tweak, d.substr(19, 18))), lambda p: F.when(F.length(d) <= 18, p).otherwise(F.concat(p, whole(d.substr(19, 18), F.concat(tweak, p)))))

    return _let(digits, permuted)


def _in_mask(mask: Column, digits: Column) -> Column:
    """digits put in order into the digit places of mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    filled = F.aggregate(
        F.split(mask, ""),
        start,
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s.out, digits.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s.out, c).alias("out"), s["at"].alias("at"))),
    )
    return filled.out


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is not doubled."""

    def add(s: Column, c: Column) -> Column:
        value = F.when(c == "", 0).otherwise((F.ascii(c) - 48) * F.when(s.i % 2 == 0, 1).otherwise(2))
        return F.struct((s.total + F.when(value > 9, value - 9).otherwise(value)).alias("total"), (s.i + 1).alias("i"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("total"), F.lit(0).alias("i")), add).total


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted, and the check digit made right; null if it was not."""

    def card(digits: Column) -> Column:
        body = permuted_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, F.lit("card"))
        new = _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(luhn_sum(digits) % 10 == 0, _in_mask(value, new))

    return _let(_only_digits(value), card)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits at most are permuted; what precedes them, a country code, stays."""

    def phone(digits: Column) -> Column:
        keep = F.greatest(F.length(digits) - 10, F.lit(0))
        return _in_mask(value, F.concat(digits.substr(F.lit(1), keep), permuted_digits(digits.substr(keep + 1, F.lit(10)), key, F.lit("phone"))))

    return F.when(F.length(_only_digits(value)).between(7, 15), _let(_only_digits(value), phone))


def _ip(value: Column, key: str) -> Column:
    o = [F.split_part(value, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.element_at(F.transform(F.array(out), lambda s: F.concat_ws(".", *[(x % 256 if low else F.floor(x / 256)).cast("string") for x in (s.a, s.b) for low in (False, True)])), 1)


def _ssn_valid(value: Column) -> Column:
    return value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _ssn(value: Column, key: str) -> Column:
    """Permuted over the valid numbers: 898 areas, 99 groups, 9999 serials."""
    area = value.substr(1, 3).cast("bigint")
    rest = (value.substr(5, 2).cast("bigint") - 1) * 9999 + value.substr(8, 4).cast("bigint") - 1
    out = feistel(F.when(area > 666, area - 2).otherwise(area - 1), rest, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    number = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return F.element_at(F.transform(F.array(out), lambda s: F.concat_ws("-", number(F.when(s.a + 1 >= 666, s.a + 2).otherwise(s.a + 1), 3), number(F.floor(s.b / 9999) + 1, 2), number(s.b % 9999 + 1, 4))), 1)


def _mod97(rearranged: Column) -> Column:
    """The number that a string of digits and capitals stands for, modulo 97."""
    return F.aggregate(F.split(rearranged, ""), F.lit(0), lambda s, c: F.when(c.rlike("^[0-9]$"), (s * 10 + F.ascii(c) - 48) % 97).when(c.rlike("^[A-Z]$"), (s * 100 + F.ascii(c) - 55) % 97).otherwise(s))


def _iban_valid(value: Column) -> Column:
    return _let(F.replace(value, F.lit(" "), F.lit("")), lambda plain: F.length(plain).between(15, 34) & (_mod97(F.concat(plain.substr(F.lit(5), F.length(plain) - 4), plain.substr(1, 4))) == 1))


def _iban(value: Column, key: str) -> Column:
    """The digits after the check digits are permuted, and the check digits made right."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def checked(x: Column) -> Column:
        """country and account -> check digits and account."""
        return F.concat(F.lpad((98 - _mod97(F.concat(x["account"], x["country"], F.lit("00")))).cast("string"), 2, "0"), x["account"])

    def made(x: Column) -> Column:
        digits = _only_digits(x["account"])
        new = F.when(F.length(digits) >= 2, _in_mask(x["account"], permuted_digits(digits, key, F.concat(F.lit("iban"), x["country"])))).otherwise(x["account"])
        return _let(F.struct(x["country"].alias("country"), new.alias("account")), checked)

    def spaced(plain: Column) -> Column:
        step = lambda s, c: F.when(c == " ", F.struct(F.concat(s.out, c).alias("out"), s["at"].alias("at"))).otherwise(F.struct(F.concat(s.out, plain.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        return F.concat(value.substr(1, 2), F.aggregate(F.split(value.substr(F.lit(3), F.length(value) - 2), ""), start, step).out)

    plain = F.replace(value, F.lit(" "), F.lit(""))
    return _let(_let(F.struct(plain.substr(1, 2).alias("country"), plain.substr(F.lit(5), F.length(plain) - 4).alias("account")), made), spaced)


def _date(value: Column, date: Column, form: str, key: str, late: bool = False) -> Column:
    """A date of the range, permuted within it and written in the same form; late: among the days after the 12th of a month."""
    at = lambda d: F.date_add(F.lit(_FIRST_DAY).cast("date"), d.cast("int"))
    turned = lambda d: feistel(F.floor(d / _DAYS_B), d % _DAYS_B, F.lit(_DAYS_A), F.lit(_DAYS_B), key, F.lit(f"date {form}"))
    number = lambda s: s.a * _DAYS_B + s.b

    def permuted(day: Column) -> Column:
        # permuted again until it is such a day, which keeps the permutation one to one; two days in five are not
        out = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), turned(day), lambda s, _: F.when(F.dayofmonth(at(number(s))) > 12, s).otherwise(turned(number(s)))) if late else turned(day)
        return F.when(day.between(0, _DAYS_A * _DAYS_B - 1), _let(out, lambda s: F.date_format(at(number(s)), form)))

    return _let(F.date_diff(date, F.lit(_FIRST_DAY).cast("date")), permuted)


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of a match of PATTERN; null if it fails its validation and is to stay as it is."""
    lead = lambda p: value.rlike(f"^(?:{p})$")
    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 32), F.lit("@"), F.substring_index(value, "@", -1))
    hexes = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"secret {i}"), value), 256) for i in (0, 1)]).substr(F.lit(1), F.length(value))
    separator = value.substr(3, 1)
    dots = F.when((separator == ".") & (value.substr(6, 1) == "."), _date(value, F.try_to_date(value, "dd.MM.yyyy"), "dd.MM.yyyy", key))
    # month first where it can be; day first is then a day after the 12th, and stays one, so that the two stay apart
    slash = lambda form, late: _date(value, F.try_to_date(value, form), form, key, late)
    slashes = F.when((separator == "/") & (value.substr(6, 1) == "/"), F.coalesce(slash("MM/dd/yyyy", False), F.when(value.substr(1, 2) > "12", slash("dd/MM/yyyy", True))))
    return (
        F.when(F.contains(value, F.lit("@")), email)
        .when(lead(r"[0-9a-fA-F]{32,128}"), hexes)
        .when(lead(r"[A-Z]{2}[0-9].*"), F.when(_iban_valid(value), _iban(value, key)))
        .when(lead(r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"), F.coalesce(dots, slashes))
        .when(lead(rf"{_OCTET}(?:\.{_OCTET}){{3}}"), _ip(value, key))
        .otherwise(_beside(value, key))
    )


def _beside(value: Column, key: str) -> Column:
    """The pseudonym of a match of BESIDE: an ISO date, a social security number or a phone number."""
    return (
        F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _date(value, F.try_to_date(value, "yyyy-MM-dd"), "yyyy-MM-dd", key))
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(_ssn_valid(value), _ssn(value, key)))
        .otherwise(_phone(value, key))
    )


def _replaced(text: Column, pattern: str, replace) -> Column:
    """struct(text, n): text with its matches of pattern replaced by replace, a Column function that gives such structs too."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def joined(ps: Column) -> Column:
        return F.struct(F.array_join(F.transform(ps, lambda p: F.concat(F.coalesce(p["rest"], F.lit("")), F.coalesce(p["hit"]["text"], F.lit("")))), "").alias("text"), F.aggregate(ps, F.lit(0).cast("bigint"), lambda n, p: n + F.coalesce(p["hit"]["n"], F.lit(0))).alias("n"))

    def put_together(found: Column) -> Column:
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("rest"), F.transform(found, replace).alias("hit"))
        return F.when(F.size(found) == 0, F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))).otherwise(F.element_at(F.transform(F.array(parts), joined), 1))

    # opened by transform, so that the matches are found once and replaced once, and only texts that have some are cut
    return F.element_at(F.transform(F.array(hits), put_together), 1)


def _or_as_it_is(value: Column, new: Column) -> Column:
    return F.element_at(F.transform(F.array(new), lambda v: F.struct(F.coalesce(v, value).alias("text"), v.isNotNull().cast("bigint").alias("n"))), 1)


def _cards_of(value: Column, key: str) -> Column:
    """struct(text, n): a run of 13 or more digits with its cards replaced.

    From left to right, the longest of whole groups with 13 to 19 digits and a right check digit are a card. Beside
    cards, and in runs too long for one, other formats are replaced too; a run of 13 to 19 digits that has no card stays.
    """
    mark = "\u0001"
    groups = F.regexp_extract_all(value, F.lit(r"[0-9]+[ \-]?"), F.lit(0))

    def scanned(gs: Column) -> Column:
        valid = lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
        longest = lambda i: F.get(F.filter(F.sequence(F.least(F.lit(19), F.size(gs) - i), F.lit(1)), lambda k: valid(_only_digits(F.array_join(F.slice(gs, i + 1, k), "")))), F.lit(0))

        def step(s: Column, i: Column) -> Column:
            taken = lambda k: F.when(k.isNull(), F.struct(F.concat(s.out, F.get(gs, i)).alias("out"), (i + 1).alias("next"))).otherwise(F.struct(F.concat(s.out, F.lit(mark), F.array_join(F.slice(gs, i + 1, k), ""), F.lit(mark)).alias("out"), (i + k).alias("next")))
            return F.when(i < s.next, s).otherwise(F.element_at(F.transform(F.array(longest(i)), taken), 1))

        return F.aggregate(F.sequence(F.lit(0), F.size(gs) - 1), F.struct(F.lit("").alias("out"), F.lit(0).alias("next")), step).out

    def part(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, _or_as_it_is(p, _card(p, key))).otherwise(_replaced(p, BESIDE, lambda v: _or_as_it_is(v, _beside(v, key))))

    def put_together(parts: Column) -> Column:
        stays = (F.size(parts) == 1) & (F.length(_only_digits(value)) <= 19)
        new = F.transform(parts, part)
        return F.when(stays, F.struct(value.alias("text"), F.lit(0).cast("bigint").alias("n"))).otherwise(F.element_at(F.transform(F.array(new), lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: p["text"]), "").alias("text"), F.aggregate(ps, F.lit(0).cast("bigint"), lambda n, p: n + p["n"]).alias("n"))), 1))

    marked = F.element_at(F.transform(F.array(groups), scanned), 1)
    return F.element_at(F.transform(F.array(F.split(marked, mark, -1)), put_together), 1)


def pseudonymised(text: Column, key: str = KEY) -> Column:
    """struct(text, n_found): text with every valid match replaced, and how many there were."""

    def replace(v: Column) -> Column:
        run = v.rlike(f"^{_RUN}$") & ~v.rlike(f"^(?:{ISO_DATE}|{SSN}|{SECRET})$") & (F.length(_only_digits(v)) >= 13)
        return F.when(run, _cards_of(v, key)).otherwise(_or_as_it_is(v, pseudonym(v, key)))

    found = _replaced(text, PATTERN, replace)
    # every format has a digit, an @, or 32 hex letters: other texts are not searched
    return F.when(text.rlike("[0-9@]|[a-fA-F]{32}"), F.element_at(F.transform(F.array(found), lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n_found"))), 1)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n_found")))


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_found of every row of docs.

    Dates are replaced from 1900-01-01 to 2101-03-27 and with two digits for day and month; others stay, as do phone
    numbers without an area code. Null and empty texts give an empty text and 0; very long texts are read whole. Repeated rows get a row each; a null doc_id keeps its row. What only
    looks like a number or date and fails validation stays. Other columns are ignored; an empty table gives an empty
    result.
    """
    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), pseudonymised(text_of(text_col), key).alias("p")).select("doc_id", "p.text", "p.n_found")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates, addresses and secrets replaced by pseudonyms."""
    return pseudonymise(read_table(spark, sf_dir, "documents"))
