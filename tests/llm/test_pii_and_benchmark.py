"""Pseudonyms against a second implementation of the permutation, and benchmark search against brute force."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenq.llm import decontaminate, pii

SCHEMA = "doc_id bigint, text string, item_id string, n_found string"
KEY = "k"


def py_feistel(a, b, size_a, size_b, tweak):
    for r in range(1, pii.ROUNDS + 1):
        h = lambda v, r=r: int(hashlib.sha256(f"{KEY}|{tweak}|{r}|{v}".encode()).hexdigest()[:15], 16)
        a, b = ((a + h(b)) % size_a, b) if r % 2 else (a, (b + h(a)) % size_b)
    return a, b


def py_digits(d, tweak):
    left = len(d) // 2
    a, b = py_feistel(int(d[:left] or 0), int(d[left:]), 10**left, 10 ** (len(d) - left), f"{tweak}:{len(d)}")
    return (str(a).zfill(left) if left else "") + str(b).zfill(len(d) - left)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def replaced(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, SCHEMA), KEY).collect()}


def test_digits_match_a_second_implementation(spark):
    random.seed(1)
    values = ["".join(random.choice("0123456789") for _ in range(n)) for n in range(2, 19) for _ in range(4)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.permuted_digits(F.col("v"), KEY, F.lit("t")).alias("p")).collect()
    for r in got:
        assert r.p == py_digits(r.v, "t")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_permutation_is_one_to_one(spark, n):
    got = spark.range(10**n).select(F.lpad(F.col("id").cast("string"), n, "0").alias("v")).select(pii.permuted_digits(F.col("v"), KEY, F.lit("t")).alias("p"))
    assert got.distinct().count() == 10**n and got.where(F.length("p") != n).isEmpty()


def test_dates_are_permuted_one_to_one(spark):
    days = spark.range(0, 300 * 245, 1, 4).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    got = days.select(pii.pseudonym(F.col("v"), KEY).alias("p"))
    assert got.distinct().count() == 300 * 245 and got.where(F.try_to_date("p", "yyyy-MM-dd").isNull()).isEmpty()


def make_card(n=16):
    body = "".join(random.choice("0123456789") for _ in range(n - 1))
    return body + str(-luhn(body + "0") % 10)


def test_cards_stay_valid_and_linked(spark):
    random.seed(2)
    cards = [make_card(n) for n in (13, 15, 16, 16, 16, 19)]
    spaced = [" ".join(c[i : i + 4] for i in range(0, len(c), 4)) for c in cards]
    got = replaced(spark, [f"a {c} b" for c in cards] + [f"pay {s}, ok" for s in spaced])
    for i, c in enumerate(cards):
        new = got[i].text[2:-2]
        assert len(new) == len(c) and new != c and luhn(new) == 0
        assert re.sub(" ", "", got[i + len(cards)].text[4:-4]) == new  # separators do not unlink
        assert [len(x) for x in got[i + len(cards)].text[4:-4].split()] == [len(x) for x in spaced[i].split()]
    wrong = cards[2][:-1] + str((int(cards[2][-1]) + 1) % 10)
    assert replaced(spark, [wrong])[0].text == wrong


def iban_ok(v):
    v = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def test_formats(spark):
    texts = ["+1 (017) 555-7713", "10.0.0.255", "1984-02-29", "29.02.1984", "02/29/1984", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "Ab.C@mail7.example.com", "0" * 20 + "abcdef" * 3]
    got = {i: r.text for i, r in replaced(spark, texts).items()}
    for i, shape in enumerate([r"\+1 \(\d{3}\) \d{3}-\d{4}", r"(\d{1,3}\.){3}\d{1,3}", r"\d{4}-\d\d-\d\d", r"\d\d\.\d\d\.\d{4}", r"\d\d/\d\d/\d{4}", r"\d{3}-\d\d-\d{4}", r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", r"GB\d\dWEST\d{14}", r"u[0-9a-f]{32}@mail7\.example\.com", r"[0-9a-f]{38}"]):
        assert re.fullmatch(shape, got[i]) and got[i] != texts[i], (texts[i], got[i])
    assert all(int(o) < 256 for o in got[1].split("."))
    datetime.date.fromisoformat(got[2])
    datetime.datetime.strptime(got[3], "%d.%m.%Y")
    datetime.datetime.strptime(got[4], "%m/%d/%Y")
    assert not re.match("000|666|9", got[5]) and iban_ok(got[6]) and iban_ok(got[7])


def test_day_first_dates_stay_apart_from_month_first(spark):
    days = spark.range(0, 300 * 245, 7, 4).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    forms = days.select(F.date_format("d", "MM/dd/yyyy").alias("v")).union(days.where(F.dayofmonth("d") > 12).select(F.date_format("d", "dd/MM/yyyy")))
    got = forms.select("v", pii.pseudonym(F.col("v"), KEY).alias("p"))
    assert got.where("p is null").isEmpty() and got.select("p").distinct().count() == forms.count()
    assert replaced(spark, ["born 31/12/1999."])[0].n_found == 1


def test_phones_without_separators_and_with_single_digits(spark):
    texts = ["+14155550123", "+33 6 12 34 56 78", "+33 (0)6 12 34 56 78", "+33612345678"]
    for i, r in replaced(spark, [f"call {t}, or" for t in texts]).items():
        assert r.n_found == 1 and re.sub("[0-9]", "9", r.text) == re.sub("[0-9]", "9", f"call {texts[i]}, or")
        assert texts[i][-5:] not in r.text and r.text.startswith("call +")
    assert replaced(spark, ["+14155550123 25 people"])[0].text.endswith(" 25 people")


def test_cards_are_found_beside_other_groups(spark):
    card = "4111 1111 1111 1111"
    new = replaced(spark, [card])[0].text
    texts = ["{} 123", "{} 12/27", "7 {}", "99 88 77 {}", "{} 5", "{} {} {}", "{} 12a", "{} 123 4 5 6"]
    got = replaced(spark, [t.replace("{}", card) for t in texts])
    for i, t in enumerate(texts):
        assert (got[i].text, got[i].n_found) == (t.replace("{}", new), t.count("{}")), t
    both = replaced(spark, [f"415-555-0123 {card}", "7 " * 20_000])
    assert both[0].n_found == 2 and "555-0123" not in both[0].text and both[0].text.endswith(new)
    assert (both[1].text, both[1].n_found) == ("7 " * 20_000, 0)


def test_what_fails_validation_stays(spark):
    texts = ["2023-02-30 x", "31.02.2020", "13/45/2000", "000-12-3456", "GB83WEST12345698765432", "1.2.3.4.5", "300.1.1.1", "1234567890123456", "year 2024, 12345 pages", "a@b", "", "no digits", "3.14159 x"]
    for i, r in replaced(spark, texts).items():
        assert (r.text, r.n_found) == (texts[i], 0), texts[i]


def test_pii_edges(spark):
    rows = [(None, "mail a@b.com"), (1, None), (1, None), (2, "10.1.2.3 " * 5_000)]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.n_found for r in got) == [0, 0, 1, 5_000]
    assert len(set(next(r.text for r in got if r.doc_id == 2).split())) == 1
    assert pii.pseudonymise(spark.createDataFrame([], SCHEMA)).count() == 0


# --- a second implementation of every format, over whole texts ---------------------------------------------------------


def py_long(d, tweak):
    if len(d) <= 18:
        return py_digits(d, tweak)
    first = py_digits(d[:18], tweak + d[18:])
    return first + py_digits(d[18:], tweak + first)


def py_mask(mask, digits):
    left = iter(digits)
    return "".join(next(left) if c in "0123456789" else c for c in mask)


def py_sha(*parts):
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


FIRST = datetime.date(1900, 1, 1)


def py_date(value, form, late=False):
    try:
        day = (datetime.datetime.strptime(value, form[1]).date() - FIRST).days
    except ValueError:
        return None
    if not 0 <= day < 300 * 245:
        return None
    while True:
        a, b = py_feistel(day // 245, day % 245, 300, 245, f"date {form[0]}")
        day = a * 245 + b
        new = FIRST + datetime.timedelta(days=day)
        if not late or new.day > 12:
            return new.strftime(form[1])


def py_iban(value):
    if not 15 <= len(value.replace(" ", "")) <= 34 or not iban_ok(value):
        return None
    plain = value.replace(" ", "")
    digits = re.sub("[^0-9]", "", plain[4:])
    account = py_mask(plain[4:], py_long(digits, "iban" + plain[:2])) if len(digits) >= 2 else plain[4:]
    check = 98 - int("".join(str(int(c, 36)) for c in account + plain[:2] + "00")) % 97
    left = iter(f"{check:02d}" + account)
    return value[:2] + "".join(c if c == " " else next(left) for c in value[2:])


def py_beside(v):
    digits = re.sub("[^0-9]", "", v)
    if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", v):
        return py_date(v, ("yyyy-MM-dd", "%Y-%m-%d"))
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", v):
        area, group, serial = int(v[:3]), int(v[4:6]), int(v[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, b = py_feistel(area - 2 if area > 666 else area - 1, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{a + 2 if a + 1 >= 666 else a + 1:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if 7 <= len(digits) <= 15:
        keep = max(0, len(digits) - 10)
        return py_mask(v, digits[:keep] + py_long(digits[keep:], "phone"))
    return None


def py_pseudonym(v):
    if "@" in v:
        return "u" + py_sha(KEY, "email", v.lower())[:32] + "@" + v.rsplit("@", 1)[1]
    if re.fullmatch("[0-9a-fA-F]{32,128}", v):
        return (py_sha(KEY, "secret 0", v) + py_sha(KEY, "secret 1", v))[: len(v)]
    if re.match("[A-Z]{2}[0-9]", v):
        return py_iban(v)
    if re.fullmatch(r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}", v):
        if v[2] == v[5] == ".":
            return py_date(v, ("dd.MM.yyyy", "%d.%m.%Y"))
        if v[2] == v[5] == "/":
            return py_date(v, ("MM/dd/yyyy", "%m/%d/%Y")) or (py_date(v, ("dd/MM/yyyy", "%d/%m/%Y"), True) if v[:2] > "12" else None)
        return None
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", v) and all(int(o) < 256 and (len(o) < 3 or o[0] in "12") for o in v.split(".")):
        o = list(map(int, v.split(".")))
        a, b = py_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    return py_beside(v)


def py_run(v):
    """A run of 13 or more digits: its cards, and beside them the other formats."""
    groups = re.findall(r"[0-9]+[ \-]?", v)
    parts, i, found = [""], 0, 0
    while i < len(groups):
        for k in range(min(19, len(groups) - i), 0, -1):
            card = "".join(groups[i : i + k])
            digits = re.sub("[^0-9]", "", card)
            if 13 <= len(digits) <= 19 and luhn(digits) == 0:
                body = py_long(digits[:-1], "card")
                parts += [py_mask(card, body + str(-luhn(body + "0") % 10)), ""]
                i += k
                found += 1
                break
        else:
            parts[-1] += groups[i]
            i += 1
    if not found and len(re.sub("[^0-9]", "", v)) <= 19:
        return v, 0
    for i in range(0, len(parts), 2):
        parts[i], n = py_replaced(parts[i], pii.BESIDE, lambda x: (py_beside(x) or x, int(py_beside(x) is not None)))
        found += n
    return "".join(parts), found


def py_any(v):
    digits = re.sub("[^0-9]", "", v)
    plain = any(re.fullmatch(p, v) for p in (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9a-fA-F]{32,128}"))
    if re.fullmatch("[0-9][0-9 \\-]*", v) and not plain and len(digits) >= 13:
        return py_run(v)
    new = py_pseudonym(v)
    return (v, 0) if new is None else (new, 1)


def py_replaced(text, pattern, replace):
    out, at, n = [], 0, 0
    for m in re.finditer(pattern, text):
        new, k = replace(m[0])
        out += [text[at : m.start()], new]
        at, n = m.end(), n + k
    return "".join(out) + text[at:], n


#: The patterns as they are, but for the look that only saves time: leftmost matches begin there anyway.
PY_PATTERN = pii.PATTERN.replace(r"(?:(?<![A-Za-z0-9._%+\-])|\G)", "")


def test_every_format_against_a_second_implementation(spark):
    random.seed(5)
    digits = lambda n: "".join(random.choice("0123456789") for _ in range(n))
    day = lambda form: (FIRST + datetime.timedelta(days=random.randrange(75_000))).strftime(form)
    makers = [
        lambda: make_card(random.randrange(13, 20)),
        lambda: "-".join(re.findall(".{1,4}", make_card(16))),
        lambda: " ".join(re.findall(".{1,4}", make_card(random.choice([15, 16, 19])))) + random.choice(["", " 123", " 12/27", " 9 8"]),
        lambda: day("%Y-%m-%d"), lambda: day("%d.%m.%Y"), lambda: day("%m/%d/%Y"), lambda: day("%d/%m/%Y"),
        lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        lambda: ".".join(str(random.randrange(300)) for _ in range(4)),
        lambda: f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: "+" + digits(random.randrange(7, 16)), lambda: f"0{digits(3)}{random.choice(' -/')}{digits(7)}",
        lambda: "".join(random.choice("0123456789abcdefABCDEF") for _ in range(random.randrange(30, 131))),
        lambda: random.choice(["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "GB83WEST12345698765432", "FR1420041010050500013M02606"]),
        lambda: f"{random.choice(['Ab.c', 'x+y', '1-2_3'])}@{random.choice(['mail.example.com', 'a-b.org', 'nope', 'x.y1'])}",
        lambda: " ".join(digits(random.randrange(1, 6)) for _ in range(random.randrange(2, 12))), lambda: digits(random.randrange(1, 25)),
    ]
    between = [" ", ", ", ". ", "; ", "\n", " and ", "x", "-", "/", "(", ") ", "é", ": "]
    texts = ["".join(random.choice(between) + random.choice(makers)() for _ in range(random.randrange(1, 9))) + random.choice(between) for _ in range(1_500)]
    got = replaced(spark, texts)
    n = 0
    for i, t in enumerate(texts):
        want = py_replaced(t, PY_PATTERN, py_any)
        assert (got[i].text, got[i].n_found) == want, t
        n += want[1]
    assert n > 2_000


def test_the_query_against_a_second_implementation(spark, data, monkeypatch):
    monkeypatch.setitem(globals(), "KEY", pii.KEY)
    got = {r.doc_id: (r.text, r.n_found) for r in pii.op7_pii_pseudonyms(spark, data).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert got == {i: py_replaced(t, PY_PATTERN, py_any) for i, t in docs.items()}
    assert sum(n for _, n in got.values()) > 10


def test_phones_of_two_parts(spark):
    got = replaced(spark, ["call 0170 1234567 now", "0170/1234567", "in 2024 12345678", "+4917012345678"])
    assert [got[i].n_found for i in range(4)] == [1, 1, 0, 1] and "1234567" not in got[0].text + got[1].text


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_contaminated_against_brute_force(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) for n in (3, 5, 9, 12, 13, 20, 36, 37, 60, 140, 300)] + [None, "", " "]
    docs = [None, "", "x y", items[0], items[0].upper() + " \n"]
    for t in items[1:11]:
        words = t.split()
        for size in (0, 50, 3000):
            pad = [word() for _ in range(size)]
            docs.append(" ".join(pad[: size // 2] + words + pad[size // 2 :]))
        docs.append(" ".join(words[: int(len(words) * 0.9)] + [word() for _ in range(400)]))
        docs.append(" ".join(words[: len(words) // 2] + [word() for _ in range(700)] + words[len(words) // 2 :]))
        docs.append(" ".join(words[: int(len(words) * 0.7)] + [word() for _ in range(100)]))
    want = {}
    for i, d in enumerate(docs):
        for j, t in enumerate(items):
            own = shingles(t)
            both = len(own & shingles(d))
            if own and 100 * both >= 80 * len(own):
                want[i, j] = (both, len(own))
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(docs)], SCHEMA)
    b = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contaminated(d, b).collect()}
    assert got == want and len(want) > 30
    kept = {r.doc_id for r in d.where(~decontaminate.is_contaminated(b)).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


def test_benchmark_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 40)
    items = [(i, f"w{i} x{i} y{i} z{i} v{i} u{i}") for i in range(8)] + [(None, "no id at all here now")]
    d = spark.createDataFrame([(i, f"pre {t} post", "", "") for i, t in items if i is not None] + [(None, items[0][1], "", "")], SCHEMA)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect() if r.doc_id is not None) == [(i, i) for i in range(8)]
    assert d.where(decontaminate.is_contaminated(b)).count() == 9
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(d, empty).count() == 0 and d.where(decontaminate.is_contaminated(empty)).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([], SCHEMA), b).count() == 0


def test_secrets_of_letters_alone_are_linked_everywhere(spark):
    secret = "deadbeef" * 4
    got = replaced(spark, [f"key {secret}", f"key {secret} 1", secret, secret.upper(), "abcdef" * 5, "facade decade " * 9])
    new = got[0].text[4:]
    assert [got[i].n_found for i in range(6)] == [1, 1, 1, 1, 0, 0]
    assert got[1].text == f"key {new} 1" and got[2].text == new != secret and len(new) == 32
