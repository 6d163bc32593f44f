import datetime
import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from evisift.llm import pii
from evisift.llm.pii import Feistel, feistel_pseudonyms, find_values, luhn_digit, pseudonymise

KEY = b"test key"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000])
def test_feistel_is_a_permutation_without_fixed_points(n):
    net = Feistel(n, KEY, "t")
    image = [net.apply(x) for x in range(n)]
    assert sorted(image) == list(range(n))
    assert [net.undo(y) for y in image] == list(range(n))
    assert n == 1 or all(x != y for x, y in enumerate(image))
    other = Feistel(n, b"other", "t")
    assert n < 97 or image != [other.apply(x) for x in range(n)]


def test_large_domains():
    net = Feistel(16**40, KEY, "t")
    for x in (0, 1, 16**40 - 1, 12345678901234567890):
        assert 0 <= net.apply(x) < 16**40 and net.undo(net.apply(x)) == x


CASES = {
    "card": ["4111111111111111", "5500-0055-5555-5559", "3782 822463 10005"],
    "iban": ["DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "ssn": ["123-45-6789"],
    "ipv4": ["97.51.17.173", "0.0.0.0", "255.255.255.255"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0199", "+49 30 901820", "+491701234567", "+44 (0)20 7946 0018", "212-555-0199", "212.555.0199"],
    "email": ["und.34@mail7.example.com", "A_b+c@x-y.org", "zú.34@mail.de"],
    "date": ["2020-02-29", "31.12.1999", "12/31/1999", "05/12/1999"],
    "secret": ['"04dbebab91ab85687d33eeaaf9ac699e1188f962"'],
}


@pytest.mark.parametrize("kind", CASES)
def test_each_kind_keeps_its_format_and_stays_linked(kind):
    for value in CASES[kind]:
        text = f"a {value}, b {value}."
        new, spans = pseudonymise(text, KEY)
        assert [k for _, _, k in spans] == [kind, kind]
        first, second = [m for m in re.fullmatch(r"a (.*), b (.*)\.", new).groups()]
        assert first == second != value
        if kind != "ipv4":
            assert len(first) == len(value)
            assert re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", first)) == re.sub(r"[0-9]", "9", re.sub(r"[A-Za-z]", "a", value)) or kind == "secret"
        assert [k for _, _, k in find_values(new)] == [kind, kind], "the pseudonym is valid again"
        assert pseudonymise(new, KEY, undo=True)[0] == text


def test_card_is_linked_across_layouts_and_valid():
    a = pseudonymise("4111111111111111", KEY)[0]
    b = pseudonymise("4111-1111-1111-1111", KEY)[0]
    assert b.replace("-", "") == a and luhn_digit(a[:-1]) == a[-1]
    two = pseudonymise("4111111111111111 5500005555555559", KEY)[1]
    assert [k for _, _, k in two] == ["card", "card"]


@pytest.mark.parametrize("text", ["4111111111111112", "version 4.0.", "999.1.1.1", "2021-02-30", "000-12-3456", "1234567890123456", "DE00370400440532013000", "no numbers", "10 20 30", "a@b", "1111111111111111"])
def test_values_that_fail_validation_stay(text):
    assert pseudonymise(text, KEY) == (text, [])


FOLLOWED = {
    "card": ["4111111111111111"], "ssn": ["123-45-6789"], "ipv4": ["97.51.17.173"], "phone": ["(212) 555-0199", "+49 30 901820"], "email": ["A_b+c@x-y.org"],
    "iban": ["ES91 2100 0418 4502 0005 1332", "AT611904300234573201", "BE68 5390 0754 7034", "PL61109010140000071219812874", "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19"],
    "date": ["31/12/1999", "31-12-1999", "12/31/1999", "13/01/2000"],
}


@pytest.mark.parametrize("word", ["a", "is", "and", "then", "them all", "BE68 5390 0754 7034", "mail@x-y.org", "to12 3456"])
@pytest.mark.parametrize("kind", FOLLOWED)
def test_each_kind_is_found_before_a_short_word(kind, word):
    for value in FOLLOWED[kind]:
        if kind == "phone" and word[0].isdigit():
            continue
        text = f"to {value} {word}"
        new, spans = pseudonymise(text, KEY)
        assert spans[0] == (3, 3 + len(value), kind) and value not in new
        assert len(spans) == 1 + word.startswith(("BE", "mail"))
        assert pseudonymise(new, KEY, undo=True)[0] == text


def test_an_iban_behind_what_only_looks_like_one():
    assert [k for _, _, k in find_values("AB12 then this ES91 2100 0418 4502 0005 1332 and")] == ["iban"]


def test_day_first_dates_stay_day_first():
    for day in range(13, 32):
        for text in (f"{day}/01/1990", f"{day}-12-2050"):
            new = pseudonymise(text, KEY)[0]
            assert new != text and 12 < int(new[:2]) and int(new[3:5]) <= 12
            assert pseudonymise(new, KEY, undo=True)[0] == text
    assert pseudonymise("31/31/1999 and 31/02/1999", KEY)[1] == []


def test_frame_nulls_empty_long_repeats_and_clashes(spark):
    long_text = "word " * 30_000 + "97.51.17.173"
    rows = [(1, None, "x"), (2, "", "y"), (3, "ip 97.51.17.173", "z"), (3, "ip 97.51.17.173", "z"), (4, long_text, "w"), (None, "4111111111111111", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pseudonymised string")
    out = feistel_pseudonyms(df, KEY).collect()
    assert len(out) == 6 and out[0].__fields__ == ["doc_id", "text", "pseudonymised", "pii_spans"]
    by = {r.doc_id: r for r in out}
    assert by[1].pseudonymised is None and by[1].pii_spans == [] and by[2].pseudonymised == ""
    new = by[3].pseudonymised.removeprefix("ip ")
    assert by[4].pseudonymised.endswith(" " + new) and by[4].pii_spans[0].start == 150_000
    assert feistel_pseudonyms(df.limit(0), KEY).count() == 0


def test_query_covers_every_document(spark):
    got = pii.op1_feistel_pseudonyms(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    both = got.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").collect()
    assert len(both) == docs.count()
    for r in both:
        spans = find_values(r.old)
        assert r.n_replaced == len(spans) and all(r.old[s:e] not in r.text for s, e, _ in spans)
        assert pseudonymise(r.text, pii.DEMO_KEY, undo=True)[0] == r.old


LAYOUTS = {
    "phone": [
        ["+49 170 1234567", "+491701234567", "+49 (0)170 1234567", "+49-170-123-4567", "+49 (170) 123 4567"],
        ["+1 (212) 555-0199", "+12125550199", "(212) 555-0199", "212-555-0199", "212.555.0199", "+1 212 555 0199"],
        ["+420 601 123 456", "+420601123456"],
    ],
    "date": [["31/12/1999", "12/31/1999", "1999-12-31", "31.12.1999", "1999/12/31", "31-12-1999"], ["05/04/2021", "2021-05-04", "04.05.2021", "5/4/2021"]],
    "iban": [["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"]],
    "card": [["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]],
}


def plain_value(kind, text):
    """The value behind a layout, by other means than the operator's."""
    digits = "".join(c for c in text if c.isalnum())
    if kind == "date":
        a, b, c = re.findall("[0-9]+", text)
        year, rest = (a, (b, c)) if len(a) == 4 else (c, (a, b))
        day_first = len(a) < 4 and ("." in text or int(a) > 12)
        return int(year), *(int(x) for x in (rest[::-1] if day_first else rest))
    if kind == "phone":
        digits = text.replace("(0)", "")
        digits = "".join(c for c in digits if c.isdigit())
        return digits if text[0] == "+" else "1" + digits
    return digits


@pytest.mark.parametrize("kind", LAYOUTS)
def test_one_value_has_one_pseudonym_in_every_layout(kind):
    for group in LAYOUTS[kind]:
        assert len({plain_value(kind, t) for t in group}) == 1
        new = [pseudonymise(f"see {t} now", KEY) for t in group]
        assert all([k for _, _, k in spans] == [kind] for _, spans in new)
        shown = [t.removeprefix("see ").removesuffix(" now") for t, _ in new]
        values = {plain_value(kind, t) for t in shown}
        assert len(values) == 1 and values != {plain_value(kind, group[0])}
        for old, t in zip(group, shown):
            assert kind == "date" or re.sub("[0-9]", "9", t) == re.sub("[0-9]", "9", old)
            if old != "5/4/2021":  # written with two digits
                assert pseudonymise(t, KEY, undo=True)[0] == old
        if kind == "phone":
            assert {t[:3] for t in shown if t[0] == "+" and group[0][:3] == "+49"} <= {"+49"}


def test_times_and_what_is_no_telephone_number():
    new, spans = pseudonymise("at 2021-02-03T10:00:00Z", KEY)
    assert [k for _, _, k in spans] == ["date"] and new.endswith("T10:00:00Z") and "2021-02-03" not in new
    for text in ("2021-02-03Tx", "1-212-555-01990", "212-555-0199-1", "x212-555-0199", "212-555.0199", "1.212.555.0199", "212-5555-0199", "31/12/99"):
        assert pseudonymise(text, KEY) == (text, []), text


def brute_values(text):
    """Every substring of up to 40 characters with free ends, validated by the standard library; longest first at each place."""
    free = lambda c: not (c.isalnum() or c == "_")

    def kind(v):
        flat = v.replace(" ", "")
        if v.count(".") == 3:
            try:
                return "ipv4" if str(ipaddress.IPv4Address(v)) == v else None
            except ValueError:
                return None
        if len(v) == 11 and v[3:7:3] == "--" and v.replace("-", "").isdigit():
            a, g, s = map(int, v.split("-"))
            return "ssn" if 0 < a < 900 and a != 666 and g and s else None
        if v[:2].isalpha() and flat.isalnum() and flat.isascii() and len(flat) == pii.IBAN_LENGTHS.get(flat[:2].upper()):
            return "iban" if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else None
        for layout in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
            try:
                if 1900 <= datetime.datetime.strptime(v, layout).year < 2100:
                    return "date"
            except ValueError:
                pass
        return None

    out, i = [], 0
    while i < len(text):
        hit = None
        if i == 0 or free(text[i - 1]) and text[i - 1] not in "./-":
            for j in range(min(len(text), i + 40), i + 7, -1):
                if text[j - 1].isalnum() and (j == len(text) or free(text[j]) and not (text[j] in "./-" and text[j + 1 : j + 2].isdigit())) and (hit := kind(text[i:j])):
                    out.append((i, j, hit))
                    i = j
                    break
        i += hit is None
    return out


def test_values_match_a_brute_force_search():
    rng = random.Random(3)
    good = ["97.51.17.173", "123-45-6789", "ES91 2100 0418 4502 0005 1332", "GB29NWBK60161331926819", "2020-02-29", "31.12.1999", "12/31/1999", "31/12/1999"]
    bad = ["97.51.17.373", "000-45-6789", "ES92 2100 0418 4502 0005 1332", "2021-02-29", "1.2", "12", "word", "AB12", "31/31/1999", "x", "6789-1", "é"]
    for _ in range(150):
        text = "".join(rng.choice(good + bad) + rng.choice([" ", ", ", ". ", "\n", " and ", "; "]) for _ in range(rng.randrange(1, 14)))
        assert find_values(text) == brute_values(text), text
