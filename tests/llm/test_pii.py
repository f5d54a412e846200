import datetime
import hashlib
import random
import re

import regex

from docspark.llm.pii import PATTERN, PATTERNS, pseudonymised

KEY = "k1"


def permuted(values, bases, kind):
    for k in range(10):
        other = ",".join(str(v) for i, v in enumerate(values) if i % 2 != k % 2)
        digest = hashlib.sha512(f"{KEY}:{kind}:{k}:{','.join(map(str, bases))}:{other}".encode()).hexdigest()
        shift = lambda i: int(digest[4 * ((i // 2) % 32) :][:4], 16)
        values = [(v + shift(i)) % bases[i] if i % 2 == k % 2 else v for i, v in enumerate(values)]
    return values


def letters(text, kind):
    kinds = [(48, 10) if re.match("[0-9]", c) else (97, 26) if re.match("[a-z]", c) else (65, 26) if re.match("[A-Z]", c) else (ord(c) // 16 * 16, 16) if 127 < ord(c) < 65536 and regex.match(r"[\p{L}\p{N}]", c) else (ord(c), 1) for c in text]
    fresh = permuted([ord(c) - low for c, (low, _) in zip(text, kinds)], [b for _, b in kinds], kind)
    return "".join(chr(v + low) for v, (low, _) in zip(fresh, kinds))


def luhn(digits):
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])) % 10


def day(text):
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y", "%m/%d/%Y"):
        try:
            return datetime.datetime.strptime(text, form).date(), form
        except ValueError:
            pass
    return None, None


def replaced(t):
    is_ = lambda kind: regex.fullmatch(PATTERNS[kind], t)
    digits = [int(c) for c in t if c.isascii() and c.isdigit()]
    if "@" in t:
        return letters(t[: t.index("@")], "email") + t[t.index("@") :]
    if t[0] == "+":
        lead = len(re.match(r"[+](\d{1,3}(?=[ .(-])|\d)", t)[0])
        return t[:lead] + letters(t[lead:], "phone") if 8 <= len(digits) <= 15 else t
    if is_("ip"):
        octets = [int(x) for x in t.split(".")]
        return ".".join(map(str, permuted(octets, [256] * 4, "ip"))) if max(octets) < 256 else t
    if is_("date"):
        found, form = day(t)
        number = (found - datetime.date(1900, 1, 1)).days if found else -1
        if not 0 <= number < 73049:
            return t
        while True:
            a, b = permuted([number // 270, number % 270], [271, 270], "date")
            number = a * 270 + b
            if number < 73049:
                return (datetime.date(1900, 1, 1) + datetime.timedelta(number)).strftime(form)
    if is_("ssn"):
        return letters(t, "ssn") if re.match(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)", t) else t
    if is_("token"):
        if not (re.search("[A-Fa-f]", t) and re.search("[0-9]", t)):
            return t
        fresh = "".join("%x" % v for v in permuted([int(c, 16) for c in t], [16] * len(t), "token"))
        return fresh.upper() if re.search("[A-F]", t) else fresh
    if luhn(digits):
        return t
    fresh = permuted(digits[:-1], [10] * (len(digits) - 1), "card")
    fresh += [next(d for d in range(10) if not luhn([*fresh, d]))]
    return "".join(str(fresh.pop(0)) if c.isdigit() else c for c in t)


def brute(text):
    return text and regex.sub(PATTERN, lambda m: replaced(m[0]), text)


def run(spark, texts):
    return [r.text for r in pseudonymised(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, text string"), KEY).orderBy("n").collect()]


TEXTS = [
    None, "", "no digits", "ann.lee42@mail.example.com é.1@x.org", "+1 (017) 555-7713, +49 30 1234567", "+1 (017) 555", "1.2.3.4 300.1.1.1 1.2.3.4.5 255.255.255.255",
    "2024-02-29 2023-02-29 29.02.2024 29/02/2024 12/31/1999 31/12/1999 1899-12-31 2099-12-31", "078-05-1120 000-12-3456 666-11-2222 123-00-1234",
    "4111 1111 1111 1111, 4111111111111111; 4111-1111-1111-1111 4111111111111112", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + "A0" * 20,
    "иван.петров7@example.com ÉRIC@x.org 𝒳@x.org", "key " + "0a" * 90 + " " + "b" * 200,
    "x4111111111111111 4111111111111111y 41111111111111110000", "word " * 30000 + "a1@b.cd", "$1 \\1 it's 4111111111111111 é",
]


def test_equals_brute_force_on_cases_and_random_strings(spark):
    rng, texts = random.Random(2), list(TEXTS)
    for _ in range(400):
        parts = [rng.choice("abcé .,-/+@") if rng.random() < 0.5 else str(rng.randrange(10 ** rng.randint(1, 17))) for _ in range(rng.randint(1, 12))]
        parts.append(f" {rng.randint(1, 31):02}/{rng.randint(1, 14):02}/{rng.randint(1890, 2110)} {rng.randint(0, 260)}.{rng.randint(0, 260)}.0.9 ")
        texts.append("".join(parts))
    got = run(spark, texts)
    assert got == [brute(t) for t in texts]


def test_formats_and_links(spark):
    got = run(spark, TEXTS)
    cards = re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", got[9])
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert digits[0] == digits[1] == digits[2] != "4111111111111111" and luhn([int(c) for c in digits[0]]) == 0 and digits[3] == "4111111111111112"
    dates = got[7].split()
    assert day(dates[0])[0] == day(dates[2])[0] == day(dates[3])[0] != datetime.date(2024, 2, 29) and dates[1] == "2023-02-29" and dates[6] == "1899-12-31"
    assert got[0] is None and got[1:3] == ["", "no digits"] and "ann.lee42" not in got[3] and "@mail.example.com" in got[3]


def test_permutes_days_one_to_one(spark):
    first = datetime.date(1900, 1, 1)
    days = [(first + datetime.timedelta(i)).isoformat() for i in range(0, 73049, 37)]
    got = run(spark, days)
    assert len(set(got)) == len(days) and all("1900-01-01" <= g <= "2099-12-31" for g in got)


def test_documents_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in pseudonymised(docs, KEY, found_col="found", changed_col="source").collect()}
    for r in docs.collect():
        found = regex.findall(PATTERN, r.text)
        g = got[r.doc_id]
        assert (g.text, g.lang, g.n_chars) == (brute(r.text), r.lang, r.n_chars)
        assert (g.found, g.source) == (len(found), sum(replaced(t) != t for t in found))
    some = spark.createDataFrame([(1, "a@b.cd", "x")], "id long, text string, _id_text_t string")
    assert pseudonymised(some, KEY).columns == some.columns
    assert pseudonymised(docs.limit(0), KEY).count() == 0


def test_finds_emails_in_texts_without_digits(spark):
    texts = ["write to jane.doe@mail.example.com", "write to jane.doe@mail.example.com by 5", "no address @ all"]
    got = run(spark, texts)
    assert got == [brute(t) for t in texts] and "jane.doe" not in got[0] and got[1] == got[0] + " by 5"
    counted = pseudonymised(spark.createDataFrame([(texts[0],)], "text string"), KEY, found_col="found", changed_col="changed").first()
    assert (counted.found, counted.changed) == (1, 1)


def test_no_address_stays_in_clear(spark):
    got = run(spark, ["иван@example.com", "see ÉRIC@x.org", "иван@example.com again"])
    assert "иван" not in got[0] and "ÉRIC" not in got[1] and got[2] == got[0] + " again"
    assert [len(g) for g in got] == [16, 14, 22] and all(0x400 <= ord(c) < 0x460 for c in got[0][:4])
