"""The SQL expressions against a plain Python twin of the same networks."""

import datetime as dt
import hashlib
import random
import re

import pytest

from rheolake.llm import pii

KEY = "k'1\\"


def digest(tag, turn, other):
    return hashlib.sha256("|".join([KEY, tag, str(turn), str(other)]).encode()).hexdigest()


def moved(own, other, turn, tag):
    h, out = digest(tag, turn, other), ""
    for i, c in enumerate(own, 1):
        step = int(h[2 * (i % 32) : 2 * (i % 32) + 2], 16)
        for lo, hi in ("09", "az", "AZ"):
            if lo <= c <= hi:
                c = chr(ord(lo) + (ord(c) - ord(lo) + step) % (ord(hi) - ord(lo) + 1))
                break
        out += c
    return out


def text_net(value, tag):
    if len(value) < 2:
        return moved(value, "", 0, tag)
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    for k in range(1, pii.ROUNDS + 1):
        if k % 2 == 0:
            a = moved(a, b, k, tag)
        else:
            b = moved(b, a, k, tag)
    return a + b


def number_net(x, size, tag, valid=lambda x: True):
    a = int((size - 1) ** 0.5) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(x, b)
        for k in range(1, pii.ROUNDS + 1):
            if k % 2 == 0:
                left = (left + int(digest(tag, k, right)[:15], 16)) % a
            else:
                right = (right + int(digest(tag, k, left)[:15], 16)) % b
        x = left * b + right
        if x < size and valid(x):
            return x


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def mod97(code):
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def laid(value, chars, keep):
    it = iter(chars)
    return "".join(c if re.match(keep, c) else next(it) for c in value)


def day(y, m, d):
    try:
        found = dt.date(int(y), int(m), int(d))
    except ValueError:
        return None
    return found if 1900 <= found.year <= 2099 else None


def day_any(y, m, d):
    try:
        return dt.date(int(y), int(m), int(d))
    except ValueError:
        return None


def twin(m):
    """(kind, pseudonym) or (None, match)."""
    kind = next(k for k, p in pii.KINDS.items() if re.fullmatch(p.replace("}+@", "}@"), m, re.ASCII))
    d = re.sub(r"\D", "", m)
    if kind == "email":
        local, domain = m.split("@")
        return kind, text_net(local, kind) + "@" + domain
    if kind == "iban":
        code = m.replace(" ", "")
        if not 15 <= len(code) <= 34 or mod97(code) != 1 or not "02" <= code[2:4] <= "98":
            return None, m
        body = text_net(code[4:], kind)
        return kind, laid(m, code[:2] + f"{98 - mod97(code[:2] + '00' + body):02d}" + body, "[ ]")
    if kind == "ip":
        parts = [int(x) for x in m.split(".")]
        if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
            return None, m
        x = number_net(int.from_bytes(bytes(parts)), 1 << 32, kind)
        return kind, ".".join(str(b) for b in x.to_bytes(4))
    if kind == "card":
        if not luhn_ok(d):
            return None, m
        body = d[0] + text_net(d[1:-1], kind)
        return kind, laid(m, body + next(c for c in "0123456789" if luhn_ok(body + c)), r"\D")
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None, m
        x = number_net(((area - (2 if area > 666 else 1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, kind)
        area = x // 989901 + 1
        return kind, f"{area + (area > 665):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"
    if kind == "date":
        a, b, c = re.split("[-/.]", m)
        sep = re.sub(r"\d", "", m)[0]
        form = "ymd" if len(a) == 4 else "mdy" if sep == "/" and not day_any(c, b, a) else "dmy"
        part = dict(zip(form, (a, b, c), strict=True))
        found = day(part["y"], part["m"], part["d"])
        if found is None:
            return None, m
        months, low = 9 if len(part["m"]) == 1 else 12, 13 if form == "mdy" else 1
        days = 9 if len(part["d"]) == 1 else 19 if form == "mdy" else 31
        split = lambda x: (1900 + x // (months * days), x // days % months + 1, x % days + low)
        x = number_net(((found.year - 1900) * months + found.month - 1) * days + found.day - low, 200 * months * days, kind, lambda x: bool(day_any(*split(x))))
        new = {k: str(v).zfill(len(part[k])) for k, v in zip("ymd", split(x), strict=True)}
        return kind, sep.join(new[k] for k in form)
    if not 8 <= len(d) <= 15:
        return None, m
    cut = max(len(d) - 10, 0)
    return kind, laid(m, d[:cut] + text_net(d[cut:], kind), r"\D")


VALUES = [
    "a@b.co", "Jane.Doe-7+x@mail2.example.com", "4041894974608795", "4041-8949 7460-8795", "4041894974608796", "79927398713", "6304000000000000000",
    "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "DE89370400440532013000", "1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3.4.5",
    "078-05-1120", "666-05-1120", "899-99-9999", "001-01-0001", "900-01-0001", "2024-02-29", "2023-02-29", "1899-12-31", "2099/12/31", "1900.1.1", "31.12.1999",
    "5/7/2020", "05/7/2020", "5/07/2020", "1/31/2020", "01.2.3.4", "01.02.2003", "1.2.2003", "2020-1-2", "2020/01/2", "12/31/2020", "31/12/2020", "99/99/2020", "+1 (499) 555-6503", "+49 30 1234567", "(212) 555-0199", "212-555-0199", "212.555.0199", "+12", "12345678",
]


def test_values_against_twin(spark):
    df = spark.createDataFrame([(i, f"x {v}, y") for i, v in enumerate(VALUES)], "doc_id long, text string")
    got = {r.doc_id: (r.text, list(r.pii)) for r in pii.pseudonymize(df, KEY).collect()}
    whole = re.compile("|".join(p.replace("}+@", "}@") for p in pii.KINDS.values()), re.ASCII)
    kinds = set()
    for i, v in enumerate(VALUES):
        m = whole.search(f"x {v}, y")
        kind, new = twin(m[0]) if m else (None, v)
        want = f"x {v}, y".replace(m[0], new) if m else f"x {v}, y"
        assert got[i] == (want, [kind] if kind else []), v
        kinds.add(kind)
    assert kinds == {*pii.KINDS, None}


def written(sep, order, pads):
    """Dates of some years as written in one layout."""
    day, last, out = dt.date(1996, 1, 1), dt.date(2000, 12, 31), set()
    while day <= last:
        part = {"y": str(day.year), "m": f"{day.month:02d}" if pads[0] else str(day.month), "d": f"{day.day:02d}" if pads[1] else str(day.day)}
        out.add(sep.join(part[k] for k in order))
        day += dt.timedelta(1)
    return out


def test_pseudonyms_are_distinct_reversible_and_of_the_same_format(spark):
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    values = {x for sep in "-/." for order in ("ymd", "dmy", "mdy") if order != "mdy" or sep == "/" for pads in ((0, 0), (0, 1), (1, 0), (1, 1)) for x in written(sep, order, pads)}
    values |= {f"10.0.{i // 256}.{i % 256}" for i in range(600)} | {f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 99):02d}-{rng.randrange(1, 9999):04d}" for _ in range(300)}
    for _ in range(300):
        body = digits(15)
        number = body + next(c for c in "0123456789" if luhn_ok(body + c))
        values |= {number, "-".join(number[i : i + 4] for i in range(0, 16, 4))}
        code = "GB00WEST" + digits(14)
        values |= {f"GB{98 - mod97(code):02d}" + code[4:], f"+{digits(2)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}"}
        values |= {f"{rng.choice('abAB')}{digits(1)}.{rng.choice('xyZ')}@example.com", f"{rng.choice('abcdefgh')}@b.co"}
    rows = list(enumerate(sorted(values)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/pii-{rng.random()}"
    pii.pseudonymize(df, KEY).write.parquet(path)
    made = spark.read.parquet(path)
    got = {r.doc_id: (r.text, list(r.pii)) for r in made.collect()}
    assert len({t for t, _ in got.values()}) == len(values)
    shape = lambda x: re.sub("[0-9]", "0", x)
    for i, x in rows:
        kinds = got[i][1]
        assert len(kinds) == 1, x
        assert kinds[0] in ("ip", "iban", "email") or shape(x) == shape(got[i][0])
    again = pii.pseudonymize(made.select("doc_id", "text"), KEY, back=True)
    assert {r.doc_id: (r.text, list(r.pii)) for r in again.collect()} == {i: (x, got[i][1]) for i, x in rows}


def test_key_is_not_in_the_plan(spark, capsys):
    df = pii.pseudonymize(spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string"), "verysecret")
    df.explain("extended")
    assert "verysecret" not in capsys.readouterr().out
    assert df.first().text != "a@b.co"


def test_clashing_columns(spark):
    names = "pii, pii_text, pii_found, pii_made, pii_new, row, text_, secret, found, made, changed, new, `a.b`"
    df = spark.createDataFrame([(1, "a@b.co", *["kept"] * 13)], f"doc_id long, text string, {names.replace(',', ' string,')} string")
    got = pii.pseudonymize(df, KEY)
    assert got.columns == [c for c in df.columns if c != "pii"] + ["pii"]
    row = got.first()
    assert list(row)[2:-1] == ["kept"] * 12 and row.pii == ["email"]


def test_whole_texts_and_edges(spark):
    rng = random.Random(3)
    parts = [rng.choice(["word", "1 2 3", "é@ü", "v1.2.3", *VALUES]) for _ in range(400)]
    rows = [(1, " ".join(parts)), (2, None), (3, ""), (None, "a@b.co a@b.co"), (5, "no value 123"), (5, "no value 123"), (6, "w" * 300_000), (7, "a." * 100_000 + "@"), (8, "1 " * 100_000)]
    df = spark.createDataFrame([(*r, 9, 3) for r in rows], "doc_id long, text string, n_chars long, pii_hidden int")
    got = pii.pseudonymize(df, KEY).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].text is None and by[3].text == "" and by[5].text == "no value 123" and by[6].text == "w" * 300_000 and by[2].n_chars == 9
    one = twin("a@b.co")[1]
    assert by[None].text == f"{one} {one}" and list(by[None].pii) == ["email", "email"] and by[None].n_chars == 13
    whole = re.compile("|".join(p.replace("}+@", "}@") for p in pii.KINDS.values()), re.ASCII)
    assert by[1].text == whole.sub(lambda m: twin(m[0])[1], rows[0][1])
    assert pii.pseudonymize(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_number_network_is_a_permutation(spark, size):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(size).select(F.expr(pii.feistel_number("id", size, "t", pii._literal(KEY)))).collect()]
    assert sorted(got) == list(range(size))
    assert got == [number_net(x, size, "t") for x in range(size)]
