"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions only.

Numbers and dates that pass their format's validation are permuted within it by a keyed Feistel network, so a value has
the same pseudonym in every document, two values never share one, and whoever holds the key can turn it back.  A format is
what can be read off the written value, and a pseudonym has the same:

* card numbers (13 to 19 digits with a right Luhn digit): first digit and layout stay, the Luhn digit is made anew;
* IBANs (check digits from 02 to 98, right mod-97 check): country and layout stay, the check digits are made anew;
* IPv4 addresses (each part up to 255, written without leading zeros): permuted among all of them;
* US social security numbers (area, group and serial in range): permuted among the valid ones;
* dates (existing days of 1900 to 2099; year-month-day, day.month.year, day/month/year; a slash date that is none of
  these but a month/day/year): order and separator stay, and so do places of one digit: the pseudonym is one of the dates
  that are written and read in the same way;
* telephone numbers (international with +, or three groups of digits): the last ten digits, layout stays;
* e-mail addresses: letters and digits of the local part, each within its class; the domain stays.

A string is split into two halves; in each round the characters of one are moved on within their class by a keyed hash
of the other.  A number below N is split into two digits of about sqrt(N) and permuted until it is in the format again
(at most 60 times; the chance that this does not do is below 10 ** -60 a value).  The key is a value of a one-row
subquery, so plans, the web interface and event logs do not show it.

Defined cases: null texts stay null, empty ones empty; null ids pass; text without a valid value stays as it is, also
where something looks like a value but is not valid; a repeated value or row is changed alike; texts of any length are
changed whole; other columns pass whatever their names, and only one named pii gives way to the result; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rheolake.llm.common import packed, table

#: For tests and examples; give a secret one for real data.
KEY = "example key"
ROUNDS = 8

_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
_IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_IP = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"
_CARD = r"(?<![\w.\-])[0-9](?:[ \-]?[0-9]){12,18}(?!\w|[.\-][0-9])"
_SSN = r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])"
_DATE = r"(?<![\w.\-/])(?:" + "|".join(rf"[0-9]{{4}}{s}[0-9]{{1,2}}{s}[0-9]{{1,2}}|[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}[0-9]{{4}}" for s in (r"\-", "/", r"\.")) + r")(?!\w|[.\-/][0-9])"
_PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{1,5}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}|(?<![.\-])[0-9]{3}[\-.][0-9]{3}[\-.][0-9]{4})(?!\w|[.\-][0-9])"
#: In this order; the first that fits at a place takes it.
KINDS = {"email": _EMAIL, "iban": _IBAN, "ip": _IP, "card": _CARD, "ssn": _SSN, "date": _DATE, "phone": _PHONE}
PATTERN = "|".join(KINDS.values())
_SSNS = 898 * 99 * 9_999


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digest(tag: str, turn: str, other: str, key: str) -> str:
    return f"sha2(concat_ws('|', {key}, '{tag}', {turn}, {other}), 256)"


def _moved(own: str, other: str, turn: str, tag: str, key: str, back: bool) -> str:
    """SQL: the characters of own, each moved on (or back) within digits, small or capital letters."""
    step = f"CAST(conv(substr({_digest(tag, turn, other, key)}, 2 * (i % 32) + 1, 2), 16, 10) AS INT)"
    c = f"substr({own}, i, 1)"
    cases = " ".join(
        f"WHEN {c} BETWEEN '{lo}' AND '{hi}' THEN chr({ord(lo)} + pmod(ascii({c}) - {ord(lo)} {'-' if back else '+'} {step}, {ord(hi) - ord(lo) + 1}))"
        for lo, hi in ("09", "az", "AZ")
    )
    return f"array_join(transform(sequence(1, length({own})), i -> CASE {cases} ELSE {c} END), '')"


def _rounds(back: bool) -> str:
    return f"sequence({ROUNDS}, 1)" if back else f"sequence(1, {ROUNDS})"


def feistel_text(value: str, tag: str, key: str, back: bool = False) -> str:
    """SQL: value with its characters permuted within their classes; back: the permutation undone."""
    half = f"(length({value}) div 2)"
    return f"""CASE WHEN length({value}) < 2 THEN {_moved(value, "''", "0", tag, key, back)} ELSE
      aggregate({_rounds(back)}, named_struct('l', substr({value}, 1, {half}), 'r', substr({value}, {half} + 1)),
        (s, k) -> CASE WHEN k % 2 = 0 THEN named_struct('l', {_moved("s.l", "s.r", "k", tag, key, back)}, 'r', s.r)
          ELSE named_struct('l', s.l, 'r', {_moved("s.r", "s.l", "k", tag, key, back)}) END,
        s -> concat(s.l, s.r)) END"""


def feistel_number(value: str, size: int | str, tag: str, key: str, valid: str = "true", back: bool = False) -> str:
    """SQL: value in [0, size) permuted among the numbers there that are valid (a condition on x); back: undone."""
    sign = "-" if back else "+"
    a = f"CAST(ceil(sqrt({size})) AS BIGINT)"
    b = f"CAST(ceil({size} / ceil(sqrt({size}))) AS BIGINT)"
    keyed = lambda x: f"CAST(conv(substr({_digest(tag, 'k', x, key)}, 1, 15), 16, 10) AS BIGINT)"
    once = f"""aggregate({_rounds(back)}, named_struct('l', x div {b}, 'r', x % {b}),
        (s, k) -> CASE WHEN k % 2 = 0 THEN named_struct('l', pmod(s.l {sign} {keyed("s.r")}, {a}), 'r', s.r)
          ELSE named_struct('l', s.l, 'r', pmod(s.r {sign} {keyed("s.l")}, {b})) END,
        s -> s.l * {b} + s.r)"""
    return f"aggregate(sequence(1, 61), CAST({value} AS BIGINT), (x, w) -> CASE WHEN w > 1 AND x < {size} AND {valid} THEN x ELSE {once} END)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _laid_out(value: str, chars: str, kind: str = "[^0-9]") -> str:
    """SQL: value with its characters outside the class kind replaced by those of chars, in order."""
    before = f"length(regexp_replace(substr({value}, 1, p - 1), '{kind}', ''))"
    return f"""array_join(transform(sequence(1, length({value})), p -> CASE WHEN substr({value}, p, 1) RLIKE '{kind}'
      THEN substr({value}, p, 1) ELSE substr({chars}, {before} + 1, 1) END), '')"""


def _luhn(digits: str, skip: int) -> str:
    """SQL: Luhn sum; skip 1 where the last digit given is the check digit, else 0."""
    d = f"CAST(substr({digits}, length({digits}) - q, 1) AS INT)"
    return f"""aggregate(sequence(0, length({digits}) - 1), 0,
      (t, q) -> t + CASE WHEN q % 2 = {skip} THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END)"""


def _mod97(code: str) -> str:
    """SQL: an IBAN (no spaces) with its first four characters moved behind, letters as two digits, modulo 97."""
    moved = f"concat(substr({code}, 5), substr({code}, 1, 4))"
    value = f"CAST(conv(substr({moved}, q, 1), 36, 10) AS BIGINT)"
    return f"""aggregate(sequence(1, length({code})), CAST(0 AS BIGINT),
      (t, q) -> (t * CASE WHEN {value} > 9 THEN 100 ELSE 10 END + {value}) % 97)"""


def _pseudonym(m: str, key: str, back: bool) -> str:
    """SQL: struct(kind, value) for a match; kind is null, and value the match, if it is not valid."""
    text = lambda value, tag: feistel_text(value, tag, key, back)
    permuted = lambda value, size, tag, valid="true": feistel_number(value, size, tag, key, valid, back)
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    same = f"named_struct('kind', CAST(NULL AS STRING), 'value', {m})"
    made = lambda kind, value: f"named_struct('kind', '{kind}', 'value', {value})"

    email = made("email", f"concat({text(f"substring_index({m}, '@', 1)", 'email')}, '@', substring_index({m}, '@', -1))")

    check = lambda body: f"lpad(98 - {_mod97(f"concat(substr(c, 1, 2), '00', {body})")}, 2, '0')"
    code = _let("b", text("substr(c, 5)", "iban"), f"concat(substr(c, 1, 2), {check('b')}, b)")
    iban = _let("c", f"replace({m}, ' ', '')", f"CASE WHEN {_mod97('c')} = 1 AND length(c) BETWEEN 15 AND 34 AND substr(c, 3, 2) BETWEEN '02' AND '98' THEN {made('iban', _let('n', code, _laid_out(m, 'n', '[ ]')))} ELSE {same} END")

    part = lambda i: f"CAST(element_at(split({m}, '[.]'), {i}) AS BIGINT)"
    address = f"(({part(1)} * 256 + {part(2)}) * 256 + {part(3)}) * 256 + {part(4)}"
    dotted = _let("x", permuted(address, 1 << 32, "ip"), "concat_ws('.', x div 16777216, x div 65536 % 256, x div 256 % 256, x % 256)")
    ip = f"CASE WHEN greatest({', '.join(part(i) for i in range(1, 5))}) < 256 AND NOT {m} RLIKE '(^|[.])0[0-9]' THEN {made('ip', dotted)} ELSE {same} END"

    inner = "substr(d, 2, length(d) - 2)"
    new = _let("b", f"concat(substr(d, 1, 1), {text(inner, 'card')})", f"concat(b, (10 - {_luhn('b', 0)} % 10) % 10)")
    card = _let("d", digits, f"CASE WHEN {_luhn('d', 1)} % 10 = 0 THEN {made('card', _let('n', new, _laid_out(m, 'n')))} ELSE {same} END")

    area, group, serial = (f"CAST(substr({m}, {i}, {n}) AS BIGINT)" for i, n in ((1, 3), (5, 2), (8, 4)))
    index = f"(({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END) * 99 + {group} - 1) * 9999 + {serial} - 1"
    shown = "x div 989901 + CASE WHEN x div 989901 >= 665 THEN 2 ELSE 1 END"
    shape = f"concat_ws('-', lpad({shown}, 3, '0'), lpad(x div 9999 % 99 + 1, 2, '0'), lpad(x % 9999 + 1, 4, '0'))"
    ssn = f"""CASE WHEN {area} NOT IN (0, 666) AND {area} < 900 AND {group} > 0 AND {serial} > 0
      THEN {made('ssn', _let('x', permuted(index, _SSNS, 'ssn'), shape))} ELSE {same} END"""

    at = lambda i: f"element_at(split({m}, '[-/.]'), {i})"
    day_of = lambda y, mo, d: f"CAST(try_to_timestamp(concat({y}, '-', lpad({mo}, 2, '0'), '-', lpad({d}, 2, '0')), 'yyyy-MM-dd') AS DATE)"
    first = f"length({at(1)}) = 4"
    forms = {"ymd": (1, 2, 3), "dmy": (3, 2, 1), "mdy": (3, 1, 2)}
    read = lambda form: day_of(*(at(i) for i in forms[form]))
    short = lambda form, n: f"length({at(forms[form][n])}) = 1"
    seen = lambda form: f"named_struct('form', '{form}', 'day', {read(form)}, 'm1', {short(form, 1)}, 'd1', {short(form, 2)})"
    found = f"CASE WHEN {first} THEN {seen('ymd')} WHEN {m} LIKE '%/%' AND {read('dmy')} IS NULL THEN {seen('mdy')} ELSE {seen('dmy')} END"
    # the dates of a form are year, month of 9 or 12, day of 9, 31 or (month first: else it were the day) 13 to 31
    form = f"named_struct('months', CAST(CASE WHEN o.m1 THEN 9 ELSE 12 END AS BIGINT), 'low', CASE WHEN o.form = 'mdy' THEN 13 ELSE 1 END, 'days', CAST(CASE WHEN o.d1 THEN 9 WHEN o.form = 'mdy' THEN 19 ELSE 31 END AS BIGINT))"
    index = "((year(o.day) - 1900) * f.months + month(o.day) - 1) * f.days + day(o.day) - f.low"
    y, mo, d = "(1900 + x div (f.months * f.days))", "(x div f.days % f.months + 1)", "(x % f.days + f.low)"
    exists = f"{d} <= day(last_day(make_date(CAST({y} AS INT), CAST({mo} AS INT), 1)))"
    moved = permuted(index, "(200 * f.months * f.days)", "date", exists)
    sep = f"substr(regexp_replace({m}, '[0-9]', ''), 1, 1)"
    two = lambda v, one: f"CASE WHEN {one} THEN CAST({v} AS STRING) ELSE lpad(CAST({v} AS STRING), 2, '0') END"
    parts = {"y": y, "m": two(mo, "o.m1"), "d": two(d, "o.d1")}
    written = "CASE o.form " + " ".join(f"WHEN '{w}' THEN concat_ws({sep}, {', '.join(parts[c] for c in w)})" for w in forms) + " END"
    date = _let("o", found, f"""
      CASE WHEN o.day BETWEEN DATE'1900-01-01' AND DATE'2099-12-31'
      THEN {made('date', _let('f', form, _let('x', moved, written)))} ELSE {same} END""")  # fmt: skip

    tail = "greatest(length(d) - 10, 0)"
    number = f"concat(substr(d, 1, {tail}), {text(f'substr(d, {tail} + 1)', 'phone')})"
    phone = _let("d", digits, f"CASE WHEN length(d) BETWEEN 8 AND 15 THEN {made('phone', _let('n', number, _laid_out(m, 'n')))} ELSE {same} END")

    branches = {"email": email, "iban": iban, "ip": ip, "card": card, "ssn": ssn, "date": date, "phone": phone}
    whens = " ".join(f"WHEN {m} RLIKE {_literal(f'^(?:{KINDS[k]})$')} THEN {branches[k]}" for k in branches)
    return f"CASE {whens} ELSE {same} END"


def pseudonymize(docs: DataFrame, key: str = KEY, back: bool = False) -> DataFrame:
    """docs with the pseudonyms in text (n_chars, if there, follows), and pii: the kinds found, in order of the text.

    back: the other way round, from pseudonyms to values.
    """
    columns, pattern = docs.columns, _literal(PATTERN)
    secret = docs.sparkSession.createDataFrame([(key,)], "secret string").scalar()
    found = docs.select(packed(columns).alias("row"), F.col("text").alias("text"), secret.alias("secret"))
    found = found.withColumn("found", F.expr(f"CASE WHEN text RLIKE '[0-9@]' THEN regexp_extract_all(text, {pattern}, 0) END"))
    made = found.withColumn("made", F.expr(f"CASE WHEN size(found) > 0 THEN transform(found, m -> {_pseudonym('m', 'secret', back)}) END"))
    changed = F.expr("exists(made, p -> p.kind IS NOT NULL)")
    woven = F.expr(f"array_join(flatten(zip_with(split(text, {pattern}, -1), made, (s, p) -> array(s, coalesce(p.value, '')))), '')")
    kinds = F.expr("coalesce(filter(transform(made, p -> p.kind), k -> k IS NOT NULL), CAST(array() AS ARRAY<STRING>))")
    new = made.select("row", changed.alias("changed"), F.when(changed, woven).otherwise(F.col("text")).alias("new"), kinds.alias("pii"))
    own = {c: F.col("row").getField(c) for c in columns}
    own["text"] = F.col("new")
    if "n_chars" in columns:
        own["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return new.select(*(own[c].alias(c) for c in columns if c.lower() != "pii"), "pii")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), F.array_join("pii", ",").alias("kinds"))
