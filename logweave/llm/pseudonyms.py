"""Format-preserving pseudonyms for personal data, in DataFrame and SQL functions only.

Every match is validated (check digits of cards and IBANs, octets of addresses, real dates, possible social security numbers) and
then permuted within its own format by a keyed Feistel network: card numbers stay card numbers with a right check digit, dates stay
dates, punctuation stays. A permutation maps equal values to equal pseudonyms and different ones to
different ones, in every document and whatever the separators, so values stay linked. Mail addresses and secrets, which have no number
format, get keyed hashes of 128 bits and more. What fails validation is ordinary text and stays. A date with slashes is read
with the month first, or with the day first where it is none otherwise.

The network alternates ``a = (a + F(b)) mod A`` and ``b = (b + F(a)) mod B`` over eight rounds, F being
HMAC-SHA-256; A and B fit the format (powers of ten for digits, 65536 for addresses, 256 x 286 days for dates from 1900 on, and
so on before and after). Every kind of value has a key of its own, derived from the caller's. The keys are data, a row that is
broadcast to the texts, and no part of any expression, so plans, explanations and event logs show none of them.

Defined results: null text stays null with 0 found, empty text stays empty; texts of any length are read whole;
repeated rows get equal texts; other columns pass through, the new ones replace clashing names; an empty table gives
an empty table.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: patterns, in order of preference at one place of a text
SECRET = r"(?<![0-9A-Za-z_\-])(?=[0-9A-Za-z_\-.+/=~]{16})(?<=(?i:token|secret|password|passwd|api.?key|access.?key)[\"']{0,1} {0,3}[=:] {0,3}[\"']{0,1})[0-9A-Za-z_\-+/][0-9A-Za-z_\-.+/=~]{14,}[0-9A-Za-z_\-+/=~]"
MAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,8}"
DATE = r"(?<![0-9A-Za-z.\-/])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[.\-/][0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
ADDRESS = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z]|-[0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){3,4}(?![0-9A-Za-z]|-[0-9])"
# a run of numbers in which cards are looked for; it ends before a number that is, or begins, something else
GROUP = r"[0-9]++(?![A-Za-z]|\.[0-9])"
CARD = rf"(?<![0-9A-Za-z.\-])(?=(?:[ \-]?[0-9]){{13}}){GROUP}(?:[ \-](?!{MAIL}|{DATE}|{SSN}|{ADDRESS}|{PHONE}){GROUP})*+"
ANY = "|".join(f"(?:{p})" for p in (SECRET, MAIL, DATE, IBAN, SSN, ADDRESS, PHONE, CARD))

#: First days of the stretches within which dates are permuted, and two factors of their lengths: until 1899, June 2100, and 9999-12-29.
DAYS = (("date'0001-01-01'", 745, 931), ("date'1900-01-01'", 256, 286), ("date'2100-06-18'", 1337, 2158))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL has no binding; a transform over one element is one."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Kinds of values, with the fields that hold their keys; dates have a kind a stretch.
KINDS = {k: k for k in ("card", "phone", "address", "iban", "ssn", "mail", "secret")} | {f"date {first}": f"date{n}" for n, (first, _, _) in enumerate(DAYS)}
#: The column of the keys while texts are replaced.
KEYS = "__pseudonym_keys"


def key_row(spark: SparkSession, key: str) -> DataFrame:
    """One row, with the two padded keys of the HMAC of every kind."""
    own = {field: hmac.digest(key.encode(), kind.encode(), hashlib.sha256).ljust(64, b"\0") for kind, field in KINDS.items()}
    values = {f"{field}_{end}": bytes(b ^ pad for b in k) for field, k in own.items() for end, pad in (("i", 0x36), ("o", 0x5C))}
    return spark.createDataFrame([(tuple(values.values()),)], f"{KEYS} struct<{', '.join(f'{name}: binary' for name in values)}>")


def _hmac(keys: str, kind: str, message: str) -> str:
    """SQL for the HMAC-SHA-256, in hexadecimal, of a string under the key of its kind."""
    own = f"{keys}.{KINDS[kind]}"
    return f"sha2(concat({own}_o, unhex(sha2(concat({own}_i, encode({message}, 'utf-8')), 256))), 256)"


def _feistel(a: str, b: str, size_a: str, size_b: str, kind: str, keys: str) -> str:
    """SQL for struct(a, b), permuted; all four are SQL for bigints."""

    def shift(other: str) -> str:
        message = f"concat_ws('|', {size_a}, {size_b}, i, {other})"
        return f"cast(conv(substr({_hmac(keys, kind, message)}, 1, 15), 16, 10) as bigint)"

    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    even = f"named_struct('a', (s.a + {shift('s.b')}) % {size_a}, 'b', s.b)"
    odd = f"named_struct('a', s.a, 'b', (s.b + {shift('s.a')}) % {size_b})"
    return f"aggregate(sequence(0, 7), {start}, (s, i) -> if(i % 2 = 0, {even}, {odd}))"


def _digits(digits: str, kind: str, keys: str) -> str:
    """SQL for a string of 2 to 36 digits, permuted among those of its length."""
    power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    u, v = "(length(d) div 2)", "(length(d) - length(d) div 2)"
    mixed = _feistel(f"substr(d, 1, {u})", f"substr(d, {u} + 1)", power(u), power(v), kind, keys)
    return _let("d", digits, _let("r", mixed, f"concat(lpad(cast(r.a as string), cast({u} as int), '0'), lpad(cast(r.b as string), cast({v} as int), '0'))"))


def _refill(shape: str, digits: str) -> str:
    """SQL for ``shape`` with its digits replaced in order by those of ``digits``."""
    seen = f"length(regexp_replace(substr({shape}, 1, p), '[^0-9]', ''))"
    return _let("n", digits, f"array_join(transform(sequence(1, length({shape})), p -> if(substr({shape}, p, 1) rlike '[0-9]', substr(n, {seen}, 1), substr({shape}, p, 1))), '')")


def _card(keys: str) -> str:
    body = _digits("substr(c, 1, length(c) - 1)", "card", keys)
    right = _let("b", body, "concat(b, filter(sequence(0, 9), k -> luhn_check(concat(b, k)))[0])")
    return _let("c", "regexp_replace(m, '[^0-9]', '')", f"if(luhn_check(c) and c rlike '[1-9]', {_refill('m', right)}, m)")


def _cards(keys: str) -> str:
    """SQL for the run of numbers ``m`` with its cards replaced, and how many: from each number on, the fewest whole numbers that make a card."""
    digits = "array_join(slice(gs, i0 + 1, j0 - i0 + 1), '')"
    card = _let("c0", digits, "length(c0) between 13 and 19 and luhn_check(c0) and c0 rlike '[1-9]'")
    ends = f"filter(sequence(i0, least(i0 + 18, size(gs) - 1)), j0 -> (i0 = 0 or get(ss, i0 - 1) = ' ') and (j0 = size(gs) - 1 or get(ss, j0) = ' ') and {card})"
    part = "array_join(flatten(transform(sequence(i0, e0), k0 -> array(gs[k0], if(k0 < e0, ss[k0], '')))), '')"
    after = lambda end: f"coalesce(get(ss, {end}), '')"
    taken = f"named_struct('r', concat(acc.r, {_let('m', part, _card(keys))}, {after('e0')}), 'n', acc.n + 1, 'next', e0 + 1)"
    passed = f"named_struct('r', concat(acc.r, gs[i0], {after('i0')}), 'n', acc.n, 'next', i0 + 1)"
    step = _let("e0", f"get({ends}, 0)", f"if(e0 is null, {passed}, {taken})")
    folded = f"aggregate(sequence(0, size(gs) - 1), named_struct('r', '', 'n', 0, 'next', 0), (acc, i0) -> if(i0 < acc.next, acc, {step}), acc -> named_struct('r', acc.r, 'n', acc.n))"
    return _let("gs", "regexp_extract_all(m, '[0-9]+', 0)", _let("ss", "regexp_extract_all(m, '[^0-9]', 0)", folded))


def _phone(keys: str) -> str:
    lead = r"regexp_extract(m, '^\\+[0-9]{1,3}(?=[^0-9])', 0)"
    rest = f"substr(m, length({lead}) + 1)"
    return _let("t", rest, f"concat({lead}, {_refill('t', _digits(r'''regexp_replace(t, '[^0-9]', '')''', 'phone', keys))})")


def _address(keys: str) -> str:
    part = lambda k: f"cast(split(m, '[.]')[{k}] as bigint)"
    mixed = _feistel(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", "address", keys)
    text = "concat_ws('.', r.a div 256, r.a % 256, r.b div 256, r.b % 256)"
    return f"if(forall(split(m, '[.]'), o -> cast(o as int) <= 255), {_let('r', mixed, text)}, m)"


def _date(keys: str) -> str:
    # month first or, where that is no date, day first
    month_first, day_first = "concat_ws('-', substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2))", "concat_ws('-', substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2))"
    american = f"m like '__/__/____' and try_cast({month_first} as date) is not null"
    iso = f"case when m like '____-__-__' then m when {american} then {month_first} else {day_first} end"
    shown = f"case when m like '____-__-__' then 'yyyy-MM-dd' when m like '__.__.____' then 'dd.MM.yyyy' when {american} then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    permuted = ""
    for first, a, b in DAYS:
        mixed = _feistel(f"n div {b}", f"n % {b}", str(a), str(b), f"date {first}", keys)
        pseudonym = _let("r", mixed, f"date_format(date_add({first}, cast(r.a * {b} + r.b as int)), {shown})")
        permuted += f" when d between {first} and date_add({first}, {a * b - 1}) then {_let('n', f'cast(datediff(d, {first}) as bigint)', pseudonym)}"
    return _let("d", f"try_cast({iso} as date)", f"case{permuted} else m end")


def _mod_97(text: str) -> str:
    """SQL for the remainder of a text of digits and capital letters, a letter counting as two digits."""
    number = "if(c rlike '[0-9]', s * 10 + cast(c as int), s * 100 + ascii(c) - 55)"
    return f"aggregate(split({text}, ''), 0, (s, c) -> if(c = '', s, ({number}) % 97))"


def _iban(keys: str) -> str:
    """Letters and country stay, the digits are permuted, and the check digits follow."""
    digits, country = "regexp_replace(substr(t, 5), '[^0-9]', '')", "substr(t, 1, 2)"
    body = _let("u", "substr(t, 5)", _refill("u", _digits(digits, "iban", keys)))
    check = _mod_97(f"concat(v, {country}, '00')")
    whole = _let("v", body, f"concat({country}, lpad(cast(98 - {check} as string), 2, '0'), v)")
    spaced = "array_join(transform(sequence(1, length(m)), p -> if(substr(m, p, 1) = ' ', ' ', substr(w, length(replace(substr(m, 1, p), ' ', '')), 1))), '')"
    valid = f"length(t) between 15 and 34 and {_mod_97('concat(substr(t, 5), substr(t, 1, 4))')} = 1 and length({digits}) >= 2"
    return _let("t", "replace(m, ' ', '')", f"if({valid}, {_let('w', whole, spaced)}, m)")


def _ssn(keys: str) -> str:
    area = "cast(substr(m, 1, 3) as bigint)"
    index = f"({area} - if({area} > 666, 2, 1))"
    mixed = _feistel(f"{index} * 99 + cast(substr(m, 5, 2) as bigint) - 1", "cast(substr(m, 8, 4) as bigint) - 1", str(898 * 99), "9999", "ssn", keys)
    new_area = "(r.a div 99 + if(r.a div 99 >= 665, 2, 1))"
    text = f"concat_ws('-', lpad(cast({new_area} as string), 3, '0'), lpad(cast(r.a % 99 + 1 as string), 2, '0'), lpad(cast(r.b + 1 as string), 4, '0'))"
    possible = f"{area} between 1 and 899 and {area} <> 666 and substr(m, 5, 2) <> '00' and substr(m, 8, 4) <> '0000'"
    return f"if({possible}, {_let('r', mixed, text)}, m)"


def replacement(keys: str) -> str:
    """SQL for the pseudonym ``r`` of the match ``m`` and the number ``n`` of values replaced."""
    hashed = lambda kind, value: _hmac(keys, kind, value)
    single = f"""case
      when m like '%@%' then concat('user-', substr({hashed('mail', 'lower(m)')}, 1, 32), '@mail.invalid')
      when m rlike {_sql('^(?:' + DATE + ')$')} then {_date(keys)}
      when m rlike {_sql('^(?:' + IBAN + ')$')} then {_iban(keys)}
      when m rlike {_sql('^(?:' + SSN + ')$')} then {_ssn(keys)}
      when m rlike {_sql('^(?:' + ADDRESS + ')$')} then {_address(keys)}
      when m rlike {_sql('^(?:' + PHONE + ')$')} then {_phone(keys)}
      else {_let('h', hashed('secret', 'm'), 'rpad(h, length(m), h)')} end"""
    others = "|".join(f"(?:{p})" for p in (DATE, IBAN, SSN, ADDRESS, PHONE))
    return f"""case when m rlike {_sql('^(?:' + CARD + ')$')} and not m rlike {_sql('^(?:' + others + ')$')} then {_cards(keys)}
      else {_let('x', single, "named_struct('r', x, 'n', cast(x <> m as int))")} end"""


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = "n_found") -> DataFrame:
    """Replace personal data in ``text_col``; ``found_col`` gets the number of values replaced."""
    text = docs[text_col]
    # most texts hold none of these characters and need no further look; each column below is read more than once, so that
    # Spark keeps the projections apart and computes it once
    hit = text.rlike("[0-9@=:]") & text.rlike(ANY)
    found, new = "__pseudonym_found", "__pseudonym_new"
    keyed = docs.crossJoin(F.broadcast(key_row(docs.sparkSession, key)))  # one row
    matched = keyed.withColumn(found, F.when(hit, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    renewed = matched.withColumn(new, F.when(F.col(found).isNotNull(), F.expr(f"transform({found}, m -> {replacement(KEYS)})")))
    pieces = F.split(renewed[text_col], ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col(new), lambda p, r: F.array(p, F.coalesce(r["r"], F.lit(""))))), "")
    columns: dict[str, Column] = {text_col: F.when(F.col(new).isNotNull(), joined).otherwise(renewed[text_col])}
    if found_col:
        changed = F.aggregate(F.col(new), F.lit(0), lambda n, r: n + r["n"])
        columns[found_col] = F.when(F.col(new).isNotNull(), changed).otherwise(F.lit(0))
    return renewed.withColumns(columns).drop(found, new, KEYS)
