"""Format-preserving Feistel pseudonyms for personal data (operator 8).

Found values are validated (Luhn digit of card numbers, octets of addresses, calendar
dates, ranges of social security numbers) and replaced by a value of the same format:
the digits are one number in a mixed radix, split in two halves, and a keyed Feistel
network permutes it. A permutation maps different values to different pseudonyms and
equal values to equal ones, in all documents, and check digits are made anew. E-mail
names and secrets, which have no number format, get a keyed hash of the same alphabet.
Everything is a Spark expression; no Python runs on the executors.

Defined results: a null text stays null and an empty one empty; values that fail their
validation stay; null ids stay; very long texts are read whole; equal rows give equal
rows; extra columns stay, except that a clash with the count columns is resolved for the
counts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROUNDS = 8

# Fixed formats. Each is guarded on both sides and bounded in length, so a search is linear in the text.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])(?![/.-][0-9])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])(?![.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "secret": r"(?<=[\"'])[0-9A-Fa-f]{32,128}(?=[\"'])",
}
ANY = "|".join(FORMATS[k] for k in ("email", "date", "ssn", "phone", "card", "ip", "secret"))
#: Dates are permuted within spans of this many days (about 200 years) from 1900-01-01.
DATE_SPAN = (250, 292)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(value: str, left: str, right: str, key: str, name: str) -> str:
    """SQL: a keyed permutation of the numbers 0 .. left * right - 1."""
    prf = lambda half: f"conv(substr(sha2(concat({key}, '/{name}/', i, '/', {left}, '/', {half}), 256), 1, 15), 16, 10)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast(({value}) div ({right}) as bigint), 'b', cast(({value}) % ({right}) as bigint)), "
        f"(s, i) -> if(i % 2 = 1, named_struct('a', pmod(s.a + cast({prf('s.b')} as bigint) % ({left}), {left}), 'b', s.b), "
        f"named_struct('a', s.a, 'b', pmod(s.b + cast({prf('s.a')} as bigint) % ({right}), {right}))), s -> s.a * ({right}) + s.b)"
    )


def _digits(of: str) -> str:
    return f"regexp_replace({of}, '[^0-9]', '')"


def _inlay(format_: str, digits: str) -> str:
    """SQL: the digits in the places of the format's digits."""
    return (
        f"aggregate(sequence(1, length({format_})), named_struct('t', '', 'k', 0), (s, i) -> if(substr({format_}, i, 1) between '0' and '9', "
        f"named_struct('t', concat(s.t, substr({digits}, s.k + 1, 1)), 'k', s.k + 1), named_struct('t', concat(s.t, substr({format_}, i, 1)), 'k', s.k)), s -> s.t)"
    )


def _permuted_digits(digits: str, key: str, name: str) -> str:
    """SQL: a permutation of digit strings of one length, up to 18 digits."""
    n = f"length({digits})"
    right = f"cast(power(10, {n} div 2) as bigint)"
    left = f"cast(power(10, {n} - {n} div 2) as bigint)"
    return f"lpad(cast({_feistel(f'cast({digits} as bigint)', left, right, key, name)} as string), {n}, '0')"


def _luhn(digits: str, odd: int) -> str:
    """SQL: the Luhn sum; odd: 1 if the last digit counts once, 0 if it counts twice."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if((length({digits}) - i) % 2 = {1 - odd}, cast(substr({digits}, i, 1) as int), "
        f"cast(substr('0246813579', cast(substr({digits}, i, 1) as int) + 1, 1) as int)))"
    )


def _card(m: str, key: str) -> str:
    body = f"substr({_digits(m)}, 1, length({_digits(m)}) - 1)"
    # The bodies of 13 to 19 digits have 12 to 18; they are bound once through one-element arrays.
    permuted = _permuted_digits("b", key, "card")
    return (
        f"transform(transform(array({body}), b -> {permuted}), d -> "
        f"transform(array(concat(d, cast((10 - {_luhn('d', 0)} % 10) % 10 as string))), w -> {_inlay(m, 'w')})[0])[0]"
    )


def _ip(m: str, key: str) -> str:
    number = f"aggregate(transform(split({m}, '[.]'), x -> cast(x as bigint)), 0L, (t, x) -> t * 256 + x)"
    return f"transform(transform(array({number}), v -> {_feistel('v', '65536L', '65536L', key, 'ip')}), v -> concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256))[0]"


def _phone(m: str, key: str) -> str:
    """The last ten digits are permuted; the country code stays."""
    d = _digits(m)
    return f"transform(transform(array({d}), d -> concat(substr(d, 1, length(d) - 10), transform(array(right(d, 10)), p -> {_permuted_digits('p', key, 'phone')})[0])), w -> {_inlay(m, 'w')})[0]"


def _ssn_number(m: str) -> str:
    area = f"cast(substr({m}, 1, 3) as bigint)"
    return f"(({area} - if({area} > 666, 2, 1)) * 99 + cast(substr({m}, 5, 2) as bigint) - 1) * 9999 + cast(substr({m}, 8, 4) as bigint) - 1"


def _ssn(m: str, key: str) -> str:
    area = "v div 989901"
    return (
        f"transform(transform(array({_ssn_number(m)}), v -> {_feistel('v', '898L', '989901L', key, 'ssn')}), v -> "
        f"concat(lpad(cast({area} + if({area} >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(v div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(v % 9999 + 1 as string), 4, '0')))[0]"
    )


def _date_pattern(m: str) -> str:
    day_first = f"try_to_timestamp(translate({m}, '.', '/'), 'dd/MM/yyyy') is not null"
    return f"case when substr({m}, 5, 1) = '-' then 'yyyy-MM-dd' when {day_first} then concat('dd', substr({m}, 3, 1), 'MM', substr({m}, 6, 1), 'yyyy') else concat('MM', substr({m}, 3, 1), 'dd', substr({m}, 6, 1), 'yyyy') end"


def _date_value(m: str) -> str:
    plain = f"case when substr({m}, 5, 1) = '-' then try_to_timestamp({m}, 'yyyy-MM-dd') else coalesce(try_to_timestamp(translate({m}, '.', '/'), 'dd/MM/yyyy'), try_to_timestamp(translate({m}, '.', '/'), 'MM/dd/yyyy')) end"
    return f"datediff({plain}, date'1900-01-01')"


def _date(m: str, key: str) -> str:
    a, b = DATE_SPAN
    moved = f"transform(array(cast(pmod(v, {a * b}) as bigint)), r -> {_feistel('r', f'{a}L', f'{b}L', key, 'date')})[0]"
    return (
        f"transform(transform(array({_date_value(m)}), v -> cast(floor(v / {a * b}) * {a * b} + {moved} as int)), v -> "
        f"case when substr({m}, 5, 1) = '-' then date_format(date_add(date'1900-01-01', v), 'yyyy-MM-dd') "
        f"when try_to_timestamp(translate({m}, '.', '/'), 'dd/MM/yyyy') is not null then concat(date_format(date_add(date'1900-01-01', v), 'dd'), substr({m}, 3, 1), date_format(date_add(date'1900-01-01', v), 'MM'), substr({m}, 6, 1), date_format(date_add(date'1900-01-01', v), 'yyyy')) "
        f"else concat(date_format(date_add(date'1900-01-01', v), 'MM'), substr({m}, 3, 1), date_format(date_add(date'1900-01-01', v), 'dd'), substr({m}, 6, 1), date_format(date_add(date'1900-01-01', v), 'yyyy')) end)[0]"
    )


def _email(m: str, key: str) -> str:
    return f"concat('u', substr(sha2(concat({key}, '/email/', lower({m})), 256), 1, 16), '@', substring_index({m}, '@', -1))"


def _secret(m: str, key: str) -> str:
    """Hex digits of the same number and case."""
    hashed = f"substr(concat(sha2(concat({key}, '/secret/', {m}), 512)), 1, length({m}))"
    return f"if({m} = upper({m}), upper({hashed}), {hashed})"


def _kind(m: str) -> str:
    """SQL: the kind of a found value, or null if it fails its validation."""
    whole = {k: _sql(f"^(?:{v})$") for k, v in FORMATS.items()}
    octets = f"forall(split({m}, '[.]'), x -> cast(x as int) < 256)"
    ssn = f"substr({m}, 1, 3) between '001' and '899' and substr({m}, 1, 3) <> '666' and substr({m}, 5, 2) <> '00' and substr({m}, 8, 4) <> '0000'"
    date = f"{_date_value(m)} between -73000 and 364999"
    card = f"transform(array({_digits(m)}), d -> {_luhn('d', 1)} % 10 = 0 and d rlike '[1-9]')[0]"
    return (
        f"case when {m} like '%@%' then 'email' when {m} rlike {whole['date']} then if(coalesce({date}, false), 'date', null) when {m} rlike {whole['ssn']} then if({ssn}, 'ssn', null) "
        f"when {m} rlike {whole['phone']} then 'phone' when {m} rlike {whole['card']} then if({card}, 'card', null) when {m} rlike {whole['ip']} then if({octets}, 'ip', null) "
        f"when {m} rlike '^[0-9A-Fa-f]{{32,128}}$' then 'secret' end"
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the text's personal data replaced, and counts of what was: n_email, n_ip, n_date, n_phone, n_ssn, n_card, n_secret (long).
    Who knows the key can undo the permutations, so it is the caller's and has no default."""
    if not key:
        raise ValueError("pseudonyms need a key")
    k = _sql(key)
    makers = {"email": _email, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card, "secret": _secret}
    replaced = "case x.kind " + " ".join(f"when '{name}' then {f('x.value', k)}" for name, f in makers.items()) + " else x.value end"
    any_ = _sql(ANY)
    names = [c for c in docs.columns if c not in {f"n_{n}" for n in makers}]
    df = docs.selectExpr("struct(*) as row", f"`{text}` as t")
    df = df.selectExpr("row", "t", f"if(t rlike '[0-9@]|[\"\\'][a-fA-F]{{32}}', regexp_extract_all(t, {any_}, 0), cast(array() as array<string>)) as m")
    df = df.selectExpr("row", "t", f"transform(m, m -> named_struct('value', m, 'kind', {_kind('m')})) as m")
    df = df.selectExpr("row", "t", "m", f"transform(m, x -> {replaced}) as r")
    joined = f"if(size(m) > 0, array_join(flatten(zip_with(split(t, {any_}, -1), r, (a, b) -> array(a, coalesce(b, '')))), ''), t)"
    return df.selectExpr(*[f"{joined} as `{c}`" if c == text else f"row.`{c}` as `{c}`" for c in names], *[f"cast(coalesce(size(filter(m, x -> x.kind = '{n}')), 0) as bigint) as n_{n}" for n in makers])
