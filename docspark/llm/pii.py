"""Format-preserving pseudonyms for personal data by keyed Feistel permutation.

Found are e-mail addresses, international phone numbers, IPv4 addresses, payment card numbers, US social security
numbers, dates and hexadecimal tokens of 32 digits or more. Numbers and dates must be valid: cards pass the Luhn test,
octets are below 256, dates exist between 1900 and 2099, phones have 8 to 15 digits. What is found becomes a vector of
digits, each with its own base (10 for digits, 26 for ASCII letters, 16 for other letters and digits, which stay within
their row of 16 characters, and in tokens, 256 for octets, 271 and 270 for the number of a day); an alternating Feistel network of ROUNDS rounds permutes the vectors of one shape and kind: in each
round the digits at even or odd places are shifted, modulo their bases, by SHA-512 of the key, kind, round and the other
half. So a value has the same pseudonym in every document, different values have different ones, separators, case and
length stay, cards pass the Luhn test again, and a date has the same pseudonym in any notation.

Only built-in SQL functions are used. Texts without a digit or @ are passed on after one quick look. The key is part of the
plan, as SQL has no other place for it: plans and event logs are as secret as the key, or `spark.sql.redaction.string.regex`
is set to hide it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
_OPEN, _SHUT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: What may be personal data, by kind, in the order in which alternatives are tried.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}" + _SHUT,
    "ip": _OPEN + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)" + _SHUT,
    "date": _OPEN + r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _SHUT,
    "ssn": _OPEN + r"\d{3}-\d{2}-\d{4}(?!-?\d)" + _SHUT,
    "token": _OPEN + r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})" + _SHUT,
    "card": _OPEN + r"\d(?:[ -]?\d){12,18}" + _SHUT,
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DAYS, _WIDE, _NARROW = 73049, 271, 270  # days from 1900-01-01 to 2099-12-31; their numbers fit into 271 * 270


def _text(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\") + '"'


def permuted(values: str, bases: str, kind: str, key: str) -> str:
    """SQL of the permuted vector of two SQL names or expressions of array<int>."""
    other = "array_join(transform(filter(acc, (x, i) -> i % 2 <> k % 2), x -> string(x)), ',')"
    digest = f"sha2(concat_ws(':', {_text(key)}, '{kind}', string(k), array_join(transform(b, x -> string(x)), ','), {other}), 512)"
    shift = "cast(conv(substring(h, 4 * ((i div 2) % 32) + 1, 4), 16, 10) as int)"
    turn = f"transform(acc, (x, i) -> if(i % 2 = k % 2, cast((x + {shift}) % get(b, i) as int), x))"
    step = f"element_at(transform(array({digest}), h -> {turn}), 1)"
    return f"element_at(transform(array({bases}), b -> aggregate(sequence(0, {ROUNDS - 1}), {values}, (acc, k) -> {step})), 1)"


def _letters(text: str, kind: str, key: str) -> str:
    """SQL of a text whose letters and digits are permuted, each within its class; others, and letters outside the basic
    plane of Unicode, stay."""
    chars = f"split({text}, '')"
    wide = r"ascii(c) between 128 and 65535 and c rlike r'^[\p{L}\p{N}]$'"
    values = f"transform({chars}, c -> case when c rlike '^[0-9]$' then cast(c as int) when c rlike '^[a-z]$' then ascii(c) - 97 when c rlike '^[A-Z]$' then ascii(c) - 65 when {wide} then ascii(c) % 16 else 0 end)"
    bases = f"transform({chars}, c -> case when c rlike '^[0-9]$' then 10 when c rlike '^[a-zA-Z]$' then 26 when {wide} then 16 else 1 end)"
    shown = f"case when c rlike '^[0-9]$' then string(v) when c rlike '^[a-z]$' then char(v + 97) when c rlike '^[A-Z]$' then char(v + 65) when {wide} then decode(unhex(lpad(hex(ascii(c) - ascii(c) % 16 + v), 4, '0')), 'UTF-16BE') else c end"
    return f"array_join(zip_with({chars}, {permuted(values, bases, kind, key)}, (c, v) -> {shown}), '')"


def _luhn(digits: str, first: int) -> str:
    """SQL of the Luhn sum of an array of digits; `first` is 1 if the last one is doubled."""
    doubled = "if(2 * x > 9, 2 * x - 9, 2 * x)"
    return f"aggregate(transform(reverse({digits}), (x, i) -> if((i + {first}) % 2 = 1, {doubled}, x)), 0, (s, x) -> s + x)"


def _card(text: str, key: str) -> str:
    digits = f"transform(split(regexp_replace({text}, '[^0-9]', ''), ''), c -> cast(c as int))"
    body = "slice(d, 1, size(d) - 1)"
    fresh = permuted(body, f"transform({body}, x -> 10)", "card", key)
    closed = f"element_at(transform(array({fresh}), p -> concat(p, array(cast((10 - {_luhn('p', 1)} % 10) % 10 as int)))), 1)"
    # the digit for a place is the one after as many digits as the text has before
    filled = f"array_join(transform(split({text}, ''), (c, i) -> if(c rlike '^[0-9]$', string(get(n, length(regexp_replace(substring({text}, 1, i), '[^0-9]', '')))), c)), '')"
    return f"element_at(transform(array({digits}), d -> if({_luhn('d', 0)} % 10 = 0, element_at(transform(array({closed}), n -> {filled}), 1), {text})), 1)"


def _ip(text: str, key: str) -> str:
    octets = f"transform(split({text}, '[.]'), x -> cast(x as int))"
    return f"if(forall({octets}, x -> x < 256), array_join(transform({permuted(octets, 'array(256, 256, 256, 256)', 'ip', key)}, x -> string(x)), '.'), {text})"


def _date(text: str, key: str) -> str:
    forms = ((r"^\d{4}-", "yyyy-MM-dd"), (r"/", "dd/MM/yyyy"), (r"\.", "dd.MM.yyyy"))
    day = "case " + " ".join(f"when {text} rlike {_text(p)} then to_date(try_to_timestamp({text}, '{f}'))" for p, f in forms) + " end"
    day = f"coalesce({day}, if({text} rlike '/', to_date(try_to_timestamp({text}, 'MM/dd/yyyy')), null))"
    number = f"datediff({day}, date'1900-01-01')"
    once = f"element_at(transform(array({permuted(f'array(cast(z div {_NARROW} as int), z % {_NARROW})', f'array({_WIDE}, {_NARROW})', 'date', key)}), w -> w[0] * {_NARROW} + w[1]), 1)"
    # numbers beyond the last day are permuted again; of 8 tries the first that is a day counts
    step = f"element_at(transform(array(a[0]), z -> element_at(transform(array({once}), y -> array(y, if(y < {_DAYS}, 0, 1))), 1)), 1)"
    walked = f"aggregate(sequence(1, 8), array(n, 1), (a, s) -> if(a[1] = 0, a, {step}), a -> a[0])"
    shown = "case " + " ".join(f"when {text} rlike {_text(p)} then date_format(q, '{f}')" for p, f in forms[:1] + forms[2:]) + f" when to_date(try_to_timestamp({text}, 'dd/MM/yyyy')) is null then date_format(q, 'MM/dd/yyyy') else date_format(q, 'dd/MM/yyyy') end"
    return f"element_at(transform(array({number}), n -> if(n between 0 and {_DAYS - 1}, element_at(transform(array(date_add(date'1900-01-01', {walked})), q -> {shown}), 1), {text})), 1)"


def _token(text: str, key: str) -> str:
    values = f"transform(split({text}, ''), c -> cast(conv(c, 16, 10) as int))"
    shown = f"array_join(transform({permuted(values, f'transform({values}, x -> 16)', 'token', key)}, x -> lower(hex(x))), '')"
    return f"if({text} rlike '[A-F]', upper({shown}), {shown})"


def _replaced(t: str, key: str) -> str:
    """SQL of the pseudonym of a found string, or itself if it isn't valid."""
    matches = lambda kind: f"{t} rlike {_text('^(?:' + PATTERNS[kind] + ')$')}"
    at = f"locate('@', {t})"
    country = f"length(regexp_extract({t}, {_text(r'^[+]([0-9]{1,3}(?=[ .(-])|[0-9])')}, 0))"
    digits = f"length(regexp_replace({t}, '[^0-9]', ''))"
    return f"""case when {t} rlike '@' then concat({_letters(f"substring({t}, 1, {at} - 1)", 'email', key)}, substring({t}, {at}))
        when {t} rlike '^[+]' then if({digits} between 8 and 15, concat(substring({t}, 1, {country}), {_letters(f"substring({t}, {country} + 1)", 'phone', key)}), {t})
        when {matches('ip')} then {_ip(t, key)}
        when {matches('date')} then {_date(t, key)}
        when {matches('ssn')} then if({t} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', {_letters(t, 'ssn', key)}, {t})
        when {matches('token')} then if({t} rlike '[A-Fa-f]' and {t} rlike '[0-9]', {_token(t, key)}, {t})
        else {_card(t, key)} end"""


def pseudonymised(docs: DataFrame, key: str, *, text_col: str = "text", found_col: str | None = None, changed_col: str | None = None) -> DataFrame:
    """The rows of `docs`, all columns as they are, with pseudonyms in the text.

    found_col and changed_col, where named, get the numbers of strings that look like personal data and of those replaced.
    Defined results: null stays null, empty texts and texts without personal data stay as they are; rows are never
    dropped or moved; the same key gives the same pseudonyms, and one that holds both kinds of quotes is refused.
    """
    if "'" in key and '"' in key:
        raise ValueError("the key must not hold both kinds of quotes")
    pattern, text = _text(PATTERN), f"`{text_col}`"
    tokens = f"regexp_extract_all({text}, {pattern}, 0)"
    work = f"named_struct('t', {tokens}, 'r', transform({tokens}, t -> {_replaced('t', key)}))"
    looked = F.expr(f"case when {text} rlike '[0-9@]' then {work} end")
    name = "_" + "_".join(docs.columns)  # no column has this name
    joined = f"array_join(zip_with(split({text}, {pattern}, -1), `{name}`.r, (g, t) -> concat(g, coalesce(t, ''))), '')"
    out = docs.withColumn(name, looked)
    columns = [F.expr(f"case when size(`{name}`.t) > 0 then {joined} else {text} end").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in (found_col, changed_col)]
    if found_col:
        columns.append(F.expr(f"cast(coalesce(size(`{name}`.t), 0) as bigint)").alias(found_col))
    if changed_col:
        columns.append(F.expr(f"cast(coalesce(size(filter(`{name}`.r, (x, i) -> x <> get(`{name}`.t, i))), 0) as bigint)").alias(changed_col))
    return out.select(columns)
