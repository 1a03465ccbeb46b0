"""PII pseudonyms that keep their format, with DataFrame functions only.

Private values are found by pattern and validated: e-mail addresses; card numbers (13 to 19 digits,
Luhn); IBANs (the length of their country, mod 97); US social security numbers (an area, group and serial
that are given out); telephone numbers (with a country code 8 to 15 digits, after +1 and without a code 10);
IPv4 addresses (octets to 255); calendar dates from 1700 to 2099. Each is replaced by a keyed Feistel permutation of its kind's own
format, so equal values get equal pseudonyms in every document, different ones different ones, and the
pseudonym validates again: check digits are recomputed, dates stay dates. Separators, letter case,
country codes and mail domains stay. Text around them is untouched; numbers that fail validation stay.
Where a run of digits fails as a card, its groups are tried: neighbouring groups that make a valid card
number are one, those of 16 digits first, then from the left, the longest first.

A string permutation halves the string by characters and, in ROUNDS rounds, shifts each letter or digit
of one half within a-z, A-Z or 0-9 by a SHA-512 stream over the key, the round and the other half.
Addresses, dates and social security numbers are permuted as numbers in Z_a x Z_b with a * b equal to the
size of the domain (65,536 x 65,536; 189 x 773 = 146,097 days; 29,634 x 29,997 = 898 areas x 99 groups x
9,999 serials), so every output is valid without cycle walking.

The key comes from the caller. Plans hold its SHA-256, from which pseudonyms can be made again: treat plans
and event logs of such a job like the key.

Edges: a null text stays null, an empty one empty; counts are then 0. Texts of any length are read
whole. Values are replaced left to right without overlap. Empty tables give empty results; other
columns, whatever their names, are carried through as they are, but one named like a count is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes of telephone numbers; others have three digits.
SHORT_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
CARD = r"(?<![A-Za-z0-9.+-])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])"
GROUPS = r"(?<![A-Za-z0-9.+-])[0-9]+(?:[ -][0-9]+)+(?![A-Za-z0-9])"
IPV4 = rf"(?<![A-Za-z0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![A-Za-z0-9]|\.[0-9])"
DATE = r"(?<![A-Za-z0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![A-Za-z0-9]|[./-][0-9])"
SSN = r"(?<![A-Za-z0-9.+-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9]|-[0-9])"
PHONE = r"(?<![A-Za-z0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9(+])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9.+-])[0-9]{3}([-. ])[0-9]{3}\3[0-9]{4}(?![A-Za-z0-9]|[.-][0-9])"
ANY = "|".join((EMAIL, IBAN, IPV4, DATE, SSN, PHONE, CARD))

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _digest(key: str) -> str:
    """What enters the streams instead of the key: of any key, text that is safe in SQL."""
    return hashlib.sha256(key.encode()).hexdigest()


def _text_half(half: str, other: str, kind: str, r: str, key: str) -> str:
    """SQL: `half` with each letter and digit shifted by the stream of the other half."""
    stream = f"sha2(concat_ws('|', '{_digest(key)}', {kind}, {r}, {other}), 512)"
    shift = "cast(conv(substr(h, 4 * ((j - 1) % 32) + 1, 4), 16, 10) as int)"
    char = f"""case when c between '0' and '9' then chr(48 + (ascii(c) - 48 + {shift}) % 10)
        when c between 'a' and 'z' then chr(97 + (ascii(c) - 97 + {shift}) % 26)
        when c between 'A' and 'Z' then chr(65 + (ascii(c) - 65 + {shift}) % 26) else c end"""
    char = char.replace(" h,", " q.h,").replace("(h,", "(q.h,").replace("between", "BETWEEN")
    one = f"transform(array(substr(q.x, j, 1)), c -> {char})[0]"
    return f"transform(array(named_struct('h', {stream}, 'x', {half})), q -> if(length(q.x) = 0, '', array_join(transform(sequence(1, greatest(length(q.x), 1)), j -> {one}), '')))[0]"


def permuted(x: str, kind: str, key: str) -> str:
    """SQL: the keyed format-preserving permutation of string expression `x` within `kind`."""
    at = f"cast(length({x}) div 2 as int)"
    step = f"if(r % 2 = 0, named_struct('a', {_text_half('s.a', 's.b', kind, 'r', key)}, 'b', s.b), named_struct('a', s.a, 'b', {_text_half('s.b', 's.a', kind, 'r', key)}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', substr({x}, 1, {at}), 'b', substr({x}, {at} + 1)), (s, r) -> {step}, s -> concat(s.a, s.b))"


def permuted_number(x: str, a: int, b: int, kind: str, key: str) -> str:
    """SQL: a keyed permutation of the number `x` within 0 .. a * b - 1."""
    f = lambda other, m: f"cast(conv(substr(sha2(concat_ws('|', '{_digest(key)}', {kind}, r, {other}), 256), 1, 14), 16, 10) as bigint) % {m}"
    step = f"if(r % 2 = 0, named_struct('a', (s.a + {f('s.b', a)}) % {a}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {f('s.a', b)}) % {b}))"
    start = f"named_struct('a', cast({x} as bigint) div {b}, 'b', cast({x} as bigint) % {b})"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> s.a * {b} + s.b)"


def _luhn(d: str, first: int) -> str:
    """SQL: the Luhn sum of digit string `d` whose last digit has weight `first` (1 or 2)."""
    return f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + (case when (length({d}) - i) % 2 = {2 - first} then case when 2 * cast(substr({d}, i, 1) as int) > 9 then 2 * cast(substr({d}, i, 1) as int) - 9 else 2 * cast(substr({d}, i, 1) as int) end else cast(substr({d}, i, 1) as int) end))"


def _refilled(shape: str, digits: str) -> str:
    """SQL: `shape` with its digits replaced in turn by those of `digits`."""
    return f"aggregate(sequence(1, length({shape})), named_struct('o', '', 'd', {digits}), (s, i) -> if(substr({shape}, i, 1) BETWEEN '0' AND '9', named_struct('o', concat(s.o, substr(s.d, 1, 1)), 'd', substr(s.d, 2)), named_struct('o', concat(s.o, substr({shape}, i, 1)), 'd', s.d)), s -> s.o)"


def _iban_mod(x: str) -> str:
    """SQL: the mod 97 of an IBAN without blanks, whose first four characters count last."""
    moved = f"concat(substr({x}, 5), substr({x}, 1, 4))"
    return f"aggregate(sequence(1, length({x})), 0, (t, i) -> transform(array(substr({moved}, i, 1)), c -> if(c BETWEEN 'A' AND 'Z', (t * 100 + ascii(c) - 55) % 97, (t * 10 + cast(c as int)) % 97))[0])"


def _date_parts(m: str) -> str:
    """SQL: struct(d date, y, k) of a date text; k is ymd, dmy or mdy, d null where it is no date."""
    n = f"transform(split({m}, '[-/.]'), p -> cast(p as int))"
    made = lambda y, mo, d: f"try_cast(concat(lpad(n[{y}], 4, '0'), '-', lpad(n[{mo}], 2, '0'), '-', lpad(n[{d}], 2, '0')) as date)"
    ymd = f"length(split({m}, '[-/.]')[0]) = 4"
    return f"transform(array({n}), n -> if({ymd}, named_struct('d', {made(0, 1, 2)}, 'k', 'ymd'), if(n[1] <= 12, named_struct('d', {made(2, 1, 0)}, 'k', 'dmy'), named_struct('d', {made(2, 0, 1)}, 'k', 'mdy'))))[0]"


def kind_of() -> str:
    """SQL over a lambda variable m: the kind of a matched text, null where it fails validation."""
    bare = "replace(m, ' ', '')"
    return f"""case
        when instr(m, '@') > 0 then 'email'
        when m rlike '^[A-Z]' then case when {_iban_mod(bare)} = 1 then 'iban' end
        when m rlike '^{OCTET}([.]{OCTET}){{3}}$' then 'ip'
        when m rlike '^([0-9]{{4}}([-/.])[0-9]{{1,2}}[-/.][0-9]{{1,2}}|[0-9]{{1,2}}([-/.])[0-9]{{1,2}}[-/.][0-9]{{4}})$' then
            case when transform(array({_date_parts('m')}), p -> p.d BETWEEN date'1700-01-01' AND date'2099-12-31')[0] then 'date' end
        when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then 'ssn'
        when m rlike '^[+]' then case when m not rlike '^[+]0' and length({_digits('m')}) between 8 and 15 then 'phone' end
        when m rlike '^[(]' or m rlike '^[0-9]{{3}}([-. ])[0-9]{{3}}[-. ][0-9]{{4}}$' then 'phone'
        when {_luhn(_digits('m'), 1)} % 10 = 0 then 'card' end"""


def _card(key: str) -> str:
    """SQL over lambda variables m and k = 'card': the pseudonym of a card number."""
    d = _digits("m")
    card = f"transform(array({permuted(f'substr({d}, 1, length({d}) - 1)', 'k', key)}), b -> concat(b, cast((10 - {_luhn('b', 2)} % 10) % 10 as string)))[0]"
    return _refilled("m", card)


def _cards_inside(run: str, key: str) -> str:
    """SQL: struct(s, n) of `run`, groups of digits with a blank or hyphen between: the run with its cards replaced, and their number."""
    window = "named_struct('a', a, 'e', e, 'm', array_join(slice(g, a, e - a + 1), ''))"
    found = f"flatten(transform(filter(sequence(1, size(g)), a -> a % 2 = 1), a -> transform(filter(sequence(a, least(size(g), a + 36)), e -> e % 2 = 1), e -> {window})))"
    sized = f"filter(transform({found}, w -> named_struct('d', {_digits('w.m')}, 'a', w.a, 'e', w.e, 'm', w.m)), w -> length(w.d) BETWEEN 13 AND 19)"
    ranked = f"array_sort(transform(filter({sized}, w -> {_luhn('w.d', 1)} % 10 = 0), w -> named_struct('odd', length(w.d) <> 16, 'a', w.a, 'less', -w.e, 'm', w.m)))"
    kept = f"aggregate({ranked}, cast(array() as array<struct<odd: boolean, a: int, less: int, m: string>>), (u, w) -> if(exists(u, h -> h.a <= -w.less AND w.a <= -h.less), u, concat(u, array(w))))"
    new = f"transform(array(w.m), m -> transform(array('card'), k -> {_card(key)})[0])[0]"
    made = f"transform({kept}, w -> named_struct('a', w.a, 'e', -w.less, 'new', {new}))"
    text = "array_join(transform(g, (x, at) -> coalesce(if(exists(f, w -> w.a = at + 1), filter(f, w -> w.a = at + 1)[0].new, if(exists(f, w -> at + 1 BETWEEN w.a AND w.e), '', x)), x)), '')"
    return f"transform(array(regexp_extract_all({run}, '[0-9]+|[ -]', 0)), g -> transform(array({made}), f -> named_struct('s', {text}, 'n', size(f)))[0])[0]"


def pseudonym(key: str) -> str:
    """SQL over lambda variables m (text) and k (kind): the pseudonym, or m itself where k is null."""
    d = _digits("m")
    local = "substring_index(m, '@', 1)"
    bare = "replace(m, ' ', '')"
    body = permuted(f"substr({bare}, 5)", "k", key)
    iban = f"transform(array({body}), b -> transform(array(concat(substr({bare}, 1, 2), '00', b)), z -> concat(substr(z, 1, 2), lpad(cast(98 - {_iban_mod('z')} as string), 2, '0'), b))[0])[0]"
    spaced = lambda x: f"transform(array({x}), y -> if(instr(m, ' ') > 0, trim(regexp_replace(y, '(.{{4}})', '$1 ')), y))[0]"
    keep = f"if(m rlike '^[+]', if({d} rlike '^(?:{SHORT_CODES})', length(regexp_extract({d}, '^(?:{SHORT_CODES})', 0)), 3), 0)"
    number = f"(cast(substr({d}, 1, 3) as bigint) - if({d} > '666', 2, 1)) * 989901 + (cast(substr({d}, 4, 2) as bigint) - 1) * 9999 + cast(substr({d}, 6) as bigint) - 1"
    ssn = f"transform(array({permuted_number(number, 29634, 29997, 'k', key)}), v -> transform(array(v div 989901), a -> concat(lpad(a + if(a >= 665, 2, 1), 3, '0'), lpad(v div 9999 % 99 + 1, 2, '0'), lpad(v % 9999 + 1, 4, '0')))[0])[0]"
    phone = f"concat(substr({d}, 1, {keep}), {permuted(f'substr({d}, {keep} + 1)', 'k', key)})"
    octets = "transform(array(split(m, '[.]')), o -> cast(o[0] as bigint) * 16777216 + cast(o[1] as bigint) * 65536 + cast(o[2] as bigint) * 256 + cast(o[3] as bigint))[0]"
    ip = f"transform(array({permuted_number(octets, 65536, 65536, 'k', key)}), v -> concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256))[0]"
    day = permuted_number("datediff(p.d, date'1700-01-01')", 189, 773, "k", key)
    sep = "regexp_extract(m, '[-/.]', 0)"
    date = f"transform(array({_date_parts('m')}), p -> transform(array(date_add(date'1700-01-01', cast({day} as int))), x -> date_format(x, case p.k when 'ymd' then concat('yyyy', {sep}, 'MM', {sep}, 'dd') when 'dmy' then concat('dd', {sep}, 'MM', {sep}, 'yyyy') else concat('MM', {sep}, 'dd', {sep}, 'yyyy') end))[0])[0]"
    return f"""case k
        when 'email' then concat({permuted(local, 'k', key)}, '@', substring_index(m, '@', -1))
        when 'iban' then {spaced(iban)}
        when 'ip' then {ip}
        when 'date' then {date}
        when 'ssn' then {_refilled('m', ssn)}
        when 'phone' then {_refilled('m', phone)}
        when 'card' then {_card(key)}
        else m end"""


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """`docs` with the text rewritten under `key`; with `counts` also n_email, n_iban, n_ip, n_date, n_ssn, n_phone, n_card (long).

    Narrow: each row is rewritten where it is read, nothing is shuffled.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # A cheap test first: every value has an @, two digits side by side, or digits around a point.
    may = F.col("text").rlike("@|[0-9]{2}|[0-9][.][0-9]")
    none = F.array().cast("array<string>")
    out = out.withColumn("found", F.coalesce(F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))), none))
    out = out.withColumn("kinds", F.expr(f"transform(found, m -> named_struct('m', m, 'k', {kind_of()}))"))
    new = F.expr(f"transform(kinds, f -> transform(array(f.m), m -> transform(array(f.k), k -> {pseudonym(key)})[0])[0])")
    # Only rows with a match are split and joined again.
    parts = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    # Texts with a failed card: what stands between values is put together again, and its groups of digits are tried.
    failed = lambda f: f"{f}.k IS NULL AND {f}.m rlike '^[0-9](?:[ -]?[0-9]){{12,18}}$'"
    out = out.withColumn("parts", F.when(F.expr(f"exists(kinds, f -> {failed('f')})"), parts))
    more = "named_struct('done', s.done, 'now', concat(s.now, f.m, parts[i]), 'hot', s.hot OR f.hot)"
    next_ = "named_struct('done', concat(s.done, array(named_struct('t', s.now, 'hot', s.hot))), 'now', parts[i], 'hot', false)"
    step = f"transform(array(named_struct('m', kinds[i - 1].m, 'k', kinds[i - 1].k, 'hot', {failed('kinds[i - 1]')})), f -> if(f.k IS NULL, {more}, {next_}))[0]"
    start = "named_struct('done', cast(array() as array<struct<t: string, hot: boolean>>), 'now', parts[0], 'hot', false)"
    between = f"aggregate(sequence(1, size(kinds)), {start}, (s, i) -> {step}, s -> concat(s.done, array(named_struct('t', s.now, 'hot', s.hot))))"
    tried = f"transform(regexp_extract_all(b.t, r'{GROUPS}', 0), y -> {_cards_inside('y', key)})"
    filled = f"transform(array({tried}), y -> named_struct('s', array_join(zip_with(split(b.t, r'{GROUPS}', -1), concat(y.s, array('')), (o, v) -> concat(o, v)), ''), 'n', aggregate(y.n, 0, (t, n) -> t + n)))[0]"
    between = f"transform({between}, b -> if(b.hot, {filled}, named_struct('s', b.t, 'n', 0)))"
    out = out.withColumn("between", F.when(F.col("parts").isNotNull(), F.expr(between)))
    valid = F.expr(f"transform(filter(kinds, f -> f.k IS NOT NULL), f -> transform(array(f.m), m -> transform(array(f.k), k -> {pseudonym(key)})[0])[0])")
    again = F.array_join(F.zip_with(F.col("between.s"), F.concat(valid, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.exists("kinds", lambda f: f["k"].isNotNull())
    text = F.when(F.col("between").isNotNull(), again).when(changed, joined).otherwise(F.col("text"))
    many = lambda kind: F.expr(f"cast(size(filter(kinds, f -> f.k = '{kind}')) as bigint)")
    made = {f"n_{kind}": many(kind) for kind in KINDS} if counts else {}
    if counts:
        made["n_card"] += F.expr("coalesce(aggregate(between.n, 0, (t, n) -> t + n), 0)")
    own = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in made]
    return out.select(*own, *[made[c].alias(c) for c in made])
