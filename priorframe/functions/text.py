"""Row hashes and formatted text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: The SQL of %.10g, of x and e, which is |x| as %.9e; the mantissa's digits and the power of ten are bound once.
_BARE = r"regexp_replace(regexp_replace({}, r'0+$', ''), r'\.$', '')"
_FIXED = "case when s.n >= 0 then concat(left(s.d, s.n + 1), '.', substring(s.d, s.n + 2)) else concat('0.', repeat('0', -s.n - 1), s.d) end"
_FORM = f"case when s.n between -4 and 9 then {_BARE.format(_FIXED)} else concat({_BARE.format("concat(left(s.d, 1), '.', substring(s.d, 2))")}, 'e', s.p) end"
_PARTS = "named_struct('d', replace(substring_index(v.e, 'e', 1), '.', ''), 'n', int(substring_index(v.e, 'e', -1)), 'p', substring_index(v.e, 'e', -1))"
_REAL = (
    "case when v.x is null or isnan(v.x) then 'nan' when v.x = double('inf') then 'inf' when v.x = double('-inf') then '-inf' "
    f"else concat(if(startswith(string(v.x), '-'), '-', ''), transform(array({_PARTS}), s -> {_FORM})[0]) end"
)


#: Java rounds the digits that it prints, C the number itself. They differ only where a number is printed as, or is the one nearest to, ten digits
#: and a five. Of such a number u.x, u.c holds ten digits, u.n the power of ten of the first, u.s the power of two that makes it whole; both sides of the
#: comparison with that tie are whole numbers. From 1e38 on, and below 1e-19, they don't fit, and
#: such a tie is rounded as it is printed; so are the few digits of numbers below 1e-307.
_FIVES = f"element_at(array({', '.join(f'cast({5**k}BD as decimal(38,0))' for k in range(31))}), cast({{}} as int) + 1)"
_TWOS = "(cast(shiftleft(1L, cast(least({0}, 62) as int)) as decimal(38,0)) * cast(shiftleft(1L, cast(greatest({0} - 62, 0) as int)) as decimal(38,0)))"
_SCALE = "(double(shiftleft(1L, cast(least({0}, 62) as int))) * double(shiftleft(1L, cast(greatest({0} - 62, 0) as int))))"
_OWN = (
    f"cast(bigint(u.x * {_SCALE.format('greatest(u.s, 0)')} / {_SCALE.format('greatest(-u.s, 0)')}) as decimal(38,0))"
    f" * {_FIVES.format('greatest(10 - u.n, 0)')} * {_TWOS.format('greatest(10 - u.n - u.s, 0)')}"
)
_TIE = f"cast(u.c * 10 + 5 as decimal(38,0)) * {_FIVES.format('greatest(u.n - 10, 0)')} * {_TWOS.format('greatest(u.s + u.n - 10, 0)')}"
_UP = f"transform(array(named_struct('a', {_OWN}, 'b', {_TIE})), y -> case when y.a > y.b then 1 when y.a < y.b then 0 else u.c % 2 end)[0]"
_DIGITS = "named_struct('x', t.x, 'c', bigint(concat(left(t.f, 1), substring(t.f, 3, 9))), 'n', int(substring_index(t.f, 'e', -1)), 's', 53 - floor(log2(t.x)))"
_ROUNDED = f"case when double(concat(u.c, '5e', u.n - 10)) = u.x then double(concat(u.c + {_UP}, 'e', u.n - 9)) end"


def _nearest(x: str) -> str:
    """The SQL of |x|, rounded to ten digits if a tie may be near, as few numbers need."""
    close = f"transform(array(abs({x}) * power(10D, 9 - floor(log10(abs({x}))))), z -> abs(z - floor(z) - 0.5D) < 1e-3D or z > 9999999990D or z < 1000000010D)[0]"
    slow = f"transform(transform(array(named_struct('x', abs({x}), 'f', format_string('%.16e', abs({x})))), t -> {_DIGITS}), u -> {_ROUNDED})[0]"
    return f"if(abs({x}) >= 1e-19D and abs({x}) < 1e38D and {close}, coalesce({slow}, abs({x})), abs({x}))"


_PRINTED = f"case when r.x is not null then format_string('%.9e', {_nearest('r.x')}) end"


def general(column: str) -> Column:
    """A double as C's %.10g writes it: ten significant digits, no trailing zeros, exponents below -4 and from 10 on; nan for null."""
    return F.expr(f"transform(transform(array(named_struct('x', double(`{column}`))), r -> named_struct('x', r.x, 'e', {_PRINTED})), v -> {_REAL})[0]")


def row_hash(fields: list[str], types: dict[str, str], known_only: bool = False) -> Column:
    """16 hex digits of SHA-256 over name=value pairs, joined by bars: doubles as %.10g, null as nan; known_only leaves out null fields."""
    parts = []
    for f in fields:
        real = types[f] in ("double", "float")
        text = "''" if real else f"coalesce(string(`{f}`), 'nan')"
        parts.append(f"named_struct('name', '{f}=', 'real', {str(real).lower()}, 'known', `{f}` is not null, 'text', {text}, 'x', double({f'`{f}`' if real else 'null'}))")
    pairs = f"array({', '.join(parts)})"
    pairs = f"filter({pairs}, v -> v.known)" if known_only else pairs
    pairs = f"transform({pairs}, r -> named_struct('name', r.name, 'real', r.real, 'text', r.text, 'x', r.x, 'e', {_PRINTED}))"
    return F.expr(f"substring(sha2(array_join(transform({pairs}, v -> concat(v.name, if(v.real, {_REAL}, v.text))), '|'), 256), 1, 16)")


def percent(c: Column) -> Column:
    return F.concat(F.format_string("%.0f", c * 100), F.lit("%"))


def confidence(p: Column) -> Column:
    """strong, likely, lean or coin flip, by the larger of p and 1 - p."""
    q = F.greatest(p, 1 - p)
    return F.when(q >= 0.75, "strong").when(q >= 0.65, "likely").when(q >= 0.57, "lean").otherwise("coin flip")
