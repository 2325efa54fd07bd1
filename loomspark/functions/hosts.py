"""Hosts in the form that the WHATWG URL standard gives them, as Column expressions.

A host is percent-decoded, mapped to lower case and plain width, its labels that aren't ASCII are
put into Bootstring (RFC 3492), and a host whose last label is a number is an IPv4 address in
any of its number forms (decimal, octal, hexadecimal, one to four parts). What can't be a host is null.

The longer expressions are written as SQL text: one call hands them over, where building them from
columns takes some hundred calls for each use.

Characters are mapped by lower case, width and the list of ignored ones; a letter with a combining
mark behind it isn't composed, as Spark has no function for that.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of RFC 3492: parameters of Bootstring for host names.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Signs that no host may hold once it is decoded, besides blanks and control characters.
FORBIDDEN = r"[\x00-\x20\x7F#%/:<>?@\[\\\]^`{|}]"
#: Characters that vanish: soft hyphen, joiners, zero-width ones, variation selectors.
IGNORED = r"[­͏᠋-᠏​⁠⁤︀-️﻿]"
#: Signs that stand for a full stop.
STOPS = "。．｡"
#: What bytes that aren't UTF-8 are decoded to.
BROKEN = "�"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once and whose expression isn't repeated in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _let(value: str, name: str, body: str) -> str:
    """``let`` as SQL text: body, in which the value has a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _of(value: Column, name: str, body: str) -> Column:
    """SQL text body of a column, which has a name in it."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def _text(sign: str) -> str:
    """A pattern or text as a SQL literal."""
    return "'" + sign.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _adapted(delta: str, points: str, first: str) -> str:
    """The bias after a delta."""
    start = _let(f"{delta} div if({first}, {DAMP}, 2)", "d0", f"named_struct('d', d0 + d0 div {points}, 'k', 0L)")
    limit, down = ((BASE - T_MIN) * T_MAX) // 2, BASE - T_MIN
    return f"aggregate(sequence(1, 7), {start}, (a, j) -> if(a.d > {limit}, named_struct('d', a.d div {down}, 'k', a.k + {BASE}), a), a -> a.k + ({down + 1} * a.d) div (a.d + {SKEW}))"


def _number(delta: str, bias: str) -> str:
    """A delta as a variable-length number: its digits as text."""
    digit = lambda n: f"concat(v.out, substr('{DIGITS}', cast({n} + 1 as int), 1))"
    last = f"named_struct('q', v.q, 'out', {digit('v.q')}, 'done', true)"
    more = f"named_struct('q', (v.q - t) div ({BASE} - t), 'out', {digit(f't + (v.q - t) % ({BASE} - t)')}, 'done', false)"
    threshold = f"least(greatest(j * {BASE} - {bias}, {T_MIN}L), {T_MAX}L)"
    step = _let(threshold, "t", f"if(v.q < t, {last}, {more})")
    return f"aggregate(sequence(1L, 8L), named_struct('q', {delta}, 'out', '', 'done', false), (v, j) -> if(v.done, v, {step}), v -> v.out)"


@cache
def _bootstring(label: str) -> str:
    """Such characters are written in the order of their code points, then places; each as the number
    of states that a decoder passes from the one before: (code point, place in the string so far)."""
    points = f"transform(filter(split({label}, ''), c -> c != ''), (c, i) -> named_struct('cp', cast(ascii(c) as bigint), 'at', cast(i as bigint)))"
    basic = f"regexp_replace({label}, '[^\\\\x00-\\\\x7F]', '')"
    start = f"named_struct('n', {FIRST_CODE}L, 'i', 0L, 'bias', {FIRST_BIAS}L, 'h', cast(size(filter(pts, p -> p.cp < {FIRST_CODE})) as bigint), 'out', '')"
    # Of the string so far, all that stands before p: smaller points, and equal ones.
    place = "cast(size(filter(pts, y -> y.at < p.at and y.cp <= p.cp)) as bigint)"
    put = f"named_struct('n', p.cp, 'i', pl + 1, 'bias', {_adapted('d', '(s.h + 1)', 's.out = ' + repr(''))}, 'h', s.h + 1, 'out', concat(s.out, {_number('d', 's.bias')}))"
    step = _let(place, "pl", _let("(p.cp - s.n) * (s.h + 1) + pl - s.i", "d", put))
    tail = f"aggregate(array_sort(filter(pts, p -> p.cp >= {FIRST_CODE})), {start}, (s, p) -> {step}, s -> s.out)"
    return _let(points, "pts", f"concat({_let(basic, 'bs', 'if(bs = ' + repr('') + ', bs, concat(bs, ' + repr('-') + '))')}, {tail})")


def bootstring(label: Column) -> Column:
    """A label in Bootstring, without ``xn--``. The label has a character that isn't ASCII."""
    return _of(label, "x", _bootstring("x"))


@cache
def _ascii(h: str) -> str:
    """Labels that aren't ASCII as ``xn--`` and Bootstring; lower case, plain width, without
    ignored characters."""
    wide, plain = ("".join(chr(c - less) for c in range(0xFF01, 0xFF5F)) for less in (0, 0xFEE0))
    mapped = f"lower(translate(translate(regexp_replace({h}, {_text(IGNORED)}, ''), '{STOPS}', '...'), {_text(wide)}, {_text(plain)}))"
    other = "'[^\\\\x00-\\\\x7F]'"
    one = f"if(x rlike {other}, concat('xn--', {_bootstring('x')}), x)"
    return f"if({h} rlike {other}, {_let(mapped, 'm', f'array_join(transform(split(m, {_text(chr(92) + chr(46))}), x -> {one}), {_text(chr(46))})')}, {h})"


@cache
def _ipv4(h: str) -> str:
    """The address in dotted form of a host whose last label is a number; null if it is none. A part
    is hexadecimal after 0x, octal after 0, else decimal."""
    short = lambda digits, base: _let(digits, "g", f"if(length(g) <= 12, try_cast(conv(concat('0', g), {base}, 10) as bigint), null)")
    bare = lambda x: f"regexp_replace({x}, '^0+', '')"
    part = f"case when x rlike '^0[xX][0-9A-Fa-f]*$' then {short(bare('substr(x, 3)'), 16)} when x rlike '^0[0-7]*$' then {short(bare('x'), 8)} when x rlike '^[1-9][0-9]*$' then {short('x', 10)} end"
    power = ", ".join(f"{256**k}L" for k in (3, 2, 1))
    room = ", ".join(f"{256**k}L" for k in (4, 3, 2, 1))
    value = f"aggregate(transform(slice(u, 1, size(u) - 1), (x, i) -> x * element_at(array({power}), i + 1)), element_at(u, -1), (y, x) -> y + x)"
    octets = ", ".join(f"cast(shiftright(w, {k}) & 255 as string)" for k in (24, 16, 8, 0))
    ok = f"forall(u, x -> x is not null) and forall(slice(u, 1, size(u) - 1), x -> x <= 255) and element_at(u, -1) < element_at(array({room}), size(u))"
    dotted = f"if(size(u) <= 4, if({ok}, {_let(value, 'w', f'concat_ws({_text(chr(46))}, {octets})')}, null), null)"
    return _let(f"transform(split(regexp_replace({h}, {_text(chr(92) + '.$')}, ''), {_text(chr(92) + '.')}), x -> {part})", "u", dotted)


def ipv4(h: Column) -> Column:
    return _of(h, "h", _ipv4("h"))


#: Of eight numbers g, the address in brackets; the first longest run of two zeros or more is left out.
_RUNS = "transform(sequence(0, 7), i -> coalesce(cast(nullif(array_position(transform(slice(g, i + 1, 8), x -> x != 0), true), 0) as int) - 1, 8 - i))"
_HEXED = "array_join(transform({x}, v -> lower(hex(v))), ':')"
_CUT = _let("cast(array_position(r, b) as int) - 1", "a", f"concat({_HEXED.format(x='slice(g, 1, a)')}, '::', {_HEXED.format(x='slice(g, a + b + 1, 8)')})")
_IPV6 = _let(_RUNS, "r", _let("array_max(r)", "b", f"concat('[', if(b >= 2, {_CUT}, {_HEXED.format(x='g')}), ']')"))


def ipv6(groups: Column) -> Column:
    """Eight numbers as an address in brackets; null for null."""
    return _of(groups, "g", f"if(g is null, null, {_IPV6})")


@cache
def _groups6(ip: str) -> str:
    octet = "(?:25[0-5]|2[0-4]\\\\d|1\\\\d\\\\d|[1-9]?\\\\d)"
    number = f"if(v4 rlike '^(?:{octet}(?:\\\\.(?!$)|$)){{4}}$', aggregate(split(v4, '\\\\.'), 0L, (n, o) -> n * 256 + cast(o as bigint)), null)"
    tail = _let(number, "n4", "concat(lower(hex(shiftright(n4, 16))), ':', lower(hex(n4 & 65535)))")
    plain = _let(f"regexp_extract({ip}, ':(\\\\d+\\\\.\\\\d+\\\\.\\\\d+\\\\.\\\\d+)$', 1)", "v4", f"if(v4 = '', lower({ip}), concat(lower(substr({ip}, 1, length({ip}) - length(v4))), {tail}))")
    parts = lambda c: f"filter(split({c}, ':'), x -> x != '')"
    # One gap at most, which stands for one group or more; no lone colon at an end.
    shape = "s rlike '^[0-9a-f:]+$' and not s rlike ':::|::.*::|^:(?!:)|(?<!:):$'"
    whole = "if(contains(s, '::'), concat(l, array_repeat('0', greatest(8 - size(l) - size(r), 0)), r), l)"
    fits = "if(contains(s, '::'), size(l) + size(r) <= 7, size(l) = 8)"
    judged = _let(whole, "w", f"if({shape} and {fits} and forall(w, x -> length(x) <= 4), transform(w, x -> cast(conv(x, 16, 10) as int)), null)")
    sides = _let(parts("substring_index(s, '::', 1)"), "l", _let(parts("substring_index(s, '::', -1)"), "r", judged))
    return _let(plain, "s", sides)


def groups6(ip: Column) -> Column:
    """The eight numbers of an IPv6 address (array<int>); null if it isn't one."""
    return _of(ip, "ip", _groups6("ip"))


def address6(raw: Column) -> Column:
    """A raw IPv6 address in brackets, in its canonical form; null if it isn't one."""
    return _of(raw, "b", _let(_let("substr(b, 2, length(b) - 2)", "ip", _groups6("ip")), "g", f"if(g is null, null, {_IPV6})"))


@cache
def _domain() -> str:
    last = "'(?:^|\\\\.)(?:[0-9]+|0x[0-9a-f]*)\\\\.?$'"
    checked = f"if(h != '' and not h rlike {_text(FORBIDDEN)}, if(h rlike {last}, {_ipv4('h')}, h), null)"
    # A plus sign isn't a blank here.
    decoded = "if(contains(raw, '%'), try_url_decode(replace(raw, '+', '%2B')), raw)"
    ascii_ = _let(decoded, "e", f"if(contains(e, '{BROKEN}'), null, lower({_ascii('e')}))")
    # Most hosts are plain names and need nothing else.
    plain = "raw rlike '^(?:[a-z0-9_-]+\\\\.)*[a-z_-][a-z0-9_-]*\\\\.?$'"
    return f"if({plain}, raw, {_let(ascii_, 'h', checked)})"


def domain(raw: Column) -> Column:
    """The host that a raw one (in lower case, not in brackets) stands for; null if it can't be one."""
    return _of(raw, "raw", _domain())
