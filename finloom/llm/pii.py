"""Personal data (native: SQL functions only).

Regular expressions propose spans, validators confirm them (octets, Luhn, digit counts, mod-97), and context words
near a span raise its score: within the 40 code points before it, across other matches, or within the first 40 of
what follows up to the second next match of its kind. Base kinds (email, ip, card, phone) stand once they are valid; further kinds
(iban, ssn, secret) need a score of at least `THRESHOLD`: IBANs have it by their check digits, numbers in the form of
social security numbers and long key-like strings only by their context.

Positions come without a scan in Python: the pieces between matches (split) and the matches (regexp_extract_all) of
one pattern interleave, so running sums of their lengths in code points are the matches' places. Texts without the
kind's tell-tale character skip its patterns. Quantifiers are possessive where that changes no match, so very long
runs take linear time and no stack.

Defined results: null and empty texts have no spans; matches that fail validation are dropped and not tried again;
very long texts are read whole; rows are judged one by one, so repeated rows and ids do no harm; empty tables give empty tables; further columns pass
through, those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least score of further kinds, code points of context, outputs that a fold gathers at a time.
THRESHOLD, CONTEXT_CHARS, FOLD = 0.6, 40, 256

#: The base patterns, as contracted, with possessive quantifiers; card runs of 12 digits or more only.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further kinds.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+(?![A-Za-z0-9_+/-])"


@dataclass(frozen=True)
class Kind:
    """has: a cheap condition on the text; valid: one on the match x; score without context; context: pattern before it;
    after: whether the pattern may stand after it as well."""

    name: str
    pattern: str
    has: str
    valid: str
    base: bool
    score: float
    context: str
    after: bool = True


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


_DIGITS = "regexp_replace({x}, '[^0-9]', '')"
#: Luhn over the digits d, from the right: every second one doubled, 9 taken off above 9.
_LUHN = (
    "aggregate(transform(split(reverse({d}), ''), (c, i) -> case when i % 2 = 0 then int(c) "
    "when 2 * int(c) > 9 then 2 * int(c) - 9 else 2 * int(c) end), 0, (a, v) -> a + v) % 10 = 0"
).replace("{d}", _DIGITS)
_COMPACT = "replace({x}, ' ', '')"
#: IBAN check: the first four characters to the end, letters as 10 to 35, remainder 1 by 97.
_MOD97 = (
    "aggregate(split(concat(substring({t}, 5), substring({t}, 1, 4)), ''), 0, (a, c) -> "
    "case when c rlike '[0-9]' then (a * 10 + int(c)) % 97 else (a * 100 + ascii(c) - 55) % 97 end) = 1"
).replace("{t}", _COMPACT)
_DIGIT, _AT, _PLUS = "rlike({t}, '[0-9]')", "contains({t}, '@')", "rlike({t}, '\\\\+[0-9]')"
_FEW = "char_length({d}) between {a} and {b}"

KINDS = (
    Kind("email", EMAIL, _AT, "true", True, 1.0, "(?i)mail|contact|write"),
    Kind("ip", IP, "rlike({t}, '[0-9]\\\\.[0-9]')", "forall(split({x}, '[.]'), o -> char_length(ltrim('0', o)) <= 3 and int(concat('0', ltrim('0', o))) <= 255)", True, 0.8, "(?i)\\\\bip\\\\b|address|server|host"),
    Kind("card", CARD, "rlike({t}, '[0-9][ -]?[0-9]')", f"case when {_FEW.format(d=_DIGITS, a=12, b=19)} then {_LUHN} else false end", True, 0.9, "(?i)card|visa|credit|debit"),
    Kind("phone", PHONE, _PLUS, _FEW.format(d=_DIGITS, a=9, b=15), True, 0.8, "(?i)phone|tel|call|mobile|fax"),
    Kind("iban", IBAN, "rlike({t}, '[A-Z]{2}[0-9]{2}')", f"case when char_length({_COMPACT}) between 15 and 34 then {_MOD97} else false end", False, 0.7, "(?i)iban|account|konto|compte|cuenta"),
    Kind("ssn", SSN, "rlike({t}, '[0-9]-[0-9]')", "not rlike({x}, '^(?:000|666|9)|-00-|-0000$')", False, 0.3, "(?i)\\\\bssn\\\\b|social security"),
    Kind("secret", SECRET, "rlike({t}, '(?i)token|secret|passw|api.?key')", "rlike({x}, '[0-9]') and rlike({x}, '[A-Za-z]')", False, 0.2, "(?i)(?:token|secret|passw(?:or)?d|api[ _-]?key)[^A-Za-z0-9]{0,8}$", False),
)


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _fold(items: str, state: str, kind: str, step: str) -> str:
    """SQL: outputs of a left fold over items; step maps (a, p) to a struct of the state `at` and the next output `x`,
    an array of none or one. Outputs gather in blocks, so that many items don't copy the growing array each time."""
    inner = f"aggregate(blk, named_struct('at', acc.at, 'out', {kind}), (a, p) -> {_let('n', step, 'named_struct(' + chr(39) + 'at' + chr(39) + ', n.at, ' + chr(39) + 'out' + chr(39) + ', concat(a.out, n.x))')})"
    outer = _let("r", inner, "named_struct('at', r.at, 'out', concat(acc.out, r.out))")
    blocks = _let("ps", items, f"transform(sequence(0, greatest(size(ps) - 1, 0) div {FOLD}), i -> slice(ps, i * {FOLD} + 1, {FOLD}))")
    return f"aggregate({blocks}, named_struct('at', {state}, 'out', {kind}), (acc, blk) -> {outer}, acc -> acc.out)"


def _spans(kind: Kind, order: int, text: str) -> str:
    """SQL for the kind's valid spans in the text: array of (start, ord, end, kind, base, score)."""
    rx = _sql(kind.pattern)
    near = f"left({{}}, {CONTEXT_CHARS})"
    # g: the piece before a match, m: the matches, the last piece has none
    pair = f"named_struct('n', char_length(g), 'c', right(g, {CONTEXT_CHARS}), 'l', {near.format('g')}, 'x', h)"
    joined = f"zip_with(split({text}, {rx}, -1), concat(regexp_extract_all({text}, {rx}, 0), array('')), (g, h) -> {pair})"
    # what follows a match: the next piece, the next match, the piece after it
    follows = near.format(f"concat(get(w, i + 1).l, case when char_length(get(w, i + 1).l) < {CONTEXT_CHARS} then concat({near.format('get(w, i + 1).x')}, coalesce(get(w, i + 2).l, '')) else '' end)")
    pieces = _let("w", joined, f"transform(w, (v, i) -> named_struct('n', v.n, 'c', v.c, 'f', case when v.x = '' then '' else {follows} end, 'x', v.x))") if kind.after else joined.replace(f"'l', {near.format('g')}", "'f', ''")
    none = "cast(array() as array<struct<s:int,c:string,f:string,x:string>>)"
    # the state carries the last code points over matches, so that a match's context does not end at the one before
    before = f"right(concat(a.at.c, p.c), {CONTEXT_CHARS})"
    after = f"right(concat(c, right(p.x, {CONTEXT_CHARS})), {CONTEXT_CHARS})"
    state = f"named_struct('n', a.at.n + p.n + char_length(p.x), 'c', {after})"
    step = _let("c", before, f"named_struct('at', {state}, 'x', case when p.x = '' then {none} else array(named_struct('s', a.at.n + p.n, 'c', c, 'f', p.f, 'x', p.x)) end)")
    valid = kind.valid.replace("{x}", "m.x")
    score = f"least(1.0D, {kind.score}D + case when rlike(m.c, '{kind.context}') or (m.f <> '' and rlike(m.f, '{kind.context}')) then 0.5D else 0.0D end)"
    found = f"transform(filter({_fold(pieces, "named_struct('n', 0, 'c', '')", none, step)}, m -> {valid}), m -> named_struct('start', m.s, 'ord', {order}, 'end', m.s + char_length(m.x), 'kind', '{kind.name}', 'base', {str(kind.base).lower()}, 'score', {score}))"
    empty = "cast(array() as array<struct<start:int,ord:int,end:int,kind:string,base:boolean,score:double>>)"
    return f"case when {kind.has.replace('{t}', text)} then {found} else {empty} end"


def find_pii(docs: DataFrame, text: str = "text", kinds=KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with pii: array of (start, ord, end, kind, base, score) by start, then kind as listed; code points, end exclusive."""
    passing = [c for c in docs.columns if c != "pii"]
    whole = docs.select(*[F.col(f"`{c}`") for c in passing], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__p_text"))
    parts = ", ".join(_spans(k, i, "__p_text") for i, k in enumerate(kinds))
    spans = F.expr(f"array_sort(filter(concat({parts}), s -> s.base or s.score >= {threshold}D), (l, r) -> case when l.start <> r.start then l.start - r.start else l.ord - r.ord end)")
    return whole.select(*[F.col(f"`{c}`") for c in passing], spans.alias("pii"))


def mask_pii(found: DataFrame, text: str = "text") -> DataFrame:
    """The texts of find_pii's result with every span replaced by [KIND]; overlapping spans by the first one's."""
    none = "cast(array() as array<struct<start:int,end:int,kind:string>>)"
    step = f"case when p.start < a.at then named_struct('at', a.at, 'x', {none}) else named_struct('at', p.end, 'x', array(named_struct('start', p.start, 'end', p.end, 'kind', p.kind))) end"
    part = "concat('[', upper(s.kind), ']', array_join(slice(ch, s.end + 1, case when i < size(k) - 1 then k[i + 1].start else size(ch) end - s.end), ''))"
    body = _let("k", _fold("pii", "0", none, step), f"concat(array_join(slice(ch, 1, k[0].start), ''), array_join(transform(k, (s, i) -> {part}), ''))")
    cut = F.expr(_let("ch", f"filter(split({text}, ''), c -> c <> '')", body))
    return found.withColumn(text, F.when(F.size("pii") == 0, F.col(text)).otherwise(cut))
