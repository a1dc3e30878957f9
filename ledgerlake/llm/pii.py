"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds ``email``, ``ip``, ``card`` (16 to 19 digits passing Luhn) and ``phone`` (8 to
15 digits) always stay.  The method adds ``iban`` (mod-97 holds) and ``ssn`` (the
digits alone are too weak; a context word nearby lifts them over the threshold).

Everything is column expressions.  Patterns that repeat a group do so possessively,
which keeps the stack flat on long texts and changes no match, but for ``IBAN``: that
one proposes a start, what follows is captured, and the ends of words in it are tried.

Nulls: a null text is empty and has no spans (``redact`` leaves it null); a null
doc_id is carried along.  Empty texts have no spans, an empty table gives no rows.
Very long texts are scanned whole, in time in proportion to their length and spans.
Repeated rows are each scanned.  Spans of different kinds may overlap; redaction
joins overlapping spans under the first one's kind, of equal starts the kind listed
first.  A column of the input named ``spans`` leaves ``scan`` as input_spans;
``redact`` returns the columns of its input, ``text`` changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, own, released, table
from .spans import CHUNK, SPAN, chunks, fold, let, listed, piece, quoted, spans

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Its group 1 is all that an IBAN can reach, and one character of a word that goes on.
IBAN = r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))[A-Z]{2}[0-9]{2}"
#: Lengths that country codes fix; for other codes the ends are tried longest first.
IBAN_LENGTH = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL OM SO",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: Words that raise the score of a kind when they stand within 40 characters before or after a span.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "address|host|server|login|from",
    "card": "card|visa|payment|credit|debit",
    "phone": "call|phone|tel|mobile|fax|contact",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|insurance",
}
#: Score of a confirmed span without context.
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}


def digits(s: str) -> str:
    return f"regexp_replace({s}, '[^0-9]', '')"


def luhn(number: str) -> str:
    d = "cast(substring(n, i, 1) as int)"
    twice = f"if({d} > 4, 2 * {d} - 9, 2 * {d})"
    return let("n", number, f"aggregate(sequence(1, length(n)), 0, (sum, i) -> sum + if((length(n) - i) % 2 = 1, {twice}, {d})) % 10 = 0")


def mod97(iban: str) -> str:
    code = "ascii(substring(turned, i, 1))"
    add = f"(rest, i) -> if({code} >= 65, (rest * 100 + {code} - 55) % 97, (rest * 10 + {code} - 48) % 97)"
    return let("turned", f"concat(substring({iban}, 5, 100), substring({iban}, 1, 4))", f"aggregate(sequence(1, length(turned)), 0, {add}) = 1")


def ibans(text: str, proposed: str) -> str:
    """SQL for the proposed spans cut to the end at which mod-97 holds; of spans that overlap the first stays."""
    fixed = "map(" + ", ".join(f"'{c}', {n}" for n, codes in IBAN_LENGTH.items() for c in codes.split()) + ")"
    bare = "replace(e, ' ', '')"
    sized = f"length({bare}) = coalesce(element_at({fixed}, substring(e, 1, 2)), length({bare}))"
    good = f"if({bare} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}$' and {sized}, {mod97(bare)}, false)"
    ends = "transform(sequence(size(words), 1, -1), k -> array_join(slice(words, 1, k), ' '))"
    cut = let("words", "split(reach, ' ')", f"get(filter({ends}, e -> {good}), 0)")
    reach = f"transform(regexp_extract_all({text}, {quoted(IBAN)}, 1), reach -> {cut})"
    pairs = f"zip_with({proposed}, {reach}, (s, f) -> named_struct('start', s.start, 'end', s.start + length(f), 'found', f))"
    free = lambda at, s: f"{s}.found is not null and {s}.start >= {at}"
    step = lambda at, s: (f"if({free(at, s)}, {s}.end, {at})", f"if({free(at, s)}, {s}, null)")
    return f"if(size({proposed}) > 0, {let('cuts', pairs, fold('cuts', '0L', step, SPAN))}, {proposed})"


CONFIRM = {
    "email": "true",
    "ip": f"s.found rlike {quoted(rf'^{PART}\.{PART}\.{PART}\.{PART}$')}",
    "card": f"if(length({digits('s.found')}) between 16 and 19, {luhn(digits('s.found'))}, false)",
    "phone": f"length({digits('s.found')}) between 8 and 15",
    "iban": "true",
    "ssn": "true",
}
PATTERNS = {"email": (EMAIL, "@"), "ip": (IP, "."), "card": (CARD, None), "phone": (PHONE, "+"), "iban": (IBAN, None), "ssn": (SSN, "-")}


def _confirmed(kind: str, rank: int) -> str:
    """SQL for the confirmed spans of a kind, scored by what stands around them in the text."""
    before, after = piece("_chunks", "greatest(s.start - 40, 0)", "s.start"), piece("_chunks", "s.end", "s.end + 40")
    score = f"if(lower({before}) rlike '{CONTEXT[kind]}' or lower({after}) rlike '{CONTEXT[kind]}', {min(1.0, SCORE[kind] + 0.3)}D, {SCORE[kind]}D)"
    return f"transform(filter(_{kind}, s -> {CONFIRM[kind]}), s -> named_struct('start', s.start, 'rank', {rank}, 'kind', '{kind}', 'end', s.end, 'score', {score}))"


def _found(docs: DataFrame, threshold: float) -> DataFrame:
    """_own (the columns of ``docs``), _chunks (of texts with spans) and _spans, an array of (start, rank, kind, end, score), by kind, then start."""
    found = docs.select(own(docs), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    found = found.selectExpr("_own", "_text", *[f"{spans('_text', p, hint)} as _{k}" for k, (p, hint) in PATTERNS.items()])
    some = " or ".join(f"size(_{k}) > 0" for k in KINDS)
    rest = [f"_{k}" for k in KINDS if k != "iban"]
    found = found.selectExpr("_own", *rest, f"{ibans('_text', '_iban')} as _iban", f"if({some}, {chunks('_text')}, cast(array() as array<string>)) as _chunks")
    parts = ", ".join(_confirmed(kind, rank) for rank, kind in enumerate(KINDS))
    return found.selectExpr("_own", "_chunks", f"filter(concat({parts}), s -> s.score >= {threshold}D) as _spans")


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``spans``: an array of (start, rank, kind, end, score), by kind, then start."""
    return _found(docs, threshold).select(*released(apart(docs, "spans")), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets."""

    step = lambda at, s: (f"greatest({at}, {s}.end)", f"if({s}.start >= {at}, concat({piece('_chunks', at, f'{s}.start')}, '[', upper({s}.kind), ']'), null)")
    pieces = let("sorted", "array_sort(_spans)", fold("sorted", "0L", step, "array<string>"))
    rest = piece("_chunks", "array_max(transform(_spans, s -> s.end))", f"size(_chunks) * {CHUNK}")
    found = _found(docs, threshold).select("_own", F.expr(f"if(size(_spans) > 0, concat(array_join({pieces}, ''), {rest}), _own.text)").alias("_new"))
    return found.select(*[F.col("_new").alias(c) if c == "text" else F.col("_own").getField(c).alias(c) for c in docs.columns])


def op10_pii(spark, sf_dir) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (of the spans, in hundredths) for every document."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS[:4]]
    scores = F.expr("array_join(transform(spans, s -> cast(cast(round(s.score * 100) as int) as string)), ',')")
    return found.select("doc_id", *counts, F.sha2(listed("filter(spans, s -> s.rank < 4)").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), scores.alias("scores"))
