"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; range, length, Luhn and mod-97 checks confirm
them or drop them; words before a span raise its score. Offsets are code points,
the end exclusive. A span's start is the length of all that stands before it:
``split`` gives what lies between the matches that ``regexp_extract_all`` gives.

The patterns match what their plain forms match, without their backtracking: a
repeated group is possessive where nothing follows it that it could give back, and
a run of characters is entered at its start (or where the last match ended) only,
since a match from inside a run fails or succeeds as that from its start does.

Defined cases: null text is empty and has no spans; rows that repeat are each
answered; an empty table gives no rows; columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of output, with their patterns.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
# What a text holds if it can hold a match, as a plain substring; None: no such string.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None}
# The score of a confirmed span, what a context word adds, and those words.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
CONTEXT_BONUS = 0.15
CONTEXT_CHARS = 48
CONTEXT = {
    "email": "e-?mail|contact|write to|address|kontakt|correo|courriel",
    "ip": "ip|server|host|login|client|address|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono",
    "iban": "iban|bank|account|konto|compte|cuenta",
}


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(total, i):
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    """The check that a proposed span of this kind must pass."""
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":
        return F.when(F.length(digits(match)).between(16, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    if kind == "iban":
        packed = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(packed).between(15, 34), mod97(packed)).otherwise(False)
    return F.lit(True)


def _check(kind: str):
    return lambda match: confirmed(kind, match)


def _is(kind: str):
    return lambda span: span["kind"] == kind


NO_SPANS = "array<struct<match:string,start:int,context:string>>"
#: Matches whose lengths are summed together.
BLOCK = 64


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(pairs: Column) -> Column:
    """Where each match begins, from the lengths of the matches and of the gaps before them."""

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        return F.struct((begin + F.length(x["match"])).alias("at"), F.concat(acc["starts"], F.array(begin)).alias("starts"))

    def block(k):
        return F.aggregate(F.slice(pairs, k * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step)

    def moved(done):
        before = F.aggregate(F.slice(done, 1, F.size(done) - 1), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(done, before, lambda x, n: F.transform(x["starts"], lambda s: s + n)))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), block), moved)


def placed(text: Column, pattern: str, matches: Column) -> Column:
    """``array<struct<match, start, context>>`` of the ``matches`` of ``pattern`` in ``text``; the context ends where the match starts."""
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))

    def spans(p):
        def context(i):
            near = [F.right(F.get(p, i - k)[part], F.lit(CONTEXT_CHARS)) for k in (2, 1) for part in ("gap", "match")]
            return F.right(F.concat_ws("", *near, F.right(F.get(p, i)["gap"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS))

        return let(_starts(p), lambda starts: F.transform(p, lambda x, i: F.struct(x["match"].alias("match"), F.get(starts, i).alias("start"), context(i).alias("context"))))

    return F.when(F.size(matches) > 0, let(pairs, spans)).otherwise(F.array().cast(NO_SPANS))


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, pii``: the confirmed spans as ``array<struct<kind, start, end, score>>``, by kind in the order of ``PATTERNS`` and then start."""
    text = F.col("__text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    for kind, pattern in PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn(kind, found)
    for kind, pattern in PATTERNS.items():
        # proposals that fail their check still move what stands behind them
        rows = rows.withColumn(kind, F.when(F.exists(kind, _check(kind)), placed(text, pattern, F.col(kind))).otherwise(F.array().cast(NO_SPANS)))

    def scored(kind):
        def one(x):
            bonus = F.when(x["context"].rlike(rf"(?i)\b(?:{CONTEXT[kind]})\b"), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), F.least(F.lit(SCORES[kind]) + bonus, F.lit(1.0)).alias("score"))

        return F.transform(F.filter(kind, lambda x: confirmed(kind, x["match"])), one)

    return rows.select("doc_id", F.concat(*map(scored, PATTERNS)).alias("pii"))


def digest(found: DataFrame) -> DataFrame:
    """Per document the counts of base kinds, the SHA-256 of the base spans, all spans, and the scores likewise."""
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"))
