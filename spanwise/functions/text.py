"""Column expressions on labels: tokens, ontology, clauses, replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a decoded segment is written in free text, the words or dashes between its times, and what a whole completion is.
SEGMENT = r"(?is)<seg>\s*<name>(.*?)</name>\s*<span>\s*(\d+\.?\d*)\s*(?:to|[-–—])\s*(\d+\.?\d*)\s*</span>\s*</seg>"
COMPLETION = r"(?s)^\s*<think>.*?</think>\s*<segments>.*?</segments>\s*$"
# What joins the clauses of a label.
CLAUSE = r"\s*(?:,|;|\band then\b|\bthen\b|\band\b)\s*"


def tokens(s: Column) -> Column:
    """Runs of a-z of the lower-cased text."""
    return F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)


def dictionary(entries: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def canonical(words: Column, mapping: Column) -> Column:
    """Words mapped to their canonical form, in order, those outside the mapping dropped."""
    return F.filter(F.transform(words, lambda w: F.try_element_at(mapping, w)), lambda w: w.isNotNull())


def folded(verb: Column, obj: Column, fold: Column) -> Column:
    """A verb replaced where the pair of verb and object has an entry of its own."""
    return F.coalesce(F.try_element_at(fold, F.concat_ws(":", verb, obj)), verb)


def phrases(s: Column, ordered: list[str]) -> Column:
    """Phrases that occur as whole words, longest first, each removed before the next is sought."""
    longest = sorted(ordered, key=lambda p: -len(p.split()))
    start = F.struct(F.lower(s).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc, p):
        pattern = F.concat(F.lit(r"(^|[^a-z])"), p, F.lit(r"([^a-z]|$)"))
        hit = F.regexp_like(acc["rest"], pattern)
        return F.struct(F.when(hit, F.regexp_replace(acc["rest"], pattern, F.lit("$1 $2"))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["found"], F.array(p))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.array(*[F.lit(p) for p in longest]), start, step, lambda acc: acc["found"])


def clauses(s: Column) -> Column:
    return F.filter(F.split(F.trim(s), CLAUSE), lambda c: F.trim(c) != "")


def atomicity(s: Column) -> Column:
    """cycle, compound, terse or atomic, by the first test that holds."""
    words = F.size(tokens(s))
    return F.when(F.lower(s).rlike("repeat|again|back and forth"), "cycle").when(F.size(clauses(s)) > 1, "compound").when(words <= 2, "terse").otherwise("atomic")


def swap_word(s: Column, old: str, new: str) -> Column:
    """The first whole-word occurrence replaced, its capital kept; null if there is none."""
    pattern = rf"(?i)(^|[^A-Za-z])({old})([^A-Za-z]|$)"
    at = F.regexp_instr(s, F.lit(pattern))
    lead = F.length(F.regexp_extract(s, pattern, 1))
    begin = at + lead
    found = F.substring(s, begin, F.lit(len(old)))
    first = F.substring(found, 1, 1)
    word = F.when(first == F.upper(first), F.initcap(F.lit(new))).otherwise(F.lit(new))
    return F.when(at > 0, F.overlay(s, word, begin, F.lit(len(old))))


def recased(s: Column) -> Column:
    """First letter upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.length(s)))


def well_formed(s: Column) -> Column:
    """No doubled word, no leading or trailing joint, at least two words."""
    t = F.lower(F.trim(s))
    return ~t.rlike(r"\b(\w+) \1\b") & ~t.rlike("^(and|then|,)|(and|then|,)$") & (F.size(tokens(s)) >= 2)


def set_error(gold: Column, pred: Column) -> Column:
    """How a predicted set differs: exact, omission, over, partial or substitution."""
    missing, extra, both = F.size(F.array_except(gold, pred)), F.size(F.array_except(pred, gold)), F.size(F.array_intersect(gold, pred))
    return F.when((missing == 0) & (extra == 0), "exact").when(extra == 0, "omission").when(missing == 0, "over").when(both > 0, "partial").otherwise("substitution")


def parsed_segments(s: Column) -> Column:
    """Segments written in free text, as ``array<struct<label, start, end>>``."""
    parts = [F.regexp_extract_all(s, F.lit(SEGMENT), F.lit(g)) for g in (1, 2, 3)]
    names = F.zip_with(parts[0], F.zip_with(parts[1], parts[2], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda n, t: F.struct(F.regexp_replace(n, r"(?U)^\s+|\s+$", "").alias("label"), t["a"].try_cast("double").alias("start"), t["b"].try_cast("double").alias("end")))
    return names


def format_reward(s: Column) -> Column:
    """1 for a completion (thought, then segments) whose segments start in order and end after they start, 1/2 for another with segments, else 0."""
    segs = parsed_segments(s)
    starts = F.transform(segs, lambda x: x["start"])
    ordered = F.forall(segs, lambda x: x["end"] > x["start"]) & (starts == F.array_sort(starts))
    return F.when(~s.rlike(COMPLETION) | (F.size(segs) == 0), 0.0).when(ordered, 1.0).otherwise(0.5)


def reply_object(s: Column) -> Column:
    """The JSON object in a model's reply: a code fence is taken off, else the first to the last brace."""
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit("")))


def parsed_actions(s: Column) -> Column:
    """``verb(object)[{qualifier}]`` cells split at semicolons; unparseable ones in ``bad``."""
    cells = F.filter(F.transform(F.split(s, ";"), lambda c: F.trim(c)), lambda c: c != "")
    pattern = r"^([a-z_]+)\(([^()]*)\)(?:\[?\{([^{}]*)\}\]?)?$"
    good = F.filter(cells, lambda c: F.regexp_like(c, F.lit(pattern)))
    return F.struct(F.transform(good, lambda c: F.struct(F.regexp_extract(c, pattern, 1).alias("verb"), F.regexp_extract(c, pattern, 2).alias("object"), F.regexp_extract(c, pattern, 3).alias("qualifier"))).alias("actions"), F.filter(cells, lambda c: ~F.regexp_like(c, F.lit(pattern))).alias("bad"))


def counterfactuals(label: Column, verb: Column, other_verb: Column, obj: Column, other_object: Column) -> Column:
    """Altered labels with their kind: wrong verb, wrong object, a claim dropped, claims reordered, a claim added."""
    c = clauses(label)
    several = F.size(c) > 1
    made = [
        ("wrong_verb", F.when(F.contains(label, verb), F.replace(label, verb, other_verb))),
        ("wrong_object", F.when(F.contains(label, obj), F.replace(label, obj, other_object))),
        ("drop_claim", F.when(several, F.array_join(F.slice(c, 1, F.size(c) - 1), ", "))),
        ("reorder", F.when(several, F.array_join(F.reverse(c), ", "))),
        ("add_claim", F.concat_ws(", ", label, F.concat_ws(" ", other_verb, other_object))),
    ]
    return F.array_compact(F.array(*[F.when(text.isNotNull() & (text != label), F.struct(F.lit(kind).alias("kind"), text.alias("text"))) for kind, text in made]))
