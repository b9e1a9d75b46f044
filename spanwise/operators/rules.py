"""Rule tables compiled to column expressions: first and all failing reasons, routing, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = list[tuple[str, Column]]


def first_reason(rules: Rules) -> Column:
    """The name of the first rule that holds, in order; null if none does."""
    out = F.when(F.coalesce(rules[0][1], F.lit(False)), rules[0][0])
    for name, test in rules[1:]:
        out = out.when(F.coalesce(test, F.lit(False)), name)
    return out


def all_reasons(rules: Rules) -> Column:
    """The names of all rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules]))


def checks(config: dict[str, list[str]], fields: list[str]) -> Rules:
    """Failing rules from ``require_yes``, ``forbid_no``, ``forbid_yes`` and ``forbid_insufficient`` lists of fields.

    A required field that is null fails: what was not seen never passes.
    """
    tests = {
        "require_yes": lambda c: ~F.coalesce(c == "yes", F.lit(False)),
        "forbid_no": lambda c: c == "no",
        "forbid_yes": lambda c: c == "yes",
        "forbid_insufficient": lambda c: c.isNull() | (c == "insufficient"),
    }
    unknown = [k for k in config if k not in tests] + [f for names in config.values() for f in names if f not in fields]
    if unknown:
        raise ValueError(f"unknown rule or field: {unknown}")
    return [(f"{kind}:{field}", tests[kind](F.col(field))) for kind in tests for field in config.get(kind, [])]


def vocabulary_violations(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """How many values of each closed field are missing or outside its vocabulary: ``field, missing, violations``."""
    each = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v"), F.col(f).cast("string").isin(*v).alias("ok")) for f, v in allowed.items()]
    long = rows.select(F.explode(F.array(*each)).alias("x"))
    return long.groupBy("x.field").agg(F.count_if(F.col("x.v").isNull()).alias("missing"), F.count_if(~F.col("x.ok")).alias("violations"))


def normalised(column: Column, allowed: list[str]) -> Column:
    """Trimmed, lower-cased, blanks as underscores; null if that is outside the vocabulary."""
    v = F.regexp_replace(F.lower(F.trim(column)), "[ ]+", "_")
    return F.when(v.isin(*allowed), v)


def gate(value: Column, target: Column, n: Column, least: int) -> Column:
    """Why a gate is not passed: a missing target is a failure of its own; null if it is passed."""
    return F.when(target.isNull(), "no_target").when(value.isNull(), "no_value").when(n < least, "too_few").when(value < target, "below_target")


def decide(family: Column, s: Column, s2: Column, reliability: Column, keep: Column, reject: Column, least: Column) -> Column:
    """Selective decision by policy family: reliability first, then missing scores, then the comparison.

    threshold: s alone; fused: the mean; agreement: both must agree; cascade: s,
    and s2 where s is undecided.
    """

    def by(x: Column) -> Column:
        return F.when(x >= keep, "KEEP").when(x <= reject, "REJECT")

    verdict = F.when(family == "threshold", by(s)).when(family == "fused", by((s + s2) / 2)).when(family == "agreement", F.when(by(s).eqNullSafe(by(s2)), by(s))).when(family == "cascade", F.coalesce(by(s), by(s2)))
    missing = s.isNull() | (s2.isNull() & (family != "threshold"))
    return F.when(F.coalesce(reliability < least, F.lit(True)), "REVIEW:unreliable").when(missing, "REVIEW:missing_score").otherwise(F.coalesce(verdict, F.lit("REVIEW:undecided")))


def route(veto: Column, threshold: Column, certified: Column, score: Column) -> Column:
    """AUTO or REVIEW with the reason: veto, no threshold, not certified, no score, below."""
    blocked = first_reason([("REVIEW:veto", veto), ("REVIEW:no_threshold", threshold.isNull()), ("REVIEW:uncertified", ~F.coalesce(certified, F.lit(False))), ("REVIEW:no_score", score.isNull()), ("REVIEW:below", score < threshold)])
    return F.coalesce(blocked, F.lit("AUTO"))


def consensus(votes: Column) -> tuple[Column, Column]:
    """The most frequent non-null vote, the first seen of ties, and its share of all votes."""
    seen = F.array_compact(votes)
    counted = F.transform(F.array_distinct(seen), lambda v: F.struct((-F.size(F.filter(seen, lambda x: x == v))).alias("n"), F.array_position(seen, v).alias("at"), v.alias("v")))
    best = F.array_min(counted)
    return best["v"], F.when(F.size(seen) > 0, -best["n"] / F.size(votes)).otherwise(0.0)


def argmax(scores: Column, order: list[str]) -> Column:
    """The key of a map's largest value; of ties the first in ``order``. Null for a null or empty map."""
    place = F.array(*[F.lit(x) for x in order])
    ranked = F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), F.array_position(place, e["key"]).alias("at"), e["key"].alias("k")))
    return F.array_min(ranked)["k"]


def structural_veto(mode: Column, top: Column, never: list[str], full: Rules) -> Column:
    """Why automation is not permitted at all, null if it is.

    full: no class of ``never`` and none of the further rules; morphology_only: the
    class alone, where a missing one is a reason; none: nothing.
    """
    by_class = F.when(top.isNull(), "no morphology").when(top.isin(*never), F.concat(top, F.lit(" is never automatic")))
    return F.when(mode == "morphology_only", by_class).when(mode == "full", F.coalesce(by_class, first_reason(full)))


def ontology_action(orders: dict[str, list[str]], never: list[str], required: dict[str, list[str]], actions: dict[str, dict], never_subtypes: list[str] | None = None, nuisance: dict[str, float] | None = None) -> dict[str, Column]:
    """``action, blocked_action, blocked_by`` from the maps ``morphology`` and ``relation``, ``offset``, ``subtype`` and required fields.

    What blocks comes first: a class, then a subtype that is never automatic; a
    required field that is missing or has another value than those allowed; a
    ``nuisance`` (a share, such as that of the camera's own motion) that is missing or
    reaches its limit. Then the first action whose
    classes, confidences, offset and subtype fit is taken; one that is switched off
    goes to review and is recorded as blocked.
    """
    top = {k: argmax(F.col(k), v) for k, v in orders.items()}
    sure = {k: F.element_at(F.col(k), top[k]) for k in orders}
    blocks: Rules = [("never_automatic", top["morphology"].isin(*never))]
    if never_subtypes:
        blocks.append(("subtype_never_automatic", F.coalesce(F.col("subtype").isin(*never_subtypes), F.lit(False))))
    for field, allowed in required.items():
        blocks += [(f"{field}_missing", F.col(field).isNull()), (f"{field}_blocks", ~F.col(field).isin(*allowed))]

    for field, limit in (nuisance or {}).items():
        blocks += [(f"{field}_missing", F.col(field).isNull()), (f"{field}_blocks", F.col(field) >= limit)]

    def fits(spec: dict) -> Column:
        ok = top["morphology"].isin(*spec["morphology"]) & top["relation"].isin(*spec["relation"])
        for k in orders:
            ok &= sure[k] >= spec["min_confidence"]
        if "max_offset" in spec:
            ok &= F.abs(F.coalesce("offset", F.lit(0.0))) <= spec["max_offset"]
        if spec.get("forbid"):
            ok &= ~F.coalesce(F.col("subtype").isin(*spec["forbid"]), F.lit(False))
        return F.coalesce(ok, F.lit(False))

    chosen = first_reason([(name, fits(spec)) for name, spec in actions.items()])
    blocked = first_reason(blocks)
    off = [name for name, spec in actions.items() if not spec.get("enabled", True)]
    taken = F.when(blocked.isNull(), chosen)
    is_off = taken.isin(*off) if off else F.lit(False)
    return {"action": F.when(taken.isNull() | is_off, "REVIEW").otherwise(taken), "blocked_action": F.when(is_off, taken), "blocked_by": blocked}


def joint_action(least: dict[str, float], views: list[str]) -> tuple[Column, Column]:
    """Boundary and semantic evidence joined: the action, and the hard rules that forbid a reject.

    A reset that was observed keeps the boundary, whatever else is known. A reject
    wants all of: a strong absence of a transition, continuity, a reset observed to
    be absent (not merely unseen), an allowed view, no transition nearby, and support
    of the labels both ways; no hard rule may hold.
    """
    c = F.col
    supported = (c("left_supports_right") >= least["support"]) & (c("right_supports_left") >= least["support"])
    hard = all_reasons([
        ("direction_change_is_not_boundary", c("only_turned")),
        ("unseen_reset_is_not_absent_reset", c("reset") == "NOT_OBSERVABLE"),
        ("unobservable_is_not_no_boundary", ~F.coalesce(c("view").isin(*views), F.lit(False))),
        ("same_label_is_not_same_instance", c("same_label") & ~F.coalesce(supported, F.lit(False))),
    ])
    met = (c("morphology") == "NO_TRANSITION") & (c("confidence") >= least["strong"]) & (c("continuity") == "continuous") & (c("reset") == "OBSERVED_ABSENT") & c("view").isin(*views) & (c("nearby").isNull() | (c("nearby") >= least["nearby"])) & supported
    kept = F.coalesce(c("reset") == "OBSERVED_PRESENT", F.lit(False))
    action = F.when(kept, "KEEP_BOUNDARY").when(F.coalesce(met, F.lit(False)) & (F.size(hard) == 0), "AUTO_REJECT_CANDIDATE").otherwise("REVIEW")
    return action, F.when(kept, F.array().cast("array<string>")).otherwise(hard)


def adoption_checks(limits: dict[str, float], low: Column) -> list[Column]:
    """The seven checks of a candidate scorer (``net, harms, gain, worst, fp, fp_base``) and both readings of them.

    strict takes the stated limit on false positives, relative that of the scorer in use.
    """
    c = F.col
    checks = {
        "net_rescues": c("net") >= limits["net"],
        "harms": c("harms") <= limits["harms"],
        "gain": c("gain") >= limits["gain"],
        "worst_fold": c("worst") >= -limits["worst"],
        "fp_absolute": c("fp") <= limits["fp"],
        "fp_relative": c("fp") <= c("fp_base") + 1e-9,
        "interval_above_zero": low > 0,
    }

    def all_but(name: str) -> Column:
        out = F.lit(True)
        for k, v in checks.items():
            out = out if k == name else out & v
        return out

    return [*(v.alias(k) for k, v in checks.items()), all_but("fp_relative").alias("strict"), all_but("fp_absolute").alias("relative")]
