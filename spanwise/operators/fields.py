"""Judgement fields from observations: how a label agrees with what was seen, what three passes say together, fields of a model's reply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx


@dataclass
class Ontology:
    """Verbs and objects by the words that name them, verbs that undo each other, and verbs that say little."""

    verbs: dict[str, str]
    objects: dict[str, str]
    inverse: dict[str, list[str]]
    generic: tuple[str, ...]

    def label_verbs(self, text: Column) -> Column:
        """The canonical verbs of a text in order."""
        return tx.canonical(tx.tokens(text), tx.dictionary(self.verbs))

    def first_verb(self, text: Column) -> Column:
        return F.try_element_at(self.label_verbs(text), F.lit(1))

    def first_object(self, text: Column) -> Column:
        return F.try_element_at(tx.canonical(tx.tokens(text), tx.dictionary(self.objects)), F.lit(1))


def verb_relation(onto: Ontology, observed: Column, label_verb: Column) -> Column:
    """same, incompatible or unknown of what was seen (any words) and a canonical verb of the label.

    Words that name no verb are the same as a verb that they hold or that holds them.
    """
    said = F.lower(F.trim(observed))
    known = onto.first_verb(observed)
    undone = F.array(*[F.lit(f"{a} {b}") for x, ys in onto.inverse.items() for y in ys for a, b in ((x, y), (y, x))])
    same = (said == label_verb) | (known == label_verb)
    return (
        F.when(F.coalesce(said, F.lit("")).eqNullSafe("") | label_verb.isNull(), "unknown")
        .when(F.coalesce(same, F.lit(False)), "same")
        .when(known.isNotNull(), F.when(F.array_contains(undone, F.concat_ws(" ", known, label_verb)), "incompatible").otherwise("unknown"))
        .when(F.contains(label_verb, said) | F.contains(said, label_verb), "same")
        .otherwise("unknown")
    )


def semantic_fields(onto: Ontology, observed_verb: Column, observed_object: Column, additional: Column, label: Column) -> dict[str, Column]:
    """``label_support, label_completeness, label_granularity, semantic_relation, object_relation`` of a label, from what was seen.

    Of several verbs in a label one that is the same beats one that is incompatible. A
    label without text is uncertain. ``observed_object`` is canonical; ``additional``: whether more was seen.
    """
    verbs, thing = onto.label_verbs(label), onto.first_object(label)
    rel = F.transform(verbs, lambda v: verb_relation(onto, observed_verb, v))
    verb_rel = F.when(F.array_contains(rel, "same"), "same").when(F.array_contains(rel, "incompatible"), "incompatible").otherwise("unknown")
    obj_rel = F.when(thing.isNull() | observed_object.isNull(), "unknown").when(thing == observed_object, "same").otherwise("wrong_object")
    generic = F.exists(verbs, lambda v: v.isin(*onto.generic)) & ~F.coalesce(onto.first_verb(observed_verb).isin(*onto.generic), F.lit(False))
    none = F.coalesce(label, F.lit("")) == ""
    wrong = (verb_rel == "incompatible") | (obj_rel == "wrong_object")
    fits = obj_rel.isin("same", "unknown")
    good, coarse = (verb_rel == "same") & fits, generic & fits
    more = F.when(F.coalesce(additional, F.lit(False)), "missing_secondary").otherwise("complete")
    return {
        "label_support": F.when(none, "uncertain").when(wrong, "contradicted").when(good | coarse, "supported").otherwise("uncertain"),
        "label_completeness": F.when(none, "unresolved").when(wrong, F.when(verb_rel == "incompatible", "incorrect").otherwise("wrong_object")).when(good | coarse, more).otherwise("unresolved"),
        "label_granularity": F.when(none | wrong, "not_applicable").when(good, F.when(generic, "too_coarse").otherwise("appropriate")).when(coarse, "too_coarse").otherwise("unresolved"),
        "semantic_relation": F.when(none, "unknown").otherwise(verb_rel),
        "object_relation": F.when(none, "unknown").otherwise(obj_rel),
    }


#: What a boundary's truth says of its validity, and what its relation to the annotation asks for.
VALIDITY = {"valid": "valid", "spurious": "invalid", "ambiguous": "ambiguous", "unresolved": "unresolved"}
TEMPORAL_ACTION = {"correctly_annotated": "keep", "missing_from_gt": "add_boundary", "spurious_gt": "remove_boundary", "gt_offset": "shift_boundary", "multiple_valid": "review_convention", "unresolved": "exclude"}


def fused(truth: Column, relation: Column, motion: Column, times: tuple[Column, Column], support: Column, completeness: Column, granularity: Column) -> dict[str, Column]:
    """The fields that three passes (a first look, the label, the time) give together.

    ``times``: that of the last pass and that of the first, which counts where the
    boundary is valid or ambiguous. Values outside the vocabularies are unresolved.
    """
    known = lambda c, names, other: F.when(c.isin(*names), c).otherwise(other)
    t, r = known(truth, VALIDITY, "unresolved"), known(relation, TEMPORAL_ACTION, "unresolved")
    s, c, g = F.coalesce(support, F.lit("uncertain")), F.coalesce(completeness, F.lit("unresolved")), F.coalesce(granularity, F.lit("unresolved"))
    last, first = times
    time = F.round(F.when(t.isin("valid", "ambiguous") & last.isNotNull() & first.isNotNull(), (last + first) / 2).when(t.isin("valid", "ambiguous"), F.coalesce(last, first)).otherwise(last), 2)
    replaced = (s == "contradicted") | c.isin("incorrect", "wrong_object")
    open_ = (s == "uncertain") | (c == "unresolved")
    return {
        "temporal_truth": t,
        "gt_boundary_relation": r,
        "candidate_boundary_validity": F.try_element_at(tx.dictionary(VALIDITY), t),
        "temporal_correction_action": F.try_element_at(tx.dictionary(TEMPORAL_ACTION), r),
        "semantic_correction_action": F.when(replaced, "replace_label").when(c == "missing_secondary", "expand_or_soften").when(g == "too_coarse", "collapse_granularity").when(c == "partially_correct", "repair_partial_label").when(open_, "exclude_or_review").otherwise("keep"),
        "naming_contrastive_role": F.when(open_, "exclude").when(replaced, "hard_negative").when(c.isin("missing_secondary", "partially_correct") | g.isin("too_coarse", "too_fine", "mixed"), "soft_positive").otherwise("strong_positive"),
        "boundary_contrastive_role": F.when(t == "valid", "positive").when((t == "spurious") & F.coalesce(motion == "yes", F.lit(False)), "motion_hard_negative").otherwise("exclude"),
        "corrected_time": time,
        "no_valid_boundary": t.isin("spurious", "unresolved") & time.isNull(),
        "boundary_time_unresolved": t == "unresolved",
    }


#: Fields of a reply that is JSON or nearly so.
VERB_FIELD, OBJECT_FIELD, MORE_FIELD = r'(?i)"(?:primary_verb|verb)"\s*:\s*"([^"]*)"', r'(?i)"object"\s*:\s*"([^"]*)"', r'(?i)"secondary_verbs"\s*:\s*\[([^\]]*)\]'


def reply_fields(onto: Ontology, reply: Column, fallback: Column) -> dict[str, Column]:
    """``verbs`` (canonical, distinct, the primary one first) and ``object`` (canonical) that a reply names; without an object field that of ``fallback``."""
    one = lambda text: F.try_element_at(tx.dictionary(onto.verbs), F.lower(F.trim(text)))
    field = lambda pattern: F.when(reply.rlike(pattern), F.regexp_extract(reply, pattern, 1))
    more = F.transform(F.regexp_extract_all(F.coalesce(field(MORE_FIELD), F.lit("")), F.lit('"([^"]*)"'), F.lit(1)), one)
    verbs = F.array_distinct(F.array_compact(F.concat(F.array(one(field(VERB_FIELD))), more)))
    return {"verbs": verbs, "object": onto.first_object(F.coalesce(F.trim(field(OBJECT_FIELD)), fallback))}
