"""Nested contracts: rules over columns of structs and arrays, and what breaks them with its path.

``faults`` and ``coerced`` turn a rule into one Column of built-in functions, so that a draft is checked where it lies, without exploding it.
Lengths are code points of trimmed texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


@dataclass(frozen=True)
class Text:
    least: int = 1
    most: int | None = None
    optional: bool = False
    trim: bool = True


@dataclass(frozen=True)
class OneOf:
    values: tuple[str, ...]


@dataclass(frozen=True)
class Score:
    """A number in [0, 1]; a lenient one is a text that stands for a number or a word, and is coerced."""

    lenient: bool = False


@dataclass(frozen=True)
class Positive:
    """A whole number above 0."""


@dataclass(frozen=True)
class Flag:
    """true or false."""


@dataclass(frozen=True)
class Mapping:
    """A map; null is an empty one."""


@dataclass(frozen=True)
class Many:
    item: object
    most: int | None = None
    least: int = 0
    default: bool = True  # null is an empty list


@dataclass(frozen=True)
class Record:
    fields: dict = field(default_factory=dict)


def _when(*tests: tuple[Column, str]) -> Column:
    """The first fault as an array of one, or an empty array."""
    out = F.array().cast("array<string>")
    for test, name in reversed(tests):
        out = F.when(test, F.array(F.lit(name))).otherwise(out)
    return out


def _at(path: Column | None, found: Column) -> Column:
    return found if path is None else F.transform(found, lambda f: F.concat(path, F.lit(": "), f))


def faults(rule, c: Column, path: Column | None = None) -> Column:
    """array<string>: every fault of ``c`` as ``path: fault``, in the order of the fields and items."""
    if isinstance(rule, Record):
        inside = [faults(r, c[name], F.lit(name) if path is None else F.concat(path, F.lit(f".{name}"))) for name, r in rule.fields.items()]
        return F.when(c.isNull(), _at(path, _when((F.lit(True), "missing")))).otherwise(F.concat(*inside))
    if isinstance(rule, Many):
        size = [(F.size(c) < rule.least, f"fewer than {rule.least}")] if rule.least else []
        size += [(F.size(c) > rule.most, f"more than {rule.most}")] if rule.most is not None else []
        inside = F.flatten(F.transform(c, lambda x, i: faults(rule.item, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        empty = F.array().cast("array<string>") if rule.default and not rule.least else _at(path, _when((F.lit(True), "missing")))
        return F.when(c.isNull(), empty).otherwise(F.concat(_at(path, _when(*size)), inside))
    if isinstance(rule, Text):
        t = X.normalise_ends(c) if rule.trim else c
        tests = [] if rule.optional else [(c.isNull(), "missing")]
        tests += [(F.length(t) < rule.least, f"shorter than {rule.least}")] if rule.least else []
        tests += [(F.length(t) > rule.most, f"longer than {rule.most}")] if rule.most is not None else []
    elif isinstance(rule, OneOf):
        tests = [(c.isNull(), "missing"), (~c.isin(*rule.values), "not one of " + ", ".join(rule.values))]
    elif isinstance(rule, Score):
        tests = [(c.isNull(), "missing")] + ([] if rule.lenient else [(F.isnan(c) | (c < 0) | (c > 1), "outside 0 to 1")])
    elif isinstance(rule, Positive):
        tests = [(c.isNull(), "missing"), ((c <= 0) | (c != F.floor(c)), "not a positive whole number")]
    elif isinstance(rule, Flag):
        tests = [(c.isNull(), "missing")]
    else:
        tests = []
    return _at(path, _when(*tests))


def coerced(rule, c: Column) -> Column:
    """``c`` as the contract reads it: texts trimmed, defaults filled, lenient scores as numbers. Fields that the rule doesn't name are left out."""
    if isinstance(rule, Record):
        return F.when(c.isNotNull(), F.struct(*[coerced(r, c[name]).alias(name) for name, r in rule.fields.items()]))
    if isinstance(rule, Many):
        return F.transform(F.coalesce(c, F.array()) if rule.default else c, lambda x: coerced(rule.item, x))
    if isinstance(rule, Text) and rule.trim:
        return X.normalise_ends(c)
    if isinstance(rule, Score) and rule.lenient:
        return X.coerce_score(c.cast("string"))
    if isinstance(rule, Mapping):
        return F.coalesce(c, F.create_map().cast("map<string,string>"))
    return c


def validated(rows: DataFrame, draft: str, rule: Record) -> DataFrame:
    """``rows`` with ``faults``, and ``draft`` as the contract reads it if there are none, else null."""
    found = rows.withColumn("faults", faults(rule, F.col(draft)))
    return found.withColumn(draft, F.when(F.size("faults") == 0, coerced(rule, F.col(draft))))


# The limits of the contracts.
_IDS = Many(Text(trim=False), 32)
ENTITY = Record({"name": Text(1, 200), "type": Text(0, 100, optional=True), "aliases": Many(Text(1, 200), 20), "evidence_block_ids": _IDS})
POINT = Record({
    "kind": OneOf(("definition", "concept", "entity", "method", "finding", "relationship", "contradiction", "other")), "title": Text(1, 200), "statement": Text(1, 1500),
    "status": OneOf(("observed", "reported", "inferred")), "scope": Text(0, 500, optional=True), "conditions": Mapping(), "importance": Score(lenient=True), "confidence": Score(lenient=True),
    "evidence_block_ids": _IDS,
})
TOPIC = Record({"title": Text(1, 200), "reason": Text(1, 800), "evidence_block_ids": _IDS})
LINK = Record({"registry_entry_id": Text(trim=False), "reason": Text(1, 500), "evidence_block_ids": _IDS})
SYNTHESIS = Record({
    "summary": Text(1, 2500), "relevance": OneOf(("direct", "partial", "contextual", "out_of_scope")), "relevance_reason": Text(1, 800), "source_boundary": Text(1, 1000),
    "themes": Many(Text(1, 160), 32), "entities": Many(ENTITY, 160), "knowledge_points": Many(POINT, 320), "suggested_topics": Many(TOPIC, 80), "concept_links": Many(LINK, 80),
})
SLICE = Record(SYNTHESIS.fields | {"coverage": Many(Record({"block_id": Text(trim=False), "status": OneOf(("analyzed", "unresolved")), "reason": Text(1, 500)}))})
CLAIM_STATUS = OneOf(("observed", "reported", "inferred"))
ANSWER = Record({
    "answer": Text(1, 8000, trim=False),
    "claims": Many(Record({"text": Text(1, 1000, trim=False), "status": CLAIM_STATUS, "node_ids": Many(Text(trim=False), 8, 1, False), "evidence_ids": Many(Text(trim=False), 12, 1, False)}), 8, default=False),
    "citations": Many(Record({
        "evidence_id": Text(trim=False), "node_id": Text(optional=True, trim=False), "document_id": Text(trim=False), "document_name": Text(trim=False), "page": Positive(), "block_id": Text(trim=False),
        "section": Text(0, optional=True, trim=False), "topic": Text(1, 160, optional=True), "status": CLAIM_STATUS,
    }), 40, default=False),
    "limitations": Many(Text(1, 800, trim=False), 5, default=False),
})
_GROUP = {"canonical_name": Text(1, 200), "canonical_type": Text(1, 100), "canonical_summary": Text(1, 1200), "confidence": Score(), "reason": Text(1, 800)}
_ACTION = lambda member, actions: Record({member: Text(trim=False), "action": OneOf(actions), "scope": Text(0, 500, optional=True), "reason": Text(1, 500)})


def resolution_groups(actions: tuple[str, ...]) -> Record:
    """Groups of candidates, at most 240 with 1 to 80 members each."""
    return Record({"groups": Many(Record(_GROUP | {"canonical_candidate_id": Text(trim=False), "registry_entry_id": Text(optional=True, trim=False), "members": Many(_ACTION("candidate_id", actions), 80, 1, False)}), 240)})


def catalog_groups(actions: tuple[str, ...]) -> Record:
    """Groups of claims, at most 360 with 1 to 120 members each."""
    return Record({"groups": Many(Record(_GROUP | {"canonical_claim_id": Text(trim=False), "importance": Score(), "members": Many(_ACTION("claim_id", actions), 120, 1, False)}), 360)})
