"""Ontology files: JSON under a head of comment lines, read strictly, as a small table of rules."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Fields of an ontology file and of its entries, what a qualifier's value can be, where an assertion can come from.
ROOT = ("schema_version", "ontology_version", "entity_types", "qualifiers", "predicates")
QUALIFIER, PREDICATE = ("id", "value_kinds"), ("id", "subject_types", "object_types", "qualifier_ids", "origins", "allow_self")
KINDS, ORIGINS = ("entity", "literal", "date", "number"), ("explicit", "inferred")
MAX_BYTES = 1 << 20
RULES = "predicate string, subjects array<string>, objects array<string>, qualifiers array<struct<id:string,kinds:array<string>>>, origins array<string>, allow_self boolean"
_ID = re.compile(r"[A-Za-z0-9._:-]{1,128}")


@dataclass(frozen=True)
class Ontology:
    version: str
    sha256: str
    entity_types: tuple[str, ...]
    qualifiers: dict[str, tuple[str, ...]]
    predicates: dict[str, dict]

    def rules(self, spark: SparkSession) -> DataFrame:
        """One row a predicate: a file of a megabyte at most, so small enough to go to every task."""
        rows = []
        for name, p in self.predicates.items():
            rows.append((name, list(p["subject_types"]), list(p["object_types"]), [(q, list(self.qualifiers[q])) for q in p["qualifier_ids"]], list(p["origins"]), p["allow_self"]))
        return spark.createDataFrame(rows, RULES)


def _once(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) != len(pairs):
        raise ValueError("a field comes twice")
    return dict(pairs)


def _exact(value: object, fields: tuple[str, ...]) -> dict:
    if not isinstance(value, dict) or set(value) != set(fields):
        raise ValueError(f"an entry must have exactly the fields {', '.join(fields)}")
    return value


def _names(value: object, what: str, within: tuple[str, ...] | set[str] | None = None, some: bool = True) -> tuple[str, ...]:
    good = isinstance(value, list) and all(isinstance(x, str) and x for x in value) and len(set(value)) == len(value)
    if not good or (some and not value) or (within is not None and not set(value) <= set(within)):
        raise ValueError(f"invalid {what}")
    return tuple(value)


def _identity(value: object, known: dict) -> str:
    if not isinstance(value, str) or not _ID.fullmatch(value) or value in known:
        raise ValueError(f"invalid or repeated id {value}")
    return value


def parse(raw: bytes) -> Ontology:
    """The ontology of a file's bytes; a field too many or too few, a repeated one, a reference to nothing or an empty vocabulary is an error."""
    if not raw or len(raw) > MAX_BYTES or raw.startswith(b"\xef\xbb\xbf"):
        raise ValueError("an ontology is UTF-8 without a mark, of a megabyte at most")
    lines = raw.decode().splitlines()
    first = next((i for i, x in enumerate(lines) if x.strip() and not x.strip().startswith("//")), len(lines))
    root = _exact(json.loads("\n".join(lines[first:]), object_pairs_hook=_once), ROOT)
    if root["schema_version"] != 1 or isinstance(root["schema_version"], bool):
        raise ValueError("schema version must be 1")
    version = _identity(root["ontology_version"], {})
    entities = _names(root["entity_types"], "entity types")
    qualifiers: dict[str, tuple[str, ...]] = {}
    for item in root["qualifiers"]:
        name = _identity(_exact(item, QUALIFIER)["id"], qualifiers)
        qualifiers[name] = _names(item["value_kinds"], f"value kinds of {name}", KINDS)
    predicates: dict[str, dict] = {}
    for item in root["predicates"]:
        name = _identity(_exact(item, PREDICATE)["id"], predicates)
        if not isinstance(item["allow_self"], bool):
            raise ValueError(f"allow_self of {name}")
        predicates[name] = {
            "subject_types": _names(item["subject_types"], f"subject types of {name}", entities), "object_types": _names(item["object_types"], f"object types of {name}", entities),
            "qualifier_ids": _names(item["qualifier_ids"], f"qualifiers of {name}", set(qualifiers), some=False), "origins": _names(item["origins"], f"origins of {name}", ORIGINS), "allow_self": item["allow_self"],
        }
    if not qualifiers or not predicates:
        raise ValueError("the vocabulary is empty")
    return Ontology(version, hashlib.sha256(raw).hexdigest(), entities, qualifiers, predicates)
