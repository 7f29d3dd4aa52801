"""Semantic tags of columns: parsing, spelling, lineage, selection."""

from __future__ import annotations

import re
from collections.abc import Iterable

#: Built-in parents of tags.
PARENTS = {
    "CAT": ["CATEGORY"], "NOMINAL": ["CATEGORY"], "ORDINAL": ["CATEGORY"], "STAGE": ["CATEGORY"], "EVENT": ["CATEGORY"],
    "DOB": ["BIRTHDATE", "DATE"],
    "PATIENT_ID": ["ID(patient)", "ID"], "HOSPITAL_ID": ["ID(hospital)", "ID"], "FACILITY_ID": ["ID(facility)", "ID"], "ORGANIZATION_ID": ["ID(organization)", "ID"],
    "SAMPLE_ID": ["ID(sample)", "ID"], "SPECIMEN_ID": ["ID(specimen)", "ID"], "ORDER_ID": ["ID(order)", "ID"], "ENCOUNTER_ID": ["ID(encounter)", "ID"], "VISIT_ID": ["ID(visit)", "ID"],
    "COLLECTION_DATE": ["DATE"], "RECEIVED_DATE": ["DATE"], "REPORT_DATE": ["DATE"], "CALIBRATION_DATE": ["DATE"], "ORDER_DATE": ["DATE"],
    "COLLECTION_AT": ["DATETIME"], "RESULT_TIME": ["DATETIME"], "RECEIVED_AT": ["DATETIME"], "ORDER_AT": ["DATETIME"],
    "ORDER_PLACED_AT": ["DATETIME"], "SPECIMEN_COLLECTED_AT": ["DATETIME"], "LAB_RECEIVED_AT": ["DATETIME"], "LAB_SECTION_RECEIVED_AT": ["DATETIME"],
    "TEST_STARTED_AT": ["DATETIME"], "RESULT_CREATED_AT": ["DATETIME"], "PRELIMINARY_REPORTED_AT": ["DATETIME"], "FINAL_REPORTED_AT": ["DATETIME"],
}
#: Qualified identifiers that stand for a tag of their own.
for _kind in ("patient", "hospital", "facility", "organization", "sample", "specimen", "order", "encounter", "visit"):
    PARENTS.setdefault(f"ID({_kind})", [f"{_kind.upper()}_ID"])


def normalise(tag: str) -> str:
    """Upper case; a qualifier in brackets keeps its case, that of ID is lower-cased."""
    m = re.fullmatch(r"\s*([^()]+?)\s*(?:\((.*)\))?\s*", tag)
    if not m:
        return tag.strip().upper()
    base, inner = m[1].upper(), m[2]
    return base if inner is None else f"{base}({inner.strip().lower() if base == 'ID' else inner})"


def distinct(tags: Iterable[str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(normalise(t) for t in tags if t.strip()))


def parse_header(header: str) -> tuple[str, tuple[str, ...]]:
    """``[[A::B]]name`` or the older ``_A::B_name`` -> (name, tags).  A header of tags alone keeps its block as name."""
    m = re.match(r"^\[\[(.+?)\]\](.*)$", header, re.S)
    if m:
        return (m[2] or f"[[{m[1]}]]"), distinct(m[1].split("::"))
    if header.startswith("_") and (end := _legacy_end(header)):
        block = header[1:end].replace("\\_", "_").replace("\\\\", "\\")
        name = header[end + 1 :]
        return (name or header), distinct(block.split("::"))
    return header, ()


def _legacy_end(header: str) -> int:
    at = 1
    while at < len(header):
        if header[at] == "\\":
            at += 2
            continue
        if header[at] == "_" and at > 1:
            return at if "::" in header[:at] or header[1:at].isupper() else 0
        at += 1
    return 0


def build_header(name: str, tags: Iterable[str]) -> str:
    tags = distinct(tags)
    if not tags:
        return name
    block = f"[[{'::'.join(tags)}]]"
    return block if name == block else block + name


def lineage(tags: Iterable[str], definitions: dict | None = None) -> tuple[str, ...]:
    """Tags with all their ancestors; cycles are harmless."""
    known = {normalise(k): v for k, v in (definitions or {}).items() if isinstance(v, dict)}
    out: dict[str, None] = {}
    todo = list(distinct(tags))
    while todo:
        tag = todo.pop(0)
        if tag in out:
            continue
        out[tag] = None
        spec = {k.upper(): v for k, v in known.get(tag, {}).items()}
        for key in ("INHERITS", "EXTENDS", "IS_A"):
            up = spec.get(key, [])
            todo += map(normalise, [up] if isinstance(up, str) else up)
        todo += map(normalise, PARENTS.get(tag, []))
        if "(" in tag:
            todo.append(tag.split("(")[0])
    return tuple(out)


def tag_property(tags: Iterable[str], key: str, definitions: dict | None = None, default=None):
    """First property along the lineage, also below EDA, ANALYSIS or PROPERTIES."""
    known = {normalise(k): v for k, v in (definitions or {}).items() if isinstance(v, dict)}
    for tag in lineage(tags, definitions):
        spec = {k.upper(): v for k, v in known.get(tag, {}).items()}
        for place in (spec, *(spec.get(k) for k in ("EDA", "ANALYSIS", "PROPERTIES"))):
            if isinstance(place, dict):
                for k, v in place.items():
                    if k.upper() == key.upper():
                        return v
    return default


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get ``.1``, ``.2`` ... that no other raw name has."""
    raw, seen, out = set(names), set(), []
    for name in names:
        pick, k = name, 0
        while pick in seen or (k and pick in raw):
            k += 1
            pick = f"{name}.{k}"
        seen.add(pick)
        out.append(pick)
    return out
