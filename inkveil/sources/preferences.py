"""Stored preferences: a small JSON file of profiles and packs, never of texts or findings. What is read is rebuilt from what is
allowed; the rest is left out."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Mapping

from ..operators.detectors import registry
from ..operators.render import PRESETS, placeholder_label, template_problem
from ..operators.terms import MAX_LABELS, MAX_MAPPINGS, MAX_TERM_LENGTH, MAX_TERMS, MIN_TERM_LENGTH, SEVERITIES, VALUES, FieldRule, TermList, clean_mapping, field_rule_problem
from ..plans.config import MAX_CUSTOM_PACKS, MAX_NAME, MAX_PROFILES, PACKS, CustomPack, Profile, builtin_profiles, core_states, derived_profile
from ..plans.workspace import Workspace
from .lists import _stored

VERSION = 2
MAX_ID, MAX_DESCRIPTION, MAX_RULES, MAX_PACK_RULES, DEFAULT_LENGTH = 60, 200, 20, 64, 40
# The only categories that stored field rules may have; others become personal.
STORED_CATEGORIES = ("secrets", "infrastructure", "personal", "paths")
DEFAULT_TEMPLATE = PRESETS["indexed"]


def _text(raw: object, longest: int) -> str | None:
    made = raw.strip() if isinstance(raw, str) else ""
    return made if 0 < len(made) <= longest else None


def _object(raw: object) -> Mapping:
    return raw if isinstance(raw, Mapping) else {}


def _list(raw: object) -> list:
    return raw if isinstance(raw, list) else []


def _one_of(raw: object, known: Iterable[str], default: str | None) -> str | None:
    return raw if isinstance(raw, str) and raw in known else default


def _ids(raw: object, known: Callable[[str], bool], most: int) -> tuple[str, ...]:
    return tuple(dict.fromkeys(x for x in _list(raw) if isinstance(x, str) and known(x)))[:most]


def _template(raw: object) -> str:
    return raw if isinstance(raw, str) and template_problem(raw) is None else DEFAULT_TEMPLATE


def clean_format(raw: object) -> tuple[str, str]:
    data = _object(raw)
    return _one_of(data.get("id"), (*PRESETS, "custom"), "indexed"), _template(data.get("customTemplate"))


def clean_rule(raw: object) -> FieldRule | None:
    data = _object(raw)
    labels = [x.strip() for x in _list(data.get("labels")) if isinstance(x, str)]
    labels = [x for x in labels if 0 < len(x) <= MAX_NAME and not set(x) & set("\r\n")][:MAX_LABELS]
    longest = data.get("maxLength")
    made = FieldRule(
        _text(data.get("id"), MAX_ID) or "", _text(data.get("name"), MAX_NAME) or "", tuple(labels), _one_of(data.get("valueType"), VALUES, "") or "",
        data["placeholderLabel"] if isinstance(data.get("placeholderLabel"), str) else "", _one_of(data.get("category"), STORED_CATEGORIES, "personal"),
        _one_of(data.get("severity"), SEVERITIES, "medium"), longest if isinstance(longest, int) and not isinstance(longest, bool) else DEFAULT_LENGTH, data.get("enabled") is not False,
    )
    return made if made.id and made.value_type and field_rule_problem(made) is None else None


def clean_pack(raw: object) -> CustomPack | None:
    """Terms and mappings are read only where the pack says that they may be stored. A missing matchInsideWords counts as set."""
    data, known = _object(raw), {d.id for d in registry()}
    id_, name = _text(data.get("id"), MAX_ID), _text(data.get("name"), MAX_NAME)
    if not id_ or not name:
        return None
    t, terms = data.get("terms"), TermList(name)
    save = isinstance(t, Mapping) and t.get("saveTerms") is True
    if isinstance(t, Mapping):
        values = [v.strip() for v in _list(t.get("values")) if isinstance(v, str)] if save else []
        mappings = [m for m in (clean_mapping(x, f"stored-{i}") for i, x in enumerate(_list(t.get("mappings")))) if m] if save else []
        form = _object(t.get("termFormat"))
        template = {"custom": _template(form.get("customTemplate"))}.get(form.get("id"), PRESETS.get(form.get("id")) if isinstance(form.get("id"), str) else None)
        terms = TermList(
            name, tuple(v for v in values if MIN_TERM_LENGTH <= len(v) <= MAX_TERM_LENGTH)[:MAX_TERMS], tuple(mappings[:MAX_MAPPINGS]), t.get("caseSensitive") is True,
            t.get("matchInsideWords") is not False, placeholder_label(t["termLabel"]) if "termLabel" in t else None, template,
        )
    rules = tuple(r for r in map(clean_rule, _list(data.get("rules"))) if r)[:MAX_RULES]
    return CustomPack(id_, _ids(data.get("detectorIds"), known.__contains__, MAX_PACK_RULES), data.get("enabled") is not False, name, _text(data.get("description"), MAX_DESCRIPTION), rules, terms, save)


def clean_profile(raw: object, packs: Iterable[str] = ()) -> Profile | None:
    data, known, own = _object(raw), {d.id for d in registry()}, set(packs)
    id_, name = _text(data.get("id"), MAX_ID), _text(data.get("name"), MAX_NAME)
    if not id_ or not name or id_ in builtin_profiles():
        return None
    overrides = {k: v for k, v in _object(data.get("overrides")).items() if k in known and isinstance(v, bool)}
    return Profile(
        "strict" if data.get("core") == "strict" else "balanced", _ids(data.get("packIds"), PACKS.__contains__, len(PACKS)), _ids(data.get("customPackIds"), own.__contains__, MAX_CUSTOM_PACKS),
        overrides, *clean_format(data.get("format")), id_, name, _text(data.get("description"), MAX_DESCRIPTION),
    )


def clean(raw: object) -> Workspace | None:
    """A workspace from stored data of this version; None if it is of another."""
    data = _object(raw)
    if data.get("version") != VERSION:
        return None
    packs = tuple(p for p in map(clean_pack, _list(data.get("customPacks"))) if p)[:MAX_CUSTOM_PACKS]
    profiles = tuple(p for p in (clean_profile(x, [k.id for k in packs]) for x in _list(data.get("profiles"))) if p)[:MAX_PROFILES]
    active = _one_of(data.get("activeProfileId"), {*builtin_profiles(), *(p.id for p in profiles)}, "balanced")
    return Workspace(active, None, profiles, packs, True)


def migrated(raw: object) -> Workspace | None:
    """A workspace from the older version, which had states of rules and a format: what isn't a preset becomes a profile."""
    data = _object(raw)
    if data.get("version") != 1:
        return None
    base = core_states("balanced")
    states = base | {k: v for k, v in _object(data.get("ruleStates")).items() if k in base and isinstance(v, bool)}
    core, form = derived_profile(states), clean_format(data.get("format"))
    if core != "custom" and form[0] == "indexed":
        return Workspace(core, remember=True)
    preset = core_states("strict" if core == "strict" else "balanced")
    made = Profile("strict" if core == "strict" else "balanced", overrides={k: v for k, v in states.items() if v != preset[k]}, format=form[0], custom_template=form[1], id="migrated-v1", name="Migrated settings")
    return Workspace(made.id, None, (made,), remember=True)


def _profile(p: Profile) -> dict:
    return {
        "id": p.id, "name": p.name, "description": p.description, "core": p.core, "packIds": list(p.pack_ids), "customPackIds": list(p.custom_pack_ids), "overrides": dict(p.overrides),
        "format": {"id": p.format, "customTemplate": p.custom_template},
    }


def _rule(r: FieldRule) -> dict:
    return {
        "id": r.id, "name": r.name, "labels": list(r.labels), "valueType": r.value_type, "placeholderLabel": r.placeholder_label, "category": r.category, "severity": r.severity,
        "maxLength": r.max_length, "enabled": r.enabled,
    }


def _pack(p: CustomPack) -> dict:
    t = p.terms
    terms = {"caseSensitive": t.case_sensitive, "matchInsideWords": t.inside_words, "saveTerms": p.save_terms}
    terms |= {"values": list(t.values), "mappings": [_stored(m) for m in t.mappings]} if p.save_terms else {}
    terms |= {"termLabel": t.label} if t.label else {}
    terms |= {"termFormat": {"id": "custom", "customTemplate": t.template}} if t.template else {}
    return {"id": p.id, "name": p.name, "description": p.description, "detectorIds": list(p.detector_ids), "rules": [_rule(r) for r in p.rules], "terms": terms, "enabled": p.enabled}


def dump(w: Workspace) -> str:
    """JSON of the workspace; of packs that don't allow it without terms, and without an unsaved profile."""
    active = w.active if w.active in {*builtin_profiles(), *(p.id for p in w.profiles)} else "balanced"
    return json.dumps({"version": VERSION, "activeProfileId": active, "profiles": [_profile(p) for p in w.profiles], "customPacks": [_pack(p) for p in w.packs]}, indent=2, ensure_ascii=False) + "\n"


def save(w: Workspace, path: str) -> bool:
    """Writes the file if the workspace is to be remembered, and removes it if not. Whether there is one now."""
    if not w.remember:
        clear(path)
        return False
    with open(path, "w", encoding="utf-8", newline="") as file:
        file.write(dump(w))
    return True


def load(path: str) -> Workspace:
    """The stored workspace, of either version; a new one if there is none or it can't be used."""
    try:
        with open(path, encoding="utf-8") as file:
            raw = json.load(file)
    except (OSError, ValueError):
        return Workspace()
    return clean(raw) or migrated(raw) or Workspace()


def stored(path: str) -> bool:
    return os.path.exists(path)


def clear(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)
