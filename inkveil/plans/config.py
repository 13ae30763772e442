"""Which rules run: core, packs, custom packs and overrides. Small settings, resolved before a plan is built."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detectors import Detector, registry
from ..operators.render import template_for
from ..operators.scan import ScanOptions, scan
from ..operators.terms import FieldRule, TermList, field_detectors, list_detectors

# Fixed values.
PACKS = {
    "pack-ca-v1": ("canadian-sin", "ca-postal-code", "phone-number", "physical-address", "date-of-birth", "health-identifier", "payment-card", "email", "person-name", "org-name"),
    "pack-us-v1": ("us-ssn", "us-aba-routing", "us-itin", "us-ein", "us-dea-number", "us-zip", "phone-number", "physical-address", "date-of-birth", "health-identifier", "payment-card", "email", "person-name", "org-name"),
    "pack-eu-v1": ("iban", "payment-card", "email", "date-of-birth", "person-name", "org-name", "physical-address"),
}


MAX_NAME, MAX_PROFILES, MAX_CUSTOM_PACKS = 40, 20, 20


@dataclass(frozen=True)
class CustomPack:
    """Rules to switch on, and field rules and terms of its own. save_terms: whether its terms may be stored."""

    id: str
    detector_ids: tuple[str, ...] = ()
    enabled: bool = True
    name: str = ""
    description: str | None = None
    rules: tuple[FieldRule, ...] = ()
    terms: TermList = field(default_factory=lambda: TermList(""))
    save_terms: bool = False

    def detectors(self) -> tuple[Detector, ...]:
        """The rules that its fields and terms make."""
        return (*field_detectors(self.id, self.rules), *list_detectors(self.terms)) if self.enabled else ()


@dataclass(frozen=True)
class Profile:
    core: str = "balanced"
    pack_ids: tuple[str, ...] = ()
    custom_pack_ids: tuple[str, ...] = ()
    overrides: Mapping[str, bool] = field(default_factory=dict)
    format: str = "indexed"
    custom_template: str = ""
    id: str = ""
    name: str = ""
    description: str | None = None


def same_config(a: Profile, b: Profile) -> bool:
    """Whether scans under both are alike: names don't count, nor the order of packs, but that of overrides does."""
    key = lambda p: (p.core, sorted(p.pack_ids), sorted(p.custom_pack_ids), list(p.overrides.items()), p.format, p.custom_template)
    return key(a) == key(b)


def name_problem(name: str) -> str | None:
    """What is wrong with the name of a profile or pack, or None."""
    length = len(name.strip())
    return "A name is needed." if not length else f"A name has at most {MAX_NAME} characters." if length > MAX_NAME else None


def new_id(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex[:12]}"


def core_states(core: str, rules: Iterable[Detector] | None = None) -> dict[str, bool]:
    return {d.id: not d.pack_only and (core == "strict" or not d.strict_only) for d in rules or registry()}


def rule_states(profile: Profile, custom_packs: Iterable[CustomPack] = ()) -> dict[str, bool]:
    """Core, then packs and enabled custom packs, which only switch on, then overrides. Unknown ids are ignored."""
    states = core_states(profile.core)
    own = {p.id: p.detector_ids for p in custom_packs if p.enabled}
    for pack in [*(PACKS.get(p, ()) for p in profile.pack_ids), *(own.get(p, ()) for p in profile.custom_pack_ids)]:
        states.update({i: True for i in pack if i in states})
    states.update({i: on for i, on in profile.overrides.items() if i in states})
    return states


def builtin_profiles() -> dict[str, Profile]:
    personal = {d.id: False for d in registry() if d.category == "personal"}
    return {"balanced": Profile(), "strict": Profile("strict"), "maximum": Profile("strict", tuple(PACKS)), "code-secrets": Profile("strict", overrides=personal)}


def derived_profile(states: Mapping[str, bool]) -> str:
    return next((c for c in ("balanced", "strict") if states == core_states(c)), "custom")


def enabled_ids(profile: Profile, custom_packs: Iterable[CustomPack] = ()) -> tuple[str, ...]:
    """In registry order."""
    return tuple(i for i, on in rule_states(profile, custom_packs).items() if on)


def options(profile: Profile, custom_packs: Iterable[CustomPack] = (), extra: tuple[Detector, ...] = ()) -> ScanOptions:
    """extra: further rules, after those of the profile's own packs."""
    packs = list(custom_packs)
    own = tuple(d for p in packs if p.id in profile.custom_pack_ids for d in p.detectors())
    return ScanOptions(frozenset(enabled_ids(profile, packs)), (*own, *extra), template_for(profile.format, profile.custom_template))


def rule_table(spark: SparkSession) -> DataFrame:
    """(id, ord, name, category, severity, label, priority, mode, explanation, packs): the catalogue of rules."""
    packs = {d.id: [p for p, ids in PACKS.items() if d.id in ids] for d in registry()}
    rows = [(d.id, i, d.name, d.category, d.severity, d.label, d.priority, d.mode, d.explanation, packs[d.id]) for i, d in enumerate(registry())]
    return spark.createDataFrame(rows, "id string, ord int, name string, category string, severity string, label string, priority int, mode string, explanation string, packs array<string>")


def preview(samples: DataFrame, rule_id: str, text_col: str = "text") -> DataFrame:
    """samples with the findings of one rule alone, whatever is on by default."""
    return scan(samples, text_col, ScanOptions(frozenset([rule_id])))


def resolved_rules(rules: DataFrame, packs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The same resolution over tables: profiles (profile, core, packs array, overrides map) against packs (pack_id, detector_id)."""
    asked = profiles.select("profile", F.explode_outer("packs").alias("pack_id")).join(packs, "pack_id").select("profile", F.col("detector_id").alias("id")).distinct().withColumn("in_pack", F.lit(True))
    every = rules.crossJoin(F.broadcast(profiles.select("profile", "core", "overrides"))).join(asked, ["profile", "id"], "left")
    base = (F.col("mode") != "pack") & ((F.col("core") == "strict") | (F.col("mode") != "strict"))
    state = F.coalesce(F.element_at("overrides", F.col("id")), base | F.coalesce("in_pack", F.lit(False)))
    return every.select("profile", "id", "ord", state.alias("enabled"))
