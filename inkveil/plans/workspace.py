"""What a user has set up: profiles, packs, and which profile is active. Values that never change; each edit gives a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..operators.terms import TermList
from .config import MAX_CUSTOM_PACKS, MAX_PROFILES, CustomPack, Profile, builtin_profiles, enabled_ids, name_problem, new_id

#: The id of a changed built-in profile that has no name yet. Changes to it are kept for the session only.
UNSAVED = "unsaved"


@dataclass(frozen=True)
class Workspace:
    active: str = "balanced"
    unsaved: Profile | None = None
    profiles: tuple[Profile, ...] = ()
    packs: tuple[CustomPack, ...] = ()
    remember: bool = False

    def profile(self) -> Profile:
        """The active profile; the balanced one if the active id is unknown."""
        known = {p.id: p for p in self.profiles} | builtin_profiles()
        if self.active == UNSAVED and self.unsaved:
            return self.unsaved
        return known.get(self.active, builtin_profiles()["balanced"])

    def rules(self) -> tuple[str, ...]:
        return enabled_ids(self.profile(), self.packs)


def _changed(w: Workspace, **values) -> Workspace:
    """The active profile with other values: a built-in one becomes the unsaved one, others change in place."""
    made = replace(w.profile(), **values)
    if w.active in {p.id for p in w.profiles}:
        return replace(w, profiles=tuple(made if p.id == w.active else p for p in w.profiles))
    return replace(w, active=UNSAVED, unsaved=replace(made, id=UNSAVED, name="Unsaved"))


def select(w: Workspace, profile_id: str) -> Workspace:
    known = {*builtin_profiles(), *(p.id for p in w.profiles), *([UNSAVED] if w.unsaved else [])}
    if profile_id not in known:
        raise ValueError(f"no such profile: {profile_id}")
    return replace(w, active=profile_id)


def set_rule(w: Workspace, rule_id: str, on: bool) -> Workspace:
    return _changed(w, overrides={**w.profile().overrides, rule_id: on})


def set_pack(w: Workspace, pack_id: str, on: bool) -> Workspace:
    """Adds or removes a pack, built in or of the user, to the active profile."""
    name = "custom_pack_ids" if pack_id in {p.id for p in w.packs} else "pack_ids"
    rest = tuple(p for p in getattr(w.profile(), name) if p != pack_id)
    return _changed(w, **{name: (*rest, pack_id) if on else rest})


def set_format(w: Workspace, format_id: str, template: str = "") -> Workspace:
    return _changed(w, format=format_id, custom_template=template)


def reset(w: Workspace) -> Workspace:
    """The active profile without packs and overrides; an unsaved one goes."""
    if w.active in {p.id for p in w.profiles}:
        return _changed(w, pack_ids=(), custom_pack_ids=(), overrides={})
    return replace(w, active="balanced" if w.active == UNSAVED else w.active, unsaved=None)


def save_profile(w: Workspace, name: str, description: str | None = None) -> Workspace:
    """The active profile under a new name, which becomes the active one: saves an unsaved one, copies any other."""
    if problem := name_problem(name):
        raise ValueError(problem)
    if len(w.profiles) >= MAX_PROFILES:
        raise ValueError(f"There are at most {MAX_PROFILES} profiles.")
    made = replace(w.profile(), id=new_id("profile"), name=name.strip(), description=description)
    return replace(w, profiles=(*w.profiles, made), active=made.id, unsaved=None if w.active == UNSAVED else w.unsaved)


def rename_profile(w: Workspace, profile_id: str, name: str) -> Workspace:
    if problem := name_problem(name):
        raise ValueError(problem)
    return replace(w, profiles=tuple(replace(p, name=name.strip()) if p.id == profile_id else p for p in w.profiles))


def delete_profile(w: Workspace, profile_id: str) -> Workspace:
    return replace(w, profiles=tuple(p for p in w.profiles if p.id != profile_id), active="balanced" if w.active == profile_id else w.active)


def put_pack(w: Workspace, pack: CustomPack) -> Workspace:
    """Adds a pack, or puts it in the place of the one of its id."""
    if problem := name_problem(pack.name):
        raise ValueError(problem)
    if any(p.id == pack.id for p in w.packs):
        return replace(w, packs=tuple(pack if p.id == pack.id else p for p in w.packs))
    if len(w.packs) >= MAX_CUSTOM_PACKS:
        raise ValueError(f"There are at most {MAX_CUSTOM_PACKS} packs.")
    return replace(w, packs=(*w.packs, pack))


def duplicate_pack(w: Workspace, pack_id: str) -> Workspace:
    one = next(p for p in w.packs if p.id == pack_id)
    return put_pack(w, replace(one, id=new_id("pack"), name=f"{one.name[:33]} (copy)"))


def delete_pack(w: Workspace, pack_id: str) -> Workspace:
    """Without the pack, in every profile too."""
    without = lambda p: replace(p, custom_pack_ids=tuple(i for i in p.custom_pack_ids if i != pack_id))
    return replace(w, packs=tuple(p for p in w.packs if p.id != pack_id), profiles=tuple(map(without, w.profiles)), unsaved=w.unsaved and without(w.unsaved))


def apply_list(w: Workspace, pack: CustomPack) -> Workspace:
    """Adds or replaces a pack and switches it on in the active profile, where it is listed once; what is remembered stays."""
    w = put_pack(w, pack)
    return w if pack.id in w.profile().custom_pack_ids else set_pack(w, pack.id, True)


def terms_pack(name: str, terms: TermList) -> CustomPack:
    return CustomPack(new_id("pack"), name=name, terms=terms)
