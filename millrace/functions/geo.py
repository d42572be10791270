"""Places named in free text, against an injected gazetteer of cities, metros and states.

Gazetteers are small and fixed, so they become literals; the query's side is settled on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gazetteer:
    cities: dict[str, tuple[str, ...]]
    metros: dict[str, tuple[str, ...]] = field(default_factory=dict)
    states: dict[str, tuple[str, ...]] = field(default_factory=dict)
    city_state: dict[str, str] = field(default_factory=dict)
    country: tuple[str, ...] = ()
    anywhere: str = "(?!)"
    region_lock: str = "(?!)"
    bare_remote: tuple[str, ...] = ("remote", "remote worldwide", "fully remote", "remote - global")

    @staticmethod
    def from_json(text: str) -> Gazetteer:
        v = json.loads(text)
        return Gazetteer({c: tuple(a) for c, a in v["cities"].items()}, {m: tuple(c) for m, c in v.get("metro_areas", {}).items()}, {s: tuple(a) for s, a in v.get("states", {}).items()},
                         v.get("city_state", {}), tuple(v.get("india_terms", v.get("country_terms", ()))), v.get("anywhere_pattern", "(?!)"), v.get("region_lock_pattern", "(?!)"))

    def aliases(self) -> dict[str, str]:
        return {a: c for c, names in self.cities.items() for a in dict.fromkeys((c, *names))}

    def metro_of(self, city: str) -> str | None:
        return next((m for m, cities in self.metros.items() if city in cities), None)

    def market(self, city: str) -> set[str]:
        return set(self.metros.get(self.metro_of(city) or "", ())) | {city}

    def city_named(self, text: str) -> str | None:
        """The longest alias that text names; earlier ones win ties."""
        low, words = text.lower(), set(re.findall("[a-z]+", text.lower()))
        hits = [(len(a), c) for a, c in self.aliases().items() if (a in low if " " in a else a in words)]
        return max(hits, key=lambda h: h[0])[1] if hits else None


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1))


def _named(text: Column, alias: str) -> Column:
    return F.lower(text).contains(alias) if " " in alias else F.array_contains(words(text), alias)


def cities_in(text: Column, g: Gazetteer) -> Column:
    """All canonical cities that text names: several words as a substring, one as a whole word."""
    held = [F.when(_named(text, a), F.lit(c)) for a, c in g.aliases().items()]
    return F.array_distinct(F.array_compact(F.array(*held)))


def canonical_city(text: Column, g: Gazetteer) -> Column:
    longest = sorted(g.aliases().items(), key=lambda kv: -len(kv[0]))
    return F.coalesce(*[F.when(_named(text, a), F.lit(c)) for a, c in longest], F.lit(None).cast("string"))


def metro_area(city: Column, g: Gazetteer) -> Column:
    out = F.lit(None).cast("string")
    for m, cities in g.metros.items():
        out = F.when(city.isin(*cities), m).otherwise(out)
    return out


def same_metro(a: Column, b: Column, g: Gazetteer) -> Column:
    return F.coalesce((a == b) | (metro_area(a, g) == metro_area(b, g)), F.lit(False))


def states_in(text: Column, g: Gazetteer) -> Column:
    """The states that text names by any of their aliases."""
    held = []
    for state, aliases in g.states.items():
        hit = F.lower(text).contains(state)
        for a in aliases:
            hit = hit | F.lower(text).contains(a)
        held.append(F.when(hit, F.lit(state)))
    return F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")


def _is_in(text: Column, names) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.array_contains(words(text), n)
    return out


def in_country(text: Column, g: Gazetteer) -> Column:
    return (F.size(cities_in(text, g)) > 0) | _is_in(text, g.country)


def open_anywhere(location: Column, description: Column, g: Gazetteer) -> Column:
    """Remote work that is not tied to a region; an empty location needs the description to say so."""
    head = F.substring(description, 1, 800)
    bare = F.lower(F.trim(location))
    return (F.when(F.concat_ws(" ", location, head).rlike(f"(?i){g.region_lock}"), False).when(location.rlike(f"(?i){g.anywhere}"), True)
            .when(bare == "", head.rlike(f"(?i){g.anywhere}")).otherwise(bare.isin(*g.bare_remote)))


def locality(location: Column, query: str, g: Gazetteer, remote: Column, description: Column, country_codes: tuple[str, ...] = ("in",)) -> Column:
    """How a place satisfies a query: exact, metro, region, remote or empty."""
    if not query:
        return F.lit("exact")
    q = query.strip().lower()
    far = F.when(remote & open_anywhere(location, description, g), "remote").otherwise("")
    if q in g.country or q in country_codes:
        return F.when(in_country(location, g), "region").otherwise(far)
    city = g.city_named(q)
    if city is None:
        return F.when(_is_in(location, sorted(set(re.findall("[a-z]+", q)))), "exact").otherwise(far)
    named, states = cities_in(location, g), states_in(location, g)
    near = F.array(*[F.lit(c) for c in sorted(g.market(city))])
    own_states = sorted({g.city_state[c] for c in g.market(city) if c in g.city_state})
    same_state = F.arrays_overlap(states, F.array(*[F.lit(s) for s in own_states])) if own_states else F.lit(False)
    return (F.when(F.array_contains(named, city), "exact").when(F.arrays_overlap(named, near), "metro").when(F.size(named) > 0, far)
            .when(F.size(states) > 0, F.when(same_state, "region").otherwise(far)).when(in_country(location, g), "region").otherwise(far))


RANKS = ("", "remote", "region", "metro", "exact")


def best_locality(location: Column, cities: list[str], g: Gazetteer, remote: Column, description: Column, nearby: bool = True) -> Column:
    """The best match among picked cities; the country's name alone matches none, and without nearby a metro match does not count."""
    kinds = []
    for c in cities:
        kind = locality(location, c, g, remote, description)
        bare = (F.size(cities_in(location, g)) == 0) & (F.size(states_in(location, g)) == 0) & (kind == "region")
        kinds.append(F.when(bare | ((kind == "metro") & F.lit(not nearby)), "").otherwise(kind))
    ranks = F.array(*[F.lit(r) for r in RANKS])
    best = F.greatest(F.lit(1), *[F.array_position(ranks, k) for k in kinds])
    return F.element_at(ranks, best.cast("int"))


def picker_order(g: Gazetteer, first: str, metros: tuple[str, ...] = ()) -> list[str]:
    """Cities for a picker: those of one metro as it lists them, then metros (if none are given, the other metros' cities as they are listed), then the rest by name."""
    listed = metros or tuple(c for m, cities in g.metros.items() if m != first for c in cities)
    return list(dict.fromkeys(c for c in (*g.metros.get(first, ()), *listed, *sorted(g.cities)) if c in g.cities))
