"""What a query means. A query is a constant: this runs on the driver and its lists become literals of the plan."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from millrace.functions.text import ABBREVIATIONS

LADDER = ("intern", "entry", "mid", "senior", "lead", "exec")


def normalise(text: str) -> str:
    out = re.sub(r"[^a-z0-9+#/&.\- ]+", " ", f" {text.lower()} ")
    for pattern, full in ABBREVIATIONS:
        out = re.sub(pattern, full, out)
    return " ".join(out.split())


@dataclass(frozen=True)
class Family:
    """A kind of role: its own names, other names, skills, and the ids of families it is confused with."""

    id: str
    canonical: tuple[str, ...]
    aliases: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    confused_with: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vocabulary:
    families: tuple[Family, ...] = ()
    seniority: dict[str, str] = field(default_factory=dict)
    noise_titles: tuple[str, ...] = ()

    @staticmethod
    def from_json(text: str) -> Vocabulary:
        found = json.loads(text)
        families = tuple(Family(f["id"], *(tuple(f.get(k, ())) for k in ("canonical", "aliases", "skills", "confused_with"))) for f in found["families"])
        terms = {phrase: level for level, phrases in found.get("seniority_terms", {}).items() for phrase in phrases}
        return Vocabulary(families, terms, tuple(found.get("noise_titles", ())))

    @property
    def skills(self) -> list[str]:
        return list(dict.fromkeys(k for f in self.families for s in f.skills if (k := normalise(s))))


@dataclass(frozen=True)
class Intent:
    normalised: str = ""
    terms: tuple[str, ...] = ()
    family: str = ""
    aliases: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    rivals: tuple[str, ...] = ()
    seniority: str = ""


def terms_of(normalised: str) -> tuple[str, ...]:
    """Words of more than one character."""
    return tuple(t for t in normalised.split() if len(t) > 1)


def for_family(family: Family, vocabulary: Vocabulary, normalised: str = "", seniority: str = "") -> Intent:
    """The intent of a role: siblings' own names are rivals unless they are names of this one too."""
    names = tuple(dict.fromkeys(normalise(p) for p in family.canonical + family.aliases))
    siblings = [f for f in vocabulary.families if f.id in family.confused_with]
    rivals = tuple(dict.fromkeys(r for f in siblings for p in f.canonical if (r := normalise(p)) not in names))
    wanted = normalised or normalise(family.canonical[0])
    return Intent(wanted, terms_of(wanted), family.id, names, tuple(normalise(s) for s in family.skills), rivals, seniority)


def query_seniority(query: str, vocabulary: Vocabulary) -> str:
    """The level of the longest phrase (over two characters) that stands alone in the query."""
    fits = [p for p in vocabulary.seniority if len(p) > 2 and re.search(rf"(?<![a-z0-9]){re.escape(p)}(?![a-z0-9])", query)]
    return vocabulary.seniority[max(fits, key=len)] if fits else ""


def understand(query: str, vocabulary: Vocabulary) -> Intent:
    """The family whose longest phrase the query holds, else the query's words alone."""
    text = normalise(query)
    held = [(len(n), -i, f) for i, f in enumerate(vocabulary.families) for p in f.canonical + f.aliases if (n := normalise(p)) and n in text]
    level = query_seniority(text, vocabulary)
    if held:
        return for_family(max(held, key=lambda h: h[:2])[2], vocabulary, text, level)
    return Intent(text, terms_of(text), seniority=level)
