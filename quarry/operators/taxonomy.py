"""Concepts, software groups and preferred criteria that texts are matched against."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fuzzy import fuzzy_aliases


@dataclass(frozen=True)
class Concept:
    kind: str
    key: str
    label: str
    weight: float
    aliases: tuple[str, ...]


@dataclass(frozen=True)
class Taxonomy:
    concepts: tuple[Concept, ...]
    strong: tuple[str, ...] = field(default=())
    related: tuple[str, ...] = field(default=())

    @classmethod
    def load(cls, path: str) -> Taxonomy:
        """From YAML: concepts, software_groups, preferred_criteria (key: label, weight, aliases), education_fields."""
        import yaml

        with open(path, encoding="utf-8") as file:
            data = yaml.safe_load(file)
        return cls.of(data)

    @classmethod
    def of(cls, data: dict) -> Taxonomy:
        made = []
        for kind, name in (("concept", "concepts"), ("software", "software_groups"), ("preferred", "preferred_criteria")):
            for key, own in (data.get(name) or {}).items():
                weight = float(own.get("weight", 1.0)) if kind == "concept" else 1.0
                made.append(Concept(kind, key, own.get("label") or key.replace("_", " ").title(), weight, tuple(a.casefold() for a in own["aliases"])))
        fields = data.get("education_fields") or {}
        return cls(tuple(made), tuple(fields.get("strong", ())), tuple(fields.get("related", ())))

    def of_kind(self, kind: str) -> list[Concept]:
        return [c for c in self.concepts if c.kind == kind]

    def hits(self, text: Column, kind: str, fuzzy: bool = True) -> Column:
        """Keys of the concepts of which an alias occurs in the normalized text, in the taxonomy's order.

        An alias is a substring; one of eight characters or more may also nearly occur. An alias of which normalizing
        leaves nothing occurs nowhere.
        """
        near = fuzzy_aliases(text, self.aliases(kind)) if fuzzy else F.array().cast("array<string>")
        held = F.transform(F.array(F.struct(text.alias("t"), near.alias("n"))), lambda x: self.held(x, kind, fuzzy))
        return F.coalesce(held[0], F.array().cast("array<string>"))

    def aliases(self, *kinds: str) -> list[str]:
        """The normalized aliases of these kinds."""
        return sorted({n for kind in kinds for c in self.of_kind(kind) for a in c.aliases if (n := _normalized(a))})

    def held(self, x: Column, kind: str, fuzzy: bool) -> Column:
        """hits of a text t, and n, the aliases that nearly occur in it."""
        own = [(c.key, [n for a in c.aliases if (n := _normalized(a))]) for c in self.of_kind(kind)]
        return F.filter(F.array(*[F.when(_any(x, aliases, fuzzy), F.lit(key)) for key, aliases in own]).cast("array<string>"), lambda k: k.isNotNull())


def _any(x: Column, aliases: list[str], fuzzy: bool) -> Column:
    hit = F.lit(False)
    for a in aliases:
        hit = hit | x["t"].contains(a)
    return hit | F.arrays_overlap(x["n"], F.lit(aliases)) if fuzzy and aliases else hit


def _normalized(alias: str) -> str:
    import re

    return " ".join(re.sub(r"[^a-z0-9+#.]+", " ", alias.casefold()).split())
