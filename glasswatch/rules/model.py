"""Shapes of the rule data."""

from __future__ import annotations

from dataclasses import dataclass

from glasswatch.functions.regex_dialect import Pattern

STAGES = ("prompt", "file", "index", "output", "session")
ACTIONS = ("disabled", "alert", "notify", "justify", "block")
LEVEL_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


@dataclass(frozen=True)
class Threat:
    threat_id: int
    threat: str
    category: str
    severity: int
    likelihood: int
    response: str
    sources: tuple[str, ...] = ()
    tier: str | None = None
    needs_approval: bool = False
    detect_class: str = "Detect"

    @property
    def risk_score(self) -> int:
        return self.severity * self.likelihood

    @property
    def risk_level(self) -> str:
        score = self.risk_score
        return "Critical" if score >= 20 else "High" if score >= 12 else "Medium" if score >= 6 else "Low"


@dataclass(frozen=True)
class Detector:
    """One ordered detector rule: the first pattern with a match decides.  With a ``scope`` it runs only for rows that
    list that number."""

    detector_id: str
    threat_id: int
    patterns: tuple[Pattern, ...]
    stage: str = "prompt"
    stages: tuple[str, ...] = ()
    mode: str = "warn"
    hint: str = ""
    refine: str | None = None
    scope: int | None = None

    @property
    def where(self) -> tuple[str, ...]:
        return self.stages or (self.stage,)


@dataclass(frozen=True)
class ContentRule:
    rule_id: str
    label: str
    severity: str
    patterns: tuple[Pattern, ...]


def wanted_stages(stage: str) -> tuple[str, ...]:
    """File and index content is reviewed like a prompt; other stages stand alone."""
    return ("prompt", stage) if stage in ("file", "index") else (stage,)


def ci(*sources: str) -> tuple[Pattern, ...]:
    return tuple(Pattern(s, "i") for s in sources)


def cs(*sources: str) -> tuple[Pattern, ...]:
    return tuple(Pattern(s, "") for s in sources)
