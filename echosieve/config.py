"""Profiles, settings and fixed values of the repetition engine."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

# They must equal the reference's for equal results.
WEB_STOPWORDS = (
    "a an the and or but if in on at to for of is are was were be been being have has had do does did will would could should may might shall can "
    "i you he she it we they this that these those"
).split()
CLI_STOPWORDS = WEB_STOPWORDS + (
    "with from by not no so just very also about what when where how why who which than then there their them into your our his her its over after before "
    "while because though although through during without within up down off again once only more most some any all each every few many much same other "
    "one two three as here"
).split()
SCAFFOLDS = {"off": "off", "light": "threshold-dedup", "medium": "keep-2", "hard": "keep-1"}
TOOL, MODE, HISTORY_LIMIT = "echosieve.v1", "repetition removal", 250
WEIGHTS = {"web": (0.38, 0.20, 0.16, 0.08, 0.18), "cli": (0.38, 0.30, 0.16, 0.08, 0.08)}  # raw, sequence, bigram, trigram, size


@dataclass(frozen=True)
class Profile:
    name: str
    min_badness: float
    min_viable: float
    min_matches: int
    min_reuse: float
    max_unique: int
    max_remove_ratio: float
    allow_capitalized: bool
    frontier_growth: int


PROFILES = {
    p.name: p
    for p in (
        Profile("none", 999.0, 999.0, 999, 999.0, 0, 0.0, False, 0),
        Profile("low", 2.8, 0.5, 2, 0.65, 2, 0.08, False, 1),
        Profile("med", 1.8, 0.2, 1, 0.5, 4, 0.18, True, 3),
        Profile("high", 1.0, 0.1, 1, 0.4, 6, 0.35, True, 4),
    )
}


@dataclass(frozen=True)
class Settings:
    dialect: str = "web"
    profile: str = "med"
    scaffold: str = "light"
    paragraph_radius: int = 12
    frontier_growth: int = 0  # 0: the profile's
    min_match_score: float = 0.2
    min_shared: int = 1
    min_tokens: int = 3
    max_candidates_per_token: int = 180
    pattern_min_score: float = 0.52
    template_top: int = 40

    def __post_init__(self):
        if self.dialect not in ("web", "cli"):
            raise ValueError(f"unknown dialect {self.dialect!r}")
        if self.profile not in PROFILES:
            raise ValueError(f"unknown profile {self.profile!r}")
        if self.scaffold not in SCAFFOLDS:
            raise ValueError(f"unknown scaffold {self.scaffold!r}")

    @property
    def growth(self) -> int:
        return self.frontier_growth if self.frontier_growth > 0 else PROFILES[self.profile].frontier_growth

    @property
    def policy(self) -> str:
        return SCAFFOLDS[self.scaffold]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str | None) -> Settings:
        """Saved settings; what is missing, unknown or invalid takes its default."""
        out = cls()
        try:
            given = json.loads(text or "{}")
        except ValueError:
            return out
        if not isinstance(given, dict):
            return out
        for k, v in given.items():
            if k in asdict(out) and isinstance(v, type(getattr(out, k))) or k in asdict(out) and isinstance(getattr(out, k), float) and isinstance(v, int):
                try:
                    out = replace(out, **{k: v})
                except ValueError:
                    continue
        return out


WEB = Settings()
CLI = Settings(dialect="cli", scaffold="off", paragraph_radius=6, min_match_score=0.24)


def scaffold_name(policy: str) -> str:
    """The name of a policy; that of none is off."""
    return {v: k for k, v in SCAFFOLDS.items()}.get(policy, "off")


def parse_profiles(text: str) -> list[str]:
    """Names of a comma list; an unknown one is an error."""
    names = [x.strip() for x in text.split(",") if x.strip()]
    unknown = [x for x in names if x not in PROFILES]
    if unknown or not names:
        raise ValueError(f"unknown profiles: {', '.join(unknown) or '(none given)'}")
    return names
