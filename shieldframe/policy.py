"""Entities, actions, policies and presets: plain driver-side objects that operators compile into Column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

#: Fixed values; the order is that of presets.
ENTITIES = (
    "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN", "IP_ADDRESS", "API_KEY", "PERSON", "ORGANIZATION", "LOCATION",
    "DATE_TIME", "MONEY", "URL", "IBAN_CODE", "US_BANK_NUMBER", "PASSPORT", "DRIVER_LICENSE", "MEDICAL_LICENSE",
)
ACTIONS = ("keep", "redact", "label", "tokenize", "hash", "generalize", "synthetic")
NEVER_REVERSIBLE = ("keep", "redact", "label", "hash")
PPM = 1_000_000
DAY = 86_400


class Blocked(Exception):
    """A whole batch can't be protected under its policy; the reason is the message."""


@dataclass(frozen=True)
class Rule:
    entity: str
    action: str = "tokenize"
    enabled: bool = True
    reversible: bool | None = None
    minimum_confidence_ppm: int = 500_000
    priority: int = 0
    locale: str = "en-US"
    scopes: tuple[str, ...] = ("*",)
    required_detectors: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.entity not in ENTITIES:
            raise ValueError(f"unknown entity {self.entity!r}")
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")
        if not 0 <= self.minimum_confidence_ppm <= PPM or abs(self.priority) > PPM:
            raise ValueError("confidence or priority out of range")
        if not self.scopes:
            raise ValueError("a rule needs a scope")
        if self.reversible is None:
            object.__setattr__(self, "reversible", self.action == "tokenize")
        elif self.reversible and self.action in NEVER_REVERSIBLE:
            raise ValueError(f"{self.action} can't be reversible")

    @property
    def active(self) -> bool:
        """Whether matches of the entity are looked for at all; scopes don't matter here."""
        return self.enabled and self.action != "keep"

    def claims(self, scope: str) -> bool:
        return "*" in self.scopes or scope in self.scopes


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[Rule, ...]
    version: int = 1
    allow_terms: tuple[str, ...] = ()
    deny_terms: Mapping[str, str] = field(default_factory=dict)
    mapping_retention_seconds: int = DAY
    audit_retention_seconds: int = 30 * DAY

    def __post_init__(self) -> None:
        entities = [r.entity for r in self.rules]
        if len(set(entities)) != len(entities):
            raise ValueError("one rule per entity")
        if self.version < 1 or self.mapping_retention_seconds < 1 or self.audit_retention_seconds < 1:
            raise ValueError("version and retentions must be positive")
        if any(not t for t in self.deny_terms) or set(self.deny_terms.values()) - set(ENTITIES):
            raise ValueError("deny terms need a text and a known entity")

    def to_json(self) -> str:
        """The policy as JSON, keys in order."""
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Policy:
        found = json.loads(text)
        rules = tuple(Rule(**(r | {"scopes": tuple(r["scopes"]), "required_detectors": tuple(r["required_detectors"])})) for r in found["rules"])
        return Policy(**(found | {"rules": rules, "allow_terms": tuple(found["allow_terms"])}))

    def rule(self, entity: str) -> Rule | None:
        return next((r for r in self.rules if r.entity == entity and r.enabled), None)

    def active(self) -> dict[str, Rule]:
        return {r.entity: r for r in self.rules if r.active}

    def gate(self, available: Sequence[str], scope: str | None = "*", has_key: bool = False) -> None:
        """Raises Blocked where a required detector or the key for a reversible rule is missing. Without a scope (rows have
        scopes of their own) every rule counts."""
        reversible = [r for r in self.active().values() if r.reversible and (scope is None or r.claims(scope))]
        if reversible and not has_key:
            raise Blocked("reversible rules need a key")
        missing = sorted({d for r in self.active().values() for d in r.required_detectors} - set(available))
        if missing:
            raise Blocked(f"required detectors unavailable: {', '.join(missing)}")


_SECRETS = ("API_KEY", "CREDIT_CARD", "US_SSN", "IBAN_CODE", "US_BANK_NUMBER", "PASSPORT", "DRIVER_LICENSE", "MEDICAL_LICENSE")
#: Actions by preset; an entity that isn't listed is tokenized.
PRESETS: dict[str, dict[str, str]] = {
    "balanced": {"API_KEY": "redact", "DATE_TIME": "generalize", "MONEY": "generalize", "URL": "keep"},
    "strict": dict.fromkeys(_SECRETS, "redact"),
    "healthcare": dict.fromkeys(_SECRETS, "redact") | {"PERSON": "synthetic", "LOCATION": "synthetic", "DATE_TIME": "synthetic"},
    "finance": {"API_KEY": "redact", "US_SSN": "redact", "PASSPORT": "redact", "DRIVER_LICENSE": "redact", "MEDICAL_LICENSE": "redact", "MONEY": "synthetic"},
    "devsecops": {"API_KEY": "redact", "PERSON": "keep", "ORGANIZATION": "keep", "LOCATION": "keep", "DATE_TIME": "keep", "MONEY": "keep", "URL": "keep"},
}
#: Entities whose made-up values a preset can take back, and entities with a floor of their own.
REVERSIBLE: dict[str, tuple[str, ...]] = {"healthcare": ("PERSON", "LOCATION", "DATE_TIME")}
FLOORS = {"PERSON": 650_000, "LOCATION": 650_000, "ORGANIZATION": 650_000}


def preset(name: str) -> Policy:
    """A preset's policy, by name in any case."""
    actions = PRESETS.get(name.lower())
    if actions is None:
        raise ValueError(f"unknown preset {name!r}")
    own = REVERSIBLE.get(name.lower(), ())
    rules = (Rule(e, actions.get(e, "tokenize"), reversible=True if e in own else None, minimum_confidence_ppm=FLOORS.get(e, 500_000)) for e in ENTITIES)
    return Policy(name.lower(), tuple(rules))


def uniform(action: str, entities: Sequence[str] = ENTITIES, **options) -> Policy:
    """One action for all `entities`."""
    return Policy(f"uniform-{action}", tuple(Rule(e, action, **options) for e in entities))


def with_rules(policy: Policy, **changes) -> Policy:
    """The policy with fields of every rule changed."""
    return replace(policy, rules=tuple(replace(r, **changes) for r in policy.rules))
