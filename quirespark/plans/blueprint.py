"""A declarative description of a document's structure: levels of headings, rules and exclusions."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..functions.dialect import pattern


@dataclass
class ValidationRules:
    """What a heading has to satisfy besides its pattern; None: no check."""

    max_length: int | None = None
    requires_line_start: bool | None = True
    requires_prev_empty_line: bool | None = None
    must_contain: list[str] | None = None
    must_not_contain: list[str] | None = None
    must_not_end_with: list[str] | None = None
    context_filters: list[str] | None = None  # in words; those with a test (operators.context) are evaluated, others carried along


@dataclass
class HierarchyRule:
    """level: 0 for matter outside the levels, 1 for the top; parent_level: None for the root."""

    level: int
    name: str
    regex: str
    parent_level: int | None = None
    description: str | None = None
    validation_rules: ValidationRules | None = field(default_factory=ValidationRules)

    def __post_init__(self):
        pattern(self.regex)
        if isinstance(self.validation_rules, dict):
            self.validation_rules = ValidationRules(**self.validation_rules)


@dataclass
class ExclusionRule:
    regex: str
    description: str | None = None

    def __post_init__(self):
        pattern(self.regex)


@dataclass
class Blueprint:
    hierarchy_structure: list[HierarchyRule]
    global_exclusion_rules: dict[str, ExclusionRule] | None = None

    def __post_init__(self):
        self.hierarchy_structure = [HierarchyRule(**r) if isinstance(r, dict) else r for r in self.hierarchy_structure]
        if self.global_exclusion_rules is not None:
            self.global_exclusion_rules = {k: ExclusionRule(**r) if isinstance(r, dict) else r for k, r in self.global_exclusion_rules.items()}

    @classmethod
    def from_json(cls, text: str) -> Blueprint:
        return cls(**json.loads(text))

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    def rule_by_level(self, level: int) -> HierarchyRule | None:
        """The first rule of that level."""
        return next((r for r in self.hierarchy_structure if r.level == level), None)
