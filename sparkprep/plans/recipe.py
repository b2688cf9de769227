"""The recipe: an ordered, JSON-serialisable list of steps."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class Step:
    id: str
    operation: str
    column: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def target(self) -> str:
        """The column the step works on: ``params['col']`` wins over ``column``."""
        return (self.params or {}).get("col") or self.column


@dataclass(frozen=True)
class Recipe:
    steps: Sequence[Step]
    session_id: str = ""

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> Recipe:
        steps = [
            Step(str(s["id"]), s["operation"], s.get("column") or "", dict(s.get("params") or {}))
            for s in data["steps"]
        ]
        return cls(steps, data.get("session_id", ""))

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        return cls.from_dict(json.loads(text))

    @classmethod
    def of(cls, *steps: tuple) -> Recipe:
        """Shorthand: ``Recipe.of(("fill_na_mean", "x"), ("bin_numeric", "y", {"bins": 3}))``."""
        return cls([Step(str(i), s[0], s[1], s[2] if len(s) > 2 else {}) for i, s in enumerate(steps, 1)])

    def to_dict(self) -> dict[str, Any]:
        return {"session_id": self.session_id, "steps": [asdict(s) | {"params": dict(s.params)} for s in self.steps]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict())
