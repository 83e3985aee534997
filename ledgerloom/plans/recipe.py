"""Recipes: two sources with their keys and the SQL that matches them."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass
from pathlib import Path

TYPES = ("postgres", "elasticsearch", "file", "csv_upload")
PERSISTENT = ("postgres", "elasticsearch")


class RecipeError(ValueError):
    pass


@dataclass(frozen=True)
class RecipeSource:
    alias: str
    type: str
    primary_key: tuple[str, ...]
    uri: str | None = None
    schema: tuple[str, ...] | None = None

    @classmethod
    def from_dict(cls, d: dict) -> RecipeSource:
        if d["type"] not in TYPES:
            raise RecipeError(f"unknown source type {d['type']!r}")
        return cls(d["alias"], d["type"], tuple(d["primary_key"]), d.get("uri"), tuple(d["schema"]) if d.get("schema") is not None else None)


@dataclass(frozen=True)
class Recipe:
    recipe_id: str
    name: str
    match_sql: str
    left: RecipeSource
    right: RecipeSource
    description: str = ""
    match_description: str = ""

    @classmethod
    def from_dict(cls, d: dict) -> Recipe:
        try:
            return cls(d["recipe_id"], d["name"], d["match_sql"], RecipeSource.from_dict(d["sources"]["left"]), RecipeSource.from_dict(d["sources"]["right"]), d.get("description", ""), d.get("match_description", ""))
        except KeyError as e:
            raise RecipeError(f"missing {e.args[0]}") from e

    @classmethod
    def from_json(cls, text: str) -> Recipe:
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict:
        own = asdict(self)
        left, right = own.pop("left"), own.pop("right")
        clean = lambda s: {k: list(v) if isinstance(v, tuple) else v for k, v in s.items() if v is not None}
        return own | {"sources": {"left": clean(left), "right": clean(right)}}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)


def validate(recipe: Recipe) -> list[str]:
    """All faults; none means valid."""
    found = [f"{what} must not be empty" for what, text in (("recipe_id", recipe.recipe_id), ("name", recipe.name), ("match_sql", recipe.match_sql)) if not text.strip()]
    for s in (recipe.left, recipe.right):
        if not s.primary_key:
            found.append(f"source '{s.alias}' needs a primary key")
        if s.type == "file" and not s.schema:
            found.append(f"file source '{s.alias}' must have a schema (expected column names)")
        if s.type in PERSISTENT and not (s.uri or "").strip():
            found.append(f"persistent source '{s.alias}' must have a URI")
    return found


def missing_parts(recipe: dict) -> list[str]:
    """The quick check of a recipe that is still a dictionary."""
    return [f"missing {k}" for k in ("recipe_id", "name", "match_sql", "sources") if not recipe.get(k)]


@dataclass(frozen=True)
class Resolution:
    match_sql: str
    sources: list[tuple[str, str]]
    primary_keys: dict[str, tuple[str, ...]]


def resolve(recipe: Recipe, file_uris: dict[str, str] | None = None) -> Resolution:
    """A source's own URI wins, then the uploaded file of its alias, then none; left before right."""
    both = (recipe.left, recipe.right)
    return Resolution(recipe.match_sql, [(s.alias, s.uri if s.uri is not None else (file_uris or {}).get(s.alias, "")) for s in both], {s.alias: s.primary_key for s in both})


def build(name: str, description: str, match_sql: str, match_description: str, left: RecipeSource, right: RecipeSource, now=time.time) -> Recipe:
    return Recipe(f"recipe-{int(now() * 1000)}", name, match_sql, left, right, description, match_description)


@dataclass
class RecipeBook:
    """Recipes as JSON files in a folder of the driver."""

    folder: Path

    def _path(self, recipe_id: str) -> Path:
        if not recipe_id or any(c in recipe_id for c in "/\\\0") or recipe_id.startswith("."):
            raise RecipeError(f"{recipe_id!r} can't be a recipe's id")
        return Path(self.folder) / f"{recipe_id}.json"

    def save(self, recipe: Recipe) -> None:
        if faults := missing_parts(recipe.to_dict()):
            raise RecipeError("; ".join(faults))
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        self._path(recipe.recipe_id).write_text(recipe.to_json())

    def get(self, recipe_id: str) -> Recipe | None:
        path = self._path(recipe_id)
        return Recipe.from_json(path.read_text()) if path.exists() else None

    def list(self) -> list[Recipe]:
        """Newest first."""
        found = sorted(Path(self.folder).glob("*.json"), key=lambda p: -p.stat().st_mtime_ns) if Path(self.folder).is_dir() else []
        return [Recipe.from_json(p.read_text()) for p in found]
