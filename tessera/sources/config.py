"""Configuration and lock files: small, read on the driver."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .frontmatter import Config

#: Names of configuration files, in the order in which they are looked for.
NAMES = ("wiki.yml", "wiki.yaml", "wiki.json", "wiki.toml")
SECTIONS = {"wiki", "graph", "site", "link", "check", "lint", "sources", "fmt", "sparql"}


@dataclass
class Project:
    """What a configuration file says; unknown sections are refused. A rule that checks and lints share may weigh differently in each."""

    @property
    def severities(self) -> dict[str, str]:
        """Both sections' severities; of a rule in both, the lint's."""
        return self.check_severities | self.lint_severities

    graph: Config = field(default_factory=Config)
    inputs: list[str] = field(default_factory=lambda: ["."])
    exclude: list[str] = field(default_factory=list)
    assets: list[str] = field(default_factory=list)
    link_style: str = "standard"
    check_severities: dict[str, str] = field(default_factory=dict)
    lint_severities: dict[str, str] = field(default_factory=dict)
    sources: dict[str, dict] = field(default_factory=dict)


def find(folder: str) -> str | None:
    """The first configuration file of a folder."""
    return next((str(Path(folder, n)) for n in NAMES if Path(folder, n).is_file()), None)


def as_list(value) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def severity(value) -> str:
    """error, warning or off; true and false mean error and off."""
    if isinstance(value, bool):
        return "error" if value else "off"
    if value not in ("error", "warning", "off"):
        raise ValueError(f"unknown severity {value!r}")
    return value


def load(path: str | None) -> Project:
    """A project from a file or a folder; defaults if there is none."""
    if path and Path(path).is_dir():
        path = find(path)
    if not path:
        return Project()
    text = Path(path).read_text(encoding="utf-8")
    data = (tomllib.loads(text) if path.endswith(".toml") else json.loads(text) if path.endswith(".json") else yaml.safe_load(text)) or {}
    unknown = set(data) - SECTIONS
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    wiki, graph = data.get("wiki", {}), data.get("graph", {})
    context = graph.get("context")
    config = Config()
    if graph.get("base_iri"):
        config.base_iri = graph["base_iri"] if graph["base_iri"].endswith(("/", "#")) else graph["base_iri"] + "/"
    if context is not None:
        # A context without a vocabulary means none; no context at all means the default one.
        config.vocab = context.get("@vocab")
        config.prefixes = {k: v for k, v in context.items() if not k.startswith("@")}
    config.implicit_types = as_list(graph.get("implicit_types"))
    config.implicit_policy = graph.get("implicit_types_policy", config.implicit_policy)
    config.content_predicate = graph.get("content_predicate")
    check, lint = ({k: severity(v) for k, v in (data.get(part) or {}).items() if isinstance(v, (bool, str)) and not k.startswith("remote")} for part in ("check", "lint"))
    return Project(config, as_list(wiki.get("inputs")) or ["."], as_list(wiki.get("exclude")), as_list(wiki.get("assets")), (data.get("link") or {}).get("style", "standard"), check, lint, data.get("sources") or {})


def lockfile(path: str) -> dict[str, dict]:
    """The locked sources by name; a file that is missing or broken has none."""
    try:
        return dict(json.loads(Path(path).read_text(encoding="utf-8")).get("sources", {}))
    except (OSError, ValueError, AttributeError):
        return {}


def schema_registry(bindings: list[tuple[str, str | list[str]]]) -> dict[str, list[str]]:
    """Schemas by class IRI, each once, in the order in which documents bind them."""
    out: dict[str, list[str]] = {}
    for kind, refs in bindings:
        held = out.setdefault(kind, [])
        held += [r for r in dict.fromkeys(as_list(refs)) if r not in held]
    return out
