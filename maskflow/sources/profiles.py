"""Profile folders: a manifest, rules, terms and an allow list per layer, checked and merged on the driver, as they
are configuration of a few files."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.policy import PolicyError, expand_layers, seal
from ..operators.rules import RULE
from .files import TERM_FILES

KNOWN_DETECTORS = ("regex_checksum", "gazetteer", "ner")
MANIFEST_KEYS = {"name", "extends", "detectors", "gazetteer_dirs", "policy", "content_hash", "signature"}


@dataclass
class Bundle:
    """What a team's layers come to: detectors in order, rules one after the other, terms of which the most specific
    layer's count, allow lists together."""

    layers: list[str] = field(default_factory=list)
    detectors: list[str] = field(default_factory=list)
    rules: list[tuple[str, str]] = field(default_factory=list)
    terms: dict[str, str] = field(default_factory=dict)
    allow: set[str] = field(default_factory=set)
    policies: list[dict] = field(default_factory=list)

    def fingerprint(self) -> str:
        body = [self.layers, self.detectors, bool(self.terms), sorted(self.terms.items()), self.rules, sorted(self.allow), self.policies]
        return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def _manifest(folder: Path) -> dict:
    path = folder / "profile.toml"
    if not path.is_file():
        raise PolicyError(f"{folder.name}: no profile.toml")
    m = tomllib.loads(path.read_text())
    if unknown := set(m) - MANIFEST_KEYS:
        raise PolicyError(f"{folder.name}: unknown keys {sorted(unknown)}")
    return m


def _lines(path: Path) -> list[str]:
    return [x.strip() for x in path.read_text().splitlines() if x.strip() and not x.strip().startswith("#")] if path.is_file() else []


def load(root: str, names: list[str]) -> Bundle:
    """The bundle of some profiles and all that they extend. A sealed layer whose files do not match is an error."""
    out = Bundle()
    for name in expand_layers(names, lambda n: list(_manifest(Path(root, n)).get("extends", []))):
        folder = Path(root, name)
        m = _manifest(folder)
        if m.get("content_hash") and m["content_hash"] != seal({p.relative_to(folder).as_posix(): p.read_bytes() for p in folder.rglob("*") if p.is_file() and p.name != "profile.toml"}):
            raise PolicyError(f"{name}: the seal does not match")
        out.layers.append(name)
        out.detectors += [d for d in m.get("detectors", []) if d not in out.detectors]
        for line in _lines(folder / "replace.md"):
            hit = re.match(RULE, line)
            if not hit:
                raise PolicyError(f"{name}: not a rule: {line!r}")
            out.rules.append(((hit[1] or hit[2]).strip(), (hit[3] or hit[4]).strip()))
        for d in [".", *m.get("gazetteer_dirs", [])]:
            for file, label in TERM_FILES.items():
                out.terms |= dict.fromkeys(_lines(folder / d / file), label)
        out.allow |= set(_lines(folder / "allowlist.txt"))
        out.policies.append(m.get("policy", {}))
    return out


def lint(root: str, name: str) -> list[str]:
    """What is wrong with a profile; empty if nothing is."""
    try:
        bundle = load(root, [name])
    except (PolicyError, tomllib.TOMLDecodeError) as e:
        return [str(e)]
    return [f"unknown detector {d}" for d in bundle.detectors if d not in KNOWN_DETECTORS]
