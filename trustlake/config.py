"""Settings from a YAML file and the environment, and which source and scope they mean."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from trustlake import schema
from trustlake.plans.audit import Settings


@dataclass
class Config:
    source: str | None = None
    base_url: str = ""
    api_token: str = ""
    api_key: str = ""
    space_key: str | None = None
    page_id: str | None = None
    root_page_id: str | None = None
    database_id: str | None = None
    warning_days: int = schema.AGE_WARNING_DAYS
    critical_days: int = schema.AGE_CRITICAL_DAYS
    similarity_threshold: float = schema.SIMILARITY_THRESHOLD
    current_versions: dict[str, str] = field(default_factory=dict)
    version_patterns: tuple[str, ...] = (r"v\d+\.\d+(\.\d+)?",)

    @classmethod
    def load(cls, path: str | None = None, environ: dict[str, str] | None = None) -> Config:
        """From a YAML file (sections notion, confluence, analyzers); variables of the environment go before it."""
        environ = os.environ if environ is None else environ
        raw: dict = {}
        if path and Path(path).exists():
            import yaml

            raw = yaml.safe_load(Path(path).read_text()) or {}
        wiki, space, looks = raw.get("confluence") or {}, raw.get("notion") or {}, raw.get("analyzers") or {}
        age, near, versions = (looks.get(k) or {} for k in ("timestamp", "similarity", "version_refs"))
        one = lambda name, given, default="": environ.get(name) or given or default
        return cls(
            base_url=one("CONFLUENCE_BASE_URL", wiki.get("base_url")).rstrip("/"), api_token=one("CONFLUENCE_API_TOKEN", wiki.get("api_token")), api_key=one("NOTION_API_KEY", space.get("api_key")),
            space_key=wiki.get("space_key"), page_id=wiki.get("page_id"), root_page_id=space.get("root_page_id"), database_id=space.get("database_id"),
            warning_days=age.get("warning_days", schema.AGE_WARNING_DAYS), critical_days=age.get("critical_days", schema.AGE_CRITICAL_DAYS), similarity_threshold=near.get("threshold", schema.SIMILARITY_THRESHOLD),
            current_versions=versions.get("current_versions") or {}, version_patterns=tuple(versions.get("patterns") or cls.version_patterns),
        )

    def source_kind(self) -> str:
        """The wiki where it has an address and a token, else the workspace."""
        return self.source or ("confluence" if self.base_url and self.api_token else "notion")

    def settings(self, as_of: datetime) -> Settings:
        return Settings(as_of, self.warning_days, self.critical_days, self.similarity_threshold, self.current_versions, self.version_patterns)


def tree_target(kind: str, target: str) -> tuple[str, str]:
    """(kind of target, value) of a page tree's root: a wiki page is a number; a workspace page an address, an id or a title."""
    target = target.strip()
    if not target:
        raise ValueError("a page tree needs a root")
    if kind == "confluence":
        if not target.isdigit():
            raise ValueError("a wiki page id is a number")
        return "id", target
    if m := re.search(r"([0-9a-fA-F]{32})(?:[?#].*)?$", target.replace("-", "")):
        h = m[1].lower()
        return "id", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
    if target.startswith(("http://", "https://")):
        raise ValueError("no page id in this address")
    return "title", target
