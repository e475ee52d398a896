"""Settings, as an immutable record with checked updates."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from .errors import InvalidRequest


@dataclass(frozen=True)
class Settings:
    """Limits that operators use unless told otherwise."""

    max_download_bytes: int = 1_000_000
    revisit_days: int = 28
    links_per_page: int = 500
    links_considered: int = 5000
    max_link_priority: int = 740_000_000
    max_chunk_sequence: int = 2000
    max_host_issues: int = 3
    buffer_items_per_ip: int = 2000
    recent_links: int = 1_000_000
    recent_ips: int = 12_000
    recent_keywords: int = 10_000
    packet_resources: int = 100_000
    query_budget_ms: float = 100.0
    reload_every: int = 1000
    max_results: int = 1000

    def with_value(self, name: str, text: str) -> Settings:
        """A copy with one setting parsed from text."""
        kinds = {f.name: type(f.default) for f in fields(self)}
        if name not in kinds:
            raise InvalidRequest(f"no setting is called {name}")
        try:
            return replace(self, **{name: kinds[name](text)})
        except ValueError as e:
            raise InvalidRequest(f"{name} can't be {text!r}") from e

    def listing(self) -> list[tuple[str, str]]:
        return [(f.name, str(getattr(self, f.name))) for f in fields(self)]
