"""Limits of the engine; every operator takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, replace


def _within(value: int, low: int, high: int) -> int:
    return max(low, min(high, int(value)))


#: Names of settings in a file.
NAMES = {
    "TRANSLATION_BASE_URL": "base_url", "TRANSLATION_MODEL": "model", "TRANSLATION_PROTOCOL": "protocol", "TRANSLATION_BATCH_SIZE": "batch_items",
    "TRANSLATION_REQUEST_CHAR_LIMIT": "request_chars", "TRANSLATION_MAX_RETRIES": "max_retries",
}


@dataclass(frozen=True)
class EngineConfig:
    """Settings, brought into their allowed ranges by ``checked``."""

    segment_chars: int = 1200
    batch_items: int = 3
    request_chars: int = 6000
    max_retries: int = 5
    term_limit: int = 120
    style_chars: int = 12_000
    upload_bytes: int = 80 * 1024 * 1024
    sample_segments: int = 30
    quiet_seconds: float = 0.65

    base_url: str = ""
    model: str = ""
    protocol: str = "openai"

    @property
    def configured(self) -> bool:
        """Whether requests can be sent."""
        return bool(self.base_url and self.model and self.protocol in ("openai", "anthropic"))

    @classmethod
    def read(cls, text: str) -> EngineConfig:
        """Settings from lines NAME=value of a file; quotes are taken off, unknown names and values of a wrong kind are left out."""
        found = {}
        for line in text.splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and not name.startswith("#"):
                found[name.removeprefix("export ").strip()] = value.strip().strip("\"'")
        own = {field: found[name] for name, field in NAMES.items() if found.get(name)}
        for field in ("batch_items", "request_chars", "max_retries"):
            if field in own:
                try:
                    own[field] = int(own[field])
                except ValueError:
                    del own[field]
        if "base_url" in own:
            own["base_url"] = own["base_url"].rstrip("/")
        if "protocol" in own:
            own["protocol"] = own["protocol"].lower()
        return cls(**own).checked()

    def checked(self) -> EngineConfig:
        return replace(self, batch_items=_within(self.batch_items, 1, 10), request_chars=_within(self.request_chars, 500, 20_000), max_retries=_within(self.max_retries, 0, 10))
