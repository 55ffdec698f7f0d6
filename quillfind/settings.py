"""Settings with their defaults, and what follows from a change of them."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

#: Dimensions by embedding model, any other has DEFAULT_DIMENSIONS; delays in milliseconds by cadence.
MODEL_DIMENSIONS = {"bge-m3": 1024, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072}
DEFAULT_DIMENSIONS = 768
SEARCH_DELAY_MS = {"always": 500, "sometimes": 2000, "occasionally": 8000}
DEFAULT_DELAY_MS = 500


@dataclass(frozen=True)
class Settings:
    provider: str = "ollama"
    model: str = "nomic-embed-text"
    vector_size: int = 768
    chunk_size: int = 128
    chunk_overlap: int = 16
    context_window_words: int = 64
    search_cadence: str = "sometimes"
    search_mode: str = "hybrid"
    log_level: str = "INFO"
    highlight: bool = True

    @classmethod
    def parse(cls, given: dict) -> Settings:
        """Defaults overlaid with given; integers are read from leading digits, else the default stays."""
        out = cls()
        for f in fields(cls):
            if f.name not in given or given[f.name] is None:
                continue
            value = given[f.name]
            if isinstance(getattr(out, f.name), int) and not isinstance(getattr(out, f.name), bool):
                value = parse_int(value, getattr(out, f.name))
            out = replace(out, **{f.name: value})
        return out


def parse_int(value, default: int) -> int:
    """The leading integer of value, or default when there is none or it is 0."""
    import re

    found = re.match(r"\s*([+-]?\d+)", str(value))
    return (int(found[1]) or default) if found else default


def model_dimensions(model: str) -> int:
    return MODEL_DIMENSIONS.get(model, DEFAULT_DIMENSIONS)


def search_delay_ms(cadence: str) -> int:
    return SEARCH_DELAY_MS.get(cadence, DEFAULT_DELAY_MS)


def requires_reindex(old: Settings, new: Settings) -> bool:
    return any(getattr(old, k) != getattr(new, k) for k in ("provider", "model", "vector_size", "chunk_size", "chunk_overlap"))
