"""Checks of the provider, the models, the store and the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from quillfind.operators.embed import EmbeddingService, ModelManager, Provider


@dataclass(frozen=True)
class Result:
    success: bool
    message: str
    error: str | None = None


@dataclass(frozen=True)
class SystemResult:
    provider: Result
    database: Result
    models: Result
    overall: bool
    pipeline: Result | None = None
    extra: dict = field(default_factory=dict)


def _tried(work: Callable[[], object], good: str, bad: str) -> Result:
    try:
        work()
    except Exception as e:  # noqa: BLE001  every failure is a result here
        return Result(False, bad, str(e))
    return Result(True, good)


def validate_provider(provider: Provider) -> Result:
    return _tried(provider.validate, "Embedding provider is ready", "Embedding provider failed")


def validate_models(manager: ModelManager | None, models: list[str]) -> Result:
    """Only a local provider has models to ensure."""
    if manager is None:
        return Result(True, "No local models are needed")
    return _tried(lambda: manager.ensure_all(models), "Models are ready", "Models failed")


def validate_database(store) -> Result:
    return _tried(lambda: store.table("notes").count(), "Database is ready", "Database failed")


def validate_pipeline(service: EmbeddingService, sentence: str = "This is a test sentence.") -> Result:
    def work() -> None:
        if not service.embed_text(sentence):
            raise ValueError("the embedding is empty")

    return _tried(work, "Embedding pipeline is ready", "Embedding pipeline failed")


def validate_system(provider: Provider, store, manager: ModelManager | None = None, models: list[str] | None = None) -> SystemResult:
    """The pipeline is tried only if provider and models pass; overall needs all."""
    p, d, m = validate_provider(provider), validate_database(store), validate_models(manager, models or [])
    whole = validate_pipeline(EmbeddingService(provider)) if p.success and m.success else None
    return SystemResult(p, d, m, p.success and d.success and m.success and (whole is None or whole.success), whole)


def summary(r: SystemResult) -> str:
    """A line for each part: its name, its state and its message."""
    whole = r.pipeline or r.models
    overall = Result(True, "All components are ready") if r.overall else Result(False, whole.message if not whole.success else "Some components failed")
    parts = (("Provider", r.provider), ("Database", r.database), ("Models", r.models), ("Overall", overall))
    return "\n".join(f"{name}: {'Ready' if x.success else 'Issue'} - {x.message}" for name, x in parts)
