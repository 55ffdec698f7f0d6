"""Embedding providers and the operators that call them."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from math import ceil
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions import fts

#: Texts a local request, estimated tokens a cloud request, spacing, tries and default wait in ms.
LOCAL_BATCH, CLOUD_TOKENS, SPACING_MS, TRIES, WAIT_MS = 8, 7500, 200, 3, 6000

Transport = Callable[[str, dict, dict], tuple[int, str]]


class EmbeddingError(RuntimeError):
    """A provider gave no embedding."""


class Provider(Protocol):
    def embed_one(self, text: str) -> list[float]: ...

    def embed_many(self, texts: list[str]) -> list[list[float]]: ...

    def validate(self) -> None: ...


def quantize(v: list[float]) -> list[int]:
    """L2-normalise and quantise one vector, as the Column operators do."""
    return quantize_rows(np.array([v], np.float64))[0].tolist()


def quantize_rows(v: np.ndarray) -> np.ndarray:
    """L2-normalise and quantise each row; squares are summed in order, as the Column operators do."""
    if not v.size:
        return np.zeros(v.shape, np.int8)
    size = np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])
    return np.floor(np.clip(v / np.where(size == 0, 1.0, size), -1.0, 1.0) * 127.0 + 0.5).astype(np.int8)


def estimate_tokens(text: str) -> int:
    return ceil(len(text) / 4)


def greedy_batches(sizes: list[int], most: int = CLOUD_TOKENS) -> list[list[int]]:
    """Places in runs whose sizes sum to at most most; the first of a run is always taken."""
    out: list[list[int]] = []
    total = 0
    for i, n in enumerate(sizes):
        if out and total + n <= most:
            out[-1].append(i)
            total += n
        else:
            out.append([i])
            total = n
    return out


def fixed_batch(ordinal: Column, size: int = LOCAL_BATCH) -> Column:
    """The request that the text with this ordinal goes in."""
    return F.floor(ordinal / size).cast("bigint")


def greedy_batch_numbers(df: DataFrame, key: str, ordinal: str, tokens: str, most: int = CLOUD_TOKENS) -> DataFrame:
    """key, ordinal, tokens, batch: greedy requests within each key's texts in order.

    Where a request ends depends on all before it, so a key's three numbers a text pass through one
    task, in order and as a stream: the task holds a batch of rows and two numbers, never a key.
    """
    rows = df.select(key, ordinal, tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, total = None, 0, 0
        for b in batches:
            out = np.empty(len(b), np.int64)
            for i, (k, n) in enumerate(zip(b[key].tolist(), b[tokens].tolist())):
                if k != last:
                    last, batch, total = k, 0, n
                elif total + n <= most:
                    total += n
                else:
                    batch, total = batch + 1, n
                out[i] = batch
            yield b.assign(batch=out)

    ordered = rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, ordinal)
    return ordered.mapInPandas(run, rows.select("*", F.lit(0).cast("bigint").alias("batch")).schema)


class _Places(dict):
    """token -> twice its place, plus one if its sign is positive; emptied when it holds limit tokens."""

    def __init__(self, dims: int, limit: int = 500_000) -> None:
        super().__init__()
        self.dims, self.limit = dims, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = hashlib.md5(token.encode()).hexdigest()  # noqa: S324  spreads tokens, guards nothing
        found = self[token] = 2 * (int(h[:8], 16) % self.dims) + (int(h[8], 16) % 2 == 0)
        return found


class HashingEmbedder:
    """Offline default: signed feature hashing of keyword tokens into dims places."""

    def __init__(self, dims: int = 64) -> None:
        self.dims, self._places = dims, _Places(dims)

    def embed_one(self, text: str) -> list[float]:
        return self.embed_many([text])[0]

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        split = [fts.query_tokens(t) for t in texts]
        places = np.fromiter(map(self._places.__getitem__, (x for s in split for x in s)), np.int64)
        row = np.repeat(np.arange(len(split)), list(map(len, split)))
        sums = np.bincount(row * self.dims + (places >> 1), 2 * (places & 1) - 1.0, len(split) * self.dims)
        return sums.reshape(len(split), self.dims).tolist()

    def validate(self) -> None:
        return None


def _no_transport(url: str, body: dict, headers: dict) -> tuple[int, str]:
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode() if body else None, {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=60) as got:  # noqa: S310
            return got.status, got.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


class LocalProvider:
    """A local embedding server: /api/embed, batches of LOCAL_BATCH."""

    def __init__(self, model: str, url: str = "http://localhost:11434", transport: Transport = _no_transport) -> None:
        self.model, self.url, self.transport = model, url.rstrip("/"), transport

    def _ask(self, given) -> list[list[float]]:
        status, body = self.transport(f"{self.url}/api/embed", {"model": self.model, "input": given}, {})
        if status != 200:
            raise EmbeddingError(f"embedding server answered {status}: {body[:200]}")
        got = json.loads(body)
        found = got.get("embeddings") or ([got["embedding"]] if got.get("embedding") else [])
        if not found or not found[0]:
            raise EmbeddingError("no embedding in the answer")
        return found

    def embed_one(self, text: str) -> list[float]:
        return self._ask(text)[0]

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        if any(not isinstance(t, str) for t in texts):
            raise TypeError("texts must be strings")
        out: list[list[float]] = []
        for i in range(0, len(texts), LOCAL_BATCH):
            out += self._ask(texts[i : i + LOCAL_BATCH])
        return out

    def validate(self) -> None:
        manager = ModelManager(self.url, self.transport)
        if not manager.contains(self.model):
            raise EmbeddingError(f"model {self.model} is not available")


class CloudProvider:
    """A cloud embedding service: /v1/embeddings, spaced calls, retries when rate limited."""

    def __init__(self, model: str, key: str, url: str = "https://api.openai.com", transport: Transport = _no_transport, sleep=time.sleep, clock=time.monotonic) -> None:
        self.model, self.key, self.url, self.transport, self.sleep, self.clock = model, key, url.rstrip("/"), transport, sleep, clock
        self._last = -1e9

    def _call(self, given) -> list[list[float]]:
        for attempt in range(TRIES):
            wait = SPACING_MS / 1000 - (self.clock() - self._last)
            if wait > 0:
                self.sleep(wait)
            self._last = self.clock()
            status, body = self.transport(f"{self.url}/v1/embeddings", {"model": self.model, "input": given}, {"Authorization": f"Bearer {self.key}"})
            if status == 200:
                return [d["embedding"] for d in sorted(json.loads(body)["data"], key=lambda d: d.get("index", 0))]
            if (status == 429 or "rate_limit_exceeded" in body) and attempt + 1 < TRIES:
                self.sleep(retry_delay_ms(body) / 1000)
                continue
            raise EmbeddingError(f"embedding service answered {status}: {body[:200]}")
        raise EmbeddingError("rate limited")

    def embed_one(self, text: str) -> list[float]:
        if estimate_tokens(text) > 8000:
            text = text[:32000]
        return self._call(text)[0]

    def embed_many(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for places in greedy_batches([estimate_tokens(t) for t in texts]):
            out += self._call([texts[i] for i in places])
        return out

    def validate(self) -> None:
        if not self.key.strip():
            raise EmbeddingError("API key is missing")
        status, body = self.transport(f"{self.url}/v1/models", {}, {"Authorization": f"Bearer {self.key}"})
        if status == 401:
            raise EmbeddingError("API key is invalid")
        if status == 403:
            raise EmbeddingError("API key lacks permission")
        if status != 200:
            raise EmbeddingError(f"service answered {status}: {body[:200]}")


def retry_delay_ms(message: str) -> int:
    """From 'try again in Xs': X in whole ms plus a second; else WAIT_MS."""
    found = re.search(r"try again in ([\d.]+)s", message)
    return ceil(float(found[1]) * 1000) + 1000 if found else WAIT_MS


class EmbeddingService:
    """Delegates to a provider and quantises."""

    def __init__(self, provider: Provider) -> None:
        self.provider = provider

    def embed_text(self, text: str) -> list[int]:
        return quantize(self.provider.embed_one(text))

    def embed_texts(self, texts: list[str]) -> list[list[int]]:
        return [quantize(v) for v in self.provider.embed_many(texts)]

    def embed_rows(self, texts: list[str]) -> list[np.ndarray]:
        """The same as numpy rows, all of one call together where they are of one length."""
        found = self.provider.embed_many(texts)
        if len({len(v) for v in found}) == 1:
            return list(quantize_rows(np.array(found, np.float64)))
        return [quantize_rows(np.array([v], np.float64))[0] for v in found]

    def validate(self) -> None:
        self.provider.validate()


class ModelManager:
    """Models of a local server."""

    def __init__(self, url: str = "http://localhost:11434", transport: Transport = _no_transport) -> None:
        self.url, self.transport = url.rstrip("/"), transport

    def reachable(self) -> bool:
        try:
            return self.transport(f"{self.url}/api/tags", {}, {})[0] == 200
        except OSError:
            return False

    def models(self) -> list[str]:
        status, body = self.transport(f"{self.url}/api/tags", {}, {})
        if status != 200:
            raise EmbeddingError(f"server answered {status}")
        return [m["name"] for m in json.loads(body).get("models", [])]

    def contains(self, model: str) -> bool:
        return any(m == model or m.split(":")[0] == model for m in self.models())

    def pull(self, model: str, progress: Callable[[int, str], None] | None = None) -> None:
        status, body = self.transport(f"{self.url}/api/pull", {"name": model}, {})
        if status != 200:
            raise EmbeddingError(f"pull of {model} failed: {status}")
        for pct, text in pull_progress(body.splitlines()):
            if progress:
                progress(pct, text)

    def ensure(self, model: str) -> None:
        if not self.contains(model):
            self.pull(model)

    def ensure_all(self, models: list[str]) -> None:
        """Every model is tried; failures are told together."""
        failed = []
        for m in models:
            try:
                self.ensure(m)
            except (EmbeddingError, OSError) as e:
                failed.append(f"{m}: {e}")
        if failed:
            raise EmbeddingError("; ".join(failed))


def pull_progress(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(percent, status) of the lines that are JSON; others are skipped."""
    for line in lines:
        try:
            d = json.loads(line)
        except ValueError:
            continue
        total = d.get("total") or 0
        yield (int(np.floor(d.get("completed", 0) / total * 100 + 0.5)) if total else 0), d.get("status", "")


def pull_progress_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """The same over a DataFrame of lines: pct, status."""
    d = F.from_json(line, "status string, total bigint, completed bigint", {"mode": "PERMISSIVE"})
    rows = lines.select(F.col(line).alias("_line"), d.alias("d")).where(F.try_parse_json("_line").isNotNull())
    pct = F.coalesce(F.floor(F.try_divide(F.coalesce("d.completed", F.lit(0)).cast("double") * 100, F.col("d.total").cast("double")) + 0.5), F.lit(0)).cast("int")
    return rows.select(pct.alias("pct"), F.coalesce("d.status", F.lit("")).alias("status"))


def embed(df: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """df with vector, the int8 embedding of text; one provider call a batch of rows, null is empty."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.ByteType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = EmbeddingService(provider)
        for b in batches:
            yield b.assign(vector=service.embed_rows(b[text].fillna("").tolist()))

    return df.mapInPandas(run, schema)
