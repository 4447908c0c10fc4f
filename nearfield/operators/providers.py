"""Embedding providers: text columns to vector columns, a model loaded once a worker."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions.tokens import hash_embedding
from nearfield.schema import LIMITS
from nearfield.settings import Settings


@dataclass(frozen=True)
class Spec:
    key: str
    dims: int
    max_len: int
    pooling: str
    normalise: str
    pad_id: int | None
    runs_here: bool = True


# fixed values: the supported models, their dimensions, limits and padding ids
CATALOGUE = {
    s.key: s
    for s in (
        Spec("api_openai", 1536, 0, "remote", "guard", None),
        Spec("onnx_miniml", 384, min(LIMITS.max_seq_len, 512), "mean", "clip", 0),
        Spec("onnx_jina_v5_nano", 768, LIMITS.max_seq_len, "last", "clip", 0),
        Spec("onnx_bge_m3", 1024, min(LIMITS.max_seq_len, 8192), "cls", "clip", 1),
        Spec("mlx_bge_m3", 1024, 8192, "model", "none", None, runs_here=False),
        Spec("hashing", 64, 0, "sum", "clip", None),
    )
}


def resolve(key: str) -> Spec:
    """The provider of a key; auto_bge_m3 is onnx_bge_m3 wherever Spark's workers run."""
    spec = CATALOGUE.get("onnx_bge_m3" if key == "auto_bge_m3" else key)
    if spec is None:
        raise ValueError(f"Unknown embedding provider: {key}. Supported: {', '.join([*CATALOGUE, 'auto_bge_m3'])}")
    if not spec.runs_here:
        raise ValueError(f"{key} needs a platform that Spark's workers don't run on")
    return spec


def pooled(tokens: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """(batch, length, width) token vectors to one vector each, as the column functions do it."""
    if how == "cls":
        return tokens[:, 0]
    if how == "last":
        return tokens[np.arange(len(tokens)), np.maximum(mask.sum(1) - 1, 0)]
    m = mask[:, :, None].astype(tokens.dtype)
    return (tokens * m).sum(1) / np.maximum(m.sum(1), 1e-9)


def normalised(v: np.ndarray, how: str) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    if how == "guard":
        return np.where(n > 1e-9, v / np.where(n > 1e-9, n, 1), v)
    return v / np.maximum(n, 1e-9) if how == "clip" else v


# fixed values: accelerators in the order in which they are tried when none is asked for
ACCELERATORS = ("CoreMLExecutionProvider", "DmlExecutionProvider", "CUDAExecutionProvider", "ROCMExecutionProvider")
CPU = "CPUExecutionProvider"


def execution_providers(preferred: str | None, available: Iterable[str] | None = None) -> list[str]:
    """Those to run a model with, best first; the CPU always comes last.

    Of a comma-separated preference those that are available, in its order; without one every accelerator that this
    machine has. available: by default what the runtime reports; where it can't be asked, the CPU alone is taken.
    """
    if available is None:
        try:
            import onnxruntime

            available = onnxruntime.get_available_providers()
        except Exception:  # noqa: BLE001 - a runtime that can't be asked still may run on the CPU
            return [CPU]
    wanted = [p.strip() for p in (preferred or "").split(",") if p.strip()] or ACCELERATORS
    usable = set(available) - {CPU}
    return [p for p in dict.fromkeys(wanted) if p in usable] + [CPU]


def model_dir(key: str, env: dict[str, str], root: str = "models") -> str:
    """Folder of a provider's model: NEARFIELD_MODEL_DIR, else a folder of the resolved provider's name under root."""
    return env.get("NEARFIELD_MODEL_DIR") or os.path.join(root, resolve(key).key)


@lru_cache(2)
def _onnx(model_dir: str):
    """(tokenizer, session), once a worker process."""
    import onnxruntime
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(model_dir, "tokenizer.json")), onnxruntime.InferenceSession(os.path.join(model_dir, "model.onnx"), providers=execution_providers(os.environ.get("ONNX_EP_PREFERENCE")))


def encode_batch(texts: list[str], tokenizer, session, spec: Spec) -> np.ndarray:
    """One forward pass, padded to the longest text of the batch and no further."""
    encoded = tokenizer.encode_batch(texts)
    ids = [e.ids[: spec.max_len] for e in encoded]
    width = max(map(len, ids))
    shape = (len(ids), width)
    tokens, mask = np.full(shape, spec.pad_id, np.int64), np.zeros(shape, np.int64)
    for row, x in enumerate(ids):
        tokens[row, : len(x)], mask[row, : len(x)] = x, 1
    feed = {"input_ids": tokens, "attention_mask": mask}
    if any(i.name == "token_type_ids" for i in session.get_inputs()):
        feed["token_type_ids"] = np.zeros(shape, np.int64)
    return normalised(pooled(session.run(None, feed)[0].astype(np.float32), mask, spec.pooling), spec.normalise)


def in_batches(encode: Callable[[list[str]], np.ndarray], size: int) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    """Arrow batches cut to the provider's batch size; texts of like length go together, so that padding stays short."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            out: list = [None] * len(s)
            order = sorted((i for i, t in enumerate(s) if t is not None), key=lambda i: len(s.iloc[i]))
            for a in range(0, len(order), size):
                at = order[a : a + size]
                for i, v in zip(at, encode([s.iloc[i] for i in at]), strict=True):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return run


class Provider:
    """Turns texts into vectors. Made on the driver, started on a worker by initialize, which may be called again."""

    def __init__(self, key: str):
        self.spec = resolve(key)

    def initialize(self) -> None:
        """Load the model or check what a connection needs; raises where the provider can't work."""

    def embed(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def dimensions(self) -> int:
        return self.spec.dims

    def shutdown(self) -> None:
        """Release what initialize took."""


class RemoteProvider(Provider):
    """A service that answers POST {model, input} by {data: [{embedding}, ...]}, vectors in the order of the texts.

    An answer that isn't a success raises, after `retries` repeated attempts for refused or overloaded connections. The
    dimensions are those of the last vectors received; before, those configured.
    """

    def __init__(self, api_key: str, url: str, model: str = "", timeout: float = 30, dims: int | None = None, retries: int = 0):
        super().__init__("api_openai")
        self.api_key, self.url, self.model, self.timeout, self.retries = api_key, url, model or "text-embedding-3-small", timeout, retries
        self.dims, self.ready = dims or self.spec.dims, False

    def initialize(self) -> None:
        if not self.api_key:
            raise ValueError("api_openai needs an API key")
        self.ready = True

    def embed(self, texts: list[str]) -> np.ndarray:
        if not self.ready:
            raise RuntimeError("provider isn't initialized")
        if not texts:
            return np.empty((0, self.dims), np.float32)
        body = json.dumps({"model": self.model, "input": texts}).encode()
        asked = urllib.request.Request(self.url, body, {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
                    data = json.load(answer)["data"]
                break
            except urllib.error.HTTPError as e:
                if not left or e.code not in (429, 502, 503, 504):
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
        if len(data) != len(texts):
            raise ValueError(f"{len(data)} vectors for {len(texts)} texts")
        found = np.array([x["embedding"] for x in data], np.float32)
        self.dims = found.shape[1]
        return normalised(found, "guard")

    def dimensions(self) -> int:
        return self.dims

    def shutdown(self) -> None:
        self.ready = False


class OnnxProvider(Provider):
    """A model folder with tokenizer.json and model.onnx, at the same path on every worker."""

    def __init__(self, key: str, folder: str):
        super().__init__(key)
        self.folder = folder

    def initialize(self) -> None:
        if missing := [f for f in ("tokenizer.json", "model.onnx") if not os.path.exists(os.path.join(self.folder, f))]:
            raise FileNotFoundError(f"{self.spec.key}: no {' and '.join(missing)} in {self.folder}")
        _onnx(self.folder)

    def embed(self, texts: list[str]) -> np.ndarray:
        return encode_batch(texts, *_onnx(self.folder), self.spec)

    def shutdown(self) -> None:
        _onnx.cache_clear()


def provider_of(settings: Settings, root: str = "models") -> Provider:
    """The provider that the settings name."""
    spec = resolve(settings.provider)
    if spec.key == "api_openai":
        return RemoteProvider(settings.api_key, settings.api_url, settings.model, settings.timeout, settings.dimensions)
    if spec.key == "hashing":
        return Provider("hashing")  # runs in the JVM, by embed
    return OnnxProvider(spec.key, settings.model_dir or os.path.join(root, spec.key))


def embed(text: Column, key: str = "hashing", model_dir: str | None = None, call_api: Callable[[list[str]], list[list[float]]] | None = None, size: int = LIMITS.batch, provider: Provider | None = None) -> Column:
    """A column of vectors; null texts give null. hashing stays in the JVM; onnx_* need a model folder every worker has;
    api_openai needs call_api, which sends one batch and returns its vectors in order, or a provider, which each task
    initializes and shuts down."""
    spec = provider.spec if provider else resolve(key)
    if spec.key == "hashing":
        return hash_embedding(text, spec.dims)
    if provider:
        encode = provider.embed
    elif spec.key == "api_openai":
        if call_api is None:
            raise ValueError("api_openai needs call_api")
        send = call_api

        def encode(texts: list[str]) -> np.ndarray:
            return normalised(np.array(send(texts), np.float32), "guard")
    else:
        if not model_dir:
            raise ValueError(f"{key} needs model_dir")

        def encode(texts: list[str]) -> np.ndarray:
            return encode_batch(texts, *_onnx(model_dir), spec)

    run = in_batches(encode, size)

    def udf(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if provider is None:
            yield from run(series)
            return
        provider.initialize()
        try:
            yield from run(series)
        finally:
            provider.shutdown()

    udf.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(udf, "array<float>")(text)
