"""Embedding backends: a deterministic hashing embedder, ONNX models, and an OpenAI-compatible HTTP connector.

Every backend has ``name``, ``dim`` and ``embed(texts) -> float32 array``; on executors it runs over Arrow batches,
one instance per worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.relevance import mean_pool

# Published widths and lengths of models.
DIMS = {"jina-embeddings-v2-base-code": 768, "bge-small-en-v1.5": 384, "nomic-embed-text": 768, "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}
MAX_TOKENS = {"jina-embeddings-v2-base-code": 8192, "bge-small-en-v1.5": 512}
BATCH = 32


def prefixes(model: str) -> tuple[str, str]:
    """(for documents, for queries)."""
    return ("search_document: ", "search_query: ") if "jina" in model.lower() else ("", "")


@dataclass(frozen=True)
class HashEmbedder:
    """Signed feature hashing of words and word pairs to unit vectors: no model, the same everywhere."""

    dim: int = 256
    name: str = "hashing"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, t in enumerate(texts):
            w = re.findall(r"[^\W_]+", t.lower())
            for f in (*w, *map(" ".join, zip(w, w[1:], strict=False))):
                h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


@dataclass
class OnnxEmbedder:
    """A model folder with ``model.onnx`` and ``tokenizer.json``: batches of similar length, mean pooling, unit norm."""

    folder: str
    name: str
    dim: int = 0
    _session: object = field(default=None, repr=False)
    _tokenizer: object = field(default=None, repr=False)

    def _load(self):
        if self._session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            self._session = onnxruntime.InferenceSession(f"{self.folder}/model.onnx", options, providers=["CPUExecutionProvider"])
            self._tokenizer = Tokenizer.from_file(f"{self.folder}/tokenizer.json")
            self._tokenizer.enable_truncation(MAX_TOKENS.get(self.name, 512))
            self._tokenizer.enable_padding()

    def embed(self, texts: list[str]) -> np.ndarray:
        self._load()
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        out: list[np.ndarray] = [None] * len(texts)
        wanted = {x.name for x in self._session.get_inputs()}
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            enc = self._tokenizer.encode_batch([texts[i] for i in part])
            mask = np.array([e.attention_mask for e in enc], dtype=np.int64)
            feed = {"input_ids": np.array([e.ids for e in enc], dtype=np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            pooled = mean_pool(self._session.run(None, {k: v for k, v in feed.items() if k in wanted})[0], mask)
            norm = np.linalg.norm(pooled.astype(np.float64), axis=1, keepdims=True)
            for i, v in zip(part, np.where(norm > 0, pooled / np.maximum(norm, 1e-30), pooled).astype(np.float32), strict=True):
                out[i] = v
        return np.stack(out) if out else np.zeros((0, self.dim), np.float32)


@dataclass
class HttpEmbedder:
    """POST {base_url}/embeddings; waits 60/rpm seconds between requests, retries 429, 5xx and transport errors."""

    base_url: str
    name: str
    dim: int
    api_key: str = field(default="", repr=False)
    rpm: int = 0
    retries: int = 4
    sleep: Callable[[float], None] = time.sleep

    def _post(self, payload: dict) -> dict:
        url = self.base_url.rstrip("/") + "/embeddings"
        for attempt in range(self.retries + 1):
            if self.rpm:
                self.sleep(60 / self.rpm)
            try:
                request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})})
                with urllib.request.urlopen(request, timeout=60) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise ValueError(f"embedding request failed with {e.code}: {truncated(e.read().decode(errors='replace'), 200).replace(self.api_key or chr(0), '***')}") from None
                last: Exception = e
            except urllib.error.URLError as e:
                last = e
            if attempt < self.retries:
                self.sleep(0.5 * 2**attempt)
        raise RuntimeError(f"embedding request failed after {self.retries} retries: {last}")

    def embed(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dim), np.float32)
        data = sorted(self._post({"model": self.name, "input": texts})["data"], key=lambda d: d["index"])
        if [d["index"] for d in data] != list(range(len(texts))):
            raise ValueError("the reply does not hold one embedding per text")
        out = np.array([d["embedding"] for d in data], dtype=np.float32)
        if out.shape[1] != self.dim:
            raise ValueError(f"expected {self.dim} dimensions, got {out.shape[1]}")
        return out


def truncated(text: str, most_bytes: int) -> str:
    """At most so many bytes, cut between characters."""
    return text.encode()[:most_bytes].decode(errors="ignore")


#: Where the services answer unless a base_url is given.
BASE_URLS = {"openai": "https://api.openai.com/v1", "ollama": "http://localhost:11434/v1"}


def build_embedder(backend: str = "hash", *, model: str = "", fallback: str | None = None, **options):
    """The backend by name; where it cannot be built, ``fallback`` once."""
    try:
        if backend == "hash":
            return HashEmbedder(**options)
        if backend == "onnx":
            import os

            folder = options.get("folder") or ""
            if not os.path.exists(f"{folder}/model.onnx"):
                raise FileNotFoundError(f"no model in {folder!r}; name its folder in embedding.folder")
            return OnnxEmbedder(name=model, dim=DIMS.get(model, 0), **options)
        if backend in ("openai", "ollama"):
            options.setdefault("base_url", BASE_URLS[backend])
            return HttpEmbedder(name=model, dim=options.pop("dim", 0) or DIMS.get(model, 0), **options)
        raise ValueError(f"unknown embedding backend {backend!r}")
    except (FileNotFoundError, KeyError, ValueError):
        if fallback is None:
            raise
        return build_embedder(fallback)


def embedded(text: str | Column, embedder, prefix: str = "") -> Column:
    """Vectors of a text column; texts are embedded in order of length within each Arrow batch."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.fillna("").tolist()
        order = sorted(range(len(known)), key=lambda i: len(known[i]))
        vectors = embedder.embed([prefix + known[i] for i in order])
        out = [None] * len(known)
        for i, v in zip(order, vectors, strict=True):
            out[i] = v
        return pd.Series(out)

    return run(text)
