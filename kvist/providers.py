"""Embedding and chat providers: deterministic offline ones, and thin clients of two network protocols.

Effects stay behind these functions; they run over Arrow batches, once per row, never inside an
expression that may be evaluated again. Results are to be materialised before they are used twice.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Addresses, request sizes and timeouts of the protocols.
OLLAMA_URL, OPENAI_URL = "http://localhost:11434", "https://api.openai.com/v1"
OLLAMA_BATCH, OPENAI_BATCH, TIMEOUT_S = 32, 128, 120

Embed = Callable[[list[str]], list[list[float]]]
Chat = Callable[[list[dict]], dict]
_WORDS = re.compile("[0-9a-zæøå]+").findall


def _post(url: str, body: dict, key: str = "") -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=TIMEOUT_S) as r:  # noqa: S310
        return json.loads(r.read())


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> tuple[int, float]:
    h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
    return h, 1.0 if h >> 63 else -1.0


def hashing_embedder(dim: int = 64) -> Embed:
    """Words hashed to signed dimensions, unit length; texts without words give zero vectors."""

    def one(text: str) -> list[float]:
        v = [0.0] * dim
        for h, sign in map(_place, _WORDS((text or "").lower())):
            v[h % dim] += sign
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    return lambda texts: [one(t) for t in texts]


def embedder(provider: str, model: str = "", base_url: str = "", key: str = "", dim: int = 64) -> Embed:
    """An embedding function; unknown providers raise ValueError."""
    p = (provider or "").strip().lower()
    if p == "offline":
        return hashing_embedder(dim)
    if p == "ollama":
        return lambda texts: [v for a in range(0, len(texts), OLLAMA_BATCH) for v in _post(f"{base_url or OLLAMA_URL}/api/embed", {"model": model, "input": texts[a : a + OLLAMA_BATCH]})["embeddings"]]
    if p == "openai":
        if not key:
            raise ValueError("this provider needs a key")
        return lambda texts: [d["embedding"] for a in range(0, len(texts), OPENAI_BATCH) for d in _post(f"{base_url or OPENAI_URL}/embeddings", {"model": model, "input": texts[a : a + OPENAI_BATCH]}, key)["data"]]
    raise ValueError(f"unknown embedding provider: {provider}")


def embed_column(df: DataFrame, text: str, embed: Embed, out: str = "embedding") -> DataFrame:
    """Adds the embedding of a text column, array<float>; null texts are embedded as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            vectors = embed(texts) if texts else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` array<float>")


def extractive_chat(limit: int = 3) -> Chat:
    """Answers with the sentences of the context that share most words with the question; refuses where none does."""

    def answer(messages: list[dict]) -> dict:
        said = messages[-1]["content"]
        context, _, question = said.rpartition(":")
        asked = {w for w in _WORDS(question.lower()) if len(w) > 3}
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip()]
        ranked = sorted(((len(asked & set(_WORDS(s.lower()))), -i, s) for i, s in enumerate(sentences)), reverse=True)
        best = [s for n, _, s in ranked[:limit] if n]
        text = " ".join(best) if best else "KAN_IKKE_SVARE: konteksten gir ikke grunnlag."
        return {"content": text, "finish_reason": "stop", "usage": {"prompt_tokens": sum(len(_WORDS(m["content"].lower())) for m in messages), "completion_tokens": len(_WORDS(text.lower()))}}

    return answer


def provider_and_model(name: str, default: str) -> tuple[str, str]:
    """Provider and model of a name like ``provider:model``; other names belong to the default provider."""
    head, colon, tail = name.partition(":")
    return (head, tail) if colon and head in ("offline", "ollama", "openai") else (default, name)


def chat(provider: str, model: str = "", base_url: str = "", key: str = "", temperature: float = 0.3, max_tokens: int = 0) -> Chat:
    """A chat function: messages to content, finish_reason and usage; unknown providers raise ValueError."""
    p = (provider or "").strip().lower()
    if p == "offline":
        return extractive_chat()
    if p == "ollama":

        def ollama(messages: list[dict]) -> dict:
            r = _post(f"{base_url or OLLAMA_URL}/api/chat", {"model": model, "messages": messages, "stream": False, "options": {"temperature": temperature}})
            usage = {k: r[k] for k in ("prompt_eval_count", "eval_count") if isinstance(r.get(k), int)}
            return {"content": r["message"]["content"], "finish_reason": r.get("done_reason"), "usage": usage}

        return ollama
    if p == "openai":
        if not key:
            raise ValueError("this provider needs a key")

        def openai(messages: list[dict]) -> dict:
            r = _post(f"{base_url or OPENAI_URL}/chat/completions", {"model": model, "messages": messages, "temperature": temperature} | ({"max_tokens": max_tokens} if max_tokens else {}), key)
            c = r["choices"][0]
            return {"content": c["message"]["content"], "finish_reason": c.get("finish_reason"), "usage": {k: v for k, v in (r.get("usage") or {}).items() if isinstance(v, int)}}

        return openai
    raise ValueError(f"unknown chat provider: {provider}")


def chat_column(df: DataFrame, system: str, user: str, talk: Callable, settings: tuple[str, ...] = ()) -> DataFrame:
    """Adds answer, llm_finish_reason, llm_usage and error; a call that fails gives its message, and the rest goes on.

    talk is a chat function; with settings it makes one of these columns' values, once for each combination.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chats: dict[tuple, Chat] = {}
        for batch in batches:
            rows = []
            for s, u, *values in zip(*(batch.column(c).to_pylist() for c in (system, user, *settings))):
                try:
                    if settings and tuple(values) not in chats:
                        chats[tuple(values)] = talk(*values)
                    r = (chats[tuple(values)] if settings else talk)([{"role": "system", "content": s or ""}, {"role": "user", "content": u or ""}])
                    rows.append((str(r["content"]), r.get("finish_reason"), list((r.get("usage") or {}).items()), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, None, None, str(e) or type(e).__name__))
            cols = list(zip(*rows)) or [()] * 4
            kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*batch.schema.names, "answer", "llm_finish_reason", "llm_usage", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, answer string, llm_finish_reason string, llm_usage map<string,bigint>, error string")


def embed_chunks(chunks: DataFrame, embed: Embed) -> DataFrame:
    """Chunks (text, metadata, _ord) with their embeddings."""
    return embed_column(chunks.select("text", "metadata", F.col("_ord")), "text", embed)
