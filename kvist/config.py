"""Settings: keyword arguments over environment over an INI file over defaults, resolved per call."""

from __future__ import annotations

import configparser
import os
from dataclasses import dataclass, fields, replace

#: (section, key) of each setting in the INI file.
INI = {
    "llm_provider": ("llm", "provider"), "llm_model": ("llm", "model"), "temperature": ("llm", "temperature"), "max_tokens": ("llm", "max_tokens"),
    "llm_base_url": ("llm", "base_url"), "embed_provider": ("embeddings", "provider"), "embed_model": ("embeddings", "model"), "embed_base_url": ("embeddings", "base_url"),
    "retrieval_method": ("retrieval", "method"), "top_k": ("retrieval", "top_k"), "hybrid_alpha": ("retrieval", "hybrid_alpha"), "bm25_k1": ("retrieval", "bm25_k1"),
    "bm25_b": ("retrieval", "bm25_b"), "candidate_multiplier": ("retrieval", "hybrid_candidate_multiplier"), "chunk_size": ("chunking", "chunk_size"),
    "chunk_overlap": ("chunking", "chunk_overlap"), "prompt_version": ("prompt", "version"), "mode": ("evaluation", "mode"),
    "groundedness_threshold": ("evaluation", "groundedness_threshold"), "repeat": ("evaluation", "sweep_repeat"), "api_key": ("openai", "api_key"),
    "qualification_k": ("retrieval", "qualification_top_k"), "refusal_tag": ("evaluation", "refusal_tag"), "content_word_length": ("evaluation", "content_word_length"),
    "preview": ("evaluation", "preview_sources"),
}


@dataclass(frozen=True)
class Settings:
    """All settings with their defaults."""

    llm_provider: str = "offline"
    llm_model: str = "llama3.2"
    temperature: float = 0.3
    max_tokens: int = 0
    llm_base_url: str = ""
    embed_provider: str = "offline"
    embed_model: str = "nomic-embed-text"
    embed_base_url: str = ""
    retrieval_method: str = "dense"
    top_k: int = 6
    hybrid_alpha: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    candidate_multiplier: int = 3
    chunk_size: int = 800
    chunk_overlap: int = 200
    prompt_version: str = "baseline"
    mode: str = "local"
    groundedness_threshold: float = 0.25
    repeat: int = 1
    api_key: str = ""
    qualification_k: int = 10
    refusal_tag: str = "kan_ikke_svare"
    content_word_length: int = 4
    preview: int = 6


def _cast(value: str, default):
    """Bad numbers fall back on the default."""
    try:
        return type(default)(value)
    except ValueError:
        return default


def settings(path: str | None = None, environ: dict[str, str] | None = None, **given) -> Settings:
    """Resolve the settings. The file is path, $KVIST_CONF or kvist.conf in the working folder; variables are KVIST_<NAME>."""
    environ = dict(os.environ) if environ is None else environ
    cp = configparser.ConfigParser()
    for p in (path, environ.get("KVIST_CONF"), "kvist.conf"):
        if p and os.path.isfile(p):
            cp.read(p, encoding="utf-8")
            break
    out = Settings()
    for f in fields(Settings):
        value = environ.get(f"KVIST_{f.name.upper()}", "").strip() or cp.get(*INI[f.name], fallback="").strip()
        if value:
            out = replace(out, **{f.name: _cast(value, f.default)})
    return replace(out, **{k: v for k, v in given.items() if v is not None})
