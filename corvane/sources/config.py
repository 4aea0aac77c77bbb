"""Settings of a run, validated when they are made."""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, fields


@dataclass(frozen=True)
class RunConfig:
    """All settings of one run. Only the model and the temperature have no default."""

    # Names and defaults are those of a public settings format.
    model: str
    temperature: float
    dev_sample_size: int = 10
    official_test_sample_size: int = 10
    seed: int = 42
    rag_top_k: int = 2
    rag_chunk_size: int = 128
    memory_top_k: int = 1
    rag_index_dir: str = "data/rag_index"
    rag_chunk_overlap: int = 32
    rag_child_chunk_size: int = 64
    rag_parent_chunk_size: int = 512
    rag_max_passage_tokens: int = 200
    rag_retrieval_buffer: int = 2
    rag_use_hybrid: bool = False
    rag_use_hyde: bool = False
    rag_relevance_threshold: float = 0.0
    rag_max_retrieval_loops: int = 2
    rag_enable_backtracking: bool = False
    rag_enable_debate: bool = False
    rag_use_multi_query: bool = False
    rag_use_option_boosting: bool = False
    rag_option_boost_weight: float = 0.05
    rag_dynamic_top_k: bool = False
    rag_heuristic_compression: bool = False
    rag_adaptive_routing: bool = False
    rag_use_reranker: bool = False
    rag_use_query_pruning: bool = False
    rag_use_synonym_expansion: bool = False
    rag_use_mmr: bool = False
    rag_mmr_lambda: float = 0.7

    def __post_init__(self) -> None:
        if not isinstance(self.model, str) or not self.model.strip():
            raise ValueError("model must name a model")
        positive = ("dev_sample_size", "official_test_sample_size", "rag_top_k", "rag_chunk_size", "memory_top_k", "rag_child_chunk_size", "rag_parent_chunk_size", "rag_max_passage_tokens", "rag_max_retrieval_loops")
        at_least_0 = ("temperature", "rag_chunk_overlap", "rag_retrieval_buffer", "rag_relevance_threshold")
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in at_least_0:
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.rag_chunk_overlap >= self.rag_chunk_size:
            raise ValueError("rag_chunk_overlap must be less than rag_chunk_size")
        if self.rag_parent_chunk_size < self.rag_child_chunk_size:
            raise ValueError("rag_parent_chunk_size must be at least rag_child_chunk_size")

    @classmethod
    def from_mapping(cls, data: dict) -> RunConfig:
        names = {f.name for f in fields(cls)}
        unknown = sorted(set(data) - names)
        absent = sorted(f.name for f in fields(cls) if f.default is MISSING and f.name not in data)
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        if absent:
            raise ValueError(f"missing settings: {absent}")
        return cls(**data)

    @classmethod
    def from_json_file(cls, path: str) -> RunConfig:
        with open(path, encoding="utf-8") as f:
            return cls.from_mapping(json.load(f))

    def to_dict(self) -> dict:
        return asdict(self)
