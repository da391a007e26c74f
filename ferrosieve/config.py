"""One immutable configuration for all parts of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

# Research domains and the search phrases that stand for them.
DOMAIN_QUERIES: dict[str, str] = {
    "World Model": '"world model" AND ("autonomous driving" OR "driving simulation")',
    "Neural Rendering": '("neural rendering" OR "gaussian splatting" OR NeRF) AND driving',
    "Sim2Real": '("sim-to-real" OR sim2real OR "domain gap") AND driving',
    "Sensor Model Validation": '("sensor model" OR "radar model" OR "lidar model") AND validation',
    "Virtual Homologation": '("virtual homologation" OR "virtual testing" OR "type approval") AND vehicle',
    "Driver Monitoring System": '("driver monitoring" OR "gaze estimation" OR drowsiness) AND vehicle',
}
# What a source writes where it has nothing to say.
NO_ABSTRACT = "no abstract"
UPLOADED_AUTHORS = ["Manual Upload"]
UNKNOWN = "Unknown"
NOT_MENTIONED = "None"
PATENT_SOURCES = ("patent", "epo_ops")
PAPER_SOURCES = ("paper", "arxiv")


@dataclass(frozen=True)
class EngineConfig:
    chunk_size: int = 2500
    chunk_overlap: int = 250
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ", "")
    section_minimum: int = 450
    tail_minimum: int = 400
    block_join: str = "  \n"
    top_k: int = 15
    abstract_search: int = 15_000
    abstract_window: int = 4_500
    abstract_stop_offset: int = 150
    cover_window: int = 3_500
    affiliation_window: int = 5_000
    embedding_dim: int = 64
    context_limit: int = 6
    context_chars: int = 5_500
    context_keep: int = 2_500
    domains: dict[str, str] = field(default_factory=lambda: dict(DOMAIN_QUERIES))


DEFAULT = EngineConfig()
