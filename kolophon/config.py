"""Parameters of the pipelines, with the defaults that results are defined by."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LineFilter:
    """Which lines take part."""

    min_chars: int = 5
    min_words: int = 6
    max_words: int = 50
    script: str | None = None  # "greek", "latin" or any


@dataclass(frozen=True)
class Sampling:
    documents: int = 10_000
    min_lines: int = 2
    max_lines: int = 10
    seed: int = 42


@dataclass(frozen=True)
class MinHash:
    """Signatures of ``perms`` slots; ``bands`` bands of equal width select candidates."""

    k: int = 4
    perms: int = 128
    bands: int = 16
    seed: int = 1
    #: "md5" can be said in other SQL engines as well; "xxhash64" is faster.
    hash: str = "md5"

    @property
    def rows(self) -> int:
        return self.perms // self.bands


@dataclass(frozen=True)
class Weights:
    """Of the parts of the composite score of lines."""

    dbi: float = 0.30
    sil: float = 0.25
    nsr: float = 0.20
    within_between: float = 0.15
    stability: float = 0.10


@dataclass(frozen=True)
class Quality:
    nsr_low: float = 0.05
    nsr_high: float = 0.60
    min_clusters: int = 3
    max_nsr: float = 0.85
    max_share: float = 0.60
    clusters: int = 200  # of the Davies-Bouldin proxy
    pairs: int = 2_000  # between clusters
    runs: int = 8
    subsample: float = 0.80
    stability_pairs: int = 300
    weights: Weights = field(default_factory=Weights)


@dataclass(frozen=True)
class Knn:
    k: int = 100
    cells: int = 64
    probes: int = 32
    abtt_source: int = 5
    abtt_global: int = 100


@dataclass(frozen=True)
class Apply:
    """A configuration chosen by a sweep, to apply to a whole corpus."""

    line_threshold: float = 0.5
    document_threshold: float = 0.5
    #: Line clusters in more documents than this make no document pairs.
    fan_out: int = 500
