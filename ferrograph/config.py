"""Settings of the engine, validated on construction."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from ferrograph.errors import ConfigError


@dataclass(frozen=True)
class Ingestion:
    max_rows: int | None = None  # rows that a file gives at most; all if unset
    csv_multiline: bool = False  # cells of CSV files may hold line feeds; such files are not split among tasks
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd")
    text_tokens: float = 3
    id_uniqueness: float = 0.95
    missing_drop: float = 0.80
    constant_distinct: int = 1
    drop_duplicates: bool = False


@dataclass(frozen=True)
class Features:
    tfidf_features: int = 512
    overlap_sample: int = 1000
    top_k: int = 3
    entropy_bins: int = 20
    name_dims: int = 20


@dataclass(frozen=True)
class Graph:
    instances_per_entity: int = 200
    prune_edges: float = 0.1
    resolution: float = 1.0
    drop_isolated: bool = True
    layout: str = "spring"
    fk_rows: int = 150
    fk_edges: int = 50


@dataclass(frozen=True)
class Network:
    architecture: str = "GCN"
    hidden: int = 64
    out: int = 32
    layers: int = 3
    dropout: float = 0.3
    heads: int = 8
    aggregator: str = "mean"
    epsilon: float = 0.0
    latent: int = 16


@dataclass(frozen=True)
class Training:
    rate: float = 1e-3
    weight_decay: float = 1e-4
    epochs: int = 30
    batch: int = 64  # edges of a batch, where neighbours are sampled
    neighbours: tuple[int, ...] = ()  # sampled of each node of a batch, by hop (10 and 5 are usual); none: the whole graph at once
    clip: float = 1.0
    accumulate: int = 1
    warmup: int = 5
    checkpoint_every: int = 10
    patience: int = 10
    val: float = 0.1
    test: float = 0.1
    link_weight: float = 1.0
    reconstruction_weight: float = 0.5
    kl_weight: float = 0.001
    contrast_weight: float = 0.3
    temperature: float = 0.07


@dataclass(frozen=True)
class Inference:
    link: float = 0.5
    top_links: int = 20
    anomaly_z: float = 2.5
    explanations: int = 10
    weights: tuple[float, float, float, float] = (0.2, 0.4, 0.2, 0.2)  # norm, PageRank, betweenness, degree


@dataclass(frozen=True)
class EngineConfig:
    version: str = "1.0"
    seed: int = 42
    ward_distance: float = 1.5
    name_merge: float = 0.5
    min_cluster: int = 1
    relationship_prune: float = 0.15
    fk_subset: float = 0.6
    correlation: float = 0.5
    ingestion: Ingestion = field(default_factory=Ingestion)
    features: Features = field(default_factory=Features)
    graph: Graph = field(default_factory=Graph)
    network: Network = field(default_factory=Network)
    training: Training = field(default_factory=Training)
    inference: Inference = field(default_factory=Inference)

    def __post_init__(self):
        if self.training.val + self.training.test >= 1:
            raise ConfigError("validation and test shares leave nothing to train on", val=self.training.val, test=self.training.test)
        if self.ward_distance <= 0:
            raise ConfigError("the clustering distance must be positive", ward_distance=self.ward_distance)

    def to_dict(self) -> dict:
        return asdict(self)
