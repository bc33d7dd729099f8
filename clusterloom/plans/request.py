"""What to run: a validated request, parameters by priority, the number of clusters, and the registry of algorithms."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, make_dataclass
from typing import Any

from pyspark.sql import DataFrame

from clusterloom.operators import central, density, rounds, server, tuning
from clusterloom.operators.rounds import ClusterResult

AGGREGATE_PRIVACY = ("gaussian_dp_aggregate", "public_clipped_control")

#: Public class counts, used where labels may not be looked at.
PUBLIC_CLUSTERS = {"dry_bean": 7, "iris": 3, "wine": 3, "digits": 10}

#: Fixed value: the largest clip norm in the public space.
LARGEST_PUBLIC_CLIP = 20


@dataclass(frozen=True)
class Setting:
    """A default, and what a value may be: one of some words, or a number from ``least`` (or ``above``) to ``most`` (or ``below``)."""

    default: Any
    words: tuple[str, ...] = ()
    least: float = -math.inf
    most: float = math.inf
    above: float = -math.inf
    below: float = math.inf

    def fits(self, value: Any) -> bool:
        if value is None:
            return self.default is None
        if self.words:
            return value in self.words
        return self.least <= value <= self.most and self.above < value < self.below

    def __str__(self) -> str:
        if self.words:
            return "one of " + ", ".join(self.words)
        limits = {"at least": self.least, "at most": self.most, "above": self.above, "below": self.below}
        return " and ".join(f"{word} {limit:g}" for word, limit in limits.items() if math.isfinite(limit))


#: Names, defaults and bounds of the settings, by topic.
PRIVACY = {
    "privacy_mode": Setting("none", ("none", "gaussian_dp", *AGGREGATE_PRIVACY)),
    "dp_epsilon": Setting(5.0, above=0),
    "dp_delta": Setting(1e-5, above=0, below=1),
    "dp_clip_norm": Setting(1.0, above=0),
}
CLUSTERS = {
    "cluster_count_mode": Setting("known_k", ("known_k", "estimated_k")),
    "target_clusters": Setting(None, least=2),
    "estimated_k_min": Setting(2, least=2),
    "estimated_k_max": Setting(12, least=2),
}
STEPS = {
    "seed": Setting(42),
    "rounds": Setting(10, least=1),
    "max_iter": Setting(300, least=1),
    "tol": Setting(1e-4, above=0),
    "density_min_samples": Setting(5, least=1),
}
TUNING = {
    "tuning_mode": Setting("none", ("none", "unsupervised")),
    "tuning_budget": Setting(8, least=1),
    "tuning_sample_size": Setting(1000, least=25),
}
CLIENTS = {
    "participation_rate": Setting(1.0, above=0, most=1),
    "dropout_rate": Setting(0.0, least=0, below=1),
    "min_samples_per_client": Setting(3, least=1),
    "labels_per_client": Setting(2, least=1),
}
#: These count in federated runs alone.
DEALING = {
    "partition_mode": Setting("iid", ("iid", "dirichlet", "quantity_skew", "label_limited")),
    "num_clients": Setting(5, least=2),
}
#: This one counts in partitions by a Dirichlet draw alone.
DIRICHLET = {"dirichlet_alpha": Setting(0.5, above=0)}

MODE = Setting("local", ("local", "federated"))
SETTINGS = PRIVACY | CLUSTERS | STEPS | TUNING | CLIENTS | DEALING | DIRICHLET


class _Checked:
    """What a request may not be: settings out of their bounds, and settings that don't go together."""

    def problems(self) -> list[str]:
        counts = PRIVACY | CLUSTERS | STEPS | TUNING | CLIENTS
        if self.mode == "federated":
            counts = counts | DEALING | (DIRICHLET if self.partition_mode == "dirichlet" else {})
        out = [f"{name} must be {limit}" for name, limit in ({"mode": MODE} | counts).items() if not limit.fits(getattr(self, name))]
        return [*out, *self._clashes()]

    def _clashes(self) -> Iterator[str]:
        if not self.dataset:
            yield "a dataset is needed"
        if len(set(self.algorithms)) < max(2, len(self.algorithms)):
            yield "two or more different algorithms are needed"
        if self.estimated_k_max < self.estimated_k_min:
            yield "the bounds of an estimated k must rise"
        estimated = self.cluster_count_mode == "estimated_k"
        if estimated and self.target_clusters is not None:
            yield "an estimated k can't be given as well"
        if self.mode != "federated":
            changed = [name for name in ("privacy_mode", "participation_rate", "dropout_rate") if getattr(self, name) != SETTINGS[name].default]
            yield from (f"{name} is for federated runs" for name in changed)
        if self.privacy_mode in AGGREGATE_PRIVACY:
            if self.dp_clip_norm > LARGEST_PUBLIC_CLIP:
                yield f"in the public space the clip is at most {LARGEST_PUBLIC_CLIP}"
            if self.partition_mode in ("dirichlet", "label_limited"):
                yield "aggregate privacy can't use partitions by label"
            if estimated:
                yield "aggregate privacy can't use an estimated k"

    def validate(self):
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self


#: mode, dataset and algorithms, then every setting by name, then parameters for all algorithms and for single ones.
RunRequest = make_dataclass(
    "RunRequest",
    [
        ("mode", str), ("dataset", str), ("algorithms", tuple),
        *[(name, Any, setting.default) for name, setting in SETTINGS.items()],
        ("params", dict, field(default_factory=dict)), ("params_by_algorithm", dict, field(default_factory=dict)),
    ],
    bases=(_Checked,), frozen=True, module=__name__,
)


def effective_params(common: dict, defaults: dict, profile: dict, overrides: dict, own: dict) -> dict:
    """Later ones win: common profile, the algorithm's defaults, generic profile, request's overrides, those for the algorithm."""
    return {**common, **defaults, **profile, **overrides, **own}


def resolve_k(request: RunRequest, points: DataFrame) -> tuple[int, str]:
    """The number of clusters and where it comes from."""
    if request.privacy_mode in AGGREGATE_PRIVACY and request.target_clusters is None:
        if request.dataset not in PUBLIC_CLUSTERS:
            raise ValueError("aggregate privacy needs a public number of clusters")
        return PUBLIC_CLUSTERS[request.dataset], "public_constant"
    if request.cluster_count_mode == "estimated_k":
        k, _ = tuning.estimate_k(points, request.estimated_k_min, request.estimated_k_max, request.tuning_budget, request.tuning_sample_size, request.seed)
        return k, "estimated_unlabeled_silhouette"
    if request.target_clusters is not None:
        return request.target_clusters, "user"
    if "label" in points.columns and (k := points.select("label").filter("label is not null").distinct().count()) > 0:
        return k, "ground_truth_oracle"
    return 3, "fallback"


@dataclass(frozen=True)
class Algorithm:
    """``run(points, k, schedule, params, seed)`` gives a :class:`ClusterResult`; points hold sample_id, client_id, features."""

    run: Callable[..., ClusterResult]
    mode: str
    preprocessing: str = "standard"
    min_client_size: int = 1
    defaults: dict[str, Any] = field(default_factory=dict)
    supported: tuple[str, ...] = ()


_ALGORITHMS: dict[str, Algorithm] = {}


def register_algorithm(name: str, algorithm: Algorithm) -> None:
    _ALGORITHMS[name] = algorithm


def algorithm_names(mode: str | None = None) -> list[str]:
    return sorted(n for n, a in _ALGORITHMS.items() if mode in (None, a.mode))


def get_algorithm(name: str) -> Algorithm:
    if name not in _ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; known: {algorithm_names()}")
    return _ALGORITHMS[name]


def _register_all() -> None:
    add = register_algorithm
    add("kmeans", Algorithm(lambda p, k, s, o, seed: rounds.kmeans(p, k, seed=seed, **o), "local", defaults={"n_init": 10}, supported=("max_iter", "tol")))
    add("gmm", Algorithm(lambda p, k, s, o, seed: central.gmm(p, k, seed=seed, **o), "local", defaults={"covariance_type": "full", "reg_covar": 1e-6}, supported=("max_iter", "tol")))
    add("dbscan", Algorithm(lambda p, k, s, o, seed: density.dbscan(p, **o), "local", defaults={"eps": None, "quantile": 0.5, "metric": "euclidean", "min_samples": 5}))
    add("agglomerative", Algorithm(lambda p, k, s, o, seed: central.agglomerative(p, k, seed=seed, **o), "local", defaults={"linkage": "ward"}))
    for name, kind, extra in (("fed_kmeans", "kmeans", {}), ("fed_fuzzy_cmeans", "fuzzy", {"fuzziness": 2.0}), ("fed_gmm_diag", "gmm", {"reg_covar": 1e-6})):
        add(name, Algorithm(lambda p, k, s, o, seed, kind=kind: rounds.fed_rounds(kind, p, k, schedule=s, seed=seed, **o), "federated", defaults=extra, supported=("rounds", "tol")))
    add("fed_server_kmeans", Algorithm(lambda p, k, s, o, seed: server.fed_server_kmeans(p, k, schedule=s, seed=seed, **o), "federated", defaults={"iter_local": 1, "drop_empty": True, "weighted": True}, supported=("rounds", "tol")))
    add("fed_grid_density", Algorithm(lambda p, k, s, o, seed: density.fed_grid_density(p, schedule=s, seed=seed, **o), "federated", "minmax", defaults={"cell_size": 0.15, "min_points": 4}))
    add("fed_snn_peaks", Algorithm(lambda p, k, s, o, seed: server.fed_snn_peaks(p, k, schedule=s, seed=seed, **o), "federated", min_client_size=2, defaults={"neighbours": 20, "reps": (2, 50)}))
    add("fed_nn_peaks", Algorithm(lambda p, k, s, o, seed: server.fed_snn_peaks(p, k, schedule=s, seed=seed, **o), "federated", min_client_size=3, defaults={"neighbours": 2, "reps": (3, 50)}))
    add("fed_personalised", Algorithm(lambda p, k, s, o, seed: server.fed_personalised(p, k, schedule=s, seed=seed, **o), "federated", "raw", defaults={"max_iters": 10}))


_register_all()
