"""What a monitored model looks like (column names only, never data) and the fixed
numbers of the monitoring rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# The results depend on each of them.
DOMAINS = {
    "healthcare": {"k": 2.0, "persistence": 0},
    "finance": {"k": 2.5, "persistence": 1},
    "standard": {"k": 3.0, "persistence": 3},
}
DIRECTIONS = {
    "statistical_parity": "upper",
    "gini": "upper",
    "psi": "upper",
    "linf": "lower",
    "ood_score": "upper",
    "privacy_score": "upper",
    "shap_importance": "upper",
}
BASELINE_DEFAULTS = {
    "psi": (0.1, 0.05),
    "linf": (0.2, 0.1),
    "ood_score": (0.1, 0.05),
    "privacy_score": (0.7, 0.1),
    "statistical_parity": (0.2, 0.1),
    "shap_importance": (0.5, 0.2),
}
REQUIRED_METRICS = ["gini", "psi", "linf", "ood_score", "privacy_score", "shap_importance"]
PARITY = "statistical_parity"
PREDICTION_TYPES = ("probability", "binary", "multiclass")
NODE_STATUSES = ("green", "warning", "critical", "locked", "grey")
STATUS_SCORES = {"green": 1.0, "warning": 0.6, "grey": 0.5, "critical": 0.0, "locked": 0.0}
BATCH_ROWS = 50
MIN_BATCH_ROWS = 20
BATCH_TIMEOUT_SECONDS = 30
CAPTURE_TICK_SECONDS = 5
CAPTURE_QUEUE_ROWS = 5000
HEARTBEAT_TIMEOUT_SECONDS = 600
TOP_FEATURES = 5
LATENCY_LIMIT_MS = 200.0
EPSILON = 1e-6
LOG_EPSILON = 1e-9
PSI_BINS = 10
OOD_Z = 3.0


class SpecError(ValueError):
    """The description of a model is not usable."""


@dataclass(frozen=True)
class Protected:
    """Protected attribute: one categorical column, or 0/1 columns."""

    kind: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class BatchSpec:
    """Column roles of a scored table. `keys` name one batch; the first key is the model.

    `row_id` names columns that tell rows of one batch apart. They order rows that share a
    timestamp and spread a hot model over many tasks.
    """

    numerical: tuple[str, ...]
    prediction: str
    quasi: tuple[str, ...]
    features: tuple[str, ...] | None = None
    categorical: tuple[str, ...] = ()
    protected: Protected | None = None
    shap: str | None = None
    prediction_type: str = "probability"
    domain: str = "standard"
    keys: tuple[str, ...] = ("model_id", "batch")
    ts: str = "ts"
    row_id: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not self.numerical:
            raise SpecError("numerical features cannot be empty")
        if not self.quasi:
            raise SpecError("quasi-identifier columns cannot be empty")
        if self.prediction_type not in PREDICTION_TYPES:
            raise SpecError(f"prediction type must be one of {PREDICTION_TYPES}")
        if not self.keys:
            raise SpecError("at least the model key is needed")
        if self.protected is not None and not self.protected.columns and not self.protected.kind:
            object.__setattr__(self, "protected", None)
        if self.features is None:
            object.__setattr__(self, "features", tuple(self.numerical) + tuple(self.categorical))

    @property
    def model(self) -> str:
        return self.keys[0]

    @property
    def by(self) -> list[str]:
        return list(self.keys)
