"""Job parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

VELOCITY_RULE = "velocity-rule-v1"
TRAVEL_RULE = "geospatial-rule-v1"
MERCHANT_RULE = "merchant-blacklist-rule-v1"

# Default weight of each rule; a rule that is not listed weighs 1.0.
DEFAULT_WEIGHTS = {MERCHANT_RULE: 2.0, TRAVEL_RULE: 1.5, VELOCITY_RULE: 1.0}
UNLISTED_WEIGHT = 1.0


@dataclass(frozen=True)
class Params:
    """Everything a scoring job can be told; the defaults are the product defaults."""

    fraud_threshold: float = 0.8
    rule_weights: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    critical_rule_ids: tuple[str, ...] = (MERCHANT_RULE, TRAVEL_RULE)
    velocity_threshold: int = 10
    velocity_window_s: int = 60
    merchant_blacklist: str = ""
    speed_limit_kmh: float = 900.0
    alert_ttl_s: int = 3600
    orchestration_version: str = "v1.0.0"
    # Opt-in checks, off by default.
    telemetry_max_age_s: int | None = None
    spend_limit: int | None = None
    spend_window_s: int = 3600
    # Keys. Empty means "not configured": signing and encryption refuse to run.
    signing_key: str = ""
    encryption_key: str = ""
    crypto_salt: str = ""

    def weight(self, rule_id: str) -> float:
        return float(self.rule_weights.get(rule_id, UNLISTED_WEIGHT))

    def is_critical(self, rule_id: str) -> bool:
        return rule_id in self.critical_rule_ids

    @classmethod
    def from_settings(cls, settings: Mapping[str, str]) -> "Params":
        """Parameters from text settings such as environment variables.

        Missing settings keep their defaults; a number that does not parse is a ``ValueError``.
        The critical-rule list is split on commas and trimmed, blanks included.
        """
        given: dict[str, object] = {}
        converters = {
            "FRAUD_THRESHOLD": ("fraud_threshold", float),
            "VELOCITY_THRESHOLD": ("velocity_threshold", int),
            "VELOCITY_WINDOW_SECONDS": ("velocity_window_s", int),
            "MERCHANT_BLACKLIST": ("merchant_blacklist", str),
            "SIGNING_KEY": ("signing_key", str),
            "ENCRYPTION_KEY": ("encryption_key", str),
            "CRYPTO_SALT": ("crypto_salt", str),
            "CRITICAL_RULE_IDS": (
                "critical_rule_ids",
                lambda text: tuple(part.strip() for part in text.split(",")),
            ),
        }
        for name, (attribute, convert) in converters.items():
            if name in settings:
                given[attribute] = convert(settings[name])
        return cls(**given)

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)


# The product specification states other limits than the defaults; they are kept as a preset.
SPEC_PRESET = Params(
    rule_weights={TRAVEL_RULE: 2.0, VELOCITY_RULE: 1.0},
    velocity_threshold=4,
    speed_limit_kmh=5000.0,
    telemetry_max_age_s=3600,
)
