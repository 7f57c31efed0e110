"""Parameters of detection and scoring, with the presets; ``validate`` lists what is wrong with one."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class RallyConfig:
    """Clustering of peaks into rallies. Times are in signal seconds."""

    min_duration: float = 2.5
    min_confidence: float = 0.5
    max_gap: float = 8.0
    min_hits: int = 2
    pre_padding: float = 1.5
    post_padding: float = 1.8
    segment: float = 120.0

    def validate(self) -> list[str]:
        wrong = []
        if not 0 <= self.min_confidence <= 1:
            wrong.append("min_confidence must lie between 0 and 1")
        for name in ("min_duration", "max_gap", "segment"):
            if getattr(self, name) <= 0:
                wrong.append(f"{name} must be positive")
        if self.min_hits < 1:
            wrong.append("min_hits must be at least 1")
        if self.pre_padding < 0 or self.post_padding < 0:
            wrong.append("padding must not be negative")
        return wrong


RALLY_PRESETS = {
    "default": RallyConfig(),
    "strict": RallyConfig(3.5, 0.7, 4.5, 5, 1.3, 1.5),
    "lenient": RallyConfig(2.0, 0.45, 10.0, 2, 1.8, 2.2),
    "debug": RallyConfig(3.0, 0.65, 5.5, 4, 1.5, 1.8),
}


@dataclass(frozen=True)
class PeakConfig:
    threshold: float = 0.25
    min_confidence: float = 0.65
    min_interval: float = 0.25


PEAK_PRESETS = {
    "default": PeakConfig(),
    "strict": PeakConfig(0.4, 0.6, 0.2),
    "lenient": PeakConfig(0.1, 0.25, 0.08),
    "mobile": PeakConfig(0.18, 0.45, 0.18),
}


@dataclass(frozen=True)
class FusionConfig:
    """The state machine over frames, fusion with peaks, and scores."""

    intensity: float = 0.4
    hit_window: float = 0.2
    min_active: int = 3
    max_pause: float = 2.0
    min_duration: float = 3.0
    max_duration: float = 120.0
    frame_interval: float = 0.5
    fused_confidence: float = 0.6
    weight_duration: float = 0.3
    weight_intensity: float = 0.4
    weight_hits: float = 0.2
    weight_continuity: float = 0.1

    def validate(self) -> list[str]:
        wrong = []
        total = self.weight_duration + self.weight_intensity + self.weight_hits + self.weight_continuity
        if abs(total - 1) >= 0.01:
            wrong.append(f"weights must sum to 1, not {total:g}")
        if not 0 <= self.intensity <= 1:
            wrong.append("intensity must lie between 0 and 1")
        if self.min_duration >= self.max_duration:
            wrong.append("min_duration must be less than max_duration")
        return wrong


FUSION_PRESETS = {
    "default": FusionConfig(),
    "high_precision": FusionConfig(intensity=0.5, min_duration=4.0, frame_interval=0.1),
    "fast": FusionConfig(frame_interval=1 / 3),
    "indoor": FusionConfig(intensity=0.35, hit_window=0.25),
    "outdoor": FusionConfig(intensity=0.45, max_pause=2.5),
}


def save(config, path: str) -> None:
    with open(path, "w") as f:
        json.dump(asdict(config), f, indent=2, sort_keys=True)


def load(kind, path: str):
    """A config of ``kind``; missing fields take their defaults, unknown ones are ignored, wrong ones raise."""
    with open(path) as f:
        values = json.load(f)
    config = kind(**{x.name: values[x.name] for x in fields(kind) if x.name in values})
    if wrong := getattr(config, "validate", list)():
        raise ValueError("; ".join(wrong))
    return config
