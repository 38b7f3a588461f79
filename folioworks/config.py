"""Thresholds of the triage rules and of the page planner, with presets."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Config:
    min_text_length: int = 50
    min_office_text_length: int = 100
    layout_refinement_threshold: float = 0.9
    confidence_exit_threshold: float = 0.9
    confidence_light_refinement_min: float = 0.5
    confidence_image_heavy_threshold: float = 50.0
    skip_opencv_image_guard: float | None = None
    skip_opencv_if_file_size_mb: float | None = None
    skip_opencv_if_page_count: int | None = None
    skip_opencv_max_image_coverage: float | None = None
    skip_opencv_text_coverage_min: float | None = None
    skip_opencv_confidence_min: float | None = None
    high_confidence: float = 0.9
    medium_confidence: float = 0.7
    low_confidence: float = 0.5
    digital_bias_text_coverage_min: float | None = 65.0
    digital_bias_image_coverage_max: float | None = 50.0
    table_bias_text_density_min: float | None = 1.5
    table_bias_text_coverage_min: float | None = 40.0
    use_ocr_score_confidence: bool = True
    ocr_score_text_weight: float = 0.35
    ocr_score_image_weight: float = 0.35
    ocr_score_noise_weight: float = 0.20
    ocr_score_font_weight: float = 0.10
    ocr_decision_threshold: float = 0.5
    ocr_score_low_band_max: float = 0.30
    ocr_score_high_band_min: float = 0.70
    hard_digital_text_threshold: int = 20
    hard_scan_image_coverage_min: float = 80.0
    hard_scan_text_max: int = 20
    variance_page_escalation_std: float = 0.18

    def __post_init__(self) -> None:
        if not self.ocr_score_low_band_max < self.ocr_decision_threshold < self.ocr_score_high_band_min:
            raise ValueError("score bands must be ordered: low < decision < high")
        if min(self.min_text_length, self.min_office_text_length) < 0:
            raise ValueError("text lengths can't be negative")


PRESETS = {
    "scanned_documents": Config(min_office_text_length=150, ocr_score_low_band_max=0.25, ocr_decision_threshold=0.45, ocr_score_high_band_min=0.65, digital_bias_text_coverage_min=75, digital_bias_image_coverage_max=20, skip_opencv_if_file_size_mb=50, skip_opencv_if_page_count=100),
    "cost": Config(min_text_length=20, min_office_text_length=50, ocr_score_low_band_max=0.40, ocr_decision_threshold=0.55, ocr_score_high_band_min=0.75, digital_bias_text_coverage_min=50, digital_bias_image_coverage_max=70, skip_opencv_if_file_size_mb=20, skip_opencv_if_page_count=50, confidence_light_refinement_min=0.40),
    "tables_and_forms": Config(min_text_length=100, min_office_text_length=200, ocr_score_low_band_max=0.20, ocr_decision_threshold=0.40, ocr_score_high_band_min=0.60, digital_bias_text_coverage_min=80, digital_bias_image_coverage_max=10, table_bias_text_density_min=1.5, table_bias_text_coverage_min=50, confidence_light_refinement_min=0.0),
    "mixed": Config(min_text_length=75, min_office_text_length=125, skip_opencv_if_file_size_mb=100, skip_opencv_if_page_count=200),
    "high_precision": Config(min_text_length=150, min_office_text_length=250, ocr_score_low_band_max=0.20, ocr_decision_threshold=0.50, ocr_score_high_band_min=0.80, digital_bias_text_coverage_min=85, digital_bias_image_coverage_max=5, confidence_exit_threshold=0.95, confidence_light_refinement_min=0.60),
}
RELAXED = replace(Config(), hard_digital_text_threshold=1000)


@dataclass(frozen=True)
class PlannerConfig:
    mode: str = "balanced"
    domain: str = "medical"
    intent_weight: float = 0.6
    image_weight: float = 0.3
    text_weakness_weight: float = 0.3
    intent_high_threshold: float = 0.7
    very_low_text_threshold: int = 20
    confidence_exit: float = 0.85
    fast_path_image_max: float = 10.0
    overrides: str = "all"
    decision_version: str = "hybrid_v1"

    @property
    def threshold(self) -> float:
        if self.mode == "safety":
            return 0.45
        if self.mode == "cost":
            return 0.75
        return 0.60 if self.domain == "medical" else 0.65

    @property
    def intent_share(self) -> float:
        return self.intent_weight if self.domain == "medical" else 0.0

    @property
    def image_share(self) -> float:
        return self.image_weight if self.domain == "medical" else 0.2

    @property
    def intent_override(self) -> bool:
        return self.overrides == "all" and self.domain == "medical"

    @property
    def failsafe_override(self) -> bool:
        return self.overrides != "none"
