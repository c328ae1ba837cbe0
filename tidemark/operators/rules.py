"""Default recommendation rules, ``(metric, operator, threshold, text)``, for ``joins.recommend``."""

# Data quality. Metrics are issue counts per severity or kind (0 where absent).
QUALITY = [
    ("critical_issues", ">", 0.0, "Address critical issues immediately before using dataset for training"),
    ("high_issues", ">", 0.0, "Resolve high-severity issues to improve model performance"),
    ("low_resolution_or_blur", ">", 0.0, "Implement image quality filtering in data preprocessing pipeline"),
    ("no_ocean_content", ">", 0.0, "Improve automated ocean region detection and filtering"),
    ("corruption", ">", 0.0, "Add data integrity checks to data collection pipeline"),
    ("issues", "=", 0.0, "Dataset quality is good - proceed with training"),
]
# Dataset health and size.
HEALTH = [
    ("alerts", ">", 0.0, "Address data health alerts to maintain system reliability"),
    ("quality_score", "<", 0.7, "Implement automated quality filtering to improve dataset quality"),
    ("freshness_hours", ">", 48.0, "Data is becoming stale - consider implementing automated data refresh"),
    ("total_samples", "<", 1000.0, "Dataset size is small - consider data augmentation or synthetic data generation"),
    ("duplicate_percentage", ">", 10.0, "High duplicate percentage detected - implement deduplication pipeline"),
]
# Drift. One metric per feature holds its KS statistic.
DRIFT = [
    ("drift_detected", "=", 0.0, "No significant data drift detected - dataset is stable"),
    ("drift_detected", "=", 1.0, "Significant data drift detected - investigate data collection pipeline"),
    ("brightness", ">", 0.1, "Brightness distribution has changed - check lighting conditions or camera settings"),
    ("contrast", ">", 0.1, "Contrast distribution has changed - verify image preprocessing pipeline"),
    ("saturation", ">", 0.1, "Color saturation has changed - check camera color calibration"),
    ("sharpness", ">", 0.1, "Image sharpness has changed - verify camera focus and image quality"),
    ("texture", ">", 0.1, "Texture patterns have changed - investigate scene composition changes"),
    ("drift_detected", "=", 1.0, "Consider retraining models with updated data distribution"),
    ("drift_detected", "=", 1.0, "Implement continuous monitoring for early drift detection"),
]
# Fixed thresholds of the model targets; the wording is ours.
EVALUATION = [
    ("mae", ">", 0.3, "height error above target: widen the training data or reweight the height loss"),
    ("within_02_pct", "<", 80.0, "too few heights within 0.2 m: work on small waves"),
    ("direction_acc", "<", 0.9, "direction accuracy below 90 %: add directional variety"),
    ("breaking_acc", "<", 0.92, "breaking accuracy below 92 %: collect more breaking examples"),
    ("ece", ">", 0.1, "confidences are poorly calibrated: fit a calibrator"),
    ("inference_ms", ">", 200.0, "inference slower than 200 ms: optimise the model"),
    ("memory_mb", ">", 2000.0, "memory above 2000 MB: reduce the model"),
    ("images_per_second", "<", 2.0, "throughput below 2 images per second: process in batches"),
    ("as_published", "<", 80.0, "overall score below 80: improve the weakest task"),
]
# Fixed thresholds of parameter diversity; the wording is ours.
DIVERSITY = [
    ("low_diversity_params", ">", 0.0, "vary the parameters of low diversity more"),
    ("low_diversity_params", "=", 0.0, "all parameters vary enough"),
    ("uniqueness_rate", "<", 0.8, "widen ranges to get more distinct combinations"),
    ("uniqueness_rate", ">=", 0.8, "parameter combinations are diverse"),
    ("high_quality_ratio", "<", 0.7, "adjust ranges to raise quality scores"),
    ("high_quality_ratio", ">=", 0.7, "quality scores are well distributed"),
]
