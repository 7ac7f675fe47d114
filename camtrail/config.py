"""Engine settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "CAMTRAIL_"


@dataclass(frozen=True)
class EngineConfig:
    """Defaults, overridden by a .env file and then by the environment (CAMTRAIL_ and the upper-case name)."""

    detector_backend: str = "auto"
    classifier_backend: str = "auto"
    inference_device: str = "cpu"
    models_dir: str = "models"
    detector_model_path: str | None = None
    classifier_model_path: str | None = None
    storage_dir: str = "storage"
    yolo_config_dir: str | None = None
    max_video_frames: int = 90
    default_confidence_threshold: float = 0.35
    default_frame_interval_seconds: float = 1.0
    species_confidence_threshold: float = 0.65
    cors_origins: str = "http://localhost:5173,http://127.0.0.1:5173"

    @classmethod
    def load(cls, env_file: str | None = ".env", environ: dict[str, str] | None = None) -> EngineConfig:
        """Unknown names are ignored."""
        given: dict[str, str] = {}
        if env_file and Path(env_file).is_file():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, separator, value = line.strip().partition("=")
                if separator and not name.startswith("#"):
                    given[name.strip().upper()] = value.strip().strip("\"'")
        given |= {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
        kinds = {f.name: type(f.default) if f.default is not None else str for f in fields(cls)}
        return cls(**{name: kind(given[key]) for name, kind in kinds.items() if (key := PREFIX + name.upper()) in given})

    def resolved(self, root: str) -> EngineConfig:
        """Relative paths taken from root. Folders are made by whoever writes to them."""
        paths = ("models_dir", "storage_dir", "detector_model_path", "classifier_model_path", "yolo_config_dir")
        absolute = {p: str(Path(root, v)) for p in paths if (v := getattr(self, p)) and "://" not in v}
        return replace(self, **absolute)

    @property
    def allowed_origins(self) -> list[str]:
        return [o for o in (part.strip() for part in self.cors_origins.split(",")) if o]

    @property
    def uploads_dir(self) -> str:
        return f"{self.storage_dir}/uploads"

    @property
    def crops_dir(self) -> str:
        return f"{self.storage_dir}/crops"

    @property
    def results_dir(self) -> str:
        return f"{self.storage_dir}/results"
