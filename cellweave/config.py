"""Settings of the build and of the sentences, with a YAML form."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

import yaml

from .sources.paths import clean, join

BUNDLED = Path(__file__).with_name("configs")


@dataclass(frozen=True)
class StaticSlot:
    """A category that always gets a place in the sentence: at most ``slots`` names, followed by ``label``."""

    objektart: str
    label: str = ""
    slots: int = 1

    def __post_init__(self):
        if not self.label:
            object.__setattr__(self, "label", self.objektart)


@dataclass(frozen=True)
class SentenceConfig:
    """Thresholds and budgets of the context. A slot is one distinct UUID, not one row."""

    static_slots: tuple[StaticSlot, ...] = ()
    assoc_threshold: float = 0.001
    max_slots: int = 10
    max_slots_per_category: int = 5
    max_categories: int = 10
    max_filler_slots: int = 0
    uuid_field: str = "UUID"
    category_separator: str = ", "
    instance_separator: str = ", "


def default_preset() -> SentenceConfig:
    """The preset for runs without any build configuration; its slot order differs from the bundled file's."""
    return SentenceConfig(static_slots=(StaticSlot("Gemeindegebiet", "Gemeinde", 2), StaticSlot("Kanton", "Kanton", 1), StaticSlot("Bezirk", "Bezirk", 1)))


@dataclass(frozen=True)
class BuildConfig:
    """Everything a build needs. ``from_yaml`` and ``for_gazetteer`` read it from a file."""

    gazetteer: str
    source_crs: int = 2056
    target_cells: int = 100
    min_resolution: int = 5
    max_resolution: int = 13
    containment_mode: str = "overlap"
    output_file: str = "spatial_store"
    total_area_resolution: int = 10
    sentence: SentenceConfig = field(default_factory=SentenceConfig)

    @classmethod
    def from_dict(cls, d: dict) -> BuildConfig:
        own = {f.name for f in fields(cls)} - {"sentence", "gazetteer"}
        known = {f.name for f in fields(SentenceConfig)} - {"static_slots"}
        slots = tuple(StaticSlot(s["objektart"], s.get("label") or s["objektart"], int(s.get("slots", 1))) for s in d.get("static_slots") or ())
        sentence = SentenceConfig(static_slots=slots, **{k: v for k, v in (d.get("sentence_generator") or {}).items() if k in known})
        return cls(gazetteer=d.get("gazetteer", ""), sentence=sentence, **{k: v for k, v in d.items() if k in own})

    @classmethod
    def from_yaml(cls, path: str | Path) -> BuildConfig:
        path = Path(path)
        if not path.exists():
            raise FileNotFoundError(f"no configuration at {path}")
        return cls.from_dict(yaml.safe_load(path.read_text(encoding="utf-8")) or {})

    @classmethod
    def for_gazetteer(cls, name: str) -> BuildConfig:
        path = BUNDLED / f"{name}.yaml"
        if not path.exists():
            raise FileNotFoundError(f"no bundled configuration for {name!r}; there are: {', '.join(sorted(p.stem for p in BUNDLED.glob('*.yaml')))}")
        return cls.from_yaml(path)

    def resolve_output_path(self, base: str | Path) -> Path | str:
        """The store's folder: text for an address (s3a://, hdfs://), which a Path would spoil, else a Path."""
        out = join(clean(base), self.output_file)
        return out if "://" in out else Path(out)


def resolve_config(explicit: SentenceConfig | None = None, config_path: str | Path | None = None, gazetteer: str | None = None) -> SentenceConfig:
    """An explicit configuration wins over a file, a file over the bundled one, that over the preset."""
    if explicit is not None:
        return explicit
    if config_path is not None:
        return BuildConfig.from_yaml(config_path).sentence
    if gazetteer is not None:
        try:
            return BuildConfig.for_gazetteer(gazetteer).sentence
        except FileNotFoundError:
            pass
    return default_preset()
