"""Configuration: what to look at, in which order libraries are searched, and which outputs to explain."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

#: The options that name one of a few ways, the default first.
CHOICES = {"source_strategy": ("auto", "ifs", "alias"), "extract_mode": ("full", "targeted"), "catalog_scope": ("full", "slice")}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Seed:
    id: str
    library: str
    file: str

    @property
    def node(self) -> str:
        return f"file:{self.library}/{self.file}"


@dataclass(frozen=True)
class Config:
    libraries: tuple[str, ...]
    seeds: tuple[Seed, ...]
    library_list: tuple[str, ...] = ()
    source_files: tuple[tuple[str, str], ...] = ()
    scratch: str = "QTEMP"
    options: dict[str, str] = field(default_factory=dict)

    @property
    def search_list(self) -> tuple[str, ...]:
        return self.library_list or self.libraries


def from_dict(data: dict) -> Config:
    libraries = tuple(str(x).upper() for x in data.get("libraries") or ())
    if not libraries:
        raise ConfigError("libraries: at least one library is needed")
    seeds = []
    for row in data.get("seeds") or ():
        missing = [k for k in ("id", "library", "file") if not row.get(k)]
        if missing:
            raise ConfigError(f"seeds: {', '.join(missing)} missing in {row}")
        seeds.append(Seed(str(row["id"]), str(row["library"]), str(row["file"])))
    if not seeds:
        raise ConfigError("seeds: at least one output is needed")
    if len({s.id for s in seeds}) < len(seeds):
        raise ConfigError("seeds: an id is used twice")
    options = {}
    for name, ways in CHOICES.items():
        value = str(data.get(name) or ways[0]).lower()
        if value not in ways:
            raise ConfigError(f"{name}: {value} is none of {', '.join(ways)}")
        options[name] = value
    listed = data.get("library_list") or (data.get("liblist") or {}).get("default") or ()
    files = tuple((str(f.get("library", libraries[0])).upper(), str(f["file"]).upper()) if isinstance(f, dict) else (libraries[0], str(f).upper()) for f in data.get("source_files") or ())
    return Config(libraries, tuple(seeds), tuple(str(x).upper() for x in listed), files, str(data.get("scratch") or "QTEMP").upper(), options)


def load(path: str | Path) -> Config:
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
