"""Options of a build or a pack, read from a YAML file on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class CorpusOptions:
    """sources: folders, each with path, max_files and max_bytes_per_file; normalization: arguments of normalize."""

    name: str = "corpus"
    version: str = "0.1.0"
    sources: list = field(default_factory=list)
    normalization: dict = field(default_factory=dict)
    output: dict = field(default_factory=dict)
    provenance: dict = field(default_factory=dict)


@dataclass(frozen=True)
class PackOptions:
    corpus_path: str = ""
    tokenizer_path: str = ""
    output_dir: str = ""
    seq_len: int = 64
    val_ratio: float = 0.05
    rows_per_shard: int = 4096
    version: str = "0.1.0"


def read_options(path: str, kind: type):
    """An instance of kind from the YAML mapping in path; keys that it doesn't know are an error, those left out have their defaults."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    unknown = sorted(set(found) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"{path} has unknown options: {', '.join(map(str, unknown))}")
    return kind(**found)
