"""Configuration files and archives, on the driver."""

from __future__ import annotations

import json
import os
import stat
import zipfile
from pathlib import Path, PurePosixPath


def merged(base: dict, over: dict) -> dict:
    """`over` on top of `base`: mappings are merged, everything else is replaced."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), dict) and isinstance(over.get(k), dict) else over.get(k, base.get(k)) for k in {**base, **over}}


def load_config(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """A YAML or JSON mapping with what its `extends` names underneath; a circle is an error."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"{path} extends itself")
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        import yaml

        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} is not a mapping")
    parent = config.pop("extends", None)
    return merged(load_config(path.parent / parent, (*seen, path)), config) if parent else config


def require(config: dict, dotted: str):
    """The value at a dotted name; an error names the first part that is missing."""
    at = config
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            raise KeyError(f"{dotted}: no {part!r}")
        at = at[part]
    return at


def resolved(name: str, config: dict, given: str | None = None, variable: str | None = None) -> str | None:
    """A setting from where it is given first: the command line, the environment, the configuration."""
    return given or (os.environ.get(variable) if variable else None) or _at(config, name)


def _at(config: dict, dotted: str):
    try:
        return require(config, dotted)
    except KeyError:
        return None


def safe_name(name: str) -> bool:
    """Whether a path stays within the folder it is joined to."""
    path = PurePosixPath(name)
    return bool(name.strip()) and not path.is_absolute() and ".." not in path.parts and "\\" not in name and not (len(name) > 1 and name[1] == ":")


def extract_zip(archive: str | Path, folder: str | Path) -> list[Path]:
    """Extract all members; nothing is written if any of them is unsafe or a link."""
    folder = Path(folder).resolve()
    with zipfile.ZipFile(archive) as z:
        members = [m for m in z.infolist() if not m.is_dir()]
        for m in members:
            if not safe_name(m.filename) or stat.S_ISLNK(m.external_attr >> 16) or not (folder / m.filename).resolve().is_relative_to(folder):
                raise ValueError(f"unsafe member {m.filename!r}")
        for m in members:
            z.extract(m, folder)
    return [folder / m.filename for m in members]
