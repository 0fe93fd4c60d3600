"""Configurations: one registry of typed parameters for JSON and command lines."""

from __future__ import annotations

import argparse
import json
import warnings
from dataclasses import dataclass
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    default: Any = None
    required: bool = False
    choices: tuple[str, ...] = ()
    least: float | None = None
    most: float | None = None

    def read(self, value: Any) -> Any:
        if self.kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, self.kind) or self.kind is not bool and isinstance(value, bool):
            raise TypeError(f"{self.name} must be {self.kind.__name__}, not {value!r}")
        if self.choices and value not in self.choices:
            warnings.warn(f"{self.name}: {value!r} is unknown; {self.choices[0]!r} is used", stacklevel=3)
            return self.choices[0]
        if self.least is not None and value < self.least or self.most is not None and value > self.most:
            raise ValueError(f"{self.name} must be from {self.least} to {self.most}, not {value}")
        return value


#: Fixed names and defaults of the configuration files.
DECONVOLUTION = (
    Parameter("algorithm_name", str, "RichardsonLucy"), Parameter("iterations", int, 10, least=0, most=10_000),
    Parameter("epsilon", float, 1e-6), Parameter("lambda", float, 0.001),
    Parameter("padding_fill", str, "zero", choices=("zero", "mirror", "linear", "quadratic", "sinusoid", "gaussian")),
    Parameter("padding_strategy", str, "parent", choices=("parent", "none", "full_psf", "manual")),
    Parameter("padding_relative_max", float, 0.001), Parameter("feathering_radius", int, 0, least=0), Parameter("cube_padding", list, [-1, -1, -1]),
)
SETUP = (
    Parameter("image_path", str, required=True), Parameter("output", str, required=True), Parameter("backend", str, "cpu"),
    Parameter("psf_file_paths", list, []), Parameter("multiple_psf_config_paths", list, []), Parameter("save_psf", bool, False),
    Parameter("labeled_image", str, ""), Parameter("label_psf_map", str, ""), Parameter("max_mem_host_gb", float, 0.0), Parameter("max_mem_device_gb", float, 0.0),
    Parameter("output_compression", str, "none"), Parameter("output_compression_level", int, -1), Parameter("tile_width", int, 0), Parameter("tile_length", int, 0),
    Parameter("n_io_threads", int, 1), Parameter("n_worker_threads", int, 1), Parameter("n_devices", int, 1),
    # accepted and without use here, where Spark deals tasks; the last one is in no use at all
    Parameter("n_threads", int, 0), Parameter("n_reader_threads", int, 0), Parameter("psf_config_path", str, ""),
)


def load(values: dict[str, Any], parameters: tuple[Parameter, ...]) -> dict[str, Any]:
    """Checked values with defaults; unknown keys warn, wrong types and missing
    required ones fail."""
    known = {p.name: p for p in parameters}
    for name in values.keys() - known.keys():
        warnings.warn(f"unknown parameter {name!r}", stacklevel=2)
    missing = [p.name for p in parameters if p.required and p.name not in values]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return {n: p.read(values[n]) if n in values else p.default for n, p in known.items()}


def read_json(path: str) -> tuple[dict[str, Any], dict[str, Any]]:
    """Setup and deconvolution settings; the latter stand in an object of their own or
    beside the others."""
    with open(path) as file:
        values = json.load(file)
    inner = values.pop("deconvolution_config", None)
    if inner is None:
        names = {p.name for p in DECONVOLUTION}
        inner = {k: values.pop(k) for k in list(values) if k in names}
    return load(values, SETUP), load(inner, DECONVOLUTION)


def write_json(path: str, setup: dict[str, Any], deconvolution: dict[str, Any]) -> None:
    with open(path, "w") as file:
        json.dump({**setup, "deconvolution_config": deconvolution}, file, indent=2)


def read_psfs(paths: list[str]) -> list[dict[str, Any]]:
    """PSF configurations from files, and from the .json files of folders by name; a bad
    file fails, but in a folder it is left out with a warning."""
    found = []
    for path in map(Path, paths):
        if not path.is_dir():
            found.append(json.loads(path.read_text()))
            continue
        for file in sorted(path.glob("*.json")):
            try:
                values = json.loads(file.read_text())
                if "model_name" not in values:
                    raise ValueError("no model_name")
                found.append(values)
            except (ValueError, TypeError) as error:
                warnings.warn(f"{file}: {error}", stacklevel=2)
    return found


def write_psf(path: str, values: dict[str, Any]) -> None:
    Path(path).write_text(json.dumps(values, indent=2))


def parser(parameters: tuple[Parameter, ...] = SETUP + DECONVOLUTION) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser()
    for p in parameters:
        how = {"action": argparse.BooleanOptionalAction} if p.kind is bool else {"nargs": "*"} if p.kind is list else {"type": p.kind}
        out.add_argument(f"--{p.name}", default=p.default, required=p.required, **how)
    return out
