"""Job settings: a JSON file's values, then those of the command line."""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import MISSING, fields
from typing import TypeVar

T = TypeVar("T")


def from_arguments(kind: type[T], about: str, arguments: list[str] | None = None) -> T:
    """The settings class filled from --config and an option for each of its fields; an unknown name in the file is an error."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", help="JSON file with any of the settings below")
    for f in fields(kind):
        parser.add_argument("--" + f.name.replace("_", "-"), type={"int": int, "float": float}.get(f.type, str))
    given = vars(parser.parse_args(arguments))
    path = given.pop("config")
    held = {}
    if path:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
    if unknown := set(held) - {f.name for f in fields(kind)}:
        raise SystemExit(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    held |= {k: v for k, v in given.items() if v is not None}
    if missing := [f.name for f in fields(kind) if f.default is MISSING and f.name not in held]:
        raise SystemExit(f"no value for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return kind(**held)
