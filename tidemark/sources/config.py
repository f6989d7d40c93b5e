"""The calibration service's YAML configuration, checked whole before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from tidemark.functions.hashing import split_threshold
from tidemark.operators.calibration import RoundConfig

#: Seconds of each unit in durations such as "24h" or "1h 30min".
UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400, "ms": 0.001}
MAX_EF, MAX_IDENTIFIER = 1000, 63


class ConfigError(ValueError):
    pass


def seconds(text: Any, field: str) -> float:
    found = re.findall(r"\s*(\d+)\s*([a-z]+)", str(text))
    if not found or "".join(f"{n}{u}" for n, u in found) != re.sub(r"\s", "", str(text)) or any(u not in UNITS for _, u in found):
        raise ConfigError(f"{field}: not a duration: {text!r}")
    return sum(int(n) * UNITS[u] for n, u in found)


def _take(node: Any, name: str, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> dict:
    """The mapping `node`; unknown and missing fields are errors."""
    if not isinstance(node, dict):
        raise ConfigError(f"{name} must be a mapping")
    if extra := sorted(set(node) - set(required) - set(optional)):
        raise ConfigError(f"{name}: unknown field {extra[0]!r}")
    if gone := [f for f in required if f not in node]:
        raise ConfigError(f"{name}.{gone[0]} is required")
    return node


def _check(fine: bool, what: str) -> None:
    if not fine:
        raise ConfigError(what)


@dataclass(frozen=True)
class Cohort:
    name: str
    data_source: str
    round: RoundConfig


@dataclass(frozen=True)
class Config:
    interval: float
    root: str
    db_share: float
    statement_timeout: float
    client_timeout: float
    cohorts: dict[str, Cohort]


def load(text: str) -> Config:
    """Parse and check a configuration; the first broken rule is named in the error."""
    import yaml

    top = _take(yaml.safe_load(text), "configuration", ("calibration", "storage", "data_sources", "indexes", "targets", "cohorts"), ("budget",))
    cal = _take(top["calibration"], "calibration", ("interval", "ef_search", "train_fraction", "split_seed", "min_samples"))
    store = _take(top["storage"], "storage", ("root", "window_seconds"))
    budget = _take(top.get("budget") or {}, "budget", (), ("db_share", "statement_timeout", "client_timeout"))

    interval = seconds(cal["interval"], "calibration.interval")
    _check(interval > 0, "calibration.interval must be greater than zero")
    grid = cal["ef_search"]
    _check(isinstance(grid, list) and bool(grid), "calibration.ef_search is required and non-empty")
    _check(all(a < b for a, b in zip(grid, grid[1:], strict=False)), "calibration.ef_search must be strictly increasing")
    _check(grid[-1] <= MAX_EF, f"calibration.ef_search values must be <= {MAX_EF}")
    _check(0 < cal["train_fraction"] < 1, "calibration.train_fraction must be in (0, 1)")
    split_threshold(cal["train_fraction"])
    _check(cal["min_samples"] >= 10, "calibration.min_samples must be >= 10")
    width = store["window_seconds"]
    _check(width > 0, "storage.window_seconds must be greater than zero")
    _check(width % 60 == 0, "storage.window_seconds must be a multiple of 60")
    share = budget.get("db_share", 0.1)
    _check(0 < share <= 1, "budget.db_share must be in (0, 1]")
    timeouts = {f: seconds(budget.get(f, d), f"budget.{f}") for f, d in (("statement_timeout", "5s"), ("client_timeout", "10s"))}
    for field, value in timeouts.items():
        _check(value > 0, f"budget.{field} must be greater than zero")

    places: dict[tuple, str] = {}
    for name, node in top["data_sources"].items():
        _check(not (isinstance(node, dict) and "password" in node), f"data source {name!r} holds a password; name an environment variable in password_env")
        node = _take(node, f"data source {name!r}", ("server", "database", "user"), ("password_env",))
        place = (node["server"], node["database"])
        _check(place not in places, f"data sources {places.get(place)!r} and {name!r} have the same server and database")
        places[place] = name
    for name, node in top["indexes"].items():
        node = _take(node, f"index {name!r}", ("data_source", "table", "key", "column"))
        _check(node["data_source"] in top["data_sources"], f"index {name!r} references unknown data source {node['data_source']!r}")
        for field in ("table", "key", "column"):
            value = node[field]
            _check(bool(value) and "\0" not in value and len(value.encode()) <= MAX_IDENTIFIER, f"index {name!r} {field} must be 1 to {MAX_IDENTIFIER} bytes without NUL")
    for name, node in top["targets"].items():
        node = _take(node, f"target {name!r}", ("k", "value", "percentile", "window"))
        _check(node["k"] >= 1, f"target {name!r} k must be >= 1")
        _check(0 < node["value"] <= 1, f"target {name!r} value must be in (0, 1]")
        _check(0 < node["percentile"] < 1, f"target {name!r} percentile must be in (0, 1)")
        window = seconds(node["window"], f"target {name!r} window")
        _check(window >= width, f"target {name!r} window must be at least storage.window_seconds")
        _check(window % width == 0, f"target {name!r} window must be a multiple of storage.window_seconds")

    cohorts = {}
    for name, node in top["cohorts"].items():
        _check(valid_name(name), f"cohort {name!r} is not a valid name")
        node = _take(node, f"cohort {name!r}", ("index", "target"))
        _check(node["index"] in top["indexes"], f"cohort {name!r} references unknown index {node['index']!r}")
        _check(node["target"] in top["targets"], f"cohort {name!r} references unknown target {node['target']!r}")
        index, target = top["indexes"][node["index"]], top["targets"][node["target"]]
        _check(grid[0] >= target["k"], f"calibration.ef_search must start at k of target {node['target']!r} or above")
        made = RoundConfig(
            tuple(grid), target["k"], float(target["value"]), float(target["percentile"]), int(seconds(target["window"], "window")), width, float(cal["train_fraction"]), cal["split_seed"], cal["min_samples"],
            node["target"], node["index"], index["table"], index["column"], index["key"],
        )
        cohorts[name] = Cohort(name, index["data_source"], made)
    return Config(interval, str(store["root"]), share, timeouts["statement_timeout"], timeouts["client_timeout"], cohorts)


def valid_name(name: str) -> bool:
    """The cohort grammar, for single names on the driver."""
    parts = name.split("/")
    return name.isascii() and len(name) <= 255 and len(parts) <= 8 and all(re.fullmatch(r"[A-Za-z0-9._=-]{1,63}", p) and p not in (".", "..") and not p.startswith("window=") for p in parts)


def cooldown(worked: float, share: float) -> float:
    """Idle seconds after `worked` busy ones that keep the busy share."""
    return worked * (1 - share) / share
