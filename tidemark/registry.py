"""User metrics, display backends and hooks, by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from .functions.metrics import REGISTRY, Metric
from .operators.series import whole_series

EVENTS = ("pre_analysis", "post_analysis", "pre_compute", "post_compute", "optimization")
_user: dict[str, Callable] = {}
_backends: dict[str, type] = {}
_built_in: set[str] = set()
_hooks: dict[str, list[tuple[int, int, Callable]]] = {}


def register_metric(name: str | None = None, needs: tuple[str, ...] = ()) -> Callable:
    """Decorator: a function that returns an aggregate Column becomes a metric like the built-in ones."""

    def add(fn: Callable) -> Callable:
        key = name or fn.__name__
        _user[key] = fn
        REGISTRY[key] = Metric(lambda **p: fn(**p), frozenset(needs), (fn.__doc__ or "").strip())
        return fn

    return add


def register_series_metric(name: str | None = None) -> Callable:
    """Decorator: a numpy function of one series' returns; ``run(df)`` applies it per series."""

    def add(fn: Callable[[np.ndarray], float]) -> Callable[[np.ndarray], float]:
        key = name or fn.__name__
        _user[key] = fn
        fn.run = lambda df: whole_series(df, fn, key)  # type: ignore[attr-defined]
        return fn

    return add


def list_metrics() -> dict[str, Callable]:
    return dict(_user)


def get_metric(name: str) -> Callable | None:
    return _user.get(name)


def register_viz_backend(name: str, built_in: bool = False) -> Callable[[type], type]:
    """Decorator; built-in ones stay when the registry is cleared."""

    def add(cls: type) -> type:
        _backends[name] = cls
        if built_in:
            _built_in.add(name)
        return cls

    return add


def list_viz_backends() -> dict[str, type]:
    return dict(_backends)


def get_viz_backend(name: str) -> Any:
    if name not in _backends:
        raise ValueError(f"no backend {name!r}; there are {sorted(_backends)}")
    return _backends[name]()


def register_hook(event: str, priority: int = 100) -> Callable[[Callable], Callable]:
    """Decorator; hooks of lower priority run first."""

    def add(fn: Callable) -> Callable:
        held = _hooks.setdefault(event, [])
        held.append((priority, len(held), fn))
        held.sort(key=lambda h: h[:2])
        return fn

    return add


def register_event_hook(event: str, hook: Callable) -> None:
    if event not in EVENTS:
        raise ValueError(f"event must be one of {EVENTS}")
    register_hook(event)(hook)


def list_hooks(event: str | None = None) -> dict[str, list[Callable]] | list[Callable]:
    if event is not None:
        return [h[2] for h in _hooks.get(event, [])]
    return {e: [h[2] for h in hs] for e, hs in _hooks.items()}


def execute_hooks(event: str, *args: Any, **kwargs: Any) -> None:
    for hook in list_hooks(event):
        hook(*args, **kwargs)


def thread_hooks(event: str, value: Any, *args: Any) -> Any:
    """Runs the hooks, each on what the one before returned (None keeps the value)."""
    for hook in list_hooks(event):
        out = hook(value, *args)
        value = value if out is None else out
    return value


def clear_registry(kind: str | None = None) -> None:
    """kind: metrics, backends, hooks or None for all."""
    if kind in (None, "metrics"):
        for name in _user:
            REGISTRY.pop(name, None)
        _user.clear()
    if kind in (None, "backends"):
        for name in set(_backends) - _built_in:
            del _backends[name]
    if kind in (None, "hooks"):
        _hooks.clear()


class HookScope:
    """``with HookScope(df, "pre_compute", "post_compute") as data``: hooks around a piece of work."""

    def __init__(self, data: DataFrame, before: str = "pre_analysis", after: str | None = "post_analysis") -> None:
        self.data, self.before, self.after = data, before, after

    def __enter__(self) -> DataFrame:
        self.data = thread_hooks(self.before, self.data)
        return self.data

    def __exit__(self, *_: object) -> None:
        if self.after:
            thread_hooks(self.after, self.data)


def create_analysis_scope(data: DataFrame) -> HookScope:
    return HookScope(data)


def create_compute_scope(data: DataFrame) -> HookScope:
    return HookScope(data, "pre_compute", "post_compute")


def create_optimization_scope(data: DataFrame) -> HookScope:
    return HookScope(data, "optimization", None)
