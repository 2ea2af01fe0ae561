"""Error types with fields, their round trip through dictionaries, and small guards."""

from __future__ import annotations

import functools
import importlib.util
import math
import warnings
from collections.abc import Callable
from typing import Any, ClassVar

import numpy as np

from .functions.periods import FACTORS


class AnalyticsError(Exception):
    """Base of the library's errors. ``FIELDS`` names what a kind carries besides its message, in order."""

    FIELDS: ClassVar[tuple[str, ...]] = ()

    def __init__(self, message: str, *values: Any, **named: Any) -> None:
        super().__init__(message)
        self.message = message
        given = dict(zip(self.FIELDS, values, strict=False)) | named
        if len(values) > len(self.FIELDS) or (unknown := named.keys() - set(self.FIELDS)):
            raise TypeError(f"{type(self).__name__} takes {', '.join(('message', *self.FIELDS))}" + (f", not {sorted(unknown)}" if len(values) <= len(self.FIELDS) else ""))
        for name in self.FIELDS:
            setattr(self, name, given.get(name))

    def __str__(self) -> str:
        held = [f"{name.replace('_', ' ')}: {value}" for name in self.FIELDS if (value := getattr(self, name)) is not None]
        return self.message + (f" ({'; '.join(held)})" if held else "")

    def to_dict(self) -> dict[str, Any]:
        return {"error_type": type(self).__name__, "message": self.message} | {name: getattr(self, name) for name in self.FIELDS}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> AnalyticsError:
        if data.get("error_type") != cls.__name__:
            raise ValueError(f"not a {cls.__name__}: {data.get('error_type')!r}")
        return cls(data["message"], **{name: data.get(name) for name in cls.FIELDS})


class ValidationError(AnalyticsError, ValueError):
    """An input breaks a stated rule."""

    FIELDS = ("param_name", "value")

    def to_dict(self) -> dict[str, Any]:
        return super().to_dict() | {"value": None if self.value is None else str(self.value)}


class InsufficientDataError(ValidationError):
    """Too few rows for a calculation."""

    FIELDS = ("required_length", "actual_length")

    def to_dict(self) -> dict[str, Any]:
        return AnalyticsError.to_dict(self)


class InvalidPeriodError(AnalyticsError, ValueError):
    """A name that is no period."""

    FIELDS = ("period",)

    def __init__(self, period: str) -> None:
        super().__init__(f"no such period; there are {sorted(FACTORS)}", period)

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> InvalidPeriodError:
        if data.get("error_type") != cls.__name__:
            raise ValueError(f"not a {cls.__name__}: {data.get('error_type')!r}")
        return cls(data["period"])


class DataAlignmentError(AnalyticsError):
    """Two tables that should have the same rows have not."""

    FIELDS = ("returns_length", "factor_length")


class NumericalError(AnalyticsError, ArithmeticError):
    """A calculation that has no number as its result."""

    FIELDS = ("operation",)


class MissingDataError(AnalyticsError):
    """Something needed was not given."""

    FIELDS = ("missing_field",)


class UnsupportedFormatError(AnalyticsError, TypeError):
    """Data of a kind that is not handled."""

    FIELDS = ("expected_format", "actual_format")


class DependencyError(AnalyticsError, ImportError):
    """A package that is not installed."""

    FIELDS = ("dependency",)


def handle_numerical_error(function: Callable) -> Callable:
    """Decorator: arithmetic, value and type errors come out as ``NumericalError`` naming the function and the error's kind."""

    @functools.wraps(function)
    def guarded(*args: Any, **kwargs: Any) -> Any:
        try:
            return function(*args, **kwargs)
        except (ArithmeticError, ValueError, TypeError) as error:
            raise NumericalError(f"{function.__name__}: {error}", type(error).__name__) from error

    return guarded


def check_dependencies(*packages: str) -> None:
    """Raises ``DependencyError`` that names all packages that cannot be found; imports none."""
    absent = ", ".join(p for p in packages if importlib.util.find_spec(p.split(".")[0]) is None)
    if absent:
        raise DependencyError(f"not installed: {absent}", absent)


def ensure_not_nan(value: Any, param_name: str, replace_with: float | None = None) -> Any:
    """``value``, or for NaN the replacement; without one NaN is an error."""
    if not (isinstance(value, float) and math.isnan(value)):
        return value
    if replace_with is None:
        raise ValidationError("must not be NaN", param_name, value)
    return replace_with


def safe_divide(numerator: Any, denominator: Any, default: Any = math.nan) -> Any:
    """Quotient of numbers or arrays, ``default`` where the denominator is zero."""
    n, d = np.asarray(numerator, dtype=float), np.asarray(denominator, dtype=float)
    out = np.divide(n, np.where(d == 0, 1.0, d))
    out = np.where(d == 0, default, out)
    return out if out.ndim else out.item()


def safe_sqrt(value: Any, default: Any = math.nan) -> Any:
    """Square root of a number or array, ``default`` below zero."""
    v = np.asarray(value, dtype=float)
    out = np.where(v < 0, default, np.sqrt(np.maximum(v, 0.0)))
    return out if out.ndim else out.item()


def deprecated(msg: str | None = None, stacklevel: int = 2) -> Callable[[Callable], Callable]:
    """Decorator: calling the function warns that it is going away."""

    def mark(function: Callable) -> Callable:
        @functools.wraps(function)
        def call(*args: Any, **kwargs: Any) -> Any:
            warnings.warn(msg or f"{function.__name__} is deprecated", DeprecationWarning, stacklevel=stacklevel)
            return function(*args, **kwargs)

        return call

    return mark
