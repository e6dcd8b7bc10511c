"""The model specification: immutable, validated when built, shared by every series of a fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from . import constants as C

_DELIMITER = "_delim_"
_MODES = ("additive", "multiplicative")


@dataclass(frozen=True)
class Seasonality:
    name: str
    period: float
    order: int
    prior_scale: float = C.SEASONALITY_PRIOR
    mode: str = "additive"
    condition: str | None = None


@dataclass(frozen=True)
class Regressor:
    """``predictor`` is the specification of a model of the regressor itself, which fills its future."""

    name: str
    prior_scale: float = C.SEASONALITY_PRIOR
    standardize: bool | str = "auto"
    mode: str = "additive"
    predictor: ModelSpec | None = None


@dataclass(frozen=True)
class Holiday:
    name: str
    ds: datetime
    lower: int = 0
    upper: int = 0
    prior_scale: float | None = None


@dataclass(frozen=True)
class ModelSpec:
    """What to fit. Methods return changed copies; a fitted model is a row of its own, so nothing is ever refitted in place."""

    growth: str = "linear"
    changepoints: tuple[datetime, ...] | None = None
    n_changepoints: int = C.N_CHANGEPOINTS
    changepoint_range: float = C.CHANGEPOINT_RANGE
    yearly: Any = "auto"
    weekly: Any = "auto"
    daily: Any = "auto"
    mode: str = "additive"
    seasonality_prior_scale: float = C.SEASONALITY_PRIOR
    holidays_prior_scale: float = C.SEASONALITY_PRIOR
    changepoint_prior_scale: float = C.CHANGEPOINT_PRIOR
    interval_width: float = C.INTERVAL_WIDTH
    uncertainty_samples: int = C.UNCERTAINTY_SAMPLES
    holidays_mode: str | None = None
    seasonalities: tuple[Seasonality, ...] = ()
    regressors: tuple[Regressor, ...] = ()
    holidays: tuple[Holiday, ...] = ()
    country: str | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.growth not in ("linear", "logistic", "flat"):
            raise ValueError('Parameter "growth" should be "linear", "logistic" or "flat".')
        if not 0 <= self.changepoint_range <= 1:
            raise ValueError('Parameter "changepoint_range" must be in [0, 1]')
        if self.n_changepoints < 0:
            raise ValueError('Parameter "n_changepoints" must not be negative')
        for mode in (self.mode, self.holidays_mode or self.mode):
            if mode not in _MODES:
                raise ValueError('seasonality modes must be "additive" or "multiplicative"')
        for scale in (self.seasonality_prior_scale, self.holidays_prior_scale, self.changepoint_prior_scale):
            if not scale > 0:
                raise ValueError("Prior scales must be > 0")
        for key, value in self.options.items():
            allowed = {"mcmc_samples": 0, "stan_backend": None, "scaling": "absmax"}
            if key not in allowed or value != allowed[key]:
                raise NotImplementedError(f"{key}={value!r} is not supported")
        for h in self.holidays:
            if h.lower > 0 or h.upper < 0:
                raise ValueError("Holiday windows need lower <= 0 <= upper")
        scales: dict[str, set] = {}
        for h in self.holidays:
            scales.setdefault(h.name, set()).add(h.prior_scale)
        for name, found in scales.items():
            if len(found) > 1:
                raise ValueError(f"Holiday {name!r} does not have consistent prior_scale specification.")
            if any(s is not None and not s > 0 for s in found):
                raise ValueError("Prior scale must be > 0")
        if self.changepoints is not None:
            object.__setattr__(self, "n_changepoints", len(self.changepoints))

    def validate_name(self, name: str, own: str) -> None:
        if _DELIMITER in name:
            raise ValueError(f'Name cannot contain "{_DELIMITER}"')
        taken = {x + s for x in C.RESERVED for s in ("", "_lower", "_upper")} | set(C.RESERVED_COLUMNS)
        if own == "seasonality":
            taken -= set(C.BUILT_IN)
        if name in taken:
            raise ValueError(f"Name {name!r} is reserved.")
        groups = {"seasonality": {s.name for s in self.seasonalities}, "holiday": {h.name for h in self.holidays}, "regressor": {r.name for r in self.regressors}}
        for kind, names in groups.items():
            if kind != own and name in names:
                raise ValueError(f"Name {name!r} already used for a {kind}.")

    def add_seasonality(self, name: str, period: float, fourier_order: int, prior_scale: float | None = None, mode: str | None = None, condition_name: str | None = None) -> ModelSpec:
        self.validate_name(name, "seasonality")
        scale = self.seasonality_prior_scale if prior_scale is None else float(prior_scale)
        if not scale > 0:
            raise ValueError("Prior scale must be > 0")
        if not (fourier_order > 0 and 0 < period < float("inf")):
            raise ValueError("Fourier order and period must be > 0, and the period finite")
        if (mode or self.mode) not in _MODES:
            raise ValueError('mode must be "additive" or "multiplicative"')
        if condition_name is not None and (condition_name in C.RESERVED_COLUMNS or _DELIMITER in condition_name):
            raise ValueError(f"Name {condition_name!r} is reserved.")
        new = Seasonality(name, float(period), int(fourier_order), scale, mode or self.mode, condition_name)
        return replace(self, seasonalities=(*(s for s in self.seasonalities if s.name != name), new))

    def add_regressor(self, name: str, prior_scale: float | None = None, standardize: bool | str = "auto", mode: str | None = None, predictor: ModelSpec | bool | None = None) -> ModelSpec:
        self.validate_name(name, "regressor")
        scale = self.holidays_prior_scale if prior_scale is None else float(prior_scale)
        if not scale > 0:
            raise ValueError("Prior scale must be > 0")
        if (mode or self.mode) not in _MODES:
            raise ValueError('mode must be "additive" or "multiplicative"')
        own = ModelSpec() if predictor is True else predictor or None
        new = Regressor(name, scale, standardize, mode or self.mode, own)
        return replace(self, regressors=(*(r for r in self.regressors if r.name != name), new))

    def add_holidays(self, holidays: Sequence[Holiday], prior_scale: float | None = None, mode: str | None = None) -> ModelSpec:
        """Registers these holidays in place of any registered before. The prior scale is also the default of regressors added later."""
        for h in holidays:
            self.validate_name(h.name, "holiday")
        scale = self.holidays_prior_scale if prior_scale is None else float(prior_scale)
        return replace(self, holidays=tuple(holidays), holidays_prior_scale=scale, holidays_mode=mode or self.mode)

    def add_country_holidays(self, country: str) -> ModelSpec:
        """The calendar itself is a table given to fit and forecast (country, ds, holiday); the package holds none. A second country replaces the first."""
        return replace(self, country={"TU": "TR"}.get(country, country))

    @property
    def has_holidays(self) -> bool:
        return bool(self.holidays) or self.country is not None

    def built_in(self, name: str, auto: bool) -> Seasonality | None:
        """The built-in seasonality a series gets: ``auto`` tells whether its history supports it."""
        if any(s.name == name for s in self.seasonalities):
            return None
        asked = getattr(self, name)
        period, default, _, _ = C.BUILT_IN[name]
        if asked == "auto" and isinstance(asked, str):
            order = default if auto else 0
        elif asked is True:
            order = default
        elif asked is False:
            order = 0
        else:
            order = int(asked)
        return Seasonality(name, period, order, self.seasonality_prior_scale, self.mode) if order > 0 else None

    def seasonalities_for(self, yearly: bool, weekly: bool, daily: bool) -> tuple[Seasonality, ...]:
        """Registered ones first, then the built-in ones, in the order yearly, weekly, daily."""
        found = [self.built_in(n, a) for n, a in zip(C.BUILT_IN, (yearly, weekly, daily), strict=True)]
        return (*self.seasonalities, *(s for s in found if s))

    @property
    def holiday_mode(self) -> str:
        return self.holidays_mode or self.mode

    @property
    def convex(self) -> bool:
        """Whether predictions are linear in the parameters."""
        modes = [self.mode, self.holiday_mode, *(s.mode for s in self.seasonalities), *(r.mode for r in self.regressors)]
        return self.growth != "logistic" and all(m == "additive" for m in modes)
