"""The model's defaults."""

N_CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CHANGEPOINT_PRIOR = 0.05
SEASONALITY_PRIOR = 10.0
SIGMA_PRIOR = 0.5
SLOPE_PRIOR = OFFSET_PRIOR = 5.0
SIGMA_INIT = 1.0
CONSTANT_SIGMA = 1e-9
INTERVAL_WIDTH = 0.8
UNCERTAINTY_SAMPLES = 1000
#: name: (period in days, Fourier order, shortest span in days, spacing in days it needs to stay under)
BUILT_IN = {"yearly": (365.25, 10, 730.0, None), "weekly": (7.0, 3, 14.0, 7.0), "daily": (1.0, 4, 2.0, 1.0)}
RESERVED = (
    "trend", "additive_terms", "daily", "weekly", "yearly", "holidays", "zeros", "extra_regressors_additive", "yhat", "extra_regressors_multiplicative", "multiplicative_terms",
)
RESERVED_COLUMNS = ("ds", "y", "cap", "floor", "y_scaled", "cap_scaled")
