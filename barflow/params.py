"""Market and model parameters.  Operators take them as ``params`` so each one is a default."""

from __future__ import annotations

# Contract, session and feature constants of the market being modelled.
DEFAULTS: dict[str, float] = {
    "tick_size": 0.25,
    "tick_value": 5.0,
    "commission_rt": 4.5,
    "slippage_per_side": 5.0,
    "cost_rt": 14.5,
    "cost_vol_mult": 0.5,
    "cost_spread_mult": 1.0,
    "cost_session_mult": 0.2,
    "cost_volume_discount": 0.1,
    "cost_lookback": 50,
    "large_lot": 10,
    "whale_lot": 30,
    "rth_open_min": 570,
    "rth_close_min": 960,
    "eth_open_min": 180,
    "rth_minutes": 390,
    "or_minutes": 30,
    "stack_ratio": 3.0,
    "stack_levels": 3,
    "tape_spike_z": 2.5,
    "whip_z": 3.0,
    "recoil_low": 0.4,
    "recoil_high": 0.7,
    "extreme_aggression": 2,
    "delta_z_window": 24,
    "zero_print_window": 24,
    "divergence_lag": 6,
    "alignment_window": 12,
    "alignment_min": 6,
    "swing_lookback": 12,
    "swing_max_bars": 30,
    "profile_window": 24,
    "value_area_share": 0.70,
    "proximity_atr": 0.5,
    "range_window": 6,
    "range_z_window": 24,
    "accum_window": 12,
    "regime_vol_window": 50,
    "autocorr_window": 20,
    "autocorr_min": 10,
    "stall_compression": 0.5,
    "context_days": 4,
    "capital": 100_000.0,
    "decay_window_days": 60,
    "decay_step_days": 10,
    "decay_min_windows": 5,
    "stable_half_life": 120.0,
    "factor_min_days": 20,
    "factor_r2": 0.3,
    "factor_t": 2.0,
    "seed": 42,
}


def resolve(params: dict | None = None) -> dict:
    """Defaults overlaid with the caller's values; unknown names are an error."""
    extra = set(params or {}) - set(DEFAULTS)
    if extra:
        raise ValueError(f"unknown parameters: {sorted(extra)}")
    return {**DEFAULTS, **(params or {})}
