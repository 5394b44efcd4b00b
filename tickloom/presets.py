"""Fee schedules, market defaults, rule defaults and grids."""

# --- fixed values: fee schedules (fractions; commission in currency per order) ---
FEE_FIELDS = ("commission_per_trade", "commission_pct", "spread_pct", "fx_conversion_pct", "tax_pct", "overnight_daily_pct")
FEES = {
    "zero": (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    "us_stocks": (1.0, 0.0, 0.0005, 0.0025, 0.0, 0.0),
    "us_stocks_usd_account": (1.0, 0.0, 0.0005, 0.0, 0.0, 0.0),
    "us_etfs_usd_account": (1.0, 0.0, 0.0003, 0.0, 0.0, 0.0),
    "forex_majors": (0.0, 0.0, 0.0001, 0.0, 0.0, 0.0),
    "forex_saxo": (0.0, 0.0, 0.00015, 0.0, 0.0, 0.0),
    "eu_stocks": (10.0, 0.001, 0.001, 0.0, 0.003, 0.0),
}

# --- fixed values: market defaults (capital, whole shares) ---
MARKETS = {"us_stocks": (10_000.0, True), "us_etfs": (100_000.0, False), "forex": (100_000.0, False)}
FALLBACK_MARKET = (10_000.0, True)

# --- fixed values: rule defaults, grids and names ---
DEFAULTS = {
    "rsi2": {
        "rsi_period": 2, "rsi_entry_threshold": 10.0, "sma_trend_period": 200, "sma_exit_period": 5,
        "rsi_exit_threshold": 0.0, "sma_trend_buffer": 1.01, "sl_percent": 0.0, "position_fraction": 0.2,
        "cooldown_candles": 0,
    },
    "ibs": {
        "ibs_entry_threshold": 0.2, "ibs_exit_threshold": 0.8, "sma_trend_period": 200, "sl_percent": 0.0,
        "position_fraction": 0.2, "cooldown_candles": 0,
    },
    "tom": {
        "entry_days_before_eom": 5, "exit_day_of_new_month": 3, "max_holding_days": 10, "position_fraction": 1.0,
        "sl_percent": 0.0, "cooldown_candles": 0,
    },
    "ibs_tom": {
        "entry_days_before_eom": 5, "exit_day_of_new_month": 3, "max_holding_days": 10, "ibs_entry_threshold": 0.2,
        "ibs_exit_threshold": 0.8, "sma_trend_period": 200, "position_fraction": 1.0, "sl_percent": 0.0,
        "cooldown_candles": 0,
    },
    "donchian": {
        "entry_mode": "donchian", "donchian_entry_period": 50, "donchian_exit_period": 20, "ema_fast": 9,
        "ema_slow": 50, "adx_period": 14, "adx_threshold": 20.0, "atr_period": 14, "trailing_atr_mult": 4.0,
        "exit_mode": "trailing", "sl_percent": 10.0, "cooldown_candles": 3, "position_fraction": 0.3,
    },
}
GRIDS = {
    "rsi2": {
        "rsi_period": [2], "rsi_entry_threshold": [5, 10, 15, 20], "sma_trend_period": [150, 200, 250],
        "sma_exit_period": [3, 5, 7, 10],
    },
    "ibs": {
        "ibs_entry_threshold": [0.1, 0.15, 0.2, 0.25], "ibs_exit_threshold": [0.7, 0.8, 0.9],
        "sma_trend_period": [150, 200, 250],
    },
    "tom": {"entry_days_before_eom": [3, 4, 5, 6], "exit_day_of_new_month": [2, 3, 4]},
    "ibs_tom": {
        "entry_days_before_eom": [4, 5, 6], "ibs_entry_threshold": [0.15, 0.2, 0.25], "exit_day_of_new_month": [2, 3],
    },
    "donchian": {
        "donchian_entry_period": [20, 50, 80], "donchian_exit_period": [10, 20], "adx_period": [14],
        "adx_threshold": [15, 20, 25], "atr_period": [14], "trailing_atr_mult": [3.0, 4.0, 5.0],
    },
    "signal_donchian": {
        "entry_mode": ["donchian"], "donchian_entry_period": [50], "donchian_exit_period": [20], "adx_period": [14],
        "adx_threshold": [0, 20], "atr_period": [14], "trailing_atr_mult": [3.0, 4.0, 5.0],
        "exit_mode": ["trailing"], "sl_percent": [8.0, 10.0], "position_fraction": [0.3], "cooldown_candles": [3],
    },
}
ALIASES = {
    "rsi2": "rsi2", "rsi2_mean_reversion": "rsi2", "ibs": "ibs", "ibs_mean_reversion": "ibs", "tom": "tom",
    "turn_of_month": "tom", "ibs_tom": "ibs_tom", "ibs_turn_of_month": "ibs_tom", "donchian": "donchian",
    "donchian_trend": "donchian",
}
WALK_FORWARD = {"is_days": 756, "oos_days": 252, "step_days": 126, "embargo_days": 1}
STOP_LEVELS = [-0.05, -0.08, -0.10, -0.15, -0.20]
