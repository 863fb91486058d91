"""The feature columns: names, parameters, and which of them a model may use."""

from __future__ import annotations

import re
from collections.abc import Iterable

# Parameters and metrics of the data model.
ALPHAS = [k / 1000 for k in range(1, 11)] + [k / 10 for k in range(1, 11)]
WINDOWS = [2**k for k in range(11)]
CHOSEN_WINDOW = 8
REGULAR = ["seq", "arrival_us", "rtt_us", "min_rtt_us", "rtt_ratio", "interarrival_us", "inv_interarrival_bps", "pkts_lost", "pkts_lost_total", "loss_rate", "inv_sqrt_loss_rate", "payload_b", "wire_b", "total_so_far_b", "payload_so_far_b", "active_flows", "fair_share_frac", "fair_share_bps", "mathis_tput_bps"]
EWMA = ["interarrival_us", "inv_interarrival_bps", "rtt_us", "rtt_ratio", "loss_rate", "inv_sqrt_loss_rate", "mathis_tput_bps"]
WINDOWED = ["interarrival_us", "inv_interarrival_bps", "tput_bps", "tput_share_frac", "total_tput_bps", "tput_fair_share_bps", "tput_to_fair_ratio", "rtt_us", "rtt_ratio", "loss_rate", "inv_sqrt_loss_rate", "mathis_tput_bps"]
WINDOWED_CURRENT = ["loss_event_rate", "inv_sqrt_loss_event_rate", "mathis_ler_bps"]
GROUND_TRUTH = ["drop_rate", "retrans_rate", "active_flows", "fair_share_frac", "fair_share_bps", "tput_share_frac", "total_tput_bps", "tput_fair_share_bps", "tput_to_fair_ratio", "class"]
INPUTS_OF = {
    "rtt_ratio": ["rtt_us", "min_rtt_us"],
    "inv_interarrival_bps": ["interarrival_us"],
    "mathis_tput_bps": ["loss_rate", "rtt_us"],
    "mathis_ler_bps": ["loss_event_rate", "rtt_us"],
    "inv_sqrt_loss_rate": ["loss_rate"],
    "inv_sqrt_loss_event_rate": ["loss_event_rate"],
    "tput_share_frac": ["tput_bps", "total_tput_bps"],
    "tput_to_fair_ratio": ["tput_share_frac"],
}


def ewma_name(metric: str, alpha: float) -> str:
    return f"{metric}_ewma_a{alpha:g}".replace(".", "_")


def window_name(metric: str, k: int) -> str:
    """``_w8``: 8 minimum RTTs; ``_cw8``: 8 current RTTs (loss-event metrics)."""
    return f"{metric}_{'cw' if metric in WINDOWED_CURRENT else 'w'}{k}"


def parse_name(name: str) -> tuple[str, str, float | None]:
    """(metric, kind, parameter) of a column name; kind is regular, ewma, window or current."""
    if m := re.fullmatch(r"(.+)_ewma_a(\d+(?:_\d+)?)", name):
        return m[1], "ewma", float(m[2].replace("_", "."))
    if m := re.fullmatch(r"(.+)_(c?w)(\d+)", name):
        return m[1], "current" if m[2] == "cw" else "window", float(m[3])
    return name, "regular", None


def all_features() -> list[str]:
    """All 318 columns; loss-event metrics need windows of at least 4."""
    windows = [window_name(m, k) for m in WINDOWED for k in WINDOWS] + [window_name(m, k) for m in WINDOWED_CURRENT for k in WINDOWS if k >= 4]
    return REGULAR + [ewma_name(m, a) for m in EWMA for a in ALPHAS] + windows


GROUND_TRUTH_COLUMN = window_name("tput_to_fair_ratio", CHOSEN_WINDOW)


def is_knowable(name: str) -> bool:
    """Whether a receiver on its own can know a column."""
    return parse_name(name)[0] not in GROUND_TRUTH


def knowable_features() -> list[str]:
    return [c for c in all_features() if is_knowable(c)]


def close_over_inputs(columns: Iterable[str]) -> list[str]:
    """The columns with all those they are computed from."""
    out, waiting = set(), list(columns)
    while waiting:
        name = waiting.pop()
        if name in out:
            continue
        out.add(name)
        metric, kind, p = parse_name(name)
        for needed in INPUTS_OF.get(metric, []):
            if kind == "regular" or needed == "min_rtt_us":
                waiting.append(needed)
            elif kind == "ewma":
                waiting.append(ewma_name(needed, p) if needed in EWMA else needed)
            else:
                current = kind == "current" and needed in WINDOWED_CURRENT
                waiting.append(window_name(needed, int(p)) if current or kind == "window" and needed in WINDOWED else needed)
    return sorted(out)


def model_inputs() -> list[str]:
    """Default model columns: knowable, without sizes and totals, loss-event windows 4 to 16, other windows up to 32."""
    barred = {"pkts_lost_total", "payload_b", "wire_b", "inv_sqrt_loss_rate"}

    def allowed(name: str) -> bool:
        _, kind, p = parse_name(name)
        return name not in barred and (kind in ("regular", "ewma") or kind == "current" and 4 <= p <= 16 or kind == "window" and p <= 32)

    return sorted(c for c in knowable_features() if allowed(c))
