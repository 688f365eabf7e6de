"""DuckDB spellings of the shared expressions, used only by oracle queries."""

from __future__ import annotations

RUNS_CLOCK = "TIMESTAMP '2024-01-31 00:00:00'"
FILES_CLOCK = "TIMESTAMP '2001-11-05 00:00:00'"


def secs(start: str, end: str) -> str:
    return f"(date_diff('microsecond', {start}, {end}) / 1000000.0)"


def hms(a: str, tag: str = "H") -> str:
    h = f"floor(({a}) / 3600)"
    m = f"floor(({a}) / 60 - {h} * 60)"
    s = f"floor(({a}) - {h} * 3600 - {m} * 60)"
    as_txt = lambda x: f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
    return f"concat_ws('', {as_txt(h)}, '{tag}:', {as_txt(m)}, 'm:', {as_txt(s)}, 's')"


def ts_text(c: str) -> str:
    return f"strftime({c}, '%Y%m%d %H:%M:%S')"


def run_id(c: str) -> str:
    """Run id of a session's client text: from character 11 to the next space; NULL without one."""
    return f"nullif(regexp_extract({c}, '^.{{10}}([^ ]*) ', 1, 's'), '')"


def cnt_if(cond: str) -> str:
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def round_duration(start: str, end: str, unit_secs: float, digits: int) -> str:
    """Exact half-up rounding of a duration in integer microseconds."""
    u = int(unit_secs * 1_000_000)
    m = f"date_diff('microsecond', {start}, {end})"
    sc = 10 ** digits
    return f"(CAST(sign({m}) * ((abs({m}) * {2 * sc} + {u}) // {2 * u}) AS DOUBLE) / {sc})"


def round_rate(amount: str, start: str, end: str, digits: int = 0) -> str:
    """Exact half-up ``ROUND(amount / seconds, d)`` for non-negative amounts."""
    m = f"nullif(date_diff('microsecond', {start}, {end}), 0)"
    sc = 10 ** digits
    return f"(CAST(({amount} * {2_000_000 * sc} + {m}) // (2 * {m}) AS DOUBLE) / {sc})"


def num_text(x: str) -> str:
    return (f"CASE WHEN ({x}) IS NULL THEN NULL WHEN abs({x}) >= 1000000000000 THEN repeat('#', 16) "
            f"ELSE lpad(format('{{:,}}', CAST({x} AS BIGINT)), 16, ' ') END")


def interval_text(micros: str) -> str:
    """Sign, days and time of a number of microseconds."""
    m = f"abs({micros})"
    return (f"CASE WHEN ({micros}) IS NULL THEN NULL ELSE if({micros} < 0, '-', '+') || format('{{:09d}} {{:02d}}:{{:02d}}:{{:02d}}.{{:06d}}', "
            f"{m} // 86400000000, {m} // 3600000000 % 24, {m} // 60000000 % 60, {m} // 1000000 % 60, {m} % 1000000) END")
