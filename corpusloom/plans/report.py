"""Fixed-width rendering of a small result for a console."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fixed_width(df: DataFrame, most: int = 200, width: int = 40) -> str:
    """The first ``most`` rows as columns of text, numbers to the right, long values cut."""
    rows = df.limit(most).collect()

    def cell(v: object) -> str:
        return "" if v is None else f"{v:,.4f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)[:width]

    table = [list(df.columns), *([cell(v) for v in r] for r in rows)]
    sizes = [max(len(r[i]) for r in table) for i in range(len(df.columns))]
    right = [any(isinstance(r[i], (int, float)) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.rjust(n) if to_right else v.ljust(n) for v, n, to_right in zip(r, sizes, right, strict=True)).rstrip() for r in table)
