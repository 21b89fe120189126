"""Pictures of intervals, for a look at a handful of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 1000


def visualize_intervals(df: DataFrame, label: str = "overlapping pair", color: str | None = None, max_rows: int = MAX_ROWS):
    """Draw the pairs of an ``overlap`` or ``nearest`` result, one line a pair, with matplotlib (needed only here).

    ``df`` has start_1, end_1, start_2 and end_2; at most ``max_rows`` rows can be drawn, more are an error."""
    import matplotlib.pyplot as plt

    rows = df.select("start_1", "end_1", "start_2", "end_2").limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows: select some of them first")
    fig, axes = plt.subplots()
    for k, r in enumerate(rows):
        axes.hlines(k, r["start_1"], r["end_1"], colors=color or "C0", linewidth=4, label=label if not k else None)
        if r["start_2"] is not None:
            axes.hlines(k + 0.3, r["start_2"], r["end_2"], colors="C1", linewidth=4)
    axes.set_xlabel("position")
    axes.set_yticks([])
    if rows:
        axes.legend()
    return fig
