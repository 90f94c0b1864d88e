"""SQL for ranks within whole tables without a window over the whole table."""


def placed(source: str, value: str, scope: str = "0") -> str:
    """SQL for source's rows with a value, and below, ties and n: smaller values, equal values and all values in the scope.

    The scope's value range is cut into a thousand cells; the rows in the cells before are counted, and only the rows
    of one cell are ranked together. The columns v_, g_ and cell_ come with it.
    """
    cell = "CASE WHEN r.hi > r.lo THEN CAST(floor((q.v_ - r.lo) / (r.hi - r.lo) * 999e0) AS BIGINT) ELSE 0 END"
    rows = f"SELECT q.*, {cell} AS cell_ FROM (SELECT *, {value} AS v_, {scope} AS g_ FROM {source} WHERE {value} IS NOT NULL) q JOIN (SELECT {scope} AS g_, min({value}) AS lo, max({value}) AS hi FROM {source} GROUP BY 1) r ON q.g_ = r.g_"
    counts = f"SELECT g_, cell_, coalesce(sum(c) OVER (PARTITION BY g_ ORDER BY cell_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_, sum(c) OVER (PARTITION BY g_) AS n_ FROM (SELECT g_, cell_, count(*) AS c FROM ({rows}) GROUP BY g_, cell_)"
    return f"SELECT a.*, CAST(b.before_ + rank() OVER (PARTITION BY a.g_, a.cell_ ORDER BY a.v_) - 1 AS BIGINT) AS below, count(*) OVER (PARTITION BY a.g_, a.cell_, a.v_) AS ties, CAST(b.n_ AS BIGINT) AS n FROM ({rows}) a JOIN ({counts}) b ON a.g_ = b.g_ AND a.cell_ = b.cell_"
