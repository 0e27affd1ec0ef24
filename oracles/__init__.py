"""Independent DuckDB oracle SQL per registered query."""


def all_sql() -> dict[str, str]:
    from oracles import clean_sql, cohort_sql, hierarchy_sql, io_sql, joins_sql, metrics_sql, report_sql, responses_sql, text_sql
    out: dict[str, str] = {}
    for mod in (cohort_sql, metrics_sql, hierarchy_sql, clean_sql, report_sql, joins_sql, text_sql, responses_sql, io_sql):
        for k, v in mod.SQL.items():
            if k in out:
                raise ValueError(f"duplicate oracle {k}")
            out[k] = v
    return out
