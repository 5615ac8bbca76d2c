"""DuckDB restatement of the rule-based answers (Q2): one row for each report and
intent, from the report's CTEs (``oracle.table_ctes``)."""

from __future__ import annotations

from collections.abc import Callable


def _listed(what: str, rows: str, order: str, sep: str, limit: str = "") -> str:
    return f"coalesce((SELECT string_agg({what}, {sep} ORDER BY {order}) FROM (SELECT * FROM {rows} ORDER BY {order} {limit})), '')"


def answers(t: str, recs: Callable[[str], str]) -> str:
    comma, line, quoted = "', '", "chr(10)", "chr(39) || name || chr(39)"

    def names(where: str) -> str:
        rows = f"{t}_cols WHERE NOT dropped AND {where}"
        return (f"(SELECT count(*) FROM {rows}) || '): ' || {_listed('name', rows, 'pos', comma, 'LIMIT 8')} "
                f"|| CASE WHEN (SELECT count(*) FROM {rows}) > 8 THEN '…' ELSE '' END")

    miss = _listed(f"{quoted} || ' (' || printf('%.1f', missing_pct) || '%)'", f"{t}_cols WHERE NOT dropped AND missing_pct > 0",
                   "missing_pct DESC, pos", comma, "LIMIT 3")
    outl = _listed(f"{quoted} || ' (' || printf('%.1f', outlier_pct) || '%)'",
                   f"(SELECT o.pos, o.outlier_pct, c.name FROM {t}_out o JOIN {t}_cols c USING (pos)) WHERE outlier_pct > 0",
                   "outlier_pct DESC, pos", comma, "LIMIT 3")
    corr = _listed("col1 || ' ↔ ' || col2 || ' (r=' || printf('%.3f', value) || ')'", f"{t}_corr", "rank", "'; '", "LIMIT 3")
    flags = _listed("'• ' || message", f"{t}_flags", "seq", line, "LIMIT 5")
    advice = _listed("seq || '. ' || message", f"({recs(t)})", "seq", line, "LIMIT 5")
    gone = _listed(f"'• ' || {quoted} || ': Dropped: ' || printf('%.1f', ratio * 100) || '% of values are missing (threshold is 60%). A column with this much missing data adds noise rather than signal.'",
                   f"{t}_cols WHERE dropped", "pos", line)
    rows, mp = "format('{:,}', CAST(total_rows AS BIGINT))", "printf('%.1f', missing_pct)"
    dups, outs = "format('{:,}', CAST(duplicate_rows AS BIGINT))", "format('{:,}', CAST(outlier_count AS BIGINT))"
    texts = {
        "health": f"""'The dataset ''{t}'' has a health score of ' || health_score || '/100, indicating ' || CASE WHEN health_score >= 80 THEN 'high' WHEN health_score >= 60 THEN 'moderate' ELSE 'poor' END
          || ' overall quality. It contains ' || {rows} || ' rows and ' || total_columns || ' columns. Missing data is ' || {mp} || '%, there are ' || {dups}
          || ' duplicate rows, and ' || {outs} || ' outlier values were detected across numeric columns.'""",
        "missing": f"""CASE WHEN {miss} <> '' THEN 'Overall, ' || {mp} || '% of cells are missing. The columns with the most missing data are: ' || {miss}
          || '. Consider median imputation for numeric columns and mode/unknown-category for categorical ones.' ELSE 'Overall missing data is ' || {mp} || '%, which is within acceptable limits.' END""",
        "duplicate": f"""CASE WHEN duplicate_rows = 0 THEN 'No duplicate rows were found in this dataset.' ELSE {dups} || ' duplicate rows were detected ('
          || printf('%.1f', CAST(duplicate_rows AS DOUBLE) / CAST(total_rows AS DOUBLE) * 100) || '% of total). Remove them before training to prevent data leakage and inflated accuracy metrics.' END""",
        "outlier": f"""CASE WHEN outlier_count = 0 THEN 'No significant outliers were detected in numeric columns.' ELSE {outs} || ' outlier values were detected. Columns most affected: '
          || {outl} || '. Use IQR capping (clip to 1st/99th percentile) or RobustScaler before training.' END""",
        "bias": f"CASE WHEN flag_count = 0 THEN 'No significant bias or class imbalance was detected in this dataset.' ELSE 'Bias flags detected:' || chr(10) || {flags} END",
        "recommend": f"CASE WHEN {advice} <> '' THEN 'Here are the top recommendations for this dataset:' || chr(10) || {advice} ELSE 'No critical issues — the dataset appears ready for feature engineering.' END",
        "column": f"""'The dataset has ' || total_columns || ' columns after cleaning. Numeric columns (' || {names("kind = 'numeric' AND mean_raw IS NOT NULL")} || '. Categorical columns ('
          || {names("kind <> 'numeric'")} || '.'""",
        "dropped": f"CASE WHEN dropped_count = 0 THEN 'No columns were dropped. All columns had acceptable missing data rates.' ELSE 'Dropped columns and reasons:' || chr(10) || {gone} END",
        "model": f"""'Based on the dataset profile (' || {rows} || ' rows, ' || total_columns || ' columns, ' || {mp}
          || '% missing), I recommend switching to the ''Algo Advisor'' tab for a full ranked list of algorithms with explanations tailored to this dataset.'""",
        "correlation": f"""CASE WHEN {corr} = '' THEN 'No significant correlations were found between numeric columns.' ELSE 'Top correlations found: ' || {corr}
          || '. Strong correlations (|r| > 0.85) may cause multicollinearity in linear models — consider dropping one column from each highly-correlated pair.' END""",
        "default": f"""'The dataset ''{t}'' has ' || {rows} || ' rows, ' || total_columns || ' columns, and a health score of ' || health_score
          || '/100. You can ask me about: missing data, duplicates, outliers, correlations, bias flags, dropped columns, or recommendations.'""",
    }
    return "\nUNION ALL\n".join(f"SELECT '{t}' AS dataset, '{k}' AS intent, {v} AS answer FROM {t}_facts" for k, v in texts.items())
