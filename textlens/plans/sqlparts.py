"""Shared fragments of the DuckDB oracle statements (the independent SQL restatement of
each query, used by the correctness gate)."""

from __future__ import annotations

from textlens.functions.metrics import DEFAULT_THRESHOLDS
from textlens.functions.text import BOS, CODE_TOKEN_PATTERN, WS_RUN
from textlens.operators.lm import DEFAULT_LAMBDA


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(expr: str) -> str:
    """Whitespace tokens of ``expr`` as a DuckDB list."""
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), {sql_str(WS_RUN)}), lambda x: x <> '')"


def code_tokens(expr: str) -> str:
    return f"regexp_extract_all(coalesce({expr}, ''), {sql_str(CODE_TOKEN_PATTERN)})"


def thresholds_values(thresholds=DEFAULT_THRESHOLDS) -> str:
    rows = ", ".join(f"({i}, {float(t)!r}::DOUBLE)" for i, t in enumerate(thresholds))
    return f"(VALUES {rows}) AS thr(threshold_idx, threshold)"


def dbl(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def lm_ctes(fit_table: str, text_col: str) -> str:
    """CTEs ``lm_bi(prev, token, cb)``, ``lm_uni(token, cu)``, ``lm_ctx(prev, cc)``,
    ``lm_tot(n_tokens, n_types)`` of the bigram LM fitted on ``fit_table`` with a start token."""
    return f"""
lm_seq AS (SELECT row_number() OVER () AS rid, list_concat([{sql_str(BOS)}], {words(text_col)}) AS s FROM {fit_table}),
lm_occ0 AS (SELECT rid, unnest(s) AS token, generate_subscripts(s, 1) AS idx FROM lm_seq),
lm_occ AS (SELECT token, lag(token) OVER (PARTITION BY rid ORDER BY idx) AS prev, idx FROM lm_occ0),
lm_bi AS (SELECT prev, token, count(*) AS cb FROM lm_occ WHERE idx > 1 GROUP BY prev, token),
lm_uni AS (SELECT token, sum(cb) AS cu FROM lm_bi GROUP BY token),
lm_ctx AS (SELECT prev, sum(cb) AS cc FROM lm_bi GROUP BY prev),
lm_tot AS (SELECT sum(cu) AS n_tokens, count(*) AS n_types FROM lm_uni)"""


def prob_expr(cb="b.cb", cc="c.cc", cu="u.cu", n="t.n_tokens", v="t.n_types", lam=DEFAULT_LAMBDA) -> str:
    uni = f"((coalesce({cu}, 0) + 1) / ({n} + {v} + 1))"
    bi = f"(coalesce({cb}, 0) / {cc})"
    return f"CASE WHEN {cc} IS NOT NULL AND {cc} > 0 THEN {dbl(lam)} * {bi} + {dbl(1.0 - lam)} * {uni} ELSE {uni} END"


def scored_ctes(rows_table: str, id_col: str, text_col: str, prompt_col: str | None = None,
                add_bos: bool = True, extra: str = "", weights_table: str | None = None) -> str:
    """CTE ``sc(<id>, [extra], pos, token, prob, weight)``: scored occurrences of
    ``rows_table`` under the LM CTEs. ``extra`` is a comma-prefixed list of key columns."""
    first = sql_str(BOS) if add_bos else "NULL::VARCHAR"
    plen = f"len({words(prompt_col)})" if prompt_col else "0"
    start = f"{plen} + {1 if add_bos else 2}"
    w_join = f"LEFT JOIN {weights_table} w ON w.token = o.token" if weights_table else ""
    w_col = "coalesce(w.weight, 0.001)" if weights_table else "1.0::DOUBLE"
    return f"""
sc_seq AS (SELECT {id_col}{extra}, list_concat([{first}], {words(text_col)}) AS s, {start} AS start FROM {rows_table}),
sc_occ0 AS (SELECT {id_col}{extra}, start, unnest(s) AS token, generate_subscripts(s, 1) - 1 AS pos FROM sc_seq),
sc_occ AS (SELECT {id_col}{extra}, start, pos, token,
           lag(token) OVER (PARTITION BY {id_col}{extra} ORDER BY pos) AS prev FROM sc_occ0),
sc AS (
  SELECT o.{id_col}{extra.replace(', ', ', o.')}, o.pos, o.token, {prob_expr()} AS prob, {w_col} AS weight
  FROM sc_occ o
  LEFT JOIN lm_bi b ON b.prev = o.prev AND b.token = o.token
  LEFT JOIN lm_ctx c ON c.prev = o.prev
  LEFT JOIN lm_uni u ON u.token = o.token
  {w_join}
  CROSS JOIN lm_tot t
  WHERE o.pos >= o.start
)"""


def metric_ctes(rows_table: str, id_col: str, extra: str = "", weighted: bool = False, thresholds=DEFAULT_THRESHOLDS) -> str:
    """CTE ``rm(<id>, [extra], threshold_idx, threshold, total_tokens, filtered_tokens,
    perplexity, longest_run)`` over ``sc`` for every row of ``rows_table``; longest run by
    gaps-and-islands."""
    nll = "-ln(prob) * weight" if weighted else "-ln(prob)"
    ex_o = extra.replace(", ", ", r.")
    return f"""
rt AS (SELECT sc.*, thr.threshold_idx, thr.threshold, (prob >= thr.threshold) AS f FROM sc CROSS JOIN {thresholds_values(thresholds)}),
isl AS (SELECT {id_col}{extra}, threshold, pos - row_number() OVER (PARTITION BY {id_col}{extra}, threshold ORDER BY pos) AS grp
        FROM rt WHERE f),
lr AS (SELECT {id_col}{extra}, threshold, max(cnt) AS best FROM
       (SELECT {id_col}{extra}, threshold, grp, count(*) AS cnt FROM isl GROUP BY ALL) GROUP BY ALL),
ag AS (SELECT {id_col}{extra}, threshold, count(*) AS total_tokens, count(*) FILTER (WHERE f) AS filtered_tokens,
       sum({nll}) FILTER (WHERE NOT f) AS nll, count(*) FILTER (WHERE NOT f) AS n_kept FROM rt GROUP BY ALL),
rm AS (
  SELECT r.{id_col}{ex_o}, thr.threshold_idx, thr.threshold,
         coalesce(ag.total_tokens, 0) AS total_tokens, coalesce(ag.filtered_tokens, 0) AS filtered_tokens,
         CASE WHEN ag.n_kept > 0 THEN exp(ag.nll / ag.n_kept) END AS perplexity,
         CASE WHEN coalesce(ag.total_tokens, 0) > 0 THEN coalesce(lr.best, 0) / ag.total_tokens ELSE 0.0 END AS longest_run
  FROM {rows_table} r CROSS JOIN {thresholds_values(thresholds)}
  LEFT JOIN ag ON ag.{id_col} = r.{id_col} AND ag.threshold = thr.threshold {''.join(f' AND ag.{c} = r.{c}' for c in extra.split(', ') if c)}
  LEFT JOIN lr ON lr.{id_col} = r.{id_col} AND lr.threshold = thr.threshold {''.join(f' AND lr.{c} = r.{c}' for c in extra.split(', ') if c)}
)"""


def _lagged(source: str, key: str, seq: str, order: int, extra: str = "") -> str:
    """One row per token of the list ``seq``: its place ``idx`` and the tokens l1.. before it."""
    lags = ", ".join(f"lag(token, {k}) OVER (PARTITION BY {key} ORDER BY idx) AS l{k}" for k in range(1, order + 1))
    return f"""SELECT *, {lags} FROM (SELECT {key}{extra}, unnest({seq}) AS token, generate_subscripts({seq}, 1) AS idx FROM {source})"""


def _context(m: int, prefix: str = "") -> str:
    return "array_to_string([" + ", ".join(f"{prefix}l{k}" for k in range(m - 1, 0, -1)) + "], ' ')" if m > 1 else "''"


def kn_ctes(fit_table: str, text_col: str, order: int, fallback=(0.5, 1.0, 1.5)) -> str:
    """CTEs of the modified Kneser-Ney model: ``a{m}(ctx, token, a)``, ``kd{m}(d1, d2, d3)``,
    ``kc{m}(ctx, total, gamma)`` for the orders m, and ``kv(v)``, the number of tokens seen."""
    out = [f"kn_seq AS (SELECT row_number() OVER () AS rid, list_concat([{sql_str(BOS)}], {words(text_col)}) AS s FROM {fit_table})",
           f"kn_occ AS MATERIALIZED ({_lagged('kn_seq', 'rid', 's', order)})"]
    f1, f2, f3 = (dbl(x) for x in fallback)
    for m in range(1, order + 1):
        count = "count(*)" if m == order else f"count(DISTINCT l{m}) + count(*) FILTER (WHERE l{m} IS NULL)"
        out.append(f"a{m} AS MATERIALIZED (SELECT {_context(m)} AS ctx, token, {count} AS a FROM kn_occ WHERE idx >= greatest(2, {m}) GROUP BY ALL)")
        out.append(f"kt{m} AS (SELECT count(*) FILTER (WHERE a = 1) AS t1, count(*) FILTER (WHERE a = 2) AS t2, "
                   f"count(*) FILTER (WHERE a = 3) AS t3, count(*) FILTER (WHERE a = 4) AS t4 FROM a{m})")
        out.append(f"kr{m} AS (SELECT 1 - 2 * y * t2 / t1 AS d1, 2 - 3 * y * t3 / t2 AS d2, 3 - 4 * y * t4 / t3 AS d3 FROM (SELECT *, t1 / (t1 + 2 * t2) AS y FROM kt{m}))")
        ok = "d1 BETWEEN 0 AND 1 AND d2 BETWEEN 0 AND 2 AND d3 BETWEEN 0 AND 3"
        out.append(f"kd{m} AS MATERIALIZED (SELECT CASE WHEN {ok} THEN d1 ELSE {f1} END AS d1, CASE WHEN {ok} THEN d2 ELSE {f2} END AS d2, "
                   f"CASE WHEN {ok} THEN d3 ELSE {f3} END AS d3 FROM kr{m})")
        out.append(f"kc{m} AS MATERIALIZED (SELECT ctx, sum(a) AS total, sum(CASE a WHEN 1 THEN d1 WHEN 2 THEN least(d2, 2) ELSE least(d3, a) END) / sum(a) AS gamma "
                   f"FROM a{m}, kd{m} GROUP BY ctx)")
    out.append("kv AS (SELECT count(*) AS v FROM a1)")
    return ",\n".join(out)


def kn_scored(rows_table: str, id_col: str, text_col: str, prompt_col: str, order: int) -> str:
    """CTE ``ks(<id>, pos, token, prob)`` of the scored tokens of ``rows_table``, each
    probability by the recursion from order 0 up."""
    p, joins = "1.0::DOUBLE / (kv.v + 1)", ""
    for m in range(1, order + 1):
        joins += (f" LEFT JOIN kc{m} c{m} ON o.idx >= {m} AND c{m}.ctx = {_context(m, 'o.')}"
                  f" LEFT JOIN a{m} g{m} ON o.idx >= {m} AND g{m}.ctx = {_context(m, 'o.')} AND g{m}.token = o.token CROSS JOIN kd{m} e{m}")
        cut = f"CASE g{m}.a WHEN 1 THEN e{m}.d1 WHEN 2 THEN e{m}.d2 ELSE e{m}.d3 END"
        p = f"CASE WHEN c{m}.total IS NULL THEN {p} ELSE coalesce(greatest(g{m}.a - {cut}, 0), 0) / c{m}.total + c{m}.gamma * ({p}) END"
    seq = f"(SELECT {id_col}, len({words(prompt_col)}) + 1 AS start, list_concat([{sql_str(BOS)}], {words(text_col)}) AS s FROM {rows_table})"
    return f"""ks_occ AS MATERIALIZED ({_lagged(seq, id_col, 's', order - 1 or 1, ', start')}),
ks AS (SELECT o.{id_col}, o.idx - 1 AS pos, o.token, {p} AS prob FROM ks_occ o{joins} CROSS JOIN kv WHERE o.idx - 1 >= o.start)"""
