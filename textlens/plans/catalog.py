"""Registered queries: one Spark job per operator of the inventory, each with its
independent DuckDB restatement (``ORACLES``) where SQL can express it.

Every query reads the driver's tables (or data Spark derives from them) in full.
Floating outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlens.operators import lm as LM
from textlens.operators import ngram as NG
from textlens.operators import scoring as S
from textlens.plans import fixtures as FX
from textlens.plans.sqlparts import kn_ctes, kn_scored, lm_ctes, metric_ctes, scored_ctes
from textlens.session import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn

    return deco


SIG_DIGITS = 9


def sig(x: F.Column, digits: int = SIG_DIGITS) -> F.Column:
    """Round a positive double to ``digits`` significant digits by scaling with an exact
    power of ten (used where values span many magnitudes, e.g. weighted perplexity)."""
    k = F.floor(F.log10(x)) - F.lit(digits - 1)
    up = F.round(x / F.pow(F.lit(10.0), k)) * F.pow(F.lit(10.0), k)
    down = F.round(x * F.pow(F.lit(10.0), -k)) / F.pow(F.lit(10.0), -k)
    return F.when(x.isNull() | (x <= 0), x).when(k >= 0, up).otherwise(down)


def sig_sql(x: str, digits: int = SIG_DIGITS) -> str:
    k = f"(floor(log10({x})) - {digits - 1})"
    return (f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN {x} WHEN {k} >= 0 THEN round({x} / pow(10.0, {k})) * pow(10.0, {k}) "
            f"ELSE round({x} * pow(10.0, -{k})) / pow(10.0, -{k}) END")


def r6(c) -> F.Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6)


# ---------------------------------------------------------------------------------------
# Flagship: LM fitted on all documents, every document scored at the 12 thresholds.
# ---------------------------------------------------------------------------------------


def doc_rows(spark: SparkSession, sf: str) -> DataFrame:
    return FX.documents(spark, sf).select(F.col("doc_id").alias("row_id"), "text")


def doc_lm(spark: SparkSession, sf: str) -> LM.BigramLM:
    """The LM fitted on all documents."""
    return LM.fit_bigram_lm(FX.documents(spark, sf).select("text"), "text", lazy=True)


def doc_row_metrics(spark: SparkSession, sf: str, weights: DataFrame | None = None) -> DataFrame:
    ts = LM.fit_and_score(doc_rows(spark, sf), "row_id", "text", weights=weights, tokens=False)
    return S.row_metrics_long(ts, ["row_id"], weighted=weights is not None, together=True)


_DOC_SQL = "docs AS (SELECT doc_id AS row_id, text FROM documents)"


@register(
    "perplexity",
    f"""
WITH {_DOC_SQL}, {lm_ctes('documents', 'text')}, {scored_ctes('docs', 'row_id', 'text')}, {metric_ctes('docs', 'row_id')}
SELECT row_id, threshold, total_tokens, filtered_tokens, round(perplexity, 6) AS perplexity,
       round(longest_run, 6) AS longest_run
FROM rm
""",
)
def q_perplexity(spark, sf):
    rm = doc_row_metrics(spark, sf)
    return rm.select("row_id", "threshold", "total_tokens", "filtered_tokens", r6("perplexity").alias("perplexity"),
                     r6("longest_run").alias("longest_run"))


# ---------------------------------------------------------------------------------------
# Shared Spark fixtures of the evaluation rows (conversations).
# ---------------------------------------------------------------------------------------

from textlens.functions import metrics as M  # noqa: E402
from textlens.functions import text as T  # noqa: E402
from textlens.operators import idf as I  # noqa: E402
from textlens.operators import similarity as SIM  # noqa: E402
from textlens.operators import simjoin as SJ  # noqa: E402
from textlens.operators import token_align as TA  # noqa: E402
from textlens.plans.sqlparts import code_tokens, sql_str, thresholds_values, words  # noqa: E402

_EV_SQL = """ev AS (
  SELECT u.conv_id * 1000000 + u.turn AS row_id, u.text AS prompt, 'text' AS language,
         u.text || chr(10) || a1.text AS prediction,
         CASE WHEN a3.text IS NOT NULL THEN u.text || chr(10) || a3.text END AS source
  FROM conversations u
  JOIN conversations a1 ON a1.conv_id = u.conv_id AND a1.turn = u.turn + 1 AND a1.role = 'assistant'
  LEFT JOIN conversations a3 ON a3.conv_id = u.conv_id AND a3.turn = u.turn + 3 AND a3.role = 'assistant'
  WHERE u.role = 'user')"""

_SIDES_SQL = """sides AS (
  SELECT row_id, 'prediction' AS side, prompt, prediction AS text FROM ev
  UNION ALL SELECT row_id, 'source' AS side, prompt, source AS text FROM ev WHERE source IS NOT NULL)"""


def eval_sides(spark, sf) -> DataFrame:
    ev = FX.eval_rows(spark, sf)
    pred = ev.select("row_id", F.lit("prediction").alias("side"), "prompt", F.col("prediction").alias("text"))
    src = ev.filter(F.col("source").isNotNull()).select("row_id", F.lit("source").alias("side"), "prompt", F.col("source").alias("text"))
    return pred.unionByName(src)


def eval_scored_arrays(spark, sf, lm=None) -> DataFrame:
    """Per-row score arrays of the predictions (prompt excluded), LM fitted on documents."""
    ev = FX.eval_rows(spark, sf)
    return LM.score_rows(lm or doc_lm(spark, sf), ev, "row_id", "prediction", "prompt")


def side_metrics(spark, sf, weights=None) -> DataFrame:
    sides = eval_sides(spark, sf)
    ts = LM.score_long(doc_lm(spark, sf), sides, "row_id", "text", "prompt", weights=weights, extra_cols=("side",))
    return S.row_metrics_long(ts, ["row_id", "side"], weighted=weights is not None)


_EV_SCORED = f"WITH {_EV_SQL}, {lm_ctes('documents', 'text')}, {scored_ctes('ev', 'row_id', 'prediction', 'prompt')}"


# ---------------------------------------------------------------------------------------
# 2.1 Sources / sinks
# ---------------------------------------------------------------------------------------


@register("scan_prompts", f"WITH {_EV_SQL} SELECT row_id, prompt, language, source, prediction FROM ev")
def q_scan_prompts(spark, sf):
    return FX.eval_rows(spark, sf).select("row_id", "prompt", "language", "source", "prediction")


@register("scan_prompts_csv", f"WITH {_EV_SQL} SELECT row_id, prompt, language, source, prediction FROM ev")
def q_scan_prompts_csv(spark, sf):
    """The prompt dataset written as quoted CSV (texts hold newlines) under the checkpoint
    folder and read back in splits, its key column checked."""
    import uuid

    from textlens.session import checkpoint_dir
    from textlens.sources import io as IO

    ev = FX.eval_rows(spark, sf).select(F.col("row_id").alias("id"), "prompt", "language", "source", "prediction")
    path = f"{checkpoint_dir(spark).rstrip('/')}/textlens-sinks/{uuid.uuid4().hex}"
    IO.write_csv(ev, path)
    back = IO.read_prompts(spark, path, key="id")
    return back.select(F.col("row_id").cast("bigint").alias("row_id"), "prompt", "language", "source", "prediction")


@register(
    "scan_json",
    "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
)
def q_scan_json(spark, sf):
    from textlens.sources.io import parse_json_column

    ev = FX.table(spark, sf, "events").select("event_id", "props")
    parsed = parse_json_column(ev, "props", "k BIGINT")
    return parsed.select("event_id", F.col("props_parsed.k").alias("k"))


def _paired_share_sql(has_source: bool) -> str:
    src = f"""sum(filtered_tokens) FILTER (WHERE side = 'source') / (coalesce(sum(total_tokens) FILTER (WHERE side = 'source'), 0) + 1e-9)""" if has_source else "NULL::DOUBLE"
    sides = _SIDES_SQL if has_source else "sides AS (SELECT row_id, 'prediction' AS side, prompt, prediction AS text FROM ev)"
    return f"""
WITH {_EV_SQL}, {sides}, {lm_ctes('documents', 'text')}, {scored_ctes('sides', 'row_id', 'text', 'prompt', extra=', side')},
{metric_ctes('sides', 'row_id', ', side')}
SELECT threshold, round(sum(filtered_tokens) FILTER (WHERE side = 'prediction') / (sum(total_tokens) FILTER (WHERE side = 'prediction') + 1e-9), 6) AS filtered_token_percentage,
       round({src}, 6) AS source_filtered_token_percentage
FROM rm GROUP BY threshold_idx, threshold"""


@register("optional_source", _paired_share_sql(False))
def q_optional_source(spark, sf):
    ev = FX.eval_rows(spark, sf).drop("source")
    has_source = "source" in ev.columns
    pred = ev.select("row_id", F.lit("prediction").alias("side"), "prompt", F.col("prediction").alias("text"))
    ts = LM.score_long(doc_lm(spark, sf), pred, "row_id", "text", "prompt", extra_cols=("side",))
    rm = S.row_metrics_long(ts, ["row_id", "side"])
    ps = S.paired_share(rm, has_source=has_source)
    return ps.select("threshold", r6("filtered_token_percentage").alias("filtered_token_percentage"),
                     r6("source_filtered_token_percentage").alias("source_filtered_token_percentage"))


# ---------------------------------------------------------------------------------------
# 2.2 Projections, filters, response parsing, alignment
# ---------------------------------------------------------------------------------------


@register("distinct_language", "SELECT DISTINCT lang AS language FROM documents")
def q_distinct_language(spark, sf):
    return FX.documents(spark, sf).select(F.col("lang").alias("language")).distinct()


@register(
    "filter_language",
    f"SELECT doc_id, len({words('text')})::BIGINT AS n_tokens FROM documents WHERE lang = 'fr'",
)
def q_filter_language(spark, sf):
    d = FX.documents(spark, sf).filter(F.col("lang") == "fr")
    return d.select("doc_id", F.size(T.tokenize_words("text")).cast("bigint").alias("n_tokens"))


def _render_sql() -> str:
    tpl = T.DEFAULT_CHAT_TEMPLATE[:-1]
    e = sql_str(tpl)
    e = f"replace({e}, '{{language}}', lang)"
    e = f"replace({e}, '{{{{ bos_token }}}}', {sql_str(T.BOS)})"
    e = f"replace({e}, '{{{{ messages }}}}', text)"
    return f"SELECT doc_id AS row_id, {e} AS rendered FROM documents"


@register("render_prompt", _render_sql())
def q_render_prompt(spark, sf):
    d = FX.doc_prompts(spark, sf)
    return d.select("row_id", T.render_prompt("prompt", "language").alias("rendered"))


_CHAT_TEMPLATE = """{{ bos_token }}
{%- for m in messages %}
<|{{ m.role }} {{ loop.index }}/{{ loop.length }}|>
  {%- if m.role == 'user' %} {{ m.content | trim }}
  {%- elif m.content %} {{ m['content'] }}{% else %} -
  {%- endif %}
  {%- if not loop.last %}{{ ';' }}{% endif %}
{% endfor %}
{%- if messages[-1].role == 'user' %}<|assistant|>{% endif %}"""


@register("render_chat", f"""
WITH t AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
           WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, '<s>' || string_agg('<|' || role || ' ' || i || '/' || n || '|> ' || CASE
    WHEN role = 'user' THEN regexp_replace(regexp_replace(text, {sql_str(T.LEADING_WS)}, ''), {sql_str(T.TRAILING_WS)}, '')
    WHEN text <> '' THEN text ELSE '-' END || CASE WHEN i < n THEN ';' ELSE '' END, '' ORDER BY i)
  || CASE WHEN arg_max(role, i) = 'user' THEN '<|assistant|>' ELSE '' END AS rendered
FROM t GROUP BY conv_id""")
def q_render_chat(spark, sf):
    """Whole conversations through a template with a loop over the turns and branches."""
    from textlens.functions.template import render_template

    return render_template(FX.chats(spark, sf), _CHAT_TEMPLATE, {"messages": "messages"}, {"bos_token": T.BOS}).select("conv_id", "rendered")


_RESP_SQL = f"""resp AS (
  SELECT doc_id AS row_id, split_part(text, chr(10), 1) AS prompt, lang AS language,
         '### Response' || chr(10) || '```' || lang || chr(10) || text || CASE WHEN lang = 'de' THEN '' ELSE chr(10) || '```' END AS response
  FROM documents),
parts AS (SELECT row_id, prompt, language, string_split(response, '### Response')[-1] AS part FROM resp),
codes AS (
  SELECT row_id, prompt, language, part,
         CASE WHEN len(regexp_extract_all(part, '(?s)```\\Q' || language || '\\E\\n(.*?)\\n```', 1)) > 0
              THEN regexp_extract_all(part, '(?s)```\\Q' || language || '\\E\\n(.*?)\\n```', 1)[1]
              ELSE regexp_replace(string_split(part, '```' || language)[-1], {sql_str(T.LEADING_WS)}, '') END AS code
  FROM parts),
gen AS (SELECT row_id, prompt, code, substr(code, length(regexp_replace(prompt, {sql_str(T.LEADING_WS)}, '')) + 1) AS generated_code FROM codes)"""


@register("response_part", f"WITH {_RESP_SQL} SELECT row_id, part FROM parts")
def q_response_part(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("row_id", T.response_part("response").alias("part"))


@register("extract_code", f"WITH {_RESP_SQL} SELECT row_id, code FROM codes")
def q_extract_code(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("row_id", T.extract_code(T.response_part("response"), F.col("language")).alias("code"))


def _generated(spark, sf):
    r = FX.responses(spark, sf)
    code = r.select("row_id", "prompt", T.extract_code(T.response_part("response"), F.col("language")).alias("code"))
    return code.select("row_id", "prompt", T.strip_prompt("code", "prompt").alias("generated_code"))


@register("strip_prompt", f"WITH {_RESP_SQL} SELECT row_id, generated_code FROM gen")
def q_strip_prompt(spark, sf):
    return _generated(spark, sf).select("row_id", "generated_code")


@register("complete_code", f"WITH {_RESP_SQL} SELECT row_id, prompt || generated_code AS complete_code FROM gen")
def q_complete_code(spark, sf):
    g = _generated(spark, sf)
    return g.select("row_id", T.complete_code("prompt", "generated_code").alias("complete_code"))


@register(
    "join_results",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def q_join_results(spark, sf):
    d = FX.documents(spark, sf).select("doc_id", "lang")
    lab = FX.table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, ["doc_id"], "left")


@register(
    "check_prompt_match",
    f"""WITH {_RESP_SQL},
loud AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
res AS (SELECT g.row_id, CASE WHEN l.doc_id IS NOT NULL THEN '! ' || g.prompt ELSE g.prompt END AS prompt
        FROM gen g LEFT JOIN loud l ON l.doc_id = g.row_id)
SELECT r.row_id, s.prompt, r.prompt AS expected
FROM resp r JOIN res s ON s.row_id = r.row_id WHERE r.prompt IS DISTINCT FROM s.prompt""",
)
def q_check_prompt_match(spark, sf):
    """Results whose prompt is not the dataset's; those of documents labelled toxic are
    recorded with a mark before it."""
    loud = FX.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id")).distinct()
    results = _generated(spark, sf).join(loud.withColumn("__loud", F.lit(True)), ["row_id"], "left").select(
        "row_id", F.when(F.col("__loud"), F.concat(F.lit("! "), F.col("prompt"))).otherwise(F.col("prompt")).alias("prompt"))
    return LM.prompt_mismatches(FX.responses(spark, sf), results).select("row_id", "prompt", "expected")


# ---------------------------------------------------------------------------------------
# 2.3 Token operators
# ---------------------------------------------------------------------------------------


@register(
    "tokenize_words",
    f"SELECT doc_id, len({words('text')})::BIGINT AS n_tokens, array_to_string({words('text')}, ' ') AS joined FROM documents",
)
def q_tokenize_words(spark, sf):
    d = FX.documents(spark, sf).select("doc_id", T.tokenize_words("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("joined"))


@register(
    "tokenize_code",
    f"SELECT doc_id, len({code_tokens('text')})::BIGINT AS n_tokens, array_to_string({code_tokens('text')}, ' ') AS joined FROM documents",
)
def q_tokenize_code(spark, sf):
    d = FX.documents(spark, sf).select("doc_id", T.tokenize_code("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("joined"))


@register(
    "add_bos",
    f"WITH {_EV_SQL} SELECT row_id, (len({words('prediction')}) + 1)::BIGINT AS n_with_bos, list_concat([{sql_str(T.BOS)}], {words('prediction')})[1] AS first_token FROM ev",
)
def q_add_bos(spark, sf):
    ev = FX.eval_rows(spark, sf).select("row_id", T.add_bos(T.tokenize_words("prediction")).alias("s"))
    return ev.select("row_id", F.size("s").cast("bigint").alias("n_with_bos"), F.get("s", 0).alias("first_token"))


@register(
    "validate_length",
    f"""WITH {_EV_SQL} SELECT row_id, len({words('prediction')})::BIGINT AS n_tokens,
       len({words('prediction')}) >= 1 AS valid_with_bos, len({words('prediction')}) >= 2 AS valid_without_bos FROM ev""",
)
def q_validate_length(spark, sf):
    ev = FX.eval_rows(spark, sf)
    text = F.col("prediction")
    return ev.select("row_id", F.size(T.tokenize_words(text)).cast("bigint").alias("n_tokens"),
                     LM.long_enough(text).alias("valid_with_bos"),
                     LM.long_enough(text, add_bos=False).alias("valid_without_bos"))


@register(
    "exclude_prompt",
    f"""WITH {_EV_SQL}, x AS (SELECT row_id, {words('prediction')} AS t, len({words('prompt')}) AS p FROM ev)
SELECT row_id, p::BIGINT AS n_prompt_tokens, greatest(len(t) - p, 0)::BIGINT AS n_scored,
       CASE WHEN len(t) > p THEN t[p + 1] END AS first_scored FROM x""",
)
def q_exclude_prompt(spark, sf):
    ev = FX.eval_rows(spark, sf)
    start = LM.first_scored_position(ev, "prompt", T.tokenize_words, True)
    ev = ev.withColumn("p", (start - 1).cast("bigint"))
    occ = LM.occurrences(ev, "row_id", "prediction", prompt_col="prompt", extra_cols=("p",), keep_empty=True)
    return occ.groupBy("row_id", F.col("p").alias("n_prompt_tokens")).agg(
        F.count("pos").alias("n_scored"), F.min_by("token", "pos").alias("first_scored"))


@register("token_scores", f"{_EV_SCORED} SELECT row_id, pos::INTEGER AS pos, token, round(prob, 6) AS prob FROM sc")
def q_token_scores(spark, sf):
    ev = FX.eval_rows(spark, sf)
    ts = LM.token_scores(doc_lm(spark, sf), ev, "row_id", "prediction", "prompt")
    return ts.select("row_id", "pos", "token", r6("prob").alias("prob"))


_BENCH_T6 = f"WITH bm AS (SELECT item_id, text FROM benchmark), {lm_ctes('documents', 'text')}, {scored_ctes('bm', 'item_id', 'text', add_bos=False)}"


@register("tokens_and_probs", f"{_BENCH_T6} SELECT item_id, pos::INTEGER AS pos, token, round(prob, 6) AS prob FROM sc")
def q_tokens_and_probs(spark, sf):
    b = FX.table(spark, sf, "benchmark").select("item_id", "text")
    t = LM.tokens_and_probs(doc_lm(spark, sf), b, "item_id", "text")
    return t.select("item_id", "pos", "token", r6("prob").alias("prob"))


@register("tokens_and_logprobs", f"{_BENCH_T6} SELECT item_id, pos::INTEGER AS pos, token, round(ln(prob), 6) AS logprob FROM sc")
def q_tokens_and_logprobs(spark, sf):
    b = FX.table(spark, sf, "benchmark").select("item_id", "text")
    t = LM.tokens_and_probs(doc_lm(spark, sf), b, "item_id", "text", as_log_probs=True)
    return t.select("item_id", "pos", "token", r6("logprob").alias("logprob"))


_SPECIAL_SQL = f"""WITH bm AS (SELECT item_id, {sql_str(T.BOS)} || ' ' || text || ' ' || {sql_str(T.EOS)} AS text FROM benchmark),
{lm_ctes('documents', 'text')}, {scored_ctes('bm', 'item_id', 'text', add_bos=False)}
SELECT item_id, count(*) AS n_pairs, round(sum(prob), 6) AS prob_sum FROM sc
WHERE token NOT IN ({', '.join(sql_str(s) for s in T.SPECIAL_TOKENS)}) GROUP BY item_id"""


@register("drop_special", _SPECIAL_SQL)
def q_drop_special(spark, sf):
    b = FX.table(spark, sf, "benchmark").select(
        "item_id", F.concat(F.lit(T.BOS + " "), F.col("text"), F.lit(" " + T.EOS)).alias("text")
    )
    t = LM.tokens_and_probs(doc_lm(spark, sf), b, "item_id", "text")
    arr = LM.assemble_scores(t.withColumn("weight", F.lit(1.0)), ["item_id"])
    kept = arr.select("item_id", LM.drop_special(F.col("scores")).alias("p"))
    return kept.select(
        "item_id",
        F.size("p").cast("bigint").alias("n_pairs"),
        r6(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["prob"])).alias("prob_sum"),
    ).filter(F.col("n_pairs") > 0)


@register("lm_unigram", f"WITH {lm_ctes('documents', 'text')} SELECT token, cu::BIGINT AS cnt FROM lm_uni")
def q_lm_unigram(spark, sf):
    return doc_lm(spark, sf).unigrams.select("token", F.col("cnt").cast("bigint").alias("cnt"))


@register("lm_bigram", f"WITH {lm_ctes('documents', 'text')} SELECT prev, token, cb::BIGINT AS cnt FROM lm_bi")
def q_lm_bigram(spark, sf):
    return doc_lm(spark, sf).bigrams.select("prev", "token", F.col("cnt").cast("bigint").alias("cnt"))


@register(
    "lm_score",
    f"""WITH {_DOC_SQL}, {lm_ctes('documents', 'text')}, {scored_ctes('docs', 'row_id', 'text')}
SELECT row_id, count(*) AS n_scored, round(sum(ln(prob)), 6) AS logprob_sum FROM sc GROUP BY row_id""",
)
def q_lm_score(spark, sf):
    ts = LM.fit_and_score(doc_rows(spark, sf), "row_id", "text", tokens=False).filter("pos IS NOT NULL")
    return ts.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_scored"), r6(F.sum(F.ln("prob"))).alias("logprob_sum"))


# ---------------------------------------------------------------------------------------
# 2.4 Threshold-filtered scoring
# ---------------------------------------------------------------------------------------


@register(
    "threshold_fanout",
    f"WITH {_EV_SQL} SELECT row_id, threshold_idx::INTEGER AS threshold_idx, threshold FROM ev CROSS JOIN {thresholds_values()}",
)
def q_threshold_fanout(spark, sf):
    ev = FX.eval_rows(spark, sf).select("row_id")
    return S.threshold_fanout(ev).select("row_id", "threshold_idx", "threshold")


_EV_METRICS = f"{_EV_SCORED}, {metric_ctes('ev', 'row_id')}"


@register("threshold_filter", f"{_EV_METRICS} SELECT row_id, threshold, (total_tokens - filtered_tokens) AS kept_tokens FROM rm")
def q_threshold_filter(spark, sf):
    f = S.threshold_fanout(eval_scored_arrays(spark, sf))
    return f.select("row_id", "threshold", M.kept_tokens(F.col("scores"), F.col("threshold")).alias("kept_tokens"))


@register("token_counts", f"{_EV_METRICS} SELECT row_id, threshold, total_tokens, filtered_tokens FROM rm")
def q_token_counts(spark, sf):
    rm = S.row_metrics(eval_scored_arrays(spark, sf))
    return rm.select("row_id", "threshold", "total_tokens", "filtered_tokens")


@register("longest_run", f"{_EV_METRICS} SELECT row_id, threshold, round(longest_run, 6) AS longest_run FROM rm")
def q_longest_run(spark, sf):
    rm = S.row_metrics(eval_scored_arrays(spark, sf))
    return rm.select("row_id", "threshold", r6("longest_run").alias("longest_run"))


@register("longest_run_islands", f"{_EV_METRICS} SELECT row_id, threshold, round(longest_run, 6) AS longest_run FROM rm")
def q_longest_run_islands(spark, sf):
    ev = FX.eval_rows(spark, sf)
    ts = LM.score_long(doc_lm(spark, sf), ev, "row_id", "prediction", "prompt")
    rm = S.row_metrics_long(ts, ["row_id"])
    return rm.select("row_id", "threshold", r6("longest_run").alias("longest_run"))


@register("sample_probs", f"{_EV_SCORED} SELECT row_id, (pos - 1 - len({words('prompt')}))::INTEGER AS idx, round(prob, 6) AS prob FROM sc JOIN ev USING (row_id)")
def q_sample_probs(spark, sf):
    sp = S.sample_probs(eval_scored_arrays(spark, sf), ["row_id"])
    return sp.select("row_id", F.posexplode("token_probabilities").alias("idx", "prob")).select("row_id", "idx", r6("prob").alias("prob"))


# IDF weights: fitted on the predictions (document texts), code pieces, word vocabulary.
def doc_weights(spark, sf, agg="mean") -> DataFrame:
    d = FX.documents(spark, sf).select("text")
    vocab = I.corpus_vocabulary(d, "text", T.tokenize_words)
    return I.vocab_weights(vocab, I.idf(d, "text"), "token", agg=agg)


def _idf_sql(admit: bool = False) -> str:
    adm = f" WHERE regexp_full_match(term, {sql_str(I.ADMIT_PATTERN[1:-1])})" if admit else ""
    return f"""idf_terms AS (SELECT DISTINCT d.doc_id, unnest({code_tokens('d.text')}) AS term FROM documents d),
idf_df AS (SELECT term, count(*) AS df FROM idf_terms{adm} GROUP BY term),
idf_tab AS MATERIALIZED (SELECT term, df, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1.0 AS idf FROM idf_df)"""


def _weights_sql(agg: str) -> str:
    fn = {"mean": "avg", "sum": "sum", "max": "max"}[agg]
    return f"""{_idf_sql()},
vocab AS MATERIALIZED (SELECT DISTINCT unnest({words('text')}) AS token FROM documents),
pieces AS MATERIALIZED (SELECT token, unnest({code_tokens('token')}) AS term FROM vocab),
known AS MATERIALIZED (SELECT p.token, {fn}(i.idf) AS weight FROM pieces p JOIN idf_tab i ON i.term = p.term GROUP BY p.token),
wt AS MATERIALIZED (SELECT v.token, coalesce(k.weight, 0.001) AS weight FROM vocab v LEFT JOIN known k ON k.token = v.token)"""


@register("perplexity_weighted", f"""
WITH {_DOC_SQL}, {_weights_sql('mean')}, {lm_ctes('documents', 'text')}, {scored_ctes('docs', 'row_id', 'text', weights_table='wt')},
{metric_ctes('docs', 'row_id', weighted=True)}
SELECT row_id, threshold, {sig_sql('perplexity')} AS perplexity FROM rm""")
def q_perplexity_weighted(spark, sf):
    rm = doc_row_metrics(spark, sf, doc_weights(spark, sf))
    return rm.select("row_id", "threshold", sig(F.col("perplexity")).alias("perplexity"))


@register("scaled_probs", f"""
WITH {_EV_SQL}, {_weights_sql('mean')}, {lm_ctes('documents', 'text')}, {scored_ctes('ev', 'row_id', 'prediction', 'prompt', weights_table='wt')}
SELECT row_id, (pos - 1 - len({words('prompt')}))::INTEGER AS idx, round(prob * weight, 6) AS scaled FROM sc JOIN ev USING (row_id)""")
def q_scaled_probs(spark, sf):
    ev = FX.eval_rows(spark, sf)
    sc = LM.score_rows(doc_lm(spark, sf), ev, "row_id", "prediction", "prompt", weights=doc_weights(spark, sf))
    wide = sc.select("row_id", M.scaled_probs(F.col("scores"), True).alias("s"))
    return wide.select("row_id", F.posexplode("s").alias("idx", "scaled")).select("row_id", "idx", r6("scaled").alias("scaled"))


_DOC_METRICS = f"WITH {_DOC_SQL}, {lm_ctes('documents', 'text')}, {scored_ctes('docs', 'row_id', 'text')}, {metric_ctes('docs', 'row_id')}"


@register("mean_perplexity", f"{_DOC_METRICS} SELECT threshold, round(avg(perplexity), 6) AS mean_perplexity FROM rm GROUP BY threshold")
def q_mean_perplexity(spark, sf):
    c = S.corpus_metrics(doc_row_metrics(spark, sf))
    return c.select("threshold", r6("mean_perplexity").alias("mean_perplexity"))


@register("filtered_share", f"{_DOC_METRICS} SELECT threshold, round(sum(filtered_tokens) / (sum(total_tokens) + 1e-9), 6) AS filtered_share FROM rm GROUP BY threshold")
def q_filtered_share(spark, sf):
    c = S.corpus_metrics(doc_row_metrics(spark, sf))
    return c.select("threshold", r6("filtered_share").alias("filtered_share"))


@register("impute_failed", f"""
WITH docs AS (SELECT doc_id AS row_id, text FROM documents),
reported AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
{lm_ctes('documents', 'text')}, {scored_ctes('docs', 'row_id', 'text')}, {metric_ctes('docs', 'row_id')},
flagged AS (SELECT rm.*, e.doc_id IS NOT NULL AS failed FROM rm LEFT JOIN reported e ON e.doc_id = rm.row_id),
imp AS (
  SELECT row_id, threshold, failed, perplexity, longest_run,
         avg(CASE WHEN NOT failed THEN perplexity END) OVER w AS mp,
         avg(CASE WHEN NOT failed THEN longest_run END) OVER w AS ml
  FROM flagged
  WINDOW w AS (PARTITION BY threshold ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT row_id, threshold, failed,
       round(CASE WHEN failed THEN mp ELSE perplexity END, 6) AS perplexity,
       round(CASE WHEN failed THEN ml ELSE longest_run END, 6) AS longest_run
FROM imp""")
def q_impute_failed(spark, sf):
    """Every document is scored in full; a scorer's error is stood for by labels.toxic = 1."""
    reported = FX.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id")).distinct()
    rm = LM.mark_failed(doc_row_metrics(spark, sf), reported, ["row_id"])
    imp = S.impute_failed(rm, "row_id")
    return imp.select("row_id", "threshold", "failed", r6("perplexity").alias("perplexity"), r6("longest_run").alias("longest_run"))


def _in_batches(spark, rows: DataFrame, group_cols=("threshold",), block_rows: int = 1000):
    """All rows of ``rows`` in three batches, by a hash of the id, through the running tables."""
    import uuid

    from textlens.operators.running import RunningMetrics
    from textlens.session import checkpoint_dir

    rows = materialize(rows.withColumn("__b", F.pmod(F.xxhash64("row_id"), F.lit(3))))
    running = RunningMetrics(spark, f"{checkpoint_dir(spark).rstrip('/')}/textlens-running/{uuid.uuid4().hex}", group_cols, block_rows=block_rows)
    for b in range(3):
        running.add(rows.where(F.col("__b") == b).drop("__b"), b)
    return running


@register("running_corpus_metrics", f"""
WITH {_DOC_SQL}, {lm_ctes('documents', 'text')}, {scored_ctes('docs', 'row_id', 'text')}, {metric_ctes('docs', 'row_id')}
SELECT threshold, count(*) AS n, round(avg(perplexity), 6) AS mean_perplexity,
       round(sum(filtered_tokens) / (sum(total_tokens) + 1e-9), 6) AS filtered_share
FROM rm GROUP BY threshold""")
def q_running_corpus_metrics(spark, sf):
    """The corpus metrics of all documents, added in batches and read from the sums."""
    c = _in_batches(spark, doc_row_metrics(spark, sf)).corpus()
    return c.select("threshold", "n", r6("mean_perplexity").alias("mean_perplexity"), r6("filtered_share").alias("filtered_share"))


@register("running_imputation", ORACLES["impute_failed"].replace("round(CASE WHEN failed THEN mp ELSE perplexity END, 6)", "round(mp, 6)").replace(
    "round(CASE WHEN failed THEN ml ELSE longest_run END, 6)", "round(ml, 6)").replace("threshold, failed,\n       round", "threshold,\n       round") + " WHERE failed")
def q_running_imputation(spark, sf):
    """The imputed metrics of the failed documents, from batches in which later and earlier
    documents are mixed."""
    reported = FX.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id")).distinct()
    imp = _in_batches(spark, LM.mark_failed(doc_row_metrics(spark, sf), reported, ["row_id"])).imputed()
    return imp.select("row_id", "threshold", r6("perplexity").alias("perplexity"), r6("longest_run").alias("longest_run"))


def _wide_sql(extra_select: str = "", extra_cte: str = "") -> str:
    cols = []
    for i, t in enumerate(M.DEFAULT_THRESHOLDS):
        cols.append(f'round(max(perplexity) FILTER (WHERE threshold_idx = {i}), 6) AS "{t}_perplexity"')
        cols.append(f'round(max(longest_run) FILTER (WHERE threshold_idx = {i}), 6) AS "{t}_longest_filtered_sequence"')
    return f"{_EV_METRICS}{extra_cte} SELECT row_id, {', '.join(cols)}{extra_select} FROM rm GROUP BY row_id"


def _wide_spark(spark, sf) -> DataFrame:
    sc = eval_scored_arrays(spark, sf)
    return S.results_wide(sc, "row_id")


@register("results_wide", _wide_sql())
def q_results_wide(spark, sf):
    w = _wide_spark(spark, sf)
    return w.select("row_id", *[r6(F.col(f"`{c}`")).alias(c) for c in w.columns if c != "row_id" and "probabilities" not in c])


@register("source_scoring", f"""
WITH {_EV_SQL}, {_SIDES_SQL}, {lm_ctes('documents', 'text')}, {scored_ctes('sides', 'row_id', 'text', 'prompt', extra=', side')},
{metric_ctes('sides', 'row_id', ', side')}
SELECT row_id, side, threshold, total_tokens, filtered_tokens, round(perplexity, 6) AS perplexity, round(longest_run, 6) AS longest_run FROM rm""")
def q_source_scoring(spark, sf):
    rm = side_metrics(spark, sf)
    return rm.select("row_id", "side", "threshold", "total_tokens", "filtered_tokens", r6("perplexity").alias("perplexity"),
                     r6("longest_run").alias("longest_run"))


@register("source_scoring_weighted", f"""
WITH {_EV_SQL}, {_SIDES_SQL}, {_weights_sql('mean')}, {lm_ctes('documents', 'text')},
{scored_ctes('sides', 'row_id', 'text', 'prompt', extra=', side', weights_table='wt')},
{metric_ctes('sides', 'row_id', ', side', weighted=True)}
SELECT row_id, side, threshold, {sig_sql('perplexity')} AS perplexity FROM rm""")
def q_source_scoring_weighted(spark, sf):
    """Both sides weighted by the documents' IDF; a token that the documents lack weighs 0.001."""
    rm = side_metrics(spark, sf, doc_weights(spark, sf))
    return rm.select("row_id", "side", "threshold", sig(F.col("perplexity")).alias("perplexity"))


@register("paired_share", _paired_share_sql(True))
def q_paired_share(spark, sf):
    ps = S.paired_share(side_metrics(spark, sf), has_source=True)
    return ps.select("threshold", r6("filtered_token_percentage").alias("filtered_token_percentage"),
                     r6("source_filtered_token_percentage").alias("source_filtered_token_percentage"))


# ---------------------------------------------------------------------------------------
# External token scores against their texts
# ---------------------------------------------------------------------------------------

_EXTERNAL_SQL = f"""{_EV_SQL},
xw AS (SELECT row_id, (row_id // 1000000 + row_id % 1000000) % 8 AS f,
  flatten(list_transform({words('prediction')}, lambda w: regexp_extract_all(w, '.{{1,4}}'))) AS t FROM ev),
xp AS (SELECT row_id, f, len(t) AS n, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM xw),
xs AS (SELECT row_id, pos, CASE WHEN f = 3 AND pos = 2 THEN '#' ELSE token END AS token, CASE WHEN f = 4 AND pos = 1 THEN 1.5 ELSE 1.0 / (pos + 2) END AS prob
  FROM xp WHERE NOT (f = 1 AND pos = 3) AND f <> 5 AND NOT (f = 6 AND pos = n - 1)
  UNION ALL SELECT CASE WHEN f = 0 THEN -row_id - 1 ELSE row_id END, CASE WHEN f = 7 THEN n ELSE pos END, token, 1.0 / (pos + 2)
  FROM xp WHERE (f = 2 AND pos = 2) OR (f = 7 AND pos = n - 1) OR (f = 0 AND pos = 0)),
xv AS (SELECT row_id, array_to_string({words('prediction')}, '') AS v FROM ev),
xr AS (SELECT row_id, pos, min(token) AS token, count(*) AS c FROM xs GROUP BY row_id, pos),
xo AS (SELECT xr.*, coalesce(sum(length(token)) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o,
  lag(pos) OVER (PARTITION BY row_id ORDER BY pos) AS before FROM xr),
xd AS (SELECT xo.*, v, list_min(list_filter(range(1, length(token) + 1), lambda i: substr(token, i, 1) <> substr(v, o + i, 1))) AS miss
  FROM xo JOIN xv USING (row_id)),
xf AS (SELECT row_id, min(pos) AS pos FROM xd WHERE miss IS NOT NULL GROUP BY row_id)"""


@register("score_defects", f"""WITH {_EXTERNAL_SQL}
SELECT DISTINCT row_id, 'unknown_row' AS defect, NULL::BIGINT AS pos, NULL::BIGINT AS "at" FROM xs WHERE row_id NOT IN (SELECT row_id FROM ev)
UNION ALL SELECT row_id, 'no_scores', NULL, NULL FROM xv WHERE v <> '' AND row_id NOT IN (SELECT row_id FROM xs)
UNION ALL SELECT row_id, 'bad_prob', pos, NULL FROM xs WHERE NOT (prob > 0 AND prob <= 1) AND row_id IN (SELECT row_id FROM ev)
UNION ALL SELECT row_id, 'repeated_pos', pos, NULL FROM xd WHERE c > 1
UNION ALL SELECT row_id, 'missing_pos', before + 1, NULL FROM xd WHERE before + 1 < pos
UNION ALL SELECT row_id, 'foreign_token', xd.pos, o + miss - 1 FROM xd JOIN xf USING (row_id) WHERE xd.pos = xf.pos
UNION ALL SELECT row_id, 'unread_text', NULL, max(o + length(token)) FROM xd WHERE row_id NOT IN (SELECT row_id FROM xf)
  GROUP BY row_id, v HAVING max(o + length(token)) < length(v)""")
def q_score_defects(spark, sf):
    return TA.score_defects(FX.eval_rows(spark, sf), FX.external_scores(spark, sf), ["row_id"], "prediction").select(
        "row_id", "defect", F.col("pos").cast("bigint").alias("pos"), F.col("at").cast("bigint").alias("at"))


@register("subword_weights", f"""WITH {_EXTERNAL_SQL}, {_weights_sql('mean')},
sound AS (SELECT row_id, f FROM xw WHERE f IN (0, 4)),
ww AS (SELECT row_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT row_id, {words('prediction')} AS w FROM ev)),
wo AS (SELECT *, sum(length(word)) OVER (PARTITION BY row_id ORDER BY i) AS e FROM ww),
tw AS (SELECT xo.row_id, xo.pos, xs.prob, (SELECT arg_min(wo.word, wo.e) FROM wo WHERE wo.row_id = xo.row_id AND wo.e > xo.o) AS word
  FROM xo JOIN xs ON xs.row_id = xo.row_id AND xs.pos = xo.pos JOIN sound ON sound.row_id = xo.row_id)
SELECT row_id, count(*) AS n_tokens, round(sum(coalesce(wt.weight, 0.001)), 6) AS weights,
  round(sum(-ln(prob) * coalesce(wt.weight, 0.001)), 6) AS weighted_nll
FROM tw LEFT JOIN wt ON wt.token = tw.word GROUP BY row_id""")
def q_subword_weights(spark, sf):
    """Scores of sub-word tokens with the IDF weight of the word they begin in, for the rows
    without a defect of order or spelling."""
    ev, scores = FX.eval_rows(spark, sf), FX.external_scores(spark, sf)
    wrong = TA.score_defects(ev, scores, ["row_id"], "prediction").where("defect <> 'bad_prob'").select("row_id").distinct()
    sound = ev.join(wrong, ["row_id"], "left_anti")
    placed = TA.words_of_tokens(sound, scores.join(sound.select("row_id"), ["row_id"], "left_semi"), ["row_id"], "prediction")
    weighted = LM.with_weights(placed.select("row_id", "prob", F.col("word").alias("token")), doc_weights(spark, sf))
    return weighted.groupBy("row_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum("weight"), 6).alias("weights"),
                                          F.round(F.sum(-F.ln("prob") * F.col("weight")), 6).alias("weighted_nll"))


# ---------------------------------------------------------------------------------------
# The n-gram model of order 5, fitted on all documents
# ---------------------------------------------------------------------------------------

_ORDER = 5
_KN_SQL = kn_ctes("documents", "text", _ORDER, NG.FALLBACK)


@register("ngram_kn_discounts", f"WITH {_KN_SQL} " + " UNION ALL ".join(
    f'SELECT {m} AS "order", round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM kd{m}' for m in range(1, _ORDER + 1)))
def q_ngram_kn_discounts(spark, sf):
    tables = NG.adjusted_counts(FX.documents(spark, sf), "text", _ORDER)
    return NG.discounts(tables).select("order", *[F.round(c, 9).alias(c) for c in ("d1", "d2", "d3")])


@register("ngram_kn_scores", f"""WITH {_EV_SQL}, {_KN_SQL}, {kn_scored('ev', 'row_id', 'prediction', 'prompt', _ORDER)}
SELECT ev.row_id, count(ks.prob) AS n_tokens, round(coalesce(sum(ln(ks.prob)), 0), 6) AS log_prob
FROM ev LEFT JOIN ks ON ks.row_id = ev.row_id GROUP BY ev.row_id""")
def q_ngram_kn_scores(spark, sf):
    """The predictions' log probability; the model is that of the documents, so grams of all
    orders and unknown tokens occur."""
    lm = NG.fit_ngram_lm(FX.documents(spark, sf), "text", _ORDER)
    ts = NG.ngram_token_scores(lm, FX.eval_rows(spark, sf), "row_id", "prediction", "prompt")
    return ts.groupBy("row_id").agg(F.count("prob").alias("n_tokens"), F.round(F.coalesce(F.sum(F.ln("prob")), F.lit(0.0)), 6).alias("log_prob"))


# ---------------------------------------------------------------------------------------
# 2.5 IDF
# ---------------------------------------------------------------------------------------


@register("idf", f"WITH {_idf_sql()} SELECT term, df, round(idf, 6) AS idf FROM idf_tab")
def q_idf(spark, sf):
    t = I.idf(FX.documents(spark, sf).select("text"), "text")
    return t.select("term", "df", r6("idf").alias("idf"))


@register("idf_admit", f"WITH {_idf_sql(admit=True)} SELECT term, df, round(idf, 6) AS idf FROM idf_tab")
def q_idf_admit(spark, sf):
    t = I.idf(FX.documents(spark, sf).select("text"), "text", admit=True)
    return t.select("term", "df", r6("idf").alias("idf"))


for _agg in ("mean", "sum", "max"):

    def _mk(agg):
        def q(spark, sf):
            w = doc_weights(spark, sf, agg)
            return w.select("token", r6("weight").alias("weight"))

        return q

    register(f"idf_vocab_{_agg}", f"WITH {_weights_sql(_agg)} SELECT token, round(weight, 6) AS weight FROM wt")(_mk(_agg))


# ---------------------------------------------------------------------------------------
# 2.6 Similarity
# ---------------------------------------------------------------------------------------

_PAIRS_SQL = """pairs AS (
  SELECT a.doc_id AS pair_id, a.doc_id AS cand_id, b.doc_id AS ref_id, a.text AS candidate, b.text AS reference
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


def _ngram_sql(side: str, col: str) -> str:
    w = words(col)
    return f"""(SELECT pair_id, n, gram, count(*) AS cnt FROM (
      SELECT pair_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS gram
      FROM pw_{side} CROSS JOIN (VALUES (1), (2), (3), (4)) AS o(n), LATERAL (SELECT unnest(range(0, greatest(len(w) - n + 1, 0))) AS i)
    ) GROUP BY ALL)"""


_BLEU_SQL = f"""{_PAIRS_SQL},
pw_c AS MATERIALIZED (SELECT pair_id, {words('candidate')} AS w FROM pairs),
pw_r AS MATERIALIZED (SELECT pair_id, {words('reference')} AS w FROM pairs),
lens AS (SELECT c.pair_id, len(c.w)::BIGINT AS c_len, len(r.w)::BIGINT AS r_len FROM pw_c c JOIN pw_r r USING (pair_id)),
cg AS {_ngram_sql('c', 'candidate')},
rg AS {_ngram_sql('r', 'reference')},
cl AS (SELECT cg.pair_id, cg.n, cg.cnt, least(cg.cnt, coalesce(rg.cnt, 0)) AS clip FROM cg LEFT JOIN rg USING (pair_id, n, gram)),
st0 AS (SELECT pair_id,
   {', '.join(f'sum(clip) FILTER (WHERE n = {n}) AS m{n}, sum(cnt) FILTER (WHERE n = {n}) AS d{n}' for n in range(1, 5))}
   FROM cl GROUP BY pair_id),
st AS (SELECT l.pair_id, l.c_len, l.r_len,
   {', '.join(f'coalesce(s.m{n}, 0)::BIGINT AS m{n}, coalesce(s.d{n}, 0)::BIGINT AS d{n}' for n in range(1, 5))}
   FROM lens l LEFT JOIN st0 s USING (pair_id))"""


def _bleu_expr() -> str:
    terms, z = [], "0"
    for n in range(1, 5):
        d = f"greatest(d{n}, 1)"
        z = f"({z} + CASE WHEN m{n} = 0 THEN 1 ELSE 0 END)"
        p = f"(CASE WHEN m{n} <> 0 THEN m{n} / {d} WHEN c_len > 1 THEN ln(c_len) / (5.0::DOUBLE * pow(2.0::DOUBLE, {z}) * {d}) END)"
        terms.append(f"(CASE WHEN {p} IS NOT NULL AND {p} > 0 THEN 0.25::DOUBLE * ln({p}) ELSE 0.0 END)")
    bp = "(CASE WHEN c_len > r_len THEN 1.0 WHEN c_len = 0 THEN 0.0 ELSE exp(1.0 - r_len / c_len) END)"
    return f"CASE WHEN m1 = 0 THEN 0.0 ELSE {bp} * exp({' + '.join(terms)}) END"


@register("ngram_precision", f"WITH {_BLEU_SQL} SELECT pair_id, c_len, r_len, m1, d1, m2, d2, m3, d3, m4, d4 FROM st")
def q_ngram_precision(spark, sf):
    return SIM.ngram_stats(FX.adjacent_pairs(spark, sf)).select("pair_id", "c_len", "r_len", "m1", "d1", "m2", "d2", "m3", "d3", "m4", "d4")


@register(
    "brevity_penalty",
    f"WITH {_BLEU_SQL} SELECT pair_id, round(CASE WHEN c_len > r_len THEN 1.0 WHEN c_len = 0 THEN 0.0 ELSE exp(1.0 - r_len / c_len) END, 6) AS bp FROM st",
)
def q_brevity_penalty(spark, sf):
    st = SIM.ngram_stats(FX.adjacent_pairs(spark, sf))
    return st.select("pair_id", r6(SIM.brevity_penalty("c_len", "r_len")).alias("bp"))


@register("bleu", f"WITH {_BLEU_SQL} SELECT pair_id, round({_bleu_expr()}, 6) AS bleu FROM st")
def q_bleu(spark, sf):
    b = SIM.bleu(FX.adjacent_pairs(spark, sf))
    return b.select("pair_id", r6("bleu").alias("bleu"))


def _shingle_sql(w: str) -> str:
    """Distinct 5-word shingles of a words-list column ``w`` (already materialised)."""
    return (f"list_distinct(CASE WHEN len({w}) >= 5 THEN list_transform(range(0, len({w}) - 4), "
            f"lambda i: array_to_string(list_slice({w}, i + 1, i + 5), ' ')) ELSE [] END)")


_DOC_WORDS = f"dw AS MATERIALIZED (SELECT doc_id, {words('text')} AS w FROM documents)"


@register(
    "shingles5",
    f"""WITH {_DOC_WORDS} SELECT doc_id, len(sh)::BIGINT AS n_shingles, coalesce(list_sort(sh)[1], '') AS first_shingle
FROM (SELECT doc_id, {_shingle_sql('w')} AS sh FROM dw)""",
)
def q_shingles5(spark, sf):
    s = SIM.shingle_sets(FX.documents(spark, sf), "doc_id", "text")
    return s.select("doc_id", F.size("shingles").cast("bigint").alias("n_shingles"),
                    F.coalesce(F.get(F.array_sort("shingles"), 0), F.lit("")).alias("first_shingle"))


_P = SIM.MERSENNE
_MINHASH_SQL = f"""perm AS (SELECT i AS perm, 1 + ((i + 1) * 2654435761) % ({_P} - 1) AS a,
                    ((i + 1) * 2246822519 + 3266489917) % {_P} AS b FROM range(0, {SIM.NUM_PERM}) t(i)),
{_DOC_WORDS},
sh AS (SELECT DISTINCT doc_id, unnest({_shingle_sql('w')}) AS s FROM dw),
hs AS (SELECT doc_id, ('0x' || substr(md5(s), 25, 8))::BIGINT % {_P} AS h FROM sh),
mh AS (SELECT hs.doc_id, perm.perm, min((perm.a * hs.h + perm.b) % {_P}) AS v FROM hs CROSS JOIN perm GROUP BY ALL),
mh_all AS (SELECT d.doc_id, perm.perm, coalesce(mh.v, {_P}) AS v FROM documents d CROSS JOIN perm LEFT JOIN mh USING (doc_id, perm))"""


@register("minhash_signature", f"WITH {_MINHASH_SQL} SELECT doc_id, perm::INTEGER AS perm, v AS minhash FROM mh_all")
def q_minhash_signature(spark, sf):
    sig = SIM.minhash_signatures(FX.documents(spark, sf), "doc_id", "text")
    return sig.select("doc_id", F.posexplode_outer("sig").alias("perm", "minhash"))


@register(
    "jaccard_minhash",
    f"""WITH {_PAIRS_SQL}, {_MINHASH_SQL}
SELECT p.pair_id, round(count(*) FILTER (WHERE x.v = y.v) / {SIM.NUM_PERM}, 6) AS jaccard
FROM pairs p JOIN mh_all x ON x.doc_id = p.cand_id JOIN mh_all y ON y.doc_id = p.ref_id AND y.perm = x.perm GROUP BY p.pair_id""",
)
def q_jaccard_minhash(spark, sf):
    sig = materialize(SIM.minhash_signatures(FX.documents(spark, sf), "doc_id", "text"))
    j = SIM.jaccard_minhash(FX.adjacent_pairs(spark, sf), sig)
    return j.select("pair_id", r6("jaccard").alias("jaccard"))


@register(
    "jaccard_exact",
    f"""WITH {_PAIRS_SQL}, pw AS MATERIALIZED (SELECT pair_id, {words('candidate')} AS wa, {words('reference')} AS wb FROM pairs),
s AS (SELECT pair_id, {_shingle_sql('wa')} AS a, {_shingle_sql('wb')} AS b FROM pw)
SELECT pair_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0
  ELSE len(list_filter(a, lambda x: list_contains(b, x))) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard FROM s""",
)
def q_jaccard_exact(spark, sf):
    j = SIM.jaccard_exact(FX.adjacent_pairs(spark, sf))
    return j.select("pair_id", r6("jaccard").alias("jaccard"))


@register(
    "near_dup_edges",
    f"""WITH {_MINHASH_SQL},
sig AS (SELECT doc_id, list(v ORDER BY perm) AS s FROM mh_all GROUP BY doc_id),
bands AS (SELECT doc_id, b AS band, list_slice(s, b * 8 + 1, b * 8 + 8) AS bucket FROM sig CROSS JOIN range(0, 32) t(b)),
reps AS (SELECT band, bucket, min(doc_id) AS rep_id FROM bands GROUP BY band, bucket),
edges AS (SELECT DISTINCT x.doc_id, r.rep_id FROM bands x JOIN reps r USING (band, bucket) WHERE x.doc_id <> r.rep_id),
sizes AS (SELECT d.doc_id, count(sh.s) AS n FROM documents d LEFT JOIN sh USING (doc_id) GROUP BY d.doc_id),
inter AS (SELECT e.doc_id, e.rep_id, count(*) AS i FROM edges e JOIN sh a ON a.doc_id = e.doc_id
          JOIN sh b ON b.doc_id = e.rep_id AND b.s = a.s GROUP BY ALL),
ex AS (SELECT e.doc_id, e.rep_id, coalesce(i.i, 0) AS i, x.n + y.n - coalesce(i.i, 0) AS u
       FROM edges e JOIN sizes x ON x.doc_id = e.doc_id JOIN sizes y ON y.doc_id = e.rep_id
       LEFT JOIN inter i ON i.doc_id = e.doc_id AND i.rep_id = e.rep_id)
SELECT doc_id, rep_id, round(CASE WHEN u = 0 THEN 1.0 ELSE i / u END, 6) AS jaccard FROM ex
WHERE u = 0 OR i / u >= 0.8""",
)
def q_near_dup_edges(spark, sf):
    docs = FX.documents(spark, sf)
    sig = materialize(SIM.minhash_signatures(docs, "doc_id", "text"))
    e = SIM.near_duplicate_edges(docs, sig, "doc_id", "text", 0.8)
    return e.select("doc_id", "rep_id", r6("jaccard").alias("jaccard"))


def _lev_sql(pairs_cte: str) -> str:
    return f"""WITH RECURSIVE {pairs_cte},
tp AS (SELECT pair_id, {words('candidate')} AS a, {words('reference')} AS r FROM bp),
dp(pair_id, i, d) AS (
  SELECT pair_id, 0, range(0, len(r) + 1) FROM tp
  UNION ALL
  SELECT dp.pair_id, dp.i + 1,
    list_transform(range(0, len(tp.r) + 1), lambda j: j + list_min(list_transform(range(0, j + 1), lambda k:
      (CASE WHEN k = 0 THEN dp.i + 1 ELSE least(dp.d[k] + CASE WHEN tp.a[dp.i + 1] = tp.r[k] THEN 0 ELSE 1 END, dp.d[k + 1] + 1) END) - k)))
  FROM dp JOIN tp ON tp.pair_id = dp.pair_id
  WHERE dp.i < len(tp.a)),
dist AS (SELECT tp.pair_id, len(tp.a)::BIGINT AS n_a, len(tp.r)::BIGINT AS n_b, dp.d[len(tp.r) + 1]::BIGINT AS distance
         FROM tp JOIN dp ON dp.pair_id = tp.pair_id AND dp.i = len(tp.a))"""


_BP_SQL = """bp AS (SELECT b.item_id AS pair_id, b.text AS candidate, n.text AS reference
       FROM benchmark b JOIN benchmark n ON n.item_id = b.item_id + 1)"""


@register("token_levenshtein", f"{_lev_sql(_BP_SQL)} SELECT pair_id, n_a, n_b, distance FROM dist")
def q_token_levenshtein(spark, sf):
    return SIM.token_levenshtein(FX.benchmark_pairs(spark, sf))


@register(
    "edit_distance",
    f"{_lev_sql(_BP_SQL)} SELECT pair_id, round(CASE WHEN greatest(n_a, n_b) > 0 THEN distance / greatest(n_a, n_b) ELSE 1.0 END, 6) AS edit_distance FROM dist",
)
def q_edit_distance(spark, sf):
    d = SIM.normalized_edit_distance(SIM.token_levenshtein(FX.benchmark_pairs(spark, sf)))
    return d.select("pair_id", r6("edit_distance").alias("edit_distance"))


_EDIT_LIMIT = 0.975  # between the least and the greatest distance of unrelated items


@register(
    "edit_distance_join",
    f"""{_lev_sql(_BP_SQL)},
ned AS (SELECT pair_id, distance, CASE WHEN greatest(n_a, n_b) > 0 THEN distance / greatest(n_a, n_b) ELSE 1.0 END AS e FROM dist)
SELECT pair_id, distance, round(e, 6) AS edit_distance FROM ned WHERE e <= {_EDIT_LIMIT}""",
)
def q_edit_distance_join(spark, sf):
    d = SIM.edit_distance_join(FX.benchmark_pairs(spark, sf), _EDIT_LIMIT)
    return d.select("pair_id", "distance", r6("edit_distance").alias("edit_distance"))


# Exact joins over the whole corpus. The SQL goes through all pairs: of shingle sets by their
# shared shingles; of token sequences by length and common words (both bounds of the
# distance), then by the distance table inside a band, a row of it a step.

_SET_JOIN_SQL = f"""{_DOC_WORDS},
sets AS MATERIALIZED (SELECT doc_id, list_sort({_shingle_sql('w')}) AS s FROM dw),
cls AS MATERIALIZED (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS rep_id FROM sets),
sh AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM cls WHERE doc_id = rep_id),
met AS (SELECT b.doc_id, a.doc_id AS rep_id, count(*) / (a.n + b.n - count(*)) AS similarity
        FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY b.doc_id, a.doc_id, a.n, b.n),
links AS (SELECT * FROM met WHERE similarity >= 0.8 UNION ALL SELECT doc_id, rep_id, 1.0 FROM cls WHERE doc_id <> rep_id)"""


@register("near_dup_pairs_exact", f"WITH {_SET_JOIN_SQL} SELECT doc_id, rep_id, round(similarity, 6) AS jaccard FROM links")
def q_near_dup_pairs_exact(spark, sf):
    """Every copy with the smallest id of its class, every pair of classes at 0.8 or more."""
    links, classes = SJ.jaccard_join(FX.documents(spark, sf), threshold=0.8)
    rows = SJ.similar_classes(links, classes)
    return rows.select("doc_id", "rep_id", r6("similarity").alias("jaccard"))


_JOIN_LIMIT = 0.2


def _edit_join_sql(limit: float) -> str:
    k = f"floor({limit}::DOUBLE * greatest(a.n, b.n) + 1e-9)::BIGINT"
    return f"""WITH RECURSIVE tok AS (SELECT doc_id, {words('text')} AS w FROM documents),
cls AS MATERIALIZED (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS rep_id FROM tok),
t AS MATERIALIZED (SELECT doc_id, w, len(w)::BIGINT AS n FROM cls WHERE doc_id = rep_id AND len(w) > 0),
c AS MATERIALIZED (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM t) GROUP BY ALL),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, {k} AS k
  FROM t a JOIN t b ON a.doc_id < b.doc_id AND abs(a.n - b.n) <= {k}),
s AS MATERIALIZED (SELECT x, y, nx, ny, k FROM p JOIN c ca ON ca.doc_id = x JOIN c cb ON cb.doc_id = y AND cb.word = ca.word
  GROUP BY ALL HAVING greatest(nx, ny) - sum(least(ca.c, cb.c)) <= k),
pos AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS i FROM t
  WHERE doc_id IN (SELECT x FROM s UNION SELECT y FROM s)),
dp AS (
  SELECT x, y, nx, ny, k, 0::BIGINT AS i, j, j AS d FROM (SELECT s.*, unnest(range(0, least(k, ny) + 1)) AS j FROM s)
  UNION ALL
  SELECT x, y, nx, ny, k, i, j, j + min(m - j) OVER (PARTITION BY x, y ORDER BY j) AS d FROM (
    SELECT x, y, nx, ny, k, i, j, min(m) AS m FROM (
      SELECT x, y, nx, ny, k, i + 1 AS i, j, d + 1 AS m FROM dp WHERE i < nx AND abs(j - i - 1) <= k
      UNION ALL
      SELECT dp.x, dp.y, nx, ny, k, dp.i + 1, j + 1, d + CASE WHEN a.word = b.word THEN 0 ELSE 1 END
      FROM dp JOIN pos a ON a.doc_id = dp.x AND a.i = dp.i + 1 JOIN pos b ON b.doc_id = dp.y AND b.i = dp.j + 1)
    GROUP BY ALL)),
links AS (SELECT y AS doc_id, x AS rep_id, d AS distance, d / greatest(nx, ny) AS e FROM dp WHERE i = nx AND j = ny)"""


@register(
    "edit_join_documents",
    f"""{_edit_join_sql(_JOIN_LIMIT)}
SELECT doc_id, rep_id, distance, round(e, 6) AS edit_distance FROM links WHERE e <= {_JOIN_LIMIT}
UNION ALL SELECT doc_id, rep_id, 0, 0.0 FROM cls WHERE doc_id <> rep_id""",
)
def q_edit_join_documents(spark, sf):
    """Every copy with the smallest id of its class, every pair of classes within 0.2."""
    links, classes = SJ.edit_join(FX.documents(spark, sf), _JOIN_LIMIT)
    copies = classes.where("doc_id <> rep_id").select("doc_id", "rep_id", F.lit(0).cast("bigint").alias("distance"), F.lit(0.0).alias("edit_distance"))
    return copies.unionByName(links.select(F.col("id_b").alias("doc_id"), F.col("id_a").alias("rep_id"), "distance",
                                           r6("edit_distance").alias("edit_distance")))


@register("token_levenshtein_documents")
def q_token_levenshtein_documents(spark, sf):
    """Each document against the next one, whole texts (no SQL: its table of distances would
    have the product of both lengths in rows)."""
    return SIM.token_levenshtein(FX.adjacent_pairs(spark, sf)).select("pair_id", "n_a", "n_b", "distance")


@register("sink_results_wide", _wide_sql(
    extra_select=", max(n_probs)::BIGINT AS n_token_probabilities",
    extra_cte=f", np AS (SELECT row_id, count(*) AS n_probs FROM sc GROUP BY row_id), rm2 AS (SELECT * FROM rm)",
).replace("FROM rm GROUP BY row_id", "FROM rm LEFT JOIN np USING (row_id) GROUP BY row_id"))
def q_sink_results_wide(spark, sf):
    """Wide results written through the CSV sink (arrays as JSON text) under the
    checkpoint folder and read back."""
    import uuid

    from pyspark.sql import types as PT

    from textlens.session import checkpoint_dir
    from textlens.sources import io as IO

    w = _wide_spark(spark, sf)
    path = IO.write_results(w, f"{checkpoint_dir(spark).rstrip('/')}/textlens-sinks/{uuid.uuid4().hex}")
    fields = [PT.StructField(f.name, PT.StringType() if isinstance(f.dataType, PT.ArrayType) else f.dataType) for f in w.schema.fields]
    back = spark.read.schema(PT.StructType(fields)).option("header", True).option("escape", '"').csv(path)
    num = [c for c in back.columns if c != "row_id" and "probabilities" not in c]
    n = F.size(F.from_json(F.col("token_probabilities"), "array<double>")).cast("bigint")
    return back.select("row_id", *[r6(F.col(f"`{c}`")).alias(c) for c in num], F.when(n > 0, n).alias("n_token_probabilities"))
