"""Signal catalogue and run tables (S, P, A, O, U) and text functions (T). Catalogue rows are derived from parts, runs from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, diversity, runs, text
from ..sources import readers, writers
from .base import both, q6, query, r6, scratch, table

_FIELD = "CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'close' WHEN 1 THEN 'volume' WHEN 2 THEN 'returns' WHEN 3 THEN 'market_cap' ELSE 'cs_roa' END"
_CAT = f"""
SELECT id, expression, status, reason, is_ic, is_icir, is_tstat, is_sharpe, turnover, coverage, source, model, batch, idea, prompt_tokens, completion_tokens FROM (
    SELECT p_partkey AS id,
        CASE CAST(p_size % 8 AS INT) WHEN 0 THEN concat('cs_rank(ts_delta_5(', f, '))') WHEN 1 THEN concat('sub(', f, ', ', f, ')') WHEN 2 THEN concat('add(cs_rank(', f, '),neg(cs_rank(open)))')
            WHEN 3 THEN concat('sign(abs_val(', f, '))') WHEN 4 THEN concat('ts_mean_', CAST(5 + 5 * (p_size % 2) AS INT), '(', f, ')') WHEN 5 THEN '' WHEN 6 THEN concat('safe_div(', f, ', low)') ELSE concat('neg(', f, ')') END AS expression,
        CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'reject' WHEN 1 THEN 'duplicate' ELSE 'ok' END AS status,
        CASE CAST(p_partkey % 12 AS INT) WHEN 0 THEN 'sparse' WHEN 6 THEN 'constant' END AS reason,
        CASE WHEN p_partkey % 9 <> 4 THEN (p_retailprice - 1400.0) / 10000.0 END AS is_ic, (p_retailprice - 1400.0) / 1000.0 AS is_icir, (p_retailprice - 1400.0) / 100.0 AS is_tstat, (p_size - 25.0) / 10.0 AS is_sharpe,
        p_size / 50.0 AS turnover, 1.0 - p_size / 60.0 AS coverage, p_brand AS source, CASE WHEN p_size % 3 = 0 THEN 'small' WHEN p_size % 3 = 1 THEN 'large' ELSE 'other' END AS model,
        CAST(p_partkey % 40 AS INT) AS batch, CAST(p_partkey % 200 AS INT) AS idea, CAST(p_size * 37 AS BIGINT) AS prompt_tokens, CAST(p_size * 11 AS BIGINT) AS completion_tokens
    FROM (SELECT *, {_FIELD} AS f FROM {{part}}) AS p) AS c
"""
_CDB = _CAT.format(part="part")


def catalogue(spark, sf_dir) -> DataFrame:
    doubles = "is_ic", "is_icir", "is_tstat", "is_sharpe", "turnover", "coverage"
    out = both(spark, sf_dir, _CAT, "part").withColumns({c: F.col(c).cast("double") for c in doubles})
    return out.withColumn("hash", text.expr_hash(F.concat_ws("|", "expression", "id")))


_HASH = "substring(sha1(concat(expression, '|', id)), 1, 16)"


@query("s12_read_run_json", "SELECT o_orderpriority AS source, count(*) AS n_runs, sum(o_orderkey % 100)::BIGINT AS n_survivors FROM orders GROUP BY 1")
def read_run_json(spark, sf_dir):
    path, source = scratch(spark, "runs"), F.col("params.source")
    summaries = _runs(spark, sf_dir)
    writers.write_documents(summaries.select(F.to_json(F.struct("params", "n_survivors", "factory", "portfolio")).alias("run")), "run", path)
    read = readers.read_run_json(spark, f"{path}/*.txt", summaries.schema)
    return read.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("n_survivors").alias("n_survivors"))


_IDEA = "SELECT p_partkey, p_size, p_brand, p_partkey % 10 = 3 AS torn, p_partkey % 11 = 5 AS bare FROM {part}"


@query("s12_read_idea_lines", """SELECT source, count(*) FILTER (NOT torn) AS n_good, count(*) FILTER (torn) AS n_bad, coalesce(sum(CASE WHEN torn OR bare THEN 0 ELSE 1 + p_size % 3 END), 0)::BIGINT AS n_expressions,
    coalesce(sum(CASE WHEN torn OR bare THEN 0 ELSE (1 + p_size % 3) * round_even(p_size * 37 / (1 + p_size % 3), 0) END), 0)::BIGINT AS prompt_tokens
    FROM (SELECT *, CASE WHEN torn THEN '?' ELSE p_brand END AS source FROM (SELECT p_partkey, p_size, p_brand, p_partkey % 10 = 3 AS torn, p_partkey % 11 = 5 AS bare FROM part)) GROUP BY source""")
def read_idea_lines(spark, sf_dir):
    """Parts as idea batches: a line of JSON each, a tenth of them torn off as by a crash while writing, some without expressions."""
    path, p = scratch(spark, "ideas"), both(spark, sf_dir, _IDEA, "part")
    n = (F.col("p_size") % 3 + 1).cast("int")
    formulas = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("ts_mean_"), (5 * i).cast("string"), F.lit("(close)")))
    line = F.to_json(F.struct(F.concat(F.lit("idea "), F.col("p_partkey").cast("string")).alias("idea"), F.col("p_brand").alias("source"), F.when(F.col("bare"), F.array().cast("array<string>")).otherwise(formulas).alias("expressions"), (F.col("p_size") * 37).cast("bigint").alias("prompt_tokens"), (F.col("p_size") * 11).cast("bigint").alias("completion_tokens")))
    p.select(F.when(F.col("torn"), F.substring(line, 1, F.length(line) - 9)).otherwise(line).alias("value")).write.text(path)
    good, bad = readers.read_ideas(spark, path)
    per = readers.idea_expressions(good).groupBy("source").agg(F.count(F.lit(1)).alias("n_expressions"), F.sum("prompt_tokens").alias("prompt_tokens"))
    counted = good.groupBy("source").agg(F.count(F.lit(1)).alias("n_good")).join(per, "source", "left").withColumn("n_bad", F.lit(0).cast("bigint"))
    lost = bad.agg(F.count(F.lit(1)).alias("n_bad")).where("n_bad > 0").select(F.lit("?").alias("source"), F.lit(0).cast("bigint").alias("n_good"), "n_bad", *[F.lit(0).cast("bigint").alias(c) for c in ("n_expressions", "prompt_tokens")])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return counted.select("source", "n_good", "n_bad", zero("n_expressions"), zero("prompt_tokens")).unionByName(lost)


@query("s13_write_report_tables", f"SELECT concat('| ', status, ' | ', n, ' |') AS line FROM (SELECT status, count(*) AS n FROM ({_CDB}) GROUP BY 1) UNION ALL SELECT '| status | n |' UNION ALL SELECT '|---|---|'")
def write_report(spark, sf_dir):
    path = scratch(spark, "report")
    writers.write_report(catalogue(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n")), path, "markdown", "status")
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("s14_append_new", f"SELECT count(*) FILTER (status <> 'reject') AS n_new, count(*) FILTER (status = 'reject') AS n_dup FROM ({_CDB})")
def append_new(spark, sf_dir):
    path, cat = scratch(spark, "catalogue"), catalogue(spark, sf_dir)
    cat.where("status = 'reject'").write.parquet(path)
    new, dup = writers.append_new(path, cat)
    return spark.createDataFrame([(new, dup)], "n_new bigint, n_dup bigint")


@query("s14_append_counts", f"SELECT count(*) FILTER (status <> 'reject') AS n_new, count(*) FILTER (status = 'reject') AS n_dup FROM ({_CDB})")
def append_counts(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    return writers.append_counts(cat.where("status = 'reject'"), cat)


@query("s15_evolve_schema", f"SELECT id, NULL::DOUBLE AS is_max_drawdown, NULL::BIGINT AS depth FROM ({_CDB})")
def evolve(spark, sf_dir):
    return writers.evolve_schema(catalogue(spark, sf_dir)).select("id", "is_max_drawdown", "depth")


_PASS = "status = 'ok' AND abs(is_ic) >= 0.01 AND abs(is_tstat) >= 1 AND turnover <= 0.8 AND coverage >= 0.3"


@query("p07_catalogue_filter", f"SELECT id, {q6('is_ic')} AS is_ic FROM ({_CDB}) WHERE {_PASS}")
def catalogue_filter(spark, sf_dir):
    return runs.catalogue_filter(catalogue(spark, sf_dir), min_ic=0.01, min_tstat=1.0, max_turnover=0.8, min_coverage=0.3).select("id", r6("is_ic").alias("is_ic"))


@query("o02_sort_and_limit", f"SELECT id, {q6('is_tstat')} AS is_tstat FROM ({_CDB}) WHERE {_PASS} ORDER BY is_tstat DESC, {_HASH} LIMIT 25")
def sort_limit(spark, sf_dir):
    out = runs.catalogue_filter(catalogue(spark, sf_dir), min_ic=0.01, min_tstat=1.0, max_turnover=0.8, min_coverage=0.3, order_by="is_tstat", limit=25)
    return out.select("id", r6("is_tstat").alias("is_tstat"))


@query("o04_sort_coverage", f"SELECT id, {q6('coverage')} AS coverage FROM ({_CDB})")
def sort_coverage(spark, sf_dir):
    return catalogue(spark, sf_dir).orderBy(F.desc("coverage"), "id").select("id", r6("coverage").alias("coverage"))


@query("a19_operator_mix", f"SELECT count(*) FILTER (contains(expression, 'ts_')) AS n_ts, count(*) AS n_ok, (SELECT count(DISTINCT o) FROM (SELECT unnest(regexp_extract_all(expression, '([a-z_0-9]+)\\(', 1)) AS o FROM ({_CDB}) WHERE status = 'ok')) AS n_operators FROM ({_CDB}) WHERE status = 'ok'")
def operator_mix(spark, sf_dir):
    return diversity.operator_mix(catalogue(spark, sf_dir))


@query("a20_catalogue_stats", f"SELECT status, count(*) AS n FROM ({_CDB}) GROUP BY ROLLUP (status)")
def catalogue_stats(spark, sf_dir):
    return runs.catalogue_stats(catalogue(spark, sf_dir))


_COST = "prompt_tokens / 1e6 * CASE model WHEN 'small' THEN 0.25 WHEN 'large' THEN 0.75 ELSE 5.0 END + completion_tokens / 1e6 * CASE model WHEN 'small' THEN 0.4 WHEN 'large' THEN 4.5 ELSE 30.0 END"


def costed(spark, sf_dir) -> DataFrame:
    prices = spark.createDataFrame([("small", 0.25, 0.4), ("large", 0.75, 4.5)], "model string, prompt_price double, completion_price double")
    return runs.token_cost(catalogue(spark, sf_dir), prices)


@query("a21_reject_funnel", f"""SELECT count(DISTINCT idea) AS ideas, count(DISTINCT batch) AS batches, count(*) FILTER (status <> 'duplicate') AS evaluated, count(*) FILTER (status = 'ok') AS stored, count(*) FILTER (status = 'duplicate') AS dup,
    count(*) FILTER (status = 'reject' AND reason = 'sparse') AS reject_sparse, count(*) FILTER (status = 'reject' AND reason = 'constant') AS reject_constant, sum(prompt_tokens + completion_tokens)::BIGINT AS tokens,
    {q6(f"sum({_COST})")} AS cost, {q6(f"sum({_COST}) / count(*) FILTER (status = 'ok')")} AS cost_per_stored FROM ({_CDB})""")
def reject_funnel(spark, sf_dir):
    rows = costed(spark, sf_dir).withColumn("tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    return runs.reject_funnel(rows, ["sparse", "constant"]).withColumns({c: r6(c) for c in ("cost", "cost_per_stored")})


@query("a22_token_cost", f"SELECT id, {q6(_COST)} AS cost FROM ({_CDB})")
def token_cost(spark, sf_dir):
    return costed(spark, sf_dir).select("id", r6("cost").alias("cost"))


@query("a23_per_expression_tokens", f"SELECT batch, round_even(sum(prompt_tokens) / greatest(1, count(*)), 0)::BIGINT AS tokens FROM ({_CDB}) GROUP BY batch")
def per_expression(spark, sf_dir):
    batches = catalogue(spark, sf_dir).groupBy("batch").agg(F.sum("prompt_tokens").alias("t"), F.collect_list("expression").alias("e"))
    return batches.select("batch", runs.per_expression_tokens(F.col("t"), F.col("e")).alias("tokens"))


def _runs(spark, sf_dir) -> DataFrame:
    """Orders as run summaries: rows of two methods, or only a best row, or neither."""
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    row = lambda method, x: F.struct(F.lit(method).alias("method"), (p / x).alias("sharpe"), (p / x / 100).alias("ic"), (p / x / 10).alias("annual_return"))
    rows = F.when(k % 3 != 0, F.array(row("orthogonalized", 1e5), row("equal", 2e5))).otherwise(F.array(row("orthogonalized", 1e5)))
    return table(spark, sf_dir, "orders").select(
        F.struct(F.col("o_orderpriority").alias("source")).alias("params"),
        (k % 100).alias("n_survivors"),
        F.struct((p / 1e6).alias("est_cost_usd")).alias("factory"),
        F.struct(rows.alias("rows"), F.when(k % 4 != 0, row("orthogonalized", 1e5)).alias("best")).alias("portfolio"),
    )


@query("a24_compare_sources", f"""WITH h AS (SELECT o_orderpriority AS source, o_totalprice / CASE WHEN o_orderkey % 3 <> 0 THEN 2e5 ELSE 1e5 END AS s, o_orderkey % 100 AS n, o_totalprice / 1e6 AS c FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 4 <> 0)
    SELECT source, count(*) AS n_runs, {q6("avg(s)")} AS sharpe_mean, {q6("stddev_pop(s)")} AS sharpe_std, {q6("avg(s / 100)")} AS ic_mean, {q6("stddev_pop(s / 100)")} AS ic_std, {q6("avg(s / 10)")} AS annual_return_mean, {q6("avg(n)")} AS n_survivors_mean, {q6("avg(c)")} AS cost_mean FROM h GROUP BY source""")
def compare_sources(spark, sf_dir):
    out = runs.compare_sources(runs.headline_rows(_runs(spark, sf_dir)))
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("source", "n_runs")})


_NAMES = "list_filter(regexp_extract_all(expression, '[A-Za-z_][A-Za-z_0-9]*\\(?'), lambda x: NOT contains(x, '('))"


@query("a28_terminal_exposure", f"""WITH s AS (SELECT expression FROM ({_CDB}) WHERE status = 'ok'), u AS (SELECT unnest(list_distinct({_NAMES})) AS field FROM s), n AS (SELECT count(*) AS n FROM s),
    o AS (SELECT f AS field, count(*) AS offered FROM (SELECT DISTINCT idea, {_FIELD.replace("p_partkey", "id")} AS f FROM ({_CDB})) GROUP BY 1), k AS (SELECT field, count(*) AS used FROM u GROUP BY 1)
    SELECT field, coalesce(offered, 0) AS offered, coalesce(used, 0) AS used, {q6("coalesce(used, 0) / (SELECT n FROM n)")} AS share FROM o FULL JOIN k USING (field)""")
def terminal_exposure(spark, sf_dir):
    cat = catalogue(spark, sf_dir)
    field = F.expr(_FIELD.replace("p_partkey", "id"))
    menu = cat.select("idea", field.alias("f")).groupBy("idea").agg(F.collect_set("f").alias("terminals"))
    return diversity.terminal_exposure(cat.where("status = 'ok'"), menu).withColumn("share", r6("share"))


@query("a29_rates", f"SELECT {q6('''avg((is_ic < 0)::INT) FILTER (status = 'ok')''')} AS flip_rate, {q6('''avg((status = 'ok')::INT)''')} AS valid_rate, {q6('''avg((status = 'duplicate')::INT)''')} AS duplicate_rate FROM ({_CDB})")
def rates(spark, sf_dir):
    out = diversity.catalogue_rates(catalogue(spark, sf_dir))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("u04_merge_catalogues", f"SELECT id, CASE WHEN status = 'reject' THEN 2 ELSE 1 END AS run FROM ({_CDB})")
def merge_catalogues(spark, sf_dir):
    cat = catalogue(spark, sf_dir).select("id", "hash", "status")
    out = writers.merge_catalogues(cat.withColumn("run", F.lit(1)), cat.where("status = 'reject'").withColumn("run", F.lit(2)), "hash", "run")
    return out.select("id", "run")


_RAW = "SELECT p_partkey AS id, concat(CASE CAST(p_size % 6 AS INT) WHEN 0 THEN 'rank(delta(' WHEN 1 THEN 'zscore(mean(' WHEN 2 THEN 'cs_rank(ts_std(' WHEN 3 THEN 'log(abs(' WHEN 4 THEN 'neg(correlation(' ELSE 'abs(div(' END, 'close, ', CAST(p_size AS INT), '))') AS expression FROM {part}"
_ALIAS = "expression"
for _a, _b in text.ALIASES.items():
    _ALIAS = f"regexp_replace({_ALIAS}, '(^|[^A-Za-z0-9_]){_a}\\(', '\\1{_b}(', 'g')"
_ALIAS = f"regexp_replace(replace({_ALIAS}, 'correlation(', 'ts_corr_20('), '(^|[^A-Za-z0-9_])corr\\(', '\\1ts_corr_20(', 'g')"


@query("t01_normalize_alias", f"SELECT id, {_ALIAS} AS expression FROM ({_RAW.format(part='part')})")
def normalize_alias(spark, sf_dir):
    return both(spark, sf_dir, _RAW, "part").select("id", text.normalize_alias(F.col("expression")).alias("expression"))


_CURRIED = _ALIAS
for _ in range(4):  # as deep as the formulas of the table are
    for _a, _b in text.curry_rules():
        _b = _b.replace("$", "\\")
        _CURRIED = f"regexp_replace({_CURRIED}, '{_a}', '{_b}', 'g')"
_CURRIED = f"translate({_CURRIED}, '{text.OPENED}{text.CLOSED}', '()')"
for _op, _w in [*text.DEFAULT_WINDOWS.items()] * 2:  # a match takes the character before it, so calls side by side need a second pass
    _CURRIED = f"regexp_replace({_CURRIED}, '(^|[^A-Za-z0-9_]){_op}\\(([^0-9]|$)', '\\1{_op}_{_w}(\\2', 'g')"


@query("t02_curry_windows", f"SELECT id, {_CURRIED} AS expression FROM ({_RAW.format(part='part')})")
def curry_windows(spark, sf_dir):
    return both(spark, sf_dir, _RAW, "part").select("id", text.normalize_expression(F.col("expression")).alias("expression"))


@query("t03_expr_hash", f"SELECT id, substring(sha1(CASE WHEN status = 'ok' THEN expression ELSE concat('reject:', expression) END), 1, 16) AS hash FROM ({_CDB})")
def expr_hash(spark, sf_dir):
    return catalogue(spark, sf_dir).select("id", text.expr_hash(F.col("expression"), F.col("status")).alias("hash"))


_OPENED = "list_transform(range(1, length(expression) + 1), lambda i: length(replace(expression[1:i], ')', '')) - length(replace(expression[1:i], '(', '')))"
_DEPTH = f"coalesce(list_max({_OPENED}), 0)::INT"


@query("t04_expr_structure", f"SELECT id, len({_NAMES})::INT AS n_terminals, greatest({_DEPTH}, 0) AS depth FROM ({_CDB})")
def expr_structure(spark, sf_dir):
    e = F.col("expression")
    return catalogue(spark, sf_dir).select("id", text.n_terminals(e).alias("n_terminals"), text.depth(e).alias("depth"))


@query("t05_structural_reject", f"""SELECT id, CASE WHEN trim(expression) = '' THEN 'empty' WHEN len({_NAMES}) < 1 THEN 'no_terminals' WHEN {_DEPTH} > 20 THEN 'too_deep'
    WHEN expression LIKE 'sub(%' AND split_part(expression[5:length(expression) - 1], ', ', 1) = split_part(expression[5:length(expression) - 1], ', ', 2) THEN 'degenerate' WHEN contains(expression, 'sign(abs_val(') THEN 'degenerate' END AS reason FROM ({_CDB})""")
def structural_reject(spark, sf_dir):
    return catalogue(spark, sf_dir).select("id", text.structural_reject(F.col("expression")).alias("reason"))


#: Formulas whose first call has two arguments, which are calls of two arguments themselves and equal in some rows.
_PAIR = "concat(CASE CAST({k} % 3 AS INT) WHEN 0 THEN 'add(' WHEN 1 THEN 'ts_cov_20(' ELSE 'mul(' END, {x}, ', ts_mean_5(', {y}, '))')"
_FIELDS = "CASE CAST({k} % 3 AS INT) WHEN 0 THEN 'close' WHEN 1 THEN 'volume' ELSE 'open' END"
_OUTER = "CASE CAST(p_size % 4 AS INT) WHEN 0 THEN 'sub' WHEN 1 THEN 'safe_div' WHEN 2 THEN 'ts_corr_20' ELSE 'mul' END"
_LEFT = _PAIR.format(k="p_partkey", x=_FIELDS.format(k="p_partkey"), y=_FIELDS.format(k="p_size"))
_RIGHT = _PAIR.format(k="p_size", x=_FIELDS.format(k="p_size"), y=_FIELDS.format(k="p_partkey"))
_NESTED = f"SELECT p_partkey AS id, {_OUTER} AS outer_name, {_LEFT} AS x, {_RIGHT} AS y FROM {{part}}"


@query("t05_equal_subtrees", f"SELECT id, CASE WHEN outer_name <> 'mul' AND x = y THEN 'degenerate' END AS reason FROM ({_NESTED.format(part='part')})")
def equal_subtrees(spark, sf_dir):
    whole = F.concat(F.lit("neg(cs_rank("), "outer_name", F.lit("("), "x", F.lit(" , "), F.regexp_replace("y", ", ", ",   "), F.lit(")))"))
    return both(spark, sf_dir, _NESTED, "part").select("id", text.structural_reject(whole).alias("reason"))


@query("t06_dedup_expressions", f"SELECT id, row_number() OVER (PARTITION BY expression ORDER BY id) > 1 AS is_duplicate FROM ({_CDB})")
def dedup(spark, sf_dir):
    return text.dedup_expressions(catalogue(spark, sf_dir), "id", "expression").select("id", "is_duplicate")


@query("t07_sanitize_name", "SELECT p_partkey AS id, concat('osap_', lower(trim(regexp_replace(p_name, '[^0-9a-zA-Z]+', '_', 'g'), '_'))) AS name FROM part")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), asof.sanitize_name(F.col("p_name")).alias("name"))


_SAID = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('Sure:', chr(10), '```json', chr(10), props, chr(10), '```', chr(10), 'Done') WHEN 2 THEN concat('I think [', props, '] fits') ELSE 'no json {here' END"
_BODY = "trim(CASE WHEN contains(said, '```json') THEN regexp_extract(said, '```json(.*?)```', 1, 's') ELSE said END, concat(' ', chr(9), chr(10), chr(13)))"


@query("t08_extract_json_payload", f"""SELECT event_id, coalesce(CASE WHEN json_valid(body) THEN body END, CASE WHEN json_valid(listed) THEN listed END, CASE WHEN json_valid(one) THEN one END) AS payload
    FROM (SELECT event_id, body, nullif(regexp_extract(body, '(\\[.*\\])', 1, 's'), '') AS listed, nullif(regexp_extract(body, '(\\{{.*\\}})', 1, 's'), '') AS one FROM (SELECT event_id, {_BODY} AS body FROM (SELECT event_id, {_SAID} AS said FROM events)))""")
def extract_json(spark, sf_dir):
    k, props = F.col("event_id") % 4, F.col("props")
    said = F.when(k == 0, props).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nDone"))).when(k == 2, F.concat(F.lit("I think ["), props, F.lit("] fits"))).otherwise("no json {here")
    return table(spark, sf_dir, "events").select("event_id", text.extract_json_payload(said).alias("payload"))


@query("t09_coerce", """SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 0 ELSE greatest(0, least(5, p_size - 20)) END::INT AS score, list_filter([trim(p_brand), ''], lambda x: x <> '') AS names,
    CASE WHEN trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'item' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM part""")
def coerce(spark, sf_dir):
    raw = F.when(F.col("p_size") % 4 == 0, "many").otherwise(F.concat(F.lit(" "), (F.col("p_size") - 20).cast("string")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.coerce_score(raw).alias("score"), text.coerce_list(F.array(F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.lit(None))).alias("names"), text.slugify(F.col("p_name")).alias("slug"))


@query("t10_metric_sentence", f"""SELECT id, printf('%s: %s %s signal, mean IC %.4f, ICIR %.4f; long-short Sharpe %.2f, %.2f%% a year, drawdown %.2f%%', expression, CASE WHEN abs(is_ic) > 0.03 THEN 'strong' WHEN abs(is_ic) > 0.01 THEN 'moderate' ELSE 'weak' END,
    CASE WHEN is_ic > 0 THEN 'positive' ELSE 'negative' END, is_ic + 1e-9, is_icir + 1e-9, is_sharpe + 1e-9, (turnover + 1e-9) * 100, (coverage + 1e-9) * 100) AS line FROM ({_CDB}) WHERE is_ic IS NOT NULL""")
def metric_sentence(spark, sf_dir):
    c = lambda n: F.col(n) + 1e-9  # noqa: E731  so that no figure lies on a rounding edge
    rows = catalogue(spark, sf_dir).where("is_ic IS NOT NULL")
    return rows.select("id", text.metric_sentence(F.col("expression"), c("is_ic"), c("is_icir"), c("is_sharpe"), c("turnover"), c("coverage")).alias("line"))


@query("t11_sweep_candidates", "SELECT concat(op, '_', w, '(', f, ')') AS expression FROM (VALUES ('ts_mean', 5), ('ts_mean', 10), ('ts_mean', 20), ('ts_mean', 60), ('ts_skew', 60)) o(op, w), (SELECT DISTINCT o_orderpriority AS f FROM orders)")
def sweep(spark, sf_dir):
    fields = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field")).distinct()
    return text.sweep_candidates(spark, fields, ["ts_mean", "ts_skew"])
