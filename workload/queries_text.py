"""Text and expression queries (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.functions import numeric as N
from pairforge.functions import text as X
from pairforge.functions.chunking import chunks
from pairforge.operators import prompts as Q
from pairforge.operators import report as T
from pairforge.operators.scaling import spread
from workload.registry import query, rounded
from workload.views import Views

TRIM = "trim({0}, e' \\t\\n\\r')"
LETTERS = """trim(regexp_replace(regexp_replace(lower(replace(replace(text, '''', ''), '’', '')),
  '[^a-z]', ' ', 'g'), ' +', ' ', 'g'))"""


def _hashed(key: str, value):
    return F.col(key), F.md5(value.cast("binary")).alias("digest"), F.length(value).alias("n_chars")


@query(
    "P1_text_key",
    f"""select doc_id, md5(k) as digest, length(k) as n_chars from (select doc_id,
      regexp_replace({TRIM.format("lower(text)")}, '\\s+', ' ', 'g') as k from documents)""",
)
def text_key(v: Views):
    return v.table("documents").select(*_hashed("doc_id", X.text_key(F.col("text"))))


RAW_SQL = """(select conv_id, turn, case when turn % 2 = 0 then ' USER: ' || text || ' ASSISTANT: '
  || role || ' ASSISTANT: ' || text || '  ' else text end as raw from conversations)"""


def _raw(v: Views):
    wrapped = F.concat(
        F.lit(" USER: "), "text", F.lit(" ASSISTANT: "), "role", F.lit(" ASSISTANT: "), "text", F.lit("  ")
    )
    raw = F.when(F.col("turn") % 2 == 0, wrapped).otherwise(F.col("text"))
    return v.table("conversations").select("conv_id", "turn", raw.alias("raw"))


@query(
    "P2_after_first_marker",
    f"""select conv_id, turn, case when contains(s, 'ASSISTANT:') then
        {TRIM.format("substr(s, instr(s, 'ASSISTANT:') + 10)")} else s end as value
      from (select conv_id, turn, {TRIM.format("raw")} as s from {RAW_SQL})""",
)
def after_first_marker(v: Views):
    return _raw(v).select("conv_id", "turn", X.after_first_marker(F.col("raw")).alias("value"))


@query(
    "P3_after_last_marker",
    f"""select conv_id, turn, {TRIM.format("string_split(raw, 'ASSISTANT:')[-1]")} as value
      from {RAW_SQL}""",
)
def after_last_marker(v: Views):
    return _raw(v).select("conv_id", "turn", X.after_last_marker(F.col("raw")).alias("value"))


@query(
    "P4_clean_completion",
    f"""with raw as (select conv_id, turn, case turn % 4 when 0 then ' ASSISTANT : ' || text
          when 1 then text when 2 then 'user:' || text || ' USER: again' else ' user:  ' end as raw
        from conversations),
      cut as (select conv_id, turn, regexp_replace(regexp_replace({TRIM.format("raw")},
          '^\\s*(?:ASSISTANT|assistant)\\s*:\\s*', ''), '^\\s*(?:USER|user)\\s*:\\s*', '') as value
        from raw)
      select conv_id, turn, value, case when value = '' then 'empty'
        when contains(value, 'USER:') or contains(value, 'ASSISTANT:') then 'marker'
        else 'ok' end as status from cut""",
)
def clean_completion(v: Views):
    turn = F.col("turn") % 4
    raw = (
        F.when(turn == 0, F.concat(F.lit(" ASSISTANT : "), "text"))
        .when(turn == 1, F.col("text"))
        .when(turn == 2, F.concat(F.lit("user:"), "text", F.lit(" USER: again")))
        .otherwise(" user:  ")
    )
    value, status = X.clean_completion(raw)
    return v.table("conversations").select(
        "conv_id", "turn", value.alias("value"), status.alias("status")
    )


@query("P5_letters_only", f"select doc_id, md5(k) as digest, length(k) as n_chars from (select doc_id, {LETTERS} as k from documents)")
def letters_only(v: Views):
    return v.table("documents").select(*_hashed("doc_id", X.letters_only(F.col("text"))))


@query(
    "P6_collapse_whitespace",
    f"""select doc_id, md5(k) as digest, length(k) as n_chars from (select doc_id,
      regexp_replace({TRIM.format("text")}, '\\s+', ' ', 'g') as k from documents)""",
)
def collapse(v: Views):
    value = X.clean_sentence(F.col("text"), letters=False)
    return v.table("documents").select(*_hashed("doc_id", value))


@query(
    "P7_route_name",
    """select route, count(*) as n from (select case
        when value in ('chosen', 'chosen_prompt') then 'chosen_prompt'
        when value in ('rejected', 'rejected_prompt') then 'rejected_prompt' end as route
      from (select coalesce(case ordinal % 3 when 0 then 'rejected_prompt' when 1 then null
        else case when ordinal % 2 = 0 then 'other' else 'chosen' end end, prompt_route) as value
      from candidate_keys)) group by route""",
)
def route_name(v: Views):
    k = F.col("ordinal")
    given = F.when(k % 3 == 0, "rejected_prompt").when(
        k % 3 == 2, F.when(k % 2 == 0, "other").otherwise("chosen")
    )
    route = X.route_name(given, F.col("prompt_route"))
    return v.candidate_keys.groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P8_role_name",
    """select translate(lower(trim('  ' || upper(event_type) || '-Eval Set ')), '- ', '__') as role,
      count(*) as n from events group by role""",
)
def role_name(v: Views):
    raw = F.concat(F.lit("  "), F.upper("event_type"), F.lit("-Eval Set "))
    return v.table("events").groupBy(X.role_name(raw).alias("role")).agg(
        F.count(F.lit(1)).alias("n")
    )


TEMPLATES = [
    (1, "rewrite", "Rewrite for class one: {text} -- done."),
    (0, "rewrite", "Rewrite for class zero: {text}"),
    (1, "direct", "Write one text of class one."),
    (0, "direct", "Write one text of class zero."),
]


@query(
    "P9_render_prompt",
    f"""with t(label, route, template) as (values
          {", ".join(f"({a}, '{b}', '{c}')" for a, b, c in TEMPLATES)}),
        k as (select source_id, label, text1, unnest(['rewrite', 'direct', 'unknown']) as route
          from sources)
      select source_id, k.label, k.route, case when template is null then 'no_template' else 'ok'
          end as prompt_status, md5(replace(template, '{{text}}', {TRIM.format("text1")})) as digest
      from k left join t on t.label = k.label and t.route = k.route""",
)
def render_prompt(v: Views):
    templates = v.spark.createDataFrame(TEMPLATES, "label int, route string, template string")
    routes = F.explode(F.array(F.lit("rewrite"), F.lit("direct"), F.lit("unknown"))).alias("route")
    rows = v.sources.select("source_id", "label", "text1", routes)
    out = Q.render_prompts(rows, templates)
    return out.select(
        "source_id", "label", "route", "prompt_status", F.md5(F.col("prompt").cast("binary")).alias("digest")
    )


@query("P10_chunk_texts")
def chunk_texts(v: Views):
    pieces = F.posexplode(chunks(F.col("text"))).alias("chunk", "piece")
    return spread(v.table("documents").select("doc_id", "text")).select("doc_id", pieces)


@query(
    "P11_token_counts",
    """with t as (select doc_id, regexp_extract_all(text,
          '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_\\s]') as tokens from documents)
      select doc_id, len(tokens)::int as n_tokens, len(list_filter(tokens,
        lambda t: regexp_full_match(t, '[\\p{L}\\p{M}\\p{N}_]+')))::int as n_words from t""",
)
def token_counts(v: Views):
    out = v.table("documents").select("doc_id", X.tokens(F.col("text")).alias("tokens"))
    return out.select(
        "doc_id", F.size("tokens").alias("n_tokens"), X.word_count(F.col("tokens")).alias("n_words")
    )


@query(
    "P12_guarded_ratio",
    """select user_id, r6(sum(value) filter (event_type = 'error') / nullif(
      sum(value) filter (event_type = 'click' and value > 60), 0)) as ratio
      from events group by user_id""",
)
def guarded_ratio(v: Views):
    def total(condition):
        return F.sum(F.when(condition, F.col("value")))

    kind = F.col("event_type")
    ratio = N.ratio(total(kind == "error"), total((kind == "click") & (F.col("value") > 60)))
    return rounded(v.table("events").groupBy("user_id").agg(ratio.alias("ratio")))


@query(
    "P13_number_or_default",
    """select event_id, coalesce(try_cast(case when event_id % 3 = 0 then event_type
      else substr(props, 7, length(props) - 7) end as double), -1.0) as number from events""",
)
def number_or_default(v: Views):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(
        F.expr("substr(props, 7, length(props) - 7)")
    )
    return v.table("events").select("event_id", N.number_or(raw, -1.0).alias("number"))


ALIASES = [("click", "tap"), ("view", "look"), ("error", "fault")]
DISPLAY = [("tap", "Tap"), ("fault", "Fault!")]


@query(
    "P14_relabel",
    f"""with a(alias, canonical) as (values {", ".join(map(str, ALIASES))}),
        d(canonical, label) as (values {", ".join(map(str, DISPLAY))})
      select event_type, coalesce(a.canonical, event_type) as canonical,
        coalesce(d.label, a.canonical, event_type) as label, count(*) as n
      from events left join a on a.alias = event_type
      left join d on d.canonical = coalesce(a.canonical, event_type) group by all""",
)
def relabel(v: Views):
    aliases = v.spark.createDataFrame(ALIASES, "alias string, canonical string")
    display = v.spark.createDataFrame(DISPLAY, "canonical string, label string")
    out = T.relabel(v.table("events"), "event_type", aliases, display)
    return out.groupBy("event_type", "canonical", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "P15_report_cells",
    """select user_id, case when m is null then '--' else printf('%.1f ± %.1f', m * 100, s * 100)
        end as mean_sd, case when lo is null or hi is null then '--'
        else printf('%.1f–%.1f', lo * 100, hi * 100) end as low_high,
      case when m is null then '--' else printf('%.1f [%.1f, %.1f]', m * 100, lo * 100, hi * 100)
        end as interval_cell
      from (select user_id, avg(value) filter (value > 3) / 7 as m, stddev_pop(value) / 7 as s,
        min(value) filter (value > 3) / 7 as lo, max(value) filter (value > 3) / 7 as hi
        from events group by user_id)""",
)
def report_cells(v: Views):
    big = F.when(F.col("value") > 3, F.col("value"))
    stats = v.table("events").groupBy("user_id").agg(
        (F.avg(big) / 7).alias("m"),
        (F.stddev_pop("value") / 7).alias("s"),
        (F.min(big) / 7).alias("lo"),
        (F.max(big) / 7).alias("hi"),
    )
    m, s, lo, hi = (F.col(c) for c in ("m", "s", "lo", "hi"))
    return stats.select(
        "user_id",
        N.mean_sd_cell(m, s).alias("mean_sd"),
        N.range_cell(lo, hi).alias("low_high"),
        N.interval_cell(m, lo, hi).alias("interval_cell"),
    )


@query(
    "P16_rule_scan",
    """with found as (select 'absolute_path' as rule from documents where regexp_matches(text,
          '(?i)(?:/home/[^/\\s"'']+/|[a-z]:[\\\\/]users[\\\\/])')
        union all select 'credential_literal' from documents where regexp_matches(text,
          '(?i)(?:api[_-]?key|access[_-]?token|secret|password)\\s*=\\s*["''][^"'']+["'']')
        union all select 'token_literal' from documents
          where regexp_matches(text, 'token\\s*=\\s*"[^"]+"')
        union all select 'address' from documents
          where regexp_matches(text, '[a-z0-9]+@[a-z0-9]+'))
      select case rule when 'address' then 'WARNING' else 'ERROR' end as severity, rule,
        count(*) as n from found group by all""",
)
def rule_scan(v: Views):
    rules = {
        **Q.RULES,
        "token_literal": ("ERROR", r"token\s*=\s*\"[^\"]+\""),
        "address": ("WARNING", "[a-z0-9]+@[a-z0-9]+"),
    }
    return Q.severity_totals(Q.rule_scan(v.table("documents"), "doc_id", "text", rules))


@query(
    "P17_quality_regions",
    """with f as (select method, seed, avg(residual_cos) as x, avg(yz_violation_score) as y
        from audit group by method, seed), m as (select median(x) as mx, median(y) as my from f)
      select method, seed, r6(x) as residual_mean, r6(y) as violation_mean,
        r6(mx) as x_boundary, r6(my) as y_boundary, case when x < mx then 'low' else 'high' end
          || '_' || case when y < my then 'low' else 'high' end as region from f, m""",
)
def quality_regions(v: Views):
    files = v.audit.groupBy("method", "seed").agg(
        F.avg("residual_cos").alias("residual_mean"),
        F.avg("yz_violation_score").alias("violation_mean"),
    )
    return rounded(Q.quality_regions(files, "residual_mean", "violation_mean"))


