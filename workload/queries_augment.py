"""Augmentation (G), selection and export queries (R11, R13-R15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairforge.operators import augment as G
from pairforge.operators import selection as S
from pairforge.operators.preference import preference_records
from pairforge.plans.pairing import build_pairs
from pairforge.settings import DeletionSettings, TokenEditSettings
from workload.registry import query, rounded
from workload.views import Views

WORDS_SQL = """(select source_id, label, list_filter(string_split(trim(regexp_replace(
  regexp_replace(lower(replace(replace(text1, '''', ''), '’', '')), '[^a-z]', ' ', 'g'), ' +', ' ',
  'g')), ' '), lambda w: w <> '') as words from sources)"""
SYN_SQL = """(select word, list(s order by s) as synonyms from (select distinct word,
  trim(regexp_replace(regexp_replace(lower(translate(lemma, '_-', '  ')), '[^a-z ]', '', 'g'),
    ' +', ' ', 'g')) as s from lemmas) where s <> '' and s <> word group by word)"""
SEED = 7


def _digest(column):
    return F.md5(column.cast("binary"))


def _variants(v: Views, technique: str):
    variants = G.edit_variants(v.sources, [SEED], TokenEditSettings())
    return variants.where((F.col("technique") == technique) & (F.size("words") > 0))


def _out(df):
    text = F.array_join("words", " ")
    return df.select("source_id", F.size("words").alias("n_words"), _digest(text).alias("digest"))


@query("G10_clean_synonyms", f"select word, array_to_string(synonyms, ',') as synonyms from {SYN_SQL}")
def clean_synonyms(v: Views):
    return G.clean_synonyms(v.lemmas).select("word", F.array_join("synonyms", ",").alias("synonyms"))


@query(
    "G1_synonym_replacement",
    f"""with w as materialized (select *, greatest(1, floor(0.1::double * len(words))::int) as n
          from {WORDS_SQL} where len(words) > 0),
      cand as (select source_id, n, word, synonyms,
          h('word:{SEED}:' || source_id || ':replace:0:' || word) as o,
          synonyms[h('pick:{SEED}:' || source_id || ':replace:0:' || word) % len(synonyms) + 1] as new
        from (select source_id, n, unnest(list_distinct(words)) as word from w)
        join {SYN_SQL} using (word)),
      edits as (select source_id, word, new from (select *, row_number() over (
          partition by source_id order by o, word) as k from cand) where k <= n),
      toks as (select source_id, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
      final as (select source_id, pos, coalesce(e.new, t.word) as word
        from toks t left join edits e using (source_id, word))
      select source_id, count(*)::int as n_words, md5(string_agg(word, ' ' order by pos)) as digest
      from final group by source_id""",
)
def synonym_replacement(v: Views):
    return _out(G.replace_synonyms(_variants(v, "replace"), G.clean_synonyms(v.lemmas)))


@query("G2_random_insertion")
def random_insertion(v: Views):
    return _out(G.insert_synonyms(_variants(v, "insert"), G.clean_synonyms(v.lemmas)))


@query("G3_random_swap")
def random_swap(v: Views):
    return _out(G.swap_words(_variants(v, "swap")))


@query(
    "G4_random_deletion",
    f"""with kept as (select source_id, words, list_filter(words, lambda w, i:
          hexd('delete:{SEED}:' || source_id || ':delete:0', i) > '19999999') as k
        from {WORDS_SQL} where len(words) > 0),
      out as (select source_id, case when len(words) <= 1 then words when len(k) = 0 then
          [words[h('spare:{SEED}:' || source_id || ':delete:0') % len(words) + 1]] else k end as o
        from kept)
      select source_id, len(o)::int as n_words, md5(array_to_string(o, ' ')) as digest from out""",
)
def random_deletion(v: Views):
    return _out(G.delete_words(_variants(v, "delete"), 0.1))


@query("G5_variant_set")
def variant_set(v: Views):
    texts = G.edited_texts(v.sources, G.clean_synonyms(v.lemmas), [SEED])
    return texts.select("source_id", "technique", "copy", "label", _digest(F.col("text")).alias("digest"))


@query("G6_training_table")
def training_table(v: Views):
    table = G.training_table(v.sources, G.clean_synonyms(v.lemmas), [7, 8])
    return table.select(
        "source_id", "seed", "aug_index", "is_original", "label", "num_aug", _digest(F.col("text1")).alias("digest")
    )


SPLIT_SQL = """list_filter(string_split(regexp_replace(trim(text1, e' \\t\\n\\r'), '\\s+', ' ', 'g'),
  ' '), lambda w: w <> '')"""


@query(
    "G7_deletion_text",
    f"""with k as (select source_id, words, list_filter(words, lambda w, i:
          hexd('11:' || source_id, i) >= '4ccccccd') as kept
        from (select source_id, {SPLIT_SQL} as words from sources))
      select source_id, md5(case when len(kept) = 0 then
          words[h('spare:11:' || source_id) % len(words) + 1] else array_to_string(kept, ' ') end)
        as digest from k""",
)
def deletion_text(v: Views):
    from pairforge.functions.text import words

    text = G.deletion_text(words(F.col("text1")), 0.3, False, 11, F.col("source_id"))
    return v.sources.select("source_id", _digest(text).alias("digest"))


@query(
    "G8_deletion_negatives",
    f"""select source_id, repeat::int as repeat, label, n::int as n, md5(array_to_string(list_filter(
        words, lambda w, i: hexd('{SEED}:' || source_id || ':' || repeat || ':' || n, i) >= '4ccccccd'), ' ')) as digest
      from (select source_id, label, {SPLIT_SQL} as words from sources), range(0, 3) a(repeat),
        range(0, 3) b(n)""",
)
def deletion_negatives(v: Views):
    records = G.deletion_negatives(v.sources, SEED, DeletionSettings())
    return records.select(
        "source_id", "repeat", "label", F.posexplode("negative_texts").alias("n", "text")
    ).withColumn("digest", _digest(F.col("text"))).drop("text")


@query(
    "G9_training_assembly",
    """select origin, source_id, label, md5('5:' || origin || ':' || source_id || ':' || sample)
        as shuffle_key, md5(text1) as digest, sample from (
      select 'source' as origin, source_id, label, text1, 0::int as sample from sources
      union all select 'augmentation', source_id, label, lower(text1), k.i::int from sources,
        range(1, 3) k(i))""",
)
def training_assembly(v: Views):
    source = v.sources.withColumn("sample", F.lit(0))
    augmented = v.sources.withColumn("sample", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "text1", F.lower("text1")
    )
    table = G.assemble_training(
        source, augmented, "source_plus_augmentation", 5, ["source_id", "sample"]
    )
    return table.withColumn("digest", _digest(F.col("text1"))).drop("text1")


WORK_TEMPLATES = [
    (1, "rewrite", "One: {text}"),
    (0, "rewrite", "Zero: {text}"),
    (1, "direct", "Describe as one."),
    (0, "direct", "Describe as zero."),
]


@query(
    "G11_work_list",
    f"""with t(label, method, template) as (values {", ".join(map(str, WORK_TEMPLATES))})
      select source_id, s.label, t.method, generation_seed::int as generation_seed,
        sample_index::int as sample_index,
        md5(replace(template, '{{text}}', trim(text1, e' \\t\\n\\r'))) as digest
      from sources s join t on t.label = s.label, range(3, 5) a(generation_seed),
        range(0, 2) b(sample_index)""",
)
def work_list(v: Views):
    templates = v.spark.createDataFrame(WORK_TEMPLATES, "label int, method string, template string")
    jobs = G.work_list(v.sources, templates, ["rewrite", "direct"], [3, 4], 2)
    return jobs.select(
        "source_id",
        "label",
        "method",
        "generation_seed",
        "sample_index",
        _digest(F.col("prompt")).alias("digest"),
    )


TASKS = [(1, "Task one. {text}"), (0, "Task zero. {text}")]


@query(
    "R11_preference_records",
    f"""with t(label, template) as (values {", ".join(map(str, TASKS))})
      select p.source_id as train_id, p.pair_rank, 'ok' as status,
        md5('3:' || p.source_id || ':' || p.pair_rank) as shuffle_key,
        md5(replace(template, '{{text}}', trim(s.text1, e' \\t\\n\\r'))) as prompt,
        md5(trim(p.chosen_text, e' \\t\\n\\r')) as chosen,
        md5(trim(p.rejected_text, e' \\t\\n\\r')) as rejected
      from pairs p join sources s using (source_id) join t on t.label = p.label""",
)
def preference(v: Views):
    templates = v.spark.createDataFrame(TASKS, "label int, template string")
    records = preference_records(
        build_pairs(v.sources, v.scored(text=True), texts=v.candidate_texts), templates, 3, strict=False
    )

    def last_text(column: str):
        return F.md5(F.element_at(F.col(column)[0]["content"], -1)["text"].cast("binary"))

    return records.select(
        "train_id",
        "pair_rank",
        "status",
        "shuffle_key",
        *[last_text(c).alias(c) for c in ("prompt", "chosen", "rejected")],
    )


@query(
    "R13_best_checkpoint",
    """select checkpoint, epoch, accuracy, f1 from (select checkpoint, epoch,
        max(metric_value) filter (metric_name = 'accuracy') as accuracy,
        max(metric_value) filter (metric_name = 'f1') as f1
      from metric_rows group by checkpoint, epoch)
      order by accuracy desc, f1 desc, epoch, checkpoint desc limit 1""",
)
def best_checkpoint(v: Views):
    return S.select_checkpoint(v.metric_rows, "cv_validation", "accuracy", "f1")


@query("R14_selection_record")
def selection_record(v: Views):
    from pairforge.sources.files import content_digest

    digest = content_digest(v.spark, f"{v.sf_dir}/events.parquet")
    return S.selection_record(v.metric_rows, "cv_validation", "accuracy", None, digest)


@query(
    "R15_early_stop",
    """with hist as (select checkpoint, epoch,
          max(metric_value) filter (metric_name = 'accuracy') as accuracy,
          max(metric_value) filter (metric_name = 'f1') as f1
        from metric_rows group by checkpoint, epoch),
      m as (select *, row_number() over e as step, max(accuracy * 1000 + f1) over (e rows between
          unbounded preceding and 1 preceding) as best from hist
        window e as (partition by checkpoint order by epoch)),
      i as (select *, best is null or accuracy * 1000 + f1 > best as improved from m),
      l as (select *, step - max(case when improved then step end) over (partition by checkpoint
          order by epoch) as idle from i),
      s as (select *, coalesce(max((idle >= 2)::int) over (partition by checkpoint order by epoch
          rows between unbounded preceding and 1 preceding), 0) as stopped from l)
      select checkpoint, max(case when improved then epoch end) as best_epoch,
        count(*) as epochs_run, r6(max(accuracy)) as best_accuracy
      from s where stopped = 0 group by checkpoint""",
)
def early_stop(v: Views):
    history = S.wide_metrics(v.metric_rows, ["accuracy", "f1"])
    return rounded(S.early_stop(history, patience=2))
