"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm.decontaminate import find_contamination
from opsframe.llm.exact_dedup import copy_groups
from opsframe.llm.filter_audit import audit_filters
from opsframe.llm.html_text import extract_text, fit_labeller
from opsframe.llm.jaccard import jaccard_components
from opsframe.llm.langid import fit_language_model, identify_language
from opsframe.llm.mixing import fair_mix
from opsframe.llm.pii import find_pii
from opsframe.llm.quality import quality_rules
from opsframe.llm.resample import resample
from opsframe.llm.secret_scan import scan_secrets
from opsframe.llm.stages import small_batches
from opsframe.llm.token_counts import count_tokens
from opsframe.llm.toxicity import fit_neighbourhood, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def fold(modulus: int, rest: int, id_col: str = "doc_id") -> Column:
    """Whether a document's id falls into the given remainder of its checksum."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(4, 2))
    model = fit_language_model(docs, ~F.col("held_out"))
    return identify_language(docs, model, keep=("held_out",))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(5, 0))
    model = fit_neighbourhood(docs, table(spark, sf_dir, "labels"), ~fold(5, 0))
    return score_toxicity(docs, model, keep=("held_out",))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return count_tokens(table(spark, sf_dir, "documents"), f.read())


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_jaccard": op5_jaccard,
    "op6_decontaminate": op6_decontaminate,
    "op7_fair_mix": op7_fair_mix,
    "op8_page_text": op8_page_text,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_resample": op13_resample,
}

#: Words in SQL: runs of characters other than space and tab to carriage return.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: DuckDB SQL of those queries that SQL can express.  Verdicts of trained models, of corpus thresholds and of random
#: tests are in the rows of the other queries, whose base columns are tested against direct forms instead.
ORACLE_SQL: dict[str, str] = {
    "op5_jaccard": rf"""
with recursive words as (
    select doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents
), shingles as (
    select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i : i + 3], ' ') end as s
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from words where len(w) > 0)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id),
links as (
    select x, y from (
        select a.doc_id as x, b.doc_id as y, count(*) as both_have from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
    ) join sizes p on p.doc_id = x join sizes q on q.doc_id = y
    where 100 * both_have >= 85 * (p.n + q.n - both_have)
), reached as (
    select doc_id as node, doc_id as seen from documents
    union
    select y, seen from reached join links on x = node
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes s on s.doc_id = d.doc_id join (select node, min(seen) as component_id from reached group by node) on node = d.doc_id
""",
    "op7_fair_mix": rf"""
with sized as (
    select row_number() over () as r, doc_id, source, coalesce(len({_WORDS.format("text")}), 0) as size,
           cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '#7#' || md5(coalesce(text, ''))), 1, 15) as bigint) as place
    from documents
), sources as (
    select source, source_size, 1.0::double + (row_number() over (order by source asc nulls last) - 1) % 3 as weight, 3.0::double * source_size as cap, (sum(source_size) over ())::double as total
    from (select source, sum(size)::bigint as source_size from sized group by source)
), levels as (
    select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
              / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
    from sources
), targets as (
    select source, source_size, least(cap, coalesce((select arg_min(level, (cap / weight, source)) from levels where level * weight <= cap) * weight, cap)) as target from levels
), timed as (
    select r, doc_id, place, size, s.source_size, target,
           (sum(size) over (partition by s.source order by place, doc_id, size rows unbounded preceding))::bigint as cum
    from sized d join targets s on d.source is not distinct from s.source
), uses as (
    select r, place, doc_id, size, (e * source_size + cum)::double / target as finish from timed, range(3) t(e) where size > 0 and target > 0
), within as (
    select r, size from (select *, sum(size) over (order by finish, place, doc_id, size rows unbounded preceding) as upto from uses) where upto <= (select sum(size) from sized)
)
select doc_id, t.size::bigint as size, source_size, target, coalesce(taken, 0)::bigint as taken
from timed t left join (select r, sum(size) as taken from within group by r) w on w.r = t.r
""",
    "op11_exact_dedup": """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id, (count(*) over (partition by coalesce(text, '')))::bigint as group_size,
       row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents
""",
    "op12_filter_audit": rf"""
with judged as (
    select coalesce(lang, '') as part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad, [
        len(w) < 200,
        100 * len(list_distinct(w)) < 50 * len(w),
        100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
        regexp_matches(t, '[#$%&*|]'),
        coalesce(min(d.doc_id) over (partition by t) < d.doc_id, false)
    ] as fails
    from (select *, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents) d left join labels l on l.doc_id = d.doc_id
), letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
    select a.x || b.x || c.x || d.x || e.x as filter_order
    from letters a join letters b on b.x <> a.x join letters c on c.x not in (a.x, b.x) join letters d on d.x not in (a.x, b.x, c.x) join letters e on e.x not in (a.x, b.x, c.x, d.x)
), steps as (
    select filter_order, step::int as step, list_transform(string_split(filter_order, ''), lambda x: instr('ABCDE', x)) as places from orders, range(1, 6) r(step)
), seen as (
    select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad from judged group by all
), walked as (
    select part, filter_order, step, n, good, bad, fails[places[step]] as failing,
           list_bool_or(list_concat([false], list_transform(places[1 : step - 1], lambda p: fails[p]))) as gone,
           len(list_filter(fails, lambda f: f)) = 1 as one
    from seen, steps
), summed as (
    select part, filter_order, step, coalesce(sum(n) filter (not gone and not failing), 0)::bigint as kept, coalesce(sum(n) filter (not gone and failing), 0)::bigint as removed,
           coalesce(sum(n) filter (gone and failing), 0)::bigint as redundant, coalesce(sum(n) filter (failing and one), 0)::bigint as unique_fails,
           coalesce(sum(good) filter (not gone and failing), 0)::bigint as good_lost, coalesce(sum(bad) filter (not gone and failing), 0)::bigint as toxic_lost
    from walked group by all
)
select *, (sum(removed) over (partition by part, filter_order[step]))::bigint as shapley from summed
""",
}
