"""Profile, cleaning and sampling queries over the labelled-features view."""

from __future__ import annotations



from pyspark.sql import functions as F

from flowlark.functions import fixed
from flowlark.operators import clean as P
from flowlark.operators import joins as J
from flowlark.operators import profile as A
from flowlark.operators import sampling as B
from flowlark.plans.registry import query
from flowlark.sources.tables import view, with_views

# The view has four source files; three of them stand for the three splits, one is unlisted.
FILES = [("file0.csv", "train"), ("file1.csv", "train"), ("file2.csv", "valid"), ("file3.csv", "test")]
LISTED = FILES[:1] + FILES[2:]
COLUMNS = "row_id, label, source_file, dataset, f_packets, f_bytes, f_rate"

LABELS = ["BENIGN", "DDoS", "Heartbleed", "PortScan", "WebAttack_SQLInjection", "WebAttack_XSS"]

CLEANED = (
    with_views("features")
    + """, cl as (select * replace (case trim(label) when 'Web Attack - XSS' then 'WebAttack_XSS'
  when 'Web Attack - Sql Injection' then 'WebAttack_SQLInjection' else trim(label) end as label) from features),
ok as (select * from cl where f_rate is not null and not isinf(f_rate))
"""
)
SPLIT = (
    CLEANED
    + """, sp as (select *, case source_file when 'file2.csv' then 'valid' when 'file3.csv' then 'test' else 'train' end as split from cl)
"""
)
ORDER = "md5('42|' || row_id), row_id"
PARTS = """, f as (select label, unnest([{f: 'f_packets', v: f_packets}, {f: 'f_bytes', v: f_bytes}, {f: 'f_rate', v: f_rate}], recursive := true)
  from cl), g as (select label, f as feature, v from f where v is not null and not isinf(v))
"""


def raw(spark, sf):
    return view(spark, sf, "features")


def labelled(spark, sf):
    return P.clean_labels(raw(spark, sf))


def split(spark, sf):
    return B.temporal_split(labelled(spark, sf), FILES)


@query("clean_numeric", with_views("features") + f" select {COLUMNS} from features where f_rate is not null and not isinf(f_rate)")
def clean_numeric(spark, sf):
    return P.clean_numeric(raw(spark, sf))


@query(
    "clean_numeric_report",
    with_views("features")
    + """ select count(*) as rows_before, count(*) filter (f_rate is not null and not isinf(f_rate)) as rows_after,
  count(*) filter (f_rate is null or isinf(f_rate)) as rows_removed from features""",
)
def clean_numeric_report(spark, sf):
    return P.clean_numeric_report(raw(spark, sf))


@query("clean_labels", CLEANED + " select row_id, label from cl")
def clean_labels(spark, sf):
    return labelled(spark, sf).select("row_id", "label")


@query("split_features_labels", CLEANED + " select row_id, f_packets, f_bytes, f_rate from ok")
def split_features_labels(spark, sf):
    return P.split_features_labels(P.clean_numeric(labelled(spark, sf)))[0]


@query("numeric_features", with_views("features") + " select row_id, f_packets, f_bytes, f_rate from features")
def numeric_features(spark, sf):
    return P.numeric_features(raw(spark, sf))


@query("binary_label", CLEANED + " select row_id, case when label = 'BENIGN' then 0 else 1 end as target from cl")
def binary_label(spark, sf):
    return labelled(spark, sf).select("row_id", P.binary_label(F.col("label")).alias("target"))


@query("label_index", CLEANED + " select label, cast(dense_rank() over (order by label) - 1 as int) as label_id from (select distinct label from cl)")
def label_index(spark, sf):
    return P.label_index(labelled(spark, sf))


@query(
    "label_from_index",
    CLEANED
    + """, ids as (select label as known, dense_rank() over (order by label) - 1 as label_id from (select distinct label from cl))
select row_id, coalesce(known, 'UNKNOWN') as label from cl left join ids on ids.label_id = cl.f_packets % 8""",
)
def label_from_index(spark, sf):
    rows = labelled(spark, sf)
    coded = rows.select("row_id", (F.col("f_packets") % 8).cast("int").alias("predicted_id"))
    return P.label_from_index(coded, P.label_index(rows), "predicted_id").select("row_id", "label")


@query(
    "standard_scale",
    SPLIT
    + """, t as (select avg(f_packets) m1, stddev_pop(f_packets) s1, avg(f_bytes) m2, stddev_pop(f_bytes) s2 from sp where split = 'train')
select row_id, round((f_packets - m1) / s1, 4) + 0.0 as f_packets, round((f_bytes - m2) / s2, 4) + 0.0 as f_bytes from sp, t""",
)
def standard_scale(spark, sf):
    out = P.standard_scale(split(spark, sf), ["f_packets", "f_bytes"], F.col("split") == "train")
    return out.select("row_id", F.round("f_packets", 4).alias("f_packets"), F.round("f_bytes", 4).alias("f_bytes"))


@query(
    "rare_label_merge",
    SPLIT
    + """, r as (select label from sp where split = 'train' group by 1 having count(*) < 500)
select row_id, split, case when label in (select label from r) then 'OtherAttack' else label end as label from sp""",
)
def rare_label_merge(spark, sf):
    return P.rare_label_merge(split(spark, sf), F.col("split") == "train", limit=500).select("row_id", "split", "label")


@query(
    "temporal_split",
    with_views("features")
    + """ select row_id, case source_file when 'file0.csv' then 'train' when 'file2.csv' then 'valid' else 'test' end as split
from features where source_file in ('file0.csv', 'file2.csv', 'file3.csv')""",
)
def temporal_split(spark, sf):
    return B.temporal_split(raw(spark, sf), LISTED).select("row_id", "split")


@query(
    "seed_attacks",
    SPLIT
    + f""", r as (select *, row_number() over (partition by label order by {ORDER}) as rn, count(*) over (partition by label) as n
  from sp where split = 'valid' and label <> 'BENIGN')
select row_id, label, case when row_id in (select row_id from r where rn <= greatest(1, floor(n * 0.15::double))) then 'train'
  else split end as split from sp""",
)
def seed_attacks(spark, sf):
    return B.seed_attacks(split(spark, sf)).select("row_id", "label", "split")


@query(
    "balanced_binary_sample",
    CLEANED
    + f""", r as (select row_id, case when label = 'BENIGN' then 0 else 1 end as target,
  row_number() over (partition by label = 'BENIGN' order by {ORDER}) as rn from cl)
select row_id, target from r where rn <= 5000""",
)
def balanced_binary_sample(spark, sf):
    return B.balanced_binary(labelled(spark, sf), 5000, 5000).select("row_id", "target")


@query(
    "per_class_cap_sample",
    CLEANED + f", r as (select row_id, label, row_number() over (partition by label order by {ORDER}) as rn from cl) select row_id, label from r where rn <= 2000",
)
def per_class_cap_sample(spark, sf):
    return B.sample_per_class(labelled(spark, sf), 2000).select("row_id", "label")


@query(
    "specialist_training_set",
    CLEANED
    + f""", r as (select row_id, label, row_number() over (partition by label order by {ORDER}) as rn from cl)
select row_id, label from r where (label = 'BENIGN' and rn <= 3000)
  or (label in ('WebAttack_BruteForce', 'WebAttack_XSS', 'WebAttack_SQLInjection', 'Infiltration') and rn <= 1000)""",
)
def specialist_training_set(spark, sf):
    return B.specialist_training_set(labelled(spark, sf), fixed.WEB_FAMILY, 3000, 1000).select("row_id", "label")


@query(
    "benign_only_sample",
    CLEANED + f", r as (select row_id, label, row_number() over (order by {ORDER}) as rn from cl where label = 'BENIGN') select row_id, label from r where rn <= 15000",
)
def benign_only_sample(spark, sf):
    return B.benign_only(labelled(spark, sf), 15000).select("row_id", "label")


@query(
    "stratified_split",
    CLEANED
    + f""", r as (select row_id, label, row_number() over (partition by label order by {ORDER}) as rn,
  count(*) over (partition by label) as n from cl), t as (select *, floor(n * 0.2::double + 0.5) as a from r)
select row_id, label, case when rn <= a then 'test' when rn <= a + floor((n - a) * 0.2::double + 0.5) then 'valid' else 'train' end as split from t""",
)
def stratified_split(spark, sf):
    return B.stratified_split(labelled(spark, sf)).select("row_id", "label", "split")


@query(
    "class_weights",
    CLEANED
    + """, c as (select label, count(*) as n_rows from cl group by 1)
select label, n_rows, round((select count(*) from cl) / ((select count(*) from c) * n_rows)::double, 4) as balanced_weight,
  round((select max(n_rows) from c) / n_rows::double, 4) as specialist_weight,
  round((select count(*) from cl where label = 'BENIGN') / (select count(*) from cl where label <> 'BENIGN')::double, 4) as positive_weight from c""",
)
def class_weights(spark, sf):
    out = B.class_weights(labelled(spark, sf))
    return out.select("label", "n_rows", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query(
    "augmentation_plan",
    CLEANED
    + """ select label, count(*) as real_count, greatest(0, 1500 - count(*)) as synth_count,
  count(*) + greatest(0, 1500 - count(*)) as total_count, 'success' as status
from cl group by 1 having count(*) < 1000 and count(*) < 1500""",
)
def augmentation_plan(spark, sf):
    return B.augmentation_plan(labelled(spark, sf))


@query("features_labels_align", CLEANED + " select row_id, f_packets, f_bytes, f_rate, label from ok")
def features_labels_align(spark, sf):
    x, y = P.split_features_labels(P.clean_numeric(labelled(spark, sf)))
    return J.features_labels_align(x, y)


@query(
    "split_leakage_check",
    SPLIT
    + """, m as (select source_file, split from sp union all select source_file, 'train' as split from sp where label = (select min(label) from sp where split = 'valid'))
select source_file, string_agg(distinct split, ',' order by split) as splits from m group by 1 having count(distinct split) > 1""",
)
def split_leakage_check(spark, sf):
    """The split table with a class that lives in the validation file also put into train, so that files leak."""
    rows = split(spark, sf).select("source_file", "split", "label")
    lived = rows.filter("split = 'valid'").agg(F.min("label").alias("label"))
    again = rows.join(F.broadcast(lived), "label").withColumn("split", F.lit("train"))  # one row
    return J.split_leakage(rows.unionByName(again))


@query(
    "label_distribution",
    CLEANED + " select label, count(*) as n_rows, round(count(*) * 100.0::double / (select count(*) from cl), 2) as pct from cl group by 1",
)
def label_distribution(spark, sf):
    return A.label_distribution(labelled(spark, sf))


_MISSING = ", ".join(
    f"('{c}', (select count(*) from features where {c} is null), "
    + (f"(select count(*) from features where isinf({c}))" if c.startswith("f_") else "0")
    + ")"
    for c in COLUMNS.split(", ")
)


@query(
    "missing_and_inf",
    with_views("features")
    + f""", m(feature, n_null, n_inf) as (values {_MISSING})
select feature, n_null, cast(n_inf as bigint) as n_inf, (select count(*) from features) as n_rows,
  (select count(*) from features) * 7 as n_cells from m""",
)
def missing_and_inf(spark, sf):
    return A.missing_and_inf(raw(spark, sf))


@query(
    "split_summary",
    SPLIT
    + """ select split, count(*) as n_rows, round(count(*) * 100.0::double / (select count(*) from sp), 1) as pct,
  count(*) filter (label <> 'BENIGN') as attack_rows, round(count(*) filter (label <> 'BENIGN') * 100.0::double / count(*), 1) as attack_pct
from sp group by 1""",
)
def split_summary(spark, sf):
    return A.split_summary(split(spark, sf))


@query(
    "label_by_split",
    SPLIT
    + """ select label, count(*) filter (split = 'train') as train, count(*) filter (split = 'valid') as valid,
  count(*) filter (split = 'test') as test, count(*) as total from sp group by 1""",
)
def label_by_split(spark, sf):
    return A.label_by_split(split(spark, sf))


@query(
    "label_by_file",
    CLEANED
    + " select source_file, "
    + ", ".join(f"count(*) filter (label = '{x}') as \"{x}\"" for x in LABELS)
    + ', count(*) as "TOTAL" from cl group by 1',
)
def label_by_file(spark, sf):
    return A.label_by_file(labelled(spark, sf), LABELS)


@query(
    "top_variance_features",
    CLEANED
    + PARTS
    + """ select feature, round(avg(v), 3) as mean, round(stddev_samp(v), 3) as std, round(min(v), 3) as least,
  round(max(v), 3) as greatest from g group by 1 order by var_samp(v) desc limit 2""",
)
def top_variance_features(spark, sf):
    return A.top_variance_features(labelled(spark, sf), 2)


@query(
    "benign_attack_contrast",
    CLEANED
    + PARTS
    + """ select feature, round(avg(v) filter (label = 'BENIGN'), 4) as benign_mean, round(avg(v) filter (label <> 'BENIGN'), 4) as attack_mean,
  round(abs(avg(v) filter (label <> 'BENIGN') - avg(v) filter (label = 'BENIGN')), 4) as abs_diff from g group by 1 order by 4 desc limit 10""",
)
def benign_attack_contrast(spark, sf):
    out = A.benign_attack_contrast(labelled(spark, sf))
    return out.select("feature", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query(
    "clipped_histogram",
    CLEANED
    + """, v as (select case when label = 'BENIGN' then 'BENIGN' else 'ATTACK' end as side, f_rate as v from ok),
u as (select max(p) as upper from (select quantile_cont(v, 0.99) as p from v group by side)),
c as (select side, least(v, upper) as v from v, u), s as (select side, min(v) lo, (max(v) - min(v)) / 40 w, count(*) n from c group by 1),
h as (select c.side, cast(least(floor((v - lo) / w), 39) as bigint) as bin, count(*) as k from c join s on c.side = s.side group by 1, 2)
select s.side, r as bin, round(lo + r * w, 4) as left_edge, coalesce(k, 0) as n_rows, round(coalesce(k, 0) / (n * w) * 1e6, 4) as density_e6
from s cross join range(40) t(r) left join h on h.side = s.side and h.bin = r""",
)
def clipped_histogram(spark, sf):
    out = A.clipped_histogram(P.clean_numeric(labelled(spark, sf)), "f_rate")
    return out.select(
        "side", "bin", F.round("left_edge", 4).alias("left_edge"), "n_rows", F.round(F.col("density") * 1e6, 4).alias("density_e6")
    )


@query(
    "clip_quantile",
    CLEANED
    + """ select case when label = 'BENIGN' then 'BENIGN' else 'ATTACK' end as side, round(quantile_cont(f_rate, 0.99), 4) as p99 from ok group by 1""",
)
def clip_quantile(spark, sf):
    from flowlark.operators.scale import exact_quantile

    rows = P.clean_numeric(labelled(spark, sf)).withColumn("side", F.when(F.col("label") == "BENIGN", "BENIGN").otherwise("ATTACK"))
    return exact_quantile(rows, ["side"], "f_rate", 0.99).select("side", F.round("quantile", 4).alias("p99"))


@query("rare_labels", CLEANED + " select label, count(*) as n_rows from cl where label <> 'BENIGN' group by 1 having count(*) < 500")
def rare_labels(spark, sf):
    return A.rare_labels(labelled(spark, sf), 500)


@query(
    "schema_parity",
    SPLIT
    + """ select split, 1 as same_columns, count(*) filter (f_rate is null) as n_null, count(*) filter (isinf(f_rate)) as n_inf from sp group by 1""",
)
def schema_parity(spark, sf):
    rows = split(spark, sf)
    return A.schema_parity({s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "valid", "test")})


@query(
    "binary_balance",
    SPLIT
    + """ select split, count(*) filter (label = 'BENIGN') as benign, count(*) filter (label <> 'BENIGN') as attack,
  round(count(*) filter (label = 'BENIGN') * 100.0::double / count(*), 2) as benign_pct,
  round(count(*) filter (label <> 'BENIGN') * 100.0::double / count(*), 2) as attack_pct from sp group by 1""",
)
def binary_balance(spark, sf):
    return A.binary_balance(split(spark, sf))


@query(
    "column_subset_read",
    "select l_returnflag as label, count(*) as n_rows from lineitem group by 1",
)
def column_subset_read(spark, sf):
    """Only the label column is read."""
    from flowlark.sources.flow_files import read_columns

    return read_columns(spark, f"{sf}/lineitem.parquet", ["l_returnflag"]).groupBy(
        F.col("l_returnflag").alias("label")
    ).agg(F.count(F.lit(1)).alias("n_rows"))
