"""Queries on summaries, reports and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.operators import summaries as sm
from slicework.operators import volumes
from slicework.plans.arrays import PLANE
from slicework.plans.registry import query
from slicework.sources import sinks

c = F.col
FILES = f"fl as (select dataset, case when plane in ('axial','sagittal') then plane else 'axial' end as orientation, case when volume_id % 5 = 0 then 'val' else 'train' end as split, volume_id from (select *, {PLANE} plane from fx_volumes))"


def files(t):
    plane = volumes.classify_plane(c("dx"), c("dy"), c("dz"))
    return t.volumes.select("dataset", F.when(plane.isin("axial", "sagittal"), plane).otherwise("axial").alias("orientation"), F.expr("if(volume_id % 5 = 0,'val','train')").alias("split"), "volume_id")


@query("a01_dataset_summary", f"with {FILES} select coalesce(dataset,'TOTAL') as dataset, count(*) as total, count(*) filter (orientation='axial') as axial, count(*) filter (orientation='sagittal') as sagittal from fl group by rollup (dataset)")
def _(t):
    return sm.dataset_summary(files(t))


@query("a02_facet_counts", f"with {FILES} select 'split' as facet, split as value, count(*) as n from fl group by 2 union all select 'orientation', orientation, count(*) from fl group by 2")
def _(t):
    return sm.facet_counts(files(t), ["split", "orientation"])


RES = "rs as (select volume_id, path, case when volume_id % 9 = 0 then 'error' when volume_id % 5 = 0 then 'skipped' when volume_id % 11 = 0 then 'exists' else 'ok' end as status, case when volume_id % 2 = 0 then 'coronal' end as tag, nz::bigint as slices, 2*nz::bigint as outputs, case when volume_id % 3 = 0 then 'cannot read '||volume_id end as message from fx_volumes)"


def results(t):
    status = F.expr("case when volume_id % 9 = 0 then 'error' when volume_id % 5 = 0 then 'skipped' when volume_id % 11 = 0 then 'exists' else 'ok' end")
    return t.volumes.select("volume_id", "path", status.alias("status"), F.expr("if(volume_id % 2 = 0, 'coronal', null)").alias("tag"), c("nz").cast("bigint").alias("slices"), (2 * c("nz")).cast("bigint").alias("outputs"), F.expr("if(volume_id % 3 = 0, concat('cannot read ', volume_id), null)").alias("message"))


@query("a03_extraction_summary", f"with {RES} select count(*) filter (status='ok') as extracted, count(*) filter (status='skipped') as skipped, count(*) filter (status='error') as errors, count(*) filter (status='exists') as skipped_existing, sum(slices)::bigint as slices, sum(outputs)::bigint as outputs from rs")
def _(t):
    return sm.extraction_summary(results(t))


@query("k12_run_report_lines", f"with {RES} select case status when 'ok' then '[OK]    '||regexp_extract(path,'[^/]*$')||'  slices='||slices||'  outputs='||outputs when 'skipped' then '[SKIP/'||coalesce(tag,'skip')||']  '||path||coalesce('  | '||message,'') else '[ERROR]  '||path||chr(10)||'  '||coalesce(message,'') end as line from rs where status <> 'exists'")
def _(t):
    return sm.report_lines(results(t))


@query("k12_report_totals", f"with {RES}, a as (select count(*) filter (status='ok') as e, count(*) filter (status='skipped') as s, count(*) filter (status='error') as r, count(*) filter (status='exists') as x, sum(slices) as n, sum(outputs) as o, (select count(*) from fx_volumes where volume_id % 50 = 0) as u from rs), l as (select ['{'=' * 50}', 'SUMMARY', '  extracted        : '||e, '  skipped          : '||s, '  errors           : '||r, '  skipped_existing : '||x, '  total_slices     : '||n, '  total_outputs    : '||o, '  unmatched_labels : '||u, '{'=' * 50}'] as l from a) select (unnest(range(10)))::int as place, unnest(l) as line from l")
def _(t):
    return sm.report_totals(results(t), t.volumes.where("volume_id % 50 = 0"))


@query("o02_top_datasets", "select dataset, count(*) as n from fx_volumes group by 1 order by n desc, dataset limit 3")
def _(t):
    return sm.top_by(t.volumes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")), "n", 3, "dataset")


@query("o07_head_errors", f"with {RES} select 'bad '||path as error_msg from rs where status='error' order by 1 limit 20")
def _(t):
    return sm.head_errors(results(t).select(F.when(c("status") == "error", F.concat(F.lit("bad "), "path")).alias("error_msg")), 20)


@query("k02_skip_existing", "select p_partkey from part where p_partkey % 3 <> 0 or p_partkey % 2 <> 0")
def _(t):
    target = t.part.where("p_partkey % 3 = 0").select("p_partkey", (c("p_partkey") % 2 == 0).alias("both"))
    return sm.skip_existing(t.part.select("p_partkey"), target, ["p_partkey"], c("both"))


NM = f"mf as (select volume_id, split_part(path,'/',1)||'__'||regexp_replace(regexp_extract(path,'[^/]*$'),'\\.nii\\.gz$','')||'__'||pl||printf('__s%04d__t000__',k)||printf('sp%04dx%04d',round_even(a*1000,0)::int,round_even(b*1000,0)::int)||'.png' as name from (select volume_id, path, 'axial' pl, unnest(range(nz)) k, dy a, dx b from (select *, {PLANE} plane from fx_volumes) where plane in ('axial','isotropic') union all select volume_id, path, 'sagittal', unnest(range(nx)), dz, dy from (select *, {PLANE} plane from fx_volumes) where plane in ('sagittal','isotropic')))"


def manifest(t):
    return volumes.predict_manifest(t.volumes.withColumn("plane", volumes.classify_plane(c("dx"), c("dy"), c("dz"))))


@query("k03_predict_manifest", f"with {NM} select volume_id, name from mf")
def _(t):
    return manifest(t).select("volume_id", "name")


@query("k03_finished_volumes", f"with {NM} select volume_id from mf group by 1 having bool_and(right(name, 20) not like '%s0003%' and volume_id % 2 = 0)")
def _(t):
    m = manifest(t)
    present = m.where("volume_id % 2 = 0 and right(name, 20) not like '%s0003%'").select("name")
    return volumes.finished_volumes(m, present, "volume_id")


@query("k05_check_collisions", f"with {NM} select count(*) as n from mf")
def _(t):
    return sm.assert_unique(manifest(t).select("volume_id", "name"), ["volume_id", "name"]).agg(F.count(F.lit(1)).alias("n"))


@query("k06_add_columns", "select p_partkey, case when p_partkey % 2 = 0 then p_size else 99 end as p_size, case when p_partkey % 3 = 0 then 'x'||p_partkey end as extra from part")
def _(t):
    base = t.part.select("p_partkey", F.expr("if(p_partkey % 2 = 0, p_size, null)").alias("p_size"))
    extra = t.part.select("p_partkey", F.lit(99).alias("p_size")).join(t.part.where("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("x"), "p_partkey").alias("extra")), "p_partkey", "left")
    path = sinks.scratch(t.spark, "columns")
    sinks.swap_snapshot(base, path)
    sinks.swap_snapshot(sm.add_columns(sinks.read_snapshot(t.spark, path), extra, "p_partkey"), path)
    return sinks.read_snapshot(t.spark, path)


@query("p05_select_keys", "select n_nationkey, n_name, true as changed from nation")
def _(t):
    kept, changed = sm.strip_columns(t.nation, ["n_nationkey", "n_name"])
    return kept.withColumn("changed", F.lit(changed))


@query("p06_pending_rows", "select doc_id from documents left join labels using (doc_id) where quality is null")
def _(t):
    return sm.pending(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), ["quality", "toxic"]).select("doc_id")


@query("k08_write_summary_json", "select '{'||string_agg('\"'||event_type||'\":{\"n\":'||n||'}', ',' order by event_type)||'}' as json from (select event_type, count(*) n from events group by 1)")
def _(t):
    e = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return sm.summary_json(e, "event_type", ["n"])


@query("k09_upsert_last_wins", "select user_id, event_id from events qualify row_number() over (partition by user_id order by (event_id % 10 = 0) desc, event_id desc) = 1")
def _(t):
    e = t.events.select("user_id", "event_id")
    return sm.upsert(e.where("event_id % 10 <> 0"), e.where("event_id % 10 = 0"), "user_id", "event_id")


@query("k10_insert_if_absent", "select o_orderkey, 'old' as src from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'new' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0")
def _(t):
    o = t.orders
    return sm.insert_if_absent(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("old").alias("src")), o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("new").alias("src")), ["o_orderkey"])


@query("k11_write_unmatched", "select 'image' as side, v.path from fx_volumes v anti join fx_labels l on l.path = replace(v.path,'.nii.gz','_seg.nii.gz') union all select 'label', l.path from fx_labels l anti join fx_volumes v on l.path = replace(v.path,'.nii.gz','_seg.nii.gz')")
def _(t):
    from slicework.operators import pairs

    a = pairs.unmatched_images(t.volumes, t.labels_fx, "_seg").select(F.lit("image").alias("side"), "path")
    return a.unionByName(pairs.unmatched_labels(t.volumes, t.labels_fx, "_seg").select(F.lit("label").alias("side"), "path"))


@query("k15_markdown_table", "select '| event_type | n |'||chr(10)||'|---|---|'||chr(10)||string_agg('| '||event_type||' | '||n||' |', chr(10) order by event_type) as markdown from (select event_type, count(*) n from events group by 1)")
def _(t):
    return sm.to_markdown(t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), ["event_type", "n"], "event_type")
