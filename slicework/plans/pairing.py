"""Queries on joins, filters, splits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.operators import pairs, sets, splits, volumes
from slicework.plans.arrays import PLANE
from slicework.plans.registry import query
from slicework.sources import tables as src
from slicework.sources.sinks import scratch

c = F.col
IGN = "(regexp_matches(lower(regexp_extract(path,'[^/]*$')),'preproc|cor|dwi|_ct|epi|fieldmap') or list_has_any(lower(path).string_split('/')[:-2], ['derivatives','.git','sourcedata']))"


def planed(t):
    return t.volumes.withColumn("plane", volumes.classify_plane(c("dx"), c("dy"), c("dz")))


@query("p01_not_ignored", f"select volume_id, not {IGN} as ok from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", volumes.not_ignored(c("path")).alias("ok"))


@query("p02_plane_filter", "select count(*) as n from fx_samples where name like '%sag%'")
def _(t):
    return volumes.plane_filter(t.samples, c("name"), "sag").agg(F.count(F.lit(1)).alias("n"))


def rules(t):
    return t.spark.createDataFrame([(1, None, "derivatives/*", "derived"), (2, "ds3", "*T2?.nii*", "bad contrast"), (3, None, "*dwi_*", "diffusion")], "rule_id int, dataset string, pattern string, reason string")


RULES = "r as (select * from (values (1,null,'derivatives/%','derived'),(2,'ds3','%T2_.nii%','bad contrast'),(3,null,'%dwi%','diffusion')) v(rule_id,ds,pattern,reason)), g as (select volume_id, dataset, reason from (select v.*, r.*, row_number() over (partition by path order by rule_id) k from fx_volumes v join r on (r.ds is null or r.ds=v.dataset) and v.path like r.pattern) where k=1)"


@query("p03_apply_exclusion_rules", f"with {RULES} select volume_id, reason from g union all select volume_id, 'kept' from fx_volumes where volume_id not in (select volume_id from g)")
def _(t):
    kept, gone = pairs.apply_exclusions(t.volumes, rules(t), "dataset", "path")
    return gone.select("volume_id", "reason").unionByName(kept.select("volume_id", F.lit("kept").alias("reason")))


@query("a22_exclusion_totals", f"with {RULES} select dataset, reason, count(*) as n from g group by cube (dataset, reason)")
def _(t):
    from slicework.operators.summaries import exclusion_totals

    return exclusion_totals(pairs.apply_exclusions(t.volumes, rules(t), "dataset", "path")[1], ["dataset", "reason"])


@query("p04_classify_plane", f"select volume_id, {PLANE} as plane from fx_volumes")
def _(t):
    return planed(t).select("volume_id", "plane")


@query("p08_select_task", "select label_id, k.task, k.axis from fx_labels join (values ('nfn','Moderate',0),('scs','Severe',2)) k(task,pat,axis) on regexp_matches(severity, k.pat)")
def _(t):
    config = t.spark.createDataFrame([("nfn", "Moderate", 0), ("scs", "Severe", 2)], "task string, pat string, axis int")
    return t.labels_fx.join(F.broadcast(config), F.expr("severity rlike pat")).select("label_id", "task", "axis")


@query("p09_shape_match", "select volume_id, case when nx=ny and ny=nz then 'ok' else 'shape_mismatch' end as status from fx_volumes")
def _(t):
    return volumes.with_shape_status(t.volumes, ("nx", "ny"), ("ny", "nz")).select("volume_id", "status")


@query("p10_skip_coronal", f"select volume_id, case when plane='coronal' then 'skipped' else 'ok' end as status, case when plane='coronal' then printf('coronal (%.2f, %.2f, %.2f)',dx,dy,dz) end as skip_reason from (select *, {PLANE} plane from fx_volumes)")
def _(t):
    return volumes.with_plane_status(planed(t)).select("volume_id", "status", "skip_reason")


@query("p14_not_test", "select subject_id, regime_50_split_1_set as side from fx_folds where is_test <> '1' and regime_50_split_1_set in ('train','val')")
def _(t):
    return src.folds(t.folds, "regime_50_split_1_set")


@query("s08_read_fold_table", "select regime_all_split_1_set as side, count(*) as n from fx_folds where is_test <> '1' group by 1")
def _(t):
    path = scratch(t.spark, "folds")
    t.folds.write.csv(path, header=True)
    return src.read_folds(t.spark, path, "regime_all_split_1_set").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("s09_read_fold_list", "select 0 as fold, 'train' as split, 's'||n_nationkey as id from nation where n_nationkey < 10 union all select 0, 'val', 's'||n_nationkey from nation where n_nationkey >= 10")
def _(t):
    js = t.nation.agg(F.to_json(F.array(F.struct(F.collect_list(F.when(c("n_nationkey") < 10, F.concat(F.lit("s"), "n_nationkey"))).alias("train"), F.collect_list(F.when(c("n_nationkey") >= 10, F.concat(F.lit("s"), "n_nationkey"))).alias("val")))).alias("js"))
    path = scratch(t.spark, "fold-list")
    js.coalesce(1).write.text(path)
    return src.read_fold_list(t.spark, path)


@query("p16_sanity_checks", "with a as (select p_partkey, case when p_partkey % 17 = 0 then 'bad' else 'img_'||p_partkey||'.png' end as name, p_size h from part), b as (select p_partkey, case when p_partkey % 19 = 0 then h+1 else h end lh, p_partkey % 23 = 0 as err from a where p_partkey % 13 <> 0) select a.name, unnest(list_filter([case when not regexp_matches(a.name,'^img_\\d+\\.png$') then 'bad_name' end, case when b.p_partkey is null then 'missing_label' end, case when b.lh <> a.h then 'size_mismatch' end, case when b.err then 'unreadable' end], lambda x: x is not null)) as issue from a left join b on a.name = (case when b.p_partkey % 17 = 0 then 'bad'||b.p_partkey else 'img_'||b.p_partkey||'.png' end)")
def _(t):
    a, b = sanity_tables(t)
    return pairs.sanity_check(a, b, r"^img_\d+\.png$")


@query("p16_empty_splits", "select * from (values ('test','missing_images'), ('val','missing_labels')) v(split, issue) where (select count(*) from part) > 0")
def _(t):
    side = lambda a, b: t.part.select(F.expr(f"if(p_partkey % 5 = 0, '{a}', '{b}')").alias("split"))
    return pairs.empty_splits(side("val", "train"), side("train", "train"), ("train", "val", "test"))


def sanity_tables(t):
    a = t.part.select("p_partkey", F.expr("if(p_partkey % 17 = 0, 'bad', concat('img_', p_partkey, '.png'))").alias("name"), c("p_size").alias("h"), F.lit(1).alias("w"), F.lit(None).cast("string").alias("error"))
    b = t.part.where("p_partkey % 13 <> 0").select(F.expr("if(p_partkey % 17 = 0, concat('bad', p_partkey), concat('img_', p_partkey, '.png'))").alias("name"), F.expr("if(p_partkey % 19 = 0, p_size + 1, p_size)").alias("h"), F.lit(1).alias("w"), F.expr("if(p_partkey % 23 = 0, 'broken', null)").alias("error"))
    return a.drop("p_partkey"), b


@query("o03_first_n_issues", "with a as (select case when p_partkey % 17 = 0 then 'bad' else 'img_'||p_partkey||'.png' end as name from part) select name, 'bad_name' as issue from a where name = 'bad' order by name limit 50")
def _(t):
    from slicework.operators.summaries import first_n_issues

    return first_n_issues(pairs.sanity_check(*sanity_tables(t), r"^img_\d+\.png$").where("issue = 'bad_name'"), 50)


LBL = "replace(v.path,'.nii.gz','_seg.nii.gz')"


@query("j01_match_labels", f"select v.volume_id, l.label_id, l.severity from fx_volumes v join fx_labels l on l.path = {LBL}")
def _(t):
    return pairs.match_labels(t.volumes, t.labels_fx, "_seg").select("volume_id", "label_id", "severity")


@query("j02_images_without_label", f"select v.volume_id from fx_volumes v anti join fx_labels l on l.path = {LBL}")
def _(t):
    return pairs.unmatched_images(t.volumes, t.labels_fx, "_seg").select("volume_id")


@query("j03_labels_without_image", f"select l.label_id from fx_labels l anti join fx_volumes v on l.path = {LBL}")
def _(t):
    return pairs.unmatched_labels(t.volumes, t.labels_fx, "_seg").select("label_id")


@query("j04_candidate_labels", f"select {LBL} as path from fx_volumes v semi join fx_labels l on l.path = {LBL}")
def _(t):
    return pairs.candidate_labels(t.volumes, t.labels_fx, "_seg")


@query("j05_pair_images_masks", "select doc_id, quality is not null as paired from documents left join labels using (doc_id)")
def _(t):
    both, lone = pairs.pair(t.documents.select("doc_id"), t.labels, "doc_id")
    return both.select("doc_id", F.lit(True).alias("paired")).unionByName(lone.select("doc_id", F.lit(False).alias("paired")))


FS = "sx as (select *, split_part(name,'_',1) subject_id from fx_samples)"


@query("j06_assign_folds", f"with {FS} select sample_id, regime_50_split_1_set as side from sx join fx_folds using (subject_id) where is_test <> '1' and regime_50_split_1_set in ('train','val')")
def _(t):
    return pairs.assign_folds(t.samples, t.folds, "regime_50_split_1_set").select("sample_id", "side")


@query("j07_select_test", f"with {FS} select sample_id from sx where subject_id in (select subject_id from fx_folds where is_test = '1')")
def _(t):
    return pairs.select_test(t.samples, t.folds).select("sample_id")


@query("j08_volume_labels", "with x as (select volume_id, regexp_extract(path,'(sub-[^/_]+)',1) f, regexp_replace(regexp_extract(path,'[^/]*$'),'\\.nii\\.gz$','') stem from fx_volumes), y as (select label_id, regexp_extract(path,'(sub-[^/_]+)',1) f, regexp_extract(path,'[^/]*$') as name from fx_labels) select volume_id, label_id from x join y using (f) where starts_with(name, stem) and regexp_matches(name, '_(T1w|T2w)_seg')")
def _(t):
    return pairs.volume_labels(t.volumes, t.labels_fx, "_(T1w|T2w)_seg").select("volume_id", "label_id")


@query("j09_attach_severity", "select label_id, case when label_id % 5 = 0 then null when label_id % 7 = 0 then null else case severity when 'Normal/Mild' then 0 when 'Moderate' then 1 else 2 end end as target, case when label_id % 5 = 0 then 'missing' when label_id % 7 = 0 then 'unknown' else 'ok' end as status from fx_labels")
def _(t):
    side = t.labels_fx.where("label_id % 5 <> 0").select("label_id", F.expr("concat('{\"PathologySeverity\":\"', if(label_id % 7 = 0, 'odd', severity), '\"}')").alias("js"))
    return pairs.attach_severity(t.labels_fx.drop("severity"), side, "label_id", "js").select("label_id", "target", "status")


#: Names of every seventh sample tell no volume; every fourth has no volume, every tenth a broken header, every third its spacing.
J10 = "select sample_id, case when sample_id % 3 = 0 then 1.5::double when sample_id % 7 = 0 or sample_id % 4 = 0 or sample_id % 10 = 1 then null else (0.5+sample_id % 5+0.25)/2 end as spacing_mm, case when sample_id % 3 = 0 then null when sample_id % 7 = 0 then 'SKIP' when sample_id % 4 = 0 then 'WARN' when sample_id % 10 = 1 then 'ERROR' else 'OK' end as status from fx_samples"


@query("j10_backfill_spacing", J10)
def _(t):
    own = t.samples.select("sample_id", F.expr("if(sample_id % 7 = 0, concat('x-', name), name)").alias("name"), F.expr("if(sample_id % 3 = 0, 1.5D, null)").alias("spacing_mm"))
    sub = "substring_index(name, '_', 1)"
    path = F.expr(f"concat({sub}, '/anat/', {sub}, '_acq-sag_rec-', sample_id, '_T2w.nii.gz')")
    headers = t.samples.where("sample_id % 4 <> 0").select(path.alias("path"), F.lit(9.0).alias("dx"), F.expr("0.5D + sample_id % 5").alias("dy"), F.lit(0.25).alias("dz"), F.expr("if(sample_id % 10 = 1, 'bad header', null)").alias("error"))
    return pairs.backfill_spacing(own, headers, "sag").select("sample_id", "spacing_mm", "status")


@query("j11_join_ground_truth", "with g as (select o_custkey, max(substr(o_orderpriority,1,1)) as label from orders group by 1) select c_custkey as k, label from customer join g on o_custkey = c_custkey")
def _(t):
    truth = t.orders.select(c("o_custkey").alias("k"), F.substring("o_orderpriority", 1, 1).alias("label"))
    return pairs.join_ground_truth(t.customer.select(c("c_custkey").alias("k")), truth, ["k"])


@query("j12_lookup_features", "select s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey")
def _(t):
    store = t.nation.select(c("n_nationkey").alias("path"), "n_name")
    return pairs.lookup_features(t.supplier.select("s_suppkey", c("s_nationkey").alias("path")), store).select("s_suppkey", "n_name")


@query("j13_link_folds", "select doc_id, l.doc_id is null as missing from documents d left join labels l using (doc_id)")
def _(t):
    return pairs.link_folds(t.documents.select("doc_id"), t.labels, "doc_id")


@query("u01_union_sources", "select c_nationkey as n from customer union all select s_nationkey from supplier")
def _(t):
    return sets.union_sources(t.customer.select(c("c_nationkey").alias("n")), t.supplier.select(c("s_nationkey").alias("n")))


@query("u02_union_distinct", "select c_nationkey as n from customer union select s_nationkey from supplier")
def _(t):
    return sets.union_distinct(t.customer.select(c("c_nationkey").alias("n")), t.supplier.select(c("s_nationkey").alias("n")))


@query("u03_except", "select c_custkey as k from customer except select o_custkey from orders")
def _(t):
    return sets.except_(t.customer.select(c("c_custkey").alias("k")), t.orders.select(c("o_custkey").alias("k")))


@query("u04_intersect", "select c_custkey as k from customer intersect select o_custkey from orders")
def _(t):
    return sets.intersect_(t.customer.select(c("c_custkey").alias("k")), t.orders.select(c("o_custkey").alias("k")))


@query("w07_centred_block", "with x as (select *, row_number() over (partition by volume_id order by slice_idx)-1 i, count(*) over (partition by volume_id) n from fx_images) select volume_id, slice_idx from x where i >= greatest(0,least(n//2-2,n-4)) and i < greatest(0,least(n//2-2,n-4))+4")
def _(t):
    return splits.centred_block(t.images, "volume_id", "slice_idx", 4).select("volume_id", "slice_idx")


@query("w08_stratified_split", "select sample_id, case when row_number() over (partition by class order by md5('42/'||sample_id), sample_id) <= round_even(count(*) over (partition by class)*0.15,0) then 'val' else 'train' end as side from fx_samples")
def _(t):
    return splits.stratified_split(t.samples, "class", "sample_id").select("sample_id", "side")


@query("w09_shuffled_split", "with x as (select distinct split_part(name,'_',1) s from fx_samples) select s, case when row_number() over (order by md5('42/'||s), s) <= greatest(1,round_even((select count(*) from x)*0.2,0)) then 'val' else 'train' end as side from x")
def _(t):
    return splits.shuffled_split(t.samples.select(F.substring_index("name", "_", 1).alias("s")), "s")


@query("w10_epoch_manifest", "with x as (select c_custkey, k.copy from customer, lateral (select unnest(range((select ceil(250.0/count(*)) from customer)::bigint)) as copy) k), o as (select *, row_number() over (order by copy, md5('7/3/'||c_custkey||'/'||copy), c_custkey)-1 p from x) select 3 as epoch, p::bigint as position, (p % 4)::bigint as rank, c_custkey from o where p < 250")
def _(t):
    return splits.epoch_manifest(t.customer, "c_custkey", 250, 3, 7, 4)


@query("w11_endless_manifest", "with x as (select c_custkey, e.epoch from customer, (values (0),(1),(2)) e(epoch)), o as (select *, epoch*(select count(*) from customer) + row_number() over (partition by epoch order by md5('7/'||epoch||'/'||c_custkey), c_custkey)-1 p from x) select epoch, p::bigint as position, c_custkey, (p % 4)::bigint as rank, (p // 4)::bigint as turn from o where p // 4 >= 10")
def _(t):
    return splits.endless_manifest(t.customer, "c_custkey", 3, 10, 7, 4)


@query("w12_sharded_manifest", "with o as (select s_suppkey, row_number() over (order by md5('7/'||s_suppkey), s_suppkey)-1 i, count(*) over () n from supplier), k as (select s_suppkey, (i % 3) as rank, e.pass from o, (values (0),(1)) e(pass) where i < n//3*3) select pass, rank::bigint as rank, (row_number() over (partition by pass, rank order by md5('7/'||pass||'/'||rank||'/'||s_suppkey), s_suppkey)-1)::bigint as turn, s_suppkey from k")
def _(t):
    return splits.sharded_manifest(t.supplier, "s_suppkey", 2, 7, 3)


@query("w13_label_encode", "select sample_id, (dense_rank() over (order by class)-1)::int as target from fx_samples")
def _(t):
    return splits.label_encode(t.samples, "class").select("sample_id", "target")


@query("o06_sample_cap", "select o_orderkey from orders order by md5('0/'||o_orderkey), o_orderkey limit 2000")
def _(t):
    return splits.sample_cap(t.orders.select("o_orderkey"), "o_orderkey", 2000)


#: Draws on the running sums of all rows, in the order of the buckets.
O08 = """with r as (select o_orderkey, o_totalprice::double wt, md5(o_orderkey::varchar) h from orders where o_totalprice > 0), k as (select greatest(1, ceil(count(*)/(4096*256.0)))::bigint k from r),
c as (select o_orderkey, sum(wt) over (order by substr(h,1,3), ('0x'||substr(h,4,6))::bigint % k, o_orderkey) hi, wt from r, k), e as (select o_orderkey, coalesce(lag(hi) over (order by hi),0) lo from c),
d as (select i as draw_id, ('0x'||substr(md5('0/'||i),1,13))::bigint/power(16.0,13) * (select sum(wt) from r) x from range(5000) t(i))
select draw_id, o_orderkey from d asof join e on d.x >= e.lo"""


@query("o08_weighted_sample", O08)
def _(t):
    return splits.weighted_sample(t.orders, "o_orderkey", "o_totalprice", 5000)


@query("s13_read_result_history", "select event_id, value from events where event_type = 'click' and event_id % 5 <> 0")
def _(t):
    path = scratch(t.spark, "history")
    t.events.select(F.expr("if(event_id % 5 = 0, '{broken', to_json(struct(event_type as mode, event_id, value)))").alias("js")).write.text(path)
    return src.read_result_history(t.spark, path, "click", f"mode string, event_id {dict(t.events.dtypes)['event_id']}, value double").select("event_id", "value")


@query("s15_ingest_many_sources", "select dataset, count(*) as n from (select 'a' as dataset from customer union all select 'b' from supplier) group by 1")
def _(t):
    frames = {"a": t.customer.select(c("c_custkey").alias("k")), "b": t.supplier.select(c("s_suppkey").alias("k")), "old": t.nation.select(c("n_nationkey").alias("k"))}
    done = t.spark.createDataFrame([("old",)], "dataset string")
    return src.ingest(frames, done).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


