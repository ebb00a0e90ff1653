"""Queries on the functions for names, paths and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.functions import names as n
from slicework.plans.registry import query

col = F.col
BASE = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.nii\\.gz$', '')"
SLICES = """slices as (select volume_id, split_part(path,'/',1)||'__'||regexp_replace(regexp_extract(path, '[^/]*$'), '\\.nii\\.gz$', '')||'__axial'||printf('__s%04d__t%03d__', nz, nx)||printf('sp%04dx%04d', round_even(dy*1000,0)::int, round_even(dx*1000,0)::int)||'.png' as sname from fx_volumes)"""


def slices(t):
    """Names of one slice for each volume."""
    path = col("path")
    return t.volumes.select("volume_id", n.slice_name(path, n.base_name(path), F.lit("axial"), col("nz"), col("nx"), n.fmt_spacing(col("dy"), col("dx"))).alias("sname"))


@query("f01_sanitize_token", "select volume_id, regexp_replace(path||' é+x', '[^\\p{L}\\p{N}._-]', '-', 'g') as token from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", n.sanitize_token(F.concat("path", F.lit(" é+x"))).alias("token"))


@query("f02_normalize_label_suffix", "select volume_id, case when s = '' or starts_with(s,'_') then s else '_'||s end as suffix from (select volume_id, case volume_id % 3 when 0 then '' when 1 then 'seg' else '_seg' end s from fx_volumes)")
def _(t):
    s = F.expr("case volume_id % 3 when 0 then '' when 1 then 'seg' else '_seg' end")
    return t.volumes.select("volume_id", n.normalize_label_suffix(s).alias("suffix"))


@query("f03_fmt_spacing", "select volume_id, printf('sp%04dx%04d', round_even(dx*1000,0)::int, round_even(dz*1000,0)::int) as sp from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", n.fmt_spacing(col("dx"), col("dz")).alias("sp"))


@query("f04_slice_name", f"with {SLICES} select volume_id, sname from slices")
def _(t):
    return slices(t)


#: Variants of slice names that fit, or that don't: a digit too few, no tile, five digits of spacing.
VARIANTS_SQL = "case volume_id % 7 when 1 then replace(replace(sname,'__s0','__s00'),'__t0','__t000') when 2 then replace(sname,'.png','__'||(volume_id % 90)||'.jpeg') when 3 then upper(sname) when 4 then replace(sname,'__t0','__t') when 5 then regexp_replace(sname,'__t\\d+','') when 6 then replace(sname,'__sp','__sp10') else sname end"
VARIANTS = "case volume_id % 7 when 1 then replace(replace(sname,'__s0','__s00'),'__t0','__t000') when 2 then replace(sname,'.png',concat('__',volume_id % 90,'.jpeg')) when 3 then upper(sname) when 4 then replace(sname,'__t0','__t') when 5 then regexp_replace(sname,'__t[0-9]+','') when 6 then replace(sname,'__sp','__sp10') else sname end"
#: The parts from the numbers that the names were made of.
F05 = f"""with {SLICES}, p as (select s.volume_id, sname, volume_id % 7 as k, nz, nx, round_even(dy*1000,0)::int h, round_even(dx*1000,0)::int w from slices s join fx_volumes using (volume_id)), g as (select *, k in (0,1,2,3) ok from p)
select volume_id, case when ok then case when k = 3 then 'AXIAL' else 'axial' end end as plane, case when ok then nz end as slice, case when ok then nx end as tile, case when ok then h end as sp_h, case when ok then w end as sp_w, case when ok and k = 2 then (volume_id % 90)::int end as extra from g"""


@query("f05_parse_slice_name", F05)
def _(t):
    return slices(t).withColumn("name", F.expr(VARIANTS)).select("volume_id", n.parse_slice_name(col("name")).alias("p")).select("volume_id", "p.*")


@query("f06_parse_spacing", f"with {SLICES} select volume_id, nullif(regexp_extract(sname,'__sp(\\d{{3,4}})x(\\d{{3,4}})',1),'')::double/1000 as h, nullif(regexp_extract(sname,'__sp(\\d{{3,4}})x(\\d{{3,4}})',2),'')::double/1000 as w from slices")
def _(t):
    return slices(t).select("volume_id", n.parse_spacing(col("sname")).alias("p")).select("volume_id", "p.*")


@query("f07_replace_spacing", f"with {SLICES} select volume_id, regexp_replace(sname,'__sp\\d{{3,4}}x\\d{{3,4}}','__sp0500x0500') as sname from slices")
def _(t):
    return slices(t).select("volume_id", n.replace_spacing(col("sname"), 0.5).alias("sname"))


@query("f08_tile_stem", f"with {SLICES}, s as (select volume_id, case when volume_id % 2 = 0 then sname else base_ end as x from (select volume_id, sname, split_part(sname,'__',1) base_ from slices)) select volume_id, case when regexp_matches(x,'__t\\d{{3,6}}__') then regexp_extract(x,'^(.*?)__t\\d{{3,6}}__',1)||'__t'||printf('%03d',volume_id % 7)||'__'||regexp_extract(x,'__t\\d{{3,6}}__(.*)$',1) else x||'__t'||printf('%03d',volume_id % 7) end as stem from s")
def _(t):
    x = F.when(col("volume_id") % 2 == 0, col("sname")).otherwise(F.substring_index("sname", "__", 1))
    return slices(t).select("volume_id", n.tile_stem(x, col("volume_id") % 7).alias("stem"))


@query("f09_dataset_from_url", "select volume_id, coalesce(nullif(regexp_replace(regexp_extract(regexp_replace(u,'/+$',''),'[^/]*$'),'\\.git$',''),''),'repo') as ds from (select volume_id, case when volume_id % 9 = 0 then '/' else 'https://host/org/'||dataset||case volume_id % 3 when 0 then '.git' when 1 then '/' else '' end end u from fx_volumes)")
def _(t):
    u = F.expr("case when volume_id % 9 = 0 then '/' else concat('https://host/org/',dataset,case volume_id % 3 when 0 then '.git' when 1 then '/' else '' end) end")
    return t.volumes.select("volume_id", n.dataset_from_url(u).alias("ds"))


@query("f10_parse_bids", "with p as (select sample_id, sample_id % 6 k, split_part(name,'_',1) s from fx_samples) select sample_id, case when k in (0,1,2) then s end as subject, case when k in (0,1,2) then sample_id::varchar end as recording, case k when 0 then 'T2w' when 1 then 'T1w' when 2 then 'T2w' end as modality from p")
def _(t):
    name = F.expr("case sample_id % 6 when 1 then replace(name,'T2w','T1w') when 2 then replace(name,'acq-sag','acq-ax') when 3 then replace(name,'T2w','T2star') when 4 then replace(name,'rec-','rec-x') when 5 then replace(name,'acq-sag_','') else name end")
    return t.samples.select("sample_id", n.parse_bids(name).alias("p")).select("sample_id", "p.*")


@query("f11_subject_of", "select sample_id, split_part(name,'_',1) as subject from fx_samples")
def _(t):
    return t.samples.select("sample_id", n.subject_of(col("name")).alias("subject"))


@query("f12_normalize_level", "select sample_id, case when sample_id % 7 = 0 then null when sample_id % 5 = 0 then 't1'||(1+sample_id % 4) else 'l'||(1+sample_id % 4) end||'_l'||(2+sample_id % 4) as level from fx_samples")
def _(t):
    name = F.expr("case when sample_id % 7 = 0 then replace(name, 'desc-', 'desc-7_desc-') when sample_id % 5 = 0 then replace(name, 'desc-L', 'desc-T1') else name end")
    return t.samples.select("sample_id", n.normalize_level(name).alias("level"))


@query("f13_split_label_key", "select sample_id, p[1] as subject, array_to_string(p[2:len(p)-2],'_') as pathology, p[len(p)-1]||'_'||p[len(p)] as level from (select sample_id, string_split(split_part(name,'_',1)||case when sample_id % 2 = 0 then '_left_neural' else '_canal' end||'_l'||(sample_id % 4)||'_l'||(sample_id % 4 + 1),'_') p from fx_samples)")
def _(t):
    key = F.expr("concat(substring_index(name,'_',1), if(sample_id % 2 = 0,'_left_neural','_canal'), '_l', sample_id % 4, '_l', sample_id % 4 + 1)")
    return t.samples.select("sample_id", n.split_label_key(key).alias("p")).select("sample_id", "p.*")


#: Contrasts of the fixture's names, some of which merge, and some that are none.
KINDS = "T2starw T2star T1w T2w MTS FLAIR PSIR MP2RAGE STIR PDw T1rho MTon MToff bold UNIT1 PD t1w".split()
SQL_KINDS = "[" + ",".join(f"'{k}'" for k in KINDS) + "]"


@query("f14_contrast_of", f"with k as (select volume_id, volume_id % 19 i, {SQL_KINDS}[(volume_id % 19) % 17 + 1] kind from fx_volumes) select volume_id, case when i >= 17 or kind in ('UNIT1','PD','t1w') then 'unknown' when kind in ('T2starw','T2star') then 'T2star(w)' when kind in ('MTon','MToff') then 'MTS' else kind end as contrast from k")
def _(t):
    kind = F.get(F.array(*map(F.lit, KINDS)), F.expr("int(volume_id % 19 % 17)"))
    name = F.when(F.expr("volume_id % 19 < 17"), F.concat(F.lit("ds__sub-1_"), kind, F.lit("__axial__s0001.png"))).otherwise(F.concat(F.lit("ds__sub-1_"), kind, F.lit("_axial.png")))
    return t.volumes.select("volume_id", n.contrast_of(name).alias("contrast"))


@query("f15_path_parts", f"with {SLICES}, f as (select volume_id, case when volume_id % 2 = 0 then 'train/ds'||(volume_id % 5)||'/'||sname else 'val/'||sname end p, sname from slices) select volume_id, case when len(string_split(p,'/')) >= 3 then string_split(p,'/')[2] else coalesce(nullif(regexp_extract(sname,'^([^_]+)__sub',1),''),'unknown') end as dataset, coalesce(nullif(regexp_extract(sname,'__(axial|sagittal)__',1),''),'unknown') as orientation, split_part(p,'/',1) as split from f")
def _(t):
    s = slices(t).withColumn("p", F.expr("if(volume_id % 2 = 0, concat('train/ds', volume_id % 5, '/', sname), concat('val/', sname))"))
    return s.select("volume_id", n.dataset_of(col("p"), col("sname")).alias("dataset"), n.orientation_of(col("sname")).alias("orientation"), n.split_of(col("p")).alias("split"))


@query("f16_strip_channel_suffix", "select sample_id, regexp_replace(x,'_0000$','') as stem from (select sample_id, split_part(name,'_',1)||case when sample_id % 2 = 0 then '_0000' else '_0001' end x from fx_samples)")
def _(t):
    return t.samples.select("sample_id", n.strip_channel_suffix(F.expr("concat(substring_index(name,'_',1), if(sample_id % 2 = 0,'_0000','_0001'))")).alias("stem"))


@query("f17_model_names", "select volume_id, m as model, 'patch_tokens_'||m||'_x' as key, 'cls_token_'||m||'_x' as cls_key from (select volume_id, case volume_id % 6 when 0 then 'name'||dataset when 1 then 'ckpt'||volume_id when 2 then 'net' when 3 then 'run' when 4 then 'DEADBEEF' else 'fm' end m from fx_volumes)")
def _(t):
    path = F.expr("case volume_id % 6 when 0 then concat('/hub/models--org--name', dataset, '/snapshots/', sha1(path)) when 1 then concat('/runs/ckpt', volume_id, '/') when 2 then '/a/net/refs' when 3 then '/a/run/snapshots/0123ABCDef' when 4 then 'snapshots/DEADBEEF' else '' end")
    m = n.model_short_name(path)
    return t.volumes.select("volume_id", m.alias("model"), n.feature_key(m, "x").alias("key"), n.feature_key(m, "x", "cls_token").alias("cls_key"))


@query("f18_parse_log_kv", f"select event_type as run, event_id as line_no, event_id as iter, date_trunc('second', ts)::timestamp as ts, unnest(['logger - INFO - Global Rank','Total Loss','LR','val/auc-macro','Iteration']) as key, unnest([0, printf('%.4f', value)::double, (event_id % 9||'.5e-0'||(1 + event_id % 5))::double, -((event_id % 7) + 0.25)::double, event_id::double]) as value from events")
def _(t):
    more = F.expr("concat(substring_index(line,'\tIteration',1), '\tLR: 7\tval/auc-macro: -', line_no % 7, '.25\tLR: ', line_no % 9, '.5e-0', 1 + line_no % 5, '\tMemory: 3/8\titeration: none', '\tIteration', substring_index(line,'\tIteration',-1))")
    return n.parse_log_kv(t.logs.withColumn("line", more))


@query("f19_parse_iteration_ts", "select event_id as line_no, case when event_id % 3 < 2 then event_id end as iter, date_trunc('second', ts)::timestamp as ts from events")
def _(t):
    line = F.expr("case line_no % 3 when 1 then replace(replace(line,'Iteration:','ITERATION: '),'/',' / ') when 2 then substring_index(line,'/',1) else line end")
    return t.logs.select("line_no", n.parse_iteration(line).alias("iter"), n.parse_ts(line).alias("ts"))


@query("f20_safe_name", "select volume_id, regexp_replace(regexp_replace('/'||path||'?','[^A-Za-z0-9._-]+','_','g'),'^_+|_+$','','g') as safe from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", n.safe_name(F.concat(F.lit("/"), "path", F.lit("?"))).alias("safe"))


@query("f21_hash_split", "select volume_id, case when ('0x'||substr(md5('42'||path),1,13))::bigint/power(16.0,13) < 0.8 then 'train' else 'val' end as split from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", n.hash_split(col("path"), 42, 0.8).alias("split"))


@query("f21_hash_split_exact")
def _(t):
    return t.volumes.select("volume_id", n.hash_split(col("path"), 42, 0.8, mode="exact").alias("split"))


@query("f22_params_fingerprint", "select volume_id, md5(dataset||'|'||nx||'|'||ny||'|'||nz) as fp from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", n.params_fingerprint(col("dataset"), col("nx"), col("ny"), col("nz")).alias("fp"))


@query("f23_json_field", "select label_id, severity, '{\"id\":'||label_id||',\"sev\":\"'||severity||'\"}' as js from fx_labels")
def _(t):
    j = F.to_json(F.struct(col("severity").alias("PathologySeverity")))
    return t.labels_fx.select("label_id", n.json_field(j, "PathologySeverity").alias("severity"), F.to_json(F.struct(col("label_id").alias("id"), col("severity").alias("sev"))).alias("js"))


@query("f24_round_n", "select event_id, round_even(value,4) as r4, round_even(value,6) as r6 from events")
def _(t):
    return t.events.select("event_id", n.round_n(col("value"), 4).alias("r4"), n.round_n(col("value"), 6).alias("r6"))
