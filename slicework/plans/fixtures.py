"""Views on the standard tables that stand in for image data: once for Spark, once as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name: source view or table, Spark expressions.
_SPARK = {
    "images": ("embeddings", ["vec_id image_id", "vec_id div 10 volume_id", "cast(vec_id % 10 as int) slice_idx", "label", "8 h", "8 w", "transform(embedding, x -> cast(x as double)) px"]),
    "masks": ("images", ["image_id", "transform(px, x -> if(image_id % 7 <> 0 and x > 0.05D, 1, 0)) gt_px", "transform(px, x -> if(image_id % 11 <> 0 and x > 0D, 1, 0)) pred_px"]),
    "predictions": ("images", ["image_id sample_id", "cast(image_id % 4 as int) run", "element_at(array('nfn','scs','ss'), cast(image_id % 3 as int)+1) task", "label % 3 y", "array(10*px[0],10*px[1],10*px[2]) logits"]),
    "volumes": (
        "part",
        [
            "p_partkey volume_id", "concat('ds',p_partkey % 5) dataset", "if(p_partkey % 4 = 2, 4D, 0.4D+(p_partkey % 5)*0.1D) dx", "if(p_partkey % 4 = 3, 4D, 0.4D+(p_partkey % 5)*0.1D) dy", "if(p_partkey % 4 = 1, 4D, 0.4D+(p_partkey % 5)*0.1D) dz",
            "cast(1+p_size % 8 as int) nx", "cast(1+p_size % 6 as int) ny", "cast(1+p_size % 5 as int) nz",
            "concat(if(p_partkey % 11 = 0,'derivatives/',''), format_string('sub-%05d/anat/sub-%05d_',p_partkey,p_partkey), if(p_partkey % 13 = 0,'dwi_',''), case p_type when 'ECONOMY' then 'T1w' when 'SMALL' then 'T2w' when 'MEDIUM' then 'T2star' when 'PROMO' then 'MTon' when 'STANDARD' then 'PSIR' else 'xyz' end, '.nii.gz') path",
        ],
    ),
    "folds": (
        "customer",
        [
            "format_string('sub-%06d',c_custkey) subject_id", "case when cast(conv(substring(md5(concat('t',c_custkey)),1,13),16,10) as bigint)/power(16D,13)<0.2 then '1' else '0' end is_test",
            "case when cast(conv(substring(md5(concat('a',c_custkey)),1,13),16,10) as bigint)/power(16D,13)<0.8 then 'train' else 'val' end regime_all_split_1_set",
            "case when cast(conv(substring(md5(concat('b',c_custkey)),1,13),16,10) as bigint)/power(16D,13)<0.04 then 'train' when cast(conv(substring(md5(concat('b',c_custkey)),1,13),16,10) as bigint)/power(16D,13)<0.06 then 'val' else '' end regime_50_split_1_set",
        ],
    ),
    "samples": ("orders", ["o_orderkey sample_id", "format_string('sub-%06d_acq-sag_rec-%d_T2w_desc-L%dL%d_label.npz',o_custkey,o_orderkey,1+o_orderkey % 4,2+o_orderkey % 4) name", "cast(substring(o_orderpriority,1,1) as string) class"]),
    "logs": ("events", ["event_id line_no", "event_type run", "concat(date_format(ts,'yyyy-MM-dd HH:mm:ss'),',000 - logger - INFO - Global Rank: 0 - Total Loss: ',format_string('%.4f',value),'\\tIteration: ',event_id,'/100000') line"]),
}

#: The same for the comparison, in order of dependence.
SQL = {
    "fx_images": "select vec_id image_id, vec_id // 10 volume_id, (vec_id % 10)::int slice_idx, label, 8 h, 8 w, embedding::double[] px from embeddings",
    "fx_masks": "select image_id, list_transform(px, lambda x: case when image_id % 7 <> 0 and x > 0.05 then 1 else 0 end) gt_px, list_transform(px, lambda x: case when image_id % 11 <> 0 and x > 0 then 1 else 0 end) pred_px from fx_images",
    "fx_predictions": "select image_id sample_id, (image_id % 4)::int run, ['nfn','scs','ss'][(image_id % 3)::int+1] task, label % 3 y, [10*px[1],10*px[2],10*px[3]] logits from fx_images",
    "fx_volumes": """select p_partkey volume_id, 'ds'||(p_partkey % 5) dataset, case when p_partkey % 4 = 2 then 4.0::double else 0.4::double+(p_partkey % 5)*0.1::double end dx, case when p_partkey % 4 = 3 then 4.0::double else 0.4::double+(p_partkey % 5)*0.1::double end dy, case when p_partkey % 4 = 1 then 4.0::double else 0.4::double+(p_partkey % 5)*0.1::double end dz,
 (1+p_size % 8)::int nx, (1+p_size % 6)::int ny, (1+p_size % 5)::int nz,
 (case when p_partkey % 11 = 0 then 'derivatives/' else '' end)||printf('sub-%05d/anat/sub-%05d_',p_partkey,p_partkey)||(case when p_partkey % 13 = 0 then 'dwi_' else '' end)||(case p_type when 'ECONOMY' then 'T1w' when 'SMALL' then 'T2w' when 'MEDIUM' then 'T2star' when 'PROMO' then 'MTon' when 'STANDARD' then 'PSIR' else 'xyz' end)||'.nii.gz' path from part""",
    "fx_labels": "select volume_id label_id, dataset, replace(path,'.nii.gz','_seg.nii.gz') path, ['Normal/Mild','Moderate','Severe'][(volume_id % 3)::int+1] severity from fx_volumes where volume_id % 4 <> 0 union all select -volume_id, dataset, 'sub-orphan'||volume_id||'_seg.nii.gz', 'Severe' from fx_volumes where volume_id % 50 = 0 and volume_id>0",
    "fx_folds": "select printf('sub-%06d',c_custkey) subject_id, case when ('0x'||substr(md5('t'||c_custkey),1,13))::bigint/power(16.0,13)<0.2 then '1' else '0' end is_test, case when ('0x'||substr(md5('a'||c_custkey),1,13))::bigint/power(16.0,13)<0.8 then 'train' else 'val' end regime_all_split_1_set, case when ('0x'||substr(md5('b'||c_custkey),1,13))::bigint/power(16.0,13)<0.04 then 'train' when ('0x'||substr(md5('b'||c_custkey),1,13))::bigint/power(16.0,13)<0.06 then 'val' else '' end regime_50_split_1_set from customer",
    "fx_samples": "select o_orderkey sample_id, printf('sub-%06d_acq-sag_rec-%d_T2w_desc-L%dL%d_label.npz',o_custkey,o_orderkey,1+o_orderkey % 4,2+o_orderkey % 4) as name, substr(o_orderpriority,1,1) class from orders",
    "fx_logs": "select event_id line_no, event_type run, strftime(ts,'%Y-%m-%d %H:%M:%S')||',000 - logger - INFO - Global Rank: 0 - Total Loss: '||printf('%.4f',value)||chr(9)||'Iteration: '||event_id||'/100000' line from events",
}


def with_views(body: str) -> str:
    """SQL whose body may use the views that it names."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, sql in SQL.items():
            if name in text and name not in needed:
                need(sql)
                if name not in needed:
                    needed.append(name)

    need(body)
    views = ", ".join(f"{n} as ({SQL[n]})" for n in needed)
    body = body.strip()
    if not views:
        return body
    return f"with {views}, {body[5:]}" if body[:5].lower() == "with " else f"with {views} {body}"


class Tables:
    """Tables of one folder and the views on them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "labels_fx":
            v = self.volumes
            own = v.where("volume_id % 4 <> 0").selectExpr("volume_id label_id", "dataset", "replace(path,'.nii.gz','_seg.nii.gz') path", "element_at(array('Normal/Mild','Moderate','Severe'), cast(volume_id % 3 as int)+1) severity")
            return own.unionByName(v.where("volume_id % 50 = 0 and volume_id > 0").selectExpr("-volume_id label_id", "dataset", "concat('sub-orphan',volume_id,'_seg.nii.gz') path", "'Severe' severity"))
        if name in _SPARK:
            source, columns = _SPARK[name]
            return getattr(self, source).selectExpr(*columns)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
