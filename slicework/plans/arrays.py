"""Queries on pixel arrays, masks and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.functions import pixels as px
from slicework.operators import segmentation as seg
from slicework.plans.registry import query

c = F.col


def P():
    return c("px")


def H():
    return c("h")


def W():
    return c("w")



def digest(a):
    """A number that changes with any element or its place."""
    return F.round(F.aggregate(F.transform(a, lambda v, i: v * (i + 1.0)), F.lit(0.0), lambda s, v: s + v), 6)


def D(a: str) -> str:
    return f"round(coalesce(list_sum(list_transform({a}, lambda v, i: v*i::double)),0),6)"


def simple(name: str, column, sql: str, view: str = "images", source: str = "fx_images", key: str = "image_id"):
    """A query of one digest for each row."""

    @query(name, f"select {key}, {D(sql)} as d from {source}")
    def _(t):
        return getattr(t, view).select(key, digest(column()).alias("d"))


Q = lambda p: f"list_aggregate(px,'quantile_cont',{p})"
simple("f25_to_uint8", lambda: px.to_uint8(P()), f"list_transform(px, lambda x: case when {Q(0.995)} > {Q(0.005)} then floor(255*greatest(0.0,least(1.0,(x-{Q(0.005)})/({Q(0.995)}-{Q(0.005)})))+0.5)::int else 0 end)")
simple("f26_labels_to_uint8", lambda: px.labels_to_uint8(F.transform(P(), lambda v: v * 900)), "list_transform(px, lambda x: greatest(0,least(255,round_even(x*900,0)))::int)")
simple("f27_zscore_pop", lambda: px.zscore(P()), "list_transform(px, lambda x: (x-list_avg(px))/(sqrt(list_sum(list_transform(px, lambda y: (y-list_avg(px))*(y-list_avg(px))))/len(px))+1e-6))")
simple("f27_zscore_sample", lambda: px.zscore(P(), ddof=1), "list_transform(px, lambda x: (x-list_avg(px))/(sqrt(list_sum(list_transform(px, lambda y: (y-list_avg(px))*(y-list_avg(px))))/(len(px)-1))+1e-6))")
SOFT = "list_transform(logits, lambda x: exp(x-list_max(logits)))"


@query("f28_softmax_family", f"select sample_id, {D(f'list_transform({SOFT}, lambda v: v/list_sum({SOFT}))')} as sm, {D(f'list_transform(logits, lambda v: v-list_max(logits)-ln(list_sum({SOFT})))')} as lsm, round(1/(1+exp(-logits[1])),6) as sg, (list_position(logits, list_max(logits))-1)::int as am from fx_predictions")
def _(t):
    x = c("logits")
    return t.predictions.select("sample_id", digest(px.softmax(x)).alias("sm"), digest(px.log_softmax(x)).alias("lsm"), F.round(px.sigmoid(x[0]), 6).alias("sg"), px.argmax(x).alias("am"))


simple("f29_minmax", lambda: px.minmax(P()), "list_transform(px, lambda x: (x-list_min(px))/(list_max(px)-list_min(px)+1e-7))")
simple("f30_standardize", lambda: px.standardize(P(), (0.0, 0.1), (0.5, 0.25)), "list_transform(px, lambda x, i: case when i % 2 = 1 then x/0.5 else (x-0.1)/0.25 end)")


@query("f31_resampled_size", "select volume_id, greatest(1, round_even(nx*dx/0.5,0)::int) as h, greatest(1, round_even(ny*dy/0.5,0)::int) as w from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", px.resampled_size(c("nx"), c("dx"), 0.5).alias("h"), px.resampled_size(c("ny"), c("dy"), 0.5).alias("w"))


@query("f32_overlap_px", "select volume_id, greatest(0,least(nx*28-1,round_even(nx*28*(ny*2.5)/100.0::double,0)::int)) as a, case when ny*20 < 100 then greatest(0,least(nz-1,round_even(nz*(ny*20)/100.0::double,0)::int)) end as b from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", px.overlap_of(c("nx") * 28, c("ny") * 2.5).alias("a"), px.overlap_of(c("nz"), c("ny") * 20).alias("b"))


@query("f33_sliding_positions", "select volume_id, array_to_string(case when n-20 <= 0 then [0] else list_sort(list_distinct(list_concat(range(0,n-20+1,15),[n-20]))) end,',') as pos from (select volume_id, (nx*ny*3)::bigint n from fx_volumes)")
def _(t):
    return t.volumes.select("volume_id", F.array_join(px.sliding_positions(c("nx") * c("ny") * 3, 20, 5), ",").alias("pos"))


def win(a: str, h: str, w: str, y0: str, x0: str, wh: str, ww: str) -> str:
    return f"[case when {y0}+i//({ww}) between 0 and {h}-1 and {x0}+i%({ww}) between 0 and {w}-1 then {a}[(({y0}+i//({ww}))*{w}+{x0}+i%({ww})+1)::int] else 0 end for i in range(({wh})*({ww}))]"


simple("f34_pad_centred", lambda: px.pad_centred(P(), H(), W(), 11, 12), win("px", "8", "8", "-1", "-2", "11", "12"))
TILES = "tl as (select image_id, (row_number() over (partition by image_id order by y0, x0)-1)::int as tile_id, y0, x0, px from fx_images, (values (0),(3),(4)) a(y0), (values (0),(3),(4)) b(x0))"


@query("f35_tile_explode", f"with {TILES} select image_id, tile_id, y0, x0, 4 as h, 4 as w, {D(win('px', '8', '8', 'y0', 'x0', '4', '4'))} as d from tl")
def _(t):
    out = px.tile_explode(t.images.select("image_id", "h", "w", "px"), tile=4, overlap_pct=25, threshold=6)
    return out.select("image_id", "tile_id", "y0", "x0", "h", "w", digest(P()).alias("d"))


simple("f36a_resize_mask_nearest", lambda: px.resize_mask(c("gt_px"), F.lit(8), F.lit(8), 6), "list_transform(range(36), lambda j: list_contains([ (i//8)*6//8*6+(i%8)*6//8 for i in range(64) if gt_px[i+1] > 0 ], j)::int)", "masks", "fx_masks")


@query("f36b_resize_mask_linear")
def _(t):
    from slicework.functions.kernels import resize_mask_linear

    return t.masks.select("image_id", digest(resize_mask_linear(6)(c("gt_px"), F.lit(8), F.lit(8))).alias("d"))


CROP = "(select image_id, px, m, list_position(m,1)-1 f from (select i.image_id, px, gt_px m from fx_images i join fx_masks using (image_id)))"


@query("f37_crop_mm", f"select image_id, {D(win('px', '8', '8', '(case when f is not null then f//8 else 4 end-2)', '(case when f is not null then f%8 else 4 end-2)', '5', '5'))} as d from {CROP}")
def _(t):
    j = t.images.join(t.masks, "image_id")
    return j.select("image_id", digest(px.crop_mm(P(), c("gt_px"), H(), W(), F.lit(2.0), 1.0)).alias("d"))


GRID = "list_transform(range(16), lambda q: list_max([gt_px[((q//4*2+i//2)*8+(q%4)*2+i%2+1)::int] for i in range(4)]))"
simple("f38_mask_to_grid", lambda: px.mask_to_grid(c("gt_px"), 8, 2), GRID, "masks", "fx_masks")
def TOK():
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("px", i * 4 + 1, F.lit(4)))
MEAN = "[list_sum([px[d+1+4*i] for i in range(16)])/16 for d in range(4)]"


@query("f39_masked_mean_pool", f"with j as (select i.image_id, px, {GRID} g from fx_images i join fx_masks using (image_id)) select image_id, {D(f'case when list_sum(g) > 0 then [list_sum([px[d+1+4*i]*g[i+1] for i in range(16)])/greatest(list_sum(g),1e-6) for d in range(4)] else {MEAN} end')} as d from j")
def _(t):
    g = F.transform(px.mask_to_grid(c("gt_px"), 8, 2), lambda v: v.cast("double"))
    return t.images.join(t.masks, "image_id").select("image_id", digest(px.masked_mean_pool(TOK(), g)).alias("d"))


simple("f40_mean_pool", lambda: px.mean_pool(TOK()), MEAN)


@query("f41_token_grid", "select image_id, 9 as n, round(list_sum(px[29:64]),6) as s from fx_images")
def _(t):
    g = px.token_grid(TOK(), 7)
    return t.images.select("image_id", F.size(g).alias("n"), F.round(px.total(F.flatten(g)), 6).alias("s"))


PLANE = "case when greatest(dx,dy,dz)/least(dx,dy,dz) <= 1.1 then 'isotropic' when dz > dx and dz > dy then 'axial' when dx > dy and dx > dz then 'sagittal' when dy > dx and dy > dz then 'coronal' else 'axial' end"


def classify_plane():
    from slicework.operators.volumes import classify_plane as f

    return f(c("dx"), c("dy"), c("dz"))


@query("f42_plane_slice", f"with v as (select *, {PLANE} plane from fx_volumes) select volume_id, 'axial' as slice_plane, k::int as slice_idx, ny as h, nx as w, dy as sp_h, dx as sp_w, list_sum([i*((i%nx)*ny*nz+(i//nx)*nz+k) for i in range(nx*ny)])::bigint as d from v, lateral (select unnest(range(nz)) k) where plane in ('axial','isotropic') union all select volume_id, 'sagittal', k::int, nz, ny, dz, dy, list_sum([i*(k*ny*nz+(i%ny)*nz+(i//ny)) for i in range(ny*nz)])::bigint from v, lateral (select unnest(range(nx)) k) where plane in ('sagittal','isotropic')")
def _(t):
    v = t.volumes.withColumn("plane", classify_plane()).withColumn("voxels", F.sequence(F.lit(0), c("nx") * c("ny") * c("nz") - 1))
    s = px.plane_slice(v)
    return s.select("volume_id", "slice_plane", "slice_idx", "h", "w", "sp_h", "sp_w", F.aggregate(F.transform("px", lambda x, i: (x * i).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("d"))


def bil(a: str) -> str:
    sy, sx = "(((i//6)+0.5)*8/5.0-0.5)", "(((i%6)+0.5)*8/6.0-0.5)"
    g = lambda dy, dx: f"{a}[(greatest(0,least(7,floor({sy})::int+{dy}))*8+greatest(0,least(7,floor({sx})::int+{dx}))+1)::int]"
    fy, fx = f"({sy}-floor({sy}))", f"({sx}-floor({sx}))"
    return f"[(1-{fy})*((1-{fx})*{g(0, 0)}+{fx}*{g(0, 1)})+{fy}*((1-{fx})*{g(1, 0)}+{fx}*{g(1, 1)}) for i in range(30)]"


@query("f43_resize_image", f"select image_id, {D(bil('px'))} as d from fx_images")
def _(t):
    return px.resize_image(t.images, 5, 6).select("image_id", digest(P()).alias("d"))


CUBIC = "case when abs(x) < 1 then 1.5*abs(x)**3-2.5*x*x+1 when abs(x) < 2 then -0.5*abs(x)**3+2.5*x*x-4*abs(x)+2 else 0 end"
#: Weights of 8 source places for 5 and for 12 targets: the filter is as wide as the step, if that is more than 1.
WEIGHTS = lambda n: f"(select t, u, {CUBIC} as w from (select t, u, (u+0.5-(t+0.5)*8.0/{n})/greatest(8.0/{n},1) as x from range({n}) a(t), range(8) b(u)) where u >= greatest(0,floor((t+0.5)*8.0/{n}-2*greatest(8.0/{n},1)+0.5)) and u < least(8,floor((t+0.5)*8.0/{n}+2*greatest(8.0/{n},1)+0.5)))"
F43B = f"with wy as (select t, u, w/sum(w) over (partition by t) as w from {WEIGHTS(5)}), wx as (select t, u, w/sum(w) over (partition by t) as w from {WEIGHTS(12)}), v as (select image_id, (unnest(range(64)))::bigint i, unnest(px) p from fx_images) select image_id, round(sum(p*wy.w*wx.w*(wy.t*12+wx.t)),6) as d from v join wy on wy.u = v.i // 8 join wx on wx.u = v.i % 8 group by 1"


@query("f43_resize_filtered", F43B.replace("**3", "^3"))
def _(t):
    from slicework.functions.kernels import resize_filtered

    out = t.images.select("image_id", resize_filtered(5, 12, "bicubic")(c("px"), c("h"), c("w")).alias("px"))
    return out.select("image_id", F.round(F.aggregate(F.transform("px", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v), 6).alias("d"))


simple("f44_binarise", lambda: px.binarise(P(), 0.05), "list_transform(px, lambda x: (x > 0.05)::int)")
EDGE = lambda m: f"[case when {m}[i+1] > 0 and least(case when i//8=0 then 0 else {m}[greatest(i-7,1)] end, case when i//8=7 then 0 else {m}[least(i+9,64)] end, case when i%8=0 then 0 else {m}[greatest(i,1)] end, case when i%8=7 then 0 else {m}[least(i+2,64)] end) <= 0 then 1 else 0 end for i in range(64)]"
simple("f45_boundary", lambda: px.boundary(c("gt_px"), F.lit(8), F.lit(8)), EDGE("gt_px"), "masks", "fx_masks")
simple("f46_overlay_code", lambda: px.overlay_code(c("gt_px"), c("pred_px")), "[gt_px[i]+2*pred_px[i] for i in range(1,65)]", "masks", "fx_masks")
simple("f47_top_left_crop", lambda: px.top_left_crop(P(), H(), W(), 10), win("px", "8", "8", "-1", "-1", "10", "10"))


@query("f48_inplane_spacing", "select volume_id, case when volume_id % 2 = 0 then (dy+dz)/2 else (dx+dy)/2 end as sp from fx_volumes")
def _(t):
    return t.volumes.select("volume_id", px.inplane_spacing(c("dx"), c("dy"), c("dz"), F.when(c("volume_id") % 2 == 0, 0).otherwise(2)).alias("sp"))


@query("p07_has_foreground", "select image_id, list_sum(gt_px) > 0 as fg from fx_masks")
def _(t):
    return t.masks.select("image_id", px.has_foreground(c("gt_px")).alias("fg"))


SEG = "sc as (select image_id, image_id % 7 as subject, list_sum([gt_px[i]*pred_px[i] for i in range(1,65)])::bigint tp, list_sum([(1-gt_px[i])*pred_px[i] for i in range(1,65)])::bigint fp, list_sum([gt_px[i]*(1-pred_px[i]) for i in range(1,65)])::bigint fn, list_sum([(1-gt_px[i])*(1-pred_px[i]) for i in range(1,65)])::bigint tn, list_sum(gt_px) > 0 as has_fg from fx_masks), sm as (select *, (2*tp+1e-7)/(2*tp+fp+fn+1e-7) dice, (tp+1e-7)/(tp+fp+fn+1e-7) iou, (tp+1e-7)/(tp+fp+1e-7) as prec, (tp+1e-7)/(tp+fn+1e-7) rec, (tn+1e-7)/(tn+fp+1e-7) spec from sc)"


@query("a18_segmentation_counts", f"with {SEG} select image_id, tp, fp, fn, tn, round(dice,6) as dice, round(iou,6) as iou, round(prec,6) as precision, round(rec,6) as recall, round(spec,6) as specificity, has_fg from sm")
def _(t):
    out = seg.seg_metrics(t.masks).drop("gt_px", "pred_px")
    return out.withColumns({m: F.round(m, 6) for m in ("dice", "iou", "precision", "recall", "specificity")})


HD = f"ba as (select image_id, i//8 y, i%8 x from (select image_id, unnest(range(64)) i, unnest({EDGE('gt_px')}) e from fx_masks) where e=1), bb as (select image_id, i//8 y, i%8 x from (select image_id, unnest(range(64)) i, unnest({EDGE('pred_px')}) e from fx_masks) where e=1), nd as (select a.image_id, min(sqrt((a.y-b.y)**2+(a.x-b.x)**2)) d from ba a join bb b using (image_id) group by a.image_id, a.y, a.x union all select b.image_id, min(sqrt((a.y-b.y)**2+(a.x-b.x)**2)) d from ba a join bb b using (image_id) group by b.image_id, b.y, b.x)"


@query("a19_hausdorff95", f"with {HD}, hd as (select image_id, quantile_cont(d,0.95) hd95 from nd group by 1) select m.image_id, case when list_sum(gt_px)=0 and list_sum(pred_px)=0 then 0.0 else round(hd95,6) end as hd95 from fx_masks m left join hd using (image_id)")
def _(t):
    return seg.hausdorff95(t.masks.withColumns({"h": F.lit(8), "w": F.lit(8)})).withColumn("hd95", F.round("hd95", 6))


@query("j15_nearest_boundary", f"with {HD} select image_id, count(*) as n, round(sum(d),6) as s from nd group by 1")
def _(t):
    m = t.masks.withColumns({"h": F.lit(8), "w": F.lit(8)})
    both = seg.nearest_boundary(m, "image_id", "gt_px", "pred_px").unionByName(seg.nearest_boundary(m, "image_id", "pred_px", "gt_px"))
    return both.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("d"), 6).alias("s"))


SEVEN = "round(avg(v),6) as mean, round(stddev_pop(v),6) as std, round(quantile_cont(v,0.5),6) as median, round(quantile_cont(v,0.25),6) as p25, round(quantile_cont(v,0.75),6) as p75, round(min(v),6) as min, round(max(v),6) as max, count(v) as n"


def seven(df):
    return df.withColumns({k: F.round(k, 6) for k in seg.SUMMARY})


@query("a20_seven_number_summary", f"with {SEG}, lg as (select unnest(['dice','iou']) metric, unnest([dice,iou]) v from sm) select metric, {SEVEN} from lg group by 1")
def _(t):
    return seven(seg.summarise(seg.seg_metrics(t.masks), ["dice", "iou"]))


@query("a21_summary_by_subject", f"with {SEG}, tg as (select 'all' subset, * from sm union all select 'foreground', * from sm where has_fg) select subset, 'dice' as metric, subject, {SEVEN.replace('(v', '(dice')} from tg group by grouping sets ((subset),(subset,subject))")
def _(t):
    return seven(seg.summary_by(seg.seg_metrics(t.masks).withColumn("subject", c("image_id") % 7), "subject", ["dice"]))


PROB = "pb as (select image_id, list_transform(px, lambda x: 1/(1+exp(-5*x))) p, gt_px t, list_transform(px, lambda x: 5*x) z from fx_images join fx_masks using (image_id))"


def probs(t):
    return t.images.join(t.masks, "image_id").select("image_id", F.transform("px", lambda v: 1 / (1 + F.exp(-5 * v))).alias("p"), F.transform("gt_px", lambda v: v.cast("double")).alias("t"), F.transform("px", lambda v: 5 * v).alias("z"))


@query("a23_soft_dice_loss", f"with {PROB} select round(1-avg((2*list_sum([p[i]*t[i] for i in range(1,65)])+1e-6)/(list_sum(p)+list_sum(t)+1e-6)),6) as dice_loss from pb")
def _(t):
    return seg.dice_loss(probs(t), "p", "t").select(F.round("dice_loss", 6).alias("dice_loss"))


@query("a24_hard_dice", f"with {PROB}, hb as (select list_transform(p, lambda x: (x>0.5)::int) p, t from pb) select round(avg((2*list_sum([p[i]*t[i] for i in range(1,65)])+1e-6)/(list_sum(p)+list_sum(t)+1e-6)),6) as dice from hb")
def _(t):
    return seg.dice_score(probs(t), "p", "t").select(F.round("dice", 6).alias("dice"))


@query("a25_bce_with_pos_weight", f"with {PROB} select round(sum(list_sum([3*t[i]*ln(1+exp(-z[i]))+(1-t[i])*ln(1+exp(z[i])) for i in range(1,65)]))/sum(len(z)),6) as bce from pb")
def _(t):
    return seg.bce_with_pos_weight(probs(t), "z", "t", 3.0).select(F.round("bce", 6).alias("bce"))


@query("a28_foreground_weights", "select image_id, 1.0::double + (list_sum(gt_px) > 0)::int as weight from fx_masks")
def _(t):
    return t.masks.select("image_id", (1.0 + px.has_foreground(c("gt_px")).cast("int")).alias("weight"))


@query("a29_pixel_mean_std", "select round(avg(v),6) as mean, round(stddev_pop(v),6) as std from (select unnest(px) v from fx_images)")
def _(t):
    s = seg.pixel_stats(t.images)
    return s.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("a30_stitch_tiles", f"select image_id, {D('px')} as d from fx_images")
def _(t):
    tiles = px.tile_explode(t.images.select("image_id", "h", "w", "px"), tile=4, overlap_pct=25, threshold=6)
    size = t.images.select("image_id", c("h").alias("height"), c("w").alias("width"))
    return seg.stitch(tiles, "image_id", size).select("image_id", digest(P()).alias("d"))


@query("a31_batch_pad_size", "select (volume_id//16)::bigint as batch, (ceil(max(nx*3)/8.0)*8)::int as pad_h, (ceil(max(ny*3)/8.0)*8)::int as pad_w from fx_volumes group by 1")
def _(t):
    v = t.volumes.select(F.expr("volume_id div 16").alias("batch"), (c("nx") * 3).alias("h"), (c("ny") * 3).alias("w"))
    return seg.batch_pad_size(v, "batch")


@query("o01_argmax_slice", "with n as (select i.volume_id, i.slice_idx, list_sum(gt_px)::int n_pos from fx_images i join fx_masks m using (image_id)) select volume_id, slice_idx, n_pos from n where n_pos > 0 qualify row_number() over (partition by volume_id order by n_pos desc, slice_idx) = 1")
def _(t):
    m = t.images.join(t.masks, "image_id").select("volume_id", "slice_idx", "gt_px")
    return seg.argmax_slice(m, "volume_id", "slice_idx", "gt_px").select("volume_id", "slice_idx", "n_pos")


@query("o05_overlay_examples", "select image_id from (select image_id, (list_sum(gt_px)=0 and list_sum(pred_px)=0) e from fx_masks) order by e, image_id limit 50")
def _(t):
    return seg.overlay_examples(t.masks, 50, "image_id").select("image_id")
