"""Queries on prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from slicework.operators import evaluation as ev
from slicework.plans.registry import query
from slicework.sources import sinks
from slicework.sources.tables import read_predictions

#: The comparison's building blocks: predictions with arg-max, softmax, and the confusion table.
P = "pr as (select *, list_position(logits, list_max(logits))-1 as p, list_transform(logits, lambda v: exp(v-list_max(logits))) as e from fx_predictions), sm as (select *, list_transform(e, lambda v: v/list_sum(e)) as s from pr)"
CM = P + ", cm as (select y, p, count(*) n from pr group by 1,2), cls as (select distinct c from (select y c from cm union all select p from cm)), pc as (select c, coalesce((select sum(n) from cm where y=c and p=c),0)::double tp, coalesce((select sum(n) from cm where y=c),0)::double t, coalesce((select sum(n) from cm where p=c),0)::double q from cls), f as (select c, tp, t, q, coalesce(tp/nullif(q,0),0) prec, coalesce(tp/nullif(t,0),0) rec, coalesce(2*tp/nullif(t+q,0),0) f1 from pc)"
R = lambda x: f"round({x},6)"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("a04_class_distribution", "with top as (select max(y) m from fx_predictions), s as (select unnest(generate_series(0,m))::int y from top) select s.y, count(f.y) as n from s left join fx_predictions f using (y) group by 1")
def _(t):
    return ev.class_distribution(t.predictions)


@query("a05_confusion_matrix", f"with {CM} select a.c as y, b.c as p, coalesce(n,0)::bigint as n, round(coalesce(n,0)::double/sum(coalesce(n,0)) over (partition by a.c),6) as share from cls a cross join cls b left join cm on cm.y=a.c and cm.p=b.c")
def _(t):
    return rounded(ev.confusion_matrix(t.predictions), "share").withColumns({"y": F.col("y").cast("bigint"), "p": F.col("p").cast("bigint")})


@query("a06_accuracy", f"with {P} select task, round(avg((y=p)::int),6) as accuracy from pr group by 1")
def _(t):
    return rounded(ev.accuracy(t.predictions, ["task"]), "accuracy")


@query("a07_balanced_accuracy", f"with {CM} select {R('avg(rec)')} as balanced_accuracy from f where t > 0")
def _(t):
    return rounded(ev.balanced_accuracy(t.predictions), "balanced_accuracy")


@query("a08_f1", f"with {CM} select {R('avg(f1)')} as f1_macro, {R('sum(f1*t)/sum(t)')} as f1_weighted from f")
def _(t):
    return rounded(ev.f1(t.predictions), "f1_macro", "f1_weighted")


@query("a09_classification_report", f"with {CM}, r as (select c::varchar as label, prec as precision, rec as recall, f1, t as support from f where t > 0 union all select 'accuracy', sum(tp)/sum(t), sum(tp)/sum(t), sum(tp)/sum(t), sum(t) from f where t > 0 union all select 'macro avg', avg(prec), avg(rec), avg(f1), sum(t) from f where t > 0 union all select 'weighted avg', sum(prec*t)/sum(t), sum(rec*t)/sum(t), sum(f1*t)/sum(t), sum(t) from f where t > 0) select label, {R('precision')} as precision, {R('recall')} as recall, {R('f1')} as f1, support from r")
def _(t):
    return rounded(ev.classification_report(t.predictions), "precision", "recall", "f1")


AG = CM + ", pos as (select c, row_number() over (order by c) i from cls), tot as (select sum(n)::double s from cm), g as (select a.i, b.i j, coalesce(n,0)::double o, x.t*z.q/s e from pos a cross join pos b join pc x on x.c=a.c join pc z on z.c=b.c left join cm on cm.y=a.c and cm.p=b.c cross join tot)"


@query("a10_cohen_kappa", f"with {AG} select {R('1-sum(case when i<>j then o else 0 end)/sum(case when i<>j then e else 0 end)')} as kappa from g")
def _(t):
    return rounded(ev.agreement(t.predictions).select("kappa"), "kappa")


@query("a11_quadratic_weighted_kappa", f"with {AG} select {R('1-sum(o*(i-j)*(i-j))/sum(e*(i-j)*(i-j))')} as qwk from g")
def _(t):
    return rounded(ev.agreement(t.predictions).select("qwk"), "qwk")


@query("a12_matthews_corrcoef", f"with {CM}, tot as (select sum(n)::double s from cm) select round(coalesce((sum(tp)*max(s)-sum(t*q))/nullif(sqrt((max(s)*max(s)-sum(q*q))*(max(s)*max(s)-sum(t*t))),0),0),6) as mcc from pc cross join tot")
def _(t):
    return rounded(ev.agreement(t.predictions).select("mcc"), "mcc")


@query("a13_cross_entropy", f"with {P} select {R('avg(-(logits[y+1]-list_max(logits)-ln(list_sum(e))))')} as cross_entropy from pr")
def _(t):
    return rounded(ev.cross_entropy(t.predictions), "cross_entropy")


WB = "avg(-[1.0,2.0,4.0][y+1]*ln(c[y+1]/list_sum(c)))"


@query("a14_weighted_cross_entropy", f"with {P}, cl as (select y, list_transform(s, lambda v: greatest(least(v,1.0),1e-7)) c from sm) select {R(WB)} as wbce from cl")
def _(t):
    return rounded(ev.weighted_cross_entropy(t.predictions), "wbce")


AUC = P + ", lg as (select y, unnest(range(len(s))) k, unnest(s) v from sm), rk as (select *, rank() over (partition by k order by v) + (count(*) over (partition by k, v) - 1)/2.0::double r from lg), au as (select k, sum((y=k)::int)::double np, (sum(case when y=k then r end)-sum((y=k)::int)*(sum((y=k)::int)+1)/2.0::double)/(sum((y=k)::int)::double*sum((y<>k)::int)) auc from rk group by k)"


@query("a15_auc_ovr", f"with {AUC} select {R('avg(auc)')} as auc_macro, {R('sum(auc*np)/sum(np)')} as auc_weighted from au")
def _(t):
    return rounded(ev.auc_ovr(t.predictions), "auc_macro", "auc_weighted")


def bundle(task: str, more: str = "") -> str:
    """All metrics of one task, by the formulas above."""
    own = AUC.replace("from fx_predictions", f"from fx_predictions where task = '{task}'{more}") + AG[len(P):]
    return f"select * from (with {own}, cl as (select y, list_transform(s, lambda v: greatest(least(v,1.0),1e-7)) c from sm) select '{task}' as task, (select {R('avg((y=p)::int)')} from pr) as accuracy, (select {R('avg(rec)')} from f where t>0) as balanced_accuracy, (select {R('avg(f1)')} from f) as f1_macro, (select {R('sum(f1*t)/sum(t)')} from f) as f1_weighted, (select {R('1-sum(case when i<>j then o else 0 end)/sum(case when i<>j then e else 0 end)')} from g) as kappa, (select {R('1-sum(o*(i-j)*(i-j))/sum(e*(i-j)*(i-j))')} from g) as qwk, (select round(coalesce((sum(tp)*max(s)-sum(t*q))/nullif(sqrt((max(s)*max(s)-sum(q*q))*(max(s)*max(s)-sum(t*t))),0),0),6) from pc cross join tot) as mcc, (select {R('avg(-(logits[y+1]-list_max(logits)-ln(list_sum(e))))')} from pr) as cross_entropy, (select {R(WB)} from cl) as wbce, (select {R('avg(auc)')} from au) as auc_macro, (select {R('sum(auc*np)/sum(np)')} from au) as auc_weighted)"


@query("a16_metric_bundle", " union all ".join(map(bundle, ("nfn", "scs", "ss"))))
def _(t):
    out = ev.evaluate(t.predictions, ["task"])
    return rounded(out, *[c for c in out.columns if c != "task"])


#: Every resample in full: its samples in ranks, with mid-ranks for ties.
BOOT = P + """, h as (select row_number() over (order by md5('42/'||sample_id), sample_id) - 1 i, y, (y=p)::int::double hit, s from sm), n as (select count(*) n from h),
gr as (select b.b, ('0x'||substr(md5('42/'||b.b||'/'||k.k),1,13))::bigint % n.n i from range(1000) b(b) cross join n cross join lateral (select unnest(range(n.n)) k) k),
d as (select b, y, hit, s from gr join h using (i)), acc as (select b, avg(hit) v from d group by 1),
lg as (select b, y, unnest(range(len(s))) k, unnest(s) v from d), rk as (select *, rank() over (partition by b, k order by v) + (count(*) over (partition by b, k, v) - 1)/2.0::double r from lg),
au as (select b, k, sum((y=k)::int)::double np, (sum(case when y=k then r end)-sum((y=k)::int)*(sum((y=k)::int)+1)/2.0::double)/nullif(sum((y=k)::int)::double*sum((y<>k)::int),0) auc from rk group by 1,2),
ab as (select b, case when count(auc) = count(*) then avg(auc) end m, case when count(auc) = count(*) then sum(auc*np)/sum(np) end w from au group by 1),
v as (select 'accuracy' as metric, v from acc union all select 'auc_macro', m from ab union all select 'auc_weighted', w from ab)"""


@query("a17_bootstrap_ci", f"with {BOOT} select metric, {R('avg(v)')} as mean, {R('quantile_cont(v,0.025)')} as ci_low, {R('quantile_cont(v,0.975)')} as ci_high, count(v) as n_draws from v group by 1")
def _(t):
    return rounded(ev.bootstrap_ci(t.predictions), "mean", "ci_low", "ci_high")


@query("a27_balanced_class_weights", "select class, round((sum(count(*)) over ())::double/((count(*) over ())*count(*)),6) as weight from fx_samples group by class")
def _(t):
    return rounded(ev.balanced_class_weights(t.samples, "class"), "weight")


@query("a26_sample_weighted_mean", "select event_type, round(sum(value*(1+user_id%5))/sum(1+user_id%5),6) as mean from events group by 1")
def _(t):
    return rounded(ev.weighted_mean(t.events.withColumn("size", 1 + F.col("user_id") % 5), "value", "size", ["event_type"]), "mean")


def last_run(task: str) -> str:
    """All metrics of a task's last run, and its number and size."""
    top = f"(select max(run) from fx_predictions where task = '{task}')"
    return f"select b.*, {top} as run, (select count(*) from fx_predictions where task = '{task}' and run = {top}) as n from ({bundle(task, f' and run = {top}').replace(',6)', ',9)')}) b"


@query("a32_regime_table", " union all ".join(map(last_run, ("nfn", "scs", "ss"))))
def _(t):
    out = ev.regime_table(t.predictions)
    return out.withColumns({x: F.round(x, 9) for x in out.columns if x not in ("task", "run", "n")})


@query("a33_all_tasks_present", "with g as (select *, sample_id*sample_id % 97 as g from fx_predictions) select g, task, count(*) as n from g where g in (select g from g group by g having count(distinct task) >= 3) group by 1,2")
def _(t):
    own = t.predictions.withColumn("g", F.col("sample_id") * F.col("sample_id") % 97)
    return ev.complete_groups(own, "g", "task", 3).groupBy("g", "task").agg(F.count(F.lit(1)).alias("n"))


ROUNDS = "".join(f", a{i} as (select sample, proto, score, q/sum(q) over (partition by proto)/k as q, k, n from b{i}), b{i + 1} as (select sample, proto, score, q/sum(q) over (partition by sample)/n as q, k, n from a{i})" for i in range(3))


@query("a34_balanced_assignment", f"with s as (select sample_id as sample, unnest(range(3)) as proto, unnest(logits) as score from fx_predictions), b0 as (select *, exp(score - max(score) over ()) as q, (select count(distinct proto) from s)::double k, (select count(distinct sample) from s)::double n from s){ROUNDS} select sample, proto::int as proto, round(score,6) as score, round(q*n,6) as q from b3")
def _(t):
    scores = t.predictions.select(F.col("sample_id").alias("sample"), F.posexplode("logits").alias("proto", "score"))
    return rounded(ev.sinkhorn(scores, 1.0), "score", "q")


@query("a35_ensemble_logits", "with lg as (select sample_id//4 as g, unnest(range(3)) c, unnest(logits) v from fx_predictions), m as (select g, c, avg(v) v from lg group by 1,2), a as (select g, list(v order by c) l from m group by 1) select g, (list_position(l, list_max(l))-1)::int as p, round(1/list_sum(list_transform(l, lambda x: exp(x-list_max(l)))),6) as prob from a")
def _(t):
    return rounded(ev.ensemble(t.predictions.withColumn("g", F.expr("sample_id div 4")), "g"), "prob")


@query("a36_distinct_values", "select 'task' as what, count(distinct task) as n from fx_predictions union all select 'label', count(distinct y) from fx_predictions")
def _(t):
    p = t.predictions
    return p.select("task").distinct().agg(F.lit("task").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(p.select("y").distinct().agg(F.lit("label").alias("what"), F.count(F.lit(1)).alias("n")))


@query("o04_order_predictions", "select sample_id, task, y from fx_predictions")
def _(t):
    return t.predictions.select("sample_id", "task", "y").orderBy("y", "sample_id")


@query("s11_read_predictions", "select run, task, count(*) as n, sum(y)::bigint as ys from fx_predictions group by 1,2")
def _(t):
    path = sinks.scratch(t.spark, "predictions")
    sinks.write_predictions(t.predictions, path)
    return read_predictions(t.spark, path).groupBy("run", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("ys"))
