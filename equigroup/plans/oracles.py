"""DuckDB SQL oracle per query name (same tables registered as views)."""

from __future__ import annotations

from equigroup.plans import sqlgen as S
from equigroup.plans.sqlgen import r6

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


# ---------------------------------------------------------------- 2.6 info
oracle("i1_entropy", S.entropy_sql(S.C_LINE, S.LINE_FEATURES))
oracle("i2_cmi", f"with {S.cmi_cte(S.C_LINE, S.LINE_FEATURES, 'l_returnflag')}\n"
                 f"select fi, fj, {r6('cmi')} as cmi from cmi")
oracle("i3_dissimilarity", f"with {S.cmi_cte(S.C_LINE, S.LINE_FEATURES, 'l_returnflag')}\n"
                           f"select fi, fj, {r6('dissimilarity')} as dissimilarity from dis")
oracle("i4_gram_centring", f"""with {S.cmi_cte(S.C_LINE, S.LINE_FEATURES, 'l_returnflag')},
full_m as (select fi, fj, dissimilarity * dissimilarity as d2 from dis
           union all select fj, fi, dissimilarity * dissimilarity from dis
           union all select feature, feature, 0.0 from ent),
rm as (select fi, avg(d2) as r from full_m group by fi),
g as (select avg(d2) as g from full_m)
select f.fi, f.fj, {r6('-0.5 * (f.d2 - a.r - b.r + g.g)')} as gram
from full_m f join rm a on a.fi = f.fi join rm b on b.fi = f.fj cross join g""")


def all_oracles():
    return dict(ORACLES)


# ---------------------------------------------------------------- 2.1/2.2 projections
H42 = "md5(concat(cast({k} as varchar), '|42'))"
PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
ORD_COLS = ["o_orderkey", "o_totalprice", "c_acctbal", "n_regionkey", "c_mktsegment", "o_orderpriority",
            "o_orderstatus"]
ALL_SET = " and ".join(f"{c} is not null" for c in ORD_COLS)

oracle("s1_load_cohort", S.C_ORD)
oracle("p1_numeric_columns", f"select o_orderkey, o_totalprice, c_acctbal from ({S.C_ORD}) t")
oracle("p2_drop_column", f"select o_orderkey, o_totalprice, c_acctbal, n_regionkey, o_orderpriority, "
                         f"o_orderstatus from ({S.C_ORD}) t")
oracle("p3_drop_null_rows", f"select * from ({S.C_NA}) t where {ALL_SET}")
oracle("p4_null_split", f"select o_orderkey, case when c_mktsegment is null then 'missing' else 'known' end as part "
                        f"from ({S.C_NA}) t")
oracle("p5_target_last", S.C_ORD)
oracle("p6_strip_prefix_int", "select c_custkey, try_cast(substr(c_name, 10) as bigint) as c_id from customer")
oracle("p7_null_audit", "select " + ", ".join(
    f"cast(count(*) filter (where {c} is null) as bigint) as {c}" for c in ORD_COLS) + f" from ({S.C_NA}) t")
oracle("p8_privileged_mask", f"select doc_id, lang, coalesce(lang = 'en', false) as privileged from ({S.C_PRED}) t")
oracle("p11_non_constant_features", f"with e as ({S.C_EMB}), v as (" + " union all ".join(
    f"select 'f{i}' as feature, var_samp(f{i}) as variance from e" for i in range(64)) +
    f") select feature, {r6('variance')} as variance from v where variance > 0")
oracle("p13_deviation_filter", f"""with d as ({S.C_PRED}),
g as (select coalesce(lang = 'en', false) as g, avg(p1) as mu from d group by 1)
select doc_id, lang, {r6('p1')} as p1, {r6('p1 - mu')} as deviation
from d join g on coalesce(d.lang = 'en', false) = g.g where abs(p1 - mu) > 0.05""")

# ---------------------------------------------------------------- 2.5 encoding
ONE_HOT = ", ".join(f"case when c_mktsegment = '{s}' then 1.0::double else 0.0::double end as \"c_mktsegment_{s}\""
                    for s in SEGMENTS)
PRIO_CASE = "case o_orderpriority " + " ".join(f"when '{p}' then {i}.0::double" for i, p in enumerate(PRIORITY)) + " end"
oracle("e1_one_hot", f"select o_orderkey, o_totalprice, c_acctbal, n_regionkey, o_orderpriority, o_orderstatus, "
                     f"{ONE_HOT} from ({S.C_ORD}) t")
oracle("e2_label_code", f"""with t as ({S.C_ORD}),
codes as (select o_orderstatus, cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as code
          from (select distinct o_orderstatus from t))
select o_orderkey, o_totalprice, c_acctbal, n_regionkey, c_mktsegment, o_orderpriority, codes.code as o_orderstatus
from t join codes using (o_orderstatus)""")
oracle("e3_ordinal_code", f"select o_orderkey, o_totalprice, c_acctbal, n_regionkey, c_mktsegment, "
                          f"{PRIO_CASE} as o_orderpriority, o_orderstatus from ({S.C_ORD}) t")
oracle("e4_ordinal_target", f"select o_orderkey, cast(case o_orderstatus when 'F' then 0 when 'O' then 1 "
                            f"else -1 end as integer) as o_orderstatus from ({S.C_ORD}) t")
oracle("e5_encode_list", f"""with t as ({S.C_ORD}),
codes as (select o_orderstatus, cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as code
          from (select distinct o_orderstatus from t))
select o_orderkey, o_totalprice, c_acctbal, n_regionkey, o_orderpriority, codes.code as o_orderstatus, {ONE_HOT}
from t join codes using (o_orderstatus)""")
oracle("e6_cohort_spec", f"""with t as ({S.C_ORD}),
codes as (select o_orderstatus, cast(dense_rank() over (order by o_orderstatus) - 1 as integer) as code
          from (select distinct o_orderstatus from t))
select o_orderkey, o_totalprice, c_acctbal, n_regionkey, {PRIO_CASE} as o_orderpriority, {ONE_HOT},
       codes.code as o_orderstatus
from t join codes using (o_orderstatus)""")
oracle("e7_zscore", f"""with t as ({S.C_ORD}),
m as (select avg(o_totalprice) as m1, stddev_pop(o_totalprice) as s1, avg(c_acctbal) as m2, stddev_pop(c_acctbal) as s2 from t)
select o_orderkey, {r6('(o_totalprice - m1) / case when s1 = 0 or s1 is null then 1.0 else s1 end')} as o_totalprice,
       {r6('(c_acctbal - m2) / case when s2 = 0 or s2 is null then 1.0 else s2 end')} as c_acctbal
from t cross join m""")

# ---------------------------------------------------------------- 2.3 splits
M1_CTE = f"""raw as ({S.C_NA}),
clean as (select * from raw where {ALL_SET}),
cnt as (select (select count(*) from raw) as n_raw, (select count(*) from clean) as n_clean),
take as (select cast(round_even(0.2 * n_raw / n_clean * n_clean, 0) as bigint) as k from cnt),
test0 as (select c.* exclude (pos) from (select *, row_number() over (order by {H42.format(k='o_orderkey')}) - 1 as pos
          from clean) c, take where pos < k),
train_raw as (select * from raw where o_orderkey not in (select o_orderkey from test0))"""
oracle("m1_test_draw", f"with {M1_CTE} select o_orderkey from test0")
oracle("m2_train_minus_test", f"with {M1_CTE} select o_orderkey from train_raw")
oracle("m3_disjoint_check", f"with {M1_CTE} select cast(count(*) as bigint) as n_overlap from train_raw "
                            f"where o_orderkey in (select o_orderkey from test0)")
oracle("m4_stratified_holdout", f"""with d as ({S.C_DOC}),
r as (select doc_id, quality, row_number() over (partition by quality order by {H42.format(k='doc_id')}) - 1 as pos,
      count(*) over (partition by quality) as n from d)
select doc_id, quality, pos < round(0.15 * n, 0) as is_test from r""")
oracle("m5_random_holdout", f"select doc_id, substr({H42.format(k='doc_id')}, 1, 8) < '33333333' as is_test "
                            f"from ({S.ALL_DOC}) d")
oracle("m6_stratified_kfold", f"""with d as ({S.C_DOC})
select doc_id, quality, cast((row_number() over (partition by quality order by {H42.format(k='doc_id')}) - 1) % 5 as integer) as fold
from d""")
oracle("m7_repeated_kfold", f"""with d as ({S.C_DOC}), reps as (select cast(range as integer) as repeat from range(10))
select doc_id, repeat, cast((row_number() over (partition by repeat, quality
         order by md5(concat(cast(doc_id as varchar), '|', cast(42 + repeat as varchar)))) - 1) % 5 as integer) as fold
from d cross join reps""")
oracle("m8_bootstrap_draw", f"""with d as ({S.ALL_DOC}),
r as (select doc_id, row_number() over (order by md5(concat(cast(doc_id as varchar), '|42'))) - 1 as pos from d),
n as (select count(*) as n from d),
draws as (select range as draw, ('0x' || substr(md5(concat(cast(range as varchar), '|42')), 1, 8))::bigint % n as pos
          from range(300), n)
select draw, doc_id from draws join r using (pos)""")

# ---------------------------------------------------------------- 2.4 joins
oracle("j1_key_join", S.C_DOC)
oracle("j2_anti_join", "select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
oracle("j3_vertical_concat", f"""with d as ({S.C_DOC}),
r as (select doc_id, quality, row_number() over (partition by quality order by {H42.format(k='doc_id')}) - 1 as pos,
      count(*) over (partition by quality) as n from d)
select doc_id, quality, case when pos < round(0.15 * n, 0) then 'validation' else 'train' end as part from r""")
oracle("j4_origin_union", f"""with d as ({S.ALL_DOC})
select doc_id, n_chars, source, 0 as origin from d
union all select doc_id, n_chars, source, 1 as origin from d where lang <> 'en'""")

# ---------------------------------------------------------------- E10 flow
E10_ENC = """select o_orderkey, o_totalprice, c_acctbal, cast(n_regionkey as double) as n_regionkey,
   {prio} as o_orderpriority, {onehot}, cast(codes.code as double) as o_orderstatus
   from {src} join codes using (o_orderstatus)"""
oracle("e10_prepare", f"""with {M1_CTE},
train0 as (select * from train_raw where {ALL_SET}),
codes as (select o_orderstatus, dense_rank() over (order by o_orderstatus) - 1 as code
          from (select distinct o_orderstatus from train0)),
tr as ({E10_ENC.format(prio=PRIO_CASE, onehot=ONE_HOT, src='train0')}),
te as ({E10_ENC.format(prio=PRIO_CASE, onehot=ONE_HOT, src='test0')}),
m as (select avg(o_totalprice) a1, stddev_pop(o_totalprice) s1, avg(c_acctbal) a2, stddev_pop(c_acctbal) s2,
             avg(n_regionkey) a3, stddev_pop(n_regionkey) s3, avg(o_orderpriority) a4, stddev_pop(o_orderpriority) s4 from tr),
z as (select 'train' as split, * from tr union all select 'test', * from te),
zz as (select split, (o_totalprice - a1) / (case when s1 = 0 then 1 else s1 end) as o_totalprice,
          (c_acctbal - a2) / (case when s2 = 0 then 1 else s2 end) as c_acctbal,
          (n_regionkey - a3) / (case when s3 = 0 then 1 else s3 end) as n_regionkey,
          (o_orderpriority - a4) / (case when s4 = 0 then 1 else s4 end) as o_orderpriority,
          {', '.join(f'"c_mktsegment_{s}"' for s in SEGMENTS)}, o_orderstatus from z cross join m)
select split, cast(count(*) as bigint) as n_rows, {r6('sum(o_totalprice)')} as sum_o_totalprice,
  {r6('sum(c_acctbal)')} as sum_c_acctbal, {r6('sum(n_regionkey)')} as sum_n_regionkey,
  {r6('sum(o_orderpriority)')} as sum_o_orderpriority,
  {', '.join(r6(f'sum("c_mktsegment_{s}")') + f' as "sum_c_mktsegment_{s}"' for s in SEGMENTS)},
  {r6('sum(o_orderstatus)')} as sum_o_orderstatus
from zz group by split""")


# ---------------------------------------------------------------- 2.7 grouping
WIDE = S.cmi_cte_wide(S.C_EMB_BINNED, S.EMB, "label", "vec_id")
ASSIGN5 = """feats as (select fi as feature from dis union select fj from dis),
assign as (select feature, cast((row_number() over (order by md5(concat(feature, '|42')), feature) - 1) % 5 as integer)
           as group_id from feats),
q as (select a.group_id, avg(d.dissimilarity) as diversity, min(d.dissimilarity) as dispersion
      from dis d join assign a on a.feature = d.fi join assign b on b.feature = d.fj and a.group_id = b.group_id
      group by a.group_id),
sz as (select group_id, count(*) as n_features from assign group by group_id),
qual as (select sz.group_id, sz.n_features, q.diversity, q.dispersion from sz left join q using (group_id))"""
oracle("i3_dissimilarity_wide", f"with {WIDE} select fi, fj, {r6('dissimilarity')} as dissimilarity from dis")
oracle("g1_random_grouping", f"with {WIDE}, {ASSIGN5} select group_id, feature from assign")
oracle("g3_diversity", f"with {WIDE}, {ASSIGN5} select group_id, cast(n_features as bigint) as n_features, "
                       f"{r6('diversity')} as diversity from qual")
oracle("g4_dispersion", f"with {WIDE}, {ASSIGN5} select group_id, {r6('dispersion')} as dispersion from qual")
oracle("g5_score", f"with {WIDE}, {ASSIGN5} select {r6('case when count(diversity) = 5 then 0.5 * sum(diversity) + 0.5 * min(dispersion) end')} as score from qual")
oracle("g6_grouping_report", f"""with {WIDE}, {ASSIGN5},
rng as (select min(dissimilarity) as lo, max(dissimilarity) as hi from dis)
select {r6('avg(diversity)')} as avg_diversity, {r6('min(dispersion)')} as min_dispersion,
  {r6('(avg(diversity) - min(lo)) / nullif(min(hi) - min(lo), 0)')} as avg_diversity_norm,
  {r6('(min(dispersion) - min(lo)) / nullif(min(hi) - min(lo), 0)')} as min_dispersion_norm
from qual cross join rng""")
oracle("g11_k_sweep", f"""with {WIDE},
feats as (select fi as feature from dis union select fj from dis),
ks as (select cast(range as integer) as k from range(2, 11)),
assign as (select k, feature, cast((row_number() over (partition by k order by md5(concat(feature, '|42')), feature) - 1) % k
           as integer) as group_id from feats cross join ks),
q as (select a.k, a.group_id, avg(d.dissimilarity) as diversity, min(d.dissimilarity) as dispersion
      from dis d join assign a on a.feature = d.fi join assign b on b.feature = d.fj and a.k = b.k and a.group_id = b.group_id
      group by a.k, a.group_id),
sz as (select k, group_id from assign group by k, group_id),
qual as (select sz.k, q.diversity, q.dispersion from sz left join q using (k, group_id))
select k, {r6('avg(diversity)')} as avg_diversity, {r6('min(dispersion)')} as min_dispersion from qual group by k""")
oracle("g2_greedy_seeds", f"""with {WIDE},
full_m as (select fi, dissimilarity as d from dis union all select fj, dissimilarity from dis),
rs as (select fi as feature, sum(d) as row_sum from full_m group by fi),
r as (select *, row_number() over (order by row_sum desc, feature) - 1 as rk from rs)
select cast(4 - rk as integer) as group_id, feature, {r6('row_sum')} as row_sum from r where rk < 5""")
oracle("g9_feature_gram", f"""with src as ({S.C_EMB}),
lv as (select vec_id, feature, v from (unpivot src on {', '.join(S.EMB)} into name feature value v))
select a.feature as fi, b.feature as fj, {r6('sum(a.v * b.v)')} as gram
from lv a join lv b on a.vec_id = b.vec_id and a.feature <= b.feature group by a.feature, b.feature""")
oracle("g10_moments", f"""with src as ({S.C_EMB}),
lv as (select feature, v from (unpivot src on {', '.join(S.EMB)} into name feature value v)),
mu as (select feature, avg(v) as m from lv group by feature),
c as (select feature, avg(power(v - m, 2)) as m2, avg(power(v - m, 3)) as m3, avg(power(v - m, 4)) as m4
      from lv join mu using (feature) group by feature)
select feature, {r6('m3 / power(m2, 1.5)')} as skewness, {r6('m4 / (m2 * m2) - 3.0')} as kurtosis from c""")


# ---------------------------------------------------------------- 2.10 metrics
PER_CLASS = """conf as (select y_true, y_pred, count(*) as n from d group by y_true, y_pred),
labs as (select y_true as c from conf union select y_pred from conf),
pc as (select c, sum(case when y_true = c and y_pred = c then n else 0 end) as tp,
              sum(case when y_pred = c and y_true <> c then n else 0 end) as fp,
              sum(case when y_true = c and y_pred <> c then n else 0 end) as fn
       from labs cross join conf group by c),
mac as (select avg(case when tp + fp > 0 then tp / (tp + fp) else 0.0 end) as macro_precision,
               avg(case when 2 * tp + fp + fn > 0 then 2.0 * tp / (2 * tp + fp + fn) else 0.0 end) as macro_f1 from pc)"""
AUC = """lab as (select count(distinct y_true) as k, max(y_true) as pos from d),
rk as (select y_true, rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2.0 as mr
       from d where {s} is not null),
au as (select case when (select k from lab) = 2 then
          (sum(case when y_true = (select pos from lab) then mr else 0 end)
           - count(*) filter (where y_true = (select pos from lab)) * (count(*) filter (where y_true = (select pos from lab)) + 1) / 2.0)
          / (count(*) filter (where y_true = (select pos from lab)) * count(*) filter (where y_true <> (select pos from lab)))
          end as roc_auc from rk)"""
oracle("v1_accuracy", f"select {r6('avg(case when y_true = y_pred then 1.0 else 0.0 end)')} as accuracy from ({S.C_PRED}) d")
oracle("v2_macro_f1", f"with d as ({S.C_PRED3}), {PER_CLASS} select {r6('macro_f1')} as macro_f1 from mac")
oracle("v3_macro_precision", f"with d as ({S.C_PRED3}), {PER_CLASS} select {r6('macro_precision')} as macro_precision from mac")
oracle("v4_roc_auc", f"with d as ({S.C_PRED}), {AUC.format(s='p1')} select {r6('roc_auc')} as roc_auc from au")
oracle("v5_metric_record", f"""with d as ({S.C_PRED}), {PER_CLASS}, {AUC.format(s='p1')}
select 'LengthRule' as "Model", {r6('(select avg(case when y_true = y_pred then 1.0 else 0.0 end) from d)')} as "Accuracy",
  {r6('macro_precision')} as "Precision", {r6('macro_f1')} as "F1-score", {r6('roc_auc')} as "ROC AUC" from mac, au""")
oracle("v5_metric_record_nulls", f"""with d0 as (select case when o_orderkey % 7 = 0 then null else y_true end as y_true,
    case when o_orderkey % 11 = 0 then null else y_pred end as y_pred, cast(y_pred as double) as score from ({S.C_PRED3}) t),
d as (select * from d0 where y_true is not null and y_pred is not null), {PER_CLASS}
select 'PriceRule' as "Model", {r6('(select avg(case when y_true = y_pred then 1.0 else 0.0 end) from d)')} as "Accuracy",
  {r6('macro_precision')} as "Precision", {r6('macro_f1')} as "F1-score", cast(null as double) as "ROC AUC" from mac""")
oracle("v5_metric_record_multiclass", f"""with d as (select *, cast(y_pred as double) as score from ({S.C_PRED3}) t),
{PER_CLASS}, {AUC.format(s='score')}
select 'PriceRule' as "Model", {r6('(select avg(case when y_true = y_pred then 1.0 else 0.0 end) from d)')} as "Accuracy",
  {r6('macro_precision')} as "Precision", {r6('macro_f1')} as "F1-score", {r6('roc_auc')} as "ROC AUC" from mac, au""")

# ---------------------------------------------------------------- 2.11 fairness
RATES = """g as (select priv as privileged,
    cast(sum(case when y_true in (0, 1) and y_pred in (0, 1) and y_true = 1 and y_pred = 1 then 1 else 0 end) as bigint) as tp,
    cast(sum(case when y_true in (0, 1) and y_pred in (0, 1) and y_true = 0 and y_pred = 1 then 1 else 0 end) as bigint) as fp,
    cast(sum(case when y_true in (0, 1) and y_pred in (0, 1) and y_true = 0 and y_pred = 0 then 1 else 0 end) as bigint) as tn,
    cast(sum(case when y_true in (0, 1) and y_pred in (0, 1) and y_true = 1 and y_pred = 0 then 1 else 0 end) as bigint) as fn,
    avg(case when y_pred = 1 then 1.0 else 0.0 end) as positive_rate,
    stddev_samp(case when y_true <> y_pred then 1.0 else 0.0 end) as error_std
  from d group by priv),
r as (select privileged, tp, fp, tn, fn, tp / (tp + fn + 1e-6) as tpr, fp / (fp + tn + 1e-6) as fpr,
        tp / (tp + fp + 1e-6) as precision, (fp + fn) / (tp + tn + fp + fn + 1e-6) as error_rate,
        positive_rate, error_std from g),
pr as (select max(case when privileged then tpr end) as tpr_p, max(case when not privileged then tpr end) as tpr_u,
          max(case when privileged then fpr end) as fpr_p, max(case when not privileged then fpr end) as fpr_u,
          max(case when privileged then precision end) as pre_p, max(case when not privileged then precision end) as pre_u,
          max(case when privileged then error_rate end) as er_p, max(case when not privileged then error_rate end) as er_u,
          max(case when privileged then positive_rate end) as pos_p, max(case when not privileged then positive_rate end) as pos_u,
          max(case when privileged then error_std end) as sd_p, max(case when not privileged then error_std end) as sd_u from r),
fr as (select case when pos_p <> 0 then pos_u / pos_p end as di, abs(tpr_p - tpr_u) as eo,
          greatest(abs(tpr_p - tpr_u), abs(fpr_p - fpr_u)) as eodds, abs(pre_p - pre_u) as pp,
          case when sqrt((sd_p * sd_p + sd_u * sd_u) / 2) > 0 then abs(er_p - er_u) / sqrt((sd_p * sd_p + sd_u * sd_u) / 2) end as ns
       from pr)"""
PRED_PRIV = f"d as (select *, coalesce(lang = 'en', false) as priv from ({S.C_PRED}) t)"
FR_COLS = (f"{r6('di')} as \"Disparate Impact\", {r6('eo')} as \"Equal Opportunity\", {r6('eodds')} as \"Equalized Odds\", "
           f"{r6('pp')} as \"Predictive Parity\", {r6('ns')} as \"N-Sigma (ErrorRate)\"")
oracle("f1_group_rates", f"with {PRED_PRIV}, {RATES} select privileged, tp, fp, tn, fn, {r6('tpr')} as tpr, "
                         f"{r6('fpr')} as fpr, {r6('precision')} as precision, {r6('error_rate')} as error_rate from r")
oracle("f2_disparate_impact", f"with {PRED_PRIV}, {RATES} select {r6('di')} as \"Disparate Impact\" from fr")
oracle("f3_equal_opportunity", f"with {PRED_PRIV}, {RATES} select {r6('eo')} as \"Equal Opportunity\" from fr")
oracle("f4_equalized_odds", f"with {PRED_PRIV}, {RATES} select {r6('eodds')} as \"Equalized Odds\" from fr")
oracle("f5_predictive_parity", f"with {PRED_PRIV}, {RATES} select {r6('pp')} as \"Predictive Parity\" from fr")
oracle("f6_n_sigma", f"with {PRED_PRIV}, {RATES} select {r6('ns')} as \"N-Sigma (ErrorRate)\" from fr")
oracle("f11_fairness_record_multiclass",
       f"with d as (select *, coalesce(c_mktsegment = 'BUILDING', false) as priv from ({S.C_PRED3}) t), {RATES} "
       f"select {FR_COLS} from fr")

DOC_FEAT = f"""df as (select doc_id, lang, quality as y_true, case when n_chars > 1500 then 1 else 0 end as y_pred,
  1.0 / (1.0 + exp(-(n_chars - 1500) / 1000.0)) as p1, n_chars, toxic,
  case when lang = 'en' then 1.0 else 0.0 end as is_en from ({S.C_DOC}) c),
bg as (select avg(cast(n_chars as double)) as m_n, avg(cast(toxic as double)) as m_t, avg(is_en) as m_e from df),
attr as (select doc_id, 1 as class, 'n_chars' as feature, 0.001 * (n_chars - m_n) as phi from df, bg
         union all select doc_id, 1, 'toxic', -0.5 * (toxic - m_t) from df, bg
         union all select doc_id, 1, 'is_en', 0.2 * (is_en - m_e) from df, bg),
mu as (select coalesce(lang = 'en', false) as priv, avg(p1) as mu from df group by 1),
pts as (select df.doc_id, coalesce(df.lang = 'en', false) as privileged, a.phi as x, df.p1 - mu.mu as y
        from df join mu on coalesce(df.lang = 'en', false) = mu.priv
        join attr a on a.doc_id = df.doc_id and a.feature = 'is_en' and a.class = 1
        where abs(df.p1 - mu.mu) > 0.05)"""
oracle("f7_explanation_bias", f"""with {DOC_FEAT}
select a.feature, {r6('abs(avg(case when coalesce(df.lang = ' + "'en'" + ', false) then a.phi end) - avg(case when not coalesce(df.lang = ' + "'en'" + ', false) then a.phi end))')} as bias
from attr a join df using (doc_id) group by a.feature""")
oracle("f8_instance_bias", f"""with {DOC_FEAT}
select cast(count(*) as bigint) as n_points, {r6('avg(sqrt(x * x + y * y))')} as "Average distance from origin" from pts""")
oracle("f8_quadrants", f"""with {DOC_FEAT}
select privileged, cast(sign(x) as integer) as x_sign, cast(sign(y) as integer) as y_sign, cast(count(*) as bigint) as n
from pts group by all""")
oracle("f11_fairness_record", f"""with {DOC_FEAT}, d as (select *, coalesce(lang = 'en', false) as priv from df), {RATES}
select {FR_COLS}, {r6('(select avg(sqrt(x * x + y * y)) from pts)')} as "Average distance from origin" from fr""")


# ---------------------------------------------------------------- 2.12 attribution / 2.8 apply
from equigroup import fixed_weights as W  # noqa: E402

COEF_VALUES = ", ".join(f"('f{i}', {W.emb_coef(i)!r})" for i in range(64))
EMB_ATTR = f"""src as ({S.C_EMB}),
lv as (select vec_id, feature, v from (unpivot src on {', '.join(S.EMB)} into name feature value v)),
bg as (select feature, avg(v) as m from lv group by feature),
co as (select * from (values {COEF_VALUES}) t(feature, c)),
attr as (select vec_id, 1 as class, feature, c * (v - m) as phi from lv join bg using (feature) join co using (feature)
         union all select vec_id, 0 as class, feature, -c * (v - m) as phi from lv join bg using (feature) join co using (feature)),
rng as (select class, feature, quantile_cont(phi, 0.95) - quantile_cont(phi, 0.05) as range from attr group by class, feature)"""
oracle("a1_linear_attribution", f"with {EMB_ATTR} select vec_id, class, feature, {r6('phi')} as phi from attr")
oracle("a5_feature_ranges", f"""with {EMB_ATTR}
select class, feature, {r6('range')} as range,
  cast(row_number() over (partition by class order by range desc, feature) as integer) as rank from rng""")
oracle("a5_feature_ranges_nulls", f"""with {EMB_ATTR.rsplit("rng as", 1)[0]}
rng as (select class, feature, quantile_cont(phi, 0.75) - quantile_cont(phi, 0.1) as range from attr where vec_id % 5 <> 0 group by class, feature)
select class, feature, {r6('range')} as range,
  cast(row_number() over (partition by class order by range desc, feature) as integer) as rank from rng""")
oracle("a5_range_stats", f"""with {EMB_ATTR}
select class, {r6('max(range)')} as max, {r6('min(range)')} as min, {r6('avg(range)')} as mean,
  {r6('stddev_pop(range)')} as std from rng group by class""")
oracle("a6_collapse_classes", f"with {EMB_ATTR} select vec_id, feature, {r6('sum(abs(phi))')} as phi from attr "
                              f"group by vec_id, feature")
oracle("a8_importance_top", f"""with {EMB_ATTR},
imp as (select class, feature, avg(abs(phi)) as importance from attr group by class, feature),
rk as (select *, cast(row_number() over (partition by class order by importance desc, feature) as integer) as rank from imp)
select class, feature, {r6('importance')} as importance, rank from rk where rank <= 10""")


def _latent_sql() -> tuple[str, list[str]]:
    """Per-row latent columns from the fixed encoder weights."""
    names, exprs = [], []
    for g in range(W.EMB_GROUPS):
        nd = W.emb_dims(g)
        for d in range(nd):
            terms = " + ".join(f"{W.enc_w(g, i, d)!r} * ((f{i} - m_f{i}) / s_f{i})"
                               for i in range(64) if W.emb_group_of(i) == g)
            name = f"group_{g}" if nd == 1 else f"group_{g}_dim{d}"
            names.append(name)
            exprs.append(f"greatest(0.0, {terms} + {W.enc_b(g, d)!r}) as {name}")
    return ", ".join(exprs), names


LAT_EXPR, LAT_NAMES = _latent_sql()
MOM = ", ".join(f"avg(f{i}) as m_f{i}, coalesce(nullif(stddev_pop(f{i}), 0.0), 1.0) as s_f{i}" for i in range(64))
LAT_CTE = f"""e as ({S.C_EMB}), mom as (select {MOM} from e),
lat as (select vec_id, {', '.join(f'f{i}' for i in range(64))}, {', '.join(f'm_f{i}, s_f{i}' for i in range(64))},
        {LAT_EXPR} from e cross join mom)"""
oracle("b3_encode_latent", f"with {LAT_CTE} select vec_id, " + ", ".join(f"{r6(n)} as {n}" for n in LAT_NAMES) + " from lat")


def _recon_sql() -> str:
    errs = []
    for i in range(64):
        g = W.emb_group_of(i)
        nd = W.emb_dims(g)
        xhat = " + ".join(f"{W.dec_w(g, d, i)!r} * {('group_%d' % g) if nd == 1 else ('group_%d_dim%d' % (g, d))}"
                          for d in range(nd))
        errs.append(f"power((f{i} - m_f{i}) / s_f{i} - ({xhat} + 0.0), 2)")
    return f"({' + '.join(errs)}) / 64.0"


oracle("b5_reconstruction_mse", f"with {LAT_CTE} select {r6('avg(' + _recon_sql() + ')')} as mse from lat")


def _decompose_sql() -> str:
    lphi = []
    for g in range(W.EMB_GROUPS):
        nd = W.emb_dims(g)
        for d in range(nd):
            n = f"group_{g}" if nd == 1 else f"group_{g}_dim{d}"
            lphi.append(f"select vec_id, {g} as group_id, {d} as dim, {W.latent_coef(g, d)!r} * ({n} - (select avg({n}) from lat)) as phi from lat")
    dec = ", ".join(f"({W.emb_group_of(i)}, {d}, 'f{i}', {W.dec_w(W.emb_group_of(i), d, i)!r})"
                    for i in range(64) for d in range(W.emb_dims(W.emb_group_of(i))))
    return f"""lphi as ({' union all '.join(lphi)}),
dec as (select * from (values {dec}) t(group_id, dim, feature, w)),
tot as (select group_id, feature, sum(abs(w)) as t from dec group by group_id, feature),
wt as (select dec.group_id, dim, dec.feature, abs(w) / case when t = 0 then 1.0 else t end as weight
       from dec join tot on dec.group_id = tot.group_id and dec.feature = tot.feature)"""


oracle("a4_decompose_latent", f"""with {LAT_CTE}, {_decompose_sql()}
select vec_id, 1 as class, feature, {r6('sum(phi * weight)')} as phi
from lphi join wt on lphi.group_id = wt.group_id and lphi.dim = wt.dim group by vec_id, feature""")


# ---------------------------------------------------------------- 2.13 run reporting
from equigroup.vocab import (BENCH_GROUPING_ORDER, BENCH_MODEL_ORDER, BENCH_MODELS, BENCHMARK_ACCURACY,  # noqa: E402
                             DATASETS, FAIRNESS_KEYS, GROUPINGS, MODELS, ORDERED_GROUPINGS)


def _case(expr: str, mapping: dict) -> str:
    return "case " + expr + " " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"


def _alt(tokens) -> str:
    return "|".join(sorted(tokens, key=len, reverse=True))


def _ds(expr: str) -> str:
    fb = f"regexp_replace(regexp_replace({expr}, '__', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce({_case(expr, DATASETS)}, {_case(fb, DATASETS)})"


G_RE = rf"^(.*)_({_alt(MODELS)})_({_alt({k: v for k, v in GROUPINGS.items() if k != 'ungrouped'})})$"
U_RE = rf"^(.*)_({_alt(MODELS)})_ungrouped$"
F_RE = rf"^(.*)_({_alt(MODELS)})_({_alt(GROUPINGS)})$"
GROUPINGS_NO_U = {k: v for k, v in GROUPINGS.items() if k != "ungrouped"}
RUN_CTE = rf"""rr as (select file_name, acc, prec, f1,
   regexp_extract(file_name, '^performance_metrics_Grouped_(.*)_run.*\.json$', 1) as gm,
   regexp_extract(file_name, '^performance_metrics_Ungrouped_(.*)_run.*\.json$', 1) as um from ({S.C_RUN}) c),
pp as (select *, lower(gm) as gl, lower(um) as ul from rr),
pr as (select file_name, acc, prec, f1,
   case when gm <> '' and regexp_matches(gl, '{G_RE}') then {_ds(f"regexp_extract(gl, '{G_RE}', 1)")}
        when um <> '' and regexp_matches(ul, '{U_RE}') then {_ds(f"regexp_extract(ul, '{U_RE}', 1)")} end as dataset,
   case when gm <> '' and regexp_matches(gl, '{G_RE}') then {_case(f"regexp_extract(gl, '{G_RE}', 2)", MODELS)}
        when um <> '' and regexp_matches(ul, '{U_RE}') then {_case(f"regexp_extract(ul, '{U_RE}', 2)", MODELS)} end as model,
   case when gm <> '' and regexp_matches(gl, '{G_RE}') then {_case(f"regexp_extract(gl, '{G_RE}', 3)", GROUPINGS_NO_U)}
        when um <> '' and regexp_matches(ul, '{U_RE}') then 'Ungrouped' end as grouping
   from pp),
rec as (select file_name, dataset, model, grouping, acc as "Accuracy", prec as "Precision", f1 as "F1-score",
   case when prec > 0 and f1 > 0 and 2 * prec - f1 > 0 then f1 * prec / (2 * prec - f1) end as "Recall"
   from pr where dataset is not null)"""
DS_COLS = ["Breast Cancer", "Heart Disease", "Obesity", "Diabetes"]


def _usable(v: str, eps: float = 0.0) -> str:
    extra = f" and abs({v}) >= {eps!r}" if eps else ""
    return f"case when {v} is not null and not isnan({v}) and not isinf({v}) and {v} <> 0{extra} then {v} end"


def _pivot(long_cte: str, eps: float = 0.0) -> str:
    cells = ", ".join(f"{r6(f'avg(case when dataset = {chr(39)}{d}{chr(39)} then uv end)')} as \"{d}\"" for d in DS_COLS)
    return f"""{long_cte},
u as (select *, {_usable('value', eps)} as uv from long)
select metric, grouping, {cells} from u group by metric, grouping"""


PERF_LONG = "long as (" + " union all ".join(
    f"select dataset, grouping, '{m}' as metric, \"{m}\" as value from rec"
    for m in ["Accuracy", "F1-score", "Precision", "Recall"]) + ")"
FAIR_CTE = rf"""fr0 as (select *, regexp_extract(file_name, '^fairness_metrics_(.*)_run.*\.json$', 1) as mm from ({S.C_FAIR_RUN}) c),
fr1 as (select *, lower(mm) as ml from fr0),
frec as (select {_ds(f"regexp_extract(ml, '{F_RE}', 1)")} as dataset,
   {_case(f"regexp_extract(ml, '{F_RE}', 2)", MODELS)} as model,
   {_case(f"regexp_extract(ml, '{F_RE}', 3)", GROUPINGS)} as grouping, * exclude (mm, ml, file_name)
   from fr1 where mm <> '' and regexp_matches(ml, '{F_RE}'))"""
FAIR_LONG = "long as (" + " union all ".join(
    f"select dataset, grouping, '{m}' as metric, \"{m}\" as value from frec where dataset is not null"
    for m in FAIRNESS_KEYS) + ")"

oracle("s3_parse_filename", f"with {RUN_CTE} select file_name, dataset, model, grouping from rec")
oracle("p9_canonical_names", f"""with c as ({S.C_RUN}),
t as (select file_name, regexp_extract(lower(file_name), '_(xgboost|randomforest|logisticregression|mlp|svm)_', 1) as model_token from c)
select file_name, model_token, {_case('model_token', MODELS)} as model from t""")
oracle("p10_usable_mean", f"with {RUN_CTE} select dataset, {r6('avg(' + _usable(chr(34) + 'Accuracy' + chr(34)) + ')')} as mean_accuracy "
                          f"from rec group by dataset")
oracle("r1_run_counts", f"with {RUN_CTE} select dataset, grouping, cast(count(*) as bigint) as runs from rec group by all")
oracle("r2_performance_report", f"with {RUN_CTE}, {_pivot(PERF_LONG)}")
oracle("r3_fairness_report", f"with {FAIR_CTE}, {_pivot(FAIR_LONG, 1e-8)}")
M_RANK = "case metric " + " ".join(f"when '{m}' then {i}" for i, m in enumerate(["Accuracy", "F1-score", "Precision", "Recall"])) + " else 4 end"
G_RANK = "case grouping " + " ".join(f"when '{g}' then {i}" for i, g in enumerate(ORDERED_GROUPINGS)) + f" else {len(ORDERED_GROUPINGS)} end"
oracle("r4_display_order", f"""with {RUN_CTE}, {PERF_LONG}, mg as (select distinct metric, grouping from long)
select metric, grouping, cast(row_number() over (order by {M_RANK}, {G_RANK}, grouping) as integer) as position from mg""")
FMT = ", ".join(f"coalesce(printf('%.6f', \"{d}\"), '-') as \"{d}\"" for d in DS_COLS)
_P7 = _pivot(PERF_LONG)
_P7_SEL = _P7.index("select metric, grouping,")
oracle("s7_report_format", f"""with {RUN_CTE}, {_P7[:_P7_SEL].rstrip()}, rep as ({_P7[_P7_SEL:]})
select replace(metric, ' ', '_') as metric_file, grouping, {FMT} from rep""")
LONGNAME = "case model " + " ".join(f"when '{MODELS[t]}' then '{BENCH_MODELS[t]}'" for t in MODELS) + " end"
BC = f"""bc as (select {LONGNAME} as model, grouping, avg({_usable(chr(34) + 'Precision' + chr(34))}) as value
        from rec where dataset = 'Breast Cancer' group by 1, 2 having value is not null)"""
BENCH = "bench as (select * from (values " + ", ".join(
    f"('{m}', {a!r}, {b!r}, {c!r})" for m, a, b, c in BENCHMARK_ACCURACY) + ") t(model, min, mean, max))"
oracle("r5_dataset_model_means", f"with {RUN_CTE}, {BC} select model, grouping, {r6('value')} as value from bc")
oracle("r6_benchmark_compare", f"""with {RUN_CTE}, {BC}, {BENCH}
select bc.model, grouping, {r6('value * 100.0')} as value_pct, {r6('min')} as min, {r6('mean')} as mean, {r6('max')} as max,
  value * 100.0 < min as below_min, value * 100.0 >= min and value * 100.0 <= max as within, value * 100.0 > max as above_max,
  {r6('greatest(1.0, 0.02 * (max - min))')} as pad
from bc left join bench on bc.model = bench.model""")
oracle("j8_benchmark_join", f"""with {RUN_CTE}, {BC}, {BENCH}
select bc.model, grouping, {r6('value * 100.0')} as value_pct, {r6('min')} as min, {r6('mean')} as mean, {r6('max')} as max
from bc left join bench on bc.model = bench.model""")
MODEL_POS = "mp as (select * from (values " + ", ".join(f"({i}, '{m}')" for i, m in enumerate(BENCH_MODEL_ORDER)) + \
    ") t(model_pos, model) where model in (select model from bc))"
GROUP_POS = "gp as (select * from (values " + ", ".join(f"({i}, '{g}')" for i, g in enumerate(BENCH_GROUPING_ORDER)) + \
    ") t(grouping_pos, grouping))"
oracle("s4_benchmark_csv", ORACLES["r6_benchmark_compare"])
oracle("s5_csv_sink", ORACLES["r2_performance_report"])
oracle("s6_metric_json", f"""with {RUN_CTE}
select cast(case grouping when 'Random' then 0 when 'K-plus' then 1 else 2 end as integer) as run_id, grouping, dataset,
  count(*) as n, {r6('sum("Accuracy")')} as accuracy, {r6('sum("F1-score")')} as f1
from rec where grouping in ('Random', 'K-plus', 'Ungrouped') group by 1, 2, 3""")
oracle("s8_summary_json", f"""with {RUN_CTE}, {_P7[:_P7_SEL].rstrip()}, rep as ({_P7[_P7_SEL:]})
select metric, grouping, dataset, value from (unpivot rep on {', '.join(f'"{d}"' for d in DS_COLS)} into name dataset value value)""")
oracle("s2_run_tree", f"""with runs as (select file_name, max(acc) as acc, max(prec) as prec, max(f1) as f1,
    cast(('0x' || substr(md5(file_name), 1, 4)) as integer) % 7 as k from ({S.C_RUN}) c0 group by file_name),
{RUN_CTE.replace(f"({S.C_RUN})", "(select * from runs where k <> 2)")}
select dataset, case when dataset is not null then model end as model,
  case when dataset is not null then grouping end as grouping, count(*) filter (where dataset is not null and k > 2) as parsed,
  count(*) filter (where dataset is null or k < 2) as skipped,
  {r6('sum(case when dataset is not null and k > 2 then runs.acc end)')} as accuracy,
  {r6('sum(case when dataset is not null and k > 2 then runs.f1 end)')} as f1
from pr join runs using (file_name) group by 1, 2, 3""")
oracle("s9_overlay_long", f"""with {RUN_CTE}, {BC}, {MODEL_POS}, {GROUP_POS}
select gp.grouping, cast(grouping_pos as integer) as grouping_pos, mp.model, cast(model_pos as integer) as model_pos,
  {r6('round(value * 100.0, 3)')} as value_pct
from gp cross join mp left join bc on bc.model = mp.model and bc.grouping = gp.grouping""")
oracle("v7_run_summary", f"""with {RUN_CTE}
select dataset, model, grouping, cast(count(*) as bigint) as num_runs, {r6('avg("Accuracy")')} as "mean_Accuracy",
  {r6('stddev_samp("Accuracy")')} as "std_Accuracy", {r6('avg("F1-score")')} as "mean_F1-score",
  {r6('stddev_samp("F1-score")')} as "std_F1-score" from rec group by all""")
oracle("v8_recall", f"with {RUN_CTE} select file_name, {r6(chr(34) + 'Recall' + chr(34))} as \"Recall\" from rec")


# ---------------------------------------------------------------- F9/F10, J6/J7
from equigroup.functions.hashing import hash_threshold  # noqa: E402

KDE_CTE = f"""o as ({S.C_ORD}),
mm as (select avg(o_totalprice) as m1, coalesce(nullif(stddev_pop(o_totalprice), 0), 1) as s1,
              avg(c_acctbal) as m2, coalesce(nullif(stddev_pop(c_acctbal), 0), 1) as s2 from o),
z as (select o_orderkey, c_mktsegment, (o_totalprice - m1) / s1 as x1, (c_acctbal - m2) / s2 as x2 from o, mm),
r as (select *, row_number() over (order by md5(concat(cast(o_orderkey as varchar), '|42'))) - 1 as pos from z),
n as (select count(*) as n from z),
draws as (select range as point, ('0x' || substr(md5(concat(cast(range as varchar), '|42')), 1, 8))::bigint % n as pos
          from range(300), n),
pts as (select point, x1 as p1, x2 as p2 from draws join r using (pos)),
de as (select point, sum(exp(-((x1 - p1) * (x1 - p1) + (x2 - p2) * (x2 - p2)) / (2 * 0.25))) / (count(*) * (2 * pi() * 0.25)) as d
       from pts cross join z group by point),
dr as (select point, sum(exp(-((x1 - p1) * (x1 - p1) + (x2 - p2) * (x2 - p2)) / (2 * 0.25))) / (count(*) * (2 * pi() * 0.25)) as d
       from pts cross join (select * from z where c_mktsegment <> 'BUILDING') zr group by point)"""
oracle("f9_observation_bias", f"""with {KDE_CTE}
select {r6('0.5 * avg(abs(coalesce(de.d, 0) - coalesce(dr.d, 0)))')} as "Observation Bias (TV)"
from pts left join de using (point) left join dr using (point)""")
oracle("j6_kernel_density", f"with {KDE_CTE} select cast(point as bigint) as point, {r6('d')} as density from de")
KNN_CTE = f"""d as ({S.ALL_DOC}),
bo as (select concat('0:', cast(doc_id as varchar)) as k, cast(n_chars as double) as x, 0 as origin from d
       union all select concat('1:', cast(doc_id as varchar)), cast(n_chars as double), 1 from d where lang <> 'en'),
sp as (select *, substr(md5(concat(k, '|42')), 1, 8) < '{hash_threshold(0.3)}' as is_test from bo),
tr as (select * from sp where not is_test), te as (select * from sp where is_test),
qv as (select distinct x as q from te),
nb as (select q, tr.k as tkey, tr.origin as lab, abs(tr.x - q) as dist,
              row_number() over (partition by q order by abs(tr.x - q), tr.k) as rn from qv cross join tr)"""
oracle("j7_knn_join", f"""with {KNN_CTE}
select {r6('q')} as q, cast(rn as integer) as rank, tkey as neighbour, {r6('dist')} as distance, lab as neighbour_label
from nb where rn <= 5""")
oracle("f10_structural_bias", f"""with {KNN_CTE},
pr as (select q, avg(cast(lab as double)) as p1 from nb where rn <= 5 group by q),
d2 as (select te.origin as y_true, pr.p1 from te join pr on te.x = pr.q),
lab as (select count(distinct y_true) as k, max(y_true) as pos from d2),
rk as (select y_true, rank() over (order by p1) + (count(*) over (partition by p1) - 1) / 2.0 as mr from d2),
au as (select case when (select k from lab) = 2 then
          (sum(case when y_true = (select pos from lab) then mr else 0 end)
           - count(*) filter (where y_true = (select pos from lab)) * (count(*) filter (where y_true = (select pos from lab)) + 1) / 2.0)
          / (count(*) filter (where y_true = (select pos from lab)) * count(*) filter (where y_true <> (select pos from lab)))
          end as roc_auc from rk)
select {r6('roc_auc')} as "Structural Bias (kNN AUC)" from au""")

KNN3_CTE = f"""d as (select vec_id, label, cast(embedding[1] as double) as e0, cast(embedding[2] as double) as e1, cast(embedding[3] as double) as e2 from embeddings),
bo as (select concat('0:', cast(vec_id as varchar)) as k, e0, e1, e2, 0 as origin from d
       union all select concat('1:', cast(vec_id as varchar)), e0, e1, e2, 1 from d where label <> 0),
sp as (select *, substr(md5(concat(k, '|42')), 1, 8) < '{hash_threshold(0.3)}' as is_test from bo
       where e0 is not null and e1 is not null and e2 is not null),
tr as (select * from sp where not is_test), te as (select * from sp where is_test),
qv as (select distinct e0, e1, e2 from te),
ds as (select q.e0, q.e1, q.e2, tr.k as tkey, tr.origin as lab, sqrt((q.e0 - tr.e0) * (q.e0 - tr.e0)
              + (q.e1 - tr.e1) * (q.e1 - tr.e1) + (q.e2 - tr.e2) * (q.e2 - tr.e2)) as dist from qv q cross join tr),
nb as (select *, row_number() over (partition by e0, e1, e2 order by dist, tkey) as rn from ds)"""
oracle("j7_knn_features", f"""with {KNN3_CTE}
select {r6('e0')} as e0, {r6('e1')} as e1, {r6('e2')} as e2, cast(rn as integer) as rank, tkey as neighbour,
{r6('dist')} as distance, lab as neighbour_label from nb where rn <= 5""")
oracle("f10_structural_bias_features", f"""with {KNN3_CTE},
pr as (select e0, e1, e2, avg(cast(lab as double)) as p1 from nb where rn <= 5 group by e0, e1, e2),
sc as (select te.origin, pr.p1 from te join pr using (e0, e1, e2)),
pairs as (select case when b.p1 > a.p1 then 1.0 when b.p1 = a.p1 then 0.5 else 0.0 end as won
          from sc a cross join sc b where a.origin = 0 and b.origin = 1)
select {r6('avg(won)')} as "Structural Bias (kNN AUC)" from pairs""")
oracle("f11_fairness_record_full", f"""select r.*, o.*, s.* from ({ORACLES['f11_fairness_record']}) r
cross join ({ORACLES['f9_observation_bias']}) o cross join ({ORACLES['f10_structural_bias']}) s""")
oracle("a2_shapley_linear", f"""with {DOC_FEAT},
v as (select doc_id, 'n_chars' as feature, cast(0.001 as double) * (n_chars - cast(1300 as double)) as phi from df
      union all select doc_id, 'toxic', cast(-0.5 as double) * (toxic - cast(1 as double) / 3) from df
      union all select doc_id, 'is_en', cast(0.25 as double) * (is_en - cast(1 as double) / 3) from df)
select doc_id, feature, {r6('phi')} as phi from v""")
oracle("a7_attribution_modes", f"""with {DOC_FEAT},
mw as (select * from (values (0, 0.001, -0.5, 0.25), (1, -0.002, 0.5, 0.1), (2, 0.0005, 0.25, -1.0)) t(class, wn, wt, we)),
lw as (select * from (values (0, 1.0, -0.5, 0.25), (1, -2.0, 0.5, 0.1), (2, 0.5, 0.25, -1.0)) t(class, w0, w1, w2)),
raw as (select doc_id, class, 'n_chars' as feature, cast(wn as double) * (n_chars - 1300) as phi from df, mw
        union all select doc_id, class, 'toxic', cast(wt as double) * (toxic - cast(1 as double) / 3) from df, mw
        union all select doc_id, class, 'is_en', cast(we as double) * (is_en - cast(1 as double) / 3) from df, mw),
lat as (select doc_id, class, cast(w0 as double) * (cast(0.001 as double) * n_chars + toxic - cast(4.9 as double) / 3) as p0,
               cast(w1 as double) * (toxic - is_en) as p1, cast(w2 as double) * (is_en - cast(1 as double) / 3) as p2 from df, lw),
lag as (select doc_id, cast(null as integer) as class, sum(abs(p0)) as p0, sum(abs(p1)) as p1, sum(abs(p2)) as p2 from lat group by doc_id),
g as (select 'grouped each_label' as mode, * from lat union all select 'grouped aggregated', * from lag),
v as (select 'raw each_label' as mode, doc_id, class, feature, phi from raw
      union all select 'raw aggregated', doc_id, null, feature, sum(abs(phi)) from raw group by doc_id, feature
      union all select mode, doc_id, class, 'n_chars', p0 from g
      union all select mode, doc_id, class, 'toxic', 0.75 * p0 + 0.25 * p1 from g
      union all select mode, doc_id, class, 'is_en', p2 from g)
select mode, doc_id, class, feature, {r6('phi')} as phi from v""")
oracle("p12_feature_presence", f"""with e as ({S.C_EMB}), v as (""" + " union all ".join(
    f"select 'f{i}' as feature, var_samp(f{i}) as variance from e" for i in range(64)) + """),
feats as (select feature from v where variance > 0),
assign as (select feature, cast((row_number() over (order by md5(concat(feature, '|42')), feature) - 1) % 5 as integer)
           as group_id from feats)
select group_id, feature, feature <> 'f63' as present from assign""")

oracle("j5_feature_pairs", f"""with src as ({S.C_LINE}), cells as ({S.pair_cells(S.LINE_FEATURES, 'l_returnflag')})
select fi, fj, cast(count(*) as bigint) as n from cells group by fi, fj""")

_SEG_FEATS = [f for f in S.LINE_FEATURES if f != "l_linestatus"]
oracle("i3_dissimilarity_by_segment",
       f"with {S.cmi_segment_cte(S.C_LINE, _SEG_FEATS, 'l_returnflag', 'l_linestatus')}\n"
       f"select seg as l_linestatus, fi, fj, {r6('dissimilarity')} as dissimilarity from dis")

# per-segment fairness: the RATES CTE with the segment carried through
_RATES_SEG = (RATES.replace("g as (select priv as privileged,", "g as (select source, priv as privileged,")
              .replace("from d group by priv)", "from d group by source, priv)")
              .replace("r as (select privileged,", "r as (select source, privileged,")
              .replace("sd_u from r),", "sd_u from r group by source),")
              .replace("pr as (select max(", "pr as (select source, max(")
              .replace("fr as (select case when pos_p", "fr as (select source, case when pos_p"))
oracle("f11_fairness_by_segment", f"""with d as (select source, coalesce(lang = 'en', false) as priv, quality as y_true,
   case when n_chars > 1500 then 1 else 0 end as y_pred from ({S.C_DOC}) c), {_RATES_SEG}
select source, {FR_COLS} from fr""")
