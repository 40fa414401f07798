"""Small builders for the oracle SQL text (DuckDB dialect)."""

from __future__ import annotations

C_ORD = """select o_orderkey, o_totalprice, c_acctbal, n_regionkey, c_mktsegment, o_orderpriority, o_orderstatus
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"""

C_NA = f"""select o_orderkey, o_totalprice,
  case when md5(concat(cast(o_orderkey as varchar), '|na1')) < '0d' then null else c_acctbal end as c_acctbal,
  n_regionkey,
  case when md5(concat(cast(o_orderkey as varchar), '|na2')) < '1a' then null else c_mktsegment end as c_mktsegment,
  o_orderpriority, o_orderstatus
from ({C_ORD}) c_ord"""

C_LINE = "select l_quantity, l_discount, l_tax, l_linenumber, l_linestatus, l_returnflag from lineitem"

ALL_DOC = "select doc_id, lang, source, n_chars from documents"
C_DOC = "select doc_id, lang, source, n_chars, toxic, quality from labels join documents using (doc_id)"

C_PRED = f"""select doc_id, lang, quality as y_true, case when n_chars > 1500 then 1 else 0 end as y_pred,
  1.0 / (1.0 + exp(-(n_chars - 1500) / 1000.0)) as p1 from ({C_DOC}) c_doc"""

C_PRED3 = f"""select o_orderkey, c_mktsegment,
  case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as y_true,
  case when o_totalprice < 150000 then 0 when o_totalprice < 300000 then 1 else 2 end as y_pred
from ({C_ORD}) c_ord"""

EMB = [f"f{i}" for i in range(64)]
C_EMB = "select vec_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(64)) + \
        ", label from embeddings"
C_EMB_BINNED = "select vec_id, " + ", ".join(
    f"cast(floor(cast(embedding[{i + 1}] as double) * 10.0) as bigint) as f{i}" for i in range(64)) + \
    ", label from embeddings"

C_RUN = """select concat(case when g = 'ungrouped' then 'performance_metrics_Ungrouped_' else 'performance_metrics_Grouped_' end,
              ds, '_', m, '_', g, '_run', cast(r as varchar), '.json') as file_name, acc, prec, f1
from (select
  case o_orderkey % 5 when 0 then 'Diabetes' when 1 then 'Heart_disease' when 2 then 'Breast_cancer' when 3 then 'Obesity' else 'Unknown' end as ds,
  case o_custkey % 5 when 0 then 'XGBoost' when 1 then 'SVM' when 2 then 'MLP' when 3 then 'RandomForest' else 'LogisticRegression' end as m,
  case o_orderpriority when '1-URGENT' then 'ungrouped' when '2-HIGH' then 'random' when '3-MEDIUM' then 'group_dissimilar'
       when '4-NOT SPECIFIED' then 'kplus' else 'bicriterion' end as g,
  o_orderkey % 10 as r,
  case when o_orderkey % 17 = 0 then 0.0::double when o_orderkey % 19 = 0 then null else o_totalprice end as acc,
  cast(o_custkey % 97 as double) / 100.0 as prec,
  cast(o_orderkey % 89 as double) / 100.0 as f1
  from orders) t"""

LINE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"]


def r6(expr: str) -> str:
    """Round like the Spark side: 6 digits, -0.0 folded to 0.0."""
    return f"(round(cast({expr} as double), 6) + 0.0)"


def long_values(src: str, features: list[str], key: str | None = None) -> str:
    """Unpivot to (feature, v varchar[, key]) with nulls kept out."""
    k = f", {key} as k" if key else ""
    return "\nunion all\n".join(
        f"select '{f}' as feature, cast({f} as varchar) as v{k} from src where {f} is not null"
        for f in features)


def pair_cells(features: list[str], target: str) -> str:
    parts = []
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            a, b = sorted([features[i], features[j]])
            parts.append(f"select '{a}' as fi, '{b}' as fj, cast({a} as varchar) as x, "
                         f"cast({b} as varchar) as y, cast({target} as varchar) as z from src "
                         f"where {a} is not null and {b} is not null and {target} is not null")
    return "\nunion all\n".join(parts)


def entropy_sql(src: str, features: list[str]) -> str:
    return f"""with src as ({src}),
lv as ({long_values('src', features)}),
cnt as (select feature, v, count(*) as n from lv group by feature, v),
tot as (select feature, n, sum(n) over (partition by feature) as t from cnt)
select feature, cast(sum(n) as bigint) as n, {r6('-sum((n / t) * log2(n / t))')} as entropy
from tot group by feature"""


def cmi_cte(src: str, features: list[str], target: str) -> str:
    return f"""src as ({src}),
cells as ({pair_cells(features, target)}),
t as (select fi, fj, x, y, z, count(*) as n from cells group by fi, fj, x, y, z),
m as (select *, sum(n) over (partition by fi, fj, x, z) as nxz, sum(n) over (partition by fi, fj, y, z) as nyz,
        sum(n) over (partition by fi, fj, z) as nz, sum(n) over (partition by fi, fj) as nn from t),
cmi as (select fi, fj, greatest(sum(n / nn * log2(n * nz / (nxz * nyz))), 0.0) as cmi from m group by fi, fj),
lv as ({long_values('src', features)}),
ecnt as (select feature, v, count(*) as n from lv group by feature, v),
etot as (select feature, n, sum(n) over (partition by feature) as t from ecnt),
ent as (select feature, -sum((n / t) * log2(n / t)) as h from etot group by feature),
dis as (select cmi.fi, cmi.fj, cmi.cmi, 1.0 - cmi.cmi / (a.h + b.h + 1e-9) as dissimilarity
        from cmi join ent a on a.feature = cmi.fi join ent b on b.feature = cmi.fj)"""


def cmi_cte_wide(src: str, features: list[str], target: str, key: str) -> str:
    """Same CTEs as ``cmi_cte`` (ending in ``dis``/``ent``) for many features of
    one type: unpivot, then a self-join on the key for the pairs."""
    cols = ", ".join(features)
    return f"""src as ({src}),
lv as (select {key} as k, {target} as zt, feature, v from (unpivot src on {cols} into name feature value v)),
cells as (select a.feature as fi, b.feature as fj, cast(a.v as varchar) as x, cast(b.v as varchar) as y,
                 cast(a.zt as varchar) as z
          from lv a join lv b on a.k = b.k and a.feature < b.feature where a.zt is not null),
t as (select fi, fj, x, y, z, count(*) as n from cells group by fi, fj, x, y, z),
m as (select *, sum(n) over (partition by fi, fj, x, z) as nxz, sum(n) over (partition by fi, fj, y, z) as nyz,
        sum(n) over (partition by fi, fj, z) as nz, sum(n) over (partition by fi, fj) as nn from t),
cmi as (select fi, fj, greatest(sum(n / nn * log2(n * nz / (nxz * nyz))), 0.0) as cmi from m group by fi, fj),
ecnt as (select feature, cast(v as varchar) as v, count(*) as n from lv group by feature, v),
etot as (select feature, n, sum(n) over (partition by feature) as t from ecnt),
ent as (select feature, -sum((n / t) * log2(n / t)) as h from etot group by feature),
dis as (select cmi.fi, cmi.fj, cmi.cmi, 1.0 - cmi.cmi / (a.h + b.h + 1e-9) as dissimilarity
        from cmi join ent a on a.feature = cmi.fi join ent b on b.feature = cmi.fj)"""

C_FAIR_RUN = """select concat('fairness_metrics_', ds, '_', m, '_', g, '_run', cast(o_orderkey % 10 as varchar), '.json') as file_name,
  case when o_orderkey % 23 = 0 then 'NaN'::double when o_orderkey % 29 = 0 then 0.0::double else o_totalprice / 300000.0 end as "Disparate Impact",
  cast(o_custkey % 50 as double) / 100.0 as "Equal Opportunity",
  case when o_orderkey % 31 = 0 then 1e-9 else cast(o_orderkey % 37 as double) / 100.0 end as "Equalized Odds",
  cast(o_custkey % 41 as double) / 50.0 as "Predictive Parity",
  o_totalprice / 100000.0 as "N-Sigma (ErrorRate)",
  case when o_orderkey % 13 = 0 then null else cast(o_orderkey % 11 as double) / 20.0 end as "Average distance from origin"
from (select o_orderkey, o_custkey, o_totalprice,
  case o_orderkey % 5 when 0 then 'Diabetes' when 1 then 'Heart_disease' when 2 then 'Breast_cancer' when 3 then 'Obesity' else 'Unknown' end as ds,
  case o_custkey % 5 when 0 then 'XGBoost' when 1 then 'SVM' when 2 then 'MLP' when 3 then 'RandomForest' else 'LogisticRegression' end as m,
  case o_orderpriority when '1-URGENT' then 'ungrouped' when '2-HIGH' then 'random' when '3-MEDIUM' then 'group_dissimilar'
       when '4-NOT SPECIFIED' then 'kplus' else 'bicriterion' end as g from orders) t"""


def cmi_segment_cte(src: str, features: list[str], target: str, segment: str) -> str:
    """``cmi_cte`` with every count, marginal and entropy taken per segment."""
    pairs = []
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            a, b = sorted([features[i], features[j]])
            pairs.append(f"select {segment} as seg, '{a}' as fi, '{b}' as fj, cast({a} as varchar) as x, "
                         f"cast({b} as varchar) as y, cast({target} as varchar) as z from src "
                         f"where {a} is not null and {b} is not null and {target} is not null")
    singles = "\nunion all\n".join(f"select {segment} as seg, '{f}' as feature, cast({f} as varchar) as v "
                                    f"from src where {f} is not null" for f in features)
    return f"""src as ({src}),
cells as ({' union all '.join(pairs)}),
t as (select seg, fi, fj, x, y, z, count(*) as n from cells group by seg, fi, fj, x, y, z),
m as (select *, sum(n) over (partition by seg, fi, fj, x, z) as nxz, sum(n) over (partition by seg, fi, fj, y, z) as nyz,
        sum(n) over (partition by seg, fi, fj, z) as nz, sum(n) over (partition by seg, fi, fj) as nn from t),
cmi as (select seg, fi, fj, greatest(sum(n / nn * log2(n * nz / (nxz * nyz))), 0.0) as cmi from m group by seg, fi, fj),
lv as ({singles}),
ecnt as (select seg, feature, v, count(*) as n from lv group by seg, feature, v),
etot as (select seg, feature, n, sum(n) over (partition by seg, feature) as t from ecnt),
ent as (select seg, feature, -sum((n / t) * log2(n / t)) as h from etot group by seg, feature),
dis as (select cmi.seg, cmi.fi, cmi.fj, 1.0 - cmi.cmi / (a.h + b.h + 1e-9) as dissimilarity
        from cmi join ent a on a.seg = cmi.seg and a.feature = cmi.fi join ent b on b.seg = cmi.seg and b.feature = cmi.fj)"""
