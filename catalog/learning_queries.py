"""Queries on neighbours, resampling and models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.common import prepared, round_col, round_sql, rounded, table
from catalog.data_queries import quota_ctes, rank_sql
from netlens.functions.lineage import cut_lineage
from netlens.operators import knn, models, resample
from netlens.operators.models import Settings, fit_model
from netlens.operators.sampling import split_dataset
from netlens.operators.trees import extra_trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 42


def add(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def vectors(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") == 0).cast("int").alias("y"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


# all squared distances, then ranks; ``e`` are rows (id, y, x)
BASE = "e as (select vec_id id, case when label = 0 then 1 else 0 end y, embedding::double[] x from embeddings)"


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def near(name: str, left: str, right: str, k: int, same: bool = True) -> str:
    """CTE ``name`` (id, rank, nid, ny, d2) of the k nearest rows."""
    other = "where a.id <> b.id" if same else ""
    return f"""{name} as (select * from (select a.id id, b.id nid, b.y ny, {dist('a.x', 'b.x')} d2,
  row_number() over (partition by a.id order by round({dist('a.x', 'b.x')}, 9), b.id) rank
  from {left} a, {right} b {other}) where rank <= {k})"""


def draw(purpose: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}:{purpose}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 15))::bigint)"


def fraction(purpose: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{SEED}:{purpose}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 8))::bigint / 4294967296.0)"


RANKED = f"m as (select *, row_number() over (order by md5(concat('{SEED}:', cast(id as varchar))), id) rk from e where y = 1)"
NEED = "(select count(*) filter (where y = 0) - count(*) filter (where y = 1) from e)"
N_MIN = "(select count(*) from e where y = 1)"


def digest_rows(df: DataFrame) -> DataFrame:
    """Rows with a readable fingerprint of the vector."""
    x = F.col("features")
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return df.select("id", "y", round_col(x[0], 6).alias("x0"), round_col(x[63], 6).alias("x63"), round_col(total, 5).alias("total"))


DIGEST = f"id, y, {round_sql('x[1]', 6)} as x0, {round_sql('x[64]', 6)} as x63, {round_sql('list_sum(x)', 5)} as total"


@add("rs00_knn_join", f"with {BASE}, {near('n', 'e', 'e', 5)} select id, cast(rank as int) as rank, nid as neighbour_id, ny as neighbour_y, {round_sql('sqrt(d2)', 6)} as distance from n")
def _(s, d):
    v = vectors(s, d)
    return rounded(knn.knn_join(v, v, 5))


@add("rs00_knn_join_pruned", f"with {BASE}, {near('n', 'e', 'e', 3)} select id, cast(rank as int) as rank, nid as neighbour_id, ny as neighbour_y, {round_sql('sqrt(d2)', 6)} as distance from n")
def _(s, d):
    v = vectors(s, d)
    return rounded(knn.knn_join(v, v, 3, block_rows=16))  # many cells and blocks


@add("rs00_knn_lsh", f"""with {BASE}, {near('n', 'e', 'e', 5)}
select id, count(*) as neighbours, true as recall_90 from n group by id""")
def _(s, d):
    """Every row has its five neighbours, of which the approximate join finds nine tenths at least."""
    v = vectors(s, d)
    found = cut_lineage(knn.knn_join(v, v, 5, method="lsh"))
    both = found.join(knn.knn_join(v, v, 5).select("id", "neighbour_id"), ["id", "neighbour_id"])
    recall = both.count() / found.count()
    return found.groupBy("id").agg(F.count("*").alias("neighbours"), F.lit(recall >= 0.9).alias("recall_90"))


@add("rs02_random_oversample", f"""with {BASE}, {RANKED}, dr as (select i draw, {draw('ros', 'i')} % {N_MIN} + 1 rk from (select unnest(range(1, {NEED} + 1)) i)),
o as (select id, y, x from e union all select -draw, y, x from dr join m using (rk)) select {DIGEST} from o""")
def _(s, d):
    return digest_rows(resample.random_oversample(vectors(s, d), SEED))


SMOTE = f"""{BASE}, {RANKED}, e1 as (select * from e where y = 1), {near('mn', 'e1', 'e1', 5)},
dr as (select i draw, {draw('smote', 'i')} % {N_MIN} + 1 rk, {draw('smote-n', 'i')} % 5 + 1 nr, {fraction('smote-u', 'i')} u from (select unnest(range(1, {NEED} + 1)) i)),
sm as (select id, y, x from e union all
  select -draw, m.y, list_transform(list_zip(m.x, b.x), lambda p: p[1] + u * (p[2] - p[1]))
  from dr join m using (rk) join mn on mn.id = m.id and mn.rank = nr join e b on b.id = mn.nid)"""


@add("rs03_smote", f"with {SMOTE} select {DIGEST} from sm")
def _(s, d):
    return digest_rows(prepared(s, d, "smote", lambda: resample.smote(vectors(s, d), SEED)))


def _summary(s, before: DataFrame, after: DataFrame) -> DataFrame:
    return resample.resampling_summary(before, after)


SEEDED = f"""{BASE}, e1 as (select * from e where y = 1), {near('mn', 'e1', 'e1', 5)}, {near('n', 'e1', 'e', 10)},
danger as (select id from n group by id having avg(case when ny <> 1 then 1.0 else 0.0 end) >= 0.5 and avg(case when ny <> 1 then 1.0 else 0.0 end) < 1),
m as (select *, row_number() over (order by md5(concat('{SEED}:', cast(id as varchar))), id) rk from e1 where id in (select id from danger)),
dr as (select i draw, {draw('border', 'i')} % nullif((select count(*) from m), 0) + 1 rk, {draw('border-n', 'i')} % 5 + 1 nr, {fraction('border-u', 'i')} u from (select unnest(range(1, {NEED} + 1)) i)),
sm as (select id, y, x from e union all
  select -draw, m.y, list_transform(list_zip(m.x, b.x), lambda p: p[1] + u * (p[2] - p[1]))
  from dr join m using (rk) join mn on mn.id = m.id and mn.rank = nr join e b on b.id = mn.nid)"""


@add("rs04_borderline_smote", f"with {SEEDED} select {DIGEST} from sm")
def _(s, d):
    return digest_rows(resample.borderline_smote(vectors(s, d), SEED))


BALANCED = f"with {BASE}, c as (select y, count(*) n from e group by y) select y, n as before_count, (select max(n) from c) as after_count from c"


@add("rs05_svm_smote", BALANCED)
def _(s, d):
    v = vectors(s, d)
    return _summary(s, v, resample.svm_smote(v, SEED))


@add("rs06_kmeans_smote", BALANCED)
def _(s, d):
    v = vectors(s, d)
    return _summary(s, v, resample.kmeans_smote(v, SEED))


@add("rs07_adasyn_quotas", f"""with {BASE}, e1 as (select * from e where y = 1), {near('n', 'e1', 'e', 5)},
sh as (select id, avg(case when ny <> 1 then 1.0 else 0.0 end) share from n group by id)
select id, {round_sql('share', 9)} as share, cast(round_even(share / (select sum(share) from sh) * {NEED}, 0) as bigint) as copies from sh""")
def _(s, d):
    return rounded(resample.adasyn_quotas(vectors(s, d)), 9)


@add("rs07_adasyn", f"""with {BASE}, e1 as (select * from e where y = 1), {near('n', 'e1', 'e', 5)}, {near('mn', 'e1', 'e1', 5)},
sh as (select id, avg(case when ny <> 1 then 1.0 else 0.0 end) share from n group by id),
g as (select id, cast(round_even(share / (select sum(share) from sh) * {NEED}, 0) as bigint) copies from sh),
m as (select e1.*, copies, row_number() over (order by md5(concat('{SEED}:', cast(e1.id as varchar))), e1.id) rk from e1 join g on g.id = e1.id where copies > 0),
c as (select *, unnest(range(1, copies + 1)) i from m),
dr as (select *, {draw('adasyn-n', 'id', 'i')} % 5 + 1 nr, {fraction('adasyn-u', 'id', 'i')} u from c),
sm as (select id, y, x from e union all
  select -(rk * 4294967296 + i), dr.y, list_transform(list_zip(dr.x, b.x), lambda p: p[1] + u * (p[2] - p[1]))
  from dr join mn on mn.id = dr.id and mn.rank = nr join e b on b.id = mn.nid) select {DIGEST} from sm""")
def _(s, d):
    return digest_rows(resample.adasyn(vectors(s, d), SEED))


@add("rs08_random_undersample", f"""with {BASE}, r as (select *, row_number() over (partition by y order by md5(concat('{SEED}:', cast(id as varchar))), id) rk from e)
select {DIGEST} from r where rk <= {N_MIN}""")
def _(s, d):
    return digest_rows(resample.random_undersample(vectors(s, d), SEED))


@add("rs09_tomek_links", f"""with {BASE}, {near('n', 'e', 'e', 1)},
l as (select a.id from n a join n b on a.nid = b.id and b.nid = a.id join e on e.id = a.id where e.y <> a.ny) select {DIGEST} from e where id not in (select id from l)""")
def _(s, d):
    return digest_rows(resample.drop_tomek_links(vectors(s, d)))


@add("rs09_smote_tomek", f"""with {SMOTE}, {near('n', 'sm', 'sm', 1)},
l as (select a.id from n a join n b on a.nid = b.id and b.nid = a.id join sm on sm.id = a.id where sm.y <> a.ny) select {DIGEST} from sm where id not in (select id from l)""")
def _(s, d):
    sm = prepared(s, d, "smote", lambda: resample.smote(vectors(s, d), SEED))
    return digest_rows(resample.drop_tomek_links(sm))


@add("rs10_edited_neighbours", f"""with {BASE}, {near('n', 'e', 'e', 3)},
l as (select n.id from n join e on e.id = n.id group by n.id having bool_or(ny <> y)) select {DIGEST} from e where id not in (select id from l)""")
def _(s, d):
    return digest_rows(resample.drop_noisy(vectors(s, d)))


@add("rs10_smote_enn", f"""with {SMOTE}, {near('n', 'sm', 'sm', 3)},
l as (select n.id from n join sm on sm.id = n.id group by n.id having bool_or(ny <> y)) select {DIGEST} from sm where id not in (select id from l)""")
def _(s, d):
    sm = prepared(s, d, "smote", lambda: resample.smote(vectors(s, d), SEED))
    return digest_rows(resample.drop_noisy(sm))


@add("rs12_resampling_summary", f"with {BASE} select y, count(*) as before_count, {N_MIN} as after_count from e group by y")
def _(s, d):
    v = vectors(s, d)
    return resample.resampling_summary(v, resample.random_undersample(v, SEED))


# ---- models ---------------------------------------------------------------


def train_and_all(s, d) -> tuple[DataFrame, DataFrame]:
    """The training part of an exact split, and every row to score."""
    v = vectors(s, d)
    return split_dataset(v, "id", "y", 0.2, 0.2, SEED).where("split = 'train'").drop("split"), v


def _scored(name: str, model: str, strategy: str = "baseline"):
    @add(name)
    def _(s, d):
        train, rows = train_and_all(s, d)
        return fit_model(model, strategy, train, Settings(), SEED).score(rows).select("id", "y", "score")


@add("md01_stationary", f"with {BASE} select unnest(range(max(len(x)) + 1))::int as feature, true as stationary from e")
def _(s, d):
    """The gradient of the penalised loss at the solution; the last one is the intercept's."""
    train, _ = train_and_all(s, d)
    settings = Settings()
    model = fit_model("logistic_regression", "baseline", train, settings, SEED).models[0]
    n, coef = train.count(), [*model.coefficients.tolist(), model.intercept]
    x = F.concat("features", F.array(F.lit(1.0)))
    z = F.aggregate(F.zip_with(x, F.array(*map(F.lit, coef)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    cells = train.select((1 / (1 + F.exp(-z)) - F.col("y")).alias("err"), F.posexplode(x).alias("feature", "v"))
    slope = F.when(F.col("feature") < len(coef) - 1, F.get(F.array(*map(F.lit, coef)), F.col("feature")) / (settings.c * n)).otherwise(0.0)
    sums = cells.groupBy("feature").agg((F.sum(F.col("err") * F.col("v")) / n).alias("g"))
    return sums.select("feature", (F.abs(F.col("g") + slope) < 1e-3).alias("stationary"))


for _n, _m in (
    ("md01_logistic_regression", "logistic_regression"),
    ("md02_decision_tree", "decision_tree"),
    ("md03_random_forest", "random_forest"),
    ("md04_gradient_boosting", "gradient_boosting"),
    ("md05_linear_svm", "linear_svm"),
    ("md07_extra_trees", "extra_trees"),
    ("md08_balanced_random_forest", "balanced_random_forest"),
    ("md09_easy_ensemble", "easy_ensemble"),
    ("md10_rusboost", "rusboost"),
    ("md11_focal_logistic", "focal_logistic"),
):
    _scored(_n, _m)
_scored("md12_class_weight", "logistic_regression", "class_weight")


TREES = 20


@add("md07_first_cut", f"""with {BASE}, r as (select j, min(x[j + 1]) lo, max(x[j + 1]) hi from e, (select unnest(range(64)) j) group by j),
o as (select t, j, lo, hi, row_number() over (partition by t order by md5('{SEED}:feature:' || t || '::' || j)) k
  from r, (select unnest(range({TREES})) t) where hi > lo),
f as (select *, ('0x' || substr(md5('{SEED}:cut:' || t || '::' || j), 1, 8))::bigint / 4294967296.0 u from o where k <= 8),
c as (select t, j, k, case when lo + u * (hi - lo) < hi then lo + u * (hi - lo) else lo end cut from f),
w as (select t, j, k, cut, count(*) n, sum(y) n1, count(*) filter (x[j + 1] <= cut) l, coalesce(sum(y) filter (x[j + 1] <= cut), 0) l1 from c, e group by all),
g as (select *, 2.0 * n1 * (n - n1) / n - case when l > 0 then 2.0 * l1 * (l - l1) / l else 0 end
  - case when n > l then 2.0 * (n1 - l1) * (n - l - n1 + l1) / (n - l) else 0 end gain from w)
select t as tree, arg_min(j, k) as feature, {round_sql('arg_min(cut, k)', 9)} as threshold, {round_sql('max(gain)', 6)} as gain
from (select *, max(round(gain, 9)) over (partition by t) best from g) where round(gain, 9) = best group by t""")
def _(s, d):
    """The root of each of the first extra trees."""
    roots = extra_trees(vectors(s, d), TREES, SEED).where("node = ''").select("tree", "feature", "threshold", "gain")
    return rounded(roots, 6, threshold=9)


_E_COUNTS = "(select y, count(*) n from e group by y)"
TRAIN = f"""{quota_ctes('sum(n) - ceil(sum(n) * 0.2)', _E_COUNTS)}, {quota_ctes('sum(n) - ceil(sum(n) * (0.2 / (1.0 - 0.2)))', '(select y, k n from q)', 'b')},
er as (select *, {rank_sql('id')} rk from e), tr as (select er.* from er join bq on er.y = bq.y where rk <= bq.k)"""


@add("md06_knn", f"""with {BASE}, {TRAIN}, {near('n', 'e', 'tr', 7, False)}
select e.id, e.y, {round_sql('avg(ny * 1.0)', 9)} as score from n join e on e.id = n.id group by e.id, e.y""")
def _(s, d):
    train, rows = train_and_all(s, d)
    return rounded(fit_model("knn", "baseline", train, Settings(), SEED).score(rows).select("id", "y", "score"), 9)


@add("md12_balanced_weights", f"with {BASE}, c as (select y, count(*) n from e group by y) select id, e.y, {round_sql('(select count(*) from e) / (2.0 * n)', 9)} as weight from e join c on e.y = c.y")
def _(s, d):
    return rounded(models.balanced_weights(vectors(s, d)).select("id", "y", "weight"), 9)


@add("md11_focal_weights", f"""with {BASE}, c as (select count(*) filter (where y = 0) n0, count(*) filter (where y = 1) n1 from e),
p as (select id, y, 1.0 / (1.0 + exp(-x[1])) p from e), t as (select *, case when y = 1 then p else 1 - p end pt from p, c)
select id, {round_sql('greatest(n0, n1) / case when y = 1 then n1 else n0 end * power(1 - least(greatest(pt, 1e-6), 1 - 1e-6), 2)', 9)} as weight from t""")
def _(s, d):
    v = vectors(s, d)
    p = 1.0 / (1.0 + F.exp(-F.col("features")[0]))
    return rounded(v.select("id", models.focal_weights(v, p).alias("weight")), 9)
