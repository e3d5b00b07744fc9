"""Queries over answers, solvers, fitted models, placebos, drop-out draws, news features, user hooks, indicators and cuts."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import linear as L
from tidepanel.operators import plugins as U
from tidepanel.operators import rewards as RW
from tidepanel.operators import risk as R
from tidepanel.operators import windows as W
from tidepanel.operators import xsection as X
from tidepanel.sources import files
from tidepanel.sources import fixtures as S
from tidepanel.streaming import jobs

from .panel_queries import OWN, P, _control, _streams, forward, momentum, r6
from .product_queries import _SCORED, _STUDY, scored_labels, study

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, needs: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = S.with_sql(needs, sql) if needs else sql
        return f

    return add


# ------------------------------------------------------- rewards of answers


def reports(spark, d) -> DataFrame:
    """(doc_id, text): each document as an answer with headers and bullets, one for each of its lines."""
    line, k = (lambda x: F.coalesce(x, F.lit(""))), (lambda i: i % 6)
    shaped = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x, i: F.when(k(i) == 0, F.concat(F.when(i % 18 == 12, F.lit("## Decision\n")).otherwise("# Part\n"), line(x)))
        .when(k(i) == 1, F.concat(F.lit("- "), line(x), F.lit(" *so it says* `paper`")))
        .when(k(i) == 2, F.concat(F.lit("* **first** "), line(x)))
        .when(k(i) == 3, F.concat(F.lit("- "), line(x), F.lit(" `note`")))
        .when(k(i) == 4, F.concat(line(x), F.lit(" | 1")))
        .otherwise(line(x)),
    )
    return S.table(spark, d, "documents").select("doc_id", F.array_join(shaped, "\n").alias("text"))


_REPORT = r"""WITH li AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
    rep AS (SELECT doc_id, string_agg(CASE i % 6 WHEN 0 THEN CASE WHEN i % 18 = 12 THEN '## Decision' ELSE '# Part' END || chr(10) || x WHEN 1 THEN '- ' || x || ' *so it says* `paper`' WHEN 2 THEN '* **first** ' || x WHEN 3 THEN '- ' || x || ' `note`' WHEN 4 THEN x || ' | 1' ELSE x END, chr(10) ORDER BY i) AS text FROM li GROUP BY 1),
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rep),
    hd AS (SELECT *, regexp_matches(x, '^\s*#{1,6}\s') AS h FROM ln),
    se AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS sid FROM hd),
    nm AS (SELECT doc_id, sid, lower(trim(regexp_extract(x, '^\s*#{1,6}\s+(.*)$', 1))) AS name FROM se WHERE h),
    ok AS (SELECT se.* FROM se JOIN nm USING (doc_id, sid) WHERE name <> 'think' AND name NOT LIKE '%conclusion%' AND name NOT LIKE '%decision%'),
    bd AS (SELECT doc_id, sid, coalesce(sum(len(regexp_extract_all(x, '[^\x09-\x0D\x20]+'))) FILTER (NOT h), 0) AS n, coalesce(bool_or(regexp_matches(x, '^\s*[-*○•]\s')) FILTER (NOT h), false) AS bullets, coalesce(bool_or(contains(x, '**')) FILTER (NOT h), false) AS bold, coalesce(bool_or(contains(x, '|')) FILTER (NOT h), false) AS cells FROM ok GROUP BY 1, 2),
    st AS (SELECT doc_id, CASE WHEN count(*) < 5 THEN greatest(0.3, count(*) / 5 * 0.7) WHEN count(*) <= 7 THEN 1 ELSE greatest(0.3, 1 - 0.15 * (count(*) - 7)) END * 0.6 + 0.4 * avg(CASE WHEN n < 50 THEN 0.2 ELSE 0.4 * bullets::INT + 0.2 * bold::INT + 0.1 * cells::INT END) AS structure FROM bd GROUP BY 1),
    bu AS (SELECT doc_id, sid, regexp_extract(x, '(?s)^\s*[-*○•]\s+(.*)', 1) AS b FROM ok WHERE NOT h AND regexp_matches(x, '^\s*[-*○•]\s')),
    op AS (SELECT *, regexp_matches(b, '(^|[^*])\*[^*]+\*([^*]|$)') AS q, regexp_matches(b, '`[^`]+`') AS s, len(regexp_extract_all(string_split(b, '*')[1], '[^\x09-\x0D\x20]+')) AS w FROM bu),
    bs AS (SELECT doc_id, sid, 0.4 * CASE WHEN q AND s THEN CASE WHEN w < 15 THEN w / 15 WHEN w <= 90 THEN 1 ELSE greatest(0.5, 1 - 0.02 * (w - 90)) END ELSE least(0.3, w / 15 * 0.3) END + 0.35 * q::INT + 0.25 * s::INT AS v FROM op),
    sv AS (SELECT doc_id, 0.3 * CASE WHEN count(*) < 4 THEN count(*) / 4 WHEN count(*) <= 7 THEN 1 ELSE greatest(0.3, 1 - 0.1 * (count(*) - 7)) END + 0.7 * count(*) / sum(1 / greatest(v, 0.01)) AS v FROM bs GROUP BY doc_id, sid),
    ev AS (SELECT doc_id, count(*) / sum(1 / greatest(v, 0.01)) AS evidence FROM sv WHERE v > 0 GROUP BY 1),
    sc AS (SELECT doc_id, coalesce(structure, 0) AS structure, coalesce(evidence, 0) AS evidence, text FROM rep LEFT JOIN st USING (doc_id) LEFT JOIN ev USING (doc_id)) """


@query(_REPORT + "SELECT doc_id, round(structure, 6) AS score FROM sc")
def cor_12(spark, d):
    return reports(spark, d).select("doc_id", F.round(RW.structure_reward(F.col("text")), 6).alias("score"))


@query(_REPORT + "SELECT doc_id, round(evidence, 6) AS score FROM sc")
def cor_13(spark, d):
    return reports(spark, d).select("doc_id", F.round(RW.evidence_reward(F.col("text")), 6).alias("score"))


@query(_REPORT + "SELECT doc_id, reward, round(score, 6) AS score FROM (SELECT doc_id, 'structure' AS reward, structure AS score FROM sc UNION ALL SELECT doc_id, 'evidence', evidence FROM sc UNION ALL SELECT doc_id, 'long', (length(text) > 500)::INT FROM sc)")
def udf_03(spark, d):
    """Three rewards by name, the last one a user's own."""
    text = F.col("text")
    own = {"structure": RW.structure_reward(text), "evidence": RW.evidence_reward(text), "long": (F.length(text) > 500).cast("double")}
    return U.scored(reports(spark, d), "doc_id", own).select("doc_id", "reward", *r6("score"))


# ------------------------------------------------------ control and solvers


@query()
def rsk_02(spark, d):
    """No SQL: each day's buffer is a weighted quantile of the scores before it; tests hold it against a plain loop."""
    grid = spark.createDataFrame([(0.005, 0.05)], "alpha double, gamma double")
    return R.regime_controlled(_streams(spark, d), grid).select("stream_id", "alpha", "gamma", "di", *r6("exposure", "realized"))


@query(_control("(0.005, 0.05)", "SELECT stream_id, di::INT AS di, round(exposure, 6) AS exposure, round(realized, 6) AS realized FROM f WHERE k > 0 AND stream_id IN (SELECT stream_id FROM st GROUP BY 1 HAVING count(*) >= 60)"))
def st_01(spark, d):
    """The controller as a stream over the batch query's return streams; it gives the same rows."""
    where = files.scratch(spark, "controller")
    returns = _streams(spark, d).select("stream_id", F.col("di").cast("int").alias("di"), "r")
    returns.write.parquet(f"{where}/returns")
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        out = jobs.controlled(spark.readStream.schema(returns.schema).parquet(f"{where}/returns"))
        jobs.run_to_table(out, f"{where}/table", f"{where}/checkpoint")
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{where}/table").select("stream_id", "di", *r6("exposure", "realized"))


@query()
def pf_05(spark, d):
    """No SQL: each day solves a linear system; tests hold it against numpy."""
    x = scored_labels(spark, d).select("di", "ticker", F.col("s").alias("score"))
    rows = OWN(spark, d).select("di", "ticker", "r").join(x, ["di", "ticker"], "left")
    return R.mean_variance(rows).select("di", "ticker", *r6("weight"))


# -------------------------------------------------- drop-out draws and news


#: Names left out of a year in each draw: the share that is missing there.
SHARE = "0.1 + 0.05 * (y % 3)"


@query(f"""SELECT round(quantile_cont(sharpe, 0.05), 6) AS q05, round(quantile_cont(sharpe, 0.25), 6) AS q25, round(quantile_cont(sharpe, 0.5), 6) AS q50, round(quantile_cont(sharpe, 0.75), 6) AS q75, round(quantile_cont(sharpe, 0.95), 6) AS q95 FROM (
    WITH x AS (SELECT m.*, fwd, year(m.date) AS y FROM mom m JOIN fwd USING (di, ticker)),
    gone AS (SELECT b, y, ticker FROM (SELECT b, y, ticker, row_number() OVER (PARTITION BY b, y ORDER BY md5(concat_ws('|', b, y, ticker))) AS k, count(*) OVER (PARTITION BY b, y) AS n FROM (SELECT DISTINCT y, ticker FROM x), range(20) t(b)) WHERE k <= round(({SHARE}) * n)),
    z AS (SELECT b, x.* FROM x, range(20) t(b) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.b = t.b AND gone.y = x.y AND gone.ticker = x.ticker)),
    r AS (SELECT b, di, avg(CASE WHEN value >= q80 THEN fwd END) - avg(CASE WHEN value <= q20 THEN fwd END) AS r FROM (SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY b, di) AS q80, quantile_cont(value, 0.2) OVER (PARTITION BY b, di) AS q20 FROM z) GROUP BY 1, 2)
    SELECT b, avg(r) * 252 / (stddev_pop(r) * sqrt(252)) AS sharpe FROM r WHERE r IS NOT NULL GROUP BY b)""", "mom fwd")
def bt_08(spark, d, draws: int = 20):
    p = P(spark, d)
    x = momentum(p).join(forward(p), ["di", "ticker"]).withColumn("y", F.year("date"))
    w = Window.partitionBy("b", "y")
    names = x.select("y", "ticker").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    ranked = names.select("b", "y", "ticker", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", "b", "y", "ticker")))).alias("k"), F.count("*").over(w).alias("n"))
    stay = ranked.where(F.col("k") > F.round(F.expr(SHARE) * F.col("n"))).select("b", "y", "ticker")
    drawn = X.legs(x.join(stay, ["y", "ticker"]).withColumn("day", F.struct("b", "di")), by="day")
    up, down = (F.avg(F.when(F.col(c), F.col("fwd"))) for c in ("up", "down"))
    r = drawn.groupBy("b", "di").agg((up - down).alias("r")).where("r is not null")
    sharpe = r.groupBy("b").agg((F.avg("r") * 252 / (F.stddev_pop("r") * 252**0.5)).alias("sharpe"))
    return sharpe.agg(*(F.round(F.percentile("sharpe", q), 6).alias(f"q{round(100 * q):02d}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)))


@query("""WITH it AS (SELECT user_id % 25 AS ticker, CAST(ts AS DATE) AS date, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS sent, embedding FROM events JOIN embeddings ON event_id = vec_id),
    el AS (SELECT ticker, date, sent, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS dim FROM it),
    da AS (SELECT ticker, date, dim, sum(e) AS e, count(*) AS n, sum(sent) AS sent FROM el WHERE e IS NOT NULL AND isfinite(e) GROUP BY 1, 2, 3),
    gr AS (SELECT ticker, dim, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT ticker, dim FROM da), (SELECT min(date) AS lo, max(date) AS hi FROM da))
    SELECT ticker, strftime(date, '%Y-%m-%d') AS date, dim::INT AS dim, round(sum(e) OVER w / sum(n) OVER w, 6) AS mean7, round(sum(sent) OVER w / sum(n) OVER w, 6) AS sent7, coalesce(sum(n) OVER w, 0)::BIGINT AS n7 FROM gr LEFT JOIN da USING (ticker, dim, date) WINDOW w AS (PARTITION BY ticker, dim ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def sig_16(spark, d):
    """Every event with a vector is a news item; one row for each name, day and dimension, null where a week has no news."""
    tone = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    items = S.table(spark, d, "events").join(S.table(spark, d, "embeddings"), F.col("event_id") == F.col("vec_id"))
    each = items.select((F.col("user_id") % 25).alias("ticker"), F.to_date("ts").alias("date"), tone.alias("sent"), F.posexplode("embedding").alias("dim", "e")).withColumn("e", F.col("e").cast("double"))
    day = each.where("e is not null and not isnan(e) and abs(e) < double('infinity')").groupBy("ticker", "dim", "date").agg(F.sum("e").alias("e"), F.count("*").alias("n"), F.sum("sent").alias("sent"))
    span = day.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = day.select("ticker", "dim").distinct().crossJoin(F.broadcast(span)).select("ticker", "dim", F.explode(F.sequence("lo", "hi")).alias("date"))  # one row
    w = Window.partitionBy("ticker", "dim").orderBy(F.unix_date("date")).rangeBetween(-6, 0)
    n = F.sum("n").over(w)
    return grid.join(day, ["ticker", "dim", "date"], "left").select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), "dim", F.round(F.sum("e").over(w) / n, 6).alias("mean7"), F.round(F.sum("sent").over(w) / n, 6).alias("sent7"), F.coalesce(n, F.lit(0)).alias("n7"))


# ------------------------------------------------------------------- models


def examples(spark, d) -> DataFrame:
    """(di, ticker, x1, x2, x3, y, part): momentum of three lengths as ranks of the day less a half, forward return, train before 70 % of the days."""
    p = P(spark, d)
    x = momentum(p, 5).select("di", "ticker", F.col("value").alias("m5")).join(momentum(p, 21).select("di", "ticker", F.col("value").alias("m21")), ["di", "ticker"])
    x = x.join(momentum(p, 1).select("di", "ticker", F.col("value").alias("m1")), ["di", "ticker"]).join(forward(p).withColumnRenamed("fwd", "y"), ["di", "ticker"])
    last = p.agg(F.max("di").alias("last"))
    x = x.crossJoin(F.broadcast(last))  # one row
    part = F.when(F.col("di") <= 0.5 * F.col("last"), "fit").when(F.col("di") <= 0.7 * F.col("last"), "choose").otherwise("test")
    return x.select("di", "ticker", *((X.pct_rank(m) - 0.5).alias(f"x{i}") for i, m in enumerate(("m5", "m21", "m1"), 1)), "y", part.alias("part"))


_EXAMPLES = """, ex AS (SELECT di, ticker, {ranks}, y, CASE WHEN di <= 0.5 * last THEN 'fit' WHEN di <= 0.7 * last THEN 'choose' ELSE 'test' END AS part FROM (SELECT di, ticker, a.value AS m5, b.value AS m21, c.value AS m1, fwd AS y FROM mom5 a JOIN mom21 b USING (di, ticker) JOIN mom1 c USING (di, ticker) JOIN fwd USING (di, ticker)), (SELECT max(di) AS last FROM p))""".format(
    ranks=", ".join(f"(rank() OVER (PARTITION BY di ORDER BY {m}) + (count(*) OVER (PARTITION BY di, {m}) - 1) / 2.0) / count(*) OVER (PARTITION BY di) - 0.5 AS x{i}" for i, m in enumerate(("m5", "m21", "m1"), 1))
)
_SUMS = "count(*) AS n, avg(x1) AS a, avg(x2) AS b, avg(y) AS c, count(*) * var_pop(x1) AS s11, count(*) * var_pop(x2) AS s22, count(*) * covar_pop(x1, x2) AS s12, count(*) * covar_pop(x1, y) AS s1y, count(*) * covar_pop(x2, y) AS s2y, count(*) * var_pop(y) AS syy"


def mean_ic(x: DataFrame, by: str, pred: str = "pred", y: str = "y") -> DataFrame:
    """(by, ic): mean over days of the rank correlation."""
    day = F.struct(by, "di")
    r = x.withColumn("day", day).select("day", X.average_rank(pred, by="day").alias("a"), X.average_rank(y, by="day").alias("b"))
    return r.groupBy("day").agg(F.corr("a", "b").alias("ic")).where("ic is not null and not isnan(ic)").groupBy(F.col(f"day.{by}").alias(by)).agg(F.avg("ic").alias("ic"))


def arrays(x: DataFrame, *names: str) -> DataFrame:
    return x.withColumn("x", F.array(*names))


@query(S.with_sql("mom1 mom5 mom21 fwd", _EXAMPLES + f", m AS (SELECT {_SUMS} FROM ex WHERE part <> 'test'), k AS (SELECT *, n + 10 AS d, s12 / sqrt(s11 * s22) * n AS e, s1y / sqrt(s11 / n) AS f, s2y / sqrt(s22 / n) AS g FROM m), w AS (SELECT *, (f * d - g * e) / (d * d - e * e) / sqrt(s11 / n) AS w1, (g * d - f * e) / (d * d - e * e) / sqrt(s22 / n) AS w2 FROM k) SELECT di, ticker, round(c + w1 * (x1 - a) + w2 * (x2 - b), 8) AS pred FROM ex, w WHERE part = 'test'"))
def ml_02(spark, d):
    """Ridge with penalty 10 on two standardised features, fitted before the test days."""
    x = arrays(examples(spark, d), "x1", "x2").withColumn("side", F.when(F.col("part") == "test", "test").otherwise("train"))
    w = L.ridge(L.moments(x.where("side = 'train'"), "side", "x", "y", 2)["train"], 10.0, standard=True)
    return x.where("side = 'test'").select("di", "ticker", F.round(L.predicted("x", *w), 8).alias("pred"))


@query(S.with_sql("mom1 mom5 mom21 fwd", _EXAMPLES + f", f AS (SELECT {_SUMS} FROM ex WHERE part = 'fit'), v AS (SELECT {_SUMS} FROM ex WHERE part = 'choose'), al AS (SELECT pow(10, k / 2) AS alpha FROM range(17) t(k)), w AS (SELECT alpha, f.*, (s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w1, (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12) AS w2 FROM al, f) SELECT round(alpha, 4) AS alpha, round((v.syy - 2 * (w1 * v.s1y + w2 * v.s2y) + w1 * w1 * v.s11 + 2 * w1 * w2 * v.s12 + w2 * w2 * v.s22) / v.n + pow(v.c - w.c - w1 * (v.a - w.a) - w2 * (v.b - w.b), 2), 8) AS error FROM w, v"))
def ml_06(spark, d):
    """The validation error of each penalty of a log grid, from one pass: the moments of the fitted and of the later days."""
    m = L.moments(arrays(examples(spark, d), "x1", "x2").where("part <> 'test'"), "part", "x", "y", 2)
    rows = [(round(10 ** (k / 2), 4), round(float(L.squared_error(m["choose"], *L.ridge(m["fit"], 10 ** (k / 2)))), 8)) for k in range(17)]
    return spark.createDataFrame(rows, "alpha double, error double")


def fitted(model, x: DataFrame, label: str) -> DataFrame:
    """x plus pred of a Spark ML regressor on x1, x2, x3, fitted on the days before the test."""
    features = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features")
    found = Pipeline(stages=[features, model.setLabelCol(label).setPredictionCol("pred")]).fit(x.where("part <> 'test'"))
    return found.transform(x).drop("features")


def trees(seed: int = 0) -> GBTRegressor:
    return GBTRegressor(maxIter=20, maxDepth=3, stepSize=0.1, seed=seed)


def scores(x: DataFrame, name: str, y: str = "y") -> DataFrame:
    return mean_ic(x.where("part = 'test'"), "part", y=y).select(F.lit(name).alias("model"), F.round("ic", 6).alias("ic"))


@query()
def ml_01(spark, d):
    """Boosted trees: predictions of the test days. No SQL."""
    return fitted(trees(), examples(spark, d), "y").where("part = 'test'").select("di", "ticker", F.round("pred", 8).alias("pred"))


@query()
def ml_03(spark, d):
    """Random forest: predictions of the test days. No SQL."""
    model = RandomForestRegressor(numTrees=30, maxDepth=6, seed=0)
    return fitted(model, examples(spark, d), "y").where("part = 'test'").select("di", "ticker", F.round("pred", 8).alias("pred"))


@query()
def ml_04(spark, d):
    """(model, ic, r2): boosted trees, and a second model on what they leave; r2 is on the fitted days. No SQL."""
    first = fitted(trees(), examples(spark, d), "y").withColumnRenamed("pred", "first").withColumn("left", F.col("y") - F.col("first"))
    second = fitted(trees(1), first, "left")
    r2 = second.where("part <> 'test'").agg(F.round(1 - F.sum(F.col("left") ** 2) / (F.var_pop("y") * F.count("*")), 6).alias("r2"))
    both = scores(second.withColumn("pred", F.col("first")), "trees").unionByName(scores(second, "second", "left"))
    return both.crossJoin(F.broadcast(r2))  # one row


def vectors(spark, d) -> DataFrame:
    """(vec_id, x, y, side): whole, finite vectors; every fifth is held out by a hash; y says whether the label is even."""
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    side = F.when(F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)) == 0, "test").otherwise("train")
    return S.table(spark, d, "embeddings").where(F.col("embedding").isNotNull() & whole).select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0).alias("y"), side.alias("side"))


@query()
def ml_05(spark, d, k: int = 32):
    """(vec_id, pca): k components, centred and fitted on the vectors that are not held out. No SQL; signs are Spark's."""
    v = vectors(spark, d).withColumn("v", array_to_vector("x"))
    steps = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c"), PCA(k=k, inputCol="c", outputCol="p")])
    return steps.fit(v.where("side = 'train'")).transform(v).select("vec_id", vector_to_array("p").alias("pca"))


@query()
def ml_09(spark, d):
    """(vec_id, pred): partial least squares of 8 components, fitted on the vectors that are not held out. No SQL."""
    v = vectors(spark, d)
    width = v.agg(F.max(F.size("x"))).first()[0] or 0
    v = v.where(F.size("x") == width)
    m = L.moments(v.where("side = 'train'"), "side", "x", "y", width).get("train")
    return v.select("vec_id", (F.round(L.predicted("x", *L.partial_least_squares(m, 8)), 6) if m else F.lit(None).cast("double")).alias("pred"))


# ----------------------------------------------------------------- placebos


def reassigned(x: DataFrame, value: str, name: str, salt, block: str) -> DataFrame:
    """x plus `name`: the value of another row of the same block; rows of a block are dealt by two orders of hashes."""
    key = F.concat_ws("|", F.lit(salt) if isinstance(salt, str) else salt, "di", "ticker")
    w = Window.partitionBy(block)
    left = x.withColumn("at", F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("a"), key)))))
    right = x.select(block, F.col(value).alias(name), F.row_number().over(w.orderBy(F.md5(F.concat(F.lit("b"), key)))).alias("at"))
    return left.join(right, [block, "at"]).drop("at")


_BLOCK = "substr(md5(concat_ws('|', di, ticker)), 1, 2)"


@query(S.with_sql("mom fwd", f""", x AS (SELECT mom.di, mom.ticker, value, fwd, {_BLOCK.replace('di, ticker', 'mom.di, mom.ticker')} AS block FROM mom JOIN fwd ON mom.di = fwd.di AND mom.ticker = fwd.ticker),
    l AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5('a' || concat_ws('|', 'placebo', di, ticker))) AS k FROM x), r AS (SELECT block, value AS other, row_number() OVER (PARTITION BY block ORDER BY md5('b' || concat_ws('|', 'placebo', di, ticker))) AS k FROM x)
    SELECT l.di, l.ticker, round(l.value, 6) AS value, round(other, 6) AS placebo, round(fwd, 6) AS fwd FROM l JOIN r USING (block, k)"""))
def ml_07(spark, d):
    """A placebo: values dealt anew over all rows, within 256 random blocks of the panel that are windows of their own."""
    p = P(spark, d)
    x = momentum(p).join(forward(p), ["di", "ticker"]).withColumn("block", F.expr(_BLOCK))
    return reassigned(x, "value", "placebo", "placebo", "block").select("di", "ticker", *r6("value", "placebo", "fwd"))


@query(S.with_sql("mom fwd", """, x AS (SELECT mom.di, mom.ticker, floor((row_number() OVER (PARTITION BY mom.di ORDER BY value, mom.ticker) - 1) * 5 / count(*) OVER (PARTITION BY mom.di)) AS a, floor((row_number() OVER (PARTITION BY mom.di ORDER BY fwd, mom.ticker) - 1) * 5 / count(*) OVER (PARTITION BY mom.di)) AS b FROM mom JOIN fwd ON mom.di = fwd.di AND mom.ticker = fwd.ticker),
    s AS (SELECT x.*, t.k FROM x, range(1, 16) t(k)),
    l AS (SELECT *, row_number() OVER (PARTITION BY k, di ORDER BY md5('a' || concat_ws('|', k, di, ticker))) AS i FROM s), r AS (SELECT k, di, b AS other, row_number() OVER (PARTITION BY k, di ORDER BY md5('b' || concat_ws('|', k, di, ticker))) AS i FROM s),
    c AS (SELECT k, a, b, count(*) AS n FROM (SELECT 0 AS k, a, b FROM x UNION ALL SELECT k, a, other FROM l JOIN r USING (k, di, i)) GROUP BY 1, 2, 3),
    m AS (SELECT k, sum(n / t * ln(n * t / (na * nb))) AS mi FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS t, sum(n) OVER (PARTITION BY k, a) AS na, sum(n) OVER (PARTITION BY k, b) AS nb FROM c) GROUP BY k)
    SELECT round(max(mi) FILTER (k = 0), 8) AS mi, round(avg(mi) FILTER (k > 0), 8) AS placebo FROM m"""))
def ml_08(spark, d, draws: int = 15):
    """Mutual information of momentum and forward return in fifths of the day, in nats, and its mean over placebos dealt within days."""
    p = P(spark, d)
    w = Window.partitionBy("di")

    def fifth(c: str):
        return F.floor((F.row_number().over(w.orderBy(c, "ticker")) - 1) * 5 / F.count("*").over(w))

    x = momentum(p).join(forward(p), ["di", "ticker"]).select("di", "ticker", fifth("value").alias("a"), fifth("fwd").alias("b"))
    s = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("day", F.struct("k", "di"))
    placebos = reassigned(s, "b", "other", F.col("k").cast("string"), "day").select("k", "a", F.col("other").alias("b"))
    cells = x.select(F.lit(0).alias("k"), "a", "b").unionByName(placebos).groupBy("k", "a", "b").agg(F.count("*").alias("n"))
    of = [F.sum("n").over(Window.partitionBy(*by)) for by in (("k",), ("k", "a"), ("k", "b"))]
    cells = cells.select("k", "n", *(c.alias(t) for c, t in zip(of, ("t", "na", "nb"), strict=True)))
    mi = cells.groupBy("k").agg(F.sum(F.expr("n / t * ln(n * t / (na * nb))")).alias("mi"))
    return mi.agg(F.round(F.max(F.when(F.col("k") == 0, F.col("mi"))), 8).alias("mi"), F.round(F.avg(F.when(F.col("k") > 0, F.col("mi"))), 8).alias("placebo"))


# -------------------------------------------------------------- user hooks


@query("SELECT provider, strftime(date, '%Y-%m-%d') AS date, ticker, round(w / coalesce(nullif(sum(w) OVER (PARTITION BY provider, date), 0), 1), 6) AS weight FROM (SELECT 'momentum' AS provider, date, ticker, greatest(value, 0) AS w FROM mom UNION ALL SELECT 'equal', date, ticker, 1.0 FROM p) WHERE date IN (SELECT max(date) FROM p GROUP BY year(date), month(date))", "mom")
def udf_01(spark, d):
    """Two providers on the last date of each month."""
    p = P(spark, d)
    dates = p.groupBy(F.year("date"), F.month("date")).agg(F.max("date").alias("date")).select("date")
    own = {"momentum": lambda panel, _: momentum(panel).withColumnRenamed("value", "weight"), "equal": lambda panel, _: panel.withColumn("weight", F.lit(1.0))}
    return U.provided(own, p, dates).select("provider", F.date_format("date", "yyyy-MM-dd").alias("date"), "ticker", *r6("weight"))


@query(f"SELECT scheme, di, ticker, round(coalesce(w / nullif(sum(abs(w)) OVER (PARTITION BY scheme, di), 0), 0), 6) AS weight FROM (SELECT 'square' AS scheme, di, ticker, s * abs(s) AS w FROM {_SCORED} UNION ALL SELECT 'best', di, ticker, CASE WHEN s > 0 THEN s - avg(s) OVER (PARTITION BY di) END FROM {_SCORED})", "lab own")
def udf_02(spark, d):
    """Two sizing schemes of a user: an expression, and a function over the day's rows."""
    above = F.when(F.col("s") > 0, F.col("s") - F.avg("s").over(Window.partitionBy("di")))
    return U.scheme_weights(scored_labels(spark, d), {"square": F.col("s") * F.abs("s"), "best": lambda x: x.withColumn("weight", above)}).select("scheme", "di", "ticker", *r6("weight"))


# --------------------------------------- indicators, cuts and probabilities

_ROWS = "r AS (SELECT *, row_number() OVER v AS rn, close - lag(close) OVER v AS ch, (high + low + close) / 3 AS tp, high - lag(high) OVER v AS up, lag(low) OVER v - low AS dn FROM p WINDOW v AS (PARTITION BY ticker ORDER BY di))"


def _ew(source: str, value: str, alpha: float, name: str) -> str:
    """SQL of (ticker, di, name): the exponentially weighted mean over all rows so far."""
    weight = f"pow({1 - alpha!r}, a.rn - b.rn)"
    return f"(SELECT a.ticker, a.di, sum(b.{value} * {weight}) / sum(CASE WHEN b.{value} IS NOT NULL THEN {weight} END) AS {name} FROM {source} a JOIN {source} b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY 1, 2)"


_INDICATORS = f""", {_ROWS}, k AS (SELECT *, CASE WHEN count(*) OVER n9 = 9 THEN 100 * (close - min(low) OVER n9) / nullif(max(high) OVER n9 - min(low) OVER n9, 0) END AS rsv FROM r WINDOW n9 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
    e10 AS {_ew('r', 'close', 2 / 11, 'ema10')}, e12 AS {_ew('r', 'close', 2 / 13, 'e12')}, e26 AS {_ew('r', 'close', 2 / 27, 'e26')}, kk AS {_ew('k', 'rsv', 1 / 3, 'kdj_k')},
    md AS (SELECT ticker, di, rn, e12 - e26 AS macd FROM e12 JOIN e26 USING (ticker, di) JOIN r USING (ticker, di)), sg AS {_ew('md', 'macd', 2 / 10, 'macd_signal')},
    dev AS (SELECT a.ticker, a.di, avg(abs(b.tp - a.m)) AS dev FROM (SELECT *, avg(tp) OVER (PARTITION BY ticker ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m FROM r) a JOIN r b ON a.ticker = b.ticker AND b.rn BETWEEN a.rn - 19 AND a.rn WHERE a.rn >= 20 GROUP BY 1, 2),
    s AS (SELECT ticker, di, rn, CASE WHEN rn >= 200 THEN avg(close) OVER n200 END AS sma200, CASE WHEN rn >= 20 THEN avg(close) OVER n20 END AS boll, CASE WHEN rn >= 20 THEN tp - avg(tp) OVER n20 END AS above,
        CASE WHEN rn > 14 THEN sum(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) OVER n14 END AS plus, CASE WHEN rn > 14 THEN sum(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) OVER n14 END AS minus,
        CASE WHEN rn > 14 THEN sum(CASE WHEN step > 0 THEN tp * volume ELSE 0 END) OVER n14 END AS gain, CASE WHEN rn > 14 THEN sum(CASE WHEN step < 0 THEN tp * volume ELSE 0 END) OVER n14 END AS loss
        FROM (SELECT *, tp - lag(tp) OVER (PARTITION BY ticker ORDER BY di) AS step FROM r) WINDOW n200 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), n20 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), n14 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    SELECT ticker, di, round(sma200, 6) AS sma200, round(boll, 6) AS boll_mid, round(ema10, 6) AS ema10, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd - macd_signal, 6) AS macd_hist, round(kdj_k, 6) AS kdj_k, round(above / nullif(0.015 * dev, 0), 4) AS cci, round(100 * abs(plus - minus) / nullif(plus + minus, 0), 6) AS dx, round(100 * gain / nullif(gain + loss, 0), 6) AS mfi
    FROM s JOIN e10 USING (ticker, di) JOIN md USING (ticker, di) JOIN sg USING (ticker, di) JOIN kk USING (ticker, di) LEFT JOIN dev USING (ticker, di)"""


@query(S.with_sql("p", _INDICATORS))
def ind_01_rest(spark, d):
    return more_indicators(P(spark, d))


def more_indicators(p: DataFrame) -> DataFrame:
    """The indicators beside ind_01's: means with weights fading by the row, flows and directions over 14 rows; whole windows only."""
    x = p.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    x = x.withColumns({"up": F.col("high") - W.shift_own("high", 1), "dn": W.shift_own("low", 1) - F.col("low"), "step": F.col("tp") - W.shift_own("tp", 1)})
    part = lambda c, v: F.when(c, v).when(F.col("up").isNotNull(), 0.0)
    x = x.withColumns(
        {
            "plus": part((F.col("up") > F.col("dn")) & (F.col("up") > 0), F.col("up")),
            "minus": part((F.col("dn") > F.col("up")) & (F.col("dn") > 0), F.col("dn")),
            "gain": part(F.col("step") > 0, F.col("tp") * F.col("volume").cast("double")),
            "loss": part(F.col("step") < 0, F.col("tp") * F.col("volume").cast("double")),
            "rsv": 100 * (F.col("close") - W.rolling(F.min, "low", 9)) / F.nullif(W.rolling(F.max, "high", 9) - W.rolling(F.min, "low", 9), F.lit(0.0)),
            "seen": F.collect_list("tp").over(W.own().rowsBetween(-19, 0)),
        }
    )
    total = lambda c: W.rolling(F.sum, c, 14)
    share = lambda a, b, up: 100 * up / F.nullif(total(a) + total(b), F.lit(0.0))
    mean = W.rolling(F.avg, "tp", 20)
    for name, value, span in (("fast", "close", 12), ("slow", "close", 26), ("ema10", "close", 10), ("kdj_k", "rsv", 5)):  # a span of 5: a third for the newest
        x = W.with_ewm(x, name, value, span=span)
    x = W.with_ewm(x.withColumns({"mean": mean, "macd": F.col("fast") - F.col("slow")}), "macd_signal", "macd", span=9)
    dev = F.aggregate("seen", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("mean"))) / 20
    found = {
        "sma200": W.rolling(F.avg, "close", 200),
        "boll_mid": W.rolling(F.avg, "close", 20),
        "ema10": F.col("ema10"),
        "macd": F.col("macd"),
        "macd_signal": F.col("macd_signal"),
        "macd_hist": F.col("macd") - F.col("macd_signal"),
        "kdj_k": F.col("kdj_k"),
        "dx": share("plus", "minus", F.abs(total("plus") - total("minus"))),
        "mfi": share("gain", "loss", total("gain")),
    }
    return x.select("ticker", "di", *(F.round(c, 6).alias(n) for n, c in found.items()), F.round((F.col("tp") - F.col("mean")) / F.nullif(0.015 * dev, F.lit(0.0)), 4).alias("cci"))


_TIERED = f"(SELECT s.action, s.di, s.car5, CASE WHEN coalesce(n, 0) > q[2] THEN 'top' WHEN coalesce(n, 0) > q[1] THEN 'mid' ELSE 'tail' END AS tier, CASE WHEN year(g.date) >= 1995 THEN 'late' ELSE 'early' END AS era, CASE WHEN abs(s.o_orderkey % 5 - s.o_orderkey // 5 % 5) >= 2 THEN 'notches' ELSE 'notch' END AS notch FROM {_STUDY} s JOIN grades g USING (o_orderkey) LEFT JOIN (SELECT company, count(*) AS n FROM grades WHERE action <> 'init' GROUP BY 1) c ON c.company = g.company, (SELECT quantile_cont(n, [1 / 3, 2 / 3]) AS q FROM (SELECT company, count(*) AS n FROM grades WHERE action <> 'init' GROUP BY 1)))"


@query(S.with_sql("own grades cal", f", z AS (SELECT action, unnest(['all', tier, era, notch]) AS cut, di, car5 FROM {_TIERED} WHERE car5 IS NOT NULL), m AS (SELECT action, cut, count(*) AS n, avg(car5) AS m, stddev_samp(car5) AS sd FROM z GROUP BY 1, 2 HAVING count(*) >= 10), c AS (SELECT action, cut, sum(pow(s, 2)) AS c2 FROM (SELECT action, cut, di, sum(car5 - m) AS s FROM z JOIN m USING (action, cut) GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT action, cut, n, round(m, 6) AS mean, round(m / (sd / sqrt(n)), 4) AS t_iid, round(m / (sqrt(c2) / n), 4) AS t_day FROM m JOIN c USING (action, cut)"))
def es_02_cuts(spark, d):
    """es_02 for all events, by how many up and down events a company has (thirds of the companies), by era, and by whether a grade moves two notches or more.

    The tables have no grades: an event's old and new grade are two digits of its key to the base of five.
    """
    g = S.grades(spark, d).select("o_orderkey", "company", "date", "action")
    n = g.where("action <> 'init'").groupBy("company").agg(F.count("*").alias("n"))
    cuts = n.agg(F.percentile("n", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    of = n.crossJoin(F.broadcast(cuts)).select("company", F.when(F.col("n") > F.col("q")[1], "top").when(F.col("n") > F.col("q")[0], "mid").otherwise("tail").alias("tier"))  # one row
    x = study(spark, d).where("car5 is not null").join(g.drop("action"), "o_orderkey").join(of, "company", "left")
    era = F.when(F.year("date") >= 1995, "late").otherwise("early")
    notch = F.when(F.abs(F.col("o_orderkey") % 5 - F.floor(F.col("o_orderkey") / 5) % 5) >= 2, "notches").otherwise("notch")
    x = x.select("action", "di", "car5", F.explode(F.array(F.lit("all"), F.coalesce("tier", F.lit("tail")), era, notch)).alias("cut"))
    days = x.groupBy("action", "cut", "di").agg(F.sum("car5").alias("s"), F.count("*").alias("k"))
    cut = x.groupBy("action", "cut").agg(F.count("*").alias("n"), F.avg("car5").alias("m"), F.stddev_samp("car5").alias("sd")).where("n >= 10")
    c2 = days.join(F.broadcast(cut), ["action", "cut"]).groupBy("action", "cut").agg(F.sum((F.col("s") - F.col("k") * F.col("m")) ** 2).alias("c2"))  # a row a cut
    return cut.join(c2, ["action", "cut"]).select("action", "cut", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") / (F.col("sd") / F.sqrt("n")), 4).alias("t_iid"), F.round(F.col("m") / (F.sqrt("c2") / F.col("n")), 4).alias("t_day"))


#: The coefficients of a rational form of erfc, right to 1.5e-7.
ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_T = "1 / (1 + 0.3275911 * abs(t) / sqrt(2))"
_P = "(" + " + ".join(f"{c} * pow({_T}, {i})" for i, c in enumerate(ERFC, 1)) + ") * exp(-t * t / 2)"


@query(f"SELECT label, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM (SELECT label, {_P} AS p FROM (SELECT label, ic * sqrt((n - 2) / greatest(1 - ic * ic, 1e-9)) AS t FROM (SELECT p_size AS label, count(*) AS n, corr(p_partkey, p_retailprice) AS ic FROM part GROUP BY 1 HAVING count(*) > 10)))")
def fn_16_p(spark, d):
    """The two-sided normal probability of each correlation's t, and its stars."""
    g = S.table(spark, d, "part").groupBy(F.col("p_size").alias("label")).agg(F.count("*").alias("n"), F.corr(F.col("p_partkey").cast("double"), "p_retailprice").alias("ic")).where("n > 10")
    t = g.select("label", F.expr("ic * sqrt((n - 2) / greatest(1 - ic * ic, 1e-9))").alias("t"))
    p = t.select("label", F.expr(_P).alias("p"))
    return p.select("label", F.round("p", 6).alias("p"), F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns").alias("stars"))
