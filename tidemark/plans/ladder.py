"""The ladder of regressions: each rung fits on the earlier interval and is measured on the later one."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import asof as A
from tidemark.operators import sparse as S
from tidemark.operators import features as X
from tidemark.operators import models as M
from tidemark.operators import ranks

Rung = Callable[[DataFrame, DataFrame], DataFrame]
#: The dense columns of the rungs on all signals, in their order.
DENSE = ("author_prior", "domain_prior", "body_length", "has_body", "has_url", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend")
BODY = ("body_length", "has_body")


def story_features(stories: DataFrame, label: str, id_: str = "id", time: str = "time") -> DataFrame:
    """Stories (title, text, by, url, time, label) with the rungs' predictions from the past and the dense columns.

    Priors are those of each row's own bound, over earlier and later interval together; a key without a past has the trailing mean.
    """
    plain = T.strip_html(F.col("text"), T.unescape_common)
    rows = stories.withColumns({"_plain": plain, "domain": T.hostname(F.col("url"))})
    rows = rows.withColumns({"body_length": T.body_length(F.col("_plain")), "has_body": T.has_body(F.col("_plain")), "has_url": T.has_url(F.col("url")), "body": F.col("_plain"), **T.temporal(F.col(time))}).drop("_plain")
    slim = rows.select(id_, "by", "domain", time, label)  # a key's rows meet in a task, so without their texts
    for name, key in (("author", "by"), ("domain", "domain")):
        slim = A.prior_mean(slim, key, time, label, A.Prior(), f"{name}_own")
    same = [id_, "by", "domain", time]
    past = slim.drop(label).distinct().withColumnsRenamed({c: f"_{c}" for c in same})
    rows = rows.join(past, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same])).drop(*[f"_{c}" for c in same])
    first = A.trailing_rung(slim, id_, time, F.col(label))
    rows = rows.join(first, id_)
    return rows.withColumns({f"{n}_prior": F.coalesce(f"{n}_own_mean", "rung1") for n in ("author", "domain")})


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as tasks may run at once, where there are fewer; texts are long, so few rows are much work."""
    parts = S.slots(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def given(column: str) -> Rung:
    """A rung whose prediction is a column that the past has given already."""
    return lambda train, test: test.withColumn("predicted", F.col(column))


def dense_ridge(columns: Sequence[str], label: str, alpha: float = 1.0) -> Rung:
    def rung(train: DataFrame, test: DataFrame) -> DataFrame:
        scaler = X.fit_scaler(train, columns)
        w = M.ridge_dense(X.scale(train, scaler), columns, label, alpha)
        scaled = X.scale(test, scaler)
        return scaled.withColumn("predicted", sum((F.col(c) * w[c] for c in columns), F.lit(w["intercept"])))

    return rung


@dataclass
class Features:
    """One TF-IDF block for each text column, then the scaled columns; all fitted on the earlier interval."""

    texts: Sequence[str]
    columns: Sequence[str]
    id_: str = "id"
    max_features: int = 50_000
    blocks: list[tuple[DataFrame, str]] = field(default_factory=list)
    scaler: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, train: DataFrame) -> Features:
        self.blocks = [(X.fit_tfidf(train, self.id_, t, self.max_features), t) for t in self.texts]
        spark = train.sparkSession  # a vocabulary is bounded by max_features, so it is kept as rows
        self.blocks = [(spark.createDataFrame(v.collect(), v.schema), t) for v, t in self.blocks]
        self.scaler = X.fit_scaler(train, self.columns) if self.columns else {}
        return self

    def of(self, df: DataFrame) -> DataFrame:
        return X.vectors(X.scale(df, self.scaler), self.blocks, self.columns)


@dataclass
class Shared:
    """Counts of all texts' terms and the scaled columns, made once from an earlier and a later interval for all rungs on them."""

    texts: Sequence[str]
    columns: Sequence[str]
    label: str
    id_: str = "id"
    max_features: int = 50_000
    made: list[DataFrame] = field(default_factory=list)
    idf: list[list[float]] = field(default_factory=list)
    of: tuple = ()

    def fit(self, train: DataFrame, test: DataFrame) -> Shared:
        if self.of and self.of[0] is train and self.of[1] is test:
            return self
        self.free()
        vocabs = []
        for t in self.texts:
            found = X.frequent_terms(train, t, self.max_features)
            vocabs.append(X.top_terms(train, t, self.max_features) if found is None else found)
        scaler = X.fit_scaler(train, self.columns)
        for df in (train, test):
            df = X.scale(df, scaler)
            for t, vocab in zip(self.texts, vocabs, strict=True):
                df = X.count_block(df, vocab, t, f"_counts_{t}")
            self.made.append(df.select(self.id_, self.label, *[f"_counts_{t}" for t in self.texts], *[F.col(c).cast("double").alias(c) for c in self.columns]).persist())
        self.idf = [X.idf_of_counts(self.made[0], f"_counts_{t}") if vocab else [1.0] for t, vocab in zip(self.texts, vocabs, strict=True)]
        self.of = (train, test)
        return self

    def vectors(self, texts: Sequence[str], columns: Sequence[str]) -> list[DataFrame]:
        """id, label and features of the earlier and the later interval: blocks of these texts, then these columns."""
        out = []
        for df in self.made:
            for t in texts:
                df = X.weigh_block(df, f"_counts_{t}", self.idf[self.texts.index(t)], f"_block_{t}")
            joined = VectorAssembler(inputCols=[*[f"_block_{t}" for t in texts], *columns], outputCol="features").transform(df)
            out.append(joined.select(self.id_, self.label, "features"))
        return out

    def free(self) -> None:
        for df in self.made:
            df.unpersist()
        self.made, self.idf, self.of = [], [], ()

    def rung(self, texts: Sequence[str], columns: Sequence[str], model: Callable[[DataFrame], object]) -> Rung:
        def run(train: DataFrame, test: DataFrame) -> DataFrame:
            rows, asked = self.fit(train, test).vectors(texts, columns)
            rows = rows.persist()
            fitted = model(rows)
            rows.unpersist()
            return fitted.transform(asked).withColumnRenamed("prediction", "predicted")

        run.free = self.free
        return run


def text_ridge(texts: Sequence[str], columns: Sequence[str], label: str, id_: str = "id", alpha: float = 1.0, max_features: int = 50_000, solver: str = "l-bfgs") -> Rung:
    def rung(train: DataFrame, test: DataFrame) -> DataFrame:
        made = Features(texts, columns, id_, max_features).fit(train)
        rows = made.of(train).select("features", label).persist()
        model = M.ridge(rows, label, alpha=alpha, solver=solver)
        rows.unpersist()
        return model.transform(made.of(test)).withColumnRenamed("prediction", "predicted")

    return rung


def text_trees(texts: Sequence[str], columns: Sequence[str], label: str, id_: str = "id", max_features: int = 50_000, **options) -> Rung:
    def rung(train: DataFrame, test: DataFrame) -> DataFrame:
        made = Features(texts, columns, id_, max_features).fit(train)
        rows = made.of(train).select("features", label).persist()
        model = S.boosted_sparse(rows, label, settings=S.Settings(**options))
        rows.unpersist()
        return model.transform(made.of(test).select(id_, label, "features")).withColumnRenamed("prediction", "predicted")

    return rung


def text_trees_stopped(texts: Sequence[str], columns: Sequence[str], label: str, held: Callable[[DataFrame], DataFrame], id_: str = "id", max_features: int = 50_000, **options) -> Rung:
    """Early-stopped trees; held marks the validation rows of the earlier interval. Vocabularies and scales are fitted without them."""

    def rung(train: DataFrame, test: DataFrame) -> DataFrame:
        marked = train.withColumn("_held", held(train))
        made = Features(texts, columns, id_, max_features).fit(marked.where("NOT _held"))
        rows = made.of(marked).select("features", label, "_held").persist()
        model = M.boosted_early(rows.where("NOT _held"), rows.where("_held"), label, **options)
        rows.unpersist()
        return model.predict(made.of(test))

    return rung


def six_rungs(label: str, id_: str = "id", max_features: int = 50_000, solver: str = "sparse", **trees) -> dict[str, Rung]:
    """Over story_features(): the trailing mean, an author's and a domain's past, ridge on the body, ridge and boosted trees on all signals. The last three share their features."""
    shared = Shared(["title", "body"], DENSE, label, id_, max_features)
    ridge = lambda rows: S.ridge_sparse(rows, label) if solver == "sparse" else M.ridge(rows, label, solver=solver)
    return {
        "1 trailing mean": given("rung1"),
        "2 author": given("author_prior"),
        "3 domain": given("domain_prior"),
        "4 body ridge": shared.rung(["body"], BODY, ridge),
        "5 all signals ridge": shared.rung(["title", "body"], DENSE, ridge),
        "6 all signals trees": shared.rung(["title", "body"], DENSE, lambda rows: S.boosted_sparse(rows, label, settings=S.Settings(**trees))),
    }


def run_ladder(spark: SparkSession, rungs: Mapping[str, Rung], train: DataFrame, test: DataFrame, label: str, id_: str, k: int = 100) -> DataFrame:
    """rung and its measures, one row for each rung."""
    parts = [rung(train, test).select(F.lit(name).alias("rung"), id_, F.col("predicted").cast("double").alias("predicted"), label) for name, rung in rungs.items()]
    predicted = reduce(DataFrame.unionByName, parts).persist()
    out = ranks.reports(predicted, "rung", "predicted", label, id_, k)
    predicted.unpersist()
    for rung in rungs.values():
        getattr(rung, "free", lambda: None)()
    at = {name: i for i, name in enumerate(rungs)}
    return spark.createDataFrame(sorted(map(tuple, out.collect()), key=lambda r: at[r[0]]), out.schema)


def score(model: Callable[[DataFrame], DataFrame], rows: DataFrame, id_: str = "id") -> DataFrame:
    """Batch predictions: id and predicted, from a fitted rung's predict."""
    return model(rows).select(id_, "predicted")


def markdown(table: DataFrame, k: int = 100) -> str:
    """The rungs as a table; precision at k is shown as a count."""
    lines = [f"| Rung | RMSE | MAE | Spearman | P@{k} |", "|-|-|-|-|-|"]
    lines += [f"| {r.rung} | {r.rmse:.4f} | {r.mae:.4f} | {r.spearman:.4f} | {round(r.precision * k)}/{k} |" for r in table.collect()]
    return "\n".join(lines)
