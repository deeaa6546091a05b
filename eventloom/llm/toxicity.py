"""Toxicity by a chain of linear classifiers over words and word beginnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.session import stage_once

#: About so many labelled documents are learned from, chosen by a hash of their id; the rest of the labels is not needed.
TRAINING_ROWS = 12_000
#: Terms of the model: those whose share of a category's rows is furthest from chance, in standard deviations.
VOCABULARY, MIN_ROWS, MIN_DEVIATIONS = 4096, 3, 4.0
#: The bounded training rows go to this many partitions, so few that an iteration is one small stage.
PARTS = 2
FOLDS = 3
PREFIX = 4
#: Strength of the L1 penalty, which leaves most terms without weight: long texts gather no noise.
PENALTY = 0.0005
ITERATIONS = 30
THRESHOLD = 0.5


@dataclass
class Chain:
    """Fitted links in their order; ``columns`` are the probabilities each yields."""

    terms: CountVectorizerModel
    links: list[LogisticRegressionModel]
    columns: list[str]


def terms_of(text: Column) -> Column:
    """Distinct lower-cased words and, marked, their first letters: stems are known with endings never seen."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), "")
    return F.array_union(words, F.transform(words, lambda w: F.concat(F.lit("^"), F.substring(w, 1, PREFIX))))


def sample_below(rows: int, total: int) -> int | None:
    """Signed 64-bit hashes below this are about ``rows`` of ``total``; None if all are wanted."""
    return None if rows >= total else -(1 << 63) + (rows << 64) // total


def usable_labels(labels: DataFrame, categories: dict[str, Column]) -> DataFrame:
    """(doc_id, one 0/1 column per category), once per id, of the labels without NULL; a category holds if any label says so."""
    marked = labels.select("doc_id", *[c.cast("double").alias(f"is_{n}") for n, c in categories.items()]).na.drop()
    return marked.groupBy("doc_id").agg(*[F.max(f"is_{n}").alias(f"is_{n}") for n in categories])


def training_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], rows: int = TRAINING_ROWS) -> DataFrame:
    """(fold, terms, one 0/1 column per category) of about ``rows`` labelled documents, whatever their number.

    Rows with one id are one document, with the text of the least hash: their number does not add to the bound.
    """
    marked = usable_labels(labels, categories)
    below = sample_below(rows, marked.count())
    few = marked if below is None else marked.filter(F.xxhash64("doc_id") < F.lit(below))
    # The sample has its bound from ``rows``, so it may be broadcast to the scan of the documents.
    marks = [f"is_{n}" for n in categories]
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    found = found.groupBy("doc_id", *marks).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return found.select(
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"), terms_of(F.col("least.text")).alias("terms"), *marks,
    )


def _probability(model: LogisticRegressionModel, rows: DataFrame, name: str) -> DataFrame:
    scored = model.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_class").transform(rows)
    return scored.withColumn(name, vector_to_array("_probability")[1]).drop("_probability", "_raw", "_class")


def _assembled(rows: DataFrame, before: list[str]) -> DataFrame:
    """Terms and the probabilities of the earlier links, as one vector."""
    return VectorAssembler(inputCols=["_terms", *before], outputCol="_features").transform(rows)


def telling_terms(training: DataFrame, categories: list[str]) -> list[str]:
    """At most VOCABULARY terms that stand in a category's rows more, or less, often than chance has it."""
    marks = [f"is_{c}" for c in categories]
    base = training.agg(*[F.avg(m).alias(m) for m in marks]).first()
    counted = training.select(F.explode("_terms_text").alias("term"), *marks).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in marks],
    ).filter(F.col("n") >= MIN_ROWS)
    far = [
        F.abs(F.col(m) - F.col("n") * base[m]) / F.sqrt(F.col("n") * max(base[m] * (1 - base[m]), 1e-9)) for m in marks
    ]
    furthest = F.greatest(*far) if len(far) > 1 else far[0]
    kept = counted.select("term", furthest.alias("far")).filter(F.col("far") >= MIN_DEVIATIONS)
    return [r.term for r in kept.orderBy(F.desc("far"), "term").limit(VOCABULARY).collect()]


def _vectors(training: DataFrame, categories: list[str]) -> CountVectorizerModel:
    """Terms that tell the categories of ``training`` apart, as a model from ``_terms_text`` to ``_terms``."""
    chosen = telling_terms(training, categories) or [""]
    return CountVectorizerModel.from_vocabulary(chosen, inputCol="_terms_text", outputCol="_terms").setBinary(True)


def _fitted(rows: DataFrame, category: str, before: list[str]) -> LogisticRegressionModel:
    """One link: ``category`` from ``_terms`` and the probabilities of the links before it."""
    learner = LogisticRegression(
        featuresCol="_features", labelCol=f"is_{category}", regParam=PENALTY, elasticNetParam=1.0, maxIter=ITERATIONS,
    )
    return learner.fit(_assembled(rows, before))


def out_of_fold(rows: DataFrame, category: str, categories: list[str], before: list[str]) -> DataFrame:
    """``rows`` (fold, _terms_text, one 0/1 column per category, the columns ``before``) with ``p_<category>``.

    A fold's probabilities come from terms picked and a model fitted on the other folds alone, so no label of the fold
    has a part in them. Where there are no other folds nothing is known: 0.5.
    """
    column, parts = f"p_{category}", []
    for fold in range(FOLDS):
        held, rest = rows.filter(F.col("fold") == fold), rows.filter(F.col("fold") != fold)
        if rest.isEmpty():
            parts.append(held.withColumn(column, F.lit(0.5)))
            continue
        terms = _vectors(rest, categories)
        model = _fitted(stage_once(terms.transform(rest).drop("_terms_text"), "other-folds"), category, before)
        parts.append(_probability(model, _assembled(terms.transform(held), before), column).drop("_features", "_terms"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_chain(training: DataFrame, categories: list[str]) -> Chain | None:
    """A classifier per category, in order; None without training rows.

    Each later link also reads the probabilities of all earlier ones. For training these come from terms and models
    that did not see the row's fold (see ``out_of_fold``), so later links learn how far earlier ones can be trusted.
    """
    if training.isEmpty():
        return None
    rows = stage_once(training.withColumnRenamed("terms", "_terms_text").repartition(PARTS, "fold", "_terms_text"), "training")
    terms = _vectors(rows, categories)
    links, columns = [], []
    for i, category in enumerate(categories):
        links.append(_fitted(stage_once(terms.transform(rows).drop("_terms_text"), "vectors"), category, columns))
        if i + 1 < len(categories):
            rows = stage_once(out_of_fold(rows, category, categories, columns).coalesce(PARTS), "out-of-fold")
        columns = [*columns, f"p_{category}"]
    return Chain(terms, links, columns)


def score(docs: DataFrame, chain: Chain | None, categories: list[str]) -> DataFrame:
    """``docs`` with a probability column ``p_<category>`` per category; all 0 if there was nothing to learn from."""
    if chain is None:
        return docs.withColumns({f"p_{c}": F.lit(0.0) for c in categories})
    kept = [f"`{c}`" for c in docs.columns if c not in chain.columns]
    rows = docs.select(F.struct(*kept).alias("_row"), terms_of(F.col("text")).alias("_terms_text"))
    rows = chain.terms.transform(rows).drop("_terms_text")
    for i, (model, column) in enumerate(zip(chain.links, chain.columns)):
        rows = _probability(model, _assembled(rows, chain.columns[:i]), column).drop("_features")
    return rows.select("_row.*", *chain.columns)


def categories_of_labels() -> dict[str, Column]:
    """The chain over ``labels``: poor writing first, toxicity after it."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def judge(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, threshold: float = THRESHOLD, rows: int = TRAINING_ROWS) -> DataFrame:
    """``docs`` with all their columns, ``p_<category>`` per category and ``toxic`` (the last probability reaches ``threshold``).

    ``docs`` has ``doc_id`` and ``text``; ``labels`` has ``doc_id`` and what ``categories`` reads. Every row is scored
    over its whole text, also those learned from. NULL and empty texts have no terms and get the base rates.
    About ``rows`` labelled documents are learned from. Labels that are NULL or whose document is missing are not used;
    a document labelled several times counts once and has the categories that any of its labels names; rows that share
    an id teach as one document, with the text of the least hash. Without any usable label nothing is toxic, and if there are some but none is drawn to learn from, this is
    an error. Repeated rows repeat; columns named like the results are
    replaced. An empty table gives no rows.
    """
    categories = categories or categories_of_labels()
    training = stage_once(training_rows(docs, labels, categories, rows), "labelled")
    if training.isEmpty() and not usable_labels(labels, categories).join(docs.select("doc_id"), "doc_id", "left_semi").isEmpty():
        raise ValueError("No usable label was drawn for training")
    chain = fit_chain(training, list(categories))
    scored = score(docs, chain, list(categories))
    return scored.withColumn("toxic", F.col(f"p_{list(categories)[-1]}") >= threshold)


def remove_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` with just their columns that are not judged toxic."""
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    return judge(whole, labels, **params).filter(~F.col("toxic")).select("_whole.*")
