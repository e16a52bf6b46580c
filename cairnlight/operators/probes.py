"""Text probes with held-out folds by patient."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlight.functions.dates import local_date
from cairnlight.operators.ranking import hash_rank
from cairnlight.session import written


def probe_counts(encounters: DataFrame, observations: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(patient, label, terms, pairs): how often each description stands before the cutoff, how often two follow each other in their sorted order, and whether the patient has a cutoff.

    terms and pairs are arrays of (term, n). A description that occurs n times follows itself n - 1 times.
    """
    rows = observations.select("patient", "description", local_date("date").alias("d")).unionByName(encounters.select("patient", "description", local_date("start").alias("d")))
    kept = rows.join(cutoffs, "patient", "left").filter("patient is not null and description is not null and d is not null and (cutoff is null or d < cutoff)")
    term = F.lower(F.regexp_replace("description", "[^A-Za-z0-9]+", "_")).alias("term")
    n = kept.groupBy("patient", F.col("cutoff").isNotNull().cast("double").alias("label"), term).agg(F.count(F.lit(1)).alias("n"))
    listed = n.groupBy("patient", "label").agg(F.array_sort(F.filter(F.collect_list(F.struct("term", "n")), lambda x: x["term"] != "")).alias("terms"))
    following = F.expr("""concat(transform(filter(terms, x -> x.n > 1), x -> struct(concat(x.term, ' ', x.term) as term, x.n - 1 as n)),
        transform(slice(terms, 2, size(terms)), (x, i) -> struct(concat(terms[i].term, ' ', x.term) as term, 1L as n)))""")
    return listed.withColumn("pairs", following)


def hashed_counts(counts: str, features: int) -> Column:
    """The array of (term, n) as a sparse vector of term frequencies; terms of the same bucket add up."""

    @F.udf(returnType=VectorUDT())
    def vector(items: list) -> SparseVector:
        summed: dict[int, float] = {}
        for bucket, n in items:
            summed[bucket] = summed.get(bucket, 0.0) + n
        return SparseVector(features, summed)

    return vector(F.transform(counts, lambda x: F.struct(F.pmod(F.hash(x["term"]), F.lit(features)).alias("bucket"), x["n"].alias("n"))))


def grouped_probe(counts: DataFrame, group: str, terms: str, pairs: str, label: str, folds: int = 5, features: int = 1 << 12) -> DataFrame:
    """(group, label, fold, prediction) of held-out rows: groups are dealt over the folds by hash within each class, so classes are spread evenly and a group is never on both sides.

    terms and pairs are arrays of (term, n), taken as term frequencies. Weights balance the classes; the term weights of a fold are learnt on its training side alone.
    """
    hashed = counts.select(group, label, hashed_counts(terms, features).alias("_a"), hashed_counts(pairs, features).alias("_b"))
    own = counts.groupBy(group).agg(F.min(label).alias("_s"))
    place = hash_rank(own, ["_s"], [group], "_r").select(group, F.pmod(F.col("_r"), F.lit(folds)).cast("int").alias("fold"))
    rows = written(hashed.join(place, group))
    out = None
    for k in range(folds):
        train, test = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(counts) < 2:
            continue
        total = sum(counts.values())
        weight = F.lit(1.0)
        for value, n in counts.items():
            weight = F.when(F.col(label) == value, total / (len(counts) * n)).otherwise(weight)
        prepared = train.withColumn("_w", weight)
        for a, b in (("_a", "_c"), ("_b", "_d")):
            model = IDF(inputCol=a, outputCol=b, minDocFreq=2).fit(prepared)
            prepared, test = model.transform(prepared), model.transform(test)
        both = VectorAssembler(inputCols=["_c", "_d"], outputCol="_x")
        fitted = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=20, regParam=0.01).fit(both.transform(prepared))
        held = fitted.transform(both.transform(test)).select(group, label, "fold", "prediction")
        out = held if out is None else out.unionByName(held)
    if out is None:
        return rows.select(group, label, "fold", F.lit(None).cast("double").alias("prediction")).limit(0)
    return out


def grouped_classes(rows: DataFrame, group: str, label: str, features: str, folds: int = 5) -> DataFrame:
    """(group, label, fold, prediction) of held-out rows for any number of classes: balanced multinomial logistic regression over an array of numbers.

    Groups are dealt over the folds by hash within their rarest class, so classes are spread evenly and a group is never on both sides. Features are scaled by the training side alone.
    A fold whose training side has one class predicts that class. Null features count as 0.
    """
    filled = F.transform(features, lambda x: F.coalesce(x, F.lit(0.0)))
    data = rows.filter(F.col(label).isNotNull()).select(F.col(group).alias("_g"), F.col(label).cast("string").alias("_y"), array_to_vector(filled).alias("_f"))
    size = data.groupBy("_y").agg(F.count(F.lit(1)).alias("_n"))
    own = data.select("_g", "_y").distinct().join(size, "_y").groupBy("_g").agg(F.min(F.struct("_n", "_y"))["_y"].alias("_s"))
    place = hash_rank(own, ["_s"], ["_g"], "_r").select("_g", F.pmod(F.col("_r"), F.lit(folds)).cast("int").alias("fold"))
    names = [r["_y"] for r in size.orderBy(F.desc("_n"), "_y").collect()]  # the classes
    numbers = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))]) if names else None
    if not names:
        return data.select(F.col("_g").alias(group), F.col("_y").alias(label), F.lit(0).alias("fold"), F.lit(None).cast("string").alias("prediction"))
    data = written(data.join(place, "_g").withColumn("_l", numbers[F.col("_y")]))
    out, labels = None, F.array(*[F.lit(n) for n in names])
    for k in range(folds):
        train, test = data.filter(F.col("fold") != k), data.filter(F.col("fold") == k)
        counts = {r["_l"]: r["n"] for r in train.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(counts) < 2:
            held = test.withColumn("_p", F.lit(next(iter(counts), 0.0)))
        else:
            weights = F.create_map(*[x for v, n in counts.items() for x in (F.lit(v), F.lit(sum(counts.values()) / (len(counts) * n)))])
            scaler = StandardScaler(inputCol="_f", outputCol="_x", withMean=True).fit(train)
            fitted = LogisticRegression(featuresCol="_x", labelCol="_l", weightCol="_w", predictionCol="_p", family="multinomial", maxIter=10, regParam=0.01).fit(scaler.transform(train).withColumn("_w", weights[F.col("_l")]))
            held = fitted.transform(scaler.transform(test))
        held = held.select(F.col("_g").alias(group), F.col("_y").alias(label), "fold", F.element_at(labels, F.col("_p").cast("int") + 1).alias("prediction"))
        out = held if out is None else out.unionByName(held)
    return out


def confusion(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """Counts per true and predicted class, with the recall of the true class."""
    n = predicted.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    total = predicted.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return n.join(total, label).select(label, prediction, "n", (F.col("n") / F.col("_n")).alias("share"))


def balanced_accuracy(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """(accuracy, balanced): overall accuracy and the mean of the classes' recalls."""
    hit = (F.col(label) == F.col(prediction)).cast("double")
    per = predicted.groupBy(label).agg(F.sum(hit).alias("h"), F.count(F.lit(1)).alias("n"))
    return per.agg((F.sum("h") / F.sum("n")).alias("accuracy"), F.avg(F.col("h") / F.col("n")).alias("balanced"))
