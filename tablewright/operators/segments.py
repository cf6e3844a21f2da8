"""k-means segmentation."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import col, finite, require_numeric
from tablewright.operators.anomalies import complete_rows
from tablewright.operators.sampling import SEED

ROWS_PER_SEGMENT = 3
MAX_ITERATIONS = 300


def segment_rows(
    df: DataFrame, columns: list[str], clusters: int, seed: int = SEED, max_iterations: int = MAX_ITERATIONS
) -> tuple[DataFrame, DataFrame]:
    """Append ``segment`` (1..clusters, missing for incomplete rows); also return the
    mean of each field and the row count per segment.

    Segments are numbered by their centres, in the order of the first field, then the
    next ones, so equal clusters bear equal labels whatever the seed.
    """
    columns, clusters = list(columns), int(clusters)
    require_numeric(df, *columns)
    if not columns or clusters < 2:
        raise ValueError("Choose at least one numeric field and two segments.")
    inputs = [f"__x{i}" for i in range(len(columns))]
    complete = complete_rows(df, columns)
    prepared = df.withColumns({n: finite(df, c) for n, c in zip(inputs, columns)})
    needed = clusters * ROWS_PER_SEGMENT
    training = prepared.filter(complete).select(*inputs)
    if training.limit(needed).count() < needed:
        raise ValueError(f"{clusters} segments need {needed} rows that hold all fields.")

    assembler = VectorAssembler(inputCols=inputs, outputCol="__raw", handleInvalid="keep")
    scaler = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True)
    assembled = assembler.transform(training)
    scaling = scaler.fit(assembled)
    model = KMeans(
        k=clusters, seed=seed, maxIter=max_iterations, tol=1e-4, featuresCol="__scaled", predictionCol="__cluster"
    ).fit(scaling.transform(assembled).select("__scaled"))

    centres = [tuple(centre) for centre in model.clusterCenters()]
    ranks = {cluster: rank for rank, cluster in enumerate(sorted(range(len(centres)), key=centres.__getitem__), 1)}
    label = F.element_at(F.array(*[F.lit(ranks[c]) for c in range(len(centres))]), F.col("__cluster") + 1)
    labelled = model.transform(scaling.transform(assembler.transform(prepared)))
    segmented = labelled.select(
        *[col(n) for n in df.columns if n != "segment"],
        F.when(complete, label).cast("int").alias("segment"),
    )
    return segmented, segment_profiles(segmented, columns)


def segment_profiles(segmented: DataFrame, columns: list[str]) -> DataFrame:
    return segmented.filter(F.col("segment").isNotNull()).groupBy("segment").agg(
        *[F.round(F.avg(finite(segmented, c)), 3).alias(c) for c in columns], F.count("*").alias("rows")
    )
