"""Reproducible splits, folds and samples. Every random choice is an MD5 of the
row key, so it does not depend on partitioning, order or reruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinarium.functions.labels import not_neutral, row_digest
from opinarium.session import materialize

SPLITS = ("train", "val", "test")
_RESOLUTION = 10_000
_PREFIX = 4  # hex digits: 65 536 buckets per stratum


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"split shares add up to {train + val + test:.4f} instead of 1")


def _draw(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def split_by_hash(df: DataFrame, key: str, train: float = 0.6, val: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``. One pass without a shuffle; the shares hold on average."""
    check_ratios(train, val, test)
    bucket = F.conv(F.substring(_draw(key, seed), 1, 8), 16, 10).cast("long") % _RESOLUTION
    return df.withColumn(
        "split",
        F.when(bucket < round(train * _RESOLUTION), SPLITS[0])
        .when(bucket < round((train + val) * _RESOLUTION), SPLITS[1])
        .otherwise(SPLITS[2]),
    )


def split_stratified(
    df: DataFrame, key: str, stratum: str | None = None, train: float = 0.6, val: float = 0.2, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``split`` with exact sizes inside each stratum; ``key`` is unique.

    Rows are ordered by their draw. Bucket counts tell in which bucket each cut
    falls, only the rows of those buckets are ranked, and the draw found there
    becomes the cut. The table itself is never shuffled, however large a
    stratum is.
    """
    check_ratios(train, val, test)
    group = F.lit("") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit("\u0000"))
    drawn = df.select("*", group.alias("_group"), _draw(key, seed).alias("_draw"))
    drawn = drawn.withColumn("_bucket", F.substring("_draw", 1, _PREFIX))

    counts = drawn.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most 65 536 rows per stratum reach these windows.
    upto = Window.partitionBy("_group").orderBy("_bucket")
    counts = counts.select(
        "_group",
        "_bucket",
        (F.sum("n").over(upto) - F.col("n")).alias("before"),
        F.sum("n").over(upto).alias("through"),
        F.sum("n").over(Window.partitionBy("_group")).alias("total"),
    )
    rest = F.ceil(F.col("total") * F.lit(val + test))
    held = F.ceil(rest * F.lit(test / (val + test) if val + test else 0.0))
    cuts = counts.select(
        "*",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("cut"), (F.col("total") - rest).alias("rank")),
                F.struct(F.lit(1).alias("cut"), (F.col("total") - held).alias("rank")),
            )
        ).alias("c"),
    ).filter((F.col("c.rank") > F.col("before")) & (F.col("c.rank") <= F.col("through")))
    cuts = cuts.select("_group", "_bucket", "c.cut", (F.col("c.rank") - F.col("before")).alias("wanted"))
    # At most two rows per stratum, and likewise one below. Written out, their
    # size is known when a join is planned, so the table is shuffled only if
    # there are very many strata.
    cuts = materialize(cuts, "split-cuts")

    place = F.row_number().over(Window.partitionBy("_group", "_bucket").orderBy("_draw"))
    edges = (
        drawn.select("_group", "_bucket", "_draw")
        .join(cuts.select("_group", "_bucket").distinct(), ["_group", "_bucket"], "left_semi")
        .withColumn("place", place)
        .join(cuts, ["_group", "_bucket"])
        .filter(F.col("place") == F.col("wanted"))
        .groupBy("_group")
        .agg(
            F.max(F.when(F.col("cut") == 0, F.col("_draw"))).alias("_train"),
            F.max(F.when(F.col("cut") == 1, F.col("_draw"))).alias("_val"),
        )
    )
    edges = materialize(edges, "split-edges")
    # A missing cut means that the split before it is empty; blank sorts first.
    return (
        drawn.join(edges, "_group", "left")
        .withColumn(
            "split",
            F.when(F.col("_draw") <= F.coalesce("_train", F.lit("")), SPLITS[0])
            .when(F.col("_draw") <= F.coalesce("_val", "_train", F.lit("")), SPLITS[1])
            .otherwise(SPLITS[2]),
        )
        .drop("_group", "_draw", "_bucket", "_train", "_val")
    )


def split_without_neutrals(df: DataFrame, key: str, rating: str = "overall_rating", **ratios: float) -> DataFrame:
    """The same split with neutral ratings left out, so a row is in one split
    whether or not neutrals are kept."""
    return split_by_hash(df, key, **ratios).filter(not_neutral(F.col(rating)))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1; per class the folds differ by at most one row.

    The rank of a row is the number of rows in earlier buckets plus its place in
    its own bucket, so the ranking window covers one small bucket at a time.
    """
    drawn = df.select("*", _draw(key, seed).alias("_draw")).withColumn("_bucket", F.substring("_draw", 1, _PREFIX))
    counts = drawn.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(label).orderBy("_bucket")
    counts = counts.select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_b"), (F.sum("n").over(upto) - F.col("n")).alias("_before")
    )
    counts = materialize(counts, "fold-offsets")
    same = F.col(label).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b"))
    place = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_draw"))
    return (
        drawn.join(counts, same, "left")
        .withColumn("fold", ((F.col("_before") + place - 1) % k).cast("int"))
        .drop("_draw", "_bucket", "_label", "_b", "_before")
    )


def sample_unique(
    df: DataFrame, n: int, key: str, unique: str = "review_text", rating: str | None = "overall_rating", seed: int = 42
) -> DataFrame:
    """``n`` rows, none neutral and no two alike in ``unique`` (in every column
    but the key when ``unique`` is absent); all of them when fewer remain.

    Duplicates are found on a digest and the lowest key stands for its copies;
    that minimum is taken on the map side, so many copies of one text cost
    nothing extra. Full rows are fetched only for the keys drawn.
    """
    if rating is not None and rating in df.columns:
        df = df.filter(not_neutral(F.col(rating)))
    names = [unique] if unique in df.columns else [c for c in df.columns if c != key]
    parts = []
    for name in names:
        column = F.col(name).cast("string")
        parts += [F.isnull(column).cast("string"), F.coalesce(F.length(column), F.lit(0)).cast("string"), F.coalesce(column, F.lit(""))]
    chosen = (
        df.groupBy(F.sha2(F.concat_ws(":", *parts), 256).alias("_digest"))
        .agg(F.min(key).alias(key))
        .orderBy(_draw(key, seed), F.col(key))
        .limit(n)
        .select(key)
    )
    return df.join(chosen, key, "left_semi")


def head_per_split(df: DataFrame, n: int, key: str, split: str = "split") -> DataFrame:
    """The first ``n`` rows of each split by key."""
    window = Window.partitionBy(split).orderBy(key)
    return df.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= n).drop("_place")


def union_splits(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name."""
    if not parts:
        raise ValueError("no splits given")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def row_ids(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Adds ``row_id``, the split and a digest of the row."""
    return df.withColumn("row_id", F.concat_ws(":", F.col(split), row_digest(*[F.col(c) for c in columns])))


def assert_no_neutrals(df: DataFrame, polarity: str = "true_polarity") -> None:
    """Fails when a row has no polarity; reads only until one is found."""
    if not df.filter(F.col(polarity).isNull()).isEmpty():
        raise ValueError("rows without a polarity")
