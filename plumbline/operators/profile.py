"""Column statistics, column classes and dataset shape.

A *dataset* is a slice of a DataFrame: the rows sharing one value of the
``by`` column, or the whole frame when ``by`` is None. Every operator works on
all slices in one job. Two physical inputs lead to the same long table with
one row per (dataset, column):

* typed frames: one wide partial aggregate per batch of columns, so the
  shuffle carries one row per dataset and map task, whatever the row count;
* cell rows from delimited files: ``(dataset_id, row_id, cells array<string>)``,
  exploded by position, because every file has its own width.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.defaults import (
    COLUMN_CLASSES,
    DATE_SHARE,
    FREETEXT_LENGTH,
    FREETEXT_RATIO,
    SENTINELS,
)
from plumbline.functions.cells import (
    as_text,
    date_like,
    is_missing,
    is_numeric_type,
    is_sentinel,
    text_key,
)
from plumbline.functions.scoring import ratio
from plumbline.session import settle

WHOLE = "all"
NULL_DATASET = "<null>"
on_column = ["dataset_id", "col_idx"]
_BATCH = 150
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def dataset_key(by: str | None) -> Column:
    """The dataset a row belongs to.

    Rows without a key are the dataset ``<null>``; a key that is itself such
    a text gets one more ``<`` in front.
    """
    if by is None:
        return F.lit(WHOLE).alias("dataset_id")
    key = F.col(f"`{by}`").cast("string")
    named = F.when(key.rlike("^<+null>$"), F.concat(F.lit("<"), key)).otherwise(key)
    return F.coalesce(named, F.lit(NULL_DATASET)).alias("dataset_id")


def measured_columns(
    df: DataFrame, by: str | None, columns: list[str] | None
) -> list[tuple[str, T.DataType]]:
    names = columns if columns is not None else [c for c in df.columns if c != by]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [(name, kinds[name]) for name in names]


def dataset_keys(df: DataFrame, by: str | None, keys: DataFrame | None = None) -> DataFrame:
    """The list of datasets to report on.

    A dataset without rows vanishes from a grouping, so callers that know the
    full list pass it as ``keys`` and get a row for the empty ones too.
    """
    if keys is not None:
        return keys.select(F.col("dataset_id").cast("string")).distinct()
    if by is None:
        return df.sparkSession.range(1).select(F.lit(WHOLE).alias("dataset_id"))
    return df.select(dataset_key(by)).distinct()


def column_stats(
    df: DataFrame,
    by: str | None = None,
    columns: list[str] | None = None,
    *,
    clean: bool = True,
    text_length: bool = False,
    sentinels: list[str] = SENTINELS,
) -> DataFrame:
    """One row per (dataset, column) with the counts behind every dimension.

    Only what is asked for is computed: null counts always, sentinel counts
    and text lengths on request, and nothing but null counts for
    columns whose type already settles the rest.
    """
    fields = list(enumerate(measured_columns(df, by, columns)))
    batches = [fields[i : i + _BATCH] for i in range(0, len(fields), _BATCH)]
    parts = [_stats_batch(df, by, b, clean, text_length, sentinels) for b in batches]
    return reduce(DataFrame.unionByName, parts)


def _stats_batch(df, by, batch, clean, text_length, sentinels) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    rows = []
    for idx, (name, kind) in batch:
        cell = F.col(f"`{name}`")
        text = as_text(cell, kind)
        typed = is_numeric_type(kind)
        written = isinstance(kind, (T.StringType, *_NESTED))
        n_null = F.col(f"null_{idx}")
        aggregates.append(F.count_if(is_missing(cell, kind)).alias(f"null_{idx}"))
        held = F.col("n_rows") - n_null
        row = [
            F.lit(idx).alias("col_idx"),
            F.lit(name).alias("col_name"),
            F.lit(kind.simpleString()).alias("col_type"),
            (F.lit(typed) | ((held == 0) & (F.col("n_rows") > 0))).alias("is_numeric"),
            n_null.alias("n_nulls"),
        ]
        if clean:
            if not written:
                row.append(held.alias("n_clean"))
            else:
                aggregates.append(
                    F.count_if(~is_sentinel(text, sentinels)).alias(f"clean_{idx}")
                )
                row.append(F.col(f"clean_{idx}").alias("n_clean"))
        if text_length:
            if not written:
                row.append(F.lit(None).cast("long").alias("text_length"))
            else:
                length = F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long")
                aggregates.append(length.alias(f"len_{idx}"))
                row.append(F.col(f"len_{idx}").alias("text_length"))
        rows.append(F.struct(*row))
    grouped = df.groupBy(dataset_key(by)).agg(*aggregates)
    return grouped.select("dataset_id", "n_rows", F.inline(F.array(*rows)))


def dataset_shape(stats: DataFrame, keys: DataFrame, n_columns: int | None = None) -> DataFrame:
    """rows, cols, total_cells and n_nulls per dataset, empty datasets included."""
    shape = stats.groupBy("dataset_id").agg(
        F.max("n_rows").alias("rows"),
        F.count(F.lit(1)).alias("cols"),
        F.sum("n_nulls").alias("n_nulls"),
    )
    cols = F.coalesce(F.col("cols"), F.lit(n_columns).cast("long"), F.lit(0).cast("long"))
    rows = F.coalesce(F.col("rows"), F.lit(0).cast("long"))
    return keys.join(shape, "dataset_id", "left").select(
        "dataset_id",
        rows.alias("rows"),
        cols.alias("cols"),
        (rows * cols).alias("total_cells"),
        F.coalesce("n_nulls", F.lit(0).cast("long")).alias("n_nulls"),
    )


def long_cells(
    df: DataFrame,
    by: str | None,
    columns: list[str] | None,
    row_id: str | None = None,
    positions: dict[str, int] | None = None,
) -> DataFrame:
    """Unpivot measured columns to (dataset_id, [order_key], col_idx, text).

    ``positions`` keeps the numbering of a wider column list.
    """
    fields = measured_columns(df, by, columns)
    numbers = [positions[name] if positions else i for i, (name, _) in enumerate(fields)]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("col_idx"), as_text(F.col(f"`{name}`"), kind).alias("text")
            )
            for i, (name, kind) in zip(numbers, fields, strict=True)
        ]
    )
    order = [] if row_id is None else [F.col(f"`{row_id}`").alias("order_key")]
    return df.select(dataset_key(by), *order, F.inline(cells)).where("text is not null")


def date_share(cells: DataFrame, sample: int | None = None) -> DataFrame:
    """Share of a column's non-null cells that are dates.

    ``cells`` is (dataset_id, col_idx, text). With ``sample``, only the first
    so many cells in the order of ``order_key`` count; the rank filter turns
    into a group limit before the shuffle, so at most ``sample`` cells per map
    task and column travel.
    """
    if sample is not None:
        first = Window.partitionBy("dataset_id", "col_idx").orderBy("order_key")
        cells = cells.withColumn("position", F.row_number().over(first)).where(
            F.col("position") <= sample
        )
    return cells.groupBy("dataset_id", "col_idx").agg(
        F.avg(date_like(F.col("text")).cast("double")).alias("date_share"),
        F.count(F.lit(1)).alias("n_sampled"),
    )


def distinct_texts(cells: DataFrame) -> DataFrame:
    """Exact number of distinct texts per (dataset, column).

    Long texts travel as their SHA-256, short ones as themselves, and equal
    texts are merged on the map side before the shuffle.
    """
    return (
        cells.groupBy("dataset_id", "col_idx", text_key(F.col("text")).alias("token"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("dataset_id", "col_idx")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def classify(
    stats: DataFrame,
    dates: DataFrame,
    distinct: DataFrame,
    *,
    date_cut: float = DATE_SHARE,
    freetext_ratio: float = FREETEXT_RATIO,
    freetext_length: float = FREETEXT_LENGTH,
) -> DataFrame:
    """Class of every column, decided in the order date, numeric, freetext, categorical."""
    mean_length = ratio(F.col("text_length"), F.col("n_rows") - F.col("n_nulls"), None)
    spread = ratio(F.col("n_distinct"), F.col("n_rows"))
    kind = (
        F.when(F.col("date_share") > date_cut, "date")
        .when(F.col("is_numeric"), "numeric")
        .when((spread > freetext_ratio) & (mean_length > freetext_length), "freetext")
        .otherwise("categorical")
    )
    on = ["dataset_id", "col_idx"]
    return (
        stats.join(dates, on, "left")
        .join(distinct, on, "left")
        .select(
            "dataset_id",
            "col_idx",
            "col_name",
            "n_rows",
            "n_nulls",
            "n_distinct",
            mean_length.alias("mean_length"),
            "date_share",
            kind.alias("class"),
        )
    )


def column_classes(
    df: DataFrame,
    row_id: str,
    by: str | None = None,
    columns: list[str] | None = None,
    *,
    date_sample: int | None = None,
    **cuts,
) -> DataFrame:
    """Profile every column of every dataset and name its class.

    The date share is that of all values, or of the first ``date_sample`` in
    the order of ``row_id``. Distinct counts decide only where a text column
    is long on average, so only such columns are counted; elsewhere
    ``n_distinct`` is null.
    """
    fields = measured_columns(df, by, columns)
    names = [name for name, _ in fields]
    stats = settle(column_stats(df, by, names, clean=False, text_length=True), "stats")
    dated = [name for name, kind in fields if not isinstance(kind, T.BooleanType)]
    positions = {name: i for i, name in enumerate(names)}
    order = None if date_sample is None else row_id
    dates = date_share(long_cells(df, by, dated, order, positions), date_sample)
    texts = [name for name, kind in fields if isinstance(kind, (T.StringType, *_NESTED))]
    length = cuts.get("freetext_length", FREETEXT_LENGTH)
    if texts:
        position = {name: i for i, name in enumerate(names)}
        cells = long_cells(df, by, texts, positions=position)
        distinct = distinct_texts(cells.join(long_texts(stats, length), on_column, "left_semi"))
    else:
        distinct = stats.select(*on_column, F.lit(None).cast("long").alias("n_distinct")).limit(0)
    return classify(stats, dates, distinct, **cuts)


def long_texts(stats: DataFrame, length: float = FREETEXT_LENGTH) -> DataFrame:
    """The columns whose mean text length passes the free-text cut."""
    held = F.col("n_rows") - F.col("n_nulls")
    return stats.where(
        ~F.col("is_numeric") & (F.col("text_length") > F.lit(float(length)) * held)
    ).select(*on_column)


def class_counts(classes: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """numeric_cols, categorical_cols, date_cols and freetext_cols per dataset."""
    counted = classes.groupBy("dataset_id").agg(
        *[F.count_if(F.col("class") == c).alias(f"{c}_cols") for c in COLUMN_CLASSES]
    )
    if keys is None:
        return counted
    zero = F.lit(0).cast("long")
    return keys.select("dataset_id").join(counted, "dataset_id", "left").select(
        "dataset_id",
        *[F.coalesce(f"{c}_cols", zero).alias(f"{c}_cols") for c in COLUMN_CLASSES],
    )
