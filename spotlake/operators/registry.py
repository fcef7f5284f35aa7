"""Filters on the sample registry, and sample-id resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUMAN = "Homo sapiens"
# Fixed value: organ alias used when resolving sample ids.
ORGAN_ALIASES = {"Colorectal": "Bowel"}
# Registry columns offered as filter options.
OPTION_COLUMNS = ("organ", "disease_state", "st_technology", "species", "preservation_method")


def _same(column: str, wanted: str) -> Column:
    return F.lower(F.col(column)) == F.lower(F.lit(wanted))


def filter_samples(samples: DataFrame, **wanted: str | None) -> DataFrame:
    """Case-insensitive conjunction over the given registry columns; None means no constraint."""
    for column, value in wanted.items():
        if value:
            samples = samples.filter(_same(column, value))
    return samples


def select_samples(
    samples: DataFrame, sample: str | None = None, take_all: bool = False, limit: int | None = None,
    order: str = "sample_id", **wanted: str | None,
) -> DataFrame:
    """Precedence of the download command: an exact id, else everything, else the filters, else nothing."""
    if sample:
        chosen = samples.filter(F.col("id") == sample)
    elif take_all:
        chosen = samples
    elif any(wanted.values()):
        chosen = filter_samples(samples, **wanted)
    else:
        chosen = samples.filter(F.lit(False))
    return chosen.orderBy(order).limit(limit) if limit else chosen


def human_only(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("species") == HUMAN)


def by_organ(samples: DataFrame, organ: str) -> DataFrame:
    """Exact match after resolving the alias."""
    return samples.filter(F.col("organ") == ORGAN_ALIASES.get(organ, organ))


def by_technology(samples: DataFrame, part: str, organ: str | None = None) -> DataFrame:
    if organ:
        samples = samples.filter(F.lower("organ") == organ.lower())
    return samples.filter(F.col("st_technology").contains(part))


def available_only(samples: DataFrame, available: DataFrame, key: str = "sample_id") -> DataFrame:
    return samples.join(available.select(key).distinct(), key, "left_semi")


def with_fallback(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """``filtered``, or ``everything`` when the filter leaves no row (decided inside the query)."""
    n = filtered.agg(F.count(F.lit(1))).scalar()
    return filtered.unionByName(everything.filter(n == 0))


def explicit_ids(samples: DataFrame, wanted: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted ids, and the ids nobody knows."""
    ids = wanted.select(key).distinct()
    return samples.join(ids, key, "left_semi"), ids.join(samples.select(key), key, "left_anti")


def sample_ids(
    samples: DataFrame, files: DataFrame, organ: str | None = None, features: DataFrame | None = None,
    max_samples: int | None = None, order: str = "sample_id",
) -> DataFrame:
    """Human samples with files, optionally of one organ; all files when none is left; then features."""
    chosen = available_only(human_only(samples), files)
    if organ:
        chosen = by_organ(chosen, organ)
    chosen = with_fallback(chosen.select("sample_id"), files.select("sample_id").distinct())
    if features is not None:
        chosen = available_only(chosen, features)
    return chosen.orderBy(order).limit(max_samples) if max_samples is not None else chosen


def options(samples: DataFrame, columns: tuple[str, ...] = OPTION_COLUMNS) -> DataFrame:
    """Distinct non-null values per option column with their number; the values of a column are few."""
    have = [c for c in columns if c in samples.columns]
    long = samples.select(*have).unpivot([], have, "field", "value").filter(F.col("value").isNotNull())
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_samples"))


def category_counts(samples: DataFrame, *columns: str) -> DataFrame:
    return samples.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def requested_files(ids: DataFrame, files: DataFrame, extras: tuple[str, ...] = ()) -> DataFrame:
    """Files that belong to wanted ids (``id.*`` or ``id_*`` at any depth) or match an extra LIKE pattern.

    The owning id is cut out of the file name, so the match is an equi join and not a join on patterns:
    an id may itself contain ``_`` or ``.``, so every prefix that ends before one of them is offered.
    """
    name = F.element_at(F.split("path", "/"), -1)
    ends = F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(1)).isin(".", "_"))
    offered = files.select("path", name.alias("name")).select(
        "path", F.explode(F.transform(ends, lambda i: F.substring("name", F.lit(1), i - 1))).alias("id"))
    hit = offered.join(ids.select("id").distinct(), "id", "left_semi").select("path")
    for pattern in extras:
        hit = hit.unionByName(files.filter(F.col("path").like(pattern)).select("path"))
    return hit.distinct()
