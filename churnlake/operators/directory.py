"""The customer directory as a stored table: paging (SV4, S6), search (SV3, PF9) and the rows of the dashboard document (SV11).

``store`` sorts the directory once, (churn_probability descending, id ascending), and keeps four Parquet tables below one folder:

* ``rows``: the directory, range-partitioned and sorted, with ``row``, a bigint that grows along the order (partition number
  and place in it, so it has gaps); row groups hold ``GROUP_ROWS`` rows, so their footers' minima and maxima prune by ``row``;
* ``fences``: every ``GROUP_ROWS``-th row of each partition with ``position``, its number from 0 without gaps;
* ``postings``: (gram, all columns of ``rows``) for every trigram of the lower-cased id, range-partitioned and sorted by
  (gram, row), so a search reads the row groups of one gram only and joins nothing. Costs about as many copies of the
  (narrow) directory as an id has trigrams;
* ``grams``: (gram, n), the number of postings; bounded by the alphabet cubed.

Only fences and gram counts asked for by key reach the driver: a few rows per call. Nothing is gathered when the tables are
made; executors can be lost at any time, each table is written from the one before.

Defined results: a null id has no trigrams and is found by its status only; null scores come last; rows that agree in
(score, id) are all kept and paged by ``row``; an empty directory has empty pages, finds and an empty array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a row group, and between fences.
GROUP_ROWS = 10_000
GRAM = 3
_PLACE_BITS = 33  # monotonically_increasing_id: the partition above, the place in it below


@dataclass(frozen=True)
class Directory:
    spark: SparkSession
    path: str
    group_rows: int

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def rows(self) -> DataFrame:
        return self.table("rows")


def _write(df: DataFrame, path: str, group_rows: int) -> None:
    df.write.mode("overwrite").option("parquet.block.row.count.limit", group_rows).parquet(path)


def store(directory: DataFrame, path: str, group_rows: int = GROUP_ROWS) -> Directory:
    """Write the four tables below ``path``, over those of an earlier call. One sort of the directory, one of the postings."""
    out = Directory(directory.sparkSession, path, group_rows)
    ordered = directory.orderBy(F.col("churn_probability").desc_nulls_last(), F.col("id").asc_nulls_last())
    _write(ordered.withColumn("row", F.monotonically_increasing_id()), f"{path}/rows", group_rows)

    part, place = F.shiftright("row", _PLACE_BITS), F.col("row").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # one row per partition of the sort: as many as tasks, so one window over them is small at any size
    sizes = out.rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    fences = out.rows.filter(place % group_rows == 0).select("row", part.alias("part"), place.alias("place"), "churn_probability", "id")
    fences = fences.join(sizes, "part").select("row", (F.col("before") + F.col("place")).alias("position"), "churn_probability", "id")
    _write(fences.orderBy("row"), f"{path}/fences", group_rows)

    name = F.lower(F.col("id"))
    starts = F.when(F.length(name) >= GRAM, F.sequence(F.lit(1), F.length(name) - (GRAM - 1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(GRAM))))
    postings = out.rows.select(F.explode(grams).alias("gram"), "*")
    _write(postings.orderBy("gram", "row"), f"{path}/postings", group_rows)
    _write(out.table("postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy("gram"), f"{path}/grams", group_rows)
    return out


def _fence(fences: DataFrame, cond: Column, last: bool):
    """The last or first fence that meets ``cond`` (None: no such fence): an aggregate to one row."""
    pick = F.max_by if last else F.min_by
    return fences.filter(cond).agg(pick(F.struct("row", "position"), "row").alias("f")).head()["f"]


def _between(d: Directory, low, high) -> DataFrame:
    """Rows from fence ``low`` up to before fence ``high`` (None: to the end); the bounds reach the Parquet footers."""
    rows = d.rows
    if low is not None:
        rows = rows.filter(F.col("row") >= low["row"])
    return rows if high is None else rows.filter(F.col("row") < high["row"])


def page(d: Directory, number: int, size: int) -> DataFrame:
    """SV4: page ``number`` from 0, by position; reads the row groups between two fences, not those of earlier pages."""
    first = number * size
    fences = d.table("fences")
    low = _fence(fences, F.col("position") <= first, last=True)
    high = _fence(fences, F.col("position") >= first + size, last=False)
    skip = first - (low["position"] if low else 0)
    return _between(d, low, high).orderBy("row").offset(skip).limit(size)


def page_after(d: Directory, after: tuple | None, size: int) -> DataFrame:
    """S6: the page behind the key (score, id), which need not be in the directory. Scores and ids must not be null."""
    if after is None:
        return page(d, 0, size)
    score, key = after
    fences = d.table("fences")
    s, i = F.col("churn_probability"), F.col("id")
    behind = s.isNull() | (s < F.lit(score)) | ((s == F.lit(score)) & (i.isNull() | (i > F.lit(key))))
    low = _fence(fences, ~behind, last=True)
    following = _fence(fences, behind, last=False)
    high = _fence(fences, F.col("position") >= following["position"] + size, last=False) if following else None
    return _between(d, low, high).filter(behind).orderBy("row").limit(size)


def search(d: Directory, term: str = "", status: str = "All") -> DataFrame:
    """SV3 / PF9 on the index: the rows of ``serving.search_customers``, with ``row``.

    An id that holds the term holds each of its trigrams: the postings of the rarest one are read and checked by
    ``contains``; a trigram without postings ends the search. Terms under three letters have no trigram and are looked for in the rows themselves.
    A term found in a status takes that status's rows whole, by a filter on the status column."""
    q = term.lower()
    rows = d.rows
    in_id = F.coalesce(F.lower("id").contains(F.lit(q)), F.lit(False))
    in_status = F.coalesce(F.lower("status").contains(F.lit(q)), F.lit(False))
    chosen = F.lit(True) if status == "All" else F.col("status") == F.lit(status)
    if len(q) < GRAM:
        return rows.filter((in_id | in_status) & chosen)
    grams = sorted({q[i:i + GRAM] for i in range(len(q) - GRAM + 1)})
    counts = {r["gram"]: r["n"] for r in d.table("grams").filter(F.col("gram").isin(grams)).collect()}  # as many as the term has
    by_status = rows.filter(in_status & chosen)
    if len(counts) < len(grams):
        return by_status
    rarest = min(grams, key=lambda g: (counts[g], g))
    by_id = d.table("postings").filter((F.col("gram") == rarest) & in_id & ~in_status & chosen).select(*rows.columns)
    return by_id.unionByName(by_status)
