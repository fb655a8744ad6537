"""Crawl tables from stored pages (PIPE9, PG12, JN6, SRC8, SNK1, SNK2).

List pages give items (link, name, notice number); detail pages give label/value records;
the two are merged on the link (detail wins), pivoted to one column per label and exported,
and one crawl-log row per list page is appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.operators import pages as PG
from pawgrid.operators import stats as ST


def crawl_table(list_pages: DataFrame, detail_pages: DataFrame, base: str | Column, labels: list[str],
                container: str = "div.lst_wrap") -> DataFrame:
    """PG12: list item columns and one column per label of ``labels`` — one row per listed item.

    ``detail_pages`` holds ``(page_id = link, html)``.  A label that the detail page has (even with
    a null value) wins over the list item's column of the same name (JN6); other items keep theirs."""
    link = K.PAGE_ITEM_LINK
    labels = [x for x in (K.PAGE_ITEM_NAME, K.PAGE_KEY_NOTICE) if x not in labels] + labels  # shared with the items
    items = PG.list_items(list_pages, base, container=container)
    records = PG.detail_records(detail_pages.withColumnRenamed("page_id", link), key=link)
    # labels given, so the pivot needs no pass to discover them; the struct tells a null value from no label
    wide = (records.groupBy(F.col(link).alias("__link")).pivot("key", labels).agg(F.first(F.struct("value")))
            .withColumnsRenamed({x: f"__{x}" for x in labels}))
    joined = items.join(wide, F.col(link) == F.col("__link"), "left")
    shared = [c for c in items.columns if c in labels]
    value = {x: F.col(f"__{x}")["value"] for x in labels}
    return joined.select(
        *[F.when(F.col(f"__{c}").isNotNull(), value[c]).otherwise(F.col(c)).alias(c) if c in shared else F.col(c)
          for c in items.columns],
        *[value[x].alias(x) for x in labels if x not in shared])


def open_crawl_table(list_pages: DataFrame, detail_pages: DataFrame, base: str | Column, labels: list[str] = (),
                     container: str = "div.lst_wrap", rest: str = "other_labels") -> DataFrame:
    """PG12 with an open schema: the list item columns, one column per label of ``labels``, and ``rest``, a
    map of every other label that the item's detail page has.  No label is lost and none has to be
    known; as in :func:`crawl_table` a label of the page wins over the item's column, even with a null value.

    The records stay whole in their rows (one map per page), so nothing is pivoted and no pass looks
    for labels.  Of detail pages with the same link one is taken (the smallest record as text)."""
    link = K.PAGE_ITEM_LINK
    items = PG.list_items(list_pages, base, container=container)
    records = PG.detail_maps(detail_pages.withColumnRenamed("page_id", link), key=link)
    one = records.groupBy(F.col(link).alias("__link")).agg(F.min_by("labels", F.to_json("labels")).alias("__labels"))
    joined = items.join(one, F.col(link) == F.col("__link"), "left")
    shared = [c for c in items.columns if c in (K.PAGE_ITEM_NAME, K.PAGE_KEY_NOTICE)]
    asked = [x for x in labels if x not in shared]
    has = lambda x: F.coalesce(F.map_contains_key("__labels", F.lit(x)), F.lit(False))
    value = lambda x: F.try_element_at("__labels", F.lit(x))
    other = F.map_filter("__labels", lambda k, _: ~k.isin(*shared, *asked))
    return joined.select(
        *[F.when(has(c), value(c)).otherwise(F.col(c)).alias(c) if c in shared else F.col(c) for c in items.columns],
        *[value(x).alias(x) for x in asked],
        F.coalesce(other, F.create_map().cast("map<string,string>")).alias(rest))


def widen(table: DataFrame, rest: str = "other_labels", max_labels: int = 2000) -> DataFrame:
    """SRC8: the union of all labels as columns (sorted), in place of the map ``rest``.

    One pass counts the labels; more than ``max_labels`` are refused, as columns are part of the plan
    (the map itself has no such bound)."""
    found = PG.label_inventory(table, rest).select("key").orderBy("key").limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"more than {max_labels} labels: keep the map, or ask for labels by name")
    clash = [r["key"] for r in found if r["key"] in table.columns]
    if clash:
        raise ValueError(f"labels named like columns: {clash}")
    return table.select("*", *[F.try_element_at(rest, F.lit(r["key"])).alias(r["key"]) for r in found]).drop(rest)


def scan_list_pages_in_ranges(list_pages: DataFrame, base: str | Column, path: str, page_col: str = "page_no",
                              container: str = "div.lst_wrap", max_pages: int | None = None, first: int = 1024) -> DataFrame:
    """SRC7 for a long list: the rows of :func:`scan_list_pages`, each page parsed once and none beyond the range
    that holds the stop page.

    Page numbers are taken in rising ranges (``first`` pages, then twice as many each time).  A range is
    parsed and written to ``path``, with a mark for every page that lists no item; when it holds a mark
    the scan ends there.  So a job per range runs on the cluster, and the driver sees one number of each."""
    spark = list_pages.sparkSession
    pages = list_pages.where(F.col("html").isNotNull() & F.col(page_col).isNotNull())
    low, top = pages.agg(F.min(page_col), F.max(page_col)).first()
    if max_pages is not None and low is not None:
        low, top = max(low, 1), min(top, max_pages)
    found = lambda: spark.read.parquet(path)
    size, stop = first, None
    while low is not None and low <= top and stop is None:
        part = PG.list_items(pages.where(F.col(page_col).between(low, min(low + size - 1, top))), base, container=container,
                             key=page_col, mark_empty=True)
        home = f"{path.rstrip('/')}/from_page={low}"
        part.write.mode("overwrite").parquet(home)
        stop = spark.read.parquet(home).where(F.col("pos").isNull()).agg(F.min(page_col)).first()[0]
        low, size = low + size, 2 * size
    if size == first:  # no page to read
        return PG.list_items(pages.where(F.lit(False)), base, container=container, key=page_col)
    items = found().drop("from_page").where(F.col("pos").isNotNull())
    return items if stop is None else items.where(F.col(page_col) < stop)


def crawl_log_rows(items: DataFrame, batch_col: str = "page_id", stamp: Column | None = None) -> DataFrame:
    """SNK2 rows: ``(timestamp, collected_count, animal_names)`` per crawl run (``batch_col``)."""
    ts = stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    s = ST.crawl_summary(items, batch_col, order_col="pos")
    return s.select(ts.alias("timestamp"), "collected_count", "animal_names", batch_col)


def scan_list_pages(list_pages: DataFrame, base: str | Column, page_col: str = "page_no",
                    container: str = "div.lst_wrap", max_pages: int | None = None) -> DataFrame:
    """SRC7: list items of numbered list pages, in page order semantics: a page whose fetch
    failed (null html) is skipped, and the first page that lists no item ends the scan (it and
    every later page are dropped).  ``max_pages`` caps the page numbers when given.

    The stop page is a scalar subquery of the plan (a min over the pages without an item); the items
    are never collected and nothing runs before the caller's action."""
    pages = list_pages if max_pages is None else list_pages.where(F.col(page_col).between(1, max_pages))
    fetched = pages.where(F.col("html").isNotNull())
    items = PG.list_items(fetched, base, container=container, key=page_col)
    per_page = (fetched.select(page_col)
                .join(items.groupBy(page_col).agg(F.count(F.lit(1)).alias("n")), page_col, "left"))
    stop = per_page.where(F.col("n").isNull()).agg(F.min(page_col).alias("stop")).scalar()
    return items.where(F.coalesce(F.col(page_col) < stop, F.lit(True)))
