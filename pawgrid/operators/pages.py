"""Label/value extraction from stored web pages (PG1–PG12, JN7, WIN3, SRC8).

The job starts from a ``pages(page_id, url, html)`` table (fetching is out of scope).  Pages are
independent and no built-in parses HTML, so each page is parsed once inside ``mapInPandas`` by the
standard library's parser (``pagetree``) and yields its rows; extraction needs no shuffle.
Elements are found by tag, class list and descent, as a selector would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pawgrid import constants as K
from pawgrid.operators.pagetree import Node, parse


def _table(box: Node | None, prefix: str) -> dict[str, str]:
    """PG5 / PG6 / PG8: rows with a header and a value, of all tables of a block."""
    out: dict[str, str] = {}
    for table in box.all("table") if box else []:
        for row in table.all("tr"):
            head, value = row.first("th"), row.first("td")
            if head and value:
                out[prefix + head.text().replace(":", "").strip()] = value.text()
    return out


def _checked(box: Node) -> str | None:
    """PG7 / PG10: the checked items of a box, or null when none has text."""
    return ", ".join(t for t in (n.text() for n in box.all("div.check_i.a")) if t) or None


def _section(main: Node | None, title: str) -> Node | None:
    """WIN3: the first section whose title contains ``title``."""
    for line in main.all("div.line") if main else []:
        tit = line.first("p.tit")
        if tit and title in tit.text():
            return line
    return None


def _info(box: Node | None) -> dict[str, str]:
    """PG3 + JN7: dt/dd pairs when the counts agree, else ``k:v`` text lines."""
    if box is None:
        return {}
    dts, dds = box.all("dt"), box.all("dd")
    if dts and len(dts) == len(dds):
        return {t.text().replace(":", ""): d.text() for t, d in zip(dts, dds)}
    pairs = (line.split(":", 1) for line in "|".join(box.strings()).split("|") if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs}


def page_record(root: Node) -> dict[str, str | None]:
    """PG2–PG11: every label of a detail page with its value; a later label wins."""
    out: dict[str, str | None] = {}
    num = root.first("p.num")
    out[K.PAGE_KEY_NOTICE] = num.text().replace(K.PAGE_NOTICE_LABEL, "").strip() if num else None
    out.update(_info(root.first(".info_box")))
    tags = root.first(".tag_wrap")
    out[K.PAGE_KEY_TAGS] = ", ".join(p.text() for p in tags.all("p")) if tags else None
    out.update(_table(root.first("div.tb_wrap"), ""))
    main = root.first("div.view_main")
    care = _section(main, K.PAGE_SECTION_CARE[0])
    out.update(_table(care.first("div.tb_wrap") if care else None, K.PAGE_SECTION_CARE[1]))
    homes = root.first("div.box.pt40")
    out[K.PAGE_KEY_HOMES] = _checked(homes) if homes else None
    health = _section(main, K.PAGE_SECTION_HEALTH[0])
    out.update(_table(health.first("div.tb_wrap") if health else None, K.PAGE_SECTION_HEALTH[1]))
    ref = _section(main, K.PAGE_SECTION_REFERENCE[0])
    box = ref.first("div.box") if ref else None
    for ul in box.all("ul") if box else []:
        for li in ul.all("li"):
            label, value = li.first("p.t_bef"), li.first("p.a")
            if label and value:
                out[K.PAGE_SECTION_REFERENCE[1] + label.text()] = value.text()
    terms = _section(main, K.PAGE_SECTION_TERMS)
    box = terms.first("div.box.pt40") if terms else None
    if box:
        out[K.PAGE_KEY_TERMS] = _checked(box)
    return out


def page_items(root: Node, container: str) -> list[tuple[int, str, str | None, str | None]]:
    """PG1: (position, href, name, number) of every ``li`` of a list in the container, with an anchor."""
    seen: dict[int, Node] = {}
    for box in root.all(container):
        for ul in box.all("ul"):
            seen.update({id(li): li for li in ul.all("li")})
    out = []
    for pos, li in enumerate(seen.values()):
        anchor = li.first("a")
        if anchor is None or anchor.attrs.get("href") is None:
            continue
        top, bottom, name, number = anchor.first(".top"), anchor.first(".bottom"), None, None
        if top:
            name = next(iter(top.text().split()), None)
        for part in "|".join(bottom.strings()).split("|") if bottom else []:
            if K.PAGE_LIST_NOTICE_LABEL in part:
                number = part.strip().replace(K.PAGE_LIST_NOTICE_LABEL, "").strip()
        out.append((pos, anchor.attrs["href"], name, number))
    return out


def _per_page(pages: DataFrame, key: str, html: str, rows: Callable[[Node], list[tuple]], fields: str,
              keep: Column | None = None) -> DataFrame:
    """One parse per page: ``rows`` of the tree with the page's key (and ``keep``); a null page has none."""
    src = pages.select(F.col(key).alias("__key"), (keep if keep is not None else F.lit("")).alias("__keep"),
                       F.col(html).alias("__html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, b, *row) for k, b, h in zip(pdf["__key"], pdf["__keep"], pdf["__html"]) if isinstance(h, str)
                   for row in rows(parse(h))]
            if out:
                frame = pd.DataFrame(out, columns=names)
                yield frame.astype({"pos": "Int64"}) if "pos" in names else frame

    schema = f"`{key}` {src.schema['__key'].dataType.simpleString()}, __keep string, {fields}"
    names = [key, "__keep", *[f.split()[0] for f in fields.split(", ")]]
    return src.mapInPandas(run, schema)


def detail_records(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """PG11 + SRC8: long form ``(page_id, key, value)``, one row per label; a later label wins.

    Pivot to a wide table with ``readers.wide_records`` when the label set is known."""
    return _per_page(pages, key, html, lambda root: list(page_record(root).items()), "key string, value string") \
        .drop("__keep")


def detail_maps(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """PG11 + SRC8 without a list of labels: ``(page_id, labels map<string,string>)``, one row per page
    with every label the page has (a label without a value maps to null).  No grouping: the record is
    complete inside its page."""
    return _per_page(pages, key, html, lambda root: [(page_record(root),)], "labels map<string,string>").drop("__keep")


def label_inventory(maps: DataFrame, labels: str = "labels") -> DataFrame:
    """Every label of the records in one pass: ``(key, n_pages, n_values)`` (pages with it; with a value)."""
    return (maps.select(F.explode(labels).alias("key", "value")).groupBy("key")
            .agg(F.count(F.lit(1)).alias("n_pages"), F.count("value").alias("n_values")))


def list_items(pages: DataFrame, base: str | Column, container: str = "div.lst_wrap",
               key: str = "page_id", html: str = "html", mark_empty: bool = False) -> DataFrame:
    """PG1: ``(page_id, pos, 상세링크, 이름, 공고번호)`` for each ``li`` with an anchor in the container.

    Link = base + href; name = first word of the anchor's ``.top`` text (null without it);
    number = text after '공고번호' in the ``.bottom`` block (null without it).  With ``mark_empty`` a page
    that lists nothing has one row of nulls."""
    nothing = [(None, None, None, None)] if mark_empty else []
    items = _per_page(pages, key, html, lambda root: page_items(root, container) or nothing,
                      "pos long, href string, name string, number string", F.lit(base) if isinstance(base, str) else base)
    if mark_empty:
        items = items.withColumn("pos", F.when(F.col("href").isNotNull(), F.col("pos")))
    return items.select(key, "pos", F.concat("__keep", "href").alias(K.PAGE_ITEM_LINK), F.col("name").alias(K.PAGE_ITEM_NAME),
                        F.col("number").alias(K.PAGE_KEY_NOTICE))


def site_root(url: Column) -> Column:
    """``scheme://host`` of a URL (the base for relative links)."""
    return F.regexp_extract(url, r"^([a-zA-Z]+://[^/?#]+)", 1)


def page_texts(pages: DataFrame, container: str = "article", key: str = "page_id", html: str = "html") -> DataFrame:
    """PG4 on arbitrary pages: the ``p`` texts of all ``container`` blocks, ', '-joined, and their
    number; nulls for a page without the block."""
    def rows(root: Node) -> list[tuple]:
        boxes = root.all(container)
        if not boxes:
            return [(None, None)]
        found = {id(p): p for box in boxes for p in box.all("p")}
        return [(", ".join(p.text() for p in found.values()), len(found))]

    return _per_page(pages, key, html, rows, "texts string, n_paragraphs long").drop("__keep")
