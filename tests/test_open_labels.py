"""Records with labels that nobody listed."""

import pytest

from pawgrid import constants as K
from pawgrid.operators import pages as PG
from pawgrid.plans.crawl import crawl_table, open_crawl_table, widen

LIST = '<div class="lst_wrap"><ul>' + "".join(
    f'<li><a href="/d/{i}"><p class="top">name{i} x</p><p class="bottom"><span>공고번호 {i}</span></p></a></li>' for i in (1, 2, 3)) + "</ul></div>"


def detail(**labels):
    rows = "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in labels.items())
    return f'<p class="num">공고 번호 : 77</p><div class="tb_wrap"><table>{rows}</table></div>'


@pytest.fixture(scope="module")
def pages(spark):
    lists = spark.createDataFrame([(0, LIST), (1, None)], "page_id long, html string")
    details = spark.createDataFrame([("http://s/d/1", detail(a="1", b="2", surprise="x")), ("http://s/d/2", detail(b="3", other="y")),
                                     ("http://s/d/2", detail(b="3", other="y")), ("http://s/d/9", detail(lost="z")), (None, detail(a="0"))],
                                    "page_id string, html string")
    return lists, details


def test_no_label_is_lost(pages):
    lists, details = pages
    rows = {r[K.PAGE_ITEM_LINK]: r for r in open_crawl_table(lists, details, "http://s", ["a"]).collect()}
    assert len(rows) == 3
    assert rows["http://s/d/1"]["a"] == "1" and rows["http://s/d/1"]["other_labels"] == {
        "b": "2", "surprise": "x", K.PAGE_KEY_TAGS: None, K.PAGE_KEY_HOMES: None}
    assert rows["http://s/d/2"]["a"] is None and rows["http://s/d/2"]["other_labels"]["other"] == "y"
    assert rows["http://s/d/3"]["other_labels"] == {} and rows["http://s/d/3"][K.PAGE_KEY_NOTICE] == "3"
    assert rows["http://s/d/1"][K.PAGE_KEY_NOTICE] == "77"


def test_widened_equals_the_table_of_listed_labels(pages):
    lists, details = pages
    labels = ["a", "b", "surprise", "other", K.PAGE_KEY_TAGS, K.PAGE_KEY_HOMES]
    want = crawl_table(lists, details, "http://s", labels)
    got = widen(open_crawl_table(lists, details, "http://s"))
    assert set(got.columns) == set(want.columns)
    order = sorted(want.columns)
    assert sorted(map(str, got.select(*order).collect())) == sorted(map(str, want.select(*order).collect()))


def test_widen_refuses_too_many_labels_and_clashes(pages):
    lists, details = pages
    table = open_crawl_table(lists, details, "http://s")
    with pytest.raises(ValueError):
        widen(table, max_labels=2)
    with pytest.raises(ValueError):
        widen(table.withColumnRenamed("pos", "surprise"))


def test_inventory_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, html string")
    assert PG.label_inventory(PG.detail_maps(none)).collect() == []
