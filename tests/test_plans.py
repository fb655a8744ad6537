"""End-to-end stage runs (PIPE3/PIPE4 and PIPE9) on tiny frames."""

import tempfile

from pyspark.sql import functions as F

from pawgrid.operators.vectors import hashing_embedder
from pawgrid.plans import crawl as CR
from pawgrid.plans import recommend as RC


def test_full_run_stages(spark):
    raw = spark.createDataFrame(
        [(1, "임보가능", "일반", "콩이", "남", "Y", "2023", "5", "#애교#순둥", "", "활발해요", "", "", "", "", ""),
         (2, "임보가능", "일반", "보리", "여", "N", "2015", "22", "#조용", "", "차분", "", "", "", "", ""),
         (3, "임보완료", "일반", "초코", "남", None, None, "abc", None, None, None, None, None, None, None, None)],
        "uid long, state string, kind string, addinfo01 string, addinfo03 string, addinfo04 string, "
        "addinfo05 string, addinfo07 string, addinfo08 string, addinfo09 string, addinfo10 string, "
        "addinfo11 string, addinfo16 string, addinfo19 string, addinfo20 string, addinfo02 string")
    queries = spark.createDataFrame([(1, "활발하고 애교 많은 소형견을 원해요"), (2, "차분한 아이")], "qid long, text string")
    out = RC.run(spark, raw, queries, hashing_embedder(16), 16, "https://site.example/", name="t" + next(tempfile._get_candidate_names()), k=5)
    c = out["candidates"].collect()
    assert {r.uid for r in c if r.qid == 1} == {1}          # small-size slot keeps only the 5 kg listing
    assert {r.uid for r in c if r.qid == 2} == {1, 2}       # closed listing never appears
    assert out["prompts"].count() == 2 and out["vectors"].count() == 3
    assert out["prepared"].where(F.col("gpt_description").isNull()).count() == 0


def test_crawl_table(spark):
    lst = ('<div class="lst_wrap"><ul><li><a href="/d/1"><p class="top">콩이 2살</p>'
           '<p class="bottom"><span>공고번호 11</span></p></a></li>'
           '<li><a href="/d/2"><p class="top">보리</p></a></li></ul></div>')
    lists = spark.createDataFrame([(1, lst)], "page_id long, html string")
    det = spark.createDataFrame(
        [("https://s/d/1", '<p class="num">공고 번호 : 99</p><div class="tb_wrap"><table><tr><th>종류</th><td>믹스</td></tr>'
                           '</table></div>'),
         ("https://s/d/2", "<div>none</div>")], "page_id string, html string")
    t = {r["상세링크"]: r for r in CR.crawl_table(lists, det, "https://s", ["종류"]).collect()}
    assert t["https://s/d/1"]["공고번호"] == "99" and t["https://s/d/1"]["종류"] == "믹스"
    assert t["https://s/d/2"]["공고번호"] is None and t["https://s/d/2"]["이름"] == "보리"
    log = CR.crawl_log_rows(CR.PG.list_items(lists, "https://s"), stamp=F.lit("t")).first()
    assert log.collected_count == 2 and log.animal_names == "콩이, 보리"


def test_scan_stops_at_first_empty_page_and_skips_failed(spark):
    def page(n):
        lis = "".join(f'<li><a href="/d/{n}{i}"><p class="top">a{n}{i}</p></a></li>' for i in range(2))
        return f'<div class="lst_wrap"><ul>{lis}</ul></div>'
    rows = [(1, page(1)), (2, None), (3, page(3)), (4, '<div class="lst_wrap"><ul></ul></div>'), (5, page(5))]
    pages = spark.createDataFrame(rows, "page_no long, html string")
    got = sorted((r.page_no, r["이름"]) for r in CR.scan_list_pages(pages, "https://s").collect())
    assert got == [(1, "a10"), (1, "a11"), (3, "a30"), (3, "a31")]
    assert CR.scan_list_pages(pages, "https://s", max_pages=1).count() == 2
