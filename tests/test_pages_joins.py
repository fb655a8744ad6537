"""Pages (PG1–PG11), suffixed joins (JN1–JN2), detail-wins merge (JN6), shaping (PRJ1–PRJ7)."""

from pyspark.sql import functions as F

from pawgrid.operators import joins as J
from pawgrid.operators import pages as PG
from pawgrid.operators import shaping as SH
from pawgrid.sources import sinks as SK

DETAIL = ('<p class="num">공고 번호 : 77</p><div class="info_box"><dl><dt>이름:</dt><dd> 콩 </dd></dl></div>'
          '<div class="tag_wrap"><p>#a</p><p> </p></div>'
          '<div class="tb_wrap"><table><tr><th>종류:</th><td>믹스</td></tr><tr><td>no header</td></tr></table></div>'
          '<div class="box pt40"><div class="check_i a">아파트</div><div class="check_i a"> </div></div>'
          '<div class="view_main"><div class="line"><p class="tit">임보 조건</p><div class="tb_wrap"><table>'
          '<tr><th>기간</th><td>3개월</td></tr></table></div></div>'
          '<div class="line"><p class="tit">참고용 정보</p><div class="box"><ul><li><p class="t_bef">키</p>'
          '<p class="a">&amp; 값</p></li></ul></div></div>'
          '<div class="line"><p class="tit">책임자 제공 사항</p><div class="box pt40"><div class="check_i a">사료</div>'
          '</div></div></div>')


def test_detail_records(spark):
    pages = spark.createDataFrame([(1, DETAIL), (2, "<html>nothing</html>")], "page_id long, html string")
    got = {(r.page_id, r.key): r.value for r in PG.detail_records(pages).collect()}
    assert got[(1, "공고번호")] == "77" and got[(1, "이름")] == "콩"
    assert got[(1, "해시태그")] == "#a, " and got[(1, "종류")] == "믹스"
    assert got[(1, "임보조건_기간")] == "3개월" and got[(1, "참고용정보_키")] == "& 값"
    assert got[(1, "이런_집도_가능해요")] == "아파트" and got[(1, "책임자_제공_사항")] == "사료"
    assert got[(2, "공고번호")] is None and got[(2, "해시태그")] is None and (2, "책임자_제공_사항") not in got


def test_info_box_fallback_lines(spark):
    html = '<div class="info_box"><dt>a</dt><dt>b</dt><dd>1</dd><span>k : v:w</span></div>'
    got = {r.key: r.value for r in PG.detail_records(spark.createDataFrame([(1, html)], "page_id long, html string"))
           .collect()}
    assert got["k"] == "v:w"


def test_list_items(spark):
    html = ('<div class="lst_wrap"><ul><li><a href="/v/1"><p class="top">콩이 (2살)</p>'
            '<p class="bottom"><span>지역</span><span>공고번호 123</span></p></a></li>'
            '<li>no anchor</li><li><a href="/v/2">x</a></li></ul></div>')
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = PG.list_items(pages, "https://site").orderBy("pos").collect()
    assert [(r.pos, r["상세링크"], r["이름"], r["공고번호"]) for r in rows] == \
        [(0, "https://site/v/1", "콩이", "123"), (2, "https://site/v/2", None, None)]


def test_markup_that_is_not_tidy(spark):
    """Two lists in a container with a second class, a single-quoted link, unclosed paragraphs, class
    lists, a block with two tables, nested boxes and all kinds of character references."""
    lst = ("<div class='wide lst_wrap'><ul><li><a href='/v/1'><p class='x top'>a b</a><li><a href=\"/v/2\">x</a></ul>"
           "<ul><li><a href=/v/3><pre>no p</pre></a></li><li><link><a href='/v/4'></a></li></ul></div>")
    rows = PG.list_items(spark.createDataFrame([(1, lst)], "page_id long, html string"), "s").orderBy("pos").collect()
    assert [(r["상세링크"], r["이름"]) for r in rows] == [("s/v/1", "a"), ("s/v/2", None), ("s/v/3", None), ("s/v/4", None)]
    page = ('<p class="num big">공고 번호 : 5</p><div class="info_box"><div><dl><dt>a:<dd>1</dl></div><dl><dt>b</dt><dd>2 &copy;</dd>'
            '</dl></div><div class="tb_wrap"><table><tr><th>x<td>1</table><table><thead><tr><th>y</th><td>2 &#183; &#xb7;</td>'
            '</tr></thead></table></div><div class="tag_wrap"><p>one<p>two <b>three</div>')
    got = {r.key: r.value for r in PG.detail_records(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()}
    assert got["공고번호"] == "5" and (got["a"], got["b"], got["x"], got["y"]) == ("1", "2 ©", "1", "2 · ·")
    assert got["해시태그"] == "one, twothree"


def test_suffix_join_and_shaping(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "uid long, addinfo01 string, state string")
    sub = spark.createDataFrame([(1, "s1"), (1, "s2")], "uid long, addinfo01 string")
    j = J.enrich(base, [sub])
    assert sorted(j.columns) == ["addinfo01_x", "addinfo01_y", "state", "uid"] and j.count() == 3
    out = SH.key_first(SH.rename_if_present(SH.drop_if_present(j, ["addinfo01_y", "absent"]),
                                            {"uid": "Pk", "nothing": "z"}), "Pk")
    assert out.columns[0] == "Pk" and "addinfo01_y" not in out.columns


def test_merge_text_columns(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None)], "p1 string, p2 string, p3 string")
    got = [r.m for r in SH.merge_text_columns(df, ["p1", "p2", "p3", "p4"], "m").collect()]
    assert got == ["a  c", None]


def _rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()),
                  key=lambda t: tuple((x is None, x if x is not None else 0) for x in t))


def test_equal_hot_rows_use_all_salts(spark):
    right = spark.createDataFrame([(1, "same")] * 1000 + [(2, "x")], "uid long, w string").repartition(3)
    hot = spark.createDataFrame([(1, True)], "uid long, __hot boolean")
    got = {(r.uid, r["__salt"]) for r in J.salt_hot_rows(right, hot, "uid", 8).collect()}
    assert got == {(1, i) for i in range(8)} | {(2, 0)}
    left = spark.createDataFrame([(1, "a"), (3, "b")], "uid long, v string")
    assert J.salted_left_join(left, right, "uid", salts=8, hot_fraction=0.1).count() == 1001


def test_left_join_strategies_agree(spark):
    # key 1 is hot on the right (a third of the rows and more), key 3 has no match, null keys on both sides
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "uid long, v string")
    sub = spark.createDataFrame([(1, f"r{i}") for i in range(30)] + [(2, "s"), (4, "t"), (None, "n")],
                                "uid long, w string")
    plain = base.join(sub, "uid", "left")
    assert _rows(J.split_left_join(base, sub, "uid")) == _rows(plain)
    assert _rows(J.salted_left_join(base, sub, "uid", salts=4, hot_fraction=0.1)) == _rows(plain)
    assert len(_rows(plain)) == 33


def test_heavy_keys_are_found_by_sketches(spark):
    n = 60_000
    k = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(-2)).when(F.col("id") % 7 == 2, None).otherwise(F.col("id"))
    df = spark.range(n).select(k.alias("uid"), F.lit("x").alias("w")).repartition(6)
    got = {r.uid: r.n for r in J.heavy_keys(df, "uid", 0.005, groups=2).collect()}
    real = {r.uid: r.n for r in df.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("uid < 0").collect()}
    rows = df.where("uid IS NOT NULL").count()
    assert set(got) == {-1, -2}  # fifty thousand other keys overflow the sketches
    assert all(abs(got[u] - real[u]) <= 0.0025 * rows for u in real)
    assert J.heavy_keys(df.where("uid IS NULL"), "uid", 0.1).collect() == []
    assert J.heavy_keys(df.select(F.col("uid").cast("string").alias("uid")), "uid", 0.1).first()["uid"] == "-1"
    assert sorted(r.uid for r in J.heavy_keys(spark.createDataFrame([(i,) for i in range(5)], "uid long"), "uid").collect()) == []


def test_salted_join_with_an_empty_or_null_right_side(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "uid long, v string")
    right = spark.createDataFrame([(1, "r"), (None, "n")], "uid long, w string")
    for r in (right, right.where("uid > 5"), right.where("uid IS NULL")):
        assert _rows(J.salted_left_join(left, r, "uid", salts=4, hot_fraction=0.1)) == _rows(left.join(r, "uid", "left"))


def test_salted_join_sketches_in_one_scan_without_a_shuffle_of_keys(spark, tmp_path):
    path = str(tmp_path / "right")
    spark.range(1000).select(F.col("id").alias("uid"), F.lit("x").alias("w")).write.parquet(path)
    plan = J.heavy_keys(spark.read.parquet(path), "uid")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_approx_top_k_accumulate" in plan and "hashpartitioning(uid" not in plan


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    a = spark.range(300).select(F.col("id").alias("uid"), (F.col("id") * 2).alias("v"))
    b = spark.range(0, 400, 3).select(F.col("id").alias("uid"), F.lit("w").alias("w"))
    ta = SK.save_bucketed(a, str(tmp_path / "a"), "uid", 6)
    tb = SK.save_bucketed(b, str(tmp_path / "b"), "uid", 6)
    joined = ta.join(tb.hint("merge"), "uid", "left")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert _rows(joined) == _rows(a.join(b, "uid", "left"))
    assert len(list((tmp_path / "a").glob("*.parquet"))) == 6  # one file a bucket
    assert _rows(SK.save_bucketed(a.limit(0), str(tmp_path / "a"), "uid", 6)) == []  # replaced, and an empty table
